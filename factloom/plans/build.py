"""From a folder of document graphs to a chronology, and the commands on it."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.lineage import cut
from factloom.operators import corrections, events, graph, linking, provenance, retrieval, rules
from factloom.plans import packs
from factloom.sources import bundles, sinks


@dataclass(frozen=True)
class Chronology:
    """events: placed and unplaced, with sources; facts: with dates, verification and cluster; deps: trusted."""

    events: DataFrame
    facts: DataFrame
    deps: DataFrame
    links: DataFrame


def key(doc: str = "doc_id", fact: str = "fact_id") -> Column:
    return F.concat_ws(":", doc, fact)


def build_chronology(bundle: bundles.Bundle, log: DataFrame | None = None, bar: float = linking.BAR) -> Chronology:
    """Corrections, derivation, provenance, links inside matters, clusters, classes."""
    facts = bundle.facts if log is None else corrections.apply(bundle.facts, log).drop("accepted")
    deps = provenance.trusted(provenance.check_relations(bundle.deps, facts, bundle.documents))
    facts = provenance.check_facts(graph.derive_dates(facts, deps), bundle.documents)
    documents = cut(linking.matter_groups(bundle.documents))
    grouped = documents.select("doc_id", "doc_pos", "grp", "matter", linking.party_keys(F.col("parties")).alias("keys"))
    facts = cut(facts.join(grouped, "doc_id").withColumn("pos", F.col("doc_pos").cast("long") * 1_000_000 + F.col("fact_pos")))
    spans = linking.document_spans(facts).select("doc_id", "span_days")
    statistics = linking.token_statistics(linking.document_texts(documents, facts))
    pairs = linking.candidate_pairs(facts.join(spans, "doc_id"), statistics, bar=bar)
    links = linking.composed_links(linking.one_to_one(pairs, ["a_doc_id", "b_doc_id"], "a_fact_id", "b_fact_id"))
    joined = links.select(key("from_doc", "from_fact").alias("a"), key("to_doc", "to_fact").alias("b"), "link_type")
    merges, splits = corrections.merges_and_splits(log) if log is not None else (None, None)
    keyed = facts.withColumns({"key": key(), "duplicate_key": F.when(F.col("is_duplicate_of").isNotNull(), key("doc_id", "is_duplicate_of"))})
    clustered = events.cluster_facts(keyed, joined, merges, splits)
    contradicted = joined.where("link_type = 'contradiction'").join(clustered.select(F.col("key").alias("a"), "cluster"), "a")
    sources = clustered.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("doc_id", "fact_id", F.col("sentence").alias("quote"), F.col("date_parsed").alias("date")))).alias("sources"))
    return Chronology(events.classify(clustered, contradicted).join(sources, "cluster"), clustered, deps, links)


def main(argv: list[str] | None = None) -> int:
    """build, contradictions, whatif, stale, interval, context, deadline, validate, rulepack.

    Exit 1: nothing to read, or errors in validate or rulepack; 2: a deadline is INDETERMINATE; 3: no facts.
    """
    parser = argparse.ArgumentParser(prog="factloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in {
        "build": ["--out", "--format", "--corrections"], "contradictions": [], "whatif": ["--fact", "--date"], "stale": ["--fact"], "interval": ["--entity", "--on"],
        "context": ["--about", "--since", "--until", "--on"], "deadline": ["--rules"], "validate": [], "rulepack": [],
    }.items():
        command = commands.add_parser(name)
        command.add_argument("folder")
        command.add_argument("--matter-field", default="matter")
        for option in options:
            command.add_argument(option)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    try:
        return run(spark, args)
    except Exception as error:  # one readable line, no traceback
        print(f"{args.command}: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "rulepack":
        checks = packs.self_test(spark, args.folder).collect()
        print("\n".join(f"{'ok' if r['passed'] else 'FAIL'}: {r['check']} {r['subject']}: {r['message']}" for r in checks))
        return int(not all(r["passed"] for r in checks))
    bundle = bundles.read_graphs(spark, args.folder, matter_field=args.matter_field, generic_ids=bundles.COMMAND_GENERIC_IDS)
    if args.command == "validate":
        messages = [f"{r['doc_id']}: {r['message']}" for r in bundles.validate(bundle).collect()]
        print("\n".join(messages) or "valid")
        return int(bool(messages))
    if bundle.documents.isEmpty():
        print("no documents", file=sys.stderr)
        return 1
    if bundle.facts.isEmpty():
        print("no facts", file=sys.stderr)
        return 3
    log = bundles.read_corrections(spark, args.corrections) if getattr(args, "corrections", None) else None
    if args.command == "deadline":
        pack = bundles.read_graphs(spark, args.rules, "*.tdg.json") if bundles._exists(spark, f"{args.rules}/statute.tdg.json") else bundles.read_graphs(spark, args.rules)
        found = rules.find_rules(pack.facts, provenance.trusted(provenance.check_relations(pack.deps, pack.facts, pack.documents)))
        instance = bundle.facts.withColumn("pos", F.col("fact_pos"))
        results = rules.check(found, instance, packs.vocabulary(spark, args.rules))
        print("\n".join(r["line"] for r in sinks.render_line(results).collect()))
        return 2 if results.where("verdict = 'INDETERMINATE'").count() else 0
    chron = build_chronology(bundle, log)
    if args.command == "build":
        if args.out:
            sinks.EXPORTERS[args.format or "csv"](events.chronology(chron.events), args.out)
        print(events.run_counts(chron.events).first().asDict())
        return 0
    if args.command == "contradictions":
        shown = retrieval.contradiction_report(chron.links)
    elif args.command == "interval":
        shown = retrieval.holds_on(chron.facts, args.entity, args.on)
    elif args.command == "context":
        shown = sinks.context_block(retrieval.select_events(chron.events, args.about or "", args.since, args.until, args.on))
    else:
        doc, _, fact = args.fact.rpartition(":")
        changed = spark.createDataFrame([(doc, fact)], "doc_id string, fact_id string")
        if changed.join(chron.facts, ["doc_id", "fact_id"], "left_semi").isEmpty():
            raise ValueError(f"no fact {args.fact}; there are: " + ", ".join(r[0] for r in chron.facts.select("key").limit(20).collect()))
        shown = graph.stale(changed, chron.deps, chron.links.where("link_type = 'coreference'")) if args.command == "stale" else graph.what_if(chron.facts, chron.deps, changed.withColumn("date", F.lit(args.date).cast("date")))
    for row in shown.collect():
        print(row.asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
