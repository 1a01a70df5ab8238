"""Rule packs: what a folder holds and whether it keeps its own promises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.lineage import cut
from factloom.operators import provenance, rules
from factloom.sources import bundles


def vocabulary(spark: SparkSession, folder: str) -> rules.Vocabulary:
    """The pack's words; its cues and noise add to the usual ones. A pack is a few clauses, so its words are collected."""
    if not bundles._exists(spark, f"{folder}/aliases.json"):
        return rules.EMPTY
    plain: dict[str, tuple[str, ...]] = {}
    ends: dict[str, tuple[str, ...]] = {}
    more: dict[str, list[str]] = {"action_cues": [*rules.ACTION_CUES], "procedural_noise": [*rules.PROCEDURAL_NOISE]}
    for r in bundles.read_vocabulary(spark, f"{folder}/aliases.json").collect():
        if r["kind"] in more:
            more[r["kind"]].append(r["term"].lower())
        elif r["kind"] in ("plain", "end_role_only"):
            of = plain if r["kind"] == "plain" else ends
            of[r["concept"]] = (*of.get(r["concept"], ()), r["term"])
    cues, noise = (tuple(dict.fromkeys(more[k])) for k in ("action_cues", "procedural_noise"))
    return rules.Vocabulary(plain, ends, cues, noise)


def expectations(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, verdict, deadline of the pack's gold cases."""
    raw = spark.read.option("wholetext", True).text(f"{folder}/expected.json")
    cases = raw.select(F.explode(F.from_json("value", "map<string, struct<verdict: string, deadline: string>>")).alias("file_name", "e"))
    return cases.select("file_name", "e.verdict", F.col("e.deadline").cast("date").alias("deadline"))


def self_test(spark: SparkSession, folder: str) -> DataFrame:
    """Check, subject, passed, message: the statute is valid, its periods stand in its text, a rule is found, and each gold case ends as expected."""
    statute = bundles.read_graphs(spark, folder, "statute.tdg.json")
    row = lambda check, subject, passed, message: [F.lit(check).alias("check"), subject.alias("subject"), passed.alias("passed"), message.alias("message")]
    broken = bundles.validate(statute).select(*row("schema", F.col("doc_id"), F.lit(False), F.col("message")))
    checked = provenance.check_relations(statute.deps, statute.facts, statute.documents)
    verdict = F.col("relation_verdict")
    support = checked.where(verdict.isNotNull()).select(*row("relation", F.concat_ws(" -> ", "from_id", "to_id"), verdict == "supported", verdict))
    found = rules.find_rules(statute.facts, provenance.trusted(checked))
    discovered = found.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("description")), "; ").alias("d")).select(*row("discovery", F.lit("rules"), F.col("n") > 0, F.col("d")))
    out = broken.union(support).union(discovered)
    if not bundles._exists(spark, f"{folder}/expected.json"):
        return out
    cases, words = bundles.read_graphs(spark, f"{folder}/gold_cases"), vocabulary(spark, folder)
    names, facts, found = (cut(x) for x in (cases.documents.select("doc_id", "file_name"), cases.facts.withColumn("pos", F.col("fact_pos")), found))
    # Each case is an instance of its own, and a pack holds a few.
    done = []
    for r in names.collect():
        results = rules.check(found, facts.where(F.col("doc_id") == r["doc_id"]), words).select("dep_pos", "verdict", "deadline").collect()
        done += [(r["doc_id"], *x) for x in results]
    done = spark.createDataFrame(done, "doc_id string, dep_pos int, verdict string, deadline date")
    first = done.join(names, "doc_id").groupBy("file_name").agg(F.min_by(F.struct("verdict", "deadline"), "dep_pos").alias("r"))
    wanted = expectations(spark, folder).select("file_name", F.col("verdict").alias("w"), F.col("deadline").alias("d")).join(first, "file_name", "left")
    good = (F.col("r.verdict") == F.col("w")) & (F.col("d").isNull() | F.col("r.deadline").eqNullSafe(F.col("d")))
    said = F.concat_ws(" ", F.coalesce("r.verdict", F.lit("no result")), F.date_format("r.deadline", "yyyy-MM-dd"))
    return out.union(wanted.select(*row("gold case", F.col("file_name"), F.coalesce(good, F.lit(False)), said)))
