"""Time limits: rules of a graph against an instance's facts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.calendar import apply_offset, let, offset_from_text, tolled
from factloom.functions.text import entity_similarity, normalise_entity, text_overlap
from factloom.lineage import cut

# Connectors that count the anchor day, and that don't.
INCLUSIVE = ("beginning with", "starting with", "commencing with", "beginning on", "starting on")
EXCLUSIVE = ("from the date on which", "from the date", "after the date", "following the date", "from", "after", "following")
# A period, what names the event it runs from, and what ends that name.
PERIOD = r"\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(?:year|month|week|day)s?\b"
RUNS_FROM = r"\b(?:beginning with|starting with|from the date(?:\s+on\s+which)?|from|of|after|following)\b\s+(.+)"
NAME_ENDS = r"[,;]|\bor\b|\bunless\b|\bwithin\b|\bto which\b|\bon which\b"


def _connector(sentence: Column) -> Column:
    """struct(at, longest, inclusive, connector, period) of the connector nearest behind the first stated period, longest on ties."""
    connectors = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(kind).alias("k")) for kind, listed in ((True, INCLUSIVE), (False, EXCLUSIVE)) for c in listed])
    # What stands behind the first period, in any line.
    tail = lambda p: F.lower(F.substring(sentence, F.instr(sentence, F.nullif(p, F.lit(""))) + F.length(p), F.length(sentence)))
    place = lambda t, p: lambda x: F.struct(F.call_function("locate", x["c"], t).alias("at"), (-F.length(x["c"])).alias("longest"), x["k"].alias("inclusive"), x["c"].alias("connector"), p.alias("period"))
    nearest = lambda t, p: F.array_min(F.filter(F.transform(connectors, place(t, p)), lambda x: x["at"] > 0))
    return let(F.nullif(F.regexp_extract(sentence, f"(?i){PERIOD}", 0), F.lit("")), lambda p: F.when(p.isNotNull(), let(tail(p), lambda t: nearest(t, p))))


def anchor_day_inclusive(sentence: Column) -> Column:
    """True, false, or null where no period or no connector is stated."""
    return _connector(sentence)["inclusive"]


def inclusivity_evidence(sentence: Column) -> Column:
    """The words from the period to the connector that R02 was read from."""
    return let(_connector(sentence), lambda found: _evidence(sentence, found))


def _evidence(sentence: Column, found: Column) -> Column:
    return F.substring(sentence, F.instr(sentence, found["period"]), F.length(found["period"]) + found["at"] - 1 - found["longest"])


def anchor_phrase(sentence: Column) -> Column:
    """What the first stated period runs from, as its clause names it; null if it doesn't."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rest = F.regexp_extract(sentence, rf"(?is){PERIOD}(.*)", 1)
    tail = F.regexp_replace(strip(F.regexp_extract(rest, f"(?i){RUNS_FROM}", 1)), r"\.+$", "")
    name = strip(F.element_at(F.split(tail, NAME_ENDS), 1))
    return F.nullif(strip(F.regexp_replace(name, r"(?i)^(the|a|an)\s+", "")), F.lit(""))


def reanchored(rules: DataFrame, facts: DataFrame, min_gain: float = 0.2, poor: float = 0.4) -> DataFrame:
    """Rules whose clause names an anchor, with the fact of their document that fits the name best.

    It must fit better than the present anchor by over ``min_gain``, first of equals; if no other
    fact does and the present one fits under ``poor``, the name itself is the anchor.
    """
    order = [c for c in ("fact_pos", "pos") if c in facts.columns][:1] + ["_id"]
    others = facts.select("doc_id", F.col("fact_id").alias("_id"), *[c for c in order if c != "_id"], F.col("entity").alias("_entity"), F.col("sentence").alias("_sentence"))
    rules = rules.withColumn("_now", text_overlap(F.col("phrase"), normalise_entity(F.col("anchor_entity"))))
    fit = F.greatest(text_overlap(F.col("phrase"), normalise_entity(F.col("_entity"))), text_overlap(F.col("phrase"), F.coalesce("_sentence", F.lit(""))))
    better = rules.where(F.col("phrase").isNotNull()).select("doc_id", "dep_pos", "phrase", "_now").join(others, "doc_id").withColumn("_fit", fit).where(F.col("_fit") > F.col("_now") + min_gain)
    first = Window.partitionBy("doc_id", "dep_pos").orderBy(F.desc("_fit"), *order)
    best = better.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("doc_id", "dep_pos", "_id", "_entity", "_sentence")
    out = rules.join(best, ["doc_id", "dep_pos"], "left")
    other, named = F.coalesce(F.col("_id") != F.col("from_id"), F.lit(False)), F.col("phrase").isNotNull() & (F.col("_now") < poor)
    pick = lambda found, now: F.when(other, F.col(found)).when(named, F.col("phrase")).otherwise(F.col(now))
    return out.withColumns({"anchor_entity": pick("_entity", "anchor_entity"), "anchor_sentence": pick("_sentence", "anchor_sentence")}).drop("_now", "_id", "_entity", "_sentence")


def edge_offset(expr: Column, values: list[Column], durations: list[Column], delta_days: Column) -> Column:
    """struct(years, months, days) of an edge; null if it states none.

    Its text, unless that is in days only and an end states months or years (a period flattened
    to days); else the ends' values and sentences in order, their days, or positive delta_days.
    """
    own, said = offset_from_text(expr), F.coalesce(*[offset_from_text(v) for v in values])
    in_days = lambda d: F.when(d > 0, F.struct(F.lit(0).alias("years"), F.lit(0).alias("months"), d.cast("int").alias("days")))
    flattened = (own["years"] == 0) & (own["months"] == 0) & ((said["years"] > 0) | (said["months"] > 0))
    return F.coalesce(F.when(~F.coalesce(flattened, F.lit(False)), own), said, *map(in_days, [*durations, delta_days]))


def find_rules(facts: DataFrame, deps: DataFrame, minus_one_day: bool | None = None, reanchor: bool = True) -> DataFrame:
    """One row for each additive edge with an offset. deps: the trusted ones.

    Whether the anchor day counts is read from the ends' sentences, else from the document's
    sentences in order; unread connectors take ``minus_one_day``, else the day counts.
    """
    more = [c for c in ("duration_days",) if c in facts.columns]
    order = [F.col(c) for c in ("fact_pos", "pos") if c in facts.columns][:1] + [F.col("fact_id")]
    side = lambda p: facts.select("doc_id", F.col("fact_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("entity", "sentence", "value", "role", *more)])
    joined = deps.where(F.col("constraint_type") == "additive").join(side("from"), ["doc_id", "from_id"]).join(side("to"), ["doc_id", "to_id"])
    readable = facts.where(anchor_day_inclusive(F.col("sentence")).isNotNull())
    elsewhere = readable.groupBy("doc_id").agg(F.min_by("sentence", F.struct(*order)).alias("_elsewhere"))
    joined = joined.join(elsewhere, "doc_id", "left")
    clauses = [F.col(c) for c in ("from_sentence", "to_sentence", "_elsewhere")]
    read = F.coalesce(*map(anchor_day_inclusive, clauses))
    evidence = F.coalesce(*[F.when(anchor_day_inclusive(c).isNotNull(), inclusivity_evidence(c)) for c in clauses])
    inclusive = F.coalesce(read, F.lit(True if minus_one_day is None else minus_one_day))
    offset = edge_offset(F.col("constraint_expr"), [F.col(c) for c in ("from_value", "from_sentence", "to_value", "to_sentence")], [F.col(f"{p}_{c}") for p in ("from", "to") for c in more], F.col("delta_days"))
    out = joined.withColumn("o", offset).where(F.col("o").isNotNull())
    out = out.withColumns({"anchor_entity": F.col("from_entity"), "anchor_sentence": F.col("from_sentence"), "phrase": F.coalesce(*[anchor_phrase(F.col(c)) for c in ("constraint_expr", "from_sentence", "from_value", "to_sentence", "to_value")])})
    out = reanchored(out, facts) if reanchor else out
    text = F.concat_ws(" ", F.col("to_entity"), F.lit("="), F.col("anchor_entity"), F.lit("+"), F.concat_ws("", *[F.when(F.col(f"o.{u}") > 0, F.concat(F.col(f"o.{u}").cast("string"), F.lit(u[0]))) for u in ("years", "months", "days")]), F.when(inclusive, "- 1 day"))
    return out.select(
        "doc_id", "dep_pos", "anchor_entity", F.col("to_entity").alias("target_entity"), "anchor_sentence", F.col("to_sentence").alias("target_sentence"), "o.*",
        inclusive.alias("minus_one_day"), F.when(read.isNull(), "assumed").otherwise("read").alias("inclusivity_source"), evidence.alias("evidence"), text.alias("description"),
    )


def alias_score(phrase: Column, entity: Column, role: Column, plain: Column, end_only: Column, noise: Column) -> Column:
    """1 for the phrase itself, 0.75 if an alias stands in the name and nothing procedural does, or is the name."""
    low = normalise_entity(entity)
    noisy = F.exists(noise, lambda n: F.contains(low, F.lower(n)))
    hit = lambda listed: F.exists(listed, lambda a: F.contains(low, F.lower(a)) & (~noisy | (low == F.lower(a))))
    return F.when(low == normalise_entity(phrase), 1.0).when(hit(plain) | ((F.upper(role) == "END") & hit(end_only)), 0.75).otherwise(0.0)


# Words of what a time limit applies to, and of other steps of a procedure.
ACTION_CUES = tuple("claim complaint application presented present presentation filed filing lodged submission submitted notice request proceedings".split())
PROCEDURAL_NOISE = tuple("appeal hearing refusal rejection grounds judgment reconsideration grievance confirmation response witness".split())


@dataclass(frozen=True)
class Vocabulary:
    """What a rule pack calls things; a parameter, never a global."""

    aliases: dict[str, tuple[str, ...]]
    end_only: dict[str, tuple[str, ...]]
    cues: tuple[str, ...] = ACTION_CUES
    noise: tuple[str, ...] = PROCEDURAL_NOISE


EMPTY = Vocabulary({}, {})


def check(
    rules: DataFrame, facts: DataFrame, vocabulary: Vocabulary = EMPTY, tolled_from: Column | None = None, tolled_to: Column | None = None,
    floor: float = 0.15, band: float = 0.10, max_rules: int = 1000, most_passed: int = 20, floor_after_end: tuple[int, int, int] = (0, 0, 0),
) -> DataFrame:
    """Rules against dated facts, a row for each rule.

    The best anchor wins (first on ties, at least ``floor``). INDETERMINATE: no fact is dated, no
    anchor fits, the rule names a concept of the vocabulary and its best anchor is neither it nor an
    alias, or aliases of several dates fit and none is the concept itself. The action is the earliest
    fact after the anchor within ``band`` of the best fit with the target, among those with a cue
    word if there are any; without one the best must reach 0.25, else the latest fact is taken.
    Days over 0 is LATE. The trace lists the ``most_passed`` best of the facts that were not chosen.

    Rules are few and broadcast by their size; facts are only aggregated by rule, before any shuffle.
    """
    for column in ("target_sentence", "evidence"):
        rules = rules if column in rules.columns else rules.withColumn(column, F.lit(None).cast("string"))
    dated = facts.where(F.col("date_parsed").isNotNull() & F.col("is_duplicate_of").isNull()).select(*[F.col(c).alias(f"f_{c}") for c in ("doc_id", "fact_id", "pos", "entity", "sentence", "role", "date_parsed")])
    none = F.array().cast("array<string>")
    holds = lambda concept: F.contains(normalise_entity(F.col("anchor_entity")), F.lit(concept.lower()))
    table = lambda d: F.concat(none, *[F.when(holds(k), F.array(*map(F.lit, v)).cast("array<string>")).otherwise(none) for k, v in d.items()])
    listed = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    keyed = rules.withColumns({"rule": F.concat_ws(":", "doc_id", F.col("dep_pos").cast("string")), "plain": table(vocabulary.aliases), "ends": table(vocabulary.end_only), "concept": reduce(or_, map(holds, {**vocabulary.aliases, **vocabulary.end_only}), F.lit(False))})
    # Every rule is tried on every dated fact: rules come from a rule pack of a few clauses, found once.
    keyed = cut(keyed)
    if keyed.count() > max_rules:
        raise ValueError(f"more than {max_rules} rules; check them pack by pack")
    met = dated.join(F.broadcast(keyed), F.lit(True))
    alias = alias_score(F.col("anchor_entity"), F.col("f_entity"), F.col("f_role"), F.col("plain"), F.col("ends"), listed(vocabulary.noise))
    likeness = (entity_similarity(F.col("anchor_entity"), F.col("f_entity")) + text_overlap(F.col("anchor_sentence"), F.col("f_sentence"))) / 2
    scored = met.withColumns({"alias": alias, "s": F.greatest(alias, likeness)})
    fact = F.struct("f_doc_id", "f_fact_id", "f_date_parsed", "f_entity", "s", "alias", "concept")
    anchors = scored.groupBy("rule").agg(
        F.max_by(F.when(F.col("s") >= floor, fact), F.when(F.col("s") >= floor, F.struct("s", (-F.col("f_pos")).alias("p"), "f_doc_id", "f_fact_id"))).alias("a"),
        F.sort_array(F.collect_set(F.when(F.col("alias") >= 0.75, F.col("f_date_parsed")))).alias("options"), F.max("alias").alias("best_alias"),
    )
    apt = ~F.col("a.concept") | (F.col("a.alias") >= 0.75)
    disputed = (F.size("options") > 1) & (F.col("best_alias") < 1)
    anchors = anchors.select("rule", F.when(apt, F.col("a")).alias("a"), "options", (F.coalesce(apt, F.lit(False)) & disputed).alias("disputed"))
    anchors = anchors.withColumn("anchor", F.when(~F.col("disputed"), F.col("a")))
    anchors = cut(anchors)
    known = anchors.where(F.col("anchor").isNotNull()).select("rule", *[F.col(f"anchor.{c}").alias(n) for c, n in (("f_date_parsed", "anchor_date"), ("f_fact_id", "anchor_fact"), ("f_doc_id", "anchor_doc"), ("s", "anchor_score"))])
    after = met.join(F.broadcast(known), "rule").where((F.col("f_date_parsed") > F.col("anchor_date")) & ~((F.col("f_fact_id") == F.col("anchor_fact")) & (F.col("f_doc_id") == F.col("anchor_doc"))))
    name, target = normalise_entity(F.col("f_entity")), F.concat_ws(" ", normalise_entity(F.col("target_entity")), "target_sentence")
    cued = F.exists(listed(vocabulary.cues), lambda c: F.contains(name, c))
    fit = F.greatest(text_overlap(target, name), text_overlap(target, F.coalesce("f_sentence", F.lit("")))) + F.when(cued, 0.15).otherwise(0.0)
    pool = after.select("rule", "f_doc_id", "f_fact_id", "f_pos", "f_date_parsed", cued.alias("cued"), fit.alias("fit"))
    best = pool.groupBy("rule").agg(F.max(F.when(F.col("cued"), F.col("fit"))).alias("best_cued"), F.max("fit").alias("best_any"))
    best = best.select("rule", F.col("best_cued").isNotNull().alias("any_cue"), F.coalesce("best_cued", "best_any").alias("best"))
    judged = pool.join(F.broadcast(best), "rule").withColumn("taken", (F.col("cued") | ~F.col("any_cue")) & (F.col("fit") >= F.col("best") - band) & (F.col("any_cue") | (F.col("best") >= 0.25)))
    chosen = F.struct(F.col("f_doc_id").alias("doc_id"), F.col("f_fact_id").alias("fact_id"), F.col("f_date_parsed").alias("date"))
    place = lambda d: F.struct(d.alias("d"), F.col("f_pos").alias("p"), F.col("f_doc_id").alias("i"), F.col("f_fact_id").alias("j"))
    early, late = F.unix_date("f_date_parsed"), -F.unix_date("f_date_parsed")
    action = judged.groupBy("rule").agg(F.min_by(F.when(F.col("taken"), chosen), F.when(F.col("taken"), place(early))).alias("match"), F.min_by(chosen, place(late)).alias("last"), F.first("best").alias("best"), F.count("*").alias("n_after"))
    action = action.select("rule", F.coalesce("match", "last").alias("action"), F.when(F.col("match").isNotNull(), F.least("best", F.lit(1.0))).otherwise(0.2).alias("action_score"), "n_after")
    top = judged.withColumn("_r", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("fit"), "f_pos", "f_doc_id", "f_fact_id"))).where(F.col("_r") <= most_passed + 1)
    passed = top.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("fit", F.col("f_fact_id").alias("fact_id"), F.col("f_date_parsed").alias("date"), F.col("f_doc_id").alias("doc_id"))), False).alias("candidates"))
    out = keyed.join(anchors, "rule", "left").join(known, "rule", "left").join(action, "rule", "left").join(passed, "rule", "left")
    base = apply_offset(F.col("anchor_date"), F.col("years"), F.col("months"), F.col("days"), F.col("minus_one_day"))
    deadline = base if tolled_from is None else tolled(base, tolled_from, tolled_to, floor_after_end)
    own = lambda x: (x["fact_id"] == F.col("action.fact_id")) & (x["doc_id"] == F.col("action.doc_id"))
    out = out.withColumns({"deadline": deadline, "deadline_base": base, "action_date": F.col("action.date"), "action_fact": F.col("action.fact_id"), "candidates": F.slice(F.filter("candidates", lambda x: ~F.coalesce(own(x), F.lit(False))), 1, most_passed)})
    over = F.datediff("action_date", "deadline")
    verdict = F.when(F.col("deadline").isNull() | F.col("action_date").isNull(), "INDETERMINATE").when(over <= 0, "TIMELY").otherwise("LATE")
    is_disputed = F.coalesce("disputed", F.lit(False))
    request = F.when(is_disputed, F.lit("which date of the anchor holds")).when(F.col("anchor_date").isNull(), F.concat(F.lit("a date for "), "anchor_entity")).when(F.col("action_date").isNull(), F.concat(F.lit("a date for "), "target_entity"))
    confidence = F.when(is_disputed, 0.1).when(F.col("anchor_score").isNull(), 0.0).when(F.col("action_score").isNull(), F.col("anchor_score")).otherwise((F.col("anchor_score") + F.col("action_score")) / 2)
    trace = F.struct("description", "evidence", "anchor_fact", "anchor_date", "anchor_score", "options", "deadline_base", "deadline", "action_fact", "action_score", "n_after", "candidates")
    return out.select("doc_id", "dep_pos", "anchor_date", "deadline", "action_date", over.alias("days_over"), verdict.alias("verdict"), confidence.alias("confidence"), request.alias("request"), trace.alias("trace"))
