"""Cross-document linking: statistics, matter partition, candidates, one-to-one matching."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import calendar, scores
from factloom.functions.text import STOP_SHORT, jaccard, normalise_entity, party_key, same_matter, supporting_quote, telling_words, tokens
from factloom.lineage import cut
from factloom.operators.events import components, numbered

# The bar holds without an embedding model, 0.60 with one.
FLOOR, BAR = 0.12, 0.50


def token_statistics(texts: DataFrame, group: str = "grp", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Group, token, df, n, idf, universal."""
    n = texts.groupBy(group).agg(F.count_distinct(doc).alias("n"))
    words = texts.select(group, doc, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
    if not _one_row_each(texts, group, doc):
        words = words.distinct()
    # Each document has a word once and is null or not, so counts combine before the shuffle.
    df = words.groupBy(group, "token").agg(F.count(doc).alias("df"))
    joined = df.join(n, group)
    return joined.withColumns({"idf": scores.idf(F.col("df"), F.col("n")), "universal": scores.is_universal(F.col("df"), F.col("n"))})


def _one_row_each(texts: DataFrame, group: str, doc: str) -> bool:
    """Whether no document has two rows in a group; reads these two columns only."""
    return texts.groupBy(group, doc).agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()


def discriminative_tokens(texts: DataFrame, statistics: DataFrame, top: int = 12, group: str = "grp", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's tokens of highest idf * (1 + ln tf), not universal; ties by first place."""
    places = texts.select(group, doc, F.posexplode(tokens(F.col(text))).alias("place", "token"))
    counted = places.groupBy(group, doc, "token").agg(F.count("*").alias("tf"), F.min("place").alias("first"))
    scored = counted.join(statistics.where(~F.col("universal")), [group, "token"]).withColumn("score", F.col("idf") * (1 + F.log("tf")))
    w = Window.partitionBy(group, doc).orderBy(F.desc("score"), "first")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(group, doc, "token", "tf", "score", "rank")


def weighted_pairs(texts: DataFrame, pairs: DataFrame, group: str = "grp") -> DataFrame:
    """Jaccard and containment of given pairs doc_id, other by their tokens' idf.

    Sums come from one row for each document and token, so no table of weights is broadcast.
    """
    words = texts.select(group, "doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).join(token_statistics(texts, group), [group, "token"]).select("doc_id", "token", "idf")
    whole = words.groupBy("doc_id").agg(F.sum("idf").alias("w"))
    left = pairs.join(words, "doc_id")
    both = left.join(words.select(F.col("doc_id").alias("other"), "token"), ["other", "token"]).groupBy("doc_id", "other").agg(F.sum("idf").alias("both"))
    sized = pairs.join(whole.withColumnRenamed("w", "wa"), "doc_id").join(whole.select(F.col("doc_id").alias("other"), F.col("w").alias("wb")), "other").join(both, ["doc_id", "other"], "left")
    shared = F.coalesce("both", F.lit(0.0))
    return sized.select("doc_id", "other", (shared / (F.col("wa") + F.col("wb") - shared)).alias("jaccard"), ((shared / F.col("wa") + shared / F.col("wb")) / 2).alias("containment"))


def document_spans(facts: DataFrame, group: str = "grp") -> DataFrame:
    """Each document's dates and its group's span in days."""
    spans = facts.groupBy(group, "doc_id").agg(F.min("date_parsed").alias("lo"), F.max("date_parsed").alias("hi"))
    w = Window.partitionBy(group)
    return spans.withColumn("span_days", F.coalesce(F.datediff(F.max("hi").over(w), F.min("lo").over(w)), F.lit(0)))


def party_keys(parties: Column) -> Column:
    """The keys of named parties that hold a word, each as sorted words."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(parties, F.array().cast("array<string>")), party_key), lambda k: F.size(k) > 0))


def _contained_keys(keys: DataFrame) -> DataFrame:
    """a, b: pairs of distinct keys (k: words), a contained in b. They meet at a's rarest word."""
    words = keys.select("k", F.explode("k").alias("w"))
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    rarest = words.join(df, "w").groupBy("k").agg(F.min_by("w", F.struct("df", "w")).alias("w"))
    met = rarest.withColumnRenamed("k", "a").join(words.withColumnRenamed("k", "b"), "w")
    return met.where((F.col("a") != F.col("b")) & (F.size(F.array_except("a", "b")) == 0)).select("a", "b")


def matter_groups(documents: DataFrame) -> DataFrame:
    """Documents with grp, the components of pairs that may be linked.

    Two declared matters must be equal; else, where both name parties, a key of one must lie in a
    key of the other; else the pair is free. No pair of documents is made: documents meet at their
    matter, at their keys and the keys that contain these, and what is free with whole classes of
    documents meets at one node.
    """
    node = lambda prefix, c: F.concat(F.lit(prefix), c)
    doc, one = node("d:", F.col("doc_id")), F.lit("any")
    keyed = cut(documents.select("doc_id", "matter", party_keys(F.col("parties")).alias("keys")))
    has, named = F.col("matter").isNotNull(), F.size("keys") > 0
    edges = keyed.where(has).select(doc.alias("a"), node("m:", F.col("matter")).alias("b"))
    # Keys decide only between pairs of which one declares no matter: its keys are the nodes.
    text = lambda c: node("p:", F.array_join(c, " "))
    open_keys = cut(keyed.where(~has).select("doc_id", F.explode("keys").alias("k")))
    other_keys = cut(keyed.where(has).select("doc_id", F.explode("keys").alias("k")))
    nodes = open_keys.select("k").distinct()
    contained = cut(_contained_keys(nodes.union(other_keys.select("k")).distinct()))
    related = contained.union(contained.select("b", "a")).union(nodes.select("k", F.col("k").alias("k2"))).distinct()
    to_nodes = related.join(nodes.withColumnRenamed("k", "b"), "b").select("a", "b")
    edges = edges.union(open_keys.select(doc, text(F.col("k"))))
    edges = edges.union(to_nodes.join(nodes.withColumnRenamed("k", "a"), "a").select(text(F.col("a")), text(F.col("b"))))
    edges = edges.union(other_keys.join(to_nodes, other_keys["k"] == to_nodes["a"]).select(doc, text(F.col("b"))))
    # Silent documents are free with all; a matter without parties is free with parties without a matter.
    kinds = keyed.agg(F.count_if(~has & ~named).alias("silent"), F.count_if(has & ~named).alias("only_matter"), F.count_if(~has & named).alias("only_parties")).first()
    if kinds["silent"]:
        edges = edges.union(keyed.select(doc, one))
    elif kinds["only_matter"] and kinds["only_parties"]:
        edges = edges.union(keyed.where(has != named).select(doc, one))
    labels = components(edges).where(F.col("key").startswith("d:")).select(F.substring("key", 3, 1 << 30).alias("doc_id"), F.col("label").alias("grp"))
    return documents.join(labels, "doc_id", "left").withColumn("grp", F.coalesce("grp", F.concat(F.lit("d:"), "doc_id")))


def document_texts(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id and text: its id in words, its type, then its facts' entities and sentences in order."""
    said = facts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("fact_pos", F.concat_ws(" ", "entity", "sentence").alias("t")))).alias("f"))
    words = F.concat_ws(" ", F.translate("doc_id", "_", " "), "document_type", F.array_join(F.transform("f", lambda x: x["t"]), " "))
    return documents.join(said, "doc_id", "left").select(*[c for c in ("doc_id", "grp") if c in documents.columns], words.alias("text"))


def _weighed(facts: DataFrame, columns: dict[str, str], statistics: DataFrame | None) -> DataFrame:
    """facts (grp, doc_id, fact_id) with a map of word to weight for each text column; a word that no statistics hold weighs as new."""
    ids = ["grp", "doc_id", "fact_id"]
    words = facts.select(*ids, F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.array_distinct(tokens(F.col(c))).alias("w")) for name, c in columns.items()])).alias("x"))
    words = words.select(*ids, "x.field", F.explode("x.w").alias("token"))
    if statistics is None:
        words = words.withColumn("idf", F.lit(1.0))
    else:
        n = statistics.groupBy("grp").agg(F.max("n").alias("n"))
        words = words.join(statistics.select("grp", "token", "df"), ["grp", "token"], "left").join(n, "grp", "left")
        words = words.withColumn("idf", scores.idf(F.coalesce("df", F.lit(0)), F.coalesce("n", F.lit(0))))
    maps = words.groupBy(*ids).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("field") == name, F.struct("token", "idf")))).alias(name) for name in columns])
    empty = F.create_map().cast("map<string,double>")
    return facts.join(maps, ids, "left").withColumns({name: F.coalesce(name, empty) for name in columns})


def _weighed_whole(facts: DataFrame, columns: dict[str, str], statistics: DataFrame | None) -> DataFrame:
    """As ``_weighed``, from one map of a group's words: no word becomes a row. For groups that are not large."""
    if statistics is None:
        weight = lambda t: F.lit(1.0)
    else:
        weights = statistics.groupBy("grp").agg(F.max("n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("token", scores.idf(F.col("df"), F.col("n"))))).alias("_idf"))
        facts = facts.join(weights, "grp", "left")
        weight = lambda t: F.coalesce(F.col("_idf")[t], scores.idf(F.lit(0), F.coalesce("_n", F.lit(0))))
    empty = F.create_map().cast("map<string,double>")
    words = lambda c: F.transform(F.array_distinct(tokens(F.col(c))), lambda t: F.struct(t.alias("token"), weight(t).alias("idf")))
    return facts.withColumns({name: F.coalesce(F.map_from_entries(words(c)), empty) for name, c in columns.items()}).drop("_n", "_idf")


def _total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)


def _map_scores(a: Column, b: Column, x: Column, y: Column) -> Column:
    """M02, M03 of two maps of word to weight and their totals x, y: struct of weighted Jaccard j and mean containment c."""
    both = F.aggregate(F.array_intersect(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda s, k: s + a[k])
    jaccard_of = lambda v: F.when(x + y - v > 0, v / (x + y - v)).otherwise(0.0)
    return calendar.let(both, lambda v: F.struct(jaccard_of(v).alias("j"), F.when((x > 0) & (y > 0), (v / x + v / y) / 2).otherwise(0.0).alias("c")))


# Facts, and words in its statistics, up to which a group meets whole in one place.
_WHOLE, _VOCABULARY = 1000, 5000


def _large_groups(own: DataFrame, statistics: DataFrame | None) -> DataFrame:
    """grp of the groups with more than that."""
    large = own.groupBy("grp").agg(F.count("*").alias("rows")).where(F.col("rows") > _WHOLE).select("grp")
    if statistics is not None:
        large = large.union(statistics.groupBy("grp").agg(F.count("*").alias("rows")).where(F.col("rows") > _VOCABULARY).select("grp"))
    return cut(large.distinct())


def _heavy(m: Column, floor: float) -> Column:
    """The heaviest words of a map, down to where the rest weighs less than ``floor`` of all."""
    rising = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("w"), e["key"].alias("t"))))
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(0).alias("light"))
    step = lambda least: lambda s, e: F.struct((s["upto"] + e["w"]).alias("upto"), (s["light"] + F.when(s["upto"] + e["w"] < least, 1).otherwise(0)).alias("light"))
    return calendar.let(rising, lambda r: F.transform(F.slice(r, F.aggregate(r, start, step(floor * _total(m) - 1e-9))["light"] + 1, F.greatest(F.size(r), F.lit(1))), lambda e: e["t"]))


def _met_in_blocks(own: DataFrame, side, fields: list[str], floor: float) -> DataFrame:
    """Pairs of facts of large groups, each once and with both facts whole, that may reach ``floor`` on some field.

    Both scores are at most the larger of the shared weight's parts of the two sides. So of a side
    the heaviest words are enough, down to where the rest weighs less than ``floor`` of all, if
    they meet all words of the other side: common words rarely bring facts together. A pair is taken at the
    first word where it meets; a group that meets more often at its words than as all pairs meets as all pairs.
    Lists of over ``_WHOLE`` facts are cut into blocks, which meet two by two, so no task gets a list.
    """
    tagged = lambda f, words: F.transform(words, lambda t: F.concat(F.lit(f"{f} "), t))
    own = cut(own.withColumns({"words": F.concat(*[tagged(f, F.map_keys(F.col(f))) for f in fields]), "heavy": F.concat(*[tagged(f, _heavy(F.col(f), floor)) for f in fields])}))
    lists = own.select("grp", "heavy", F.explode("words").alias("list")).groupBy("grp", "list").agg(F.count("*").alias("facts"), F.count_if(F.array_contains("heavy", F.col("list"))).alias("heavy")).where(F.col("heavy") > 0)
    lists = cut(lists.select("grp", "list", "facts"))
    groups = own.groupBy("grp").agg(F.count("*").alias("facts")).join(lists.groupBy("grp").agg(F.sum(F.col("facts") * F.col("facts")).alias("met")), "grp", "left")
    groups = cut(groups.withColumn("whole", F.col("facts") * F.col("facts") <= F.coalesce("met", F.lit(0))))
    listed = own.join(groups.select("grp", "whole"), "grp").withColumn("list", F.explode(F.when(F.col("whole"), F.array(F.lit(""))).otherwise(F.col("words")))).drop("whole")
    sizes = lists.union(groups.where("whole").select("grp", F.lit("").alias("list"), "facts")).select("grp", "list", F.ceil(F.col("facts") / _WHOLE).cast("int").alias("blocks"))
    placed = listed.join(sizes, ["grp", "list"]).withColumn("block", F.pmod(F.xxhash64("doc_id", "fact_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["grp", "list", "x", "y"]
    placed = placed.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    met = side(placed, "a", *cell, "words", "heavy", "block").join(side(placed, "b", *cell, "words", "heavy", "block"), cell)
    first = F.array_min(F.concat(F.array_intersect("a_heavy", "b_words"), F.array_intersect("a_words", "b_heavy")))
    met = met.where((F.col("a_doc_id") < F.col("b_doc_id")) & ((F.col("x") == F.col("y")) | (F.col("a_block") != F.col("b_block"))))
    return met.where((F.col("list") == "") | (F.col("list") == first)).drop(*cell[1:], *[f"{p}_{c}" for p in "ab" for c in ("words", "heavy", "block")])


def candidate_pairs(facts: DataFrame, statistics: DataFrame | None = None, bar: float = BAR, floor: float = FLOOR) -> DataFrame:
    """Scored fact pairs of different documents of a group.

    facts: grp, doc_id, fact_id, pos, entity, sentence, role, date_parsed, duration_days, is_duplicate_of,
    span_days; raw_text and value for the supporting quote, matter and keys (of parties) where the
    pair's own documents must be allowed. statistics: df and n of the group's words; without them all
    words weigh alike. Duplicates take no part. Facts of a group meet in one place, so what is shuffled
    grows with facts and not with pairs; those of a large group meet in blocks, each pair once. Matter,
    role and date gap are tested before any score.
    """
    has = set(facts.columns)
    raw, value = (F.col(c) if c in has else F.lit("") for c in ("raw_text", "value"))
    gate = [c for c in ("matter", "keys") if c in has]
    kept, columns = ["doc_id", "fact_id", "pos", "role", "date_parsed", "duration_days", "span_days", *gate], {"em": "entity", "qm": "quote"}
    quote = supporting_quote(F.col("sentence"), raw, F.col("date_parsed"), value)["quote"]
    own = cut(facts.where(F.col("is_duplicate_of").isNull() & F.col("grp").isNotNull()).select("grp", *kept, "entity", quote.alias("quote")))
    # Used for the sizes of groups and for the weights.
    statistics = None if statistics is None else cut(statistics.where(F.col("grp").isNotNull()).select("grp", "token", "df", "n"))
    large = _large_groups(own, statistics)

    def side(df: DataFrame, p: str, *more: str) -> DataFrame:
        shared = [c for c in ("grp", *more) if c in ("grp", "list", "x", "y")]
        totals = [_total(F.col(m)).alias(f"{p}_{m}_total") for m in columns]
        return df.select(*shared, *[F.col(c).alias(f"{p}_{c}") for c in (*kept, *columns, *more) if c not in shared], *totals)

    def of(df: DataFrame | None, how: str) -> DataFrame | None:
        return None if df is None else df.join(large, "grp", how)

    if large.isEmpty():
        weighed = _weighed_whole(own, columns, statistics)
        met = side(weighed, "a").join(side(weighed, "b"), "grp").where(F.col("a_doc_id") < F.col("b_doc_id"))
    else:
        weighed = _weighed_whole(of(own, "left_anti"), columns, of(statistics, "left_anti"))
        met = side(weighed, "a").join(side(weighed, "b"), "grp").where(F.col("a_doc_id") < F.col("b_doc_id"))
        met = met.unionByName(_met_in_blocks(_weighed(of(own, "left_semi"), columns, of(statistics, "left_semi")), side, list(columns), floor))
    role = scores.role_compatibility(F.col("a_role"), F.col("b_role"))
    apart = calendar.gap_incompatible(F.col("a_date_parsed"), F.col("b_date_parsed"), F.col("a_span_days"))
    pairs = met.where((role > 0) & ~apart)
    if len(gate) == 2:
        pairs = pairs.where(same_matter(F.col("a_matter"), F.col("b_matter"), F.col("a_keys"), F.col("b_keys"))["allowed"])
    alike = [_map_scores(*[F.col(f"{p}_{m}") for p in "ab"], *[F.col(f"{p}_{m}_total") for p in "ab"]).alias(m) for m in columns]
    # A generated row keeps the conditions below from working the scores out again.
    scored = pairs.withColumn("s", F.explode(F.array(F.struct(*alike))))
    near = calendar.temporal_proximity(F.col("a_date_parsed"), F.col("b_date_parsed"), F.col("a_duration_days"), F.col("b_duration_days"))
    scored = scored.withColumns({"entity_score": F.greatest("s.em.j", "s.em.c"), "sentence_score": F.col("s.qm.j"), "temporal_score": near, "role_score": role})
    scored = scored.where(F.greatest("entity_score", "sentence_score") >= floor).withColumn("score", scores.pair_score(F.col("entity_score"), F.col("sentence_score"), F.col("temporal_score"), F.col("role_score")))
    return scored.where(F.col("score") >= bar).drop("s", *[f"{p}_{c}" for p in "ab" for c in ("em", "qm", "em_total", "qm_total", "span_days", *gate)])


def one_to_one(pairs: DataFrame, group: list[str], a: str, b: str, score: str = "score") -> DataFrame:
    """Greedy matching by score, ties by a, then b.

    A pair that ranks first for both its ends is taken, its ends leave, and so on; this equals
    the greedy order, and all groups advance together.
    """
    left, taken = cut(pairs), None
    order = [F.desc(score), a, b]
    while True:
        wa, wb = Window.partitionBy(*group, a).orderBy(*order), Window.partitionBy(*group, b).orderBy(*order)
        best = cut(left.withColumns({"_a": F.row_number().over(wa), "_b": F.row_number().over(wb)}).where("_a = 1 and _b = 1").drop("_a", "_b"))
        if best.isEmpty():
            return best if taken is None else taken
        taken = best if taken is None else taken.unionByName(best)
        for end in (a, b):
            left = left.join(best.select(*group, end), [*group, end], "left_anti")
        left = cut(left.select(*pairs.columns))


def gated_links(facts: DataFrame, entity_floor: float = 0.4, sentence_floor: float = 0.1, least: float = 0.4) -> DataFrame:
    """Coreference, contradiction and parallel application of facts of one role.

    The join is on group, role and a shared telling word of the name or the whole name, as names without one score 0.
    """
    # Names and words are made once a fact; pairs are found by ids alone before these join.
    own = facts.where(F.col("is_duplicate_of").isNull()).withColumn("name", normalise_entity(F.col("entity")))
    own = cut(own.withColumns({"nw": telling_words(F.col("name"), STOP_SHORT), "sw": telling_words(F.coalesce("sentence", F.lit("")))}))
    keyed = own.select("grp", "role", "doc_id", "fact_id", F.explode(F.array_union("nw", F.array("name"))).alias("w"))
    ids = lambda p: keyed.select("grp", "role", "w", F.col("doc_id").alias(f"{p}_doc_id"), F.col("fact_id").alias(f"{p}_fact_id"))
    pairs = ids("a").join(ids("b"), ["grp", "role", "w"]).where(F.col("a_doc_id") < F.col("b_doc_id")).drop("w").distinct()
    side = lambda p: own.select("grp", "role", *[F.col(c).alias(f"{p}_{c}") for c in ("doc_id", "fact_id", "entity", "name", "nw", "sw", "date_parsed", "duration_days", "value")])
    met = pairs.join(side("a"), ["grp", "role", "a_doc_id", "a_fact_id"]).join(side("b"), ["grp", "role", "b_doc_id", "b_fact_id"])
    entity = F.when(F.col("a_name") == F.col("b_name"), 1.0).otherwise(jaccard(F.col("a_nw"), F.col("b_nw")))
    sentence = jaccard(F.col("a_sw"), F.col("b_sw"))
    matched = calendar.values_match(F.col("a_date_parsed"), F.col("b_date_parsed"), F.col("a_duration_days"), F.col("b_duration_days"), F.col("a_value"), F.col("b_value"))
    exact_long = (entity == 1.0) & (F.size(F.split(F.trim("a_entity"), r"\s+")) > 1)
    scored = met.withColumns({"es": entity, "ss": sentence, "vm": matched}).where((F.col("es") >= entity_floor) & ((F.col("ss") >= sentence_floor) | exact_long))
    scored = scored.withColumn("confidence", 0.6 * F.col("es") + 0.4 * F.col("ss")).where(F.col("confidence") >= least)
    kind = F.when(F.coalesce(F.col("vm.matches"), F.lit(True)), "coreference").when(F.col("ss") >= 0.2, "contradiction").otherwise("parallel_application")
    return scored.select(
        F.col("a_doc_id").alias("from_doc"), F.col("a_fact_id").alias("from_fact"), F.col("b_doc_id").alias("to_doc"), F.col("b_fact_id").alias("to_fact"), kind.alias("link_type"), "confidence",
        F.coalesce(F.date_format("a_date_parsed", "yyyy-MM-dd"), "a_value").alias("value_a"), F.coalesce(F.date_format("b_date_parsed", "yyyy-MM-dd"), "b_value").alias("value_b"), F.col("vm.delta").alias("delta_days"),
    )


def composed_links(matched: DataFrame) -> DataFrame:
    """Matched pairs as coreference, or contradiction when comparable and over 5 days apart."""
    delta = F.coalesce(F.abs(F.datediff("b_date_parsed", "a_date_parsed")), F.abs(F.col("a_duration_days") - F.col("b_duration_days")))
    return matched.select(
        F.col("a_doc_id").alias("from_doc"), F.col("a_fact_id").alias("from_fact"), F.col("b_doc_id").alias("to_doc"), F.col("b_fact_id").alias("to_fact"),
        F.when(delta > 5, "contradiction").otherwise("coreference").alias("link_type"), F.col("score").alias("confidence"), delta.alias("delta_days"),
    )


def with_siblings(links: DataFrame, groups: DataFrame) -> DataFrame:
    """Every restatement of a matched event joins the link. groups: doc_id, fact_id, grp_key (its restatements' key)."""
    side = lambda p: groups.select(F.col("doc_id").alias(f"{p}_doc"), F.col("grp_key").alias(f"{p}_fact"), F.col("fact_id").alias(f"{p}_member"))
    out = links.join(side("from"), ["from_doc", "from_fact"]).join(side("to"), ["to_doc", "to_fact"])
    return out.withColumns({"from_fact": F.col("from_member"), "to_fact": F.col("to_member")}).drop("from_member", "to_member")


def structural_analogies(deps: DataFrame, facts: DataFrame, bar: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Classes and class pairs by Jaccard of documents' (role, role, type) sets."""
    role = lambda side: facts.select("doc_id", F.col("fact_id").alias(f"{side}_id"), F.col("role").alias(f"{side}_role"))
    signed = deps.join(role("from"), ["doc_id", "from_id"]).join(role("to"), ["doc_id", "to_id"]).select("doc_id", F.concat_ws("|", "from_role", "to_role", "constraint_type").alias("sig"))
    return signature_classes(signed, bar)


def signature_classes(signed: DataFrame, bar: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, class of the sets that doc_id, sig rows make; and a, b, similarity, pairs of the classes alike.

    A class is the smallest document of its set. Documents of one class are alike (similarity 1,
    a = b); pairs counts the document pairs that a class pair stands for, so nothing is unfolded.
    """
    sets = signed.groupBy("doc_id").agg(F.sort_array(F.collect_set("sig")).alias("s"))
    classes = cut(sets.groupBy("s").agg(F.min("doc_id").alias("class"), F.count("*").alias("n")))
    return sets.join(classes.select("s", "class"), "s").select("doc_id", "class"), _class_pairs(classes, bar)


# Classes of a list that meet in one block; a list of more is cut into blocks.
_BLOCK = 2000


def _class_pairs(classes: DataFrame, bar: float) -> DataFrame:
    """a, b, similarity, pairs of the classes (s, class, n) alike.

    A set is bits over its signatures' places (numbers, if there are over 1,024), so a pair costs a few operations.
    Classes meet as all pairs if that is less than their meeting at every shared signature, where a
    pair is judged at the first, rarest one. Long lists are cut into blocks, so no task gets a list.
    """
    members = classes.select("class", F.explode("s").alias("sig"))
    places = cut(numbered(members.groupBy("sig").agg(F.count("*").alias("df")), ["df", "sig"], "at").withColumn("at", F.col("at") - 1))
    cost = places.agg(F.count("*").alias("v"), F.sum(F.col("df") * F.col("df")).alias("met")).first()
    word = (F.col("at") / 64).cast("int")
    each = members.join(places.select("sig", "at"), "sig").select("class", "at", word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bit"))
    v, sized = cost["v"], classes.select("class", "n", F.size("s").alias("size"))
    if v <= 1024:
        bits = each.groupBy("class").agg(*[F.coalesce(F.bit_or(F.when(F.col("w") == i, F.col("bit"))), F.lit(0).cast("long")).alias(f"m{i}") for i in range((v + 63) // 64)])
        own, held = cut(sized.join(bits, "class")), [f"m{i}" for i in range((v + 63) // 64)]
    else:
        own, held = cut(sized.join(each.groupBy("class").agg(F.sort_array(F.collect_list("at")).alias("ids")), "class")), ["ids"]
    n = own.count()
    at_all = n * n <= (cost["met"] or 0)
    listed = own.withColumn("list", F.lit(-1).cast("long")) if at_all else own.join(each.select("class", F.col("at").alias("list")), "class")
    lengths = listed.groupBy("list").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    blocked = listed.join(lengths, "list").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda p, mine, other: blocked.select("list", F.col("block").alias(mine), every.alias(other), F.col("class").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in ("n", "size", *held)]).repartition(parts, "list", "x", "y")
    met = side("a", "x", "y").join(side("b", "y", "x"), ["list", "x", "y"]).where(F.col("a") <= F.col("b"))
    if v <= 1024:
        same = [F.col(f"{c}_a").bitwiseAND(F.col(f"{c}_b")) for c in held]
        both = reduce(add, map(F.bit_count, same), F.lit(0))
        # No bit of both stands before the list's own.
        under = [F.when(F.col("list") >= 64 * i + 64, m).when(F.col("list") > 64 * i, m.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), (F.col("list") % 64).cast("int"))))).otherwise(0) for i, m in enumerate(same)]
        first = reduce(and_, [m == 0 for m in under], F.lit(True))
    else:
        both = F.size(F.array_intersect("ids_a", "ids_b"))
        first = F.col("list") == F.array_min(F.array_intersect("ids_a", "ids_b"))
    met = met if at_all else met.where(first)
    pairs = F.when(F.col("a") == F.col("b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("long")
    alike = met.select("a", "b", "size_a", "size_b", both.alias("both"), pairs.alias("pairs")).where((F.col("both") > 0) & (F.col("pairs") > 0))
    return alike.select("a", "b", (F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))).alias("similarity"), "pairs").where(F.col("similarity") >= bar)


def all_links(*links: DataFrame) -> DataFrame:
    """U02, T04."""
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.orderBy(F.desc("confidence"), "from_doc", "from_fact", "to_doc", "to_fact")
