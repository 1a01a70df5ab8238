import json
import math
import random
from datetime import date

from pyspark.sql import functions as F

from factloom.operators import corrections, events, extract, graph, linking, provenance, retrieval, rules
from factloom.functions import text as text_functions
from factloom.plans import packs
from factloom.sources import bundles, sinks

FACT = "cluster string, doc_id string, pos int, entity string, role string, date_parsed date, value string, duration_days int, confidence double, temporal_content boolean, verified boolean, derivation string"


def classify(spark, rows):
    return {r["cluster"]: r for r in events.classify(spark.createDataFrame(rows, FACT)).collect()}


def test_event_status(spark):
    d = date(2025, 7, 12)
    row = lambda c, doc, when=d, value=None, days=None, temporal=True, verified=True, how=None: (c, doc, len(c), "dismissal", "END", when, value, days, 0.9, temporal, verified, how)
    found = classify(spark, [
        row("agreed", "a"), row("agreed", "b"), row("unverified", "a"), row("unverified", "b", verified=False), row("disputed", "a"), row("disputed", "b", date(2025, 7, 14)),
        row("single", "a"), row("none", "a", None), row("plain", "a", None, temporal=False), row("derived", "a", how="x + 28 days"),
        row("month", "a", None, "2025-07"), row("apart", "a", None, "2025-07"), row("apart", "b", None, "2025-08"), row("inside", "a", d, "2025-07-12"), row("inside", "b", None, "2025-07"),
    ])
    status = {k: r["status"] for k, r in found.items()}
    assert status == {"agreed": "agreed", "unverified": "single_source", "disputed": "disputed", "single": "single_source", "none": "unplaced", "plain": "unplaced", "derived": "derived", "month": "single_source", "apart": "disputed", "inside": "agreed"}
    assert [str(v["date"]) for v in found["disputed"]["disputed_values"]] == ["2025-07-12", "2025-07-14"]
    assert found["plain"]["reason"] == "no temporal content" and found["none"]["reason"] == "no date found"
    assert found["disputed"]["label"] == "dismissal (end)" and found["month"]["date"] == date(2025, 7, 1)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r["key"]: r["label"] for r in events.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {x: find(x) for x in parent}
    assert events.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_clusters_split_wins(spark):
    facts = spark.createDataFrame([("a:1", None), ("b:1", None), ("c:1", "a:1"), ("d:1", None)], "key string, duplicate_key string")
    links = spark.createDataFrame([("a:1", "b:1"), ("b:1", "d:1")], "a string, b string")
    split = spark.createDataFrame([("d:1",)], "key string")
    found = {r["key"]: r["cluster"] for r in events.cluster_facts(facts, links, split=split).collect()}
    assert found == {"a:1": "a:1", "b:1": "a:1", "c:1": "a:1", "d:1": "d:1"}


def test_derivation_and_what_if(spark):
    facts = spark.createDataFrame([("d", "a", date(2025, 9, 12)), ("d", "b", None), ("d", "c", None), ("d", "e", date(2020, 1, 1))], "doc_id string, fact_id string, date_parsed date")
    deps = spark.createDataFrame(
        [("d", "a", "b", "additive", "28 days", None, 0), ("d", "b", "c", "additive", "", 10, 1), ("d", "a", "e", "additive", "", 5, 2), ("d", "c", "a", "additive", "", 1, 3)],
        "doc_id string, from_id string, to_id string, constraint_type string, constraint_expr string, delta_days int, dep_pos int",
    )
    found = {r["fact_id"]: (r["date_parsed"], r["derivation"]) for r in graph.derive_dates(facts, deps).collect()}
    assert found["b"][0] == date(2025, 10, 10) and found["c"][0] == date(2025, 10, 20) and found["e"] == (date(2020, 1, 1), None) and "28 days" in found["b"][1]
    changed = spark.createDataFrame([("d", "a", date(2025, 10, 13))], "doc_id string, fact_id string, date date")
    moved = {r["fact_id"]: (r["now"], r["hop"]) for r in graph.what_if(facts, deps, changed).collect()}
    assert moved == {"b": (date(2025, 11, 10), 1), "e": (date(2025, 10, 18), 1), "c": (date(2025, 11, 20), 2)}


def chain(spark, edges):
    """One dated fact and a chain of edges of a day each, with a side edge at its start."""
    facts = [("d", "f0", date(2025, 1, 1), "START"), ("d", "side", None, "END")] + [("d", f"f{i + 1}", None, "END") for i in range(edges)]
    deps = [("d", f"f{i}", f"f{i + 1}", "additive", "", 1, i) for i in range(edges)] + [("d", "f0", "side", "additive", "", 2, edges)]
    return spark.createDataFrame(facts, "doc_id string, fact_id string, date_parsed date, role string"), spark.createDataFrame(deps, "doc_id string, from_id string, to_id string, constraint_type string, constraint_expr string, delta_days int, dep_pos int")


def test_scenarios_follow_long_chains(spark):
    facts, deps = chain(spark, 12)
    dated = graph.derive_dates(facts, deps)
    found = graph.edit_scenarios(dated, deps).collect()
    assert len(found) == 6 and {(r["fact_id"], r["breadth"], r["depth"]) for r in found} == {("f0", 13, 12)}
    assert graph.edit_scenarios(facts, deps).count() == 0  # undated targets move nothing
    changed = spark.createDataFrame([("d", "f0", date(2025, 2, 1))], "doc_id string, fact_id string, date date")
    assert {r["fact_id"] for r in graph.what_if(facts, deps, changed).collect()} == {"side", *(f"f{i}" for i in range(1, 11))}


def test_derivation_and_staleness_reach_the_end_of_long_chains(spark):
    facts, deps = chain(spark, 103)
    dates = {r["fact_id"]: r["date_parsed"] for r in graph.derive_dates(facts, deps).collect()}
    assert dates == {"side": date(2025, 1, 3), **{f"f{i}": date.fromordinal(date(2025, 1, 1).toordinal() + i) for i in range(104)}}
    changed = spark.createDataFrame([("d", "f0")], "doc_id string, fact_id string")
    links = spark.createDataFrame([("d", "f103", "e", "x")], "from_doc string, from_fact string, to_doc string, to_fact string")
    found = {(r["doc_id"], r["fact_id"]): r["hop"] for r in graph.stale(changed, deps, links).collect()}
    assert found == {("d", "side"): 1, ("e", "x"): 99, **{("d", f"f{i}"): i for i in range(1, 104)}}


def edges_by_loop(facts, tolerance=15):
    """All edges of one entity, a pair at a time."""
    by = lambda role: [f for f in facts if f["role"] == role]
    out, used, lasting = [], set(), [d for d in by("DURATION") if d["duration_days"] is not None]
    for s in by("START"):
        for e in by("END"):
            if not s["date_parsed"] or not e["date_parsed"] or e["date_parsed"] <= s["date_parsed"]:
                continue
            gap = (e["date_parsed"] - s["date_parsed"]).days
            best = min(lasting, key=lambda d: abs(gap - d["duration_days"]), default=None)  # noqa: B023
            if best and abs(gap - best["duration_days"]) <= tolerance + int(gap / 365 * 1.5):
                out += [(s["fact_id"], e["fact_id"], "additive", f"end = start + {best['value'] or best['raw_text']}", gap, True), (s["fact_id"], best["fact_id"], "additive", "duration = end - start", gap, True)]
                used.add(best["fact_id"])
            else:
                out.append((s["fact_id"], e["fact_id"], "ordering", f"{s['fact_id']} precedes {e['fact_id']} by {gap} days", gap, True))
            used |= {s["fact_id"], e["fact_id"]}
    for d in lasting:
        if d["fact_id"] in used:
            continue
        if s := next((s for s in by("START") if s["fact_id"] not in used), None):
            out.append((s["fact_id"], d["fact_id"], "additive", f"duration {d['value'] or d['raw_text']} from {s['entity']}", d["duration_days"], False))
            used.add(s["fact_id"])
        if e := next((e for e in by("END") if e["fact_id"] not in used), None):
            out.append((d["fact_id"], e["fact_id"], "additive", f"{e['entity']} = start + {d['value'] or d['raw_text']}", d["duration_days"], False))
            used.add(e["fact_id"])
    return out + [(s["fact_id"], c["fact_id"], "interval", f"{c['fact_id']} in [{s['fact_id']}, ...]", None, False) for c in by("CONTAINS") for s in by("START")]


def test_build_edges_against_a_loop(spark):
    rng, rows = random.Random(3), []
    for doc in range(40):
        for pos in range(rng.randrange(14)):
            role = rng.choice(("START", "START", "END", "END", "DURATION", "DURATION", "CONTAINS"))
            days = rng.choice((None, 30, 90, 365, 1100)) if role == "DURATION" else None
            when = date.fromordinal(date(2020, 1, 1).toordinal() + rng.choice((0, 5, 30, 95, 400, 1120))) if role != "DURATION" and rng.random() < 0.7 else None
            rows.append((f"d{doc}", f"f{pos:02}", pos, rng.choice(("Art. 4 Lease", "lease", "Job")), role, rng.choice((None, f"P{days}D")) if days else None, f"{days} days" if days else "then", when, days))
    facts = spark.createDataFrame(rows, "doc_id string, fact_id string, fact_pos int, entity string, role string, value string, raw_text string, date_parsed date, duration_days int")
    expected, groups = [], {}
    for r in facts.orderBy("doc_id", "fact_pos").collect():
        groups.setdefault((r["doc_id"], r["entity"].removeprefix("Art. 4 ").lower()), []).append(r)
    for (doc, _), own in groups.items():
        expected += [(doc, *e) for e in edges_by_loop(own)]
    found = [tuple(r) for r in graph.build_edges(facts).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    assert {(e[3], e[6]) for e in found} == {("additive", True), ("additive", False), ("ordering", True), ("interval", False)}


def test_one_to_one_is_greedy(spark):
    rng = random.Random(5)
    rows = [(g, a, b, rng.randrange(5)) for g in range(3) for a in range(7) for b in range(7) if rng.random() < 0.6]
    expected, used = set(), set()
    for g, a, b, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if ("a", g, a) not in used and ("b", g, b) not in used:
            used |= {("a", g, a), ("b", g, b)}
            expected.add((g, a, b))
    found = linking.one_to_one(spark.createDataFrame(rows, "g int, a int, b int, score int"), ["g"], "a", "b").collect()
    assert {(r["g"], r["a"], r["b"]) for r in found} == expected


def groups_by_pairs(rows):
    """The components of all pairs that may be linked, pair by pair."""
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def allowed(x, y):
        if x[1] is not None and y[1] is not None:
            return x[1] == y[1]
        a, b = ([set(p.lower().split()) for p in r[2]] for r in (x, y))
        return any(p <= q or q <= p for p in a for q in b) if a and b else True

    for i, x in enumerate(rows):
        for y in rows[:i]:
            if allowed(x, y):
                parent[find(x[0])] = find(y[0])
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), set()).add(r[0])
    return sorted(map(sorted, groups.values()))


def test_matter_groups_are_those_of_all_pairs(spark):
    rng = random.Random(11)
    names = ["Adeyemi", "Bree Adeyemi", "Castellan", "Castellan Dunmore", "Erskine", "Fairweather Grant", "Grant"]
    kinds = [lambda: None, lambda: rng.choice("mnop")], [lambda: [], lambda: rng.sample(names, rng.randint(1, 2))]
    for kind in range(24):
        # Mixtures of documents with and without a matter or parties; in some no document is silent.
        rows = []
        for i in range(rng.randint(1, 9)):
            matter, parties = kinds[0][rng.randrange(2)](), kinds[1][rng.randrange(2)]()
            if kind % 3 and matter is None and not parties:
                parties = [rng.choice(names)]
            if kind % 3 == 2 and not parties:
                parties = [rng.choice(names)]
            rows.append((f"d{i}", matter, parties))
        found = {}
        for r in linking.matter_groups(spark.createDataFrame(rows, "doc_id string, matter string, parties array<string>")).collect():
            found.setdefault(r["grp"], set()).add(r["doc_id"])
        assert sorted(map(sorted, found.values())) == groups_by_pairs(rows), rows


def test_candidate_pairs_against_all_pairs(spark):
    """Blocking by telling words loses no pair; two matters and a document of both parties stay apart as their documents say."""
    rng = random.Random(12)
    words = "the notice of payment delivery crane hull permit survey deck".split()
    rows = []
    for d in range(12):
        for i in range(3):
            said = " ".join(rng.choices(words, weights=[9, 5, 5, 3, 3, 1, 1, 1, 1, 1], k=rng.randint(2, 8)))
            rows.append(("g", f"d{d:02}", f"f{i}", 3 * d + i, " ".join(rng.sample(words, rng.randint(1, 3))), said, rng.choice(["START", "END", "CONTAINS"]), date(2025, 1, 1 + rng.randrange(28)), None, None, 30, "m" if d % 4 == 0 else "n" if d % 4 == 1 else None, []))
    schema = "grp string, doc_id string, fact_id string, pos int, entity string, sentence string, role string, date_parsed date, duration_days int, is_duplicate_of string, span_days int, matter string, keys array<array<string>>"
    facts = spark.createDataFrame(rows, schema)
    statistics = linking.token_statistics(facts.select("grp", "doc_id", F.concat_ws(" ", "entity", "sentence").alias("text")))
    found = {(r["a_doc_id"], r["a_fact_id"], r["b_doc_id"], r["b_fact_id"]): round(r["score"], 9) for r in linking.candidate_pairs(facts, statistics).collect()}
    docs = {}
    for r in rows:
        docs.setdefault(r[1], set()).update(r[4].split() + r[5].split())
    idf = {w: math.log((len(docs) + 1) / (sum(w in t for t in docs.values()) + 1)) + 1 for w in words}
    weight = lambda ws: sum(idf[w] for w in ws)
    expected = {}
    for x in rows:
        for y in rows:
            if x[1] >= y[1] or {x[6], y[6]} == {"START", "END"} or (x[11] and y[11] and x[11] != y[11]):
                continue
            near = []
            for n in (4, 5):
                p, q = set(x[n].split()), set(y[n].split())
                near.append((weight(p & q) / weight(p | q), (weight(p & q) / weight(p) + weight(p & q) / weight(q)) / 2))
            entity, sentence = max(near[0]), near[1][0]
            score = (0.45 * entity + 0.25 * sentence + 0.3 * 0.5 ** (abs((x[7] - y[7]).days) / 21)) * (1 if x[6] == y[6] else 0.85)
            if max(entity, sentence) >= 0.12 and score >= 0.5:
                expected[x[1], x[2], y[1], y[2]] = round(score, 9)
    assert found == expected and len(found) > 20


def test_signature_classes(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x"), ("d", "z"), ("e", "x"), ("e", "y"), ("e", "q"), ("e", "p")]
    classes, pairs = linking.signature_classes(spark.createDataFrame(rows, "doc_id string, sig string"), 0.5)
    assert {r["doc_id"]: r["class"] for r in classes.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    assert {(r["a"], r["b"]): (r["similarity"], r["pairs"]) for r in pairs.collect()} == {("a", "a"): (1.0, 1), ("a", "c"): (0.5, 2), ("a", "e"): (0.5, 2)}


def test_numbering_follows_one_order(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(500)]
    found = events.numbered(spark.createDataFrame(rows, "pos int, cluster int").repartition(7), ["pos", "cluster"], "n").collect()
    assert [(r["pos"], r["cluster"]) for r in sorted(found, key=lambda r: r["n"])] == sorted(rows) and sorted(r["n"] for r in found) == list(range(1, 501))
    assert events.numbered(spark.createDataFrame([], "pos int, cluster int"), ["pos", "cluster"], "n").count() == 0


def test_gated_links(spark):
    rows = [("g", "a", "1", "the dismissal hearing", "The hearing took place in Leeds", "END", date(2025, 7, 12)), ("g", "b", "1", "dismissal hearing", "A hearing took place in Leeds", "END", date(2025, 7, 13)), ("g", "c", "1", "dismissal hearing", "The hearing took place in Leeds", "END", date(2025, 8, 30))]
    facts = spark.createDataFrame([(*r, None, None, None) for r in rows], "grp string, doc_id string, fact_id string, entity string, sentence string, role string, date_parsed date, duration_days int, value string, is_duplicate_of string")
    found = {(r["from_doc"], r["to_doc"]): r["link_type"] for r in linking.gated_links(facts).collect()}
    assert found == {("a", "b"): "coreference", ("a", "c"): "contradiction", ("b", "c"): "contradiction"}


def test_rules(spark):
    facts = spark.createDataFrame([("r", "s", 0, "dismissal", "within 3 months beginning with the dismissal", None, "START", None, None), ("r", "t", 1, "claim presented", "the claim is presented within 3 months beginning with the dismissal", None, "END", None, None)], "doc_id string, fact_id string, pos int, entity string, sentence string, value string, role string, date_parsed date, is_duplicate_of string")
    deps = spark.createDataFrame([("r", 0, "s", "t", "additive", "3 months", None)], "doc_id string, dep_pos int, from_id string, to_id string, constraint_type string, constraint_expr string, delta_days int")
    found_rules = rules.find_rules(facts, deps)
    rule = found_rules.first()
    assert (rule["months"], rule["minus_one_day"], rule["inclusivity_source"]) == (3, True, "read")
    case = lambda when: spark.createDataFrame([("c", "1", 0, "dismissal", "She was dismissed", "END", date(2025, 7, 12), None), ("c", "2", 1, "claim presented", "The claim was presented", "END", when, None)], "doc_id string, fact_id string, pos int, entity string, sentence string, role string, date_parsed date, is_duplicate_of string")
    late, timely, none = (rules.check(found_rules, case(d)).first() for d in (date(2025, 10, 20), date(2025, 10, 11), None))
    assert (late["deadline"], late["verdict"], late["days_over"]) == (date(2025, 10, 11), "LATE", 9)
    assert (timely["verdict"], timely["days_over"]) == ("TIMELY", 0) and none["verdict"] == "INDETERMINATE"
    assert "LATE" in sinks.render_line(rules.check(found_rules, case(date(2025, 10, 20)))).first()["line"]
    assert not rules.find_rules(facts.replace("within 3 months beginning with the dismissal", "3 months from the dismissal"), deps).first()["minus_one_day"] is None


def test_rules_of_named_concepts(spark):
    rule = spark.createDataFrame([("r", 0, "effective date of termination", "claim presented", "three months from the effective date of termination", 0, 3, 0, False, "read", "x")], "doc_id string, dep_pos int, anchor_entity string, target_entity string, anchor_sentence string, years int, months int, days int, minus_one_day boolean, inclusivity_source string, description string")
    words = rules.Vocabulary({"effective date of termination": ("dismissal", "appeal dismissal date")}, {}, noise=("appeal",))
    case = lambda name: spark.createDataFrame([("c", "1", 0, name, "It was three months from the date", "END", date(2025, 7, 12), None), ("c", "2", 1, "claim presented", "The claim was presented", "END", date(2025, 10, 20), None)], "doc_id string, fact_id string, pos int, entity string, sentence string, role string, date_parsed date, is_duplicate_of string")
    verdict = lambda name, vocabulary: (lambda r: (r["verdict"], r["anchor_date"] is None))(rules.check(rule, case(name), vocabulary).first())
    assert verdict("date of termination meeting", rules.EMPTY) == ("LATE", False)
    assert verdict("date of termination meeting", words) == verdict("dismissal appeal", words) == ("INDETERMINATE", True)
    assert verdict("her dismissal", words) == verdict("Effective  Date of termination", words) == verdict("appeal dismissal date", words) == ("LATE", False)


def test_rules_are_anchored_to_the_event_of_their_clause(spark):
    phrases = ["within three months beginning with the effective date of termination, or later", "28 days from the date on which X.", "2 weeks of notice", "no period after the act", "3 months", None]
    found = spark.createDataFrame(list(enumerate(phrases)), "i int, s string").orderBy("i").select(rules.anchor_phrase(F.col("s")).alias("p")).collect()
    assert [r["p"] for r in found] == ["effective date of termination", "X", "notice", None, None, None]
    clause = "presented within three months beginning with the effective date of termination"
    deps = spark.createDataFrame([("r", 0, "s", "t", "additive", "3 months", None)], "doc_id string, dep_pos int, from_id string, to_id string, constraint_type string, constraint_expr string, delta_days int")
    fact = lambda i, pos, entity, sentence: ("r", i, pos, entity, sentence, None, "START")
    table = lambda *more: spark.createDataFrame([fact("s", 0, "complaint", "The complaint"), fact("t", 1, "claim", clause), *more], "doc_id string, fact_id string, pos int, entity string, sentence string, value string, role string")
    anchor = lambda facts, **how: (lambda r: (r["anchor_entity"], r["anchor_sentence"], r["description"]))(rules.find_rules(facts, deps, **how).first())
    other = fact("e", 2, "the effective date of termination", "It ends")
    assert anchor(table(other)) == ("the effective date of termination", "It ends", "claim = the effective date of termination + 3m - 1 day")
    assert anchor(table(other), reanchor=False)[:2] == ("complaint", "The complaint")
    long = table().withColumn("sentence", F.when(F.col("fact_id") == "t", F.concat("sentence", F.lit(" or by any other day that the tribunal in its discretion thinks fit to allow"))).otherwise(F.col("sentence")))
    assert anchor(long)[:2] == ("effective date of termination", "effective date of termination")


def test_relations(spark):
    docs = spark.createDataFrame([("d", "The response is due 28 days after the service of the claim. Other 8 days apply.")], "doc_id string, source_text string")
    facts = spark.createDataFrame([("d", "a", "service"), ("d", "b", "response"), ("d", "c", "weather")], "doc_id string, fact_id string, entity string")
    deps = spark.createDataFrame([("d", "a", "b", "additive", "28 days", None), ("d", "c", "b", "additive", "28 days", None), ("d", "a", "b", "additive", "", 99), ("d", "a", "b", "ordering", "", 5)], "doc_id string, from_id string, to_id string, constraint_type string, constraint_expr string, delta_days int")
    found = [r["relation_verdict"] for r in provenance.check_relations(deps, facts, docs).orderBy("constraint_type", F.coalesce("delta_days", F.lit(0)), "from_id").collect()]
    assert found == ["supported", "anchor-not-in-clause", "offset-not-in-source", None]


def test_corrections(spark):
    facts = spark.createDataFrame([("d", "a", date(2025, 1, 1), "2025-01-01", "x", 0.5), ("d", "b", None, None, "y", 0.5), ("d", "c", None, None, "z", 0.5)], "doc_id string, fact_id string, date_parsed date, value string, entity string, confidence double")
    log = spark.createDataFrame([(0, "reject", "d", "a", None, None), (1, "accept", "d", "a", None, None), (2, "edit_date", "d", "a", "2025-02-02", None), (3, "edit_label", "d", "b", None, "named"), (4, "reject", "d", "c", None, None)], "pos int, op string, doc_id string, fact_id string, new_date string, new_label string")
    found = {r["fact_id"]: r for r in corrections.apply(facts, log).collect()}
    assert set(found) == {"a", "b"} and found["a"]["date_parsed"] == date(2025, 2, 2) and found["a"]["confidence"] == 1 and found["a"]["accepted"] and found["b"]["entity"] == "named"


def test_extraction_and_recall(spark):
    docs = spark.createDataFrame([("d", "Jane Roe was hired from 3 March 2024 for 6 months. The Board met on 2024-05-01. See 3 March 2024.", "letter"), ("e", "nothing here", "letter"), ("f", None, "letter")], "doc_id string, source_text string, document_type string")
    rows = extract.extract_facts(docs).orderBy("doc_id", "start_char").collect()
    assert [(r["raw_text"], r["value"], r["role"]) for r in rows][:3] == [("3 March 2024", "2024-03-03", "START"), ("6 months", "P180D", "DURATION"), ("2024-05-01", "2024-05-01", "UNKNOWN")]
    text = docs.first()["source_text"]
    assert all(text[r["start_char"] : r["end_char"]] == r["raw_text"] for r in rows) and rows[0]["entity"] == "Jane Roe"
    facts = spark.createDataFrame([("d", "2024-05-01", None)], "doc_id string, value string, date_parsed date")
    assert [r["value"] for r in retrieval.missed_dates(extract.timexes(docs), facts).collect()] == ["2024-03-03"]


def test_timexes_of_every_shape(spark):
    day, none = "DATE", None
    shapes = [
        ("He served from 2019 to 2021.", [("2019", day, "2019", none), ("2021", day, "2021", none)]),
        ("Between  2019 and 2021-03-04 it ran.", [("2019", day, "2019", none), ("2021-03-04", day, "2021-03-04", none)]),
        ("Built between 1999 – 2003, sold.", [("1999", day, "1999", none), ("2003", day, "2003", none)]),
        ("See Roe (2019) and (Roe 2018).", [("2019", day, "2019", none)]),
        ("It lasts 2 years and 3 months.", [("2 years and 3 months", "DURATION", "P820D", 820)]),
        ("It lasts 1 year, 2 months and 5 days or 3 months, 1 day.", [("1 year, 2 months and 5 days", "DURATION", "P430D", 430), ("3 months, 1 day", "DURATION", "P91D", 91)]),
        ("Pay in 10 business days, 1 working day or 5 Calendar weeks.", [("10 business days", "DURATION", "P10D", 10), ("1 working day", "DURATION", "P1D", 1), ("5 Calendar weeks", "DURATION", "P35D", 35)]),
        ("Pay in 6\nmonths or 99999999999 days.", [("6\nmonths", "DURATION", "P180D", 180), ("99999999999 days", "DURATION", none, none)]),
        ("On Jan. 5, 2020 and Sep 6 2020 and MAY 7, 2020.", [("Jan. 5, 2020", day, "2020-01-05", none), ("Sep 6 2020", day, "2020-09-06", none), ("MAY 7, 2020", day, "2020-05-07", none)]),
        ("On January 5, 2020, 6 Feb. 2020 and 2020-03-04; since Apr. 2020.", [("January 5, 2020", day, "2020-01-05", none), ("6 Feb. 2020", day, "2020-02-06", none), ("2020-03-04", day, "2020-03-04", none), ("Apr. 2020", day, "2020-04", none)]),
    ]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(shapes)], "doc_id int, source_text string")
    rows = extract.timexes(docs).orderBy("doc_id", "start").collect()
    for i, (text, expected) in enumerate(shapes):
        own = [r for r in rows if r["doc_id"] == i]
        assert [(r["text"], r["timex_type"], r["value"], r["duration_days"]) for r in own] == expected, text
        assert all(text[r["start"] : r["end"]] == r["text"] for r in own), text


def test_passages(spark):
    docs = spark.createDataFrame([("a", "The cat sat. The dismissal was unfair."), ("b", "A dismissal letter. Weather.")], "doc_id string, source_text string")
    found = [r["sentence"] for r in retrieval.passages(docs, "unfair dismissal", 2).collect()]
    assert found == ["The dismissal was unfair.", "A dismissal letter."]


def test_bundle(spark, tmp_path):
    graph_ = {"schema_version": "1.2", "document_id": "unknown", "facts": [{"id": "a", "entity": "x", "role": "START", "value": "2024-01-02"}, {"id": "b", "entity": "y", "role": "ODD"}], "dependencies": [{"from_id": "a", "to_id": "zz", "constraint_type": "additive"}]}
    (tmp_path / "one.json").write_text(json.dumps(graph_))
    (tmp_path / "two.json").write_text(json.dumps(graph_ | {"schema_version": "2.0"}))
    (tmp_path / "bad.json").write_text("{no json")
    bundle = bundles.read_graphs(spark, str(tmp_path))
    assert [r["doc_id"] for r in bundle.documents.collect()] == ["one"] and bundle.errors.count() == 2
    fact = bundle.facts.where("fact_id = 'a'").first()
    assert fact["confidence"] == 0.9 and fact["date_parsed"] == date(2024, 1, 2) and fact["temporal_content"]
    messages = [r["message"] for r in bundles.validate(bundle).collect()]
    assert any("role ODD" in m for m in messages) and any("zz is no fact" in m for m in messages) and len(messages) == 4


def test_every_file_is_read_or_an_error(spark, tmp_path):
    whole = {"document_id": "x", "facts": [{"id": "f", "entity": "e", "role": "START"}], "dependencies": []}
    for name, content in {
        "a": whole | {"parties": "Okonkwo", "matter": 7}, "b": whole | {"document_id": "doc_001", "parties": ["One", " ", "Two"]}, "c": whole | {"document_id": "same"}, "d": whole | {"document_id": "same", "extra": {"parties": 3}},
        "e": {"facts": "none", "dependencies": []}, "f": {"facts": []}, "g": [1], "h": whole | {"document_id": None},
    }.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    (tmp_path / "i.json").write_text("")
    bundle = bundles.read_graphs(spark, str(tmp_path))
    docs = {r["file_name"][0]: r for r in bundle.documents.collect()}
    assert {k: r["doc_id"] for k, r in docs.items()} == {"a": "x", "b": "b", "c": "c", "d": "d", "h": "h"}
    assert (docs["a"]["parties"], docs["a"]["matter"], docs["b"]["parties"], docs["c"]["parties"]) == (["Okonkwo"], "7", ["One", "Two"], [])
    assert [r["doc_pos"] for r in sorted(docs.values(), key=lambda r: r["file_name"])] == [1, 2, 3, 4, 5]
    assert {r["file_name"][0] for r in bundle.errors.collect()} == set("efgi")
    # Whatever a plan reads, the same files are in the tables.
    assert bundle.documents.count() == bundle.documents.select("doc_id").distinct().count() == bundle.facts.select("doc_id").distinct().count() == 5
    assert "doc_001" in {r["doc_id"] for r in bundles.read_graphs(spark, str(tmp_path), generic_ids=bundles.COMMAND_GENERIC_IDS).documents.collect()}


def test_correction_logs_are_saved_and_grow(spark, tmp_path):
    path, shape = str(tmp_path / "log.json"), "pos int, op string, doc_id string, fact_id string, new_date string, keys array<array<string>>, ts string"
    assert bundles.read_corrections(spark, path).count() == 0
    for n, op in enumerate(("accept", "edit_date", "merge")):
        more = spark.createDataFrame([(0, op, "d", "f", "2020-01-02" if n == 1 else None, [["d", "f"], ["e", "g"]] if n == 2 else None, "t" if n == 0 else None)], shape)
        bundles.append_corrections(bundles.read_corrections(spark, path), more, path)
    found = bundles.read_corrections(spark, path).orderBy("pos").collect()
    assert [(r["pos"], r["op"], r["new_date"]) for r in found] == [(0, "accept", None), (1, "edit_date", "2020-01-02"), (2, "merge", None)]
    assert found[0]["ts"] == "t" and found[1]["ts"].endswith("+00:00") and found[2]["keys"] == [["d", "f"], ["e", "g"]]
    (tmp_path / "old.json").write_text(json.dumps({"force_merge": [[["a", "1"], ["b", "2"], ["c", "3"]]], "split": [["d", "4"]]}))
    merges, splits = corrections.merges_and_splits(bundles.read_overrides(spark, str(tmp_path / "old.json")))
    assert {tuple(r) for r in merges.collect()} == {("a:1", "b:2"), ("a:1", "c:3")} and [r["key"] for r in splits.collect()] == ["d:4"]


def test_intake_drops_nothing_unless_asked(spark):
    said = "Page noise\n***\n\nThe crane was delivered on 3 May\n2021 and then inspected."
    both = spark.createDataFrame([(said,)], "t string").select(text_functions.intake(F.col("t")).alias("raw"), text_functions.intake(F.col("t"), clean=True).alias("clean")).first()
    assert both["raw"]["text"] == said and both["raw"]["dropped"] == []
    assert both["clean"]["text"] == "The crane was delivered on 3 May 2021 and then inspected." and set(both["clean"]["dropped"]) == {"***", "Page noise"}


def test_long_paragraphs_are_cut_at_sentences(spark):
    sentence = "This is one of the many sentences on 3 May 2021 here. "
    kept = spark.createDataFrame([(sentence * 60,)], "t string").select(text_functions.paragraphs(F.col("t")).alias("p")).first()["p"]
    assert all(len(p) <= 1500 for p in kept) and " ".join(kept) == (sentence * 60).strip() and len(kept) < 5


def pack_files(folder, verdict="LATE"):
    """A pack of our own: 30 days from a delivery."""
    clause = "The buyer gives notice of a fault within 30 days from the date of delivery."
    fact = lambda i, entity, role, **more: {"id": i, "entity": entity, "role": role, "sentence": clause} | more
    (folder / "statute.tdg.json").write_text(json.dumps({"schema_version": "1.0", "document_id": "rule", "source_text": clause, "facts": [fact("a", "delivery", "START"), fact("b", "notice of fault", "END")], "dependencies": [{"from_id": "a", "to_id": "b", "constraint_type": "additive", "constraint_expr": "30 days"}]}))
    (folder / "aliases.json").write_text(json.dumps({"anchor_aliases": {"delivery": {"plain": ["handing over"], "end_role_only": []}}, "action_cues": ["fault"], "procedural_noise": []}))
    cases = {"late.json": ("2021-06-20", "2021-05-10"), "timely.json": ("2021-06-09", "2021-05-10"), "open.json": (None, "2021-05-10")}
    (folder / "gold_cases").mkdir()
    for name, (done, start) in cases.items():
        facts = [{"id": "1", "entity": "handing over of goods", "role": "START", "value": start, "sentence": "They were handed over."}, {"id": "2", "entity": "notice of fault", "role": "END", "value": done, "sentence": "She wrote."}]
        (folder / "gold_cases" / name).write_text(json.dumps({"document_id": name, "facts": facts, "dependencies": []}))
    (folder / "expected.json").write_text(json.dumps({"late.json": {"verdict": verdict, "deadline": "2021-06-09"}, "timely.json": {"verdict": "TIMELY"}, "open.json": {"verdict": "INDETERMINATE"}}))


def test_rule_packs_are_tested(spark, tmp_path):
    for name, verdict in (("good", "LATE"), ("bad", "TIMELY")):
        (tmp_path / name).mkdir()
        pack_files(tmp_path / name, verdict)
    found = {(r["check"], r["subject"]): r["passed"] for r in packs.self_test(spark, str(tmp_path / "good")).collect()}
    assert found == {("relation", "a -> b"): True, ("discovery", "rules"): True, **{("gold case", f"{n}.json"): True for n in ("late", "timely", "open")}}
    assert [r["subject"] for r in packs.self_test(spark, str(tmp_path / "bad")).where("not passed").collect()] == ["late.json"]


def test_roles_by_preposition_verb_and_noun(spark):
    cases = {
        "He worked from {}.": "START", "It ran until {}.": "END", "He had started, then resigned on {}.": "END", "It was signed by all and closed {}.": "END", "The lease began in a year, {}.": "START",
        "On {} he resigned.": "END", "the commencement date, {}": "START", "as of {}": "START", "during {}": "CONTAINS", "seen on {}": "UNKNOWN", "It ended. Then {}": "UNKNOWN", "They met {} and hired him, as was the end": "START",
    }
    rows = [(i, c.format("5 May 2020"), c.index("{"), c.index("{") + 10, role) for i, (c, role) in enumerate(cases.items())]
    df = spark.createDataFrame(rows, "i int, t string, a int, b int, role string")
    for r in df.withColumn("found", extract.role_of(F.col("t"), F.col("a"), F.col("b"), F.lit("DATE"))).collect():
        assert r["found"] == r["role"], r


def test_action_is_the_first_within_the_band(spark):
    rule = spark.createDataFrame([("r", 0, "dismissal", "claim to the tribunal", "x", "a claim is presented to the tribunal", 0, 3, 0, False, "")], "doc_id string, dep_pos int, anchor_entity string, target_entity string, anchor_sentence string, target_sentence string, years int, months int, days int, minus_one_day boolean, description string")
    case = lambda *more: spark.createDataFrame([("c", "0", 0, "dismissal", "x", "END", date(2025, 1, 10), None), *[("c", str(i + 1), i + 1, e, s, "END", d, None) for i, (e, s, d) in enumerate(more)]], "doc_id string, fact_id string, pos int, entity string, sentence string, role string, date_parsed date, is_duplicate_of string")
    check = lambda *more: (lambda r: (r["trace"]["action_fact"], r["verdict"]))(rules.check(rule, case(*more)).first())
    late, early = date(2025, 5, 1), date(2025, 2, 1)
    assert check(("claim to the tribunal", "", late), ("claim tribunal again", "", early)) == ("1", "LATE")  # far better fit wins
    assert check(("claim to the tribunal", "", late), ("tribunal claim", "", early)) == ("2", "TIMELY")  # within the band, the first
    assert check(("weather", "", early), ("a walk", "", late)) == ("2", "LATE")  # nothing fits: the last
    assert check(("tribunal to", "", late), ("notice of rain", "", early)) == ("2", "TIMELY")  # cue words before better fits
    assert check() == (None, "INDETERMINATE")


def test_exports(spark):
    rows = [(date(2024, 1, 2), "day", "x", "agreed", [("d", "f", "quote")], None, 0.9)]
    shape = "date date, precision string, label string, status string, sources array<struct<doc_id:string,fact_id:string,quote:string>>, disputed_values array<struct<date:date,docs:array<string>>>, confidence double"
    row = sinks.export_rows(spark.createDataFrame(rows, shape)).first()
    assert row["Date"] == "2024-01-02" and row["Confidence"] == "0.90" and row["Quotes"] == "quote"
