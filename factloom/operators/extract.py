"""Dated facts from text (E01, E03, E05, E07, W03, W06, W07), with offsets, as Columns.

The expressions are found with regular expressions on the JVM; no text leaves it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.calendar import UNIT_DAYS, parse_date
from factloom.functions.text import MONTHS, sentence_around

_MONTH = "(?:" + "|".join(rf"{m}|{m[:3]}\b\.?" for m in MONTHS) + ")"
_AND = r"(?:\s*,\s*|\s+and\s+)"
# Both years of 'from 2019 to 2021'; just the first where a full date follows.
_RANGE = r"(?:from|between)\s+\d{4}\s+(?:to|and|until|through|[-–—])\s+(?:(?=\d{4}-\d{2}-\d{2}\b)|\d{4})"
# Expression kinds in order of precedence; an earlier one keeps its place.
PATTERNS = (
    ("DATE", _RANGE),
    ("DATE", r"(?<=\()\d{4}(?=\))"),
    ("DURATION", rf"\d+\s+years?{_AND}\d+\s+months?(?:{_AND}\d+\s+days?)?"),
    ("DURATION", rf"\d+\s+months?{_AND}\d+\s+days?"),
    ("DURATION", r"\d+\s+(?:business|calendar|working)\s+(?:day|week|month|year)s?"),
    ("DATE", rf"\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH}\s+\d{{4}}"),
    ("DATE", rf"{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}"),
    ("DATE", r"\d{4}-\d{2}-\d{2}"),
    ("DATE", r"\d{1,2}[./]\d{1,2}[./]\d{4}"),
    ("DATE", rf"{_MONTH}\s+\d{{4}}"),
    ("DURATION", r"\d+\s+(?:day|week|month|year)s?"),
)
# Prepositions just before an expression, verbs near it and nouns of its sentence that tell its role.
PREPOSITIONS = {
    "START": ("from", "since", "starting", "beginning", "as of", "effective"),
    "END": ("until", "till", "through", "by", "before", "no later than", "ending"),
    "DURATION": ("for", "over", "spanning", "within"),
    "CONTAINS": ("during", "throughout", "amid", "while"),
}
VERBS = {
    "END": (
        "end finish terminate expire close conclude dissolve abolish complete cease stop adjourn discharge die resign retire abdicate surrender repeal dismiss graduate demolish "
        "fall defeat cure ended finished terminated expired closed concluded dissolved abolished completed ceased stopped discharged died resigned retired abdicated "
        "surrendered repealed dismissed graduated defeated cured fell"
    ).split(),
    "START": (
        "begin start commence initiate launch open inaugurate establish found incorporate admit diagnose enroll deploy bear enter invade sign execute file hire appoint elect "
        "accede ascend announce award take began started commenced initiated launched opened inaugurated established founded incorporated admitted diagnosed enrolled "
        "deployed born entered invaded signed executed filed hired appointed elected announced awarded"
    ).split(),
    "DURATION": (
        "last continue span endure persist extend run serve reign rule survive lasted continued spanned endured persisted extended ran served reigned ruled survived"
    ).split(),
}
NOUNS = {
    "START": (
        "start beginning commencement inception onset outset founding establishment admission diagnosis birth inauguration signing execution opening launch"
    ).split(),
    "END": "end conclusion termination expiration expiry closure death discharge dissolution completion surrender resignation retirement graduation".split(),
    "DURATION": "duration length period span term tenure reign".split(),
}
# Words that show that an edge rests on a stated period.
TRIGGERS = ("within", "after", "before", "from", "no later than", "not later than", "following", "upon", "prior to", "at least", "at most", "thereof")


def timexes(documents: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, start, end, text, timex_type, value, date_parsed, duration_days in order of place.

    With ``keep_text`` also ``around``, the line and sentence parts about it, and its place in them.
    """
    any_of = r"(?i)\b(" + "|".join(f"(?:{p})" for _, p in PATTERNS) + r")\b"
    pieces = F.split("source_text", any_of)  # what stands between the matches gives their places
    found = F.regexp_extract_all("source_text", F.lit(any_of), F.lit(1))
    rows = documents.select("doc_id", "source_text", F.transform(pieces, F.length).alias("gaps"), found.alias("found")).select("doc_id", "source_text", "gaps", F.transform("found", F.length).alias("sizes"), F.posexplode("found").alias("i", "text"))
    total = lambda a, n: F.aggregate(F.slice(F.col(a), F.lit(1), n), F.lit(0), lambda s, x: s + x)
    at = total("gaps", F.col("i") + 1) + total("sizes", F.col("i"))
    prefix, year = (F.regexp_extract("text", rf"(?i)^((?:from|between)\s+)(\d{{4}})", i) for i in (1, 2))
    years = F.array(F.struct((F.col("at") + F.length(prefix)).alias("start"), year.alias("text")), F.struct((F.col("at") + F.length("text") - 4).alias("start"), F.substring("text", -4, 4).alias("text")))
    spans = F.when(prefix == "", F.array(F.struct(F.col("at").alias("start"), "text"))).otherwise(F.filter(years, lambda y: y["text"].rlike(r"^\d{4}$")))
    rows = rows.withColumn("at", at).select("doc_id", "source_text", F.inline(spans))
    flat = F.initcap(F.regexp_replace("text", r"\s+", " "))
    kind = F.when(flat.rlike(r"(?i)^\d+ (business |calendar |working )?(day|week|month|year)"), "DURATION").otherwise("DATE")
    named = F.regexp_replace(flat, r"([A-Z][a-z]{2})\.", "$1")
    day = F.coalesce(parse_date(named), *[F.try_to_timestamp(named, F.lit(f)).cast("date") for f in ("MMM d, yyyy", "MMM d yyyy")])
    date = F.when(kind == "DATE", day)
    month = F.when((kind == "DATE") & date.isNull(), F.coalesce(*[F.try_to_timestamp(named, F.lit(f)).cast("date") for f in ("MMMM yyyy", "MMM yyyy")]))
    days = F.when(kind == "DURATION", _days(flat))
    value = F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.date_format(month, "yyyy-MM"), F.when(flat.rlike(r"^\d{4}$"), flat), F.concat(F.lit("P"), days.cast("string"), F.lit("D")))
    return rows.select("doc_id", "start", (F.col("start") + F.length("text")).alias("end"), "text", kind.alias("timex_type"), value.alias("value"), date.alias("date_parsed"), days.alias("duration_days"), sentence_around(F.col("source_text"), F.col("start"), F.col("start") + F.length("text")).alias("sentence"), *_around(keep_text))


def _around(keep: bool) -> list[Column]:
    """The text from the last full stop or line end before an expression to the first full stop after it."""
    if not keep:
        return []
    before = F.regexp_extract(F.substring("source_text", F.lit(1), F.col("start")), r"([^.\n]*)$", 1)
    after = F.regexp_extract(F.substring("source_text", F.col("start") + F.length("text") + 1, F.length("source_text")), r"^([^.]*\.?)", 1)
    return [F.concat(before, "text", after).alias("around"), F.length(before).alias("around_start"), (F.length(before) + F.length("text")).alias("around_end")]


def _days(text: Column) -> Column:
    """Approximate days of all parts of '2 years and 3 months', also of '10 business days'; null if too many."""
    out = F.lit(0).cast("decimal(38,0)")
    for unit, days in UNIT_DAYS.items():
        found = F.regexp_extract_all(text, F.lit(rf"(?i)(\d+) (?:business |calendar |working )?{unit}"), F.lit(1))
        out = F.try_add(out, F.aggregate(found, F.lit(0).cast("decimal(38,0)"), lambda a, x: F.try_add(a, F.try_multiply(x.try_cast("decimal(20,0)"), F.lit(days))).try_cast("decimal(38,0)")))  # noqa: B023
    return out.try_cast("int")


def role_of(text: Column, start: Column, end: Column, timex_type: Column) -> Column:
    """A duration's own role, else that of the preposition just before, of the nearest verb of the sentence (one behind counts 10 more), or of a noun."""
    head = F.regexp_extract(F.lower(F.substring(text, F.lit(1), start)), r"([^.\n]*)$", 1)
    tail = F.regexp_extract(F.lower(F.substring(text, end + 1, F.length(text))), r"^([^.]*\.?)", 1)
    window = F.trim(F.substring(head, -30, 30))
    out = F.when(timex_type == "DURATION", "DURATION")
    for role, listed in PREPOSITIONS.items():
        out = out.when(window.rlike(rf"\b(?:{'|'.join(listed)})\s*$"), role)
    role_of_verb = F.create_map(*[F.lit(x) for role, listed in VERBS.items() for verb in listed for x in (verb, role)])
    words = lambda t: F.filter(F.regexp_extract_all(t, F.lit("([a-z]+)"), F.lit(1)), lambda w: role_of_verb[w].isNotNull())
    # A verb's place is where its letters stand last before the expression, and first behind it.
    since = lambda w: F.length(F.call_function("substring_index", head, w, F.lit(-1))) + F.length(w)
    near = lambda side: lambda w, i: F.struct((since(w) if side == 0 else F.instr(tail, w) + 9).alias("far"), F.lit(side).alias("side"), i.alias("i"), role_of_verb[w].alias("role"))
    verb = F.array_min(F.concat(F.transform(words(head), near(0)), F.transform(words(tail), near(1))))
    out = out.when(verb.isNotNull(), verb["role"])
    for role, listed in NOUNS.items():
        out = out.when(F.concat_ws(" ", head, tail).rlike(rf"\b(?:{'|'.join(listed)})\b"), role)
    return out.otherwise("UNKNOWN")


def entity_of(sentence: Column, text: Column, fallback: Column) -> Column:
    """The last capitalised name before the expression, else the first after it."""
    name = r"((?:[A-Z][\p{L}'-]+)(?:\s+[A-Z][\p{L}'-]+)*)"
    before = F.regexp_extract_all(F.split_part(sentence, text, F.lit(1)), F.lit(name), F.lit(1))
    after = F.regexp_extract(F.split_part(sentence, text, F.lit(-1)), name, 1)
    noun = F.regexp_extract(sentence, r"(?i)\b(?:the|this|a|an)\s+(\w+)", 1)
    return F.coalesce(F.try_element_at(before, F.lit(-1)), F.nullif(after, F.lit("")), F.nullif(noun, F.lit("")), fallback)


def mark_duplicates(facts: DataFrame, same: list[str], name: str, order: str) -> DataFrame:
    """Facts with is_duplicate_of, the name of the first of those with the same columns; null for the first itself."""
    keys = [F.col(c).alias(f"_key{i}") for i, c in enumerate(same)]
    first = facts.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n")))["n"].alias("_name"))
    joined = facts.join(first, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(same)], "left").drop(*[f"_key{i}" for i in range(len(same))])
    return joined.withColumn("is_duplicate_of", F.when(F.col("_name") != F.col(name), F.col("_name"))).drop("_name")


def extract_facts(documents: DataFrame) -> DataFrame:
    """Facts of each document; the first of each (entity, role, value) stays, others name it as duplicate."""
    found = timexes(documents, keep_text=True).join(documents.select("doc_id", F.coalesce("document_type", F.lit("document")).alias("_type")), "doc_id")
    facts = found.withColumns({"role": role_of(F.col("around"), F.col("around_start"), F.col("around_end"), F.col("timex_type")), "entity": entity_of(F.col("sentence"), F.col("text"), F.col("_type"))})
    order = Window.partitionBy("doc_id").orderBy("start")
    facts = facts.withColumn("fact_pos", F.row_number().over(order) - 1).withColumn("fact_id", F.format_string("f%03d", F.col("fact_pos") + 1))
    return mark_duplicates(facts, ["doc_id", "entity", "role", "value"], "fact_id", "start").select(
        "doc_id", "fact_id", "fact_pos", "entity", "role", "value", F.col("text").alias("raw_text"), "timex_type", "sentence", "date_parsed", "duration_days", F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.lit(0.7).alias("confidence"), "is_duplicate_of", F.lit(True).alias("temporal_content"),
    )


#: Extractors by name; each takes documents (doc_id, source_text, document_type) and returns facts.
EXTRACTORS = {"regex": extract_facts}


def downgrade_edges(deps: DataFrame, facts: DataFrame, triggers: tuple[str, ...] = TRIGGERS) -> DataFrame:
    """an additive edge is ordering when no trigger word stands in either sentence or its target is dated."""
    side = lambda p: facts.select("doc_id", F.col("fact_id").alias(f"{p}_id"), F.col("sentence").alias(f"{p}_s"), F.col("date_parsed").alias(f"{p}_d"))
    joined = deps.join(side("from"), ["doc_id", "from_id"]).join(side("to"), ["doc_id", "to_id"])
    said = F.concat_ws(" ; ", "from_s", "to_s").rlike(rf"(?i)\b(?:{'|'.join(triggers)})\b")
    weak = (F.col("constraint_type") == "additive") & (~said | F.col("to_d").isNotNull())
    return joined.withColumn("constraint_type", F.when(weak, "ordering").otherwise(F.col("constraint_type"))).drop("from_s", "to_s", "from_d", "to_d")
