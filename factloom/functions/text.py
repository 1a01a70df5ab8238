"""Text as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.calendar import NUMBER_WORDS, let, words_to_int

MONTHS = "january february march april may june july august september october november december".split()
# Words that no sentence comparison counts, and words that no comparison of names counts.
STOP_LONG = (
    "the of a an in on to for and or is are was were be been shall will that this by with from at as its it not no any all each such may"
).split()
STOP_SHORT = "the of a an in on to for and or".split()
# Titles of persons, forms of organisations and generic words, which tell no party from another.
PERSON_TITLES = "mr mrs ms miss mx dr prof professor sir dame lord lady rev hon judge justice master messrs".split()
ORGANISATION_FORMS = (
    "ltd limited plc llp llc inc incorporated corp corporation company co group holdings partnership trust foundation association gmbh ag sa sarl bv nv ab as oy spa srl pty kk"
).split()
GENERIC_WORDS = "the and of for estate trading formerly trustees executors others anor ors".split()
NAME_PARTICLES = [*PERSON_TITLES, *ORGANISATION_FORMS, *GENERIC_WORDS]
# How a clause is numbered before its name.
NUMBERED = (r"art\.?\s*\d[\d.]*", r"section\s*\d+[().\d\w]*", r"§\s*\d+[().\d\w]*", r"article\s*\d[\d.]*")
# What stands between words, and where a sentence ends.
NO_WORD, SENTENCE_END = r"[^\p{L}\p{N}]+", r"(?<=[.;:\n])(?=\s)"
CLAUSE_NUMBER = rf"(?iU)^(?:{'|'.join(NUMBERED)})\s*"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case, in order."""
    return F.array_remove(F.split(F.lower(text), NO_WORD), "")


def token_set(text: Column) -> Column:
    """X19."""
    return F.array_distinct(tokens(text))


def flat(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def base_entity(entity: Column) -> Column:
    """Without the number of an article or section before it, lower case."""
    return F.lower(F.trim(F.regexp_replace(entity, CLAUSE_NUMBER, "")))


def normalise_entity(entity: Column, boilerplate: tuple[str, ...] = ()) -> Column:
    """Clause number and boilerplate patterns removed, blanks collapsed, lower; the original if nothing is left."""
    out = F.regexp_replace(entity, CLAUSE_NUMBER, "")
    for pattern in boilerplate:
        out = F.regexp_replace(out, f"(?i){pattern}", " ")
    out = F.lower(flat(out))
    return F.when(out == "", F.lower(entity)).otherwise(out)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def telling_words(text: Column, stop: list[str] = STOP_LONG) -> Column:
    """Blank-separated words without stop words, lower case; punctuation stays."""
    return F.array_except(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""), F.array(*map(F.lit, stop)))


def text_overlap(a: Column, b: Column, stop: list[str] = STOP_LONG) -> Column:
    """Jaccard of the telling words."""
    return jaccard(telling_words(a, stop), telling_words(b, stop))


def entity_similarity(a: Column, b: Column, boilerplate: tuple[str, ...] = ()) -> Column:
    """1 for equal normalised names, else their word overlap."""
    x, y = normalise_entity(a, boilerplate), normalise_entity(b, boilerplate)
    return F.when(x == y, 1.0).otherwise(text_overlap(x, y, STOP_SHORT))


def party_key(name: Column) -> Column:
    """The words of a name that tell it apart, sorted."""
    kept = F.filter(F.array_distinct(tokens(name)), lambda t: (F.length(t) > 1) & ~t.isin(NAME_PARTICLES) & ~t.rlike(r"^\p{N}+$"))
    return F.array_sort(kept)


def parties_overlap(a: Column, b: Column) -> Column:
    """Some key of one side is contained in a key of the other; arrays of arrays."""
    inside = lambda x, y: (F.size(x) > 0) & (F.size(F.array_except(x, y)) == 0)
    return F.exists(a, lambda x: F.exists(b, lambda y: inside(x, y) | inside(y, x)))


def same_matter(matter_a: Column, matter_b: Column, parties_a: Column, parties_b: Column) -> Column:
    """struct(allowed, reason). Declared matters decide, then named parties; silence never blocks. parties: keys."""
    named = (F.size(parties_a) > 0) & (F.size(parties_b) > 0)
    return (
        F.when(matter_a.isNotNull() & matter_b.isNotNull(), F.struct((matter_a == matter_b).alias("allowed"), F.lit("declared matter").alias("reason")))
        .when(named, F.struct(parties_overlap(parties_a, parties_b).alias("allowed"), F.lit("named parties").alias("reason")))
        .otherwise(F.struct(F.lit(True).alias("allowed"), F.lit("not stated").alias("reason")))
    )


def sentences(text: Column) -> Column:
    """Array of struct(start, sentence); a sentence ends at . ; : or a line end before white space."""
    parts = F.split(text, SENTENCE_END)
    lengths = F.transform(parts, F.length)
    starts = F.transform(parts, lambda p, i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x))
    cut = F.transform(F.arrays_zip(parts.alias("p"), starts.alias("s")), lambda z: F.struct((z["s"] + F.length(z["p"]) - F.length(F.ltrim(z["p"]))).alias("start"), flat(z["p"]).alias("sentence")))
    return F.filter(cut, lambda z: z["sentence"] != "")


def clauses(text: Column) -> Column:
    """X10."""
    return F.filter(F.transform(F.split(text, r"(?<=[.;:])\s+"), flat), lambda x: x != "")


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """X11: from the last sentence end before a span to the first after it."""
    before, after = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    head = F.regexp_extract(before, r"([^.;\n]*)$", 1)
    return flat(F.concat(head, F.substring(text, start + 1, end - start), F.regexp_extract(after, r"^([^.;\n]*[.;]?)", 1)))


def normalize_whitespace(text: Column) -> Column:
    """Line ends, words broken by hyphens, blanks, trailing blanks, at most one empty line."""
    for pattern, to in (("\r\n?", "\n"), (r"(\w)-\n(\w)", "$1$2"), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# Shapes of what may be a date or a period; a month's name needs a day or a year beside it.
_SHORT_MONTHS = "jan feb mar apr jun jul aug sep sept oct nov dec".split()
_MONTH_NAME = "(?:" + "|".join([*MONTHS, *_SHORT_MONTHS]) + ")"
DATE_LIKE = (
    r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH_NAME}\b",
    rf"\b{_MONTH_NAME}\s+\d{{1,2}}\b",
    rf"\b{_MONTH_NAME}\s+\d{{4}}\b",
    r"\b(?:19|20)\d{2}\b",
    r"\b\d+\s+(?:day|week|month|year|hour)s?\b",
    r"\b(?:yesterday|today|tomorrow|forthwith|immediately)\b",
)
# Page furniture of law reports and letters.
JUNK = (
    r"^\s*OJ\s+[A-Z]\s+\d+", r"^\s*\(\d+\)\s*$", r"^\s*\d+\s*/\s*\d+\s*$", r"^\s*[IVX]+\s*$", r"^\s*[-–—]+\s*$", r"^\s*\*+\s*$",
    "official journal", "european communities", r"^\s*\(language of the case", r"^\s*judgment of the court", r"^\s*in case\s+[A-Z]-\d+",
)


def has_date_like(text: Column) -> Column:
    """any token that may be a date or a period."""
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in DATE_LIKE))


def mentions_date(text: Column, when: Column) -> Column:
    """F16: states a date as ISO, by year, day and the month's first three letters, or in numbers either way round."""
    low, name = F.lower(text), F.lower(F.date_format(when, "MMM"))
    day, month, year = F.dayofmonth(when).cast("string"), F.month(when).cast("string"), F.year(when).cast("string")
    spoken = F.contains(low, year) & F.regexp_like(low, F.concat(F.lit(r"\b0?"), day, F.lit(r"\b"))) & F.contains(low, name)
    number = lambda a, b: F.regexp_like(low, F.concat(F.lit(r"\b0?"), a, F.lit(r"[./-]0?"), b, F.lit("[./-](?:"), year, F.lit("|"), F.substring(year, 3, 2), F.lit(r")\b")))
    return F.contains(low, F.date_format(when, "yyyy-MM-dd")) | spoken | number(day, month) | number(month, day)


def is_junk_line(line: Column) -> Column:
    """page furniture or a line of columns, and never a line with a date."""
    trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
    return ~has_date_like(trimmed) & trimmed.rlike("(?i)" + "|".join(f"(?:{p})" for p in (*JUNK, r"\s{6,}")))


def paragraphs(text: Column, most: int = 1500) -> Column:
    """The kept paragraphs; one of over ``most`` characters is cut where a sentence ends before a capital, and put together again up to that length."""
    pieces = lambda p: F.filter(F.transform(F.split(p, r"(?<=[.!?])\s+(?=[A-Z])"), F.trim), lambda x: x != "")
    empty = F.array().cast("array<string>")

    def pack(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", last, piece)))
        return F.when((F.size(done) > 0) & (F.length(last) + F.length(piece) < most), joined).otherwise(F.concat(done, F.array(piece)))

    cut = lambda p: F.when(F.length(p) > most, F.aggregate(pieces(p), empty, pack)).otherwise(F.array(p))
    return F.flatten(F.transform(clean_paragraphs(text)["kept"], cut))


def clean_paragraphs(text: Column, least: int = 80) -> Column:
    """struct(kept, dropped): paragraphs without junk lines; a short one stays only with a date."""
    joined = F.regexp_replace(F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2"), r"(?m)^\s*[-•*]\s+", "")
    blocks = F.split(joined, r"\n\s*\n")
    lines = F.transform(blocks, lambda b: F.split(b, r"\n"))
    paragraphs = F.transform(lines, lambda ls: flat(F.array_join(F.filter(ls, lambda x: ~is_junk_line(x)), " ")))
    junk = F.filter(F.transform(F.flatten(lines), F.trim), lambda x: (x != "") & is_junk_line(x))
    keeps = lambda p: (F.length(p) >= least) | has_date_like(p)
    short = F.filter(paragraphs, lambda p: (p != "") & ~keeps(p))
    return F.struct(F.filter(paragraphs, lambda p: (p != "") & keeps(p)).alias("kept"), F.concat(junk, short).alias("dropped"))


def intake(text: Column, clean: bool = False) -> Column:
    """struct(text, dropped): by default the text with white space normalised, nothing dropped; cleaned only on request."""
    if not clean:
        return F.struct(normalize_whitespace(text).alias("text"), F.array().cast("array<string>").alias("dropped"))
    return F.struct(F.array_join(paragraphs(text), "\n\n").alias("text"), clean_paragraphs(text)["dropped"].alias("dropped"))


def best_paragraph(text: Column, keywords: list[str], most: int = 2000) -> Column:
    """The first paragraph of highest 2 * dates + keywords; else the flat text, cut."""
    kept = clean_paragraphs(text)["kept"]
    score = lambda p: 2 * F.size(F.regexp_extract_all(p, F.lit(r"(\b\d{4}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b)"), F.lit(1))) + F.size(F.array_intersect(tokens(p), F.array(*map(F.lit, keywords))))
    scored = F.transform(kept, lambda p, i: F.struct(score(p).alias("s"), (-i).alias("i"), p.alias("p")))
    return F.coalesce(F.array_max(scored)["p"], F.substring(flat(text), 1, most))


def quote_supported(source: Column, *candidates: Column, least: int = 12) -> Column:
    """A flattened quote of at least 12 characters stands in the flattened source."""
    found = [F.coalesce((F.length(flat(c)) >= least) & F.contains(flat(source), flat(c)), F.lit(False)) for c in candidates]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def stated_offsets(text: Column) -> Column:
    """Distinct struct(n, unit) of the periods that a text states, in digits or in words.

    Word boundaries hold, so 'twenty-one days' is 21 days and never one day.
    """
    pattern = r"(?:(\d+)|((?:" + "|".join(NUMBER_WORDS) + r")(?:[ -](?:and )?(?:" + "|".join(NUMBER_WORDS) + r"))*))[ -]+(day|week|month|year)s?\b"
    # Where a number begins is tested before its words.
    found = lambda low: F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9-])(?=[0-9e-hn-t])" + pattern), F.lit(0))
    number = lambda m: F.coalesce(F.regexp_extract(m, r"^(\d+)", 1).try_cast("int"), words_to_int(F.regexp_replace(m, r"[ -]+(?:day|week|month|year)s?$", "")))
    one = lambda m: F.struct(number(m).alias("n"), F.regexp_extract(m, r"(day|week|month|year)s?$", 1).alias("unit"))
    return let(F.lower(text), lambda low: F.array_distinct(F.transform(found(low), one)))


def supporting_quote(sentence: Column, raw: Column, when: Column, value: Column | None = None) -> Column:
    """struct(quote, corroborated): the field of at least four words that states the date, else the value."""
    stated = F.when(when.isNotNull(), F.lit(True))
    states = lambda t: mentions_date(t, when) if value is None else F.when(stated, mentions_date(t, when)).otherwise((value != "") & F.contains(F.lower(t), F.lower(value)))
    good = lambda t: F.coalesce((F.size(tokens(t)) >= 4) & states(t), F.lit(False))
    found = lambda t, ok: F.struct(t.alias("quote"), F.lit(ok).alias("corroborated"))
    return F.when(good(sentence), found(sentence, True)).when(good(raw), found(raw, True)).otherwise(found(F.coalesce(sentence, F.lit("")), False))


def strip_fences(text: Column) -> Column:
    """JSON without its code fence."""
    return F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
