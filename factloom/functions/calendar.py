"""Calendar arithmetic as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words and approximate days of a unit.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
    "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
UNIT_DAYS = {"year": 365, "month": 30, "week": 7, "day": 1}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def offset_from_text(text: Column) -> Column:
    """struct(years, months, days) of '3 months and 2 weeks' or 'P3M2W'; null if none.

    Repeated units add up; a week is seven days. ISO text is read in full.
    """
    digits = lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("int")
    # A run of figures has one unit behind it, so one search finds all units; ISO parts follow those in words.
    words = lambda low: F.regexp_extract_all(low, F.lit(r"(\d+[ -]*(?:year|month|week|day))s?\b"), F.lit(1))
    iso = lambda low: F.when(low.rlike(r"^p(\d+[ymwd])+$"), F.regexp_extract_all(low, F.lit(r"(\d+[ymwd])"), F.lit(1)))
    last = lambda x: F.regexp_extract(x, r"([ymwd])[a-z]*$", 1)
    parts = lambda low: F.transform(F.concat(words(low), F.coalesce(iso(low), F.array().cast("array<string>"))), lambda x: F.struct(last(x).alias("u"), digits(x).alias("n")))
    total = lambda ps, u: F.aggregate(F.filter(ps, lambda x: x["u"] == u), F.lit(0), lambda a, x: a + x["n"])
    whole = lambda ps: F.struct(total(ps, "y").alias("years"), total(ps, "m").alias("months"), (total(ps, "w") * 7 + total(ps, "d")).alias("days"))
    stated = lambda low: F.when(low.rlike(r"\d"), let(parts(low), lambda ps: F.when(F.size(ps) > 0, whole(ps))))
    some = lambda o: F.when((o["years"] != 0) | (o["months"] != 0) | (o["days"] != 0), o)
    return let(F.lower(text), lambda low: let(stated(low), some))


def apply_offset(start: Column, years: Column | int, months: Column | int, days: Column | int, minus_one_day: Column | bool = False) -> Column:
    """Calendar-exact; months clamp to the end of the month, then days, then the inclusive day."""
    as_int = lambda x: x if isinstance(x, Column) else F.lit(x)
    moved = F.date_add(F.add_months(start, as_int(years) * 12 + as_int(months)), as_int(days))
    return F.date_sub(moved, F.when(as_int(minus_one_day), 1).otherwise(0))


def iso_period(text: Column) -> Column:
    """struct(years, months, days) of a full PnYnMnWnD; null otherwise."""
    part = lambda u: F.coalesce(F.regexp_extract(text, rf"(\d+){u}", 1).try_cast("int"), F.lit(0))
    good = text.rlike(r"^P(?=\d)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?$")
    return F.when(good, F.struct(part("Y").alias("years"), part("M").alias("months"), (part("W") * 7 + part("D")).alias("days")))


def approximate_days(text: Column) -> Column:
    """Days of an ISO duration with 365-day years and 30-day months; null if it is none."""
    part = lambda u: F.coalesce(F.regexp_extract(text, rf"(\d+){u}", 1).try_cast("int"), F.lit(0))
    good = text.rlike(r"^P(\d+[YMWD])+$")
    return F.when(good, part("Y") * 365 + part("M") * 30 + part("W") * 7 + part("D"))


def words_to_int(text: Column) -> Column:
    """D05: 'one hundred and twenty' to 120; null if a word is no number word."""
    words = F.filter(F.split(F.lower(text), r"[\s-]+"), lambda w: (w != "") & (w != "and"))
    table = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    values = F.transform(words, lambda w: F.coalesce(table[w], w.try_cast("int")))
    total = lambda vs: F.aggregate(vs, F.lit(0), lambda a, v: F.when(v == 100, F.greatest(a, F.lit(1)) * 100).otherwise(a + v))
    return let(values, lambda vs: F.when((F.size(vs) > 0) & F.forall(vs, lambda v: v.isNotNull()), total(vs)))


def text_duration_days(text: Column) -> Column:
    """D05, D06: '21 days' or 'three months' in approximate days; null if there is none."""
    units = "|".join(UNIT_DAYS)
    phrase = F.regexp_extract(F.lower(text), rf"((?:[a-z0-9]+[ -]+)*?)([a-z0-9]+)[ -]+({units})s?\b", 0)
    unit = F.regexp_extract(phrase, rf"({units})s?$", 1)
    number = F.regexp_extract(phrase, r"(\d+)[ -]+[a-z]+$", 1).try_cast("int")
    spoken = "|".join(NUMBER_WORDS)
    words = F.regexp_extract(phrase, rf"((?:(?:{spoken}|and)[ -]+)+)[a-z]+$", 1)
    table = F.create_map(*[F.lit(x) for pair in UNIT_DAYS.items() for x in pair])
    return F.coalesce(number, words_to_int(F.trim(words))) * table[F.nullif(unit, F.lit(""))]


def parse_date(text: Column) -> Column:
    """The first format that fits; never the present day's parts."""
    formats = ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d MMM yyyy", "dd/MM/yyyy", "dd.MM.yyyy")
    clean = F.regexp_replace(F.trim(text), r"(\d)(st|nd|rd|th)\b", "$1")
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)).cast("date") for f in formats])


def precision(date_parsed: Column, value: Column, duration_days: Column) -> Column:
    """Day, month, year, relative or none."""
    return (
        F.when(date_parsed.isNotNull(), "day").when(value.rlike(r"^\d{4}-\d{2}$"), "month").when(value.rlike(r"^\d{4}$"), "year")
        .when(value.rlike(r"^P\d") | duration_days.isNotNull(), "relative").otherwise("none")
    )


def value_interval(value: Column) -> Column:
    """struct(lo, hi) of YYYY-MM-DD, YYYY-MM or YYYY; null otherwise."""
    day = F.try_to_timestamp(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value), F.lit("yyyy-MM-dd")).cast("date")
    month = F.try_to_timestamp(F.when(value.rlike(r"^\d{4}-\d{2}$"), F.concat(value, F.lit("-01"))), F.lit("yyyy-MM-dd")).cast("date")
    year = F.try_to_timestamp(F.when(value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-01-01"))), F.lit("yyyy-MM-dd")).cast("date")
    lo = F.coalesce(day, month, year)
    hi = F.coalesce(day, F.last_day(month), F.date_sub(F.add_months(year, 12), 1))
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def allen(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The order of tests matters; a missing end or a start after its end is UNKNOWN."""
    known = F.coalesce((a_start <= a_end) & (b_start <= b_end), F.lit(False))
    return (
        F.when(~known, "UNKNOWN")
        .when((a_start == b_start) & (a_end == b_end), "EQUALS")
        .when(a_end < b_start, "BEFORE").when(a_start > b_end, "AFTER")
        .when(a_end == b_start, "MEETS").when(a_start == b_end, "MET_BY")
        .when((a_start < b_start) & (a_end > b_start) & (a_end < b_end), "OVERLAPS")
        .when((a_start > b_start) & (a_start < b_end) & (a_end > b_end), "OVERLAPPED_BY")
        .when((a_start == b_start) & (a_end < b_end), "STARTS").when((a_start == b_start) & (a_end > b_end), "STARTED_BY")
        .when((a_start > b_start) & (a_end < b_end), "DURING").when((a_start < b_start) & (a_end > b_end), "CONTAINS")
        .when((a_end == b_end) & (a_start > b_start), "FINISHES").when((a_end == b_end) & (a_start < b_start), "FINISHED_BY")
        .otherwise("UNKNOWN")
    )


def values_match(date_a: Column, date_b: Column, days_a: Column, days_b: Column, value_a: Column, value_b: Column, tolerance: int = 5) -> Column:
    """struct(matches, delta): dates, else durations, else ISO durations; null matches if unknown."""
    delta = F.coalesce(F.abs(F.datediff(date_b, date_a)), F.abs(days_b - days_a), F.abs(approximate_days(value_b) - approximate_days(value_a)))
    return F.struct((delta <= tolerance).alias("matches"), delta.alias("delta"))


def span_compatibility(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column, half_life: float = 365.0) -> Column:
    """1 if the spans meet, else halved for each half life of gap; 0 if a span is missing."""
    gap = F.greatest(F.datediff(b_lo, a_hi), F.datediff(a_lo, b_hi), F.lit(0))
    known = a_lo.isNotNull() & a_hi.isNotNull() & b_lo.isNotNull() & b_hi.isNotNull()
    return F.when(known, F.pow(F.lit(0.5), gap / half_life)).otherwise(0.0)


def temporal_proximity(date_a: Column, date_b: Column, days_a: Column | None = None, days_b: Column | None = None, half_life: float = 21.0) -> Column:
    """0.5 ** (gap / half life) on dates, else on durations, else null."""
    gap = F.abs(F.datediff(date_b, date_a))
    gap = gap if days_a is None else F.coalesce(gap, F.abs(days_b - days_a))
    return F.pow(F.lit(0.5), gap / half_life)


def active_on(start: Column, end: Column, on: Column) -> Column:
    """Whether an interval with possibly missing ends holds on a day."""
    return (
        F.when(start.isNull() & end.isNull(), "UNKNOWN").when(on < start, "NO").when(on > end, "NO")
        .when(start.isNull(), "YES (start unknown)").when(end.isNull(), "YES (no end found)").otherwise("YES")
    )


def gap_incompatible(date_a: Column, date_b: Column, span_days: Column, least: int = 60, part: float = 0.25) -> Column:
    """both dated and further apart than max(least, part of the group's span)."""
    return F.coalesce(F.abs(F.datediff(date_b, date_a)) > F.greatest(F.lit(float(least)), part * span_days), F.lit(False))


def tolerance_days(delta: Column, base: int = 15) -> Column:
    """Base + int(1.5 * |days| / 365)."""
    return (base + F.floor(1.5 * F.abs(delta) / 365)).cast("int")


def tolled(deadline: Column, start: Column, end: Column, floor_after_end: tuple[int, int, int] = (0, 0, 0), after_expiry: bool = False) -> Column:
    """The deadline moved by the days of a suspension, at least end + a period; kept if it starts too late."""
    moved = F.greatest(F.date_add(deadline, F.datediff(end, start)), apply_offset(end, *floor_after_end))
    applies = start.isNotNull() & end.isNotNull() & ((start < deadline) | F.lit(after_expiry))
    return F.when(applies, moved).otherwise(deadline)


def repair_month_as_duration(date: Column, raw: Column) -> Column:
    """A date whose month only repeats the number of a stated duration is none."""
    stated = F.regexp_extract(F.lower(raw), r"\b(\d{1,2})\s+months?\b", 1).try_cast("int")
    has_name = F.lower(raw).rlike(r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)")
    return F.when((F.month(date) == stated) & ~has_name & ~raw.rlike(r"\d{4}"), F.lit(None)).otherwise(date)


def repair_year(date: Column, raw: Column) -> Column:
    """The single year that the raw text states replaces another year."""
    years = F.array_distinct(F.regexp_extract_all(raw, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)))
    stated = F.when(F.size(years) == 1, F.element_at(years, 1).try_cast("int"))
    moved = F.add_months(date, (stated - F.year(date)) * 12)
    return F.when(stated.isNotNull() & (stated != F.year(date)), moved).otherwise(date)
