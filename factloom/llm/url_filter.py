"""URL filter: host and path rules first, then a weighted vocabulary.

The vocabulary is one Aho-Corasick automaton over strict and soft terms. A hit
counts only between boundaries: neither neighbour is a letter a-z or a digit.
A URL is blocked on one strict term, or on ``min_soft`` distinct soft terms.

Defined cases: null or no ``://``: host and path are empty and no rule fits; the
vocabulary still sees the string, null counts as allowed. Repeated rows give
repeated rows. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import map_rows, table

# The rules of the contract, host, path and verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# The vocabulary. One strict term blocks alone.
STRICT = ("porn", "xxx", "sexcam", "escort", "hentai", "spam-farm", "spamfarm", "link-farm", "linkfarm", "viagra", "cialis", "warez")
SOFT = ("adult", "bet", "bonus", "casino", "cheap", "click", "deals", "discount", "farm", "free", "loan", "lottery", "pharmacy", "pills", "poker", "replica", "spam", "win")

SCHEMA = "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both are empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return lower_ascii(rest[:end]), path[:stop]


@dataclass(frozen=True)
class UrlFilter:
    rules: tuple[tuple[str, str, str], ...] = RULES
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    min_soft: int = 2

    @lru_cache(maxsize=8)
    def _automaton(self):
        automaton = ahocorasick.Automaton()
        for kind, terms in ((0, self.strict), (1, self.soft)):
            for term in terms:
                automaton.add_word(term, (kind, term))
        automaton.make_automaton()
        return automaton

    def rule_for(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, as its text and verdict."""
        fits = [(len(h) + len(p), h + p, v) for h, p, v in self.rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else None

    def term_hits(self, url: str | None) -> tuple[int, int]:
        """Distinct strict and soft terms that stand between boundaries."""
        text = lower_ascii(url or "")
        found: tuple[set, set] = (set(), set())
        for end, (kind, term) in self._automaton().iter(text):
            before = end - len(term)
            if (before < 0 or text[before] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                found[kind].add(term)
        return len(found[0]), len(found[1])

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = split_url(url)
        rule = self.rule_for(host, path)
        strict, soft = self.term_hits(url)
        verdict = rule[1] if rule else "block" if strict or soft >= self.min_soft else "allow"
        return host, path, rule[0] if rule else None, verdict, strict, soft


def judge_urls(pages: DataFrame, url_filter: UrlFilter = UrlFilter()) -> DataFrame:
    """A row with host, path, rule, verdict and term counts for each page."""

    def judge(batch: pa.RecordBatch) -> dict:
        rows = [url_filter.judge(u) for u in batch.column("url").to_pylist()]
        names = ("host", "path", "rule", "verdict", "n_strict", "n_soft")
        return {"page_id": batch.column("page_id").cast(pa.int64())} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_rows(pages.select("page_id", "url"), SCHEMA, judge)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    listed = lambda terms: "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    count = lambda terms: f"len(list_filter({listed(terms)}, lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))"
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(url, '{upper}', '{lower}'), '') AS low,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest,
         row_number() OVER () AS r
  FROM pages),
named AS (
  SELECT page_id, r, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(h, p, v) AS (VALUES {rules}),
best AS (
  SELECT r, max_by(h || p, length(h) + length(p)) AS rule, max_by(v, length(h) + length(p)) AS v
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
counted AS (SELECT *, {count(STRICT)} AS ns, {count(SOFT)} AS nw FROM named)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN ns > 0 OR nw >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(ns AS INTEGER) AS n_strict, CAST(nw AS INTEGER) AS n_soft
FROM counted LEFT JOIN best USING (r)"""


ORACLE_SQL = _sql()
