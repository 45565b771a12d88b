"""URL filter: host and path rules, then a weighted vocabulary counted by Aho-Corasick.

A term counts where it stands alone: neither neighbour may be an ASCII letter or digit. One
strict term rejects; soft terms reject from ``SOFT_HITS`` distinct ones on. Rules go first.

Nulls and odd input: a null url, or one without ``://``, has an empty host and path and no rule; a null
url has no terms either, so it is allowed. Repeated rows each get their verdict, empty tables give an
empty result, and other columns are ignored.
"""

from __future__ import annotations

import functools
import string

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import map_pieces

# The filter's rules and vocabulary.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
STRICT_TERMS = ("porn", "xxx", "casino", "viagra", "warez", "spam", "malware", "phishing", "escort")
SOFT_TERMS = (
    "adult", "ads", "bet", "bonus", "cheap", "click", "coupon", "dating", "deal", "discount", "farm", "loan",
    "pills", "poker", "promo", "replica", "sex", "slots", "track", "tracker", "winner",
)
SOFT_HITS = 2

_WORD = frozenset(string.ascii_lowercase + string.digits)
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@functools.cache
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term in soft:
        automaton.add_word(term, (term, False))
    for term in strict:
        automaton.add_word(term, (term, True))
    automaton.make_automaton()
    return automaton


def count_terms(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Distinct strict and distinct soft terms that stand alone in ``url``."""
    text = url.translate(_LOWER)
    found: set[tuple[str, bool]] = set()
    for end, hit in _automaton(strict, soft).iter(text):
        begin = end - len(hit[0])
        if (begin < 0 or text[begin] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            found.add(hit)
    n_strict = sum(is_strict for _, is_strict in found)
    return n_strict, len(found) - n_strict


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules) -> Column:
    """Index into ``rules`` of the longest rule that fits, else null."""
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][0] + rules[i][1]))
    fits = [((host == rules[i][0]) | host.endswith("." + rules[i][0])) & path.startswith(rules[i][1]) for i in order]
    return F.coalesce(*[F.when(fit, F.lit(i)) for i, fit in zip(order, fits)])


def judge_urls(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    rules=RULES,
    strict: tuple[str, ...] = STRICT_TERMS,
    soft: tuple[str, ...] = SOFT_TERMS,
    soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_strict, n_soft)."""
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"))

    def count(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = [count_terms(url or "", strict, soft) for url in piece.column(1).to_pylist()]
        counts = [pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*piece.columns, *counts], ["page_id", "url", "n_strict", "n_soft"])

    kind = rows.schema["page_id"].dataType.simpleString()
    counted = map_pieces(rows, count, f"page_id {kind}, url string, n_strict int, n_soft int", "url")
    parts = counted.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = parts.withColumn("at", matching_rule(F.col("host"), F.col("path"), rules))
    names = F.array(*[F.lit(host + path) for host, path, _ in rules])
    actions = F.array(*[F.lit(action) for _, _, action in rules])
    rejected = (F.col("n_strict") > 0) | (F.col("n_soft") >= soft_hits)
    return ruled.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("at").isNotNull(), F.get(names, F.col("at"))).alias("rule"),
        F.coalesce(F.get(actions, F.col("at")), F.when(rejected, "block").otherwise("allow")).alias("verdict"),
        "n_strict",
        "n_soft",
    )
