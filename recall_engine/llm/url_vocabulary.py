"""URL filter by a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in one pass over the lower-cased url. A hit
counts if no ASCII letter or digit touches it on either side. Each distinct term adds its weight once, and a
url whose weight reaches ``LIMIT`` is blocked: one strict term is enough, soft terms must be several.
Explicit host and path rules go before the vocabulary; the longest rule that fits decides.

Null, empty and malformed urls have an empty host and path, fit no rule, and are allowed unless the vocabulary
blocks them. Repeated rows are judged alike, each on its own; an empty table gives an empty one. All other
columns are kept; columns named like those added are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.llm.common import ascii_lower, table
from recall_engine.llm.registry import query

LIMIT = 2
STRICT = ("casino", "porn", "viagra", "xxx")
SOFT = ("adult", "bets", "bonus", "cheap", "free", "jackpot", "loans", "pills", "poker", "slots", "win")
VOCABULARY = tuple((term, LIMIT) for term in STRICT) + tuple((term, 1) for term in SOFT)
#: (verdict, host, path start)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=4)
def _automaton(terms: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for term, weight in terms:
        found.add_word(term, (term, weight))
    if terms:
        found.make_automaton()
    return found if terms else None


def weight_of(url: str | None, terms: tuple[tuple[str, int], ...]) -> int:
    """Sum of the weights of the distinct terms that stand alone in a lower-cased url."""
    automaton, hits = _automaton(terms), {}
    if not url or automaton is None:
        return 0
    for end, (term, weight) in automaton.iter(url):
        start = end - len(term) + 1
        if (start == 0 or url[start - 1] not in ALNUM) and (end + 1 == len(url) or url[end + 1] not in ALNUM):
            hits[term] = weight
    return sum(hits.values())


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return (
        F.coalesce(ascii_lower(F.regexp_extract(url, parts, 1)), F.lit("")),
        F.coalesce(F.regexp_extract(url, parts, 2), F.lit("")),
    )


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits as a struct of rule and verdict, or null. ``rules`` is a short parameter."""
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        F.when(
            ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start)),
            F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, name, start in longest_first
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    vocabulary: tuple[tuple[str, int], ...] = VOCABULARY,
    limit: int = LIMIT,
    url: str = "url",
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``url_weight`` and ``verdict`` (allow or block) to every row."""

    @F.pandas_udf("int")
    def weights(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: weight_of(u, vocabulary)).astype("int32")

    host, path = host_and_path(F.col(url))
    parts = pages.withColumns({"host": host, "path": path, "url_weight": weights(F.lower(url))})
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("url_weight") >= limit, "block").otherwise("allow")
    return parts.withColumns({"rule": fit["rule"], "verdict": F.coalesce(fit["verdict"], own)})


def _sql() -> str:
    def bounded(term: str) -> str:
        return f"CAST(regexp_matches(lower(url), '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS INTEGER)"

    longest_first = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [
        (f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN", h + p, v)
        for v, h, p in longest_first
    ]
    weight = " + ".join(f"{w} * {bounded(t)}" for t, w in VOCABULARY)
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path,
       CASE {' '.join(f"{c} '{r}'" for c, r, _ in fits)} END AS rule,
       CASE {' '.join(f"{c} '{v}'" for c, _, v in fits)}
            ELSE CASE WHEN {weight} >= {LIMIT} THEN 'block' ELSE 'allow' END END AS verdict
FROM parts"""


@query("op5_url_vocabulary", _sql())
def op5_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
