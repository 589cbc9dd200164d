"""URL verdicts: longest host and path rule, else a list of canonical URLs behind a blocked Bloom filter.

A listed entry is a canonical URL, or a bare host, which covers its pages and subdomains.  So a page is
looked up by its own canonical URL, by that without the query, and by its host and parent domains.  A
hash picks one block of 256 bits and one bit in each of its eight words.  The filter is sized to the
list and built by an aggregation per block; what it lets through goes to an exact hash join with the
list, which removes all false positives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import spread, write_table

#: Listed URLs for each block of 256 bits; blocks of 32 bytes that are broadcast at most (64 MB, enough for 33 million
#: URLs; a longer list lets more pages through to the join, with the same verdicts).
PER_BLOCK, MOST_BLOCKS = 16, 1 << 21
_SALTS = [0x9E3779B1 * (2 * i + 1) % (1 << 31) | 1 for i in range(8)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without a last slash, query without utm_* and ref; no scheme, no fragment.  Empty without ``://``."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)(utm_[^=&]*|ref)=[^&]*", ""), "^&", "")
    address = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/$", ""))
    return F.concat(address, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def expressions(url: Column) -> Column:
    """What a page may be listed as: its canonical URL, that without a query, its host and the domains above it."""
    host = _bare(host_of(url))
    labels = F.split(host, "[.]")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    whole = F.concat(F.array(canonical(url), F.concat(host, F.regexp_replace(path_of(url), "/$", ""))), domains)
    return F.filter(F.array_distinct(whole), lambda x: x != "")


def _bits(h: Column) -> list[Column]:
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in _SALTS]


class BlockedBloom:
    """Blocks by number; ``maybe`` takes 64-bit hashes."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64).view(np.uint64)
        block = ((h >> np.uint64(32)) & np.uint64(len(self.words) - 1)).astype(np.int64)
        low, hit = h & np.uint64(0xFFFFFFFF), np.ones(len(h), dtype=bool)
        for i, s in enumerate(_SALTS):
            bit = (low * np.uint64(s) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
            hit &= (self.words[block, i] >> bit & np.uint64(1)).astype(bool)
        return hit


def build_filter(hashes: DataFrame, most_blocks: int = MOST_BLOCKS) -> BlockedBloom:
    """The filter of a column ``h``: one row per block that is used, ``most_blocks`` at most, comes to the driver."""
    n = min(most_blocks, max(64, 1 << max(0, hashes.count() // PER_BLOCK).bit_length()))
    block = F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(n - 1))
    parts = hashes.select(block.alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("h")))))
    rows = parts.groupBy("block").agg(*(F.expr(f"bit_or(shiftleft(1L, b{i}))").alias(f"w{i}") for i in range(8))).toArrow()
    words = np.zeros((n, 8), dtype=np.uint32)
    words[rows.column(0).to_numpy()] = np.stack([c.to_numpy() for c in rows.columns[1:]], axis=1).astype(np.uint32)
    return BlockedBloom(words)


def looked_up(pages: DataFrame, urls: DataFrame, id_col: str, url_col: str, rules: tuple[Rule, ...], most_blocks: int) -> DataFrame:
    """(row, id, host, path, rule, ruled, possible): each page with the expressions that pass the filter, written once.

    Only pages without a rule are looked up; ``row`` numbers the rows.
    """
    session = pages.sparkSession
    bloom = session.sparkContext.broadcast(build_filter(urls.select(F.xxhash64("canonical").alias("h")), most_blocks))

    @F.pandas_udf("array<int>")
    def passing(hashes: pd.Series) -> pd.Series:
        size = hashes.map(len).to_numpy()
        flat = np.concatenate([np.zeros(0, dtype=np.int64), *hashes])
        return pd.Series([np.nonzero(x)[0] for x in np.split(bloom.value.maybe(flat), np.cumsum(size)[:-1])] if len(size) else [])

    host, path = F.col("host"), F.col("path")
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in rules]
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i].name))
    first = lambda what: F.coalesce(*(F.when(fits[i], F.lit(what(rules[i]))) for i in order), F.lit(None).cast("string"))
    base = pages.select(F.col(id_col), F.col(url_col).alias("_url")).select(id_col, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), "_url")
    base = base.withColumns({"rule": first(lambda r: r.name), "ruled": first(lambda r: r.verdict)})
    base = base.withColumn("said", F.when(F.col("ruled").isNull(), expressions(F.col("_url"))).otherwise(F.expr("cast(array() as array<string>)")))
    base = base.withColumn("pass", passing(F.transform("said", lambda x: F.xxhash64(x))))
    possible = F.transform("pass", lambda i: F.element_at("said", i + 1))
    return write_table(base.select(F.monotonically_increasing_id().alias("row"), id_col, "host", "path", "rule", "ruled", possible.alias("possible")), "pages")


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row; ``listed`` has canonical URLs and hosts in its column ``canonical``.

    The longest rule (host and path together; ties go to the one listed first) that fits the host or
    a parent domain and starts the path wins; without one, a page is blocked if one of its
    ``expressions`` is listed, the smallest of which is told.  A null URL, or one without ``://``, has an
    empty host and path and is not listed.  Repeated rows are judged each, repeated list entries count
    once; an empty list blocks nothing.  Other columns are left.
    """
    urls = listed.select("canonical").where("canonical <> ''").distinct()
    base = looked_up(pages, urls, id_col, url_col, rules, most_blocks)
    possible = base.where(F.size("possible") > 0).select("row", F.explode("possible").alias("canonical"))
    hits = possible.join(urls, "canonical").groupBy("row").agg(F.min("canonical").alias("listed"))
    verdict = F.coalesce("ruled", F.when(F.col("listed").isNotNull(), "block").otherwise("allow"))
    return base.join(hits, "row", "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"), "listed")


def filter_report(pages: DataFrame, listed: DataFrame, url_col: str = "url", most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(expressions, passed, listed): expressions of all pages, those that the filter lets through, and those that are listed."""
    urls = listed.select("canonical").where("canonical <> ''").distinct()
    base = looked_up(pages.withColumn("_page", F.lit(0)), urls, "_page", url_col, (), most_blocks)
    passed = base.select(F.explode("possible").alias("canonical")).join(urls.withColumn("found", F.lit(1)), "canonical", "left")
    asked = pages.agg(F.coalesce(F.sum(F.size(expressions(F.col(url_col)))), F.lit(0)).alias("expressions"))
    return asked.join(passed.agg(F.count(F.lit(1)).alias("passed"), F.count("found").alias("listed")))


#: Words of the query's list.  Hosts of the first are listed whole; of the last, pages are.
LISTED_HOSTS, LISTED_PAGES = ("cheap-pills", "free-bets", "spam-farm", "casino-win", "adult-x"), "ads-track"
_ENDS, _HEADS, _LANGS, _NUMBERS = ("com", "net", "org"), ("", "blog.", "m."), ("en", "fr", "de", "es"), 8192


def listing(spark: SparkSession) -> DataFrame:
    """The list that the query filters by: 15 hosts, and 294,912 numbered pages of another, whether they are in ``pages`` or not."""
    pick = lambda xs, i: F.element_at(F.array(*(F.lit(x) for x in xs)), (i % len(xs) + 1).cast("int"))
    hosts = spark.range(len(LISTED_HOSTS) * len(_ENDS)).select(F.concat(pick(LISTED_HOSTS, F.floor(F.col("id") / len(_ENDS))), F.lit(".example."), pick(_ENDS, F.col("id"))).alias("canonical"))
    i, each = F.col("id"), len(_ENDS) * len(_HEADS) * len(_LANGS)
    place = F.concat(pick(_HEADS, F.floor(i / len(_ENDS))), F.lit(f"{LISTED_PAGES}.example."), pick(_ENDS, i), F.lit("/"), pick(_LANGS, F.floor(i / (len(_ENDS) * len(_HEADS)))), F.lit("/"), F.floor(i / each).cast("string"))
    return hosts.unionByName(spark.range(0, each * _NUMBERS, 1, spread(spark)).select(place.alias("canonical")))


def _values(words: tuple[str, ...]) -> str:
    return ", ".join(f"('{w}')" for w in words)


ORACLE = f"""
WITH split AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1), ''), '(^|&)(utm_[^=&]*|ref)=[^&]*', '', 'g'), '^&', '') AS query
  FROM pages
), bare AS (
  SELECT *, regexp_replace(host, '^www\\.', '') AS h, regexp_replace(path, '/$', '') AS p FROM split
), said AS (
  SELECT DISTINCT url, unnest(list_concat([h || p || CASE WHEN query = '' THEN '' ELSE '?' || query END, h || p],
    list_transform(range(1, greatest(len(string_split(h, '.')), 2)), lambda i: array_to_string(string_split(h, '.')[i:], '.')))) AS canonical FROM bare
), listed AS (
  SELECT w || '.example.' || e AS canonical FROM (VALUES {_values(LISTED_HOSTS)}) a(w), (VALUES {_values(_ENDS)}) b(e)
  UNION ALL SELECT x || '{LISTED_PAGES}.example.' || e || '/' || l || '/' || n FROM (VALUES {_values(_HEADS)}) a(x), (VALUES {_values(_ENDS)}) b(e), (VALUES {_values(_LANGS)}) c(l), range({_NUMBERS}) d(n)
), hits AS (SELECT url, min(canonical) AS entry FROM said JOIN listed USING (canonical) WHERE canonical <> '' GROUP BY url
), rules(verdict, rhost, rpath) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}
), ruled AS (
  SELECT n.page_id, n.url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM bare) n JOIN rules r
    ON (n.host = rhost OR ends_with(n.host, '.' || rhost)) AND starts_with(n.path, rpath)
  GROUP BY ALL
)
SELECT n.page_id, n.host, n.path, r.rule, coalesce(r.verdict, CASE WHEN entry IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN r.verdict IS NULL THEN entry END AS listed
FROM bare n LEFT JOIN ruled r ON n.page_id = r.page_id AND n.url = r.url LEFT JOIN hits ON hits.url = n.url
"""
