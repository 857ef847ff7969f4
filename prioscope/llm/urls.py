"""URL filter as a sort-merge range join (operator 2).

A host is written backwards with every label closed by a dot (``www.example.com`` becomes
``com.example.www.``) and followed by the path. A rule is then a prefix of such keys, which is
an interval, and rules of one host nest. A url asks with one key for its host and one for each
parent domain. Keys are cut into ranges of about equal size; a rule goes to every range that
its interval meets. In a range, keys and interval starts are swept in order, and a stack holds
the rules whose interval is open. Of the rules a url meets, the longest (host and path
together) wins; of rules equal in length, the one with the longer host; of rules alike, a block.

Defined results: a null url and one without ``://`` have an empty host and path and meet no rule.
A url that meets no rule has a null rule and the default verdict. Repeated rows come back as
often as they came in. Ties of keys are cut by a hash of the row, so a url that a third of all
rows share is swept in several ranges. Every text is compared by its UTF-8 bytes.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
ROWS_PER_RANGE = 5_000
SAMPLE_PER_RANGE = 40
MAX_RANGES = 20_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def canonical_key(labels: Column, path: Column) -> Column:
    """``com.example.`` and the path, as bytes."""
    return F.concat(F.array_join(labels, "."), F.lit("."), path).cast("binary")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _asked(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """One row per page and domain it belongs to."""
    host, path = url_parts(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).cast("string").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = reversed_labels(F.col("host"))
    return base.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(labels)))).withColumn(
        "key", canonical_key(F.slice(labels, 1, F.col("depth")), F.col("path"))
    ).withColumn("tie", F.xxhash64("row", "depth"))


def _cuts(asked: DataFrame, per_range: int) -> list[tuple[bytes, int]]:
    """Range ends from a sample of the keys; they decide where work is done, not what is found."""
    rows = asked.count()
    ranges = min(MAX_RANGES, rows // per_range + 1)
    if ranges == 1:
        return []
    share = min(1.0, ranges * SAMPLE_PER_RANGE / rows)
    sample = sorted((bytes(r.key), r.tie) for r in asked.select("key", "tie").sample(share, 7).toLocalIterator())
    step = max(1, len(sample) // ranges)
    return sample[step::step]


def _after(key: bytes) -> bytes | None:
    """The end of the interval of all keys that start with ``key``; None if it has no end."""
    trimmed = key.rstrip(b"\xff")
    return trimmed[:-1] + bytes([trimmed[-1] + 1]) if trimmed else None


def _sweep(keys: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    """For each asked key the best rule whose interval holds it."""
    wanted = keys.sort_values("key", kind="stable")
    starts = sorted(zip(rules["start"].map(bytes), rules["length"], rules["host_length"], rules["verdict"] == "block", rules["rule"], rules["verdict"]))
    best_rule, best_verdict, best_length, best_host = [], [], [], []
    stack: list[tuple] = []  # (interval start, best rule so far on this stack)
    nr = 0
    for key in wanted["key"].map(bytes):
        while nr < len(starts) and starts[nr][0] <= key:
            rule = starts[nr]
            while stack and not rule[0].startswith(stack[-1][0]):
                stack.pop()
            stack.append((rule[0], max([rule[1:], *(top[1] for top in stack[-1:])])))
            nr += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        length, host_length, _, rule, verdict = stack[-1][1] if stack else (None, None, None, None, None)
        best_rule.append(rule)
        best_verdict.append(verdict)
        best_length.append(length)
        best_host.append(host_length)
    return wanted.assign(rule=best_rule, verdict=best_verdict, length=best_length, host_length=best_host)


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url",
    per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page. ``rules``: host, path, verdict."""
    spark = pages.sparkSession
    asked = _asked(pages, id_col, url_col)
    cuts = spark.sparkContext.broadcast(_cuts(asked, per_range))

    @F.pandas_udf("int")
    def range_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts.value, (bytes(k), t)) for k, t in zip(key, tie)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(start: pd.Series) -> pd.Series:
        ends = []
        for key in start.map(bytes):
            low, end = bisect_right(cuts.value, (key, -(2**63))), _after(key)
            high = len(cuts.value) if end is None else bisect_right(cuts.value, (end, -(2**63)))
            ends.append(list(range(low, high + 1)))
        return pd.Series(ends)

    placed = asked.withColumn("range", range_of("key", "tie"))
    intervals = rules.select(
        F.concat("host", "path").alias("rule"), "verdict", F.octet_length(F.concat("host", "path")).alias("length"),
        F.octet_length("host").alias("host_length"), canonical_key(reversed_labels(F.lower("host")), F.col("path")).alias("start"),
    )
    spread = intervals.withColumn("range", F.explode(ranges_of("start")))

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = _sweep(left, right)[["page_id", "host", "path", "row", "rule", "verdict", "length", "host_length"]]
        return found.astype({c: object for c in ("page_id", "host", "path", "rule", "verdict")})  # one Arrow array per column, whatever came in batches

    kind = dict(pages.dtypes)[id_col]
    found = placed.groupBy("range").cogroup(spread.groupBy("range")).applyInPandas(
        met, "page_id string, host string, path string, row long, rule string, verdict string, length int, host_length int"
    )
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("length", "host_length", (F.col("verdict") == "block").alias("b"), "rule", "verdict")))
    return (
        found.groupBy("row")
        .agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
        .select(F.col("page_id").cast(kind).alias("page_id"), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                     ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


__all__ = ["ORACLE", "RULES", "judge_urls", "rule_table"]
