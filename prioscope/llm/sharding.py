"""Sharding by extendible hashing (operator 7); DataFrame functions only.

A row's place is a string of 64 bits: 32 of the hash of its key, then 32 of the hash of its
place in the table, which splits rows that share a key. The directory starts with one bucket.
Sizes are summed per bucket, and only buckets over the byte limit are looked at with one more
bit, until every shard fits. Sizes of several bits are summed in one pass over the narrow
table of keys; the splitting itself goes bit by bit over those sums.

Defined results: a null text has no bytes, a null key is a key like any other, an empty table
has no shards. A shard that cannot be split (one row over the limit) is marked ``oversized``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from prioscope.llm.common import free_name, kept, text_of

KEY_BITS, ROW_BITS, STRIDE = 32, 32, 8
BITS = KEY_BITS + ROW_BITS


def _bits(c: Column) -> Column:
    """The first 32 bits of an MD5 as text of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 2), 32, "0")


def places(docs: DataFrame, key_col: str = "doc_id", row_col: str | None = None) -> DataFrame:
    """(key, row, bits, n_bytes) per row, stored, so that the row numbers are fixed."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    narrow = docs.select(F.col(key_col).alias("key"), F.octet_length(text_of()).cast("long").alias("n_bytes"), row.alias("row"))
    return kept(
        narrow.select("key", "row", "n_bytes", F.concat(_bits(F.coalesce(F.col("key").cast("string"), F.lit("null"))), _bits(F.col("row"))).alias("bits")),
        "places",
    )


def _split_once(rows: DataFrame, start: int, limit: int) -> DataFrame:
    """Directory of cells of ``start + STRIDE`` bits: the bits their shard has, or null where it is still too large."""
    end = start + STRIDE
    cells = rows.groupBy(F.substring("bits", 1, end).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"))
    found = cells
    for depth in range(start, end + 1):
        sums = cells.groupBy(F.substring("cell", 1, depth).alias("p")).agg(F.sum("n_bytes").alias(f"b{depth}"), F.sum("n").alias(f"n{depth}"))
        found = found.withColumn("p", F.substring("cell", 1, depth)).join(sums, "p").drop("p")
    fits = [F.when((F.col(f"b{d}") <= limit) | (F.col(f"n{d}") == 1), F.lit(d)) for d in range(start, end + 1)]
    last = F.lit(end) if end >= BITS else F.lit(None).cast("int")
    depth = F.coalesce(*fits, last)
    size = F.coalesce(*[F.when(depth == d, F.col(f"b{d}")) for d in range(start, end + 1)])
    count = F.coalesce(*[F.when(depth == d, F.col(f"n{d}")) for d in range(start, end + 1)])
    return kept(
        found.select(
            "cell", depth.alias("depth"), F.substring(F.col("cell"), F.lit(1), depth).alias("shard"), size.alias("shard_bytes"), count.alias("shard_rows")
        ),
        "directory",
    )


def assign(docs: DataFrame, limit: int, key_col: str = "doc_id", row_col: str | None = None) -> DataFrame:
    """One row per document: its shard (bits), the shard's depth, bytes and rows.

    ``row_col`` is a column that numbers the rows; without it they are numbered as they are read.

    Every round joins the rows that are left to a directory of their next eight bits. The first
    one has at most 256 rows and is broadcast; later ones are as many as there are large buckets.
    """
    left, done, start = places(docs, key_col, row_col), [], 0
    while True:
        directory = _split_once(left, start, limit)
        side = F.broadcast(directory) if start == 0 else directory
        placed = left.withColumn("cell", F.substring("bits", 1, start + STRIDE)).join(side, "cell").drop("cell")
        done.append(placed.where("depth IS NOT NULL").drop("cell"))
        start += STRIDE
        if start >= BITS or directory.where("depth IS NULL").isEmpty():
            break
        left = kept(placed.where("depth IS NULL").select("key", "row", "n_bytes", "bits"), "oversized")
    return reduce(DataFrame.unionByName, done).select(
        F.col("key").alias(key_col), "row", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversized")
    )


def write_shards(docs: DataFrame, limit: int, path: str, key_col: str = "doc_id") -> DataFrame:
    """Write each shard to its own folder ``shard=<bits>`` below ``path``; returns the assignment.

    A shard fits its byte limit, so one task can write it: rows are sent by shard. The numbered rows are
    stored first, since a shuffled input could come in another order when it is read again.
    """
    name, row = free_name(docs, "shard"), free_name(docs, "_row")
    numbered = kept(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    table = kept(assign(numbered, limit, key_col, row), "assignment")
    placed = numbered.join(
        table.select(F.col("row").alias(row), F.concat(F.lit("b"), "shard").alias(name)), row
    )
    placed.drop(row).repartition(F.col(name)).write.partitionBy(name).parquet(path)
    return table


def oracle(limit: int, depths: int = KEY_BITS) -> str:
    """DuckDB SQL for ``assign``: the shortest prefix whose bytes fit. Rows with a hash of their own end within the key's bits."""
    hashed = "lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::UBIGINT), 32, '0')"
    return f"""
WITH p AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes, {hashed} AS bits FROM documents),
s AS (SELECT doc_id, n_bytes, d.depth, substr(bits, 1, d.depth) AS shard, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows
      FROM p, range(0, {depths + 1}) AS d(depth) WINDOW w AS (PARTITION BY d.depth, substr(bits, 1, d.depth))),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS nr FROM s WHERE shard_bytes <= {limit} OR shard_rows = 1)
SELECT doc_id, n_bytes, shard, depth::INTEGER AS depth, shard_bytes::BIGINT AS shard_bytes, shard_rows, shard_bytes > {limit} AS oversized FROM f WHERE nr = 1
"""
