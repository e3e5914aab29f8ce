"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of each source are put in a seeded random order; row r of a source of n rows gets
the fractional rank (r + u) / n, where u in [0, 1) is a fixed jitter of the source, so that
sources of a few rows don't pile up at one point. All rows, sorted by fractional rank, are
cut into equal runs: every shard then holds each source in the proportion of the whole,
to within about a row, and shard sizes differ by at most one row (law ``rows``).

A source that holds a third of all rows is ranked in many tasks: ranks come from bucket
offsets (see ``positions``). Texts are read once, for size and checksum, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import buckets_for, hex_fraction_bucket, shuffle_key, with_positions
from .staging import staged


def stratified_shards(docs: DataFrame, shards: int = 24, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Null text counts as empty: size 8, checksum 0. Null source is a stratum of its own.
    Null ids sort first; rows equal in id, text and source are interchangeable and each
    gets its own slot. An empty table gives no rows; further columns are ignored. Equal
    texts aren't kept together: this law balances rows and mixture only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col))).alias("stratum"),
            shuffle_key(seed, F.col(id_col), text).alias("shuffle_key"),
        ),
        "shards",
    )
    rows = slim.count()
    buckets = buckets_for(rows)
    ranked = with_positions(
        slim.withColumn("bucket", hex_fraction_bucket(F.col("shuffle_key"), buckets)),
        ["stratum"], "bucket", ["shuffle_key", "doc_id", "text_crc32", "size"],
    )
    jitter = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("stratum")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    spread = ranked.withColumn("rank", (F.col("before") + jitter) / F.col("in_all")).withColumn(
        "slice", F.least(F.floor(F.col("rank") * buckets), F.lit(buckets - 1)).cast("long")
    )
    placed = with_positions(
        spread.drop("bucket", "before", "in_all"), [], "slice", ["rank", "stratum", "shuffle_key", "doc_id", "text_crc32", "size"]
    )
    shard = F.expr(f"(before * {shards}) div {max(rows, 1)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("before") - F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def mixture_report(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows by shard and source, for a look at how even the mixture is."""
    return placed.join(docs.select("doc_id", "source"), "doc_id").groupBy("shard", "source").count()


ORACLE = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
slim AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, coalesce(text, '') AS body,
         CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum,
         md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS shuffle_key
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY shuffle_key, doc_id) - 1 AS r,
         count(*) OVER (PARTITION BY stratum) AS n,
         ('0x' || substr(md5('7:' || stratum), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM slim
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (r + u) / n, stratum, shuffle_key, doc_id) - 1 AS pos, count(*) OVER () AS total
  FROM ranked
)
SELECT doc_id, size,
       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT)),
                       lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)::BIGINT AS text_crc32,
       'rows' AS law, (pos * 24 // total)::INTEGER AS shard,
       (pos - ((pos * 24 // total) * total + 23) // 24)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM placed, crc_table
"""
