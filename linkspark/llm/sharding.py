"""Weighted rendezvous sharding with gapless slots.

Every shard draws a number from the hash of (record key, shard); the record goes
to the shard whose draw, scaled by its weight, is the highest. A new shard can
only win records for itself, so growing from n to n + 1 shards moves about
1 / (n + 1) of the records and moves none between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, materialise, numbered, positions

#: Hex digits of the md5 that make a draw: 52 bits, exact in a double.
_DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """Uniform number in (0, 1) that depends on the key and the shard only."""
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**_DIGITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the winning shard: the greatest -weight / ln(draw); ties go to the lower shard. Shards of weight 0 get nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("some shard needs a weight above 0")
    text = F.coalesce(key.cast("string"), F.lit(""))
    runs = [F.struct((-F.lit(float(w)) / F.log(draw(text, i))).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    best = F.greatest(*runs) if len(runs) > 1 else runs[0]
    return (-best["i"]).cast("int")


def shard(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 8, bucket_rows: int = 50_000) -> DataFrame:
    """One row per input row: the key, size, text_crc32, law ('key'), shard, slot and grown_shard.

    size is the UTF-8 length of the text plus 1 (null: 1). text_crc32 is unsigned; a null text counts as empty.
    slot numbers the rows of a shard from 0 without gaps, in an order shuffled by a hash of key and checksum: rows are
    ordered within hash buckets of about bucket_rows rows and buckets are laid out by prefix sums, so no task
    holds a whole shard. grown_shard is the shard after one shard of the mean weight is added.
    Null keys hash as the empty string. Rows that repeat a key share a shard and get slots of their own; rows that also
    agree in size and checksum are interchangeable, so they are counted before the shuffle and numbered from the count.
    No rows give no rows. Columns are taken by position, so others may have any name; a result called like the key gets
    an underscore.
    """
    grown = [*weights, sum(weights) / len(weights)]
    key, text = (F.col(f"k{i}") for i in positions(df, key_col, text_col))
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    hashed = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("/"), crc.cast("string"), F.lit("/slot"))
    # Only a narrow row per kind of record leaves the scan; the text stays behind.
    each = numbered(df).select(
        key.alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        crc.alias("crc"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown"),
        F.conv(F.substring(F.md5(hashed.cast("binary")), 1, 8), 16, 10).cast("long").alias("h"),
    )
    narrow = materialise(each.groupBy(*each.columns).agg(F.count(F.lit(1)).alias("n")), "shards")
    buckets = max(1, -(-narrow.count() // (bucket_rows * len(weights))))
    placed = narrow.withColumn("bucket", (F.col("h") * F.lit(buckets) / F.lit(2.0**32)).cast("long"))
    counts = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("b_n"))
    before = Window.unboundedPreceding, -1
    base = counts.select(
        F.col("shard").alias("b_shard"), F.col("bucket").alias("b_bucket"),
        F.coalesce(F.sum("b_n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(*before)), F.lit(0)).alias("base"),
    )
    local = F.coalesce(F.sum("n").over(Window.partitionBy("shard", "bucket").orderBy("h", "key", "size", "crc").rowsBetween(*before)), F.lit(0))
    out = placed.withColumn("local", local).join(base, (F.col("shard") == F.col("b_shard")) & (F.col("bucket") == F.col("b_bucket")))
    # Rows that agree in all: numbered in runs, so that no array grows with their number.
    run = 100_000
    out = out.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / run))))
    out = out.withColumn("copy", F.explode(F.sequence(F.col("run") * run, F.least((F.col("run") + 1) * run, F.col("n")) - 1)))
    return keyed(out, key_col, {
        "size": F.col("size"), "text_crc32": F.col("crc"), "law": F.lit("key"), "shard": F.col("shard"),
        "slot": (F.col("base") + F.col("local") + F.col("copy")).cast("long"), "grown_shard": F.col("grown"),
    }, F.col("key"))


#: DuckDB has no crc32 of its own: bytes are folded through the table of the reflected polynomial, made by rule.
CRC_SQL = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::UBIGINT] || [x::UBIGINT for x in range(8)],
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v
    FROM range(256) r(i)))
"""


def oracle_sql(shards: int = 8) -> str:
    def score(i: int) -> str:
        return f"-1.0 / ln((('0x' || substr(md5(k || '/{i}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {16**_DIGITS}.0)"

    def pick(n: int) -> str:
        return f"list_position(s[1:{n}], list_max(s[1:{n}])) - 1"

    return f"""
WITH {CRC_SQL.strip()},
d AS (SELECT doc_id, coalesce(text, '') AS tx, octet_length(encode(coalesce(text, ''))) AS n, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
h AS (SELECT doc_id, n + 1 AS size, tx, k, [{', '.join(score(i) for i in range(shards + 1))}] AS s FROM d),
b AS (SELECT tx, hex(encode(tx)) AS x FROM (SELECT DISTINCT tx FROM h)),
c AS (SELECT tx, xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] ||
        [('0x' || substr(x, 2 * i + 1, 2))::UBIGINT for i in range(length(x) // 2)],
        lambda a, y: xor(a >> 8, t[((xor(a, y) & 255) + 1)::BIGINT]))) AS crc FROM b, crc_table)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, ({pick(shards)})::INTEGER AS shard,
  (row_number() OVER (PARTITION BY {pick(shards)} ORDER BY ('0x' || substr(md5(k || '/' || crc::BIGINT || '/slot'), 1, 8))::BIGINT, doc_id NULLS FIRST, size, crc) - 1)::BIGINT AS slot,
  ({pick(shards + 1)})::INTEGER AS grown_shard
FROM h JOIN c USING (tx)
"""
