"""Keys, splits, ranks and joins that the other operators are made of. Every rank has an explicit tie-break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

PACK = 1 << 24


def bucket(key: Column, n: int, salt: str = "") -> Column:
    """Deterministic bucket 0..n-1 that other engines can compute: the first eight hex digits of an md5, modulo n. A null key counts as the empty text."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def crc_fold(key: Column, n: int, prefix: str = "") -> Column:
    """Fold 0..n-1 by crc32 of prefix and key; a null key counts as the empty text."""
    return (F.crc32(F.concat(F.lit(prefix), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")) % n).cast("int")


def splits(key: Column, val_share: float = 0.1, locked_share: float = 0.25, salt: str = "7") -> dict[str, Column]:
    """split (locked, val or sample), fold (0, 1) and es (early-stopping rows), all from one hash: parity against magnitude keeps es even over folds."""
    h = bucket(key, 1000, salt)
    locked, val = int(1000 * val_share * locked_share), int(1000 * val_share)
    return {"split": F.when(h < locked, "locked").when(h < val, "val").otherwise("sample"), "fold": (h % 2).cast("int"), "es": h < 150}


def large(df: DataFrame) -> DataFrame:
    """A side of a join with a row per record, which is never sent whole to the driver: files are compressed, and exploded rows, maps and lists are far larger than Spark's planner takes them for."""
    return df.hint("merge")


def pack(a: Column, b: Column) -> Column:
    """One long of two ids; b must be from 0 and below 2^24, a below 2^39: others are an error."""
    fits = (b >= 0) & (b < PACK) & (a >= 0) & (a < 1 << 39)
    return F.when(fits | a.isNull() | b.isNull(), a.cast("long") * PACK + b.cast("long")).otherwise(F.raise_error(F.lit("an id is too large to be packed")).cast("long"))


def unpack(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 24), key % PACK


def sample_rank(df: DataFrame, by: Sequence[str], key: str, salt: str = "sample", rank: str = "sample_rank") -> DataFrame:
    """Rows of each group numbered from 1 in an order shuffled by a hash of their key: the first n are a stable sample of the group."""
    shuffled = F.md5(F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(shuffled, key)))


def rows_between(df: DataFrame, order: Sequence[Column], start: int, n: int) -> DataFrame:
    """n rows from the start-th on (from 0) in an order that should be total. Each task keeps its first start + n rows only."""
    return df.orderBy(*order).offset(start).limit(n) if start else df.orderBy(*order).limit(n)


def row_index(df: DataFrame, key: str, name: str = "row") -> DataFrame:
    """Rows numbered from 0 in the order of a unique key of any type: the table is cut into ranges of the key, ranges are counted, and each is numbered by one task from where the one before ends."""
    cut = stage(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row per range
    local = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return cut.withColumn("_l", local).join(F.broadcast(base), "_p").withColumn(name, (F.col("_b") + F.col("_l")).cast("long")).drop("_p", "_l", "_b")


def side_by_side(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """The columns of both tables in one row per key, never by position. Keys must be the same on both sides, each once: else an error names how many are not."""
    on = list(on)
    a, b = left.withColumn("_a", F.lit(1)), right.withColumn("_b", F.lit(1))
    both = a.join(b, on, "full")
    w = F.count(F.lit(1)).over(Window.partitionBy(*on))
    odd = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_n") > 1)
    checked = both.withColumn("_n", w).withColumn("_ok", F.when(odd, F.raise_error(F.lit("a key is missing on one side or stands twice")).cast("boolean")).otherwise(F.lit(True)))
    return checked.filter("_ok").drop("_a", "_b", "_n", "_ok")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1. Spark prunes to k rows per task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def best(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, by, order, 1, "_rank").drop("_rank")


def with_max_other(df: DataFrame, by: str, value: str, tie: str, name: str, missing: float) -> DataFrame:
    """The greatest value among the other rows of the group (`missing` if there is none), and whether the row is the greatest (ties by `tie`)."""
    order = Window.partitionBy(by).orderBy(F.desc(value), F.asc(tie))
    all_rows = Window.partitionBy(by)
    df = df.withColumn("_rk", F.row_number().over(order))
    first, second = (F.max(F.when(F.col("_rk") == k, F.col(value))).over(all_rows) for k in (1, 2))
    return df.withColumn(name, F.coalesce(F.when(F.col("_rk") == 1, second).otherwise(first), F.lit(missing))).withColumn("is_argmax", F.col("_rk") == 1).drop("_rk")


def count_greater(left: DataFrame, right: DataFrame, by: str, left_value: str, right_value: str, name: str) -> DataFrame:
    """For each left row, how many right rows of its group have a greater value.

    One sorted pass over the union of both sides: no pair of rows is ever formed.
    """
    mark = F.lit
    both = left.withColumns({"_v": F.col(left_value), "_n": mark(0), "_left": mark(True)}).unionByName(
        right.select(F.col(by), F.col(right_value).alias("_v"), mark(1).alias("_n"), mark(False).alias("_left")), allowMissingColumns=True
    )
    ahead = Window.partitionBy(by).orderBy(F.desc("_v")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(by, "_v")
    return both.withColumn(name, (F.sum("_n").over(ahead) - F.sum("_n").over(same)).cast("long")).filter("_left").drop("_v", "_n", "_left")


def offset_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_value: str, right_value: str, offsets: Sequence[int], name: str = "k") -> DataFrame:
    """Rows whose right value is the left value plus one of the offsets: a range join as an equi-join on exploded offsets."""
    moved = left.withColumn(name, F.explode(F.array(*[F.lit(int(k)) for k in offsets]))).withColumn("_at", F.col(left_value) + F.col(name))
    to = right.withColumnRenamed(right_value, "_at")
    return moved.join(large(to), [*on, "_at"]).withColumnRenamed("_at", right_value)


def running(counts: DataFrame, value: str, sums: Sequence[str], buckets: int = 256) -> DataFrame:
    """counts with, for each column of `sums`, `<column>_before`: its sum over the rows of smaller value. Values are distinct.

    The rows are cut into about equal ranges of value at approximate quantiles; ranges are summed first, and each is then
    run through by one task, so no task holds the whole order. Only the cuts reach the driver.
    """
    cuts = counts.agg(F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(1000)).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(value))) if cuts else F.lit(0)
    cut = counts.withColumn("_b", at)
    per = cut.groupBy("_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = (Window.unboundedPreceding, -1)
    base = per.select(F.col("_b"), *[F.coalesce(F.sum(f"_t_{s}").over(Window.orderBy("_b").rowsBetween(*before)), F.lit(0)).alias(f"_s_{s}") for s in sums])  # a row per range
    inside = Window.partitionBy("_b").orderBy(value).rowsBetween(*before)
    out = cut.withColumns({f"_l_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}).join(F.broadcast(base), "_b")
    return out.withColumns({f"{s}_before": F.col(f"_l_{s}") + F.col(f"_s_{s}") for s in sums}).drop("_b", *[f"_{k}_{s}" for s in sums for k in "ls"])


def exact_quantiles(df: DataFrame, value: str, at: Sequence[float]) -> list[float]:
    """Quantiles with linear interpolation, from counts of distinct values and their running sums: no buffer holds the values. Nulls and NaN are left out; no rows give []."""
    x = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    n = x.agg(F.sum("n").alias("n")).first()["n"] or 0
    if not n:
        return []
    ranks = sorted({int(r) for q in at for r in (q * (n - 1), min(n - 1, int(q * (n - 1)) + 1))})
    wanted = F.exists(F.array(*[F.lit(r).cast("long") for r in ranks]), lambda r: (r >= F.col("n_before")) & (r < F.col("n_before") + F.col("n")))
    rows = running(x, "v", ["n"]).filter(wanted).collect()  # a value per rank asked for
    value_of = {r: next(x["v"] for x in rows if x["n_before"] <= r < x["n_before"] + x["n"]) for r in ranks}
    out = []
    for q in at:
        lo = int(q * (n - 1))
        a, b = value_of[lo], value_of[min(n - 1, lo + 1)]
        out.append(a + (b - a) * (q * (n - 1) - lo))
    return out


def multiset_lost(df: DataFrame, id_col: str, a: str, b: str, name: str = "lost") -> DataFrame:
    """Per row id how many elements array a has beyond those of b, each as often as it stands there: counted by element, so long arrays are never compared pair by pair."""
    side = lambda c, n: df.select(id_col, F.explode(c).alias("x"), F.lit(n).alias("n"))
    left = side(a, 1).union(side(b, -1)).groupBy(id_col, "x").agg(F.sum("n").alias("n")).groupBy(id_col).agg(F.sum(F.greatest("n", F.lit(0))).cast("long").alias(name))
    return df.join(left, id_col, "left").fillna(0, [name])


def finite(c: Column, missing: float = -1.0, limit: float = 1e6) -> Column:
    """NaN and null as `missing`, infinities clipped."""
    return F.when(c.isNull() | F.isnan(c), F.lit(missing)).otherwise(F.least(F.greatest(c, F.lit(-limit)), F.lit(limit)))


def set_algebra(base: DataFrame, additions: DataFrame, mask: DataFrame, on: Sequence[str]) -> DataFrame:
    """base and additions, once each, without the masked keys."""
    on = list(on)
    return base.select(on).union(additions.select(on)).distinct().join(mask.select(on).distinct(), on, "left_anti")


def selection_faults(base: DataFrame, additions: DataFrame, mask: DataFrame, on: Sequence[str]) -> DataFrame:
    """Counts that must be 0 before selections are combined: repeated keys, additions that the base has, masked keys that neither has, additions that are masked."""
    on = list(on)
    twice = lambda df: df.groupBy(*on).count().filter("count > 1")
    found = {
        "repeated_base": twice(base), "repeated_additions": twice(additions), "repeated_mask": twice(mask), "additions_in_base": additions.select(on).distinct().join(base.select(on), on, "left_semi"),
        "mask_unknown": mask.select(on).distinct().join(base.select(on).union(additions.select(on)), on, "left_anti"), "additions_masked": additions.select(on).distinct().join(mask.select(on), on, "left_semi"),
    }
    out = None
    for name, df in found.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fault"), "n")
        out = one if out is None else out.union(one)
    return out


def changes(before: DataFrame, after: DataFrame, on: Sequence[str]) -> DataFrame:
    """Symmetric difference with its side: '-' rows that went, '+' rows that came."""
    on = list(on)
    return before.join(after, on, "left_anti").select(*on, F.lit("-").alias("side")).union(after.join(before, on, "left_anti").select(*on, F.lit("+").alias("side")))


def digest(df: DataFrame) -> DataFrame:
    """Row count and one SHA-256 of a whole table as a multiset of rows: the md5 of every row goes, in two halves, into the sums of one of 256 buckets, and their list in order is hashed."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    h = F.md5(text.cast("binary"))
    part = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("decimal(38,0)")
    each = df.select(F.substring(h, 1, 2).alias("b"), part(3, 15).alias("x"), part(18, 15).alias("y"))
    sums = each.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    lines = sums.agg(F.sum("n").alias("n_rows"), F.array_sort(F.collect_list(F.concat_ws(":", "b", F.col("n").cast("string"), F.col("x").cast("string"), F.col("y").cast("string")))).alias("l"))
    return lines.select(F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.sha2(F.array_join("l", ",").cast("binary"), 256).alias("digest"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free checksum of a whole table."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    return df.select(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("h").cast("string").alias("checksum"))
