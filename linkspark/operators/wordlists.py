"""Word lists learned from pairs by counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batch


def insertions(pairs: DataFrame, a: str = "words_a", b: str = "words_b") -> DataFrame:
    """Per word: pairs whose record adds it (n_added), drops it (n_dropped), has it on both sides (n_both)."""
    tag = lambda c, kind: F.transform(c, lambda w: F.struct(w.alias("word"), F.lit(kind).alias("kind")))
    each = F.concat(tag(F.array_except(b, a), "added"), tag(F.array_except(a, b), "dropped"), tag(F.array_intersect(a, b), "both"))
    e = pairs.select(F.explode(each).alias("e")).select("e.word", "e.kind")
    return e.groupBy("word").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("added", "dropped", "both")])


def select_words(counts: DataFrame, least: int, rate: float) -> DataFrame:
    """Words added at least `least` times, in at least `rate` of the pairs that show them."""
    n = F.col("n_added") + F.col("n_dropped") + F.col("n_both")
    return counts.filter((F.col("n_added") >= least) & (F.col("n_added") >= rate * n))


def is_subsequence(short: Column, long: Column) -> Column:
    """All letters of short stand in long in order, the first letter first."""
    pattern = F.concat(F.lit("^"), F.array_join(F.split(short, ""), ".*"))
    return F.regexp_like(long, pattern) & (F.length(short) < F.length(long)) & (F.length(short) > 0)


def abbreviations(pairs: DataFrame, a: str = "words_a", b: str = "words_b", least: int = 2, share: float = 0.5) -> DataFrame:
    """Short forms: word lists of equal length that differ in one place, where one word's letters run through the other's; kept if it is the dominant reading."""
    diff = F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda z: z["x"] != z["y"])
    one = pairs.filter(F.size(a) == F.size(b)).withColumn("d", diff).filter(F.size("d") == 1).select(F.col("d")[0]["x"].alias("x"), F.col("d")[0]["y"].alias("y"))
    both = one.select(F.when(F.length("x") < F.length("y"), F.col("x")).otherwise(F.col("y")).alias("short"), F.when(F.length("x") < F.length("y"), F.col("y")).otherwise(F.col("x")).alias("long"))
    n = both.filter(F.col("short").rlike("^[a-z]+$") & is_subsequence(F.col("short"), F.col("long"))).groupBy("short", "long").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("short")
    ranked = n.withColumns({"_t": F.sum("n").over(w), "_r": F.row_number().over(w.orderBy(F.desc("n"), "long"))})
    return ranked.filter((F.col("_r") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("_t"))).select("short", "long", "n")


def unique_key_pairs(anchors: DataFrame, records: DataFrame, key: list[str]) -> DataFrame:
    """Pairs that share a key which one anchor only has."""
    lone = anchors.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("s1").alias("s1")).filter("_n = 1").drop("_n")
    return lone.join(records.select(*key, "cand"), key)


def anchor_pairs(anchors: DataFrame, records: DataFrame, key: list[str], name: str = "name_n", least: float = 95.0) -> DataFrame:
    """Pairs that share a key which one anchor only has, and whose names are alike as sets of words: sure pairs to learn from."""
    lone = unique_key_pairs(anchors, records, key).select("s1", "cand")
    side = lambda df, i, t: df.select(i, batch.token_views(F.col(name))[1].alias(t))
    x = lone.join(side(anchors, "s1", "a"), "s1").join(side(records, "cand", "b"), "cand")
    shared, only_a, only_b = batch.set_parts(F.col("a"), F.col("b"))
    x = x.select("s1", "cand", shared.alias("shared"), only_a.alias("only_a"), only_b.alias("only_b"), ((F.size("a") == 0) | (F.size("b") == 0)).alias("none"))
    rest = batch.column("ratio")(F.col("only_a"), F.col("only_b"))
    alike = batch.token_set(F.col("shared"), F.col("only_a"), F.col("only_b"), F.col("rest"), F.col("none"))
    return x.withColumn("rest", rest).withColumn("alike", F.round(alike, 6)).filter(F.col("alike") >= least).select("s1", "cand", "alike")


def area_aliases(addresses: DataFrame, codes: dict[str, str], places: DataFrame, least: int = 20, pure: float = 0.9, share: float = 0.5, beside: float = 0.2) -> DataFrame:
    """Components that stand where an area's name would: they come with places of one area, and seldom beside a known name.

    addresses: (id, parts: the components); codes: known names and their area; places: (place, area), places that belong
    to one area (see purity). Kept: (alias, area, n) with at least `least` addresses that name the area's places, `pure`
    of those with a place, `share` of all, and less than `beside` with a known name.
    """
    known = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    each = addresses.select("id", F.exists("parts", lambda c: F.element_at(known, c).isNotNull()).alias("named"), F.explode(F.array_distinct("parts")).alias("part"))
    voted = each.join(places, F.col("part") == F.col("place")).groupBy("id").agg(F.min("area").alias("area"), F.countDistinct("area").alias("areas")).filter("areas = 1").select("id", "area")
    other = each.filter(F.element_at(known, F.col("part")).isNull()).join(places.select(F.col("place").alias("part")).distinct(), "part", "left_anti")
    total = other.groupBy("part").agg(F.count(F.lit(1)).alias("n_all"), F.avg(F.col("named").cast("int")).alias("beside"))
    votes = other.join(voted, "id").groupBy("part", "area").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("part")
    best = votes.withColumns({"_t": F.sum("n").over(w), "_r": F.row_number().over(w.orderBy(F.desc("n"), "area"))}).filter("_r = 1").join(total, "part")
    kept = best.filter((F.col("n") >= least) & (F.col("n") >= pure * F.col("_t")) & (F.col("n") >= share * F.col("n_all")) & (F.col("beside") < beside))
    return kept.select(F.col("part").alias("alias"), "area", "n")


def purity(df: DataFrame, key: str, value: str, least: int = 3, share: float = 0.95) -> DataFrame:
    """Keys whose commonest value covers the share of at least `least` rows."""
    n = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    ranked = n.withColumns({"total": F.sum("n").over(w), "_r": F.row_number().over(w.orderBy(F.desc("n"), value))})
    return ranked.filter((F.col("_r") == 1) & (F.col("total") >= least) & (F.col("n") >= share * F.col("total"))).drop("_r")


def junk_names(records: DataFrame, vocabulary: DataFrame, least: int = 5) -> DataFrame:
    """Names of one word that the vocabulary lacks, at `least` addresses or more."""
    one = records.filter(~F.col("name").contains(" ") & (F.col("name") != "")).join(vocabulary.withColumnRenamed("word", "name"), "name", "left_anti")
    return one.groupBy("name").agg(F.countDistinct("addr").alias("n_addr")).filter(F.col("n_addr") >= least)


def frequency_percentile(df: DataFrame, key: str) -> DataFrame:
    """Per key its count and the share of keys that are at most as common: computed over the table of counts, one row per count."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # One row per distinct count: a table of the square root of the corpus at most.
    per = n.groupBy("n").agg(F.count(F.lit(1)).alias("keys"))
    run = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    table = per.withColumn("percentile", F.sum("keys").over(run) / F.sum("keys").over(total)).drop("keys")
    return n.join(table, "n")


def substitutions(pairs: DataFrame, a: str = "words_a", b: str = "words_b", least: int = 2) -> DataFrame:
    """Words that replace one another where exactly one word differs on either side."""
    x, y = F.array_except(a, b), F.array_except(b, a)
    return pairs.select(x.alias("x"), y.alias("y")).filter("size(x) = 1 and size(y) = 1").groupBy(F.col("x")[0].alias("old"), F.col("y")[0].alias("new")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
