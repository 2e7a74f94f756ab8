"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is `size` consecutive words of an item (an item of fewer words is one window). A document contains a window
only if it contains all its words, so one necessary word, the rarest of the window over the whole corpus, is a
sufficient prefix. Documents keep the positions of such words with the words around them; a join on the word, bounds on
position and length, and the comparison of the whole window verify exact containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower_col, keyed, materialise, numbered, positions

#: Separators of words, for a split.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Distinct words that may stand in the plan as a set (about a megabyte); more go through a join.
MOST_LITERALS = 20_000

#: Windows of no more characters than this, with their items, are broadcast.
MOST_BYTES = 8_000_000


def words_col(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.filter(F.split(ascii_lower_col(F.coalesce(text, F.lit(""))), _GAPS), lambda w: w != "")


def windows_of(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """One row per distinct window: its words (w), their number (len) and the items it stands in.

    Null, empty and wordless items have none; a null item id is in no list of items, but its windows stand.
    """
    item, text = (F.col(f"k{i}") for i in positions(items, item_col, text_col))
    w = numbered(items).select(item.cast("string").alias("item"), words_col(text).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("w"))
    return w.groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("w"))


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def _listed(words: DataFrame, most: int) -> list[str] | None:
    """The words of a one-column table if they are no more than `most`, else None."""
    got = [r[0] for r in words.limit(most + 1).collect()]
    return sorted(got) if len(got) <= most else None


def _prefixes(docs: DataFrame, windows: DataFrame, most: int) -> DataFrame:
    """The windows with their rarest word by its count over all documents, and its place in the window.

    Ties go to the longer word, then by spelling, then to the first place.
    """
    vocabulary = windows.select(F.explode("w").alias("word")).distinct()
    listed = _listed(vocabulary, most)
    if listed is not None:
        inside = docs.select(F.explode(F.expr(f"filter(words, x -> x IN ({_quoted(listed)}))")).alias("word")) if listed else None
    else:
        inside = docs.select(F.explode("words").alias("word")).join(vocabulary, "word", "left_semi")
    if inside is None:
        return windows.withColumns({"rare": F.lit(""), "off": F.lit(0)})
    counts = inside.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    each = windows.select("w", F.posexplode("w").alias("off", "word")).join(counts, "word", "left")
    pick = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("word")).alias("l"), "word", "off")).alias("p")
    # A window with a word that no document holds can't occur.
    chosen = each.groupBy("w").agg(pick).filter("p.n > 0").select("w", F.col("p.word").alias("rare"), F.col("p.off").alias("off"))
    return windows.join(chosen, "w")


def _candidates(docs: DataFrame, prefixes: DataFrame, size: int, most: int) -> DataFrame:
    """One row per document: row, key, hash of the text, n_words and the places of prefix words, each with the words up to a window around it."""
    rare = prefixes.select(F.col("rare").alias("word")).distinct()
    listed = _listed(rare, most)
    if listed == []:
        held = F.expr("cast(array() as array<int>)")
    elif listed is not None:
        held = F.expr(f"filter(sequence(0, size(words) - 1), i -> words[i] IN ({_quoted(listed)}))")
    else:
        # Too many for the plan: documents meet the prefix words in a shuffle, summed to a set per document.
        pairs = docs.select("key", "hash", F.explode(F.array_distinct("words")).alias("word")).join(rare, "word", "left_semi")
        sets = pairs.groupBy("key", "hash").agg(F.collect_set("word").alias("own")).select(F.col("key").alias("s_key"), F.col("hash").alias("s_hash"), "own")
        docs = docs.join(sets, F.col("key").eqNullSafe(F.col("s_key")) & (F.col("hash") == F.col("s_hash")), "left")
        held = F.expr("filter(sequence(0, size(words) - 1), i -> coalesce(array_contains(own, words[i]), false))")
    held = F.when(F.size("words") > 0, held).otherwise(F.expr("cast(array() as array<int>)"))
    found = docs.select("key", "hash", "words", held.alias("held"))
    around = F.expr(f"transform(held, i -> struct(i as at, words[i] as word, slice(words, greatest(i - {size - 1}, 0) + 1, {2 * size - 1}) as ctx))")
    return found.select(F.monotonically_increasing_id().alias("row"), "key", "hash", F.size("words").cast("long").alias("n_words"), around.alias("places"))


def occurrences(candidates: DataFrame, prefixes: DataFrame, size: int) -> DataFrame:
    """Verified places: row, first word (from 0), last word and the items of the window.

    A document without prefix words has none; windows of repeated words may overlap themselves. The windows are
    broadcast only where their measured size is small (MOST_BYTES); else both sides are shuffled by the prefix word.
    """
    c = candidates.filter(F.size("places") > 0).select("row", F.explode("places").alias("p")).select("row", "p.at", "p.word", "p.ctx").withColumn("c", F.least(F.col("at"), F.lit(size - 1)))
    begin = F.col("c") - F.col("off")
    same = F.when((begin >= 0) & (begin + F.col("len") <= F.size("ctx")), F.slice("ctx", F.greatest(begin, F.lit(0)) + 1, F.col("len")) == F.col("w")).otherwise(False)
    held = prefixes.agg(F.sum(F.length(F.array_join("w", " ")) + F.length(F.array_join("items", " ")) + 100)).first()[0] or 0
    near = F.broadcast(prefixes) if held <= MOST_BYTES else prefixes
    hits = c.join(near, (F.col("word") == F.col("rare")) & same)
    return hits.select("row", (F.col("at") - F.col("off")).alias("first"), (F.col("at") - F.col("off") + F.col("len") - 1).alias("last"), "items")


def contamination(df: DataFrame, items: DataFrame, key_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, most_literals: int = MOST_LITERALS) -> DataFrame:
    """Per row of df: key, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 and contaminated.

    items_sha256 is the hash of the ids of the items found, sorted as text and joined by commas (of the empty text where
    none). Null and empty texts have no words; items without words have no windows; a null item id takes part in n_hit but is not
    listed. Rows that repeat stay rows. Empty tables on either side give no rows or no hits. Columns are taken by position,
    so others may have any name; a result called like the key gets an underscore.
    Long texts stay whole: what leaves a document is its word count and the surroundings of prefix words.
    """
    out = _contamination(df, items, key_col, text_col, item_col, item_text, size, most_literals)
    return keyed(out, key_col, {n: F.col(n) for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}, F.col("key"))


def _contamination(df: DataFrame, items: DataFrame, key_col: str, text_col: str, item_col: str = "item_id", item_text: str = "text", size: int = 10, most_literals: int = MOST_LITERALS) -> DataFrame:
    """The result of contamination with the key as `key`, and the hash of the text."""
    key, text = (F.col(f"k{i}") for i in positions(df, key_col, text_col))
    docs = numbered(df).select(key.alias("key"), words_col(text).alias("words"), F.xxhash64(text).alias("hash"))
    windows = materialise(windows_of(items, item_col, item_text, size), "windows")
    prefixes = materialise(_prefixes(docs, windows, most_literals), "prefixes")
    found = materialise(_candidates(docs, prefixes, size, most_literals), "places")
    hits = materialise(occurrences(found, prefixes, size), "hits")
    order = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    # Words of an occurrence that no earlier one covers.
    fresh = hits.select("row", "first", "last").distinct().withColumn("seen", F.max("last").over(order))
    fresh = fresh.select("row", F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce("seen", F.lit(-1)))).alias("n"))
    covered = fresh.groupBy("row").agg(F.sum("n").cast("long").alias("n_hit"))
    listed = hits.select("row", F.explode_outer("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = found.select("row", "key", "hash", "n_words").join(covered, "row", "left").join(listed, "row", "left")
    return out.select(
        "key", "hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(df: DataFrame, items: DataFrame, key_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of df, all columns as they are and whatever they are called, without those whose own text is contaminated.

    Each row is judged by its text: of rows that repeat a key only the contaminated ones go, and so do contaminated rows without a key.
    """
    key, text = (F.col(f"k{i}") for i in positions(df, key_col, text_col))
    bad = _contamination(df, items, key_col, text_col, **how).filter("contaminated").select(F.col("key").alias("bad_key"), F.col("hash").alias("bad_hash")).distinct()
    return numbered(df).join(bad, key.eqNullSafe(F.col("bad_key")) & (F.xxhash64(text) == F.col("bad_hash")), "left_anti").toDF(*df.columns)


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def oracle_sql(size: int = 10) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + {size - 1}) AS x, least(len(w), {size}) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS x
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, i, pos.n, item_id FROM pos JOIN win ON pos.x = win.x),
cov AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
