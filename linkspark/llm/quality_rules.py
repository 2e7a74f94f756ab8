"""Document rules with thresholds that adapt to language and source.

Statistics of each document go into mergeable quantile sketches with relative-error buckets (DDSketch): a sketch is
the count per logarithmic bucket, so merging is addition and any grouping can be summed from (language, source). Fences
are read from the sketches: far from the median of the group, in units of the spread on its other side, which no junk beyond
can move while it is at most half the group. A source's fence reaches one width beyond its language's at most, so that a
source of mostly junk does not set its own. Every group's sketch is merged with its language's, weighed as PRIOR rows, and
a language's with that of all: small groups follow their language and large ones themselves, with no size at which the
rule changes. Documents beyond a fence are not kept.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, map_texts, materialise, numbered, positions

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = {c: None for c in (0x20, *range(0x09, 0x0E))}
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs"]

#: Statistic, and the distance of its fence from the median where the sketch shows no spread; else the spread sets it.
STATS = {"symbol_share": 0.05, "upper_share": 0.05, "bang_share": 0.05, "dup_line_share": 0.34, "repeat_share": 0.20, "mean_word": 1.0}
#: Those that also have a fence below the median; the others are shares, for which none is too low.
LOW = ["mean_word"]
#: Standard deviations by which chance alone may carry a short text beyond a fence that a spread sets.
CHANCE = 3.0

#: Rows for which a sketch counts when it is merged into that of a part of its rows, and the units in which a row is counted there.
PRIOR, UNITS = 100, 1_000_000

#: Relative error of a sketch; values up to FLOOR share the bucket of zero.
ALPHA, FLOOR = 0.01, 1e-6
_GAMMA = (1 + ALPHA) / (1 - ALPHA)


def measure(text: str | None) -> tuple[int, ...]:
    """The counts named in _COUNTS; n_lines are lines with a word, n_capitals A-Z, n_bangs exclamation marks."""
    if not text:
        return (0,) * len(_COUNTS)
    words = _WORDS.findall(text)
    if not words:
        return (0,) * len(_COUNTS)
    lines = [x for x in text.split("\n") if x.translate(_SPACE)] if "\n" in text else [text]
    repeated = 0
    if len(words) > 5:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(grams)) < len(grams):
            seen, reach = Counter(grams), 0
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    repeated += i + 5 - max(i, reach)
                    reach = i + 5
    return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), sum(map(text.count, _CAPITALS)), text.count("!")


def _measured(texts: list) -> dict:
    rows = [measure(t) for t in texts]
    return {f"r_{k}": pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_COUNTS))}


def bucket(value: Column) -> Column:
    """Bucket of a value: 0 up to FLOOR, else from 1, each GAMMA times as wide as the one before."""
    return F.when(value <= FLOOR, F.lit(0)).otherwise(F.ceil(F.log(value / FLOOR) / F.log(F.lit(_GAMMA)))).cast("int")


def bucket_value(index: Column) -> Column:
    """The value that stands for a bucket, within ALPHA of every value in it."""
    return F.when(index == 0, F.lit(0.0)).otherwise(F.lit(FLOOR) * F.pow(F.lit(_GAMMA), index) * F.lit(2 / (1 + _GAMMA)))


def sketch(df: DataFrame, by: list[str], stats: list[str]) -> DataFrame:
    """One row per group, statistic and bucket, with its count n: hot groups are summed before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), bucket(F.col(s)).alias("bucket")) for s in stats])).alias("p")
    return df.select(*by, pairs).groupBy(*by, F.col("p.stat").alias("stat"), F.col("p.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "stat", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """Per group and statistic: the row count and the quantiles named in `at`."""
    w = Window.partitionBy(*by, "stat")
    run = sketches.withColumn("below", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("rows", F.sum("n").over(w))
    picks = [bucket_value(F.min(F.when(F.col("below") >= F.ceil(F.lit(q) * F.col("rows")), F.col("bucket")))).alias(name) for name, q in at.items()]
    return run.groupBy(*by, "stat").agg(F.first("rows").alias("rows"), *picks)


def merged_with(own: DataFrame, by: list[str], wider: DataFrame, wider_by: list[str], prior: int) -> DataFrame:
    """The sketches `own` by `by`, each merged with that of `wider` it is a part of (by wider_by, some of by) as if that held `prior` rows. Counts are in UNITS of a row."""
    whole = wider.groupBy(*[F.col(c).alias(f"w_{c}") for c in wider_by], F.col("stat").alias("w_stat")).agg(F.sum("n").alias("w_all"))
    each = wider.select(*[F.col(c).alias(f"x_{c}") for c in wider_by], F.col("stat").alias("x_stat"), "bucket", F.col("n").alias("w_n"))
    same = lambda a, b: [F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in wider_by] + [F.col(f"{a}stat") == F.col(f"{b}stat")]
    shares = each.join(whole, same("x_", "w_")).select(*[f"x_{c}" for c in wider_by], "x_stat", "bucket", F.floor(F.lit(float(prior * UNITS)) * (F.col("w_n") / F.col("w_all"))).alias("n"))
    added = own.select(*by, "stat").distinct().join(shares, same("", "x_")).select(*by, "stat", "bucket", "n")
    return merge(own.select(*by, "stat", "bucket", (F.col("n") * UNITS).alias("n")).union(added), by)


def fences(sketches: DataFrame, by: list[str], least: dict[str, float], reach: float, name: str) -> DataFrame:
    """Per group, for each statistic its width, fence (median + width), and for those of LOW also the same below.

    A width is reach * twice the distance of the median from the quartile on the other side of it, which the rows beyond
    the fence can't move; `least` if that is 0.
    """
    q = quantiles(sketches, by, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    floor = F.create_map(*[F.lit(x) for s, v in least.items() for x in (s, v)])[F.col("stat")]
    wide = lambda spread: F.when(spread > 0, F.lit(2 * reach) * spread).otherwise(floor)
    q = q.withColumn("width", wide(F.col("q2") - F.col("q1"))).withColumn("low_width", wide(F.col("q3") - F.col("q2")))
    q = q.withColumn("fence", F.col("q2") + F.col("width")).withColumn("low", F.col("q2") - F.col("low_width"))
    pick = lambda s, c: F.max(F.when(F.col("stat") == s, F.col(c)))
    above = [pick(s, c).alias(f"{name}_{c}_{s}") for s in least for c in ("fence", "width")]
    below = [pick(s, c).alias(f"{name}_{c}_{s}") for s in LOW for c in ("low", "low_width")]
    return q.groupBy(*by).agg(*above, *below)


def measured(df: DataFrame, key_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Counts and shares per row, beside m_key, m_lang and m_source; one pass over the texts. A null text has no words and all shares 0; rows that repeat stay."""
    key, lang, source, text = (F.col(f"k{i}") for i in positions(df, key_col, lang_col, source_col, text_col))
    base = numbered(df).select(key.alias("m_key"), lang.cast("string").alias("m_lang"), source.cast("string").alias("m_source"), text.alias("m_text"))
    out = map_texts(base, "m_text", _measured, ", ".join(f"r_{k} long" for k in range(len(_COUNTS))), ["m_key", "m_lang", "m_source"])
    out = out.toDF("m_key", "m_lang", "m_source", *_COUNTS)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "upper_share": share("n_capitals", "word_chars"), "bang_share": share("n_bangs", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "mean_word": share("word_chars", "n_words"),
    })


def thresholds(rows: DataFrame, reach: float, prior: int) -> DataFrame:
    """Per language and source of measured rows (t_lang, t_source): the fences f_ above and g_ below. No rows with words give no groups."""
    stats, pair = list(STATS), ["m_lang", "m_source"]
    # Rows with words only: empty texts would drag the quartiles to zero.
    by_source = materialise(sketch(rows.filter("n_words > 0"), pair, stats), "sketches")
    by_lang, every = merge(by_source, ["m_lang"]), merge(by_source, [])
    by_lang = materialise(merged_with(by_lang, ["m_lang"], every, [], prior), "sketches")
    small = fences(merged_with(by_source, pair, by_lang, ["m_lang"], prior), pair, STATS, reach, "s").withColumnsRenamed({"m_lang": "t_lang", "m_source": "t_source"})
    mid = fences(by_lang, ["m_lang"], STATS, reach, "l").withColumnRenamed("m_lang", "l_lang")
    table = small.join(mid, F.col("t_lang").eqNullSafe(F.col("l_lang")))
    up = [F.least(f"s_fence_{s}", F.col(f"l_fence_{s}") + F.col(f"l_width_{s}")).alias(f"f_{s}") for s in stats]
    down = [F.greatest(F.least(f"s_low_{s}", f"l_low_{s}"), F.col(f"l_low_{s}") - F.col(f"l_low_width_{s}")).alias(f"g_{s}") for s in LOW]
    return table.select("t_lang", "t_source", *up, *down)


def judge(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: float = 6.0, prior: int = PRIOR) -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    base_failed: n_words < 10 or 100 * n_repeat_words > 20 * n_words. kept is false if that holds or if a statistic lies
    beyond a fence of the row's language and source, or beyond the language's fence by more than its width (below the median, also no
    nearer to it than the language's); texts of few words have an allowance for chance. The sketch of a group is merged with
    its language's as `prior` rows, and a language's with that of all rows. Null languages and sources are groups of their own.
    A null text has no words and so fails. Whole texts are measured; ties change nothing; rows that repeat stay rows (and
    count as often in the sketches); no rows give no rows. Columns are taken by position, so others may have any name; a
    result called like the key gets an underscore.
    """
    rows = materialise(measured(df, key_col, text_col, lang_col, source_col), "measured")
    table = thresholds(rows, reach, prior)
    out = rows.join(table, F.col("m_lang").eqNullSafe(F.col("t_lang")) & F.col("m_source").eqNullSafe(F.col("t_source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # Chance: the deviation of a share of independent letters, and of a mean of words whose lengths deviate by half their mean.
    spare = {
        "upper_share": lambda f: F.sqrt(f * F.greatest(1 - f, F.lit(0.0)) / F.greatest("word_chars", F.lit(1))),
        "mean_word": lambda f: f / 2 / F.sqrt(F.greatest("n_words", F.lit(1))),
    }
    slack = lambda s, f: F.lit(CHANCE) * spare[s](f) if s in spare else F.lit(0.0)
    beyond = F.lit(False)
    for s in STATS:
        beyond = beyond | F.coalesce(F.col(s) > F.col(f"f_{s}") + slack(s, F.col(f"f_{s}")), F.lit(False))
    for s in LOW:
        beyond = beyond | F.coalesce(F.col(s) < F.col(f"g_{s}") - slack(s, F.col(f"g_{s}")), F.lit(False))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return keyed(out, key_col, {n: F.col(n) for n in names} | {"base_failed": failed, "kept": ~failed & ~beyond}, F.col("m_key"))
