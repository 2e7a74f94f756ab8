"""Record-level tables: views, frequencies, vocabularies, idf and fake names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .keys import large


def views(df: DataFrame, name: str = "name", addr: str = "addr", country: str = "country") -> DataFrame:
    """Every row with its name and address views and the flags that derive from them."""
    out = df.withColumns(text.name_views(F.col(name)) | text.addr_views(F.col(addr), F.col(country)))
    return out.withColumns({
        "addr_empty": F.col("addr_n") == "", "addr_nodigit": ~F.col("addr_n").rlike("[0-9]"), "addr_noletter": ~F.col("addr_n").rlike("[a-z]"),
        "name_noletter": ~F.col("name_n").rlike("[a-z]"), "script": text.script(F.coalesce(F.col(name), F.lit(""))).cast("int"),
        "num_first": F.coalesce(F.try_element_at("nums", F.lit(1)), F.lit(-1)).cast("long"), "n_nums": F.size("nums").cast("long"),
        "ntok_name": F.size(text.tokens(F.col("name_n"))).cast("long"), "ntok_addr": F.size(text.tokens(F.col("addr_n"))).cast("long"),
        "addr_key": F.array_join(F.array_sort(F.array_distinct(text.tokens(F.col("addr_n")))), " "),
    })


def frequencies(s1: DataFrame, pool: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with how many anchors (`name`_s1) and records (`name`_pool) share their key; 0 for an empty key."""
    a = s1.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = pool.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    counts = a.join(b, key, "full").filter(F.col(key) != "")
    add = lambda df: df.join(large(counts), key, "left").withColumns({f"{name}_s1": F.coalesce("_a", F.lit(0)).cast("long"), f"{name}_pool": F.coalesce("_b", F.lit(0)).cast("long")}).drop("_a", "_b")
    return add(s1), add(pool)


def document_frequencies(df: DataFrame, id_col: str, words: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Distinct words with the number of rows that hold them (df) and idf = ln(N / df), per group if `by` is given; a row counts `weight` times."""
    by, times = list(by), F.col(weight) if weight else F.lit(1)
    n = df.groupBy(*by).agg(F.sum(times).alias("n"))
    each = df.select(*by, times.alias("_times"), F.explode(F.array_distinct(words)).alias("word")).groupBy(*by, "word").agg(F.sum("_times").alias("df"))
    out = each.join(n, by) if by else each.join(F.broadcast(n))  # one row
    return out.withColumn("idf", F.ln(F.col("n") / F.col("df"))).drop("n")


def pack_idf(s1: DataFrame, pool: DataFrame, words: str = "words", offset: float = 0.7) -> DataFrame:
    """(country, word, df, idf_global, idf_country) over both sides: ln(N / df) over all records, and ln(N_c / df_c) + offset within the country."""
    both = s1.select("country", F.array_distinct(words).alias("w")).unionByName(pool.select("country", F.array_distinct(words).alias("w")))
    sizes = both.groupBy("country").agg(F.count(F.lit(1)).alias("n_c"))
    per = both.select("country", F.explode("w").alias("word")).groupBy("country", "word").agg(F.count(F.lit(1)).alias("df"))
    every = per.groupBy("word").agg(F.sum("df").alias("df_all"))
    total = sizes.agg(F.sum("n_c").alias("n_all"))  # one row, as is a row per country
    out = per.join(every, "word").join(F.broadcast(sizes), "country").join(F.broadcast(total))
    return out.select("country", "word", "df", F.ln(F.col("n_all") / F.col("df_all")).alias("idf_global"), (F.ln(F.col("n_c") / F.col("df")) + offset).alias("idf_country"))


#: What pack_views does, each of which can be left out: areas as codes, saints written out, house-number suffixes split off (or kept as a token of their own), the country's
#: street words, its tags dropped, its legal forms dropped, learned words replaced.
SWITCHES = ("admin", "saint", "suffix", "suffix_token", "streets", "tags", "legal", "lexicon")


def pack_views(df: DataFrame, regions: dict[str, str], tags: list[str], use: tuple[str, ...] = ("admin", "saint", "suffix", "tags"), streets: dict[str, str] | None = None, legal: list[str] = (), words: dict[str, str] | None = None) -> DataFrame:
    """Views for a country with its own address habits, by the SWITCHES in use; with none they are those of `views`."""
    low = F.lower(text.latin_fold(F.col("addr")))
    saints = text.SAINTS(low) if "saint" in use else low
    if "streets" in use and streets:
        saints = F.array_join(text.mapped(F.split(saints, " "), streets), " ")
    drop = [*(tags if "tags" in use else ()), *(legal if "legal" in use else ())]
    spoken = text.tokens(text.NAME(F.lower(text.latin_fold(F.col("name")))))
    if "lexicon" in use and words:
        spoken = text.mapped(spoken, words)
    name = F.array_join(F.filter(spoken, lambda w: ~w.isin(*drop)), " ") if drop or words else F.col("name")
    tagged = F.exists(text.tokens(text.NAME(F.lower(text.latin_fold(F.col("name"))))), lambda w: w.isin(*tags))
    out = df.withColumns({"hn_sfx": text.house_suffix(saints), "f_ctag": tagged, "adm": area(saints, regions)})
    bare = text.without_suffix(saints) if "suffix" in use else saints
    if "suffix_token" in use:  # "98 bis" and "98b" read alike, and unlike "98"
        bare = F.when(F.col("hn_sfx") != "", F.concat(text.without_suffix(saints), F.lit(" sfx"), F.col("hn_sfx"))).otherwise(bare)
    plain = out.withColumns({"addr": text.admin_components(bare, regions) if "admin" in use else bare, "name": name})
    return views(plain).withColumns({"street_key": text.street_key(F.when(F.col("num_first") >= 0, F.col("num_first")), F.filter(text.tokens(F.col("addr_n")), lambda w: ~w.rlike("[0-9]")))})


def area(addr: Column, regions: dict[str, str]) -> Column:
    """The code of the last component that names a region, '' if none does."""
    m = F.create_map(*[F.lit(x) for kv in regions.items() for x in kv])
    parts = F.transform(F.split(addr, ","), lambda c: F.element_at(m, F.trim(F.regexp_replace(F.regexp_replace(c, "[-'.]", " "), " +", " "))))
    return F.coalesce(F.try_element_at(F.filter(parts, lambda c: c.isNotNull()), F.lit(-1)), F.lit(""))


#: Cores of one word that may be made up.
LONE = "^[a-z]{5,12}$"


def fake_names(s1: DataFrame, pool: DataFrame, core: str = "name_core", addr_key: str = "addr_key", least: int = 3) -> DataFrame:
    """Names of one word of 5 to 12 letters that no anchor's vocabulary has, seen at `least` addresses or more."""
    vocabulary = s1.select(F.explode(text.tokens(F.col(core))).alias(core)).distinct()
    lone = pool.filter(F.col(core).rlike(LONE)).join(vocabulary, core, "left_anti")
    return lone.groupBy(core).agg(F.countDistinct(addr_key).alias("n_addr")).filter(F.col("n_addr") >= least)


def generic_words(s1: DataFrame, core: str = "name_core", least: int = 1000) -> DataFrame:
    return s1.select(F.explode(F.array_distinct(text.tokens(F.col(core)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
