"""Tables in and out: unquoted tab-separated text, id lists, restartable parts, fingerprints, samples, validators."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import bucket, fingerprint

SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]


def read_tsv(spark: SparkSession, path: str, columns: list[str] = tuple(SOURCE_COLUMNS)) -> DataFrame:
    """Tab-separated text with a header, nothing quoted or escaped, every column a string, null as ''. The header must be the columns asked for."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.options(sep="\t", quote="", escape="", header=True, enforceSchema=False, emptyValue="").schema(schema).csv(path)
    return df.na.fill("")


def id_list(lists: Column) -> Column:
    """The ids of a comma-separated list; blanks and empty entries go."""
    return F.filter(F.transform(F.split(F.coalesce(lists, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def id_pairs(df: DataFrame, key: str, lists: str, item: str = "id") -> DataFrame:
    return df.select(key, F.explode(id_list(F.col(lists))).alias(item))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def id_lists(all_keys: DataFrame, pairs: DataFrame, key: str, item: str, name: str = "ids") -> DataFrame:
    """One row per key, those without items included: its items sorted and joined by commas."""
    g = pairs.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias(name))
    return all_keys.select(key).join(g, key, "left").fillna("", [name])


def write_tsv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Unquoted tab-separated text with a header. one_file gathers the rows in one task: only for a table that a file must hold whole."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(sep="\t", quote="", escape="", header=True, emptyValue="", nullValue="").csv(path)


def write_parts(df: DataFrame, path: str, key: str, parts: int, per_job: int = 16) -> None:
    """Parts by key hash, per_job of them in one pass over the input; a rerun writes those that no finished pass has marked."""
    spark = df.sparkSession
    part = df.withColumn("part", bucket(F.col(key), parts, "part"))
    todo = [i for i in range(parts) if not _exists(spark, f"{path}/_done/{i}")]
    for lo in range(0, len(todo), per_job):
        group = todo[lo : lo + per_job]
        chosen = part.filter(F.col("part").isin(group)) if len(group) < parts else part
        chosen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        for i in group:
            _write_text(spark, f"{path}/_done/{i}", "")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version of a table beside the old ones, then name it as the current one: readers see the old version or the new, never a part. Nothing is renamed, so any store will do."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    _write_text(df.sparkSession, f"{path}/current.txt", version)


def current_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/current.txt', wholetext=True).first()[0].strip()}")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _write_text(spark: SparkSession, path: str, content: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content.encode()))
    out.close()


def read_side_table(path: str, spark: SparkSession | None = None):
    """JSON or, where the library is installed, YAML; through Spark's file systems if a session is given."""
    raw = Path(path).read_text() if spark is None else "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(raw)
    return json.loads(raw)


def merged(base: dict, over: dict) -> dict:
    """A configuration laid over its defaults, nested dicts key by key."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def check_fingerprints(tables: dict[str, DataFrame], expected: dict[str, str]) -> list[str]:
    """Names of tables whose content isn't the expected one."""
    return [n for n, df in tables.items() if fingerprint(df).first()["checksum"] != expected.get(n)]


def smoke_sample(s1: DataFrame, pool: DataFrame, truth: DataFrame, share: int = 10, noise: int = 50) -> tuple[DataFrame, DataFrame]:
    """One in `share` anchors, their true records, and one in `noise` of the other records: by key hash, so always the same."""
    a = s1.filter(bucket(F.col("s1"), share, "smoke") == 0)
    mine = truth.join(a.select("s1"), "s1", "left_semi").select("cand")
    own = pool.join(mine, "cand", "left_semi")
    return a, own.unionByName(pool.join(mine, "cand", "left_anti").filter(bucket(F.col("cand"), noise, "smoke") == 0))


def violations(matches: DataFrame, candidates: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Counts per fault of a submission. matches: (s1, cand), candidates: (s1, cand).

    duplicate pairs; records with two owners; unknown anchors and records; matches that are no candidates; matches across countries.
    """
    pair = ["s1", "cand"]
    a, b = s1.select("s1", F.col("country").alias("c1")), pool.select("cand", F.col("country").alias("c2"))
    faults = {
        "duplicate_pairs": matches.groupBy(*pair).count().filter("count > 1"), "many_owners": matches.distinct().groupBy("cand").count().filter("count > 1"),
        "unknown_s1": matches.join(a, "s1", "left_anti"), "unknown_cand": matches.join(b, "cand", "left_anti"), "not_candidates": matches.join(candidates.select(*pair).distinct(), pair, "left_anti"),
        "other_country": matches.join(a, "s1").join(b, "cand").filter("c1 <> c2"),
    }
    out = None
    for name, df in faults.items():
        row = df.agg(F.lit(name).alias("fault"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def header_faults(spark: SparkSession, path: str, columns: list[str]) -> list[str]:
    """What is wrong with the header line of a tab-separated file: columns that lack, that are too many, or that stand in another order."""
    found = (spark.read.text(path).first() or [""])[0].split("\t")
    lacking, extra = [c for c in columns if c not in found], [c for c in found if c not in columns]
    return [*(f"missing {c}" for c in lacking), *(f"extra {c}" for c in extra), *(["order"] if not lacking and not extra and found != list(columns) else [])]


def anchor_faults(df: DataFrame, key: str, anchors: DataFrame) -> DataFrame:
    """missing_keys: anchors without a row; extra_keys: rows whose key is no anchor."""
    have, want = df.select(key).distinct(), anchors.select(key).distinct()
    count = lambda x, name: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fault"), "n")
    return count(want.join(have, key, "left_anti"), "missing_keys").union(count(have.join(want, key, "left_anti"), "extra_keys"))


def list_faults(df: DataFrame, key: str, lists: str, prefix: str = "S") -> DataFrame:
    """Faults within the lists: repeated keys, repeated ids in a list, ids without the prefix, keys that list themselves."""
    x = df.withColumn("_ids", id_list(F.col(lists)))
    return x.agg(
        (F.count(F.lit(1)) - F.countDistinct(key)).alias("repeated_keys"), F.count_if(F.size("_ids") != F.size(F.array_distinct("_ids"))).alias("repeated_ids"),
        F.count_if(F.exists("_ids", lambda i: ~i.startswith(prefix))).alias("bad_prefix"), F.count_if(F.array_contains("_ids", F.col(key))).alias("self_match"),
    )
