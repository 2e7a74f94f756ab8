"""What the corpus operators share: scratch tables, folds, words and Arrow maps."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word: a run of characters that are not ASCII separators, punctuation or capitals.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_RE = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(65, 91)}
_UPPER_TEXT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    if text.isascii():
        return text.lower()
    return text.translate(_LOWER)


def ascii_lower_col(text: Column) -> Column:
    return F.translate(text, _UPPER_TEXT, _UPPER_TEXT.lower())


def words_of(text: str | None) -> list[str]:
    return WORD_RE.findall(ascii_lower(text)) if text else []


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def fold_col(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty string (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine that names none, as in tests, gets a temporary one; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, is never evaluated twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def positions(df: DataFrame, *names: str) -> list[int]:
    """Where the named columns stand in df: the exact name, else the one that differs in case only."""
    exact, folded = df.columns, [c.lower() for c in df.columns]
    return [exact.index(n) if n in exact else folded.index(n.lower()) for n in names]


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns called k0, k1, ... by position, so that no name of the caller's clashes with one of an operator."""
    return df.toDF(*[f"k{i}" for i in range(len(df.columns))])


def beside(taken: list[str], name: str) -> str:
    """name, or name with underscores added until it differs from all of taken (also in case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def keyed(df: DataFrame, key_col: str, results: dict[str, Column], key: Column) -> DataFrame:
    """The key under its own name and the results under theirs; a result called like the key gets an underscore."""
    return df.select(key.alias(key_col), *[c.alias(beside([key_col], n)) for n, c in results.items()])


#: Spark's bound of an Arrow batch in bytes (64 MB unless set; a batch also ends at 10,000 rows), and ours: a batch stands several times in an executor, in its JVM and its workers.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of about BATCH_BYTES. Spark reads the bound from the session when the map runs: it is set there, unless the session has one."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def map_texts(df: DataFrame, text_col: str, fn: Callable[[list], dict[str, list]], schema: str, keep: list[str]) -> DataFrame:
    """Arrow map over batches: the kept columns, called k0, k1, ... in their order, then the columns that fn makes of the list of texts.

    schema lists the new columns ("r_n long, r_score double"). fn is built once per task if it has a `start` attribute.
    A text that is among the kept columns travels once.
    """
    at, by = positions(df, *keep), numbered(df)
    text_at = positions(df, text_col)[0]
    n_keep = place = len(keep)
    columns = [F.col(f"k{i}").alias(f"k{j}") for j, i in enumerate(at)]
    if text_at in at and by.schema[text_at].dataType == StringType():
        place = at.index(text_at)
    else:
        columns.append(F.col(f"k{text_at}").cast("string").alias("text"))
    source = by.select(*columns)
    fields = [f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(n_keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = fn.start() if hasattr(fn, "start") else fn
        for batch in batches:
            # Slices bound what a batch of very long texts holds in Python objects.
            for part in sliced(batch, place):
                made = call(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], *made.values()], names=[*(f"k{i}" for i in range(n_keep)), *made])

    return map_arrow(source, run, ", ".join([*fields, schema]))


def sliced(batch: pa.RecordBatch, text_at: int, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about equal bytes of text (a slice holds one row at least)."""
    text = batch.column(text_at)
    start, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(text).to_pylist()):
        held += n or 0
        if held >= most_bytes:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
