"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped on reading.

A set of files is a folder of `NNNNNN-<attempt>.bin` (ids, little-endian, 16 bits wide if the vocabulary allows it, else 32)
and `NNNNNN-<attempt>.idx`: a header of four unsigned 64-bit numbers (magic, version, bytes per id, documents), then n + 1
offsets in ids (64-bit), n document ids (64-bit) and n bytes that are 1 where the document id is null. Files are in
ascending order of document id; the base of each file is the prefix sum of the ids before it.

The manifest names the files that count. Every attempt of a task writes under a name of its own and reports it in its
manifest row, of which Spark commits one per task: nothing is renamed or replaced, so a retried or speculative task is
safe on any store. What lost attempts left is not named and can be swept.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32, keyed, materialise, numbered, positions, scratch_path, sliced
from .tokens import WordPieces, packed

MAGIC, VERSION = 0x4C4C4D544F4B4944, 1
MANIFEST = "file int, path string, n_docs long, n_tokens long"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """One pair of files, under a name that no other attempt uses."""

    def __init__(self, folder: str, number: int, width: int):
        self.fs, root = _fs(folder)
        self.fs.create_dir(root, recursive=True)
        name = f"{number:06d}-{uuid.uuid4().hex}"
        self.path, self.uri = f"{root}/{name}", f"{folder}/{name}"
        self.kind, self.width = np.dtype("<u2" if width == 2 else "<u4"), width
        self.out = self.fs.open_output_stream(f"{self.path}.bin")
        self.ends, self.ids, self.nulls = [0], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_all([doc_id], [ids.astype(self.kind).tobytes()])

    def add_all(self, doc_ids: list[int | None], raw: list[bytes]) -> None:
        """Documents whose ids are already in the file's form."""
        self.out.write(b"".join(raw))
        for doc_id, r in zip(doc_ids, raw):
            self.ends.append(self.ends[-1] + len(r) // self.width)
            self.ids.append(0 if doc_id is None else doc_id)
            self.nulls.append(doc_id is None)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        with self.fs.open_output_stream(f"{self.path}.idx") as f:
            f.write(np.array([MAGIC, VERSION, self.width, len(self.ids)], dtype="<u8").tobytes())
            f.write(np.array(self.ends, dtype="<i8").tobytes() + np.array(self.ids, dtype="<i8").tobytes() + np.array(self.nulls, dtype="u1").tobytes())
        return self.uri, len(self.ids), self.ends[-1]


class Reader:
    """A pair of files; ids(i) is a view of the mapped file. Files that are not of this format, or whose offsets disagree with their length, are refused."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        raw = self._bytes(fs, f"{path}.idx")
        magic, version, width, n = np.frombuffer(raw, dtype="<u8", count=4).tolist()
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is no token file of version {VERSION}")
        self.n = n
        self.offsets = np.frombuffer(raw, dtype="<i8", count=n + 1, offset=32)
        ids = np.frombuffer(raw, dtype="<i8", count=n, offset=32 + 8 * (n + 1))
        nulls = np.frombuffer(raw, dtype="u1", count=n, offset=32 + 8 * (2 * n + 1))
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), nulls.tolist())]
        data = self._bytes(fs, f"{path}.bin")
        self.data = np.frombuffer(data, dtype="<u2" if width == 2 else "<u4") if len(data) else np.zeros(0, dtype="<u4")
        if len(self.data) != self.offsets[-1]:
            raise ValueError(f"{uri}: {len(self.data)} ids, the offsets say {self.offsets[-1]}")

    @staticmethod
    def _bytes(fs, path: str):
        from pyarrow import fs as pafs

        if isinstance(fs, pafs.LocalFileSystem):
            return pa.memory_map(path).read_buffer()  # mapped, not copied
        with fs.open_input_file(path) as f:
            return f.read_buffer()

    def ids(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]


def write(df: DataFrame, tokenizer: str, folder: str | None = None, key_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Encode every text, append end_id and write the files; returns the manifest, one row per file, with its base.

    One range shuffle on the key, and a hash of the text among rows of one key, orders the corpus; each task then encodes
    its range and streams it into one pair of files, so a task holds its offsets and one batch of ids. Keys are whole
    numbers (the format stores 64 bits); others are refused. Null texts encode as empty (end_id alone). Null keys come
    first. Rows that repeat a key are kept, in order of the hash of their text, then the text. No rows give no files.
    Columns are taken by position, so others may have any name.
    """
    at = positions(df, key_col, text_col)
    if (kind := df.schema[at[0]].dataType.simpleString()) not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"token files take keys that are whole numbers, {key_col} is {kind}")
    folder = folder or scratch_path(df.sparkSession, "tokens")
    width = 2 if _vocabulary(tokenizer, end_id) <= 1 << 16 else 4

    def run(batches):
        files, coder, end = None, WordPieces.of_worker(tokenizer, width), packed([end_id], width)
        for batch in batches:
            for part in sliced(batch, 1):
                files = files or Writer(folder, TaskContext.get().partitionId(), width)
                files.add_all(part.column(0).to_pylist(), [raw + end for raw in coder.encode(part.column(1).to_pylist())])
        if files:
            uri, n, total = files.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [uri], "n_docs": [n], "n_tokens": [total]})

    source = numbered(df).select(F.col(f"k{at[0]}").cast("long").alias("k"), F.col(f"k{at[1]}").cast("string").alias("t"))
    ordered = source.withColumn("h", F.xxhash64("t")).repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    files = materialise(ordered.mapInArrow(run, MANIFEST), "manifest")
    # One row per file: the prefix sum over them is small at any size of corpus.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("base", before)


def _vocabulary(tokenizer: str, end_id: int) -> int:
    from .tokens import load

    return max(load(tokenizer).get_vocab_size(), end_id + 1)


def sweep(spark: SparkSession, manifest: DataFrame, folder: str) -> int:
    """Remove the files of the folder that the manifest doesn't name, once the write is over; returns how many. The list of files is small: a task writes one pair."""
    from pyarrow import fs as pafs

    files, root = _fs(folder)
    named = {r["path"].rsplit("/", 1)[-1] for r in manifest.select("path").collect()}
    lost = [f.path for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.rsplit(".", 1)[0] not in named]
    for path in lost:
        files.delete_file(path)
    return len(lost)


def read(spark: SparkSession, manifest: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Per document, from the mapped files: key, start (ids of all documents before it), n_tokens, ids_crc32 (over 32-bit little-endian ids).

    Null and repeated keys come back as they were written; an empty manifest gives no rows; a result called like the key
    gets an underscore.
    """

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = Reader(path)
                for k in range(0, f.n, 5000):
                    rows = range(k, min(k + 5000, f.n))
                    ids = [f.ids(i) for i in rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f.doc_ids[i] for i in rows], pa.int64()), pa.array([base + int(f.offsets[i]) for i in rows], pa.int64()),
                         pa.array([len(x) for x in ids], pa.int64()), pa.array([crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                        names=["k", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, manifest.count())
    rows = manifest.select("path", "base").repartition(n).mapInArrow(run, "k long, start long, n_tokens long, ids_crc32 long")
    return keyed(rows, key_col, {n: F.col(n) for n in ("start", "n_tokens", "ids_crc32")}, F.col("k"))


def read_ids(spark: SparkSession, manifest: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Per document its ids: the general form for training input. Documents without text have the end id alone; an empty manifest gives no rows."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                f = Reader(path)
                for k in range(0, f.n, 500):
                    rows = range(k, min(k + 500, f.n))
                    yield pa.RecordBatch.from_arrays([pa.array([f.doc_ids[i] for i in rows], pa.int64()), pa.array([f.ids(i).astype("i4") for i in rows], pa.list_(pa.int32()))], names=["k", "ids"])

    rows = manifest.select("path").mapInArrow(run, "k long, ids array<int>")
    return keyed(rows, key_col, {"ids": F.col("ids")}, F.col("k"))
