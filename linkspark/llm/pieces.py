"""Lossless SentencePiece-style encoding: an Aho-Corasick automaton over the pieces feeds a one-pass Viterbi.

The automaton reports, for every position, each piece that ends there (its output links); each report relaxes the best
score of that position from the best score where the piece begins. A character that is no piece of its own is spelt in
bytes at a score below every piece. A blank is written as U+2581 and a literal U+2581 is always spelt in bytes, so
decoding gives the text back exactly.

Where no piece holds U+2581 after another character, the best path of a text is the best paths of its blank-led words
one after the other: a piece cannot cross such a boundary. Words are therefore solved once per worker and kept in a
bounded cache. A vocabulary with pieces across blanks is solved over whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, keyed, map_texts, numbered, positions
from .tokens import BoundedCache, per_worker

BLANK = "▁"


class Pieces:
    """The automaton and the tables of a vocabulary: (piece, score) by id, and the ids of the 256 bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], dummy_prefix: bool = True, most: int = 200_000):
        import ahocorasick

        if len(byte_ids) != 256:
            raise ValueError("256 byte pieces are needed")
        self.byte_ids, self.dummy_prefix = byte_ids, dummy_prefix
        self.auto = ahocorasick.Automaton()
        for p, (i, s) in pieces.items():
            self.auto.add_word(p, (len(p), s, i))
        self.auto.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.spelt = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.table = {i: p.replace(BLANK, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        across = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)
        if across:
            self.cut = re.compile(r".+", re.S)
        elif any("\n" in p for p in pieces):
            self.cut = re.compile(r" *[^ ]+| +")
        else:  # a line feed is always spelt: no piece crosses it either
            self.cut = re.compile(r"\n| *[^ \n]+| +")
        self.known = BoundedCache(most)

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        plain = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls({m.id_to_piece(i): (i, m.get_score(i)) for i in plain}, byte_ids)

    @classmethod
    def of_worker(cls, path: str) -> Pieces:
        return per_worker(("pieces", path), lambda: cls.from_model(path))

    def viterbi(self, s: str) -> list[int]:
        """Ids of the best path over s (blanks already written as U+2581). Ties go to the piece that begins first."""
        n, single, spelt = len(s), self.single, self.spelt
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        done = 0
        for end, (length, score, i) in self.auto.iter(s):
            e = end + 1
            while done < e:  # before any piece that ends here: spell the character
                done += 1
                best[done] = best[done - 1] + spelt if s[done - 1] not in single else float("-inf")
            total = best[e - length] + score
            if total > best[e] or (total == best[e] and back[e] is not None and length > back[e][0]):
                best[e], back[e] = total, (length, i)
        while done < n:
            done += 1
            best[done] = best[done - 1] + spelt
        out: list[int] = []
        while n:
            if back[n] is None:
                out.extend(self.byte_ids[b] for b in reversed(s[n - 1].encode()))
                n -= 1
            else:
                length, i = back[n]
                out.append(i)
                n -= length
        return out[::-1]

    def _segment(self, seg: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(seg.split(BLANK)):
            if k:
                out += [self.byte_ids[b] for b in BLANK.encode()]
            if part:
                out += self.viterbi(part.replace(" ", BLANK))
        return out

    def encode(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids of the whole text."""
        if not text:
            return np.zeros(0, dtype="<u4")
        segs = self.cut.findall(f" {text}" if self.dummy_prefix else text)
        known = self.known
        parts = []
        for s in segs:
            if (raw := known.get(s)) is None:
                raw = np.array(self._segment(s), dtype="<u4").tobytes()
                if len(s) <= 64:  # long runs seldom come again
                    known.keep(s, raw)
            parts.append(raw)
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode()
        return text[1:] if self.dummy_prefix and len(ids) else text


class _Encode:
    def __init__(self, model: str, ids: bool):
        self.model, self.ids = model, ids

    def start(self):
        coder = Pieces.of_worker(self.model)
        lo, hi = min(coder.byte_ids), max(coder.byte_ids)

        def call(texts: list) -> dict:
            got = [None if t is None else coder.encode(t) for t in texts]
            same = [None if t is None else coder.decode(g) == t for t, g in zip(texts, got)]
            made = {
                "r_pieces": pa.array([0 if g is None else len(g) for g in got], pa.int64()),
                "r_bytes": pa.array([0 if g is None else int(((g >= lo) & (g <= hi)).sum()) for g in got], pa.int64()),
                "r_crc": pa.array([None if g is None else crc32(g.tobytes()) for g in got], pa.int64()),
                "r_same": pa.array(same, pa.bool_()),
            }
            if self.ids:
                made["r_ids"] = pa.array([None if g is None else g.astype("i4") for g in got], pa.list_(pa.int32()))
            return made

        return call


def encode(df: DataFrame, model: str, key_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per row: key, n_pieces, n_spelt (byte pieces among them), ids_crc32 (ids as little-endian unsigned 32-bit), round_trip
    (decoding the ids gives the text back) and, on demand, piece_ids.

    A map without a shuffle. A null text has 0 pieces and null checksum, round_trip and piece_ids; an empty text has
    no pieces and round-trips. Whole texts of any length are encoded. Rows that repeat stay rows; no rows give no rows.
    Columns are taken by position, so others may have any name; a result called like the key gets an underscore.
    """
    out = map_texts(df, text_col, _Encode(model, ids), "r_pieces long, r_bytes long, r_crc long, r_same boolean" + ", r_ids array<int>" * ids, [key_col])
    names = {"r_pieces": "n_pieces", "r_bytes": "n_spelt", "r_crc": "ids_crc32", "r_same": "round_trip", "r_ids": "piece_ids"}
    return keyed(out, key_col, {n: F.col(c) for c, n in names.items() if c in out.columns}, F.col("k0"))


def decode(df: DataFrame, model: str, key_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """Per row: key and the text that the ids spell.

    Null ids give null, no ids the empty text; ids that are none of the model's, or bytes that are no UTF-8, are an error.
    Rows that repeat stay rows; no rows give no rows. A key called text makes the result text_.
    """
    key, ids = (F.col(f"k{i}") for i in positions(df, key_col, ids_col))
    source = numbered(df).select(key.alias("k"), ids.cast("array<int>").alias("ids"))

    def run(batches):
        coder = Pieces.of_worker(model)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, dtype="<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    out = source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, text string")
    return keyed(out, key_col, {"text": F.col("text")}, F.col("k"))
