"""Token counts: lengths only leave the workers; the ids themselves are never kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, map_texts
from .tokens import BytePieceCounts


class _Counts:
    def __init__(self, tokenizer: str):
        self.tokenizer = tokenizer

    def start(self):
        coder = BytePieceCounts.of_worker(self.tokenizer)

        def call(texts: list) -> dict:
            return {
                "r_bytes": pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                "r_tokens": pa.array(coder.count(texts), pa.int64()),
            }

        return call


def count(df: DataFrame, tokenizer: str, key_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens of the whole text and over_limit (n_tokens > limit).

    A map without a shuffle. Null and empty texts have 0 bytes and 0 tokens. Very long texts are cut at boundaries
    that no token crosses, so the count is that of the whole text. Rows that repeat stay rows; no rows give no rows.
    Columns are taken by position, so others may have any name; a result called like the key gets an underscore.
    """
    out = map_texts(df, text_col, _Counts(tokenizer), "r_bytes long, r_tokens long", [key_col])
    return keyed(out, key_col, {"n_bytes": F.col("r_bytes"), "n_tokens": F.col("r_tokens"), "over_limit": F.col("r_tokens") > limit}, F.col("k0"))
