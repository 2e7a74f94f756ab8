"""Quality classifier: a sparse rule ensemble (RuleFit) over text statistics.

Small regression trees are boosted on labelled rows; every path from a root to a node becomes a conjunctive rule; an
L1-penalised logistic regression weighs the rules and most weights become zero. The rules left are compiled into one
Spark column expression, so scoring needs no model object on the workers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_col, keyed, map_texts, materialise, numbered, positions

FEATURES = [
    "log_words", "mean_word", "max_word", "upper_share", "digit_share", "symbol_share", "bang_share", "pipe_share", "stop_share",
    "other_share", "line_words", "dup_line_share", "distinct_share", "repeat_share", "lower_line_share", "symbol_words",
]
_LOWER_LINE = re.compile(r"^[a-zà-öø-ÿ]", re.M)
_SYMBOL_END = re.compile(r"[#*$%&!|<>](?=\s|\Z)")


def statistics(text: str | None) -> tuple[float, ...]:
    """The features of a whole text, each in one pass of compiled code; an empty text is all zeros."""
    if not text or not (words := text.split()):
        return (0.0,) * len(FEATURES)
    raw = text.encode()
    n = len(raw)
    by = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    m = len(words)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], words[2:])))
    return (
        float(np.log1p(m)), (len(text) - m) / m, float(max(map(len, words))), by[65:91].sum() / n, by[48:58].sum() / n,
        by[[35, 36, 37, 38, 42, 60, 62]].sum() / n, by[33] / n, by[124] / n, by[46] / m,
        by[128:].sum() / n, m / len(lines), 1.0 - len(set(lines)) / len(lines), distinct / m, 1.0 - pairs / max(1, m - 2) if m > 2 else 0.0,
        len(_LOWER_LINE.findall(text)) / len(lines), len(_SYMBOL_END.findall(text)) / m,
    )


def _statistics(texts: list) -> dict:
    rows = [statistics(t) for t in texts]
    return {f"r_{k}": pa.array([float(r[k]) for r in rows], pa.float64()) for k in range(len(FEATURES))}


#: The columns of the features; those of the caller are numbered, so that the two never clash.
NAMES = [f"r_{k}" for k in range(len(FEATURES))]


def with_statistics(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns, called k0, k1, ... in their order, and one column per feature, called as in NAMES."""
    return map_texts(df, text_col, _statistics, ", ".join(f"{n} double" for n in NAMES), keep)


@dataclass(frozen=True)
class Rule:
    """weight applies where every condition (feature, above, threshold) holds: value > threshold if above, else value <= threshold."""

    conditions: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, above, t in self.conditions:
            out &= (x[:, f] > t) if above else (x[:, f] <= t)
        return out

    def column(self, names: list[str]) -> Column:
        out = None
        for f, above, t in self.conditions:
            c = F.col(names[f]) > F.lit(t) if above else F.col(names[f]) <= F.lit(t)
            out = c if out is None else out & c
        return out


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r in self.rules:
            z = z + r.weight * r.holds(x)
        return 1.0 / (1.0 + np.exp(-z))

    def column(self, names: list[str]) -> Column:
        z = F.lit(float(self.intercept))
        for r in self.rules:
            z = z + F.when(r.column(names), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, bins: list[np.ndarray], coded: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, path: tuple, rows: np.ndarray, out: list, values: np.ndarray, rate: float) -> None:
    """Split rows by the best gain in squared gradient over hessian; every path is appended to out."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for f in range(x.shape[1]):
            k = len(bins[f])
            if not k:
                continue
            code = coded[rows, f]
            sg = np.cumsum(np.bincount(code, g[rows], k + 1))[:-1]
            sh = np.cumsum(np.bincount(code, h[rows], k + 1))[:-1]
            n = np.cumsum(np.bincount(code, minlength=k + 1))[:-1]
            gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            gain[(n < least) | (len(rows) - n < least)] = -1
            if gain[at := int(np.argmax(gain))] > best[0]:
                best = (gain[at], (f, at))
    if best[1] is None:
        values[rows] += rate * total_g / (total_h + 1)
        return
    f, at = best[1]
    t = float(bins[f][at])
    low = coded[rows, f] <= at
    for above, part in ((False, rows[low]), (True, rows[~low])):
        longer = (*path, (f, above, t))
        out.append(longer)
        _grow(x, bins, coded, g, h, depth - 1, least, longer, part, out, values, rate)


def tidy(path: tuple) -> tuple:
    """One condition per feature and direction: the tightest."""
    tight: dict[tuple[int, bool], float] = {}
    for f, above, t in path:
        old = tight.get((f, above))
        tight[f, above] = t if old is None else (max(old, t) if above else min(old, t))
    return tuple((f, above, t) for (f, above), t in sorted(tight.items()))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, rounds: int = 400) -> Model:
    """Boost trees, take their paths as rules, weigh them by lasso logistic regression (accelerated proximal gradient)."""
    if not len(y):
        return Model(0.0, ())
    p = float(np.clip(y.mean(), 0.001, 0.999))
    if y.min() == y.max():
        return Model(float(np.log(p / (1 - p))), ())
    bins = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49), method="lower")) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(bins[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    z = np.full(len(y), np.log(p / (1 - p)))
    paths: list[tuple] = []
    least = max(5, len(y) // 500)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        _grow(x, bins, coded, y - q, q * (1 - q), depth, least, (), np.arange(len(y)), paths, z, 0.3)
    rules = [Rule(c) for c in sorted({tidy(c) for c in paths})]
    if not rules:  # too few rows to split
        return Model(float(np.log(p / (1 - p))), ())
    held = np.stack([r.holds(x) for r in rules], axis=1)
    _, first = np.unique(held, axis=1, return_index=True)  # rules that hold on the same rows are one rule
    rules = [rules[i] for i in sorted(first.tolist())]
    m = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    scale = np.maximum(m.std(axis=0), 0.02)
    a = (m - m.mean(axis=0)) / scale
    step = 4.0 * len(y) / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w, b, v, c, t = np.zeros(a.shape[1]), np.log(p / (1 - p)), np.zeros(a.shape[1]), np.log(p / (1 - p)), 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ v + c))) - y
        new = v - step * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0.0)
        new_b = c - min(step, 4.0) * r.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    weights = w / scale
    return Model(float(b - (weights * m.mean(axis=0)).sum()), tuple(Rule(r.conditions, float(k)) for r, k in zip(rules, weights) if k))


def _labelled(labels: DataFrame, label_key: str, label_col: str) -> DataFrame:
    """l_key and l_y of labelled rows outside fold 0; what is neither 0 nor 1 and null keys are left out."""
    k, y = (F.col(f"k{i}") for i in positions(labels, label_key, label_col))
    lab = numbered(labels).select(k.alias("l_key"), y.cast("int").alias("l_y"))
    return lab.filter(F.col("l_y").isin(0, 1) & F.col("l_key").isNotNull() & (fold_col(F.col("l_key")) != 0))


def _below(h: Column, n: int, most: int) -> Column:
    """True for about `most` of n rows, by hash."""
    scale = 1 << 30
    return F.pmod(h, F.lit(scale)) < min(scale, -(-scale * most // max(1, n)))


def learn(texts: DataFrame, text_col: str, labels: DataFrame, key_col: str, label_key: str = "doc_id", label_col: str = "quality", most_rows: int = 20_000) -> Model:
    """Fit on labelled rows outside fold 0.

    The documented bound of the sample: about most_rows label rows by key hash, then about most_rows of the rows of
    texts that have such a key, by a hash of key and text; rows that agree in key, text and label count once. Only the
    statistics of that sample reach the driver.
    """
    lab = _labelled(labels, label_key, label_col).distinct()
    lab = materialise(lab.filter(_below(F.xxhash64("l_key", F.lit(11)), lab.count(), most_rows)), "labels")
    key, text = (F.col(f"k{i}") for i in positions(texts, key_col, text_col))
    # The sample of labels is bounded by most_rows: it goes to the texts, which stay where they are.
    both = numbered(texts).select(key.alias("key"), text.alias("text")).join(F.broadcast(lab), F.col("key") == F.col("l_key")).select("l_key", "l_y", F.xxhash64("text").alias("h"), "text")
    stats = materialise(with_statistics(both, "text", ["l_key", "l_y", "h"]).distinct(), "labelled")
    rows = stats.filter(_below(F.xxhash64("k0", "k2", F.lit(13)), stats.count(), most_rows)).toPandas().sort_values(["k0", "k1", "k2"])
    return fit(rows[NAMES].to_numpy(dtype=np.float64), rows["k1"].to_numpy(dtype=np.float64))


def classify(df: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: key, held_out (fold 0), score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    The fit reads the texts of its bounded sample only (see learn); then one map over the whole texts scores them
    without a shuffle. Null and empty texts have all-zero statistics and are scored like any other row. Null keys are
    never trained on. Without labels every score is 0.5; with labels of one kind, near that kind. Rows that repeat stay
    rows; no rows give no rows. Columns are taken by position, so others may have any name; a result called like the
    key gets an underscore.
    """
    model = learn(df, text_col, labels, key_col)
    scored = with_statistics(df, text_col, [key_col]).select("k0", model.column(NAMES).alias("score"))
    return keyed(scored, key_col, {"held_out": fold_col(F.col("k0")) == 0, "score": F.col("score"), "predicted": (F.col("score") >= threshold).cast("int")}, F.col("k0"))


def passing(df: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of df, all columns as they are and whatever they are called, whose score reaches the threshold; learned and scored as in classify."""
    model = learn(df, text_col, labels, key_col)
    stats = with_statistics(df, text_col, df.columns)
    return stats.filter(model.column(NAMES) >= threshold).select(*[f"k{i}" for i in range(len(df.columns))]).toDF(*df.columns)
