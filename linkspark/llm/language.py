"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled running text is built. A text is cross-parsed against each: phrases are
longest matches, over words and blanks alike, so the number of phrases times the bits of a pointer into that language's
text, per character, estimates the cross entropy of the text under the language (Ziv and Merhav). The language that
needs the fewest normalised phrases wins.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import fold_col, keyed, map_texts, numbered, positions
from .tokens import per_worker

_WORD = re.compile(r"[^\W\d_]+")

#: Share of the phrases that fit a language from which a text counts as written in it (see Parser.fit).
LEAST_FIT = 0.8


def plain(text: str | None) -> str:
    """The running text that is parsed: lower-cased words of letters, one blank before, between and after them; empty without a letter."""
    words = _WORD.findall(text.lower()) if text else []
    return f" {' '.join(words)} " if words else ""


@dataclass(frozen=True)
class Languages:
    """Per language, those with more labelled rows first: its labelled texts (as plain), and how many phrases a character of such text takes."""

    texts: dict[str, tuple[str, ...]]
    rates: dict[str, float]


class Parser:
    """Cross-parses against the labelled text of each language (name -> texts as plain makes them).

    The automata of all languages form one table, state and symbol -> state, so that a batch of texts takes a step under
    every language at once; the few texts of a batch that are much longer than the others are finished one by one.
    """

    def __init__(self, texts: dict[str, tuple[str, ...]], rates: dict[str, float] | None = None):
        self.names = list(texts)
        self.rates = rates or {}
        alphabet = sorted({c for v in texts.values() for t in v for c in t})
        self.width = len(alphabet) + 1  # the last code: a symbol of no language
        self.codes = np.full(0x110000, self.width - 1, dtype=np.uint16)
        self.codes[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        self.bits, roots, parts, held = [], [], [], 0
        for k in self.names:  # one automaton at a time: as objects it takes far more room than as a table
            # A mark between texts that no plain text holds: no phrase runs from one text into another.
            machine = SuffixAutomaton().extend("\n".join(texts[k]))
            self.bits.append(math.log2(machine.size + 2))  # to name a place in this language's text
            part = np.full((len(machine.next), self.width), -1, dtype=np.int32)
            for state, after in enumerate(machine.next):
                for c, to in after.items():
                    if c != "\n":
                        part[state, self.codes[ord(c)]] = held + to
            roots.append(held)
            held += len(part)
            parts.append(part.reshape(-1))
        self.roots = np.array(roots, dtype=np.int64)
        self.flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def phrases(self, symbols: str) -> list[int]:
        return self.all_phrases([symbols])[0].tolist()

    def all_phrases(self, texts: list[str], least: int = 48) -> np.ndarray:
        """The phrases of plain texts (rows) under each language: longest matches, or single unseen symbols."""
        n, k, width = len(texts), len(self.names), self.width
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        symbols = self.codes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        starts, ends = (np.cumsum(lengths) - lengths)[order], np.sort(lengths)
        state = np.tile(self.roots[:, None], (1, n))
        count = np.zeros((k, n), dtype=np.int64)
        root = self.roots[:, None]
        t, live = 0, n
        while True:
            live = n - int(np.searchsorted(ends, t, side="right"))  # texts longer than t come first
            if live < least:
                break
            c = symbols[starts[:live] + t].astype(np.int64)
            now = state[:, :live]
            after = self.flat[now * width + c]
            ended = after < 0
            # The phrase ends before c; c begins the next one, or is one of its own if the language never has it.
            again = self.flat[root * width + c]
            alone = ended & (again < 0)
            count[:, :live] += (ended & (now != root)) + alone.astype(np.int64)
            state[:, :live] = np.where(ended, np.where(alone, root, again), after)
            t += 1
        for i in range(live):
            rest = symbols[starts[i] + t : starts[i] + lengths[order[i]]].tolist()
            for j in range(k):
                state[j, i], more = self._finish(int(state[j, i]), int(self.roots[j]), rest)
                count[j, i] += more
        count += state != root
        out = np.empty((n, k), dtype=np.int64)
        out[order] = count.T
        return out

    def _finish(self, state: int, root: int, codes: list[int]) -> tuple[int, int]:
        count, table, width = 0, memoryview(self.flat), self.width
        at_root = root * width
        for c in codes:
            after = table[state * width + c]
            if after < 0:
                count += state != root
                after = table[at_root + c]
                if after < 0:
                    count += 1
                    after = root
            state = after
        return state, count

    def fit(self, name: str, phrases: int, chars: int) -> float:
        """1 if the text takes no more phrases than text of the language does (with four deviations of chance and two phrases for short texts), else their ratio."""
        if not (rate := self.rates.get(name)):
            return 1.0
        usual = rate * chars
        return min(1.0, (usual + 4 * math.sqrt(usual) + 2) / max(1, phrases))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Per text the winning language, the posterior of its code length against the others', and its fit. A tie goes to the language with more labelled rows."""
        symbols = [plain(t) for t in texts]
        some = [i for i, s in enumerate(symbols) if s] if self.names else []
        out = [("und", 0.0, 0.0)] * len(texts)
        for i, counts in zip(some, self.all_phrases([symbols[i] for i in some]).tolist() if some else []):
            cost = [n * b for n, b in zip(counts, self.bits)]
            best = min(range(len(cost)), key=cost.__getitem__)
            name = self.names[best]
            out[i] = name, 1.0 / sum(2.0 ** max(-1000.0, cost[best] - c) for c in cost), self.fit(name, counts[best], len(symbols[i]))
        return out


class _Predict:
    def __init__(self, shared):
        self.shared = shared  # a broadcast of bounded size

    def start(self):
        known: Languages = self.shared.value
        parser = per_worker(("parser", hashlib.sha256(repr(known).encode()).hexdigest()), lambda: Parser(known.texts, known.rates))

        def call(texts: list) -> dict:
            got = parser.predict_all(texts)
            return {"r_lang": pa.array([g[0] for g in got], pa.string()), "r_score": pa.array([g[1] for g in got], pa.float64()), "r_fit": pa.array([g[2] for g in got], pa.float64())}

        return call


def learn(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 200, train_chars: int = 50_000, most_text: int = 10_000) -> Languages:
    """Labelled texts per non-null language, from rows outside fold 0.

    The sample is bounded: about sample_docs rows per language by a hash of key and text (rows that agree in both count
    once), of which whole texts are taken in hash order until they hold train_chars characters; texts of more than
    most_text bytes come after all others, so at most train_chars + most_text characters are fetched for a language that
    has shorter ones. Only these texts reach the driver. Prediction reads everything.

    Labels may be wrong: each half of a language's sample is parsed against the other halves of all languages, and
    texts that another language explains better are left out. The same parses give the phrases per character.
    """
    k, t, lang = (F.col(f"k{i}") for i in positions(df, key_col, text_col, lang_col))
    rows = numbered(df).select(k.alias("key"), t.cast("string").alias("t"), lang.cast("string").alias("l")).filter(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}") & (fold_col(F.col("key")) != 0))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Languages({}, {})
    scale = 1 << 30
    rows = rows.withColumn("h", F.xxhash64("key", "t", F.lit(7)))
    rate = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(scale, -(-scale * sample_docs // n)))])
    drawn = rows.filter(F.pmod("h", F.lit(scale)) < rate[F.col("l")])
    sizes = drawn.groupBy("l", "h").agg(F.max(F.octet_length("t")).alias("n")).collect()
    taken: list[int] = []
    held: dict[str, int] = defaultdict(int)
    for r in sorted(sizes, key=lambda r: (r["l"], r["n"] > most_text, r["h"])):
        if held[r["l"]] < train_chars and (r["n"] <= most_text or not held[r["l"]]):
            held[r["l"]] += r["n"]
            taken.append(r["h"])
    fetched = drawn.filter(F.col("h").isin(taken)).groupBy("l", "h").agg(F.min("t").alias("t")).collect()
    texts: dict[str, list[str]] = defaultdict(list)
    for r in sorted(fetched, key=lambda r: (r["l"], r["h"])):
        if symbols := plain(r["t"]):
            texts[r["l"]].append(symbols)
    return settle({name: texts[name] for name in sorted(texts, key=lambda x: (-counts[x], x))})


def settle(texts: dict[str, list[str]]) -> Languages:
    """Leave out texts whose label another language's text contradicts, and take each language's phrases per character."""
    halves = [Parser({name: tuple(v[i::2] or v) for name, v in texts.items()}) for i in (0, 1)]
    kept: dict[str, tuple[str, ...]] = {}
    rates: dict[str, float] = {}
    for at, (name, v) in enumerate(texts.items()):
        good, phrases = [], 0
        for i in (0, 1):
            judge = halves[1 - i]
            for t, counts in zip(v[i::2], judge.all_phrases(v[i::2]).tolist() if v[i::2] else []):
                if min(range(len(counts)), key=lambda x: counts[x] * judge.bits[x]) == at:  # noqa: B023
                    good.append(t)
                    phrases += counts[at]
        kept[name] = tuple(good or v)
        if len(good) > 1:
            rates[name] = phrases / sum(map(len, good))
    return Languages(kept, rates)


def predict(df: DataFrame, known: Languages, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (k0, k1, ... in their order), r_lang, r_score (0 to 1) and r_fit (0 to 1; see Parser.fit).

    A map without a shuffle; what is broadcast is the bounded labelled text. A text that is null or has no letter gets
    'und', 0 and 0. Whole texts are parsed. Rows that repeat stay rows; no rows give no rows; with nothing learned every
    text is 'und'.
    """
    shared = df.sparkSession.sparkContext.broadcast(known)
    return map_texts(df, text_col, _Predict(shared), "r_lang string, r_score double, r_fit double", df.columns if keep is None else keep)


def identify(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from df and predict each of its rows: key, held_out (fold 0), lang_pred, score, fit. See learn and predict.

    Columns are taken by position, so others may have any name; a result called like the key gets an underscore.
    """
    out = predict(df, learn(df, key_col, text_col, lang_col), text_col, [key_col])
    k = F.col("k0")
    return keyed(out, key_col, {"held_out": fold_col(k) == 0, "lang_pred": F.col("r_lang"), "score": F.col("r_score"), "fit": F.col("r_fit")}, k)


def spoken(df: DataFrame, known: Languages, text_col: str = "text", least_score: float = 0.3, least_fit: float = LEAST_FIT) -> DataFrame:
    """The rows of df, all columns as they are, with a letter, a language told apart from the others and a text that fits it.

    least_score: below it, at least four languages explain the text about equally well. least_fit: a text of a language
    that was not learned takes more phrases than texts of the one that wins.
    """
    out = predict(df, known, text_col)
    return out.filter((F.col("r_lang") != "und") & (F.col("r_score") >= least_score) & (F.col("r_fit") >= least_fit)).select(*[f"k{i}" for i in range(len(df.columns))]).toDF(*df.columns)
