"""Near-duplicate classes by DartMinHash signatures and banded joins.

DartMinHash (Christiani 2020): every (element, weight region) throws darts at random times; a dart that lands inside
the element's weight and before the document's horizon counts; each coordinate keeps its earliest dart. Two documents
agree on a coordinate with the probability of their weighted Jaccard similarity. The number of darts per document does
not depend on its length, so signatures are cheap for long texts. Here the arrivals of a region are a Poisson stream
drawn from the element's hash, so they are the same in every document that holds the element.

Bands of coordinates are hashed; documents that share a band are candidates, and every candidate link is checked by the
exact Jaccard similarity of the shingle sets. Links are made without emitting the pairs of a band: each member is held
against the band's least member; then the documents of bands that still hold several classes meet across classes in a
join filtered by prefixes and sketches of their sets (neither leaves out a similar pair), whose candidates are checked in turn.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, ascii_lower, keyed, map_arrow, map_texts, materialise, numbered, positions, sliced
from .tokens import BoundedCache, per_worker

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = (1, 3, 12)  # arrivals drawn at a time: fixed, so that sums of gaps round alike in every document


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Darts:
    """Signatures of `k` coordinates for many weighted sets at once."""

    def __init__(self, k: int):
        self.k = k
        self.darts = k * (math.log(k) + 2.0)  # expected darts that fill nearly all coordinates

    def signatures(self, doc: np.ndarray, element: np.ndarray, weight: np.ndarray | None, n_docs: int) -> np.ndarray:
        """doc: the set's number per element (0 to n_docs - 1, every set has one element at least); element: 64-bit hashes; weight: above 0, or None for 1."""
        k = self.k
        best = np.full(n_docs * k, np.inf)
        sig = np.zeros(n_docs * k, dtype=np.uint64)
        if weight is None:
            mass = np.bincount(doc, minlength=n_docs).astype(np.float64)
            regions = [(doc, mix(element + _GOLD), 1.0, None, None)]
        else:
            mass = np.bincount(doc, weight, minlength=n_docs)
            regions = []
            level = 0
            while (inside := weight > (start := 2.0**level - 1)).any():
                # Region `level` spans weights [2^level - 1, 2^(level+1) - 1): darts come 2^level times as fast.
                salt = np.uint64(int(_GOLD) * (level + 1) & 0xFFFFFFFFFFFFFFFF)
                regions.append((doc[inside], mix(element[inside] + salt), 2.0**level, weight[inside], start))
                level += 1
        horizon = self.darts / mass
        todo = np.ones(n_docs, dtype=bool)
        since = np.zeros(n_docs)
        while todo.any():
            for r_doc, r_seed, rate, r_weight, start in regions:
                use = todo[r_doc]
                self._throw(r_doc[use], r_seed[use], rate, None if r_weight is None else r_weight[use], start, since, horizon, best, sig)
            # A coordinate that no dart has hit needs a longer horizon; what came before stays.
            empty = ~np.isfinite(best.reshape(n_docs, k)).all(axis=1)
            todo &= empty
            since = np.where(todo, horizon, since)
            horizon = np.where(todo, horizon * 2, horizon)
        return sig.reshape(n_docs, k)

    def _throw(self, doc, seed, rate, weight, start, since, horizon, best, sig) -> None:
        k = np.uint64(self.k)
        at = np.zeros(len(doc))
        drawn, block = 0, 0
        while len(doc):
            width = _BLOCKS[min(block, len(_BLOCKS) - 1)]
            h = mix(seed[:, None] + _GOLD * np.arange(drawn + 1, drawn + width + 1, dtype=np.uint64)[None, :])
            time = at[:, None] + np.cumsum(-np.log(uniform(h)) / rate, axis=1)
            hit = (time <= horizon[doc][:, None]) & (time > since[doc][:, None])
            h2 = mix(h ^ _M1)
            if weight is not None:
                hit &= start + uniform(mix(h ^ _M2)) * rate < weight[:, None]
            row, col = np.nonzero(hit)
            cell = doc[row] * self.k + (h2[row, col] % k).astype(np.int64)
            when, dart = time[row, col], h[row, col]
            before = best[cell]
            near = when < before
            cell, when, dart = cell[near], when[near], dart[near]
            np.minimum.at(best, cell, when)
            won = best[cell] == when
            sig[cell[won]] = dart[won]
            more = time[:, -1] <= horizon[doc]
            doc, seed, at = doc[more], seed[more], time[more, -1]
            weight = None if weight is None else weight[more]
            drawn += width
            block += 1


class Shingles:
    """64-bit hashes of the runs of `size` words of a text; a text of fewer words, but not none, is one shingle."""

    def __init__(self, size: int = 5, most: int = 200_000):
        self.size = size

        class Hashes(BoundedCache):
            def __missing__(self, w: str) -> int:
                return self.keep(w, xxhash.xxh3_64_intdigest(w))

        self.hashes = Hashes(most)

    @classmethod
    def of_worker(cls) -> Shingles:
        return per_worker("shingles", cls)

    def of(self, text: str | None) -> np.ndarray:
        """All shingles, in order, with repeats."""
        words = WORD_RE.findall(ascii_lower(text)) if text else []
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(h) - self.size + 1)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(min(self.size, len(h))):
            out = mix(out + _GOLD + h[k : k + n])
        return out

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.of(text), return_counts=True)


def _keys_and_texts(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """k (the key in its own type) and t (the text)."""
    key, text = positions(df, key_col, text_col)
    return numbered(df).select(F.col(f"k{key}").alias("k"), F.col(f"k{text}").cast("string").alias("t"))


def signature_table(source: DataFrame, bands: int, rows: int, weighted: bool) -> DataFrame:
    """Of rows (k, t): k, content (128-bit hash of the sorted shingle set, null without words), n (distinct shingles), bands (one hash per band)."""

    def run(batches):
        shingles, darts = Shingles.of_worker(), Darts(bands * rows)
        salt = (np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)[None, :]
        for batch in batches:
            for part in sliced(batch, 1, 1_000_000):
                for lo in range(0, part.num_rows, 256):
                    piece = part.slice(lo, 256)
                    sets = [shingles.counted(t) for t in piece.column(1).to_pylist()]
                    full = [i for i, (e, _) in enumerate(sets) if len(e)]
                    keys: list = [None] * len(sets)
                    content: list = [None] * len(sets)
                    if full:
                        doc = np.repeat(np.arange(len(full)), [len(sets[i][0]) for i in full])
                        element = np.concatenate([sets[i][0] for i in full])
                        weight = np.concatenate([sets[i][1] for i in full]).astype(np.float64) if weighted else None
                        sig = darts.signatures(doc, element, weight, len(full)).reshape(len(full), bands, rows)
                        band = np.zeros((len(full), bands), dtype=np.uint64) + salt
                        for r in range(rows):
                            band = mix(band + _GOLD + sig[:, :, r])
                        band = band.view(np.int64)
                        for j, i in enumerate(full):
                            keys[i] = band[j]
                            content[i] = xxhash.xxh3_128_digest(sets[i][0].tobytes() + (sets[i][1].tobytes() if weighted else b""))
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0), pa.array(content, pa.binary()), pa.array([len(e) for e, _ in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                        names=["k", "content", "n", "bands"],
                    )

    return map_arrow(source, run, f"k {source.schema['k'].dataType.simpleString()}, content binary, n int, bands array<long>")


def shingle_sets(source: DataFrame) -> DataFrame:
    """Of rows (k, t): k and s, the sorted distinct shingle hashes (none for a null text or one without words)."""

    def run(batches):
        shingles = Shingles.of_worker()
        for batch in batches:
            for part in sliced(batch, 1, 1_000_000):
                sets = [shingles.counted(t)[0].view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["k", "s"])

    return map_arrow(source, run, f"k {source.schema['k'].dataType.simpleString()}, s array<long>")


def contents(df: DataFrame, text_col: str) -> DataFrame:
    """df by position (k0, k1, ...) and content: the hash of the sorted shingle set, as in signature_table; null without words."""

    def of(texts: list) -> dict:
        shingles = Shingles.of_worker()
        sets = [shingles.counted(t)[0] for t in texts]
        return {"content": pa.array([xxhash.xxh3_128_digest(e.tobytes()) if len(e) else None for e in sets], pa.binary())}

    return map_texts(df, text_col, of, "content binary", df.columns)


def classes(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Connected components of links (a, b): one row (node, class) per node that has a link to another; class is the least node.

    Repeated links, links both ways and links to oneself change nothing; no links give no rows. Ids of any type with an order.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes; each round is a written
    table, and a hot node is summed before the shuffle.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    for _ in range(most_rounds):
        # Large-star: every node's larger neighbours are linked to its least neighbour.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small-star: a node and its smaller neighbours are linked to the least of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        after = materialise(small, "links")
        same = after.join(edges, ["a", "b"], "left_anti").limit(1).count() == 0 and after.count() == edges.count()
        edges = after
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("class")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("class")).distinct())


def _alike(n_a: Column, n_b: Column, similarity: float) -> Column:
    """Sets whose sizes differ by more than the similarity allows can't be that similar."""
    return F.least(n_a, n_b) >= F.lit(similarity) * F.greatest(n_a, n_b) - F.lit(1e-9)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets (k, s) have at least the similarity.

    A key may come with several sets: any of them makes the link. A pair with a key that has no set is left out, as is
    one with an empty set; repeated pairs come out once; no pairs give no pairs.
    """
    left = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("s_a")), "a")
    both = left.join(sets.select(F.col("k").alias("b"), F.col("s").alias("s_b")), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter((shared > 0) & (shared >= F.lit(similarity) * (F.size("s_a") + F.size("s_b") - shared) - F.lit(1e-9))).select("a", "b").distinct()


#: Bits of a sketch.
SKETCH_BITS = 1024


def sketches(sets: DataFrame) -> DataFrame:
    """Per set (k, s) the parities of its elements by bit, as longs b0, b1, ...: two sets differ in at least as many elements as their sketches in bits.

    An empty set has no bits. Rows that repeat stay rows; s is never null (shingle_sets makes none).
    """
    words = SKETCH_BITS // 64
    names = [f"b{i}" for i in range(words)]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                s = [mix(np.array(x, dtype=np.int64).view(np.uint64)) % np.uint64(SKETCH_BITS) for x in part.column(1).to_pylist()]
                odd = np.array([np.bincount(x.astype(np.int64), minlength=SKETCH_BITS) & 1 for x in s], dtype=np.uint8)
                bits = np.packbits(odd, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(bits[:, i].copy()) for i in range(words)]], names=["k", *names])

    return map_arrow(sets.select("k", "s"), run, f"k {sets.schema['k'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) among sets (k, c, s) of different classes c, none left out that could be similar.

    Elements are ordered by rarity among the sets. Two similar sets share an element among the first n - ceil(t n) + 1 of
    either, and at the first one they share enough elements are left for the overlap they need. Elements that one class
    alone has in its prefixes pair nothing, so a large class meets itself nowhere. Sets that share the rare traces of an
    edit but little else are told apart within the join by their sketches: as bits differ only where elements do, a pair
    with more differing bits than a similar pair may have differing elements is left out, and never one that is similar.
    Sets beyond about SKETCH_BITS / 2 * (1 + t) / (1 - t) / 2 elements are hardly told apart by it and go to the exact check.
    Keys stand once, sets are not empty; sets of one class only, or none, give no pairs.
    """
    each = sets.select("k", "c", F.size("s").alias("n"), F.explode("s").alias("e"))
    rarity = each.groupBy("e").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(rarity, "e").groupBy("k", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("o"))
    length = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9)).cast("int") + 1
    prefix = materialise(ordered.select("k", "c", "n", F.posexplode(F.slice("o", F.lit(1), length)).alias("at", "x")).select("k", "c", "n", "at", F.col("x.e").alias("e")), "prefixes")
    mixed = prefix.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("e")
    p = prefix.join(mixed, "e", "left_semi").join(materialise(sketches(sets), "sketches"), "k")
    bits = [c for c in p.columns if c.startswith("b")]
    x, y = (p.select(F.col("e").alias(f"e{i}"), *[F.col(c).alias(f"{c}_{i}") for c in ("k", "c", "n", "at", *bits)]) for i in (1, 2))
    need = F.lit(similarity / (1 + similarity)) * (F.col("n_1") + F.col("n_2")) - F.lit(1e-9)
    left = F.least(F.col("n_1") - F.col("at_1"), F.col("n_2") - F.col("at_2"))  # this element and those after it
    differ = sum((F.bit_count(F.col(f"{c}_1").bitwiseXOR(F.col(f"{c}_2"))) for c in bits), F.lit(0))
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("n_1") + F.col("n_2")) + F.lit(1e-9)
    met = x.join(y, (F.col("e1") == F.col("e2")) & (F.col("k_1") < F.col("k_2")) & (F.col("c_1") != F.col("c_2")) & _alike(F.col("n_1"), F.col("n_2"), similarity) & (left >= need) & (differ <= most))
    return met.select(F.col("k_1").alias("a"), F.col("k_2").alias("b")).distinct()


def near_duplicates(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, bands: int = 32, rows: int = 6, weighted: bool = False) -> DataFrame:
    """One row per row of df: key and class_id, the least key of the documents that links of at least `similarity` join.

    Similarity is the Jaccard similarity of the sets of five-word shingles (words of ASCII-lower-cased letters and digits
    and anything beyond ASCII; fewer than five words are one shingle). With 32 bands of 6 coordinates a link of exactly 0.8
    is a candidate with probability 0.99994, and more above. `weighted` draws candidates by the weighted similarity
    of shingle counts instead; the links are then those whose sets also reach the similarity.

    Keys are of any type that has an order. Rows of equal shingle sets are one node. Rows that repeat a key are one
    document: whatever is linked to one of their texts shares their class. A text without words (null, empty,
    punctuation) is alone: its class is its key. Rows without a key are classed by their content and never name a class,
    unless no row of it has a key: then class_id is null. No rows give no rows. Columns are taken by position, so others
    may have any name; a key called class_id makes the result class_id_.
    """
    source = _keys_and_texts(df, key_col, text_col)
    sig = materialise(signature_table(source, bands, rows, weighted), "signatures")
    with_key = sig.filter("content is not null and k is not null")
    reps = materialise(with_key.groupBy("content").agg(F.min(F.struct("k", "n", "bands")).alias("r")).select("content", F.col("r.k").alias("k"), F.col("r.n").alias("n"), F.col("r.bands").alias("bands")), "representatives")
    member = reps.select(F.col("k"), "n", F.explode("bands").alias("band"))
    heads = member.groupBy("band").agg(F.min(F.struct("k", "n")).alias("h"), F.max("k").alias("top")).filter("top > h.k").select("band", F.col("h.k").alias("a"), F.col("h.n").alias("n_a"))
    shared = materialise(member.join(heads, "band"), "shared")
    stars = materialise(shared.filter((F.col("k") > F.col("a")) & _alike(F.col("n"), F.col("n_a"), similarity)).select("a", F.col("k").alias("b")).distinct(), "stars")
    ids = shared.select(F.col("k").alias("i")).distinct()
    texts = source.join(ids, F.col("k") == F.col("i"), "left_semi")
    sets = materialise(shingle_sets(texts).filter(F.size("s") > 0), "sets")
    if sets.count() > ids.count():  # rows that repeat a key
        sets = sets.distinct()
    first = materialise(verified(stars, sets, similarity).union(_same_key(with_key, reps)), "verified")
    comp = classes(first)
    # Bands that still hold more than one class: their documents meet again by the prefixes of their sets, across classes only.
    known = shared.select("band", "k").join(comp, F.col("k") == F.col("node"), "left").select("band", "k", F.coalesce("class", "k").alias("c"))
    known = materialise(known, "classed")
    open_bands = known.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("band")
    rest = known.join(open_bands, "band", "left_semi").select("k", "c").distinct()
    pairs = materialise(prefix_pairs(sets.join(rest, "k"), similarity).join(stars, ["a", "b"], "left_anti"), "across")
    final = classes(first.union(verified(pairs, sets, similarity)))
    # The class of a content is that of its least key.
    by_content = reps.select("content", "k").join(final, F.col("k") == F.col("node"), "left").select(F.col("content").alias("c_content"), F.coalesce("class", "k").alias("class_id"))
    out = sig.select("k", "content").join(by_content, F.col("content") == F.col("c_content"), "left")
    return keyed(out, key_col, {"class_id": F.coalesce("class_id", F.when(F.col("content").isNull(), F.col("k")))}, F.col("k"))


def _same_key(with_key: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of the contents that stand under one key, each held against the least of them."""
    several = with_key.groupBy("k").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).filter("lo < hi").select("k")
    node = reps.select("content", F.col("k").alias("b"))
    each = with_key.select("k", "content").join(several, "k", "left_semi").distinct().join(node, "content").select("k", "b").distinct()
    return each.join(each.groupBy("k").agg(F.min("b").alias("a")), "k").filter("a < b").select("a", "b").distinct()


def representatives(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of df, all columns as they are, that stand for their class: those of the least key; the rest go.

    Rows that repeat the key of a representative leave one, the first by text; all rows of a key go if one of its texts is
    linked to a lesser key, those without words too. Rows without a key go if their shingle
    set is that of a row that has one; else one of each shingle set stays (their near copies aren't looked for).
    Rows without a key and without words stay. Columns are taken by position and may have any name.
    """
    at, text = (F.col(f"k{i}") for i in positions(df, key_col, text_col))
    by = numbered(df)
    found = near_duplicates(df, key_col, text_col, **how).toDF("f_key", "f_class")
    gone = found.filter(F.col("f_key") != F.col("f_class")).select(F.col("f_key").alias("gone")).distinct()
    kept = by.filter(at.isNotNull()).join(gone, at == F.col("gone"), "left_anti")
    twice = found.filter(F.col("f_key").isNotNull()).groupBy("f_key").count().filter("count > 1").select(F.col("f_key").alias("twice"))
    if twice.limit(1).count():
        first = Window.partitionBy(at).orderBy(text)
        repeated = kept.join(twice, at == F.col("twice"), "left_semi").withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place")
        kept = kept.join(twice, at == F.col("twice"), "left_anti").unionByName(repeated)
    if by.filter(at.isNull()).limit(1).count():
        none = contents(df, text_col).filter(at.isNull())
        held = contents(df, text_col).filter(at.isNotNull() & F.col("content").isNotNull()).select(F.col("content").alias("held")).distinct()
        new = none.filter("content is not null").join(held, F.col("content") == F.col("held"), "left_anti").dropDuplicates(["content"])
        kept = kept.unionByName(none.filter("content is null").unionByName(new).drop("content"))
    return kept.toDF(*df.columns)
