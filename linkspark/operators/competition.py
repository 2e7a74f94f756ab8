"""Ranks and rivals: what a pair's score means beside the other candidates of its anchor and the other claimants of its record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import count_greater, with_max_other


def _by(key: str, value: str, tie: str):
    return Window.partitionBy(key).orderBy(F.desc(value), F.asc(tie))


def table_features(pairs: DataFrame, forward: DataFrame, reverse: DataFrame, gate: float = 0.02) -> DataFrame:
    """Retrieval features over the full table of pairs (s1, cand, cos, ch_fwd, ch_rev); ranks missing from a list are 51 and 6."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    s1s = forward.filter("rank <= 2").groupBy("s1").agg(at(1).alias("s1_top1"), at(2).alias("_s2"))
    top = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(Window.partitionBy("cand"))
    rev = reverse.withColumn("_top", top)
    rs = rev.groupBy("cand").agg(at(1).alias("rev_top1"), at(2).alias("_r2"), F.count_if(F.col("score") >= F.col("_top") - gate).alias("n_claim_gate"))
    out = pairs.join(forward.select("s1", "cand", F.col("rank").alias("fwd_rank")), ["s1", "cand"], "left")
    out = out.join(reverse.select("s1", "cand", F.col("rank").alias("rev_rank")), ["s1", "cand"], "left").join(s1s, "s1", "left").join(rs, "cand", "left")
    s, r = Window.partitionBy("s1"), Window.partitionBy("cand")
    return out.fillna({"fwd_rank": 51, "rev_rank": 6, "n_claim_gate": 0}).withColumns({
        "rel_s1": F.col("cos") - F.col("s1_top1"), "s1_gap12": F.col("s1_top1") - F.col("_s2"), "rel_rec": F.col("cos") - F.col("rev_top1"),
        "rev_gap12": F.col("rev_top1") - F.col("_r2"), "rank_s1": F.row_number().over(_by("s1", "cos", "cand")), "n_cands_s1": F.count(F.lit(1)).over(s),
        "rank_rec_tab": F.row_number().over(_by("cand", "cos", "s1")), "n_s1_rec_tab": F.count(F.lit(1)).over(r),
        "rel_rec_tab": F.col("cos") - F.max("cos").over(r), "n_channels": F.col("ch_fwd").cast("int") + F.col("ch_rev").cast("int"), "ch_both": F.col("ch_fwd") & F.col("ch_rev"),
    }).drop("_s2", "_r2")


def record_side_table(pairs: DataFrame, dense: DataFrame) -> DataFrame:
    """rank, number of claimants and distance to the best, of each pair against the dense table of all anchors plus the pair itself."""
    own = dense.select("s1", "cand", F.lit(1).alias("_own"))
    agg = dense.groupBy("cand").agg(F.count(F.lit(1)).alias("_n"), F.max("cos").alias("_mx"))
    out = count_greater(pairs, dense.withColumnRenamed("cos", "_cos"), "cand", "cos", "_cos", "_gt")
    out = out.join(own, ["s1", "cand"], "left").join(agg, "cand", "left")
    return out.withColumns({
        "rank_rec_tab": F.col("_gt") + 1, "n_s1_rec_tab": F.coalesce("_n", F.lit(0)) + F.when(F.col("_own").isNull(), 1).otherwise(0),
        "rel_rec_tab": F.coalesce(F.least(F.lit(0.0), F.col("cos") - F.col("_mx")), F.lit(0.0)),
    }).drop("_gt", "_own", "_n", "_mx")


#: Evidence columns by the rank that says whether their channel saw the pair.
CHANNELS = {"fr": ["fs"], "rr": ["rs", "rd"], "fr_ft": ["fs_ft"], "rr_ft": ["rs_ft", "rd_ft"], "c1": ["c1s", "c1nk"], "c2": ["c2s", "c2nk"], "c3": ["c3s"], "c1r": ["c1rs", "c1rnk", "c1rg"], "c2r": ["c2rs", "c2rnk", "c2rg"], "c3r": ["c3rs", "c3rg"]}


def channel_features(union: DataFrame, channels: dict[str, list[str]] = CHANNELS) -> DataFrame:
    """u_ columns: flags and fused ranks; rank and evidence of a channel, null (never imputed) where it didn't see the pair; candidates and reverse lexical members per anchor."""
    have = [r for r in channels if r in union.columns]
    flags = [c for c in union.columns if c.startswith("in_")]
    cols = [F.col(f).cast("int").alias(f"u_{f}") for f in flags] + [F.col(c).alias(f"u_{c}") for c in ("n_member_channels", "fused_rank", "fused_hd_rank")]
    for r in have:
        cols += [F.when(F.col(r) > 0, F.col(c)).alias(f"u_{c}") for c in [r, *channels[r]] if c in union.columns]
    rev = F.lit(False)
    for f in ("in_c1r", "in_c2r", "in_c3r"):
        rev = rev | F.col(f) if f in flags else rev
    w = Window.partitionBy("s1")
    return union.select("s1", "cand", *cols, F.count(F.lit(1)).over(w).alias("u_n_s1"), F.sum(rev.cast("long")).over(w).alias("u_n_lexrev_s1"))


def anchor_side(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Of the anchor's list: rank, best, second (0 if alone), gap to the next (the last: to 0) and to the best, counts above 0.5 and 0.8, sum."""
    order, w = _by("s1", p, "cand"), Window.partitionBy("s1")
    rk = F.row_number().over(order)
    out = pairs.withColumns({"p_rank_s1": rk, "_next": F.lead(p, 1, 0.0).over(order)})
    return out.withColumns({
        "p_max_s1": F.max(p).over(w), "p_second_s1": F.coalesce(F.max(F.when(F.col("p_rank_s1") == 2, F.col(p))).over(w), F.lit(0.0)),
        "p_gap_next": F.col(p) - F.col("_next"), "p_gap_top": F.max(p).over(w) - F.col(p), "p_n05_s1": F.count_if(F.col(p) > 0.5).over(w),
        "p_n08_s1": F.count_if(F.col(p) > 0.8).over(w), "p_sum_s1": F.sum(p).over(w),
    }).drop("_next")


def record_side(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Among the claimants of the record in the table itself: best other (0 if alone), distance to it, rank, others above 0.5."""
    w = Window.partitionBy("cand")
    out = with_max_other(pairs, "cand", p, "s1", "p_max_other_rec", 0.0).drop("is_argmax")
    return out.withColumns({
        "p_rel_other": F.col(p) - F.col("p_max_other_rec"), "p_rank_rec": F.row_number().over(_by("cand", p, "s1")),
        "p_n05_other_rec": F.count_if(F.col(p) > 0.5).over(w) - F.when(F.col(p) > 0.5, 1).otherwise(0),
    })


def record_side_external(pairs: DataFrame, rivals: DataFrame, p: str = "p") -> DataFrame:
    """The same against a table of rivals (s1, cand, q) of all anchors; a pair's own entry there doesn't count.

    Rivals are summed per record to the two best and two counts, so a record of many claimants costs its pairs nothing.
    """
    order = Window.partitionBy("cand").orderBy(F.desc("q"), F.asc("s1"))
    ranked = rivals.withColumn("_rk", F.row_number().over(order))
    pick = lambda k, c: F.max(F.when(F.col("_rk") == k, F.col(c)))
    agg = ranked.groupBy("cand").agg(pick(1, "q").alias("_m1"), pick(1, "s1").alias("_a1"), pick(2, "q").alias("_m2"), F.count_if(F.col("q") > 0.5).alias("_c5"), F.count(F.lit(1)).alias("_nc"))
    out = count_greater(pairs, rivals.withColumnRenamed("q", "_q"), "cand", p, "_q", "_gt")
    out = out.join(agg, "cand", "left").join(rivals.select("s1", "cand", F.col("q").alias("_self")), ["s1", "cand"], "left")
    own = F.coalesce(F.col("_self") > F.col(p), F.lit(False)).cast("long")
    out = out.withColumns({
        "p_max_other_rec": F.coalesce(F.when(F.col("_a1") == F.col("s1"), F.col("_m2")).otherwise(F.col("_m1")), F.lit(0.0)),
        "p_n05_other_rec": F.coalesce("_c5", F.lit(0)) - F.coalesce((F.col("_self") > 0.5).cast("long"), F.lit(0)), "p_rank_rec": F.col("_gt") - own + 1,
        "n_other": F.coalesce("_nc", F.lit(0)) - F.when(F.col("_self").isNotNull(), 1).otherwise(0),
    })
    return out.withColumn("p_rel_other", F.col(p) - F.col("p_max_other_rec")).drop("_gt", "_m1", "_a1", "_m2", "_c5", "_nc", "_self")


def stage2(pairs: DataFrame, rivals: DataFrame | None = None, p: str = "p") -> DataFrame:
    """Both sides' features; without rivals the table itself holds them all."""
    side = anchor_side(pairs, p)
    return record_side(side, p) if rivals is None else record_side_external(side, rivals, p).drop("n_other")


def competition(pairs: DataFrame, rivals: DataFrame | None = None, p: str = "p") -> DataFrame:
    """p_other: the best score of another anchor on the same record (-1 if none), and is_argmax."""
    if rivals is None:
        return with_max_other(pairs, "cand", p, "s1", "p_other", -1.0)
    out = record_side_external(pairs, rivals, p)
    return out.withColumns({"p_other": F.when(F.col("n_other") <= 0, -1.0).otherwise(F.col("p_max_other_rec")), "is_argmax": F.col("p_rank_rec") == 1}).drop(
        "p_max_other_rec", "p_n05_other_rec", "p_rank_rec", "n_other", "p_rel_other"
    )


def own_competition(pairs: DataFrame, others: DataFrame | None = None, p: str = "p") -> DataFrame:
    """Rivals with own scores where there are any, the other table's elsewhere."""
    own = pairs.select("s1", "cand", F.col(p).alias("q"))
    return own if others is None else others.select("s1", "cand", "q").join(own, ["s1", "cand"], "left_anti").unionByName(own)


def one_owner(selected: DataFrame, p: str = "p") -> DataFrame:
    """Every record keeps the selecting anchor of the highest score, ties to the lowest id."""
    return selected.withColumn("_rk", F.row_number().over(_by("cand", p, "s1"))).filter("_rk = 1").drop("_rk")


def multi_owner(selected: DataFrame) -> DataFrame:
    """How many records, and pairs, have more than one owner."""
    n = selected.groupBy("cand").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pairs"))


def siblings(pairs: DataFrame, records: DataFrame, similarity, p: str = "p", confident: float = 0.5, most: int = 6) -> DataFrame:
    """Support from the anchor's other confident candidates: their number, shared numbers, same house, best address and name likeness, score of the best address.

    records: (cand, nums, num_first, addr_n, name_n); similarity: a column function of two strings (0 to 100). At most
    `most` siblings per anchor meet each pair. Missing: counts 0, likeness -1.
    """
    ranked = pairs.withColumn("_rk", F.row_number().over(_by("s1", p, "cand")))
    sib = ranked.filter((F.col(p) >= confident) & (F.col("_rk") <= most)).select("s1", F.col("cand").alias("sib"), F.col(p).alias("sp"))
    r2 = records.select(F.col("cand").alias("sib"), *[F.col(c).alias(f"{c}_2") for c in ("nums", "num_first", "addr_n", "name_n")])
    x = pairs.select("s1", "cand").join(sib, "s1").filter("sib <> cand").join(records, "cand").join(r2, "sib")
    x = x.withColumns({
        "ad": F.when((F.col("addr_n") == "") | (F.col("addr_n_2") == ""), -1.0).otherwise(similarity(F.col("addr_n"), F.col("addr_n_2"))),
        "nm": similarity(F.col("name_n"), F.col("name_n_2")), "ns": F.arrays_overlap("nums", "nums_2").cast("int"),
        "hn": ((F.col("num_first") >= 0) & (F.col("num_first") == F.col("num_first_2"))).cast("int"),
    })
    g = x.groupBy("s1", "cand").agg(
        F.count(F.lit(1)).alias("sib_n"), F.sum("ns").alias("sib_num_share"), F.sum("hn").alias("sib_hn_eq"), F.max("ad").alias("sib_addr_max"), F.max("nm").alias("sib_name_max"),
        F.max_by("sp", F.struct("ad", "sp")).alias("sib_addr_best_p"),
    )
    return pairs.select("s1", "cand").join(g, ["s1", "cand"], "left").fillna({"sib_n": 0, "sib_num_share": 0, "sib_hn_eq": 0, "sib_addr_max": -1.0, "sib_name_max": -1.0, "sib_addr_best_p": -1.0})


def graph_features(pairs: DataFrame, names: DataFrame, similarity, p: str = "p", sure: float = 0.99, most: int = 8, near: float = 95.0) -> DataFrame:
    """Name agreement with the anchor's surest other candidates: number, best likeness, best of the same source, exact and near counts, score-weighted likeness."""
    ranked = pairs.withColumn("_rk", F.row_number().over(_by("s1", p, "cand")))
    sib = ranked.filter((F.col(p) >= sure) & (F.col("_rk") <= most)).select("s1", F.col("cand").alias("sib"), F.col(p).alias("sp"))
    n2 = names.select(F.col("cand").alias("sib"), F.col("src").alias("src_2"), F.col("name_n").alias("name_2"))
    x = pairs.select("s1", "cand").join(sib, "s1").filter("sib <> cand").join(names.select("cand", "src", "name_n"), "cand").join(n2, "sib").withColumn("nm", similarity(F.col("name_n"), F.col("name_2")))
    g = x.groupBy("s1", "cand").agg(
        F.count(F.lit(1)).alias("g_n"), F.max("nm").alias("g_max"), F.max(F.when(F.col("src") == F.col("src_2"), F.col("nm"))).alias("g_same_max"),
        F.count_if(F.col("name_n") == F.col("name_2")).alias("g_exact"), F.count_if(F.col("nm") > near).alias("g_near"), (F.sum(F.col("sp") * F.col("nm")) / F.sum("sp")).alias("g_weighted"),
    )
    return pairs.select("s1", "cand").join(g, ["s1", "cand"], "left").fillna({"g_n": 0, "g_max": -1.0, "g_same_max": -1.0, "g_exact": 0, "g_near": 0, "g_weighted": -1.0})


def list_aggregates(pairs: DataFrame, p: str = "p") -> DataFrame:
    w = Window.partitionBy("s1")
    return pairs.withColumns({
        "p_sum": F.sum(p).over(w), "p_n50": F.count_if(F.col(p) > 0.5).over(w), "p_n90": F.count_if(F.col(p) > 0.9).over(w), "p_max": F.max(p).over(w),
        "p_rank": F.row_number().over(_by("s1", p, "cand")),
    })


def band(pairs: DataFrame, low: float = 0.001, high: float = 0.999, p: str = "p") -> DataFrame:
    """Uncertain pairs: strictly between the bounds."""
    return pairs.filter((F.col(p) > low) & (F.col(p) < high))
