"""Properties and brute force of operators that SQL can't express, and their corner cases."""

import itertools
import math
import shutil

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkspark.functions import batch, similarity, text
from linkspark.operators import blocking, competition, decide, evaluate, keys, learning, numbers, patterns, records, wordlists
from linkspark.operators import pairs as pair_ops
from linkspark.plans import fixture, linkage
from linkspark.plans.queries import ORACLE_SQL, QUERIES
from linkspark.sources import io
from test_queries import same

SF = "/root/testdata/sf0.001"
PAIRS = "s1 long, cand long, src int, country string, p double, label int"


def pairs(spark, rows):
    return spark.createDataFrame([(s, c, 2 + c % 2, "US", p, y) for s, c, p, y in rows], PAIRS)


def brute_expected(ps, lam, q0, k):
    total = 0.0
    for ys in itertools.product((0, 1), repeat=len(ps)):
        prob = math.prod(p if y else 1 - p for p, y in zip(ps, ys))
        miss = [(math.exp(-lam) * lam**i / math.factorial(i), i) for i in range(25)] if any(ys) else [(1 - q0, 0), (q0, 1)]
        for w, extra in miss:
            m, t = sum(ys) + extra, sum(ys[:k])
            f = float(k == 0) if m == 0 else 5 * t / (4 * k + m) if t else 0.0
            total += prob * w * f
    return total


def test_expected_score_is_exact():
    ps = [0.9, 0.6, 0.3, 0.2]
    got = decide.expected_f05(ps, 0.3, 0.25)
    assert got == pytest.approx([brute_expected(ps, 0.3, 0.25, k) for k in range(5)], abs=1e-9)


def test_choose_expected_runs_in_columns(spark):
    got = {r.s1: r.k for r in decide.choose_expected(pairs(spark, [(1, 1, 0.9, 1), (1, 2, 0.05, 0), (2, 3, 0.02, 0)]), 0.1, 0.1).collect()}
    assert got == {1: 1, 2: 0}


def test_removal_value_is_exact(spark):
    rest, p, extra = [0.7, 0.4], 0.6, 0.5

    def score(t, k, m):
        return float(k == 0) if m <= 0 else 5 * t / (4 * k + m)

    want = 0.0
    for ys in itertools.product((0, 1), repeat=3):
        prob = math.prod(q if y else 1 - q for q, y in zip([p, *rest], ys))
        m = sum(ys) + extra
        want += prob * (score(sum(ys[1:]), 2, m) - score(sum(ys), 3, m))
    c = evaluate.removal_value(F.lit(3), F.array(*[F.lit(x) for x in rest]), F.lit(p), F.lit(extra))
    assert spark.range(1).select(c.alias("v")).first().v == pytest.approx(want)


def test_veto_only_removes_and_one_owner_is_one(spark):
    p = pairs(spark, [(1, 1, 0.9, 1), (2, 1, 0.9, 0), (2, 2, 0.4, 1), (3, 3, 0.5, 0)])
    pat = spark.createDataFrame([(3, 3, "US", 5, "sixword", "group", None)], "s1 long, cand long, country string, k long, kind string, extra string, allnum boolean")
    kept = {(r.s1, r.cand) for r in patterns.veto(p, pat).collect()}
    assert kept == {(1, 1), (2, 1), (2, 2)}
    assert {(r.s1, r.cand) for r in competition.one_owner(p).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert {(r.s1, r.cand) for r in patterns.score_veto(p, p.select("s1", "cand", F.lit(0.0).alias("score")), 0.5).collect()} == {(r.s1, r.cand) for r in p.collect()}


def test_empty_tables(spark):
    e = pairs(spark, [])
    assert competition.competition(e).count() == competition.one_owner(e).count() == decide.prefix_table(decide.universe(competition.competition(e))).count() == 0
    s1 = spark.createDataFrame([], "s1 long, name string, addr string, country string")
    pool = s1.withColumnRenamed("s1", "cand")
    assert all(c.count() == 0 for c in blocking.lexical_channels(s1, pool).values())


def test_null_and_blank_records(spark):
    rows = [(1, None, None, "US"), (2, "", "", "India"), (3, "  ", "null", None), (4, "x" * 5000, "1 " * 3000, "France")]
    df = spark.createDataFrame(rows, "s1 long, name string, addr string, country string")
    assert records.views(df).count() == 4
    assert blocking.block_tokens(blocking.block_views(df), "s1").count() == 4


def test_nearest_is_exact_over_chunks(spark):
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(30, 8)).round(3), rng.normal(size=(70, 8)).round(3)
    to = lambda m, n: spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(m)], f"{n} long, v array<double>, b int")
    got = {(r.s1, r.cand) for r in blocking.nearest(to(q, "s1"), to(c, "cand"), "s1", "cand", "v", "b", 5, rows=7, group=2).collect()}
    want = {(i, int(j)) for i, s in enumerate(np.round(q @ c.T, 6)) for j in np.argsort(-s, kind="stable")[:5]}
    assert got == want


def test_tsv_round_trip(spark, tmp_path):
    path = f"{tmp_path}/a.tsv"
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"quoted" name\t\tUS\nS2-2\tb\t1 Main St, Troy\tUS\n')
    df = io.read_tsv(spark, path)
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("S1-1", '"quoted" name', "", "US"), ("S2-2", "b", "1 Main St, Troy", "US")]
    io.write_tsv(df, f"{tmp_path}/out", one_file=True)
    assert io.read_tsv(spark, f"{tmp_path}/out").count() == 2


def test_parts_restart(spark, tmp_path):
    df = spark.range(200).withColumn("v", F.col("id") * 2)
    io.write_parts(df, f"{tmp_path}/parts", "id", 4)
    io.write_parts(df, f"{tmp_path}/parts", "id", 4)
    assert io.read_parts(spark, f"{tmp_path}/parts").count() == 200
    shutil.rmtree(f"{tmp_path}/parts/part=2")  # a part that was never finished is written again, the others stay
    (tmp_path / "parts" / "_done" / "2").unlink()
    io.write_parts(df, f"{tmp_path}/parts", "id", 4, per_job=1)
    assert io.read_parts(spark, f"{tmp_path}/parts").agg(F.sum("v")).first()[0] == 200 * 199
    io.replace_table(df, f"{tmp_path}/table")
    io.replace_table(df.filter("id < 5"), f"{tmp_path}/table")
    assert io.current_table(spark, f"{tmp_path}/table").count() == 5
    (tmp_path / "side.json").write_text('{"a": [1, 2]}')
    assert io.read_side_table(f"{tmp_path}/side.json") == io.read_side_table(f"file://{tmp_path}/side.json", spark) == {"a": [1, 2]}
    (tmp_path / "h.tsv").write_text("b\ta\tx\n1\t2\t3\n")
    assert io.header_faults(spark, f"{tmp_path}/h.tsv", ["a", "b", "c"]) == ["missing c", "extra x"] and io.header_faults(spark, f"{tmp_path}/h.tsv", ["a", "b", "x"]) == ["order"]
    assert io.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert io.check_fingerprints({"x": df}, {"x": keys.fingerprint(df).first()["checksum"]}) == []


def test_list_faults(spark):
    df = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S1-1"), ("S1-2", " X9, ")], "k string, ids string")
    assert io.list_faults(df, "k", "ids").first().asDict() == {"repeated_keys": 1, "repeated_ids": 1, "bad_prefix": 1, "self_match": 1}


def test_training_and_metrics(spark):
    rows = [(i, i, (i % 97) / 100 + 0.01, int(i % 97 > 60)) for i in range(400)]
    x = pairs(spark, rows).withColumns({"fold": keys.bucket(F.col("s1"), 2), "q": F.col("p") * 2, "nothing": F.lit(None).cast("double")})
    scored = learning.cross_fit(x, ["q", "nothing"], "label", "fold", rounds=3, depth=2)
    assert learning.ranking_metrics(scored, "p1", "label").first().auc > 0.97
    better = learning.residual_boost(x, ["q"], "label", "p", rounds=2, depth=2)
    before, after = (learning.ranking_metrics(better, c, "label").first().logloss for c in ("p", "p3"))
    assert after < before
    assert sum(learning.simplex_blend(x.withColumn("r", 1 - F.col("p")), ["p", "r"], "label", 4).values()) == 1
    assert learning.ranking_metrics(learning.platt(x, ["p"], "label", "pp"), "pp", "label").first().auc > 0.97
    kept = learning.keep_negatives(x, F.col("cand"), F.col("cand") % 2 == 0)
    assert kept.filter("label = 1").count() == x.filter("label = 1").count() and kept.agg(F.max("weight")).first()[0] == 4


def test_count_model_and_gate(spark):
    a = spark.createDataFrame([(i, float(i % 3), i % 3) for i in range(90)], "s1 long, x double, m int")
    out = learning.count_model(a, ["x"], "m")
    r = {x.m: (x.p_single, x.n_expected) for x in out.dropDuplicates(["m"]).collect()}
    assert r[0][0] > 0.5 > r[2][0] and r[2][1] > r[0][1]


def test_bootstrap_and_intervals(spark):
    d = spark.range(100).select((F.col("id") % 2).cast("double").alias("delta"))
    mean, low, high = evaluate.bootstrap(d)
    assert mean == 0.5 and low < 0.5 < high
    assert evaluate.poisson_interval(0)[0] == 0 and evaluate.poisson_interval(10)[0] < 10 < evaluate.poisson_interval(10)[1]


def test_specialist_and_importances(spark):
    p = spark.createDataFrame([("a b", "a b", "1 x", "", "India", "a b llc")], "name_core_1 string, name_core_2 string, addr_n_1 string, addr_n_2 string, country string, name_n_2 string")
    s1 = spark.createDataFrame([("a b llc",), ("a b llc",)], "name_n string")
    r = learning.specialist_features(p, s1, ["llc", "inc"]).first()
    assert (r.full_form_s1_count, r.n_core_shared, r.core_eq, r.addr_empty_2, r.india, r.has_llc, r.has_inc) == (2, 2, 1, 1, 1, 1, 0)


def test_subsequences(spark):
    df = spark.createDataFrame([("st", "street", True), ("ts", "street", False), ("street", "st", False)], "a string, b string, y boolean")
    assert all(r.g == r.y for r in df.withColumn("g", wordlists.is_subsequence(F.col("a"), F.col("b"))).collect())


def test_steps_render_alike(spark):
    import duckdb

    names = ["Ph & Co. www.x.com", "THE  quick-fox 00123", "M/S A.B.C (India)", ""]
    want = [duckdb.execute(f"select {text.BLOCK_NAME.sql('x')} from (select ? as x)", [n]).fetchone()[0] for n in names]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert [r.v for r in df.orderBy("i").select(text.BLOCK_NAME(F.col("n")).alias("v")).collect()] == want


# ---------------------------------------------------------------- fuzzy kernels in batches
@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abcd  é", max_size=20), st.text("abcde ", max_size=30)), max_size=12))
def test_batches_equal_the_kernels(rows):
    rows = [*rows, ("", ""), ("a", ""), ("x" * 64, "x" * 63), ("y" * 90, "yz"), ("a\0b", "ab")]
    a, b = map(list, zip(*rows))
    for k in ("ratio", "partial", "jaro_winkler"):
        assert batch.pairwise(k, a, b).tolist() == pytest.approx([similarity.KERNELS[k][0](x, y) for x, y in rows])


def test_fuzzy_features_equal_the_kernels(spark):
    s1, pool, _ = fixture.corpus(spark, SF)
    p = fixture.pairs(spark, SF).filter("(s1 + cand) % 17 = 0").select("s1", "cand")
    odd = s1.select("s1", "s1_id", "country", F.when(F.col("s1") % 11 == 0, "").when(F.col("s1") % 7 == 0, F.concat(F.lit("Café №1 "), "name")).otherwise(F.col("name")).alias("name"), F.when(F.col("s1") % 5 == 0, None).otherwise(F.col("addr")).alias("addr"))
    a, b = pair_ops.with_views(odd, pool)
    got = {(r.s1, r.cand): r for r in pair_ops.base_features(p, a, b).collect()}
    left, right = {r.s1: r for r in a.collect()}, {r.cand: r for r in b.collect()}
    assert len(got) == p.count() > 100
    for (i, j), r in got.items():
        for f, (kernel, view) in pair_ops.FUZZY.items():
            x, y = left[i][view] or "", right[j][view] or ""
            assert r[f] == pytest.approx(similarity.KERNELS[kernel][0](x, y)), (f, x, y)
    assert {len(r) for r in got.values()} == {2 + 17 + 2 + 14 + 10 + 22 + 5}


def test_graph_features_equal_brute_force(spark):
    s1, pool, _ = fixture.corpus(spark, SF)
    a, b = pair_ops.with_views(s1, pool)
    p = fixture.pairs(spark, SF).filter("s1 < 60")
    got = {(r.s1, r.cand): r for r in pair_ops.graph_features(p, p.select("s1", "cand", "p"), b, most=3, least=0.3).collect()}
    name = {r.cand: r for r in b.select("cand", "src", "name_n", "name_raw").collect()}
    rows = [(r.s1, r.cand, r.p) for r in p.collect()]
    for s, c, _ in rows:
        sib = [x for x in sorted(((q, -k) for t, k, q in rows if t == s and q >= 0.3), reverse=True) if -x[1] != c][:3]
        r = got[s, c]
        if not sib:
            assert r.g_n99 == -1
            continue
        sims = [(similarity.ratio(name[c].name_n, name[-k].name_n) / 100, q, name[-k].src == name[c].src) for q, k in sib]
        assert (r.g_n99, r.g_name_n_exact_n, r.g_name_near_n) == (len(sib), sum(x == 1 for x, _, _ in sims), sum(x > 0.95 for x, _, _ in sims))
        assert r.g_name_n_max == pytest.approx(max(x for x, _, _ in sims)) and r.g_name_weighted == pytest.approx(max(x * q for x, q, _ in sims))
        assert r.g_name_n_same_src == pytest.approx(max(x if same else -1 for x, _, same in sims))


# ---------------------------------------------------------------- keys
def test_ids_that_do_not_fit_are_refused(spark):
    ok = spark.createDataFrame([(5, 7), (None, 1)], "a long, b long").select(keys.pack(F.col("a"), F.col("b")).alias("k")).collect()
    assert [r.k for r in ok] == [5 * 2**24 + 7, None]
    for row in ((1, 2**24), (1, -1), (2**39, 1)):
        with pytest.raises(Exception, match="too large"):
            spark.createDataFrame([row], "a long, b long").select(keys.pack(F.col("a"), F.col("b")).alias("k")).collect()


def test_tables_side_by_side_must_have_the_same_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string")
    assert keys.side_by_side(a, spark.createDataFrame([(2, 1), (1, 0)], "k long, b long"), ["k"]).count() == 2
    for rows in ([(1, 0)], [(1, 0), (2, 1), (3, 1)], [(1, 0), (1, 1), (2, 1)]):
        with pytest.raises(Exception, match="missing on one side"):
            keys.side_by_side(a, spark.createDataFrame(rows, "k long, b long"), ["k"]).collect()


def test_null_keys_have_buckets(spark):
    df = spark.createDataFrame([(None,), ("",)], "k string")
    assert len({(r.b, r.c) for r in df.select(keys.bucket(F.col("k"), 7).alias("b"), keys.crc_fold(F.col("k"), 5).alias("c")).collect()}) == 1


def test_running_sums_and_quantiles_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.lognormal(size=700), 2).tolist() + [None, float("nan"), 5.0, 5.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    clean = sorted(x for x in v if x is not None and x == x)
    at = [0.0, 0.1, 0.37, 0.5, 0.99, 1.0]
    assert keys.exact_quantiles(df, "v", at) == pytest.approx(np.quantile(clean, at).tolist())
    g = df.filter("v is not null and not isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.v: r.n_before for r in keys.running(g, "v", ["n"], buckets=9).collect()}
    assert got == {x: sum(y < x for y in clean) for x in set(clean)}
    assert keys.exact_quantiles(df.filter("v < 0"), "v", at) == []


def test_digests_see_every_change(spark):
    rows = [(i, f"t{i}") for i in range(50)]
    d = lambda r: keys.digest(spark.createDataFrame(r, "a long, b string")).first()
    first = d(rows)
    assert first == d(rows[::-1]) and first.n_rows == 50
    assert len({first.digest, d([*rows, rows[0]]).digest, d(rows[1:]).digest, d([(0, "T0"), *rows[1:]]).digest, d([(0, None), *rows[1:]]).digest, d([]).digest}) == 6


def test_multisets_by_count(spark):
    df = spark.createDataFrame([(1, list("aab"), list("abb")), (2, [], ["x"]), (3, ["y"] * 3, [])], "i long, a array<string>, b array<string>")
    assert {r.i: r.lost for r in keys.multiset_lost(df, "i", "a", "b").collect()} == {1: 1, 2: 0, 3: 3}


# ---------------------------------------------------------------- the chain
def test_the_chain_finds_the_truth(spark):
    all_ = linkage.link_scores(spark, "/root/testdata/sf0.01").filter("country is null and mb is null").first()
    assert all_.oracle_ceiling > 0.98 and all_.macro_f05 > 0.9 and all_.micro_precision > 0.95 and all_.micro_recall > 0.85


def test_number_features_of_examples(spark):
    rows = [("12 elm", "21 elm"), ("0012 elm", "12 elm"), ("", ""), ("Unit 4 elm", "4b"), (None, "7")]
    x = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    found = numbers.number_features(x.withColumn("i", F.monotonically_increasing_id()), "a", "b", ["i"])
    got = found.orderBy("i").collect()
    assert found.columns == ["i", *numbers.FEATURES] and len(numbers.FEATURES) == 35
    assert (got[0].nf_transposition, got[0].nf_digit_damerau, got[0].nf_digit_lev, got[0].nf_alpha_equal) == (1, 1, 2, 1)
    assert (got[1].nf_zero_equal, got[1].nf_substring, got[1].nf_shared_suffix) == (1, 1, 2)
    assert (got[2].nf_digit_lev, got[2].nf_alpha_ratio, got[2].nf_count1, got[2].nf_firstpos1) == (-1, -1, 0, -1)
    assert (got[3].nf_unit_before1, got[3].nf_compound2, got[3].nf_startsnum2, got[3].nf_startsnum1) == (1, 1, 1, 0)
    assert (got[4].nf_first_missing1, got[4].nf_num_only2) == (1, 1)


def test_bootstrap_draws_groups_whole(spark):
    df = spark.createDataFrame([(g, float(g)) for g in range(40) for _ in range(3)], "g long, delta double")
    got = [r["mean"] for r in evaluate.bootstrap_sums(df, 200, "g").collect()]
    assert abs(np.mean(got) - 19.5) < 0.6 and 1.2 < np.std(got) < 2.6
    assert sorted(got) == sorted(r["mean"] for r in evaluate.bootstrap_sums(df.repartition(5), 200, "g").collect())


def test_gradient_weights_are_no_worse_than_the_grid(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 600)
    rows = [(int(v), *(float(np.clip(0.5 + s * (v - 0.5) + rng.normal() * n, 0.02, 0.98)) for s, n in ((0.5, 0.15), (0.3, 0.1), (0.0, 0.2)))) for v in y]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double").cache()
    loss = lambda w: learning.ranking_metrics(df.withColumn("p", text.expit(sum((F.lit(w[k]) * text.logit(F.col(k)) for k in "abc"), F.lit(0.0)))), "p", "y").first().logloss
    grid, fit = learning.simplex_blend(df, list("abc"), "y", 4), learning.simplex_fit(df, list("abc"), "y", 10)
    assert sum(fit.values()) == pytest.approx(1) and min(fit.values()) >= 0 and loss(fit) <= loss(grid) + 1e-6


def test_row_numbers_over_any_key(spark):
    df = spark.createDataFrame([(f"k{(i * 7919) % 1000:04d}",) for i in range(1000)], "k string").repartition(7)
    assert [r.row for r in keys.row_index(df, "k").orderBy("k").collect()] == list(range(1000))


def test_pack_switches(spark):
    df = spark.createDataFrame([("a", "Café France", "98 bis st. martin, nord", "France"), ("b", "Café", "98b ste-anne, nord", "France")], "i string, name string, addr string, country string")
    full = {r.i: r for r in records.pack_views(df, {"nord": "hdf"}, ["france"]).collect()}
    assert (full["a"].hn_sfx, full["a"].adm, full["a"].f_ctag, full["a"].name_n) == ("b", "hdf", True, "cafe") and "saint martin" in full["a"].addr_n and "hdf" in full["a"].addr_n
    none = {r.i: r for r in records.pack_views(df, {"nord": "hdf"}, ["france"], use=()).collect()}
    plain = {r.i: r for r in records.views(df).collect()}
    assert all(none[i].name_n == plain[i].name_n and none[i].addr_n == plain[i].addr_n for i in "ab")
    kept = {r.i: r for r in records.pack_views(df, {"nord": "hdf"}, ["france"], use=("saint", "suffix_token")).collect()}
    assert all("sfxb" in kept[i].addr_n.replace(" ", "") for i in "ab")
    swapped = records.pack_views(df, {}, [], use=("streets", "legal", "lexicon"), streets={"st.": "rue"}, legal=["cafe"], words={"cafe": "bistro"}).filter("i = 'b'").first()
    assert swapped.name_n == "bistro"


def _broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_name_channel_meets_classes_not_copies(spark):
    """Brute force over copies and ties; the vectors that meet are as many as the different names, however many rows bear them."""
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(i, "US" if i % 4 else "India", f"{words[i % 6]} {words[i // 6 % 5]}") for i in range(90)]
    q, x = rows[:60], [(1000 + i, c, t) for i, c, t in rows[20:]]
    make = lambda r, i: spark.createDataFrame(r, f"{i} long, country string, name_c string")
    grams = lambda t: [f" {w} "[j : j + 3] for w in t.split() for j in range(len(w))]
    found = blocking.name_channel(make(q, "s1"), make(x, "cand"), "s1", "cand", 7, 0.5)
    assert not _broadcasts(found)
    got = {(r["s1"], r["cand"]): (r["score"], r["rank"]) for r in found.collect()}
    want = {}
    for country in ("US", "India"):
        index = [(i, grams(t)) for i, c, t in x if c == country]
        df = {g: sum(g in gs for _, gs in index) for _, gs in index for g in gs}
        idf = {g: math.log((1 + len(index)) / (1 + d)) + 1 for g, d in df.items() if d <= len(index) * 0.5}

        def unit(gs):
            v = {g: gs.count(g) * idf[g] for g in gs if g in idf}
            norm = math.sqrt(sum(w * w for w in v.values()))
            return {g: w / norm for g, w in v.items()}

        for s, c, t in q:
            if c == country:
                a = unit(grams(t))
                scored = [(-round(sum(w * b.get(g, 0) for g, w in a.items()), 6), i) for i, b in ((i, unit(gs)) for i, gs in index)]
                want |= {(s, i): (-v, r) for r, (v, i) in enumerate(sorted(z for z in scored if z[0] < 0)[:7], 1)}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) <= 1e-6 for k in want)


def test_neighbours_equal_brute_force(spark):
    """Houses on both sides of the cuts between stretches, copies, words that no record has, and no side sent whole to the driver."""
    words = ["a", "b", "c", "d"]
    contents = [" ".join(c) for n in (1, 2, 3) for c in itertools.combinations(words, n)]
    a = [(i, "US", "main" if i % 3 else "oak", i * 7 % 23 - 4, contents[i % 11]) for i in range(60)] + [(90, "US", "main", 3, "a z"), (91, "US", "", 3, "a"), (92, "US", "main", None, "a")]
    b = [(500 + i, "US", "main" if i % 4 else "oak", i * 5 % 29 - 6, contents[(i * 3) % 14]) for i in range(80)]
    make = lambda r, i: spark.createDataFrame(r, f"{i} long, country string, street string, house long, content string")
    found = patterns.neighbours(make(a, "s1"), make(b, "cand"), reach=4)
    assert not _broadcasts(found)
    want = []
    for s, c, street, h, t in a:
        for r, c2, street2, h2, t2 in b:
            extra = sorted(set(t2.split()) - set(t.split()))
            if street and h is not None and (c, street) == (c2, street2) and abs(h2 - h) <= 4 and set(t.split()) <= set(t2.split()):
                want.append((s, r, c, h2 - h, "equal" if not extra else f"superset+{min(2, len(extra))}", " ".join(extra) or None))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str) and want


#: Queries and how many joins they may send to all machines: tables of a row per word of a short list, per country or per rule.
SENT = [("eval_mirror_estimate", 0), ("join_offset_range", 0), ("pat_neighbours", 0), ("pat_families", 0), ("pat_added_and_decoy_words", 1), ("feat_vector_cosines", 0), ("sim_gram_cosine", 0), ("block_training_pairs", 0), ("sim_fuzzy_ratios", 0), ("feat_second_explainer", 0), ("pat_removal_rules", 0), ("pat_pattern_pairs", 0)]


@pytest.mark.parametrize("name, most", SENT)
def test_no_table_of_records_is_broadcast(spark, name, most):
    assert _broadcasts(QUERIES[name](spark, SF)) <= most


#: Queries on neighbours and how many joins may have been sent to all machines once they ran.
NEAR = [("pat_neighbours", 0), ("pat_added_and_decoy_words", 1), ("pat_families", 0)]


@pytest.mark.parametrize("name, most", NEAR)
def test_neighbours_of_copies_equal_sql_and_stay_off_the_driver(spark, tmp_path, name, most):
    """Three copies on the same streets and three on others; the plan that ran counts, under a threshold that any file here is below."""
    db = duckdb.connect()
    copies = f"SELECT p.* REPLACE (p_partkey + i * 840 + i % 2 * 200000 AS p_partkey) FROM '{SF}/part.parquet' p, range(6) r(i)"
    db.execute(f"COPY ({copies}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    assert db.execute("SELECT count(*) = count(DISTINCT p_partkey) FROM part").fetchone()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        df = QUERIES[name](spark, str(tmp_path))
        got = df.collect()
        ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and want
    assert "Final Plan" in ran and ran.count("BroadcastExchange") <= most


def test_training_pairs_are_all_unless_bounded(spark):
    """More true pairs than any fixed bound: none is left out."""
    n = 160_000
    truth = spark.range(n).selectExpr("id as s1", "id as cand")
    side = lambda i: spark.range(n).selectExpr(f"id as {i}", "'n' as name", "'a' as addr")
    assert blocking.training_pairs(truth, side("s1"), side("cand")).count() == 2 * n
    assert 0 < blocking.training_pairs(truth, side("s1"), side("cand"), 1000).count() < 4000


def test_cosines_of_texts_equal_those_of_rows(spark):
    """Copies, empty texts and nulls: the same cosines as by the vectors of each row."""
    from linkspark.operators import features

    a = spark.createDataFrame([(i, t) for i, t in enumerate(["acme works", "acme works", "zeta labs", "", None, "acme labs"])], "s1 long, t string")
    b = spark.createDataFrame([(10 + i, t) for i, t in enumerate(["acme works", "labs", None, "labs"])], "cand long, t string")
    every = a.select("s1").crossJoin(b.select("cand"))
    got = features.gram_cosine(every, features.gram_texts(a, "s1", "t"), features.gram_texts(b, "cand", "t"), "c")
    assert not _broadcasts(got)
    va, vb = ({r[0]: r["grams"] for r in features.gram_vectors(x, i, "t").collect()} for x, i in ((a, "s1"), (b, "cand")))
    want = {(s, c): sum(w * vb[c].get(g, 0) for g, w in va[s].items()) if s in va and c in vb else None for s in range(6) for c in range(10, 14)}
    assert {r["s1"] for r in got.filter("c is null and cand <> 12").collect()} == {3, 4}
    for r in got.collect():
        w = want[r["s1"], r["cand"]]
        assert (r["c"] is None) == (w is None) and (w is None or abs(w - r["c"]) < 1e-9)


#: Queries whose pairs are compared by their texts.
BY_TEXTS = ["feat_pack_views", "feat_base_fuzzy", "feat_base", "feat_second_explainer", "pat_name_families"]


@pytest.mark.parametrize("name", BY_TEXTS)
def test_pairs_of_copies_are_compared_once(spark, tmp_path, monkeypatch, name):
    """Three copies of the same records elsewhere: three times the pairs, no more to compare, and the rows of the SQL or three times those of one copy."""
    compared, real = [], pair_ops.stage

    def stage(df, kind):
        out = real(df, kind)
        compared.append(out.count()) if kind == "compared" else None
        return out

    monkeypatch.setattr(pair_ops, "stage", stage)
    monkeypatch.setattr(linkage, "stage", stage)
    db = duckdb.connect()
    db.execute(f"COPY (SELECT p.* REPLACE (p_partkey + i * 8400 AS p_partkey) FROM '{SF}/part.parquet' p, range(3) r(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    one = QUERIES[name](spark, SF).toPandas()
    once = compared[:]
    df = QUERIES[name](spark, str(tmp_path))
    assert once and compared == once * 2 and min(once) <= len(one) and not _broadcasts(df)
    got = df.toPandas()
    if name in ORACLE_SQL:
        same(got, db.execute(ORACLE_SQL[name]).df())
    else:
        same(got.assign(cand=got.cand % (4 * 8400), s1=got.s1 % 8400), pd.concat([one] * 3))


def test_removal_rules_of_one_pass_equal_brute_force(spark):
    """All rules at once, against each by hand; an anchor keeps a pair under each rule alone."""
    rng = np.random.default_rng(5)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rows = [(s, c, pick(["US", "France", "India"]), pick(["LEGADD", "LEGSW", "CTAG", "SWDW", "ADDO", "EQ"]), pick(["D12", "D3", "ND"]), pick("++-0")) for s in range(80) for c in rng.choice(9, 4, replace=False).tolist()]
    fam = spark.createDataFrame(rows, "s1 long, cand long, country string, family string, bucket string, side string")
    selected, asked = {r[:2] for r in rows if (r[0] + r[1]) % 4}, {r[:2] for r in rows if r[1] % 2 == 0}
    pairs_ = lambda xs: spark.createDataFrame(sorted(xs), "s1 long, cand long")
    want = set()
    for rule in ("R", "FR9", "R+"):
        hits = {r[:2] for r in rows for country, fams, buckets, needs in patterns.REMOVALS[rule] if r[5] == "+" and r[2] == country and r[3] in fams and (not buckets or r[4] in buckets) and (not needs or r[:2] in asked)} & selected
        count = lambda s, xs: sum(x[0] == s for x in xs)
        want |= {(rule, s, c) for s, c in hits if count(s, hits) < count(s, selected)}
        one = patterns.removal_pairs(fam, pairs_(selected), rule, pairs_(asked)).collect()
        assert sorted(map(tuple, one)) == sorted((s, c) for r, s, c in want if r == rule)
    got = patterns.removals(fam, pairs_(selected), ["R", "FR9", "R+"], pairs_(asked)).select("rule", "s1", "cand").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r for r, _, _ in want} == {"R", "FR9", "R+"}


def test_removal_rules_make_pairs_once(spark):
    """The query's last plan reads stage tables only: no rule joins the pairs or tells families anew."""
    plan = QUERIES["pat_removal_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "part.parquet" not in plan and plan.count("SortMergeJoin") <= 6
