"""More operators as queries: fuzzy kernels, whole feature tables, explanations, packs, evidence, removals, resampling; and the chain from records to matches.

Fuzzy ratios are checked by a longest-common-subsequence recursion in SQL, kernels and explanations by literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batch, explain, lexicon, similarity, text
from ..operators import blocking, competition, decide, evaluate, features, keys, learning, numbers, pairs, patterns, records, wordlists
from ..sources import io
from ..sources.staging import stage
from . import fixture as fx
from .queries import _FOLD_ADDR, _FOLD_NAME, _list, _map, _odd, _ODD_SQL, _r, _table, _toks, query


# ---------------------------------------------------------------- fuzzy kernels
def _lcs_sql(need: str) -> str:
    """Tables lcs (x, y, l) for the pairs (x, y) of `need`: the rows of the dynamic program are made one by one, a running maximum fills each."""
    return f"""num AS (SELECT row_number() OVER () AS id, x, y FROM (SELECT DISTINCT x, y FROM {need})),
dp AS (SELECT id, 0 AS i, j, 0 AS v FROM num, LATERAL unnest(range(0, len(y) + 1)) t(j)
  UNION ALL SELECT id, i, j, max(greatest(v, w)) OVER (PARTITION BY id ORDER BY j) FROM (SELECT d.id, d.i + 1 AS i, d.j, d.v,
    CASE WHEN d.j > 0 AND substr(n.y, d.j, 1) = substr(n.x, d.i + 1, 1) THEN lag(d.v) OVER (PARTITION BY d.id ORDER BY d.j) + 1 ELSE 0 END AS w FROM dp d JOIN num n USING (id) WHERE d.i < len(n.x))),
lcs AS (SELECT x, y, max(v) AS l FROM dp JOIN num USING (id) WHERE i = len(x) GROUP BY x, y)"""


def _ratio_sql(x: str, y: str, l: str) -> str:  # noqa: E741
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 100.0 ELSE 200.0 * {l} / (len({x}) + len({y})) END"


def _set_sql(both: str, x: str, y: str, l: str) -> str:  # noqa: E741
    """token_set of the shared words and the rests, from the common subsequence of the rests."""
    left, right = (f"(CASE WHEN {both} <> '' AND {s} <> '' THEN {both} || ' ' || {s} ELSE {both} || {s} END)" for s in (x, y))
    whole = f"200.0 * (len({both}) + (CASE WHEN {both} <> '' AND {x} <> '' AND {y} <> '' THEN 1 ELSE 0 END) + {l}) / greatest(len({left}) + len({right}), 1)"
    parts = ", ".join(f"200.0 * len({both}) / (len({both}) + len({s}))" for s in (left, right))
    return f"CASE WHEN {both} <> '' AND ({x} = '' OR {y} = '') THEN 100.0 WHEN {both} <> '' THEN greatest({whole}, {parts}) ELSE {_ratio_sql(x, y, l)} END"


_SETS_SQL = """array_to_string(list_sort(list_filter(list_distinct({a}), lambda w: list_contains({b}, w))), ' ') AS {p}shared,
  array_to_string(list_sort(list_filter(list_distinct({a}), lambda w: NOT list_contains({b}, w))), ' ') AS {p}only_a, array_to_string(list_sort(list_filter(list_distinct({b}), lambda w: NOT list_contains({a}, w))), ' ') AS {p}only_b"""
_NAMES_SQL = f"""WITH RECURSIVE {fx.WITH_PAIRS}, w AS (SELECT p.s1, p.cand, {text.BLOCK_NAME.sql('a.name')} AS a, {text.BLOCK_NAME.sql('b.name')} AS b FROM pairs p JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand)),
v AS (SELECT *, {_toks('a')} AS ta, {_toks('b')} AS tb FROM w),
z AS (SELECT *, array_to_string(list_sort(ta), ' ') AS sa, array_to_string(list_sort(tb), ' ') AS sb, {_SETS_SQL.format(a='ta', b='tb', p='')} FROM v),
need AS (SELECT a AS x, b AS y FROM z UNION ALL SELECT sa, sb FROM z UNION ALL SELECT only_a, only_b FROM z)"""


@query(f"""{_NAMES_SQL}, {_lcs_sql('need')}
SELECT s1, cand, round({_ratio_sql('a', 'b', 'l1.l')}, 6)::DOUBLE AS ratio, round({_ratio_sql('sa', 'sb', 'l2.l')}, 6)::DOUBLE AS token_sort, round({_set_sql('shared', 'only_a', 'only_b', 'l3.l')}, 6)::DOUBLE AS token_set,
  round(jaro_winkler_similarity(a, b), 6) AS jaro_winkler FROM z JOIN lcs l1 ON l1.x = a AND l1.y = b JOIN lcs l2 ON l2.x = sa AND l2.y = sb JOIN lcs l3 ON l3.x = only_a AND l3.y = only_b""")
def sim_fuzzy_ratios(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    side = lambda df, i, t: df.select(i, text.BLOCK_NAME(F.col("name")).alias("name_n")).select(i, *[c.alias(n) for n, c in pairs.views_of(["name_n"], t).items()])
    x = fx.pairs(spark, sf_dir).select("s1", "cand").join(keys.large(side(s1, "s1", "a")), "s1").join(keys.large(side(pool, "cand", "b")), "cand")
    out = pairs.fuzzy_features(x, only=["n_ratio", "n_tsort", "n_tset", "n_jw"])
    return out.select("s1", "cand", *[_r(c).alias(n) for c, n in (("n_ratio", "ratio"), ("n_tsort", "token_sort"), ("n_tset", "token_set"), ("n_jw", "jaro_winkler"))])


@query(f"""WITH RECURSIVE p AS (SELECT a.p_partkey, split_part(a.p_name, ' ', 2) AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
q AS (SELECT DISTINCT a, b, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS s, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS t FROM p),
win AS (SELECT a, b, s, substr(t, greatest(e - len(s), 0) + 1, least(e, len(t)) - greatest(e - len(s), 0)) AS u FROM q, LATERAL unnest(range(1, len(s) + len(t))) r(e)),
need AS (SELECT s AS x, u AS y FROM win), {_lcs_sql('need')},
best AS (SELECT a, b, max(CASE WHEN contains(b, a) OR contains(a, b) THEN 100.0 ELSE 200.0 * l / (len(x) + len(y)) END) AS v FROM win JOIN lcs ON x = s AND y = u GROUP BY a, b)
SELECT p_partkey, round(v, 6)::DOUBLE AS partial FROM p JOIN best USING (a, b)""")
def sim_partial_ratios(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    x = p.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    return x.select("p_partkey", _r(batch.column("partial")(F.col("a"), F.col("b"))).alias("partial"))


#: Kernel, its strings, and what it gives: worked out by hand.
KERNEL_LITERALS = [
    ("osa", "ca", "abc", "3"), ("osa", "abcd", "acbd", "1"), ("osa", "", "abc", "3"), ("damerau", "ca", "abc", "2"), ("damerau", "abcd", "acbd", "1"), ("soft_kind", "abcde", "abcdx", "2"), ("soft_kind", "abcde", "abxyz", "0"),
    ("soft_kind", "abcdef", "abcdxy", "2"), ("soft_kind", "abc", "abd", "0"), ("soft_kind", "processing", "prnoecssnig", "3"), ("soft_kind", "stone", "xtoen", "0"), ("lenient", "private", "prsvooet", "true"),
    ("lenient", "private", "pxxvooet", "false"), ("lenient", "abc", "abd", "true"), ("lenient", "abc", "xbc", "false"), ("lenient", "ab", "ab", "false"), ("light_slip", "city", "ciyt", "true"), ("light_slip", "abc", "xyc", "false"),
    ("heavy_scramble", "processing", "prnoecssnig", "true"), ("heavy_scramble", "abcd", "bacd", "false"), ("filler_match", "ciyt", "city plot", "true"), ("filler_match", "5ervices", "services", "true"),
    ("filler_match", "garden", "services", "false"), ("acronym", "cmv", "centre medical vauban", "true"), ("acronym", "vcm", "centre medical vauban", "true"), ("acronym", "abcdef", "a1 b1 c1 d1 e1 f1 g1 h1", "true"),
    ("acronym", "a", "alpha", "false"), ("acronym", "ab", "alpha 1b beta", "true"), ("web_distance", "developmentdex", "dex development", "0"), ("web_distance", "dexdevelop", "dex development", "4"),
    ("web_distance", "dexdevelopm", "dex development", "0"), ("web_distance", "nitowing", "north island towing", "0"), ("web_distance", "dexdeve1opment", "dex development", "0"), ("web_distance", "dex", "", "99"),
    ("segment_distance", "adenterprises", "alpha delta enterprises", "0"), ("segment_distance", "alphaxelta", "alpha delta", "1"), ("segment_distance", "zzzzzz", "alpha delta", "99"), ("number_link", "136", "36", "digit_dropped"),
    ("number_link", "136", "146", "digit_substituted"), ("number_link", "12", "21", "null"), ("ratio", "abc", "abd", "66.666667"), ("ratio", "", "", "100.0"), ("token_sort", "b a", "a b", "100.0"), ("token_set", "a b c", "a b", "100.0"),
    ("partial", "abc", "xxabcxx", "100.0"), ("partial", "abd", "xxabcxx", "66.666667"), ("partial_token_set", "a b", "b c", "100.0"), ("jaro_winkler", "martha", "marhta", "0.961111"),
]


def _values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(text.sql_text(str(v)) for v in r) + ')' for r in rows)}) t({columns})"


@query(_values(KERNEL_LITERALS, "kernel, a, b, value"))
def sim_kernel_literals(spark, sf_dir):
    rows = spark.createDataFrame([r[:3] for r in KERNEL_LITERALS], "kernel string, a string, b string")
    out = None
    for k in dict.fromkeys(r[0] for r in KERNEL_LITERALS):
        kind = similarity.KERNELS[k][1]
        got = similarity.column(similarity.KERNELS[k][0], kind)(F.col("a"), F.col("b"))
        got = _r(got).cast("string") if kind == "double" else got.cast("string")
        one = rows.filter(F.col("kernel") == k).select("kernel", "a", "b", F.coalesce(got, F.lit("null")).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- explanations
#: Country, anchor, record, what of it: the operations of names or addresses, the relation of the numbers, a feature's value.
EXPLAIN_LITERALS = [
    ("US", "Global Services Inc", "Global 5ervices Inc", "name", "homoglyph"), ("France", "Dex Development SARL", "developmentdex.com", "name", "lower,domain"), ("France", "Centre Medical Vauban SAS", "MVC", "name", "caps,acronym"),
    ("US", "Greene, Cardone and Schumacher PC", "Lumxylo D.B.A. Greene, Cardone and Schumacher PC", "name", "alias_marker"), ("US", "Salt Sport", "Sport Salt", "name", "permute"), ("US", "Acme Ltd", "Acme Limited", "name", "legal_restyle"),
    ("US", "Star Clean Valley LLC", "Star Clean Valley L.L.C.", "name", "dotted"), ("US", "Best Infotech", "Best Infotech - 9219770714", "name", "phone"), ("US", "Salt Sport Shop", "Salt Sport", "name", "word_drop"), ("US", "Salt Sport", "Salt Sport Group", "name", "filler_add"),
    ("US", "136 Main Street, Troy, NY", "36 MAIN ST, TROY, NY", "relation", "4"), ("US", "254 Oak Avenue, Troy, NY", "2-54 Oak Ave, Troy, New York", "relation", "3"), ("US", "635 Concord Street, Billings, MT", "00635 CONCORD ST, BILLINGS, MT", "relation", "1"),
    ("US", "9005 Meadow Hills Drive", "9004-9006 Meadow Hills Dr", "relation", "2"), ("US", "99 Oak Road", "101 Oak Road", "relation", "6"), ("US", "12 Oak Road", "477 Oak Road, Lot 12", "relation", "7"), ("US", "12 Oak Road", "477 Oak Road", "relation", "8"),
    ("India", "12 Gandhi Road, Salem, Tamil Nadu", "DOOR NO 187 12 GANDHI ROAD, SALEM, TN", "relation", "1"), ("India", "19 Dda Flats, New Delhi, Delhi", "H.NO 59 DDA FLATS, NEW DELHI, Delhi", "relation", "5"), ("US", "12 Oak Road", "Oak Road", "relation", "0"),
    ("US", "1 Oak St, Troy, NY", "1 Oak St, Albany, NY", "addr", "comp_drop,locality_replaced"), ("US", "1 Oak St, Troy, NY", "Troy, 1 Oak St, NY", "addr", "reorder"), ("US", "1 Oak Street, Troy, NY", "1 Oak St, Troy, NY", "addr", "street_abbr"),
    ("France", "30 Rue Lachassaigne, Bordeaux, Nouvelle-Aquitaine", "30 Rue Lachassaigne, Bordeaux, Gironde", "addr", "admin_alias"), ("France", "98B Rue de Dieppe, Lille", "98 bis Rue de Dieppe, Lille", "addr", "num_suffix"), ("US", "1 Oak St, Troy", "", "addr", "addr_empty"),
    ("US", "2653 6th Place, Portland, OR", "2653 Sixth Place, Portland, Oregon", "addr", "admin_alias,ordinal"),
]


@query(_values(EXPLAIN_LITERALS, "country, a, b, what, value"))
def feat_explanation_literals(spark, sf_dir):
    rows = spark.createDataFrame([r[:4] for r in EXPLAIN_LITERALS], "country string, a string, b string, what string")
    named, c = F.col("what") == "name", F.col
    e = explain.explain_pairs(F.when(named, c("a")), F.when(~named, c("a")), F.when(named, c("b")), F.when(~named, c("b")), F.lit(2), c("country"))
    got = F.when(named, F.array_join("e.name_ops", ",")).when(c("what") == "addr", F.array_join(F.filter("e.addr_ops", lambda o: o != "addr_caps"), ",")).otherwise(c("e.a3_num_rel").cast("int").cast("string"))
    return rows.withColumn("e", e).select("country", "a", "b", "what", got.alias("value"))


def _explained(spark, sf_dir) -> DataFrame:
    s1, pool, _ = fx.corpus(spark, sf_dir)
    x = fx.pairs(spark, sf_dir).select("s1", "cand", "src", "country")
    x = x.join(keys.large(s1.select("s1", F.col("name").alias("na"), F.col("addr").alias("aa"))), "s1").join(keys.large(pool.select("cand", F.col("name").alias("nb"), F.col("addr").alias("ab"))), "cand")
    return x.withColumn("e", explain.explain_pairs(*[F.col(c) for c in ("na", "aa", "nb", "ab", "src", "country")]))


@query()
def feat_explanations(spark, sf_dir):
    """Every pair explained: the 125 scalar and operation features. The literals above are its check against SQL; the kernels and views have brute-force tests."""
    return _explained(spark, sf_dir).select("s1", "cand", *[F.col(f"e.{f}").alias(f) for f in explain.FEATURES])


@query()
def feat_decoys_explained(spark, sf_dir):
    """Decoy features that need the explainer, beside the offsets of the house numbers."""
    e = _explained(spark, sf_dir)
    nums = lambda c: F.transform(F.regexp_extract_all(F.split_part(F.col(c), F.lit(","), F.lit(1)), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    off = features.decoy_offsets(nums("aa"), nums("ab"))["dec_ind"]
    plus = features.added_word(text.BLOCK_NAME(F.col("na")), text.BLOCK_NAME(F.col("nb"))).isNotNull().cast("int")
    return e.select("s1", "cand", *[c.alias(k) for k, c in pairs.explained_decoys(off, plus, F.col("e.x1_name_explained"), F.col("e.name_ops")).items()])


@query()
def feat_second_explainer(spark, sf_dir):
    """The rest of the second explainer's features, over the pairs' name words and streets: those of names and of addresses once for every two different ones that meet in a country."""
    s1, pool, _ = fx.corpus(spark, sf_dir)
    met, texts, _, _ = pairs.meet(fx.pairs(spark, sf_dir).select("s1", "cand", "country"), s1.select("s1", "name", "addr"), pool.select("cand", "name", "addr"), {"n": ["name"], "p": ["addr"]})
    none, empty = F.lit(""), F.array().cast("array<string>")
    w = lambda c: F.array_distinct(text.tokens(text.BLOCK_NAME(F.col(c))))
    legal = lambda c: F.filter(w(c), lambda x: x.isin(*text.LEGAL))
    street = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.split_part(F.col(c), F.lit(","), F.lit(1))), F.lit("([a-z]+)"), F.lit(1)))
    idf = F.create_map(*[F.lit(v) for kv in {"group": 4.0, "holdings": 3.5}.items() for v in kv])
    two = {g: pairs.different(met, g, texts[g].withColumnRenamed(c, "a"), texts[g].withColumnRenamed(c, "b"), "country") for g, c in (("n", "name"), ("p", "addr"))}
    e = {"n": explain.explain_pairs(F.col("a"), none, F.col("b"), none, F.lit(0), F.col("country")), "p": explain.explain_pairs(none, F.col("a"), none, F.col("b"), F.lit(0), F.col("country"))}
    of = {
        "n": pairs.second_explainer(F.array_except(w("b"), w("a")), idf, F.lit(0.0), empty, empty, legal("a"), legal("b"), F.col("e.name_ops")),
        "p": pairs.second_explainer(empty, idf, F.col("e.a3_num_rel"), street("a"), street("b"), empty, empty, empty),
    }
    x = met
    for g in ("p", "n"):
        mine = [c.cast("double").alias(k) for k, c in of[g].items() if k.startswith("bp_a_") == (g == "p")]
        on = ["country", f"a_{g}", f"b_{g}"]
        x = x.join(keys.large(stage(two[g].withColumn("e", e[g]).select(*on, *mine), "compared")), on)
    return x.select("s1", "cand", *of["n"])


_CONFLICT = "list_filter([trim(lower(x)) for x in string_split({a}, ',')], lambda c: c IN ('new york', 'tamil nadu', 'nord', 'oregon', 'montana', 'goa'))"


@query(f"""WITH v AS (SELECT p.s1, p.cand, {_CONFLICT.format(a='a.addr')} AS x, {_CONFLICT.format(a='b.addr')} AS y FROM pairs p JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand))
SELECT s1, cand, CASE WHEN len(x) > 0 AND len(y) > 0 THEN (len(list_intersect(x, y)) = 0)::INTEGER END::DOUBLE AS adm_conflict, CASE WHEN s1 % 2 = 0 AND cand % 3 = 0 THEN 0 WHEN s1 % 2 = 0 THEN 1 WHEN cand % 3 = 0 THEN 2 ELSE 3 END::INTEGER AS prov FROM v""", "pairs")
def feat_areas_and_provenance(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    known = ["new york", "tamil nadu", "nord", "oregon", "montana", "goa"]
    areas = lambda df, i, n: df.select(i, F.filter(F.transform(F.split(F.lower("addr"), ","), lambda c: F.trim(c)), lambda c: c.isin(*known)).alias(n))
    x = fx.pairs(spark, sf_dir).select("s1", "cand").join(areas(s1, "s1", "x"), "s1").join(areas(pool, "cand", "y"), "cand")
    return x.select("s1", "cand", pairs.area_conflict(F.col("x"), F.col("y")).alias("adm_conflict"), features.provenance(F.col("s1") % 2 == 0, F.col("cand") % 3 == 0).cast("int").alias("prov"))


# ---------------------------------------------------------------- base features
def _record_sql(table: str, i: str, out: str) -> str:
    """Views of a table of the fixture as records.views makes them: name_n, core, ns, skel, raw texts, addr_n and its words, numbers, flags."""
    phrases = text.Steps((("pad",), *text._words(text.STATES_OF_WORDS), ("trim",)))
    return f"""{out}0 AS (SELECT {i}, src, country, name, addr, {text.NAME.sql('lower(name)')} AS name_n, {text.ADDR.sql(_FOLD_ADDR)} AS clean, lower({_FOLD_ADDR}) AS low FROM {table}),
{out}1 AS (SELECT *, array_to_string(list_filter({_toks('name_n')}, lambda t: NOT list_contains({_list(text.LEGAL)}, t)), ' ') AS core0,
  list_transform({_toks(phrases.sql('clean'))}, lambda t: coalesce({_map(text.ADDR_ABBR | text.STATES)}[t], t)) AS w1 FROM {out}0),
{out}2 AS (SELECT *, CASE WHEN core0 = '' THEN name_n ELSE core0 END AS name_core,
  array_to_string(list_filter(CASE WHEN country = 'India' THEN list_transform(w1, lambda t: coalesce({_map(text.INDIA_CODES)}[t], t)) ELSE w1 END, lambda t: NOT list_contains({_list(text.ADDR_NOISE)}, t)), ' ') AS addr_n,
  list_transform(regexp_extract_all(clean, '\\d+'), lambda x: right(x, 9)::BIGINT) AS nums FROM {out}1),
{out} AS (SELECT *, replace(name_core, ' ', '') AS name_ns, {text.skeleton_sql('name_core')} AS name_skel, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS name_raw, trim(regexp_replace(lower(addr), '[^a-z0-9]+', ' ', 'g')) AS addr_raw,
  array_to_string(list_sort(list_distinct({_toks('addr_n')})), ' ') AS addr_key, {_toks('name_core')} AS nw, {_toks('addr_n')} AS aw FROM {out}2)"""


_BASE_SQL = f"""{fx.WITH_PAIRS}, anchors AS (SELECT *, 1 AS src FROM er_s1), {_record_sql('anchors', 's1', 'a')}, {_record_sql('er_pool', 'cand', 'b')}"""


def _idf_sql(p: str, w: str) -> str:
    return f"""{p}i AS (SELECT w, ln((SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b)) / count(*)) AS idf FROM (SELECT unnest(list_distinct({w})) AS w FROM a UNION ALL SELECT unnest(list_distinct({w})) FROM b) GROUP BY w),
{p}a AS (SELECT s1, sum(idf) AS sa, list({{'w': {p}i.w, 'i': idf}}) AS la FROM (SELECT s1, unnest(list_distinct({w})) AS w FROM a) x JOIN {p}i USING (w) GROUP BY s1), {p}b AS (SELECT cand, sum(idf) AS sb, list({{'w': {p}i.w, 'i': idf}}) AS lb FROM (SELECT cand, unnest(list_distinct({w})) AS w FROM b) x JOIN {p}i USING (w) GROUP BY cand),
{p}o0 AS (SELECT s1, cand, coalesce(la, []) AS la, coalesce(lb, []) AS lb, coalesce(sa, 0) AS sa, coalesce(sb, 0) AS sb, list_transform(coalesce(la, []), lambda e: e.w) AS wa, list_transform(coalesce(lb, []), lambda e: e.w) AS wb FROM pairs LEFT JOIN {p}a USING (s1) LEFT JOIN {p}b USING (cand)),
{p}o1 AS (SELECT *, coalesce(list_sum(list_transform(list_filter(la, lambda e: list_contains(wb, e.w)), lambda e: e.i)), 0) AS sh, len(list_filter(wa, lambda w: list_contains(wb, w))) AS n FROM {p}o0),
{p}o AS (SELECT s1, cand, n::DOUBLE AS {p}_inter, round(CASE WHEN sa + sb - sh > 0 THEN sh / (sa + sb - sh) ELSE -1 END, 6) AS {p}_wjac, round(CASE WHEN sa > 0 THEN sh / sa ELSE -1 END, 6) AS {p}_cov1, round(CASE WHEN sb > 0 THEN sh / sb ELSE -1 END, 6) AS {p}_cov2,
  round(coalesce(list_max(list_transform(list_filter(la, lambda e: NOT list_contains(wb, e.w)), lambda e: e.i)), 0), 6) AS {p}_miss_max, round(coalesce(list_max(list_transform(list_filter(lb, lambda e: NOT list_contains(wa, e.w)), lambda e: e.i)), 0), 6) AS {p}_extra_max,
  (len(la) - n)::DOUBLE AS {p}_miss_cnt, (len(lb) - n)::DOUBLE AS {p}_extra_cnt FROM {p}o1)"""


_FREQ_SQL = """fn AS (SELECT k, sum(s) AS fs, sum(1 - s) AS fp FROM (SELECT name_core AS k, 1 AS s FROM a UNION ALL SELECT name_core, 0 FROM b) GROUP BY k), fa AS (SELECT k, sum(s) AS fs, sum(1 - s) AS fp FROM (SELECT addr_key AS k, 1 AS s FROM a UNION ALL SELECT addr_key, 0 FROM b) WHERE k <> '' GROUP BY k)"""
_UNIT = r"(\b(apt|apartment|suite|ste|unit|flat|floor|fl|flr|room|bldg|building)\b|#)"


def _both_sql(name: str, expr: str) -> str:
    return ", ".join(f"({expr.format(t=t)})::DOUBLE AS {name}{i}" for t, i in (("a", 1), ("b", 2)))


@query(f"""WITH {_BASE_SQL}, {_idf_sql('n', 'nw')}, {_idf_sql('a', 'aw').replace('FROM a UNION ALL', 'FROM a AS a_ UNION ALL')}, {_FREQ_SQL},
x AS (SELECT s1, cand, a.nums AS x, b.nums AS y FROM pairs JOIN a USING (s1) JOIN b USING (cand))
SELECT s1, cand, (a.name_core = b.name_core)::DOUBLE AS core_eq, (a.name_ns = b.name_ns)::DOUBLE AS ns_eq, (b.src = 3)::DOUBLE AS is_s3,
  {_both_sql('addr_empty', "{t}.addr_n = ''")}, {_both_sql('ntok_name', f"len({_toks('{t}.name_n')})")}, {_both_sql('ntok_addr', f"len({_toks('{t}.addr_n')})")}, {_both_sql('name_nonascii', "regexp_matches({t}.name, '[^\\x00-\\x7F]')")},
  {_both_sql('has_unit', f"regexp_matches({{t}}.low, '{_UNIT}')")}, regexp_matches(b.addr, '[^\\x00-\\x7F]')::DOUBLE AS addr_nonascii2, regexp_matches(b.low, '\\b(null|none|n/a)\\b')::DOUBLE AS addr_null2, (NOT regexp_matches(b.addr_n, '[0-9]'))::DOUBLE AS addr_nodigit2,
  (NOT regexp_matches(b.addr_n, '[a-z]'))::DOUBLE AS addr_noletter2, (NOT regexp_matches(b.name_n, '[a-z]'))::DOUBLE AS name_noletter2, 0.0::DOUBLE AS script2, 0.0::DOUBLE AS f_url2, 0.0::DOUBLE AS f_handle2, 0.0::DOUBLE AS f_formerly2, 0.0::DOUBLE AS f_urltail2, 0.0::DOUBLE AS fake2,
  round(ln(1 + coalesce(f1.fs, 0)), 6) AS name_freq_s1_1, round(ln(1 + coalesce(f2.fp, 0)), 6) AS name_freq_pool2, round(ln(1 + coalesce(f2.fs, 0)), 6) AS name_freq_s1_2, round(ln(1 + coalesce(f3.fs, 0)), 6) AS addr_freq_s1_1, round(ln(1 + coalesce(f4.fp, 0)), 6) AS addr_freq_pool2,
  n_inter, n_wjac, n_cov1, n_cov2, n_miss_max, n_extra_max, n_miss_cnt, n_extra_cnt, a_inter, a_wjac, a_cov1, a_cov2, a_miss_max, a_extra_max,
  len(list_intersect(x, y))::DOUBLE AS num_inter, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN -1 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6)::DOUBLE AS num_jac, len(list_distinct(x))::DOUBLE AS num_cnt1, len(list_distinct(y))::DOUBLE AS num_cnt2,
  (len(list_distinct(x)) - len(list_intersect(x, y)))::DOUBLE AS num_miss1, (len(list_distinct(y)) - len(list_intersect(x, y)))::DOUBLE AS num_extra2, (len(x) > 0 AND len(y) > 0)::DOUBLE AS num_first_both,
  CASE WHEN len(x) > 0 AND len(y) > 0 THEN (x[1] = y[1])::INTEGER ELSE -1 END::DOUBLE AS num_first_eq, CASE WHEN len(x) > 0 AND len(y) > 0 THEN (abs(x[1] - y[1]) = 1)::INTEGER ELSE -1 END::DOUBLE AS num_first_off1,
  round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN ln(1 + abs(x[1] - y[1])) ELSE -1 END, 6) AS num_first_ldiff
FROM pairs JOIN a USING (s1) JOIN b USING (cand) JOIN no USING (s1, cand) JOIN ao USING (s1, cand) JOIN x USING (s1, cand) LEFT JOIN fn f1 ON f1.k = a.name_core LEFT JOIN fn f2 ON f2.k = b.name_core LEFT JOIN fa f3 ON f3.k = a.addr_key LEFT JOIN fa f4 ON f4.k = b.addr_key""")
def feat_base(spark, sf_dir):
    """The base features that are no fuzzy ratios; those are in feat_base_fuzzy and feat_base_partial, from the same builder."""
    s1, pool, _ = fx.corpus(spark, sf_dir)
    return pairs.base_features(fx.pairs(spark, sf_dir), s1, pool, only=[c for c in pairs.BASE if c not in pairs.FUZZY], each=_r)


_PARTIAL = ("n_partial", "ns_partial", "n_partial_raw", "a_ptset")
_FUZZY_SQL = {  # feature: (strings x, y, kind)
    "n_ratio": ("a.name_n", "b.name_n"), "ns_ratio": ("a.name_ns", "b.name_ns"), "sk_ratio": ("a.name_skel", "b.name_skel"), "a_ratio": ("a.addr_n", "b.addr_n"), "n_ratio_raw": ("a.name_raw", "b.name_raw"),
}
_FUZZY_SETS = {"n_tset": "name_n", "sk_tset": "name_skel", "a_tset": "addr_n", "n_tset_raw": "name_raw", "a_tset_raw": "addr_raw"}
_FUZZY_SORTS = {"n_tsort": "name_n", "a_tsort": "addr_n"}


def _fuzzy_base_sql() -> str:
    cols = [f"{x} AS {f}_x, {y} AS {f}_y" for f, (x, y) in _FUZZY_SQL.items()]
    cols += [f"array_to_string(list_sort({_toks(f'a.{v}')}), ' ') AS {f}_x, array_to_string(list_sort({_toks(f'b.{v}')}), ' ') AS {f}_y" for f, v in _FUZZY_SORTS.items()]
    cols += [f"{_SETS_SQL.format(a=_toks(f'a.{v}'), b=_toks(f'b.{v}'), p=f'{f}_')}, (a.{v} = '' OR b.{v} = '') AS {f}_none" for f, v in _FUZZY_SETS.items()]
    plain = [*_FUZZY_SQL, *_FUZZY_SORTS]
    need = " UNION ALL ".join([f"SELECT {f}_x AS x, {f}_y AS y FROM z" for f in plain] + [f"SELECT {f}_only_a, {f}_only_b FROM z" for f in _FUZZY_SETS])
    out = [f"round({_ratio_sql(f'{f}_x', f'{f}_y', f'l_{f}.l')}, 6)::DOUBLE AS {f}" for f in plain]
    out += [f"round(CASE WHEN {f}_none THEN 0.0 ELSE {_set_sql(f'{f}_shared', f'{f}_only_a', f'{f}_only_b', f'l_{f}.l')} END, 6)::DOUBLE AS {f}" for f in _FUZZY_SETS]
    joins = " ".join([f"JOIN lcs l_{f} ON l_{f}.x = {f}_x AND l_{f}.y = {f}_y" for f in plain] + [f"JOIN lcs l_{f} ON l_{f}.x = {f}_only_a AND l_{f}.y = {f}_only_b" for f in _FUZZY_SETS])
    return f"WITH RECURSIVE {_BASE_SQL}, z AS (SELECT s1, cand, a.name_n AS an, b.name_n AS bn, {', '.join(cols)} FROM pairs JOIN a USING (s1) JOIN b USING (cand)), need AS ({need}), {_lcs_sql('need')} SELECT s1, cand, {', '.join(out)}, round(jaro_winkler_similarity(an, bn), 6) AS n_jw FROM z {joins}"


@query(_fuzzy_base_sql())
def feat_base_fuzzy(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    return pairs.base_features(fx.pairs(spark, sf_dir), s1, pool, only=[c for c in pairs.FUZZY if c not in _PARTIAL], each=_r)


@query()
def feat_base_partial(spark, sf_dir):
    """The window ratios of the base features (sim_partial_ratios checks the kernel against SQL; a test checks these columns by brute force)."""
    s1, pool, _ = fx.corpus(spark, sf_dir)
    return pairs.base_features(fx.pairs(spark, sf_dir), s1, pool, only=[*_PARTIAL], each=_r)


#: Two addresses of an anchor's number, by key: as written and disturbed.
_ADDR_PAIR = ("CASE s1 % 5 WHEN 0 THEN addr WHEN 1 THEN 'Unit 4, ' || addr WHEN 2 THEN 'B' || addr || ' 21' WHEN 3 THEN street ELSE addr || ' 7' END", "CASE s1 % 7 WHEN 0 THEN '00' || addr WHEN 1 THEN reverse(cast(house as varchar(20))) || ' ' || street WHEN 2 THEN addr || ' 21' WHEN 3 THEN '12' WHEN 4 THEN '7 ' || addr WHEN 5 THEN upper(addr) ELSE street END")
_NUM_SQL = f"""WITH RECURSIVE {fx.WITH}, q AS (SELECT s1, lower({_ADDR_PAIR[0]}) AS a, lower({_ADDR_PAIR[1]}) AS b FROM er_s1),
t AS (SELECT *, regexp_extract_all(a, '[0-9]+') AS na, regexp_extract_all(b, '[0-9]+') AS nb, trim(regexp_replace(regexp_replace(regexp_replace(a, '[0-9]+', ' ', 'g'), '[^a-z_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS la,
  trim(regexp_replace(regexp_replace(regexp_replace(b, '[0-9]+', ' ', 'g'), '[^a-z_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS lb, len(regexp_extract(a, '^[^0-9]*')) AS ha, len(regexp_extract(b, '^[^0-9]*')) AS hb FROM q),
u AS (SELECT *, coalesce(na[1], '') AS x, coalesce(nb[1], '') AS y, len(na) > 0 AND len(nb) > 0 AS bt, la <> '' AND lb <> '' AS lt, {_SETS_SQL.format(a=_toks('la'), b=_toks('lb'), p='')} FROM t),
need AS (SELECT la AS x, lb AS y FROM u UNION ALL SELECT only_a, only_b FROM u), {_lcs_sql('need')},
v AS (SELECT u.*, levenshtein(u.x, u.y) AS lev, damerau_levenshtein(u.x, u.y) AS dam, l1.l AS ll, l2.l AS lr, len(list_filter(range(1, least(len(u.x), len(u.y)) + 1), lambda i: left(u.x, i) = left(u.y, i))) AS pre, len(list_filter(range(1, least(len(u.x), len(u.y)) + 1), lambda i: right(u.x, i) = right(u.y, i))) AS suf
  FROM u JOIN lcs l1 ON l1.x = la AND l1.y = lb JOIN lcs l2 ON l2.x = only_a AND l2.y = only_b)"""


def _num_cols() -> str:
    at = lambda e: f"CASE WHEN bt THEN ({e})::DOUBLE ELSE -1.0 END"
    tx = lambda e: f"round(CASE WHEN lt THEN ({e})::DOUBLE ELSE -1.0 END, 6)"
    same = "list_sort(na) = list_sort(nb)"
    cols = {
        "nf_digit_lev": at("lev"), "nf_digit_damerau": at("dam"), "nf_digit_norm": f"round({at('lev / greatest(len(x), len(y), 1)')}, 6)", "nf_len_diff": at("len(y) - len(x)"), "nf_single_sub": at("lev = 1 AND len(x) = len(y)"),
        "nf_single_indel": at("lev = 1 AND len(x) <> len(y)"), "nf_transposition": at("dam = 1 AND lev = 2"), "nf_zero_equal": at("x::BIGINT = y::BIGINT"), "nf_substring": at("contains(x, y) OR contains(y, x)"),
        "nf_shared_prefix": at("pre"), "nf_shared_suffix": at("suf"), "nf_rest_equal": at("CASE WHEN len(na) > 1 AND len(nb) > 1 THEN (na[2:] = nb[2:])::INTEGER ELSE -1 END"), "nf_multiset_equal": at(same), "nf_order_changed": at(f"{same} AND na <> nb"),
        "nf_shared_count": at("len(list_intersect(na, nb))"), "nf_first_in_other": at("list_contains(nb, x)"), "nf_other_first_in_self": at("list_contains(na, y)"),
        "nf_alpha_ratio": tx(f"({_ratio_sql('la', 'lb', 'll')}) / 100"), "nf_alpha_tset": tx(f"({_set_sql('shared', 'only_a', 'only_b', 'lr')}) / 100"), "nf_alpha_equal": tx("la = lb"), "nf_alpha_lenratio": tx("least(len(la), len(lb)) / greatest(len(la), len(lb))"),
    }
    units = f"\\b(?:{numbers.UNITS})\\b"
    for i, (s, n, letters, h) in enumerate((("a", "na", "la", "ha"), ("b", "nb", "lb", "hb")), 1):
        some = f"len({n}) > 0"
        cols |= {
            f"nf_count{i}": f"len({n})::DOUBLE", f"nf_first_missing{i}": f"(len({n}) = 0)::DOUBLE", f"nf_firstpos{i}": f"(CASE WHEN {some} THEN {h} ELSE -1 END)::DOUBLE", f"nf_startsnum{i}": f"({some} AND trim(left({s}, {h})) = '')::DOUBLE",
            f"nf_unit_before{i}": f"({some} AND regexp_matches(left({s}, {h}), '{units}'))::DOUBLE", f"nf_compound{i}": f"({some} AND (regexp_matches(left({s}, {h}), '[a-z]$') OR regexp_matches({s}, '^[^0-9]*[0-9]+[a-z]')))::DOUBLE", f"nf_num_only{i}": f"({some} AND {letters} = '')::DOUBLE",
        }
    return ", ".join(f"{cols[f]} AS {f}" for f in numbers.FEATURES)


@query(f"{_NUM_SQL} SELECT s1, {_num_cols()} FROM v")
def feat_number_residuals(spark, sf_dir):
    s1, _, _ = fx.corpus(spark, sf_dir)
    x = s1.select("s1", F.expr(_ADDR_PAIR[0]).alias("a"), F.expr(_ADDR_PAIR[1]).alias("b"))
    out = numbers.number_features(x, "a", "b", ["s1"])
    return out.select("s1", *[_r(k).alias(k) for k in numbers.FEATURES])


@query()
def feat_vector_cosines(spark, sf_dir):
    """The two vector features of the explainer (sim_gram_cosine checks the cosine against SQL)."""
    s1, pool, _ = fx.corpus(spark, sf_dir)
    out = pairs.vector_features(fx.pairs(spark, sf_dir), *pairs.with_views(s1, pool))
    return out.select("s1", "cand", _r("n3_core_tfidf").alias("n3_core_tfidf"), _r("a13_addr_tfidf").alias("a13_addr_tfidf"))


@query()
def feat_graph(spark, sf_dir):
    """The eighteen graph features of every pair against its anchor's confident other candidates (the kernel and windows have tests)."""
    s1, pool, _ = fx.corpus(spark, sf_dir)
    a, b = pairs.with_views(s1, pool)
    p = fx.pairs(spark, sf_dir)
    g = pairs.graph_features(p, p.select("s1", "cand", "p"), b, least=0.4)
    return g.join(pairs.anchor_frequencies(b, a), "cand").select("s1", "cand", *[_r(c).alias(c) for c in g.columns if c.startswith("g_")], *[_r(f"g_s1freq_{v}").alias(f"g_s1freq_{v}") for v in ("name_raw", "name_n", "name_ns")])


# ---------------------------------------------------------------- projections, keys, sets
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25")
def proj_slice(spark, sf_dir):
    """Rows 25 to 74 of a total order: the feature is the slice."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return keys.rows_between(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, 50)


@query("SELECT p_partkey, p_name, (row_number() OVER (ORDER BY p_name, p_partkey) - 1)::BIGINT AS row FROM part")
def proj_row_index(spark, sf_dir):
    """Rows numbered over the whole table, in the order of a unique text key, without a task that holds them all."""
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name").withColumn("k", F.concat(F.rpad("p_name", 40, " "), F.lpad(F.col("p_partkey").cast("string"), 12, "0")))
    return keys.row_index(p, "k").select("p_partkey", "p_name", "row")


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('sample' || o_orderkey::VARCHAR), o_orderkey)::INTEGER AS sample_rank FROM orders")
def win_sample_rank(spark, sf_dir):
    return keys.sample_rank(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey")


@query("SELECT o_orderkey, o_totalprice, lines FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*)::BIGINT AS lines FROM lineitem GROUP BY 1) USING (o_orderkey)")
def join_side_by_side(spark, sf_dir):
    """Columns of two tables of the same keys put side by side: by key, never by position."""
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(lines.select("o_orderkey"), "o_orderkey", "left_semi")
    return keys.side_by_side(orders, lines, ["o_orderkey"])


_CRC = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT] || [x::UBIGINT for x in range(8)], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(256) r(i)))"""


@query(f"""WITH {_CRC}, k AS (SELECT p_partkey, hex(encode('grp:' || p_brand)) AS x FROM part)
SELECT p_partkey, (xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || [('0x' || substr(x, 2 * i + 1, 2))::UBIGINT for i in range(length(x) // 2)], lambda a, y: xor(a >> 8, t[((xor(a, y) & 255) + 1)::BIGINT]))) % 3)::INTEGER AS fold FROM k, crc_table""")
def proj_crc_folds(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", keys.crc_fold(F.col("p_brand"), 3, "grp:").alias("fold"))


_SEL = "a AS (SELECT l_partkey AS s1, l_suppkey AS cand FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey AS s1, l_suppkey AS cand FROM lineitem WHERE l_discount > 0.08), c AS (SELECT l_partkey AS s1, l_suppkey AS cand FROM lineitem WHERE l_quantity < 5)"


@query(f"""WITH {_SEL} SELECT 'repeated_base' AS fault, count(*)::BIGINT AS n FROM (SELECT s1, cand FROM a GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'repeated_additions', count(*) FROM (SELECT s1, cand FROM b GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'repeated_mask', count(*) FROM (SELECT s1, cand FROM c GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'additions_in_base', count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM a)
UNION ALL SELECT 'mask_unknown', count(*) FROM (SELECT * FROM c EXCEPT (SELECT * FROM a UNION SELECT * FROM b)) UNION ALL SELECT 'additions_masked', count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM c)""")
def set_selection_faults(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("s1"), F.col("l_suppkey").alias("cand"), "l_returnflag", "l_discount", "l_quantity")
    return keys.selection_faults(li.filter("l_returnflag = 'R'"), li.filter("l_discount > 0.08"), li.filter("l_quantity < 5"), ["s1", "cand"])


@query("""WITH h AS (SELECT md5(p_brand || chr(31) || p_name || chr(31) || p_partkey::VARCHAR) AS h FROM part),
s AS (SELECT substr(h, 1, 2) AS b, count(*) AS n, sum(('0x' || substr(h, 3, 15))::BIGINT)::VARCHAR AS x, sum(('0x' || substr(h, 18, 15))::BIGINT)::VARCHAR AS y FROM h GROUP BY 1)
SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(b || ':' || n || ':' || x || ':' || y, ',' ORDER BY b || ':' || n || ':' || x || ':' || y)) AS digest FROM s""")
def io_digest(spark, sf_dir):
    return keys.digest(_table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey"))


_FAULTY = "SELECT CASE WHEN s1 % 50 = 0 THEN 's' || s1_id ELSE s1_id END AS k, CASE s1 % 6 WHEN 0 THEN 'S2-1,S2-1' WHEN 1 THEN '' WHEN 2 THEN 'S2-3, S3-4' WHEN 3 THEN 'X9,S2-2' WHEN 4 THEN s1_id ELSE ' ,S2-7' END AS l FROM {s1} UNION ALL SELECT s1_id, 'S2-9' FROM {s1} WHERE s1 % 20 = 7"


@query(f"""WITH {fx.WITH}, f AS ({_FAULTY.replace('{s1}', 'er_s1')}), x AS (SELECT k, list_filter(list_transform(string_split(l, ','), lambda v: trim(v)), lambda v: v <> '') AS i FROM f)
SELECT 'repeated_keys' AS fault, (count(*) - count(DISTINCT k))::BIGINT AS n FROM x UNION ALL SELECT 'repeated_ids', count(*) FILTER (len(i) <> len(list_distinct(i))) FROM x UNION ALL SELECT 'bad_prefix', count(*) FILTER (len(list_filter(i, lambda v: NOT starts_with(v, 'S'))) > 0) FROM x
UNION ALL SELECT 'self_match', count(*) FILTER (list_contains(i, k)) FROM x UNION ALL SELECT 'missing_keys', count(*) FROM er_s1 WHERE s1_id NOT IN (SELECT k FROM f) UNION ALL SELECT 'extra_keys', count(DISTINCT k) FROM f WHERE k NOT IN (SELECT s1_id FROM er_s1)""")
def io_list_faults(spark, sf_dir):
    s1, _, _ = fx.corpus(spark, sf_dir)
    df = spark.sql(_FAULTY, s1=s1)
    within = io.list_faults(df, "k", "l")
    rows = within.select(F.explode(F.array(*[F.struct(F.lit(c).alias("fault"), F.col(c).cast("long").alias("n")) for c in within.columns])).alias("f")).select("f.*")
    return rows.unionByName(io.anchor_faults(df, "k", s1.select(F.col("s1_id").alias("k"))))


# ---------------------------------------------------------------- normalisers
_RAW = "s1::VARCHAR || ' ' || name || CASE s1 % 3 WHEN 0 THEN ' (Ｆｕｌｌ) ½' WHEN 1 THEN ' — Зал №7' ELSE ' ﬁn नमस्ते' END"
_RAW_SPARK = _RAW.replace("s1::VARCHAR", "cast(s1 as string)")


@query(f"""SELECT s1, trim(regexp_replace(lower(replace(replace(replace(replace(nfc_normalize(v), 'Ｆｕｌｌ', 'Full'), '½', '1⁄2'), 'ﬁ', 'fi'), '№', 'No')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')) AS raw FROM (SELECT s1, {_RAW} AS v FROM er_s1)""", "er")
def norm_raw_view(spark, sf_dir):
    s1, _, _ = fx.corpus(spark, sf_dir)
    return s1.select("s1", text.raw_view(F.expr(_RAW_SPARK)).alias("raw"))


#: Texts of several scripts and their ASCII fold.
FOLDS = [
    ("Fócus Léarning", "focus learning"), ("N° 12 Rue", "no 12 rue"), ("Œuvre  ﬁne ß", "oeuvre fine ss"), ("राम", "raama"), ("Москва", "moskva"), ("カタ", "kata"), ("한국", "hangug"), ("١٢", "12"), ("Łódź", "lodz"), ("", ""), ("plain 7", "plain 7"),
]


@query(_values(FOLDS, "s, folded"))
def norm_fold_scripts(spark, sf_dir):
    return spark.createDataFrame([(s,) for s, _ in FOLDS], "s string").select("s", text.fold_scripts(F.col("s")).alias("folded"))


_NUMBERED = "CASE s1 % 4 WHEN 0 THEN '0070 AVENUE 18 ' || addr WHEN 1 THEN 'COUR2 ' || addr WHEN 2 THEN 'N°3, ' || addr ELSE addr || ' B12 007' END"


@query(f"""SELECT s1, array_to_string(list_transform(regexp_extract_all(lower(a), '(?:^|[^\\p{{L}}0-9])([0-9]+)', 1), lambda v: regexp_replace(v, '^0+([0-9])', '\\1')), ',') AS numbers FROM (SELECT s1, {_NUMBERED} AS a FROM er_s1)""", "er")
def norm_address_numbers(spark, sf_dir):
    """Numbers of an address that no letter stands right before, without leading zeros."""
    s1, _, _ = fx.corpus(spark, sf_dir)
    return s1.select("s1", F.array_join(patterns.all_numbers(F.expr(_NUMBERED)), ",").alias("numbers"))


@query("""SELECT s1, house::VARCHAR || '|' || array_to_string(list_sort(list_filter(string_split(street, ' '), lambda t: t <> '')[1:4]), ' ') AS key FROM er_s1""", "er")
def norm_street_keys(spark, sf_dir):
    s1, _, _ = fx.corpus(spark, sf_dir)
    return s1.select("s1", text.street_key(F.col("house"), text.tokens(F.col("street"))).alias("key"))


@query("""SELECT * FROM (VALUES ('4 Elm, New Delhi', 'India', '4 elm dl'), ('4 Elm, San Juan, Puerto Rico', 'US', '4 elm san juan pr'), ('4 Elm, Tamilnadu', 'India', '4 elm tn'), ('4 Elm Rd, WestBengal', 'India', '4 elm road wb'),
  ('Door No 4, Elm St, New York', 'US', '4 elm street ny'), ('4 Elm, OR', 'India', '4 elm od'), ('4 Elm, OR', 'US', '4 elm or'), ('null', 'US', ''), ('4 Elm, Jammu and Kashmir', 'India', '4 elm jk')) t(addr, country, addr_n)""")
def norm_state_literals(spark, sf_dir):
    rows = [
        ("4 Elm, New Delhi", "India"), ("4 Elm, San Juan, Puerto Rico", "US"), ("4 Elm, Tamilnadu", "India"), ("4 Elm Rd, WestBengal", "India"), ("Door No 4, Elm St, New York", "US"), ("4 Elm, OR", "India"), ("4 Elm, OR", "US"),
        ("null", "US"), ("4 Elm, Jammu and Kashmir", "India"),
    ]
    return spark.createDataFrame(rows, "addr string, country string").select("addr", "country", text.addr_views(F.col("addr"), F.col("country"))["addr_n"].alias("addr_n"))


# ---------------------------------------------------------------- records and blocking
@query(f"""WITH w AS (SELECT country, list_distinct({_toks(text.BLOCK_NAME.sql('name'))}) AS w FROM (SELECT country, name FROM er_s1 UNION ALL SELECT country, name FROM er_pool)), e AS (SELECT country, unnest(w) AS word FROM w), d AS (SELECT country, word, count(*) AS df FROM e GROUP BY ALL),
g AS (SELECT word, sum(df) AS dfg FROM d GROUP BY word), n AS (SELECT country, count(*) AS nc FROM w GROUP BY country)
SELECT country, word, df::BIGINT AS df, round(ln((SELECT count(*) FROM w) / dfg), 6) AS idf_global, round(ln(nc / df) + 0.7, 6) AS idf_country FROM d JOIN g USING (word) JOIN n USING (country)""", "er")
def rec_pack_idf(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    words = lambda df: df.select("country", text.tokens(text.BLOCK_NAME(F.col("name"))).alias("words"))
    return records.pack_idf(words(s1), words(pool)).select("country", "word", "df", _r("idf_global").alias("idf_global"), _r("idf_country").alias("idf_country"))


@query(f"""WITH {fx.WITH}, {_record_sql('er_pool', 'cand', 'b')}
SELECT cand, name_n, name_core, name_skel, addr_n, coalesce(nums[1], -1)::BIGINT AS num_first, len(nums)::BIGINT AS n_nums, len({_toks('name_n')})::BIGINT AS ntok_name, len({_toks('addr_n')})::BIGINT AS ntok_addr, addr_key, addr_n = '' AS addr_empty, NOT regexp_matches(addr_n, '[0-9]') AS addr_nodigit, 0::INTEGER AS script FROM b""")
def rec_full_views(spark, sf_dir):
    """Every view column of every record, names and addresses as in the single queries."""
    _, pool, _ = fx.corpus(spark, sf_dir)
    return records.views(pool).select("cand", "name_n", "name_core", "name_skel", "addr_n", "num_first", "n_nums", "ntok_name", "ntok_addr", "addr_key", "addr_empty", "addr_nodigit", "script")


_PACK_REGIONS = {"nord": "hdf", "new york": "ny", "tamil nadu": "tn"}
#: Features whose pack view replaces the plain one in the gated country: those that read names, addresses, numbers or idf.
PACK_FEATURES = [f for f in pairs.FUZZY if not f.endswith("_raw")] + [
    "core_eq", "ns_eq", "n_inter", "n_wjac", "n_cov1", "n_cov2", "n_miss_max", "n_extra_max", "n_miss_cnt", "n_extra_cnt", "a_inter", "a_wjac", "a_cov1", "a_cov2", "a_miss_max", "a_extra_max",
    "num_inter", "num_jac", "num_cnt1", "num_cnt2", "num_miss1", "num_extra2", "num_first_both", "num_first_eq", "num_first_off1", "num_first_ldiff", "ntok_name1", "ntok_name2", "ntok_addr1", "ntok_addr2",
]


@query()
def feat_pack_views(spark, sf_dir):
    """Base features of the packed views of one country's records, in place of the plain ones on its pairs, and three agreements of the pack (suffix, region, street key)."""
    s1, pool, _ = fx.corpus(spark, sf_dir)
    p = fx.pairs(spark, sf_dir).filter("country = 'France'").select("s1", "cand")
    agree = {"pk_sfx_agree": "hn_sfx", "pk_adm_agree": "adm", "pk_street_agree": "street_key"}
    packed = lambda df: stage(records.pack_views(df, _PACK_REGIONS, ["france"]).select("text", "name", "addr", "country", *agree.values()), "packed")
    x = pairs.base_features(p, s1, pool, only=PACK_FEATURES, views=lambda df: pairs.seen_views(packed(df)), agree=agree)
    return x.select("s1", "cand", *[F.col(c).alias(f"pk_{c}") for c in PACK_FEATURES], *agree)


@query("""WITH t AS (SELECT s1, cand FROM pairs WHERE label = 1 AND s1 % 4 = 0) SELECT s1, cand, (s1, cand) IN (SELECT (s1, cand) FROM t) AS ft_seen, s1 IN (SELECT s1 FROM t) AS ft_seen_s1, cand IN (SELECT cand FROM t) AS ft_seen_cand FROM pairs""", "pairs")
def block_training_flags(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return blocking.seen_in_training(p.select("s1", "cand"), p.filter("label = 1 AND s1 % 4 = 0").select("s1", "cand"))


@query("""SELECT s1, 'train' AS split FROM er_s1 WHERE ('0x' || substr(md5('7' || s1::VARCHAR), 1, 8))::BIGINT % 1000 >= 0 UNION ALL SELECT s1, 'test' FROM er_s1""", "er")
def block_query_mask(spark, sf_dir):
    s1, _, _ = fx.corpus(spark, sf_dir)
    return blocking.query_mask(s1, "train").select("s1", F.lit("train").alias("split")).unionByName(blocking.query_mask(s1, "test").select("s1", F.lit("test").alias("split")))


@query("""SELECT s1, cand, 'whole' AS view, 'query: ' || a.name || ' | ' || a.addr AS a, 'query: ' || b.name || ' | ' || b.addr AS b FROM er_truth JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand)
UNION ALL SELECT s1, cand, 'name', 'query: ' || a.name || ' | ', 'query: ' || b.name || ' | ' FROM er_truth JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand)""", "er")
def block_training_pairs(spark, sf_dir):
    """Two views of every true pair, as an encoder would be fitted on."""
    s1, pool, truth = fx.corpus(spark, sf_dir)
    return blocking.training_pairs(truth, s1, pool)


@query(f"""WITH {fx.WITH}, w AS (SELECT s1, unnest({_toks(text.BLOCK_NAME.sql('name'))}) AS w FROM er_s1), u AS (SELECT s1, ' ' || w || ' ' AS p, unnest([3, 4, 5]) AS n FROM w), v AS (SELECT *, unnest(range(1, greatest(len(p) + 1 - n, 1) + 1)) AS i FROM u),
g AS (SELECT s1, (('0x' || substr(md5(substr(p, i, n)), 1, 8))::BIGINT % 16)::INTEGER AS b, count(*) AS n FROM v GROUP BY ALL), z AS (SELECT s1, sqrt(sum(n * n)) AS norm FROM g GROUP BY s1)
SELECT s1, b, round(n / norm, 6) AS weight FROM g JOIN z USING (s1)""")
def block_hashed_vectors(spark, sf_dir):
    """Hashed letter runs as vectors; zeros left out here."""
    s1, _, _ = fx.corpus(spark, sf_dir)
    v = features.hashed_vectors(s1.select("s1", text.BLOCK_NAME(F.col("name")).alias("n")), "s1", "n", 16)
    return v.select("s1", F.posexplode("vec").alias("b", "weight")).filter("weight > 0").select("s1", "b", _r("weight").alias("weight"))


# ---------------------------------------------------------------- decisions
_EV = "SELECT s1, cand, (cand % 7) / 7.0 AS z_std, (cand % 3 = 0)::INTEGER AS missing_gate, 1 AS num_first_both, (cand % 2)::INTEGER AS num_first_eq FROM pairs WHERE cand % 5 <> 0"


@query(f"""WITH ev AS ({_EV}), o AS (SELECT s1, cand, p, coalesce(CASE WHEN row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) = 1 THEN nth_value(p, 2) OVER (PARTITION BY cand ORDER BY p DESC, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE max(p) OVER (PARTITION BY cand) END, -1) AS po FROM pairs),
q AS (SELECT s1, count(*)::BIGINT AS q_band_n, sum(missing_gate)::DOUBLE AS q_missing_n, sum(num_first_both - num_first_eq)::DOUBLE AS q_conflict_n, max(z_std) AS q_spread_max FROM ev GROUP BY s1),
s AS (SELECT o.s1, o.cand, row_number() OVER w AS k, coalesce(z_std, -1) AS z, coalesce(missing_gate, -1)::DOUBLE AS m FROM o LEFT JOIN ev USING (s1, cand) WHERE p >= po AND p > 0.02 WINDOW w AS (PARTITION BY o.s1 ORDER BY p DESC, o.cand)),
n AS (SELECT *, lead(z, 1, -1) OVER w AS nz, lead(m, 1, -1) OVER w AS nm FROM s WINDOW w AS (PARTITION BY s1 ORDER BY k)),
r AS (SELECT s1, k, z AS lz, m AS lm, nz, nm FROM n WHERE k <= 10 UNION ALL SELECT s1, 0, -1, -1, z, m FROM n WHERE k = 1)
SELECT s1, k::INTEGER AS k, round(lz, 6)::DOUBLE AS last_z_std, lm::DOUBLE AS last_missing_gate, round(nz, 6)::DOUBLE AS next_z_std, nm::DOUBLE AS next_missing_gate, coalesce(q_band_n, 0)::BIGINT AS q_band_n, coalesce(q_missing_n, 0) AS q_missing_n, coalesce(q_conflict_n, 0) AS q_conflict_n, round(coalesce(q_spread_max, 0), 6)::DOUBLE AS q_spread_max
FROM r LEFT JOIN q USING (s1)""", "pairs")
def dec_evidence_prefixes(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    ev = p.filter("cand % 5 <> 0").select("s1", "cand", ((F.col("cand") % 7) / 7.0).alias("z_std"), (F.col("cand") % 3 == 0).cast("int").alias("missing_gate"), F.lit(1).alias("num_first_both"), (F.col("cand") % 2).cast("int").alias("num_first_eq"))
    u = decide.universe(keys.with_max_other(p, "cand", "p", "s1", "p_other", -1.0))
    t = decide.evidence_prefixes(u, ev, ["z_std", "missing_gate"], "z_std", "missing_gate")
    return t.select("s1", F.col("k").cast("int").alias("k"), _r("last_z_std").alias("last_z_std"), "last_missing_gate", _r("next_z_std").alias("next_z_std"), "next_missing_gate", "q_band_n", "q_missing_n", "q_conflict_n", _r("q_spread_max").alias("q_spread_max"))


# ---------------------------------------------------------------- patterns
def _name_families(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Neighbour pairs by family, told once for every two different names that meet; and all pairs with their score."""
    s1, pool, _ = fx.corpus(spark, sf_dir)
    side = lambda df, i, h: df.select(i, "name", F.col("house").alias(h))
    met, texts, _, _ = pairs.meet(fx.pairs(spark, sf_dir).select("s1", "cand", "country", "p"), side(s1, "s1", "ha"), side(pool, "cand", "hb"), {"n": ["name"]})
    words = lambda c: texts["n"].select("text", text.tokens(text.BLOCK_NAME(F.col("name"))).alias(c))
    two = pairs.different(met, "n", words("words_a"), words("words_b")).select(F.col("a_n").alias("s1"), F.col("b_n").alias("cand"), F.lit("").alias("country"), F.lit(0).alias("k"), "words_a", "words_b")
    told = patterns.name_families(two, ["group", "holdings"], ["services"], ["france", "india"]).select(F.col("s1").alias("a_n"), F.col("cand").alias("b_n"), "family", "wnew", "wold")
    fam = met.withColumn("k", F.col("hb") - F.col("ha")).join(keys.large(stage(told, "compared")), ["a_n", "b_n"])
    return fam.select("s1", "cand", "country", "k", "family", *patterns.offset_marks(F.col("k")), "wnew", "wold"), met.select("s1", "cand", "p")


_LEG = _list(sorted({*patterns.LEGAL_FR, *patterns.LEGAL_EN}))
_FAM_SQL = f"""WITH w AS (SELECT p.s1, p.cand, p.country, p.p, b.house - a.house AS k, {_toks(text.BLOCK_NAME.sql('a.name'))} AS x, {_toks(text.BLOCK_NAME.sql('b.name'))} AS y FROM pairs p JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand)),
t AS (SELECT *, list_filter(x, lambda v: NOT list_contains({_LEG}, v)) AS ca, list_filter(y, lambda v: NOT list_contains({_LEG}, v)) AS cb, list_filter(x, lambda v: list_contains({_LEG}, v)) AS fa, list_filter(y, lambda v: list_contains({_LEG}, v)) AS fb FROM w),
n AS (SELECT *, list_filter(list_transform(range(1, len(cb) + 1), lambda i: CASE WHEN len(list_filter(cb[1:i], lambda v: v = cb[i])) > len(list_filter(ca, lambda v: v = cb[i])) THEN cb[i] END), lambda v: v IS NOT NULL) AS more,
  list_filter(list_transform(range(1, len(ca) + 1), lambda i: CASE WHEN len(list_filter(ca[1:i], lambda v: v = ca[i])) > len(list_filter(cb, lambda v: v = ca[i])) THEN ca[i] END), lambda v: v IS NOT NULL) AS less,
  len(list_filter(fb, lambda v: NOT list_contains(fa, v))) > 0 AS lm, len(list_filter(fa, lambda v: NOT list_contains(fb, v))) > 0 AS ll FROM t),
f AS (SELECT s1, cand, country, k, p, CASE WHEN len(more) = 1 THEN more[1] END AS wnew, CASE WHEN len(less) = 1 THEN less[1] END AS wold, CASE WHEN len(ca) = 0 OR len(cb) = 0 THEN NULL WHEN len(more) = 0 AND len(less) = 0 AND lm AND ll THEN 'LEGSW' WHEN len(more) = 0 AND len(less) = 0 AND lm THEN 'LEGADD' WHEN len(more) = 0 AND len(less) = 0 AND ll THEN 'LEGDROP'
  WHEN len(more) = 0 AND len(less) = 0 THEN 'EQ' WHEN len(more) = 1 AND len(less) = 0 AND more[1] IN ('france', 'india') THEN 'CTAG' WHEN len(more) = 1 AND len(less) = 0 AND more[1] IN ('group', 'holdings') THEN 'ADDW' WHEN len(more) = 1 AND len(less) = 0 AND more[1] = 'services' THEN 'ADDF'
  WHEN len(more) = 1 AND len(less) = 0 THEN 'ADDO' WHEN len(less) = 0 THEN 'ADD2' WHEN len(more) = 0 THEN 'SUB' WHEN len(cb) = 1 AND len(ca) >= 2 AND cb[1] = array_to_string(list_transform(ca, lambda v: left(v, 1)), '') THEN 'ACR'
  WHEN len(more) = 1 AND len(less) = 1 AND len(less[1]) >= 4 AND levenshtein(less[1], more[1]) <= CASE WHEN greatest(len(less[1]), len(more[1])) <= 5 THEN 1 ELSE 2 END THEN 'TYPO' WHEN len(more) = 1 AND len(less) = 1 AND more[1] IN ('group', 'holdings') THEN 'SWDW'
  WHEN len(more) = 1 AND len(less) = 1 AND more[1] = 'services' THEN 'SWFIL' WHEN len(more) = 1 AND len(less) = 1 THEN 'SWOTH' WHEN len(list_intersect(ca, cb)) / greatest(len(list_distinct(list_concat(ca, cb))), 1) >= 0.5 THEN 'NEAR' END AS family FROM n),
fam AS (SELECT s1, cand, country, k::BIGINT AS k, p, family, CASE WHEN abs(k) IN (1, 2) THEN 'D12' WHEN abs(k) IN ({', '.join(map(str, features.OFFSETS))}) THEN 'D3' ELSE 'ND' END AS bucket, CASE WHEN k > 0 THEN '+' WHEN k < 0 THEN '-' ELSE '0' END AS side, wnew, wold FROM f WHERE family IS NOT NULL)"""


@query(f"{_FAM_SQL} SELECT s1, cand, country, k, family, bucket, side, wnew, wold FROM fam", "pairs")
def pat_name_families(spark, sf_dir):
    return _name_families(spark, sf_dir)[0].select("s1", "cand", "country", F.col("k").cast("long").alias("k"), "family", "bucket", "side", "wnew", "wold")


@query(f"""{_FAM_SQL}, sel AS (SELECT s1, cand FROM pairs WHERE p >= 0.1), hit AS (SELECT DISTINCT 'R' AS rule, s1, cand FROM fam WHERE side = '+' AND country = 'US' AND ((family = 'LEGADD' AND bucket IN ('D12', 'D3')) OR (family = 'LEGSW' AND bucket = 'D3'))
  UNION SELECT DISTINCT 'FR9', s1, cand FROM fam WHERE side = '+' AND country = 'France' AND family IN ('LEGADD', 'LEGSW', 'CTAG') AND bucket IN ('D12', 'D3') AND cand % 2 = 0
  UNION SELECT DISTINCT 'R+', s1, cand FROM fam WHERE side = '+' AND ((country = 'US' AND ((family IN ('LEGADD', 'LEGSW') AND bucket IN ('D12', 'D3')) OR (family = 'SWDW' AND bucket = 'D3') OR (family = 'ADDO' AND bucket = 'D12'))) OR (country = 'India' AND family IN ('LEGADD', 'LEGSW') AND bucket = 'D3' AND cand % 2 = 0))),
gone AS (SELECT * FROM hit JOIN sel USING (s1, cand)), per AS (SELECT s1, count(*) AS had FROM sel GROUP BY s1), lost AS (SELECT rule, s1, count(*) AS n_gone FROM gone GROUP BY ALL)
SELECT rule, s1, cand FROM gone JOIN per USING (s1) JOIN lost USING (rule, s1) WHERE n_gone < had""", "pairs")
def pat_removal_rules(spark, sf_dir):
    fam, scored = _name_families(spark, sf_dir)
    fam = stage(fam.select("s1", "cand", "country", "family", "bucket", "side"), "families")
    return patterns.removals(fam, scored.filter("p >= 0.1").select("s1", "cand"), ["R", "FR9", "R+"], fam.filter("cand % 2 = 0")).select("rule", "s1", "cand")


@query("""WITH sel AS (SELECT s1, cand, p FROM pairs WHERE p >= 0.3), m AS (SELECT sel.s1, sel.cand, o.s1 AS other, o.p AS po FROM sel JOIN pairs o ON o.cand = sel.cand AND o.s1 <> sel.s1 AND o.p >= sel.p WHERE o.s1 IN (SELECT s1 FROM sel))
SELECT s1, cand, arg_max(other, (po, -other)) AS other FROM m GROUP BY s1, cand""", "pairs")
def pat_swapped_owner(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).select("s1", "cand", "p")
    return patterns.swapped_owner(p, p.filter("p >= 0.3"))


# ---------------------------------------------------------------- word lists
_KEYED = f"SELECT s1, regexp_replace(lower(addr), '^0+', '') AS key, {text.BLOCK_NAME.sql('name')} AS n FROM er_s1"
_ANCHOR_SQL = f"""WITH RECURSIVE {fx.WITH}, k AS ({_KEYED}), l AS (SELECT key, min(s1) AS s1 FROM k GROUP BY key HAVING count(*) = 1),
p AS (SELECT l.s1, b.cand, {_toks('k.n')} AS a, {_toks(text.BLOCK_NAME.sql('b.name'))} AS b FROM l JOIN k USING (s1) JOIN er_pool b ON regexp_replace(lower(b.addr), '^0+', '') = l.key),
z AS (SELECT s1, cand, {_SETS_SQL.format(a='a', b='b', p='')} FROM p), need AS (SELECT only_a AS x, only_b AS y FROM z), {_lcs_sql('need')},
r AS (SELECT s1, cand, round({_set_sql('shared', 'only_a', 'only_b', 'l')}, 6)::DOUBLE AS alike FROM z JOIN lcs ON x = only_a AND y = only_b)"""


@query(f"{_ANCHOR_SQL} SELECT s1, cand, alike FROM r WHERE alike >= 95")
def words_anchor_pairs(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    key = lambda df: df.withColumns({"key": F.regexp_replace(F.lower("addr"), "^0+", ""), "name_n": text.BLOCK_NAME(F.col("name"))})
    return wordlists.anchor_pairs(key(s1), key(pool), ["key"])


_PLACES = {"troy": "NY", "salem": "TN", "lille": "HDF", "portland": "OR", "billings": "MT"}
_KNOWN = {"new york": "NY", "tamil nadu": "TN"}
_PARTS = "list_transform(string_split(regexp_replace(lower(addr), '^0*[0-9]+ ', ''), ','), lambda c: trim(c))"


@query(f"""WITH {fx.WITH}, d AS (SELECT cand AS id, {_PARTS} AS parts FROM er_pool WHERE addr <> ''), e AS (SELECT id, len(list_filter(parts, lambda c: {_map(_KNOWN)}[c] IS NOT NULL)) > 0 AS named, unnest(list_distinct(parts)) AS part FROM d),
v AS (SELECT id, min({_map(_PLACES)}[part]) AS area FROM e WHERE {_map(_PLACES)}[part] IS NOT NULL GROUP BY id HAVING count(DISTINCT {_map(_PLACES)}[part]) = 1), o AS (SELECT * FROM e WHERE {_map(_KNOWN)}[part] IS NULL AND {_map(_PLACES)}[part] IS NULL),
t AS (SELECT part, count(*) AS n_all, avg(named::INTEGER) AS beside FROM o GROUP BY part), g AS (SELECT part, area, count(*) AS n FROM o JOIN v USING (id) GROUP BY part, area),
r AS (SELECT *, sum(n) OVER (PARTITION BY part) AS t, row_number() OVER (PARTITION BY part ORDER BY n DESC, area) AS k FROM g)
SELECT part AS alias, area, n::BIGINT AS n FROM r JOIN t USING (part) WHERE k = 1 AND n >= 10 AND n >= 0.9 * r.t AND n >= 0.5 * n_all AND beside < 0.2""")
def words_area_aliases(spark, sf_dir):
    _, pool, _ = fx.corpus(spark, sf_dir)
    parts = F.transform(F.split(F.regexp_replace(F.lower("addr"), "^0*[0-9]+ ", ""), ","), lambda c: F.trim(c))
    places = spark.createDataFrame(list(_PLACES.items()), "place string, area string")
    return wordlists.area_aliases(pool.filter("addr <> ''").select(F.col("cand").alias("id"), parts.alias("parts")), _KNOWN, places, least=10)


@query(f"""WITH {fx.WITH}, w AS (SELECT s1, country, unnest({_toks(text.BLOCK_NAME.sql('name'))}) AS w FROM er_s1), u AS (SELECT s1, country, ' ' || w || ' ' AS p, unnest([3, 4, 5]) AS n FROM w), v AS (SELECT *, unnest(range(1, greatest(len(p) + 1 - n, 1) + 1)) AS i FROM u),
g AS (SELECT DISTINCT s1, country, substr(p, i, n) AS g FROM v), s AS (SELECT country, count(*) AS n FROM er_s1 GROUP BY country)
SELECT country, g, count(*)::BIGINT AS df, round(ln((1 + any_value(n)) / (1 + count(*))) + 1, 6) AS idf FROM g JOIN s USING (country) GROUP BY country, g""")
def words_gram_idf(spark, sf_dir):
    s1, _, _ = fx.corpus(spark, sf_dir)
    return features.gram_idf(s1.select("country", text.BLOCK_NAME(F.col("name")).alias("n")), "n", "country").select("country", "g", "df", _r("idf").alias("idf"))


# ---------------------------------------------------------------- learning
@query(f"""WITH {_CRC}, k AS (SELECT p_partkey, hex(encode('name:' || p_name)) AS x FROM part)
SELECT p_partkey, (xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || [('0x' || substr(x, 2 * i + 1, 2))::UBIGINT for i in range(length(x) // 2)], lambda a, y: xor(a >> 8, t[((xor(a, y) & 255) + 1)::BIGINT]))) % 3)::INTEGER AS fold FROM k, crc_table""")
def learn_group_folds(spark, sf_dir):
    return learning.group_folds(_table(spark, sf_dir, "part"), "p_name").select("p_partkey", "fold")


@query("SELECT s1, cand, round(1.0 / count(*) OVER (PARTITION BY s1), 9)::DOUBLE AS weight FROM pairs", "pairs")
def learn_balanced_weights(spark, sf_dir):
    return learning.balanced_weights(fx.pairs(spark, sf_dir)).select("s1", "cand", _r("weight", 9).alias("weight"))


def _scores(spark, sf_dir) -> DataFrame:
    p = fx.pairs(spark, sf_dir)
    return p.select("s1", "cand", "label", "p", (F.col("p") * 0.5 + 0.2).alias("q"), (((F.col("cand") * 31) % 97 + 1) / 100.0).alias("r"))


@query()
def learn_blends(spark, sf_dir):
    """Weights on the simplex, by grid and by gradient, and the mean of a logistic blend: one row per method (tests hold the gradient against the grid)."""
    x = stage(_scores(spark, sf_dir), "scores")
    rows = [("grid", *learning.simplex_blend(x, ["p", "q", "r"], "label", 4).values()), ("gradient", *learning.simplex_fit(x, ["p", "q", "r"], "label", 8).values())]
    mean = learning.platt(x, ["p", "q"], "label", "blend").agg(F.avg("blend")).first()[0]
    return spark.createDataFrame([(m, *map(float, w), float(mean)) for m, *w in rows], "method string, p double, q double, r double, blend_mean double")


@query()
def learn_row_model(spark, sf_dir):
    """The model that tells anchors without matches, out of fold, on the row features of their candidates."""
    p = keys.with_max_other(fx.pairs(spark, sf_dir), "cand", "p", "s1", "p_other", -1.0).withColumn("elig", F.col("p") >= F.col("p_other"))
    x = decide.row_features(p).join(p.groupBy("s1").agg((F.sum("label") == 0).cast("int").alias("empty")), "s1").withColumn("fold", keys.bucket(F.col("s1"), 2))
    return learning.cross_fit(x, ["r_p1", "r_p2", "r_gap12", "r_sum", "r_nelig"], "empty", "fold", rounds=5, depth=2, out="p_empty").select("s1", "empty", _r("p_empty").alias("p_empty"))


@query()
def learn_count_model(spark, sf_dir):
    """p_single and the expected number of matches per anchor (a test holds them against a known rule)."""
    p = fx.pairs(spark, sf_dir)
    a = p.groupBy("s1").agg(F.max("p").alias("pmax"), F.sum("p").alias("psum"), F.sum("label").cast("int").alias("m"))
    return learning.count_model(a, ["pmax", "psum"], "m").select("s1", _r("p_single").alias("p_single"), _r("n_expected").alias("n_expected"))


@query(f"""WITH {_BASE_SQL}, f AS (SELECT name_n, count(*) AS n FROM a GROUP BY name_n)
SELECT s1, cand, coalesce(f.n, 0)::BIGINT AS full_form_s1_count, len(list_intersect({_toks('a.name_core')}, {_toks('b.name_core')}))::INTEGER AS n_core_shared, (a.name_core = b.name_core)::INTEGER AS core_eq, (a.addr_n = b.addr_n)::INTEGER AS addr_eq, (b.addr_n = '')::INTEGER AS addr_empty_2,
  (a.country = 'India')::INTEGER AS india, list_contains({_toks('b.name_n')}, 'llc')::INTEGER AS has_llc, list_contains({_toks('b.name_n')}, 'sarl')::INTEGER AS has_sarl FROM pairs JOIN a USING (s1) JOIN b USING (cand) LEFT JOIN f ON f.name_n = b.name_n""")
def learn_specialist_features(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    a, b = records.views(s1), records.views(pool)
    side = lambda df, i, k: df.select(i, *[F.col(c).alias(f"{c}_{k}") for c in ("name_n", "name_core", "addr_n")])
    x = fx.pairs(spark, sf_dir).select("s1", "cand", "country").join(side(a, "s1", 1), "s1").join(side(b, "cand", 2), "cand")
    out = learning.specialist_features(x, a, ["llc", "sarl"])
    return out.select("s1", "cand", "full_form_s1_count", "n_core_shared", "core_eq", "addr_eq", "addr_empty_2", "india", "has_llc", "has_sarl")


# ---------------------------------------------------------------- evaluation
_SETS = "SELECT 'anchor' AS set, s1, cand FROM pairs WHERE label = 1 UNION ALL SELECT 'decoy', s1, cand FROM pairs WHERE label = 0 AND cand % 4 >= 2"


@query(f"""WITH st AS ({_SETS}), sel AS (SELECT s1, cand FROM pairs WHERE p >= 0.45) SELECT set, count(*)::BIGINT AS n, count(sel.cand)::BIGINT AS accepted, round(count(sel.cand) / count(*), 6) AS share FROM st LEFT JOIN sel USING (s1, cand) GROUP BY set""", "pairs")
def eval_acceptance(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    one = lambda name, where: p.filter(where).select(F.lit(name).alias("set"), "s1", "cand")
    return evaluate.acceptance(p.filter("p >= 0.45"), one("anchor", "label = 1").unionByName(one("decoy", "label = 0 AND cand % 4 >= 2")))


@query("""WITH sel AS (SELECT s1, cand, country FROM pairs WHERE p >= 0.45), k AS (SELECT s1, count(*) AS k FROM sel GROUP BY s1), a AS (SELECT country, coalesce(k, 0) AS k FROM er_s1 LEFT JOIN k USING (s1)), m AS (SELECT country, cand, count(*) AS n FROM sel GROUP BY ALL HAVING count(*) > 1),
mm AS (SELECT country, count(*) AS r, sum(n) AS p FROM m GROUP BY country)
SELECT country, count(*)::BIGINT AS n_s1, sum(k)::BIGINT AS matches, round(avg(k), 6) AS matches_per_s1, round(avg((k = 0)::INTEGER), 6) AS empty_share, coalesce(max(r), 0)::BIGINT AS multi_assigned_records, coalesce(max(p), 0)::BIGINT AS multi_pairs FROM a LEFT JOIN mm USING (country) GROUP BY country""", "pairs")
def eval_match_profile(spark, sf_dir):
    s1, _, _ = fx.corpus(spark, sf_dir)
    return evaluate.match_profile(fx.pairs(spark, sf_dir).filter("p >= 0.45").select("s1", "cand"), s1)


@query("SELECT country, count(*)::BIGINT AS n, count(*) FILTER (p > 0.02 AND p < 0.99)::BIGINT AS n_band, round(avg((p > 0.02 AND p < 0.99)::INTEGER), 6) AS band_share FROM pairs GROUP BY country", "pairs")
def eval_band_share(spark, sf_dir):
    return evaluate.band_share(fx.pairs(spark, sf_dir))


def _times(at: str) -> str:
    import math

    below, out = 0.0, []
    for k in range(6):
        below += math.exp(-1) / math.factorial(k)
        out.append(f"({at} >= {round(below, 9)})::INTEGER")
    return " + ".join(out)


@query(f"""WITH d AS (SELECT country || '/' || (s1 // 40) AS block, sum(p - 0.25) AS d, count(*) AS n FROM pairs GROUP BY 1), e AS (SELECT *, unnest(range(1, 21)) AS round FROM d),
t AS (SELECT *, ({_times("(('0x' || substr(md5(block || '/' || round::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0)")}) AS times FROM e) SELECT round::INTEGER AS round, round(sum(d * times) / sum(n * times), 9) AS mean FROM t GROUP BY round""", "pairs")
def eval_bootstrap(spark, sf_dir):
    """Twenty resampled means over blocks of anchors, drawn whole."""
    p = fx.pairs(spark, sf_dir).select(F.concat_ws("/", "country", F.floor(F.col("s1") / 40).cast("string")).alias("block"), (F.col("p") - 0.25).alias("delta"))
    return evaluate.bootstrap_sums(p, 20, "block").select("round", "mean")


# ---------------------------------------------------------------- the whole chain
def link(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Records to matches (s1, cand, score): both lexical channels, forward and reverse; base features and explanations of what they propose; a score; one owner per record; a threshold; vetoes.

    Without training data the score is a fixed sum of evidence (see EVIDENCE); a fitted model takes its place as a column.
    """
    ch = blocking.lexical_channels(s1, pool)
    reverse = ch["c1r"].filter("rank = 1 or gap < 2").unionByName(ch["c2r"].filter("rank = 1 or gap < 2"), allowMissingColumns=True).select("s1", "cand")
    found = ch["c1"].filter("rank <= 20").select("s1", "cand").union(ch["c2"].filter("rank <= 20").select("s1", "cand")).union(reverse).distinct()
    found = stage(found, "candidates")
    a, b = pairs.with_views(s1, pool)
    views = lambda df, i, t: df.select(i, *[F.col(c).alias(f"{t}_{c}") for c in ("addr_empty", "num_first")], *[c.alias(n) for n, c in pairs.views_of(["name_core", "addr_n"], t).items()])
    x = found.join(keys.large(views(a, "s1", "a")), "s1").join(keys.large(views(b, "cand", "b")), "cand")
    parts = {v: batch.set_parts(F.col(f"a_{v}_set"), F.col(f"b_{v}_set")) for v in ("name_core", "addr_n")}
    words = lambda v: F.size(F.array_intersect(f"a_{v}_set", f"b_{v}_set")) / F.greatest(F.size(F.array_union(f"a_{v}_set", f"b_{v}_set")), F.lit(1))
    rest = batch.fuzzy({"rest": parts["name_core"][1:]}, [("ratio", "rest")])
    both = (F.col("a_num_first") >= 0) & (F.col("b_num_first") >= 0)
    scored = x.withColumn("f", rest).withColumns({
        "name_j": words("name_core"), "addr_j": F.when(F.col("a_addr_empty") | F.col("b_addr_empty"), None).otherwise(words("addr_n")), "added": F.col("b_name_core").startswith(F.concat("a_name_core", F.lit(" "))),
        "house": F.when(both, (F.col("a_num_first") == F.col("b_num_first")).cast("double")),
    })
    score = EVIDENCE["name"] * F.col("name_j") + EVIDENCE["addr"] * F.coalesce("addr_j", F.lit(EVIDENCE["unknown"])) + EVIDENCE["house"] * F.coalesce("house", F.lit(EVIDENCE["unknown"])) - EVIDENCE["added"] * F.col("added").cast("double")
    return scored.select("s1", "cand", F.round(score, 6).alias("score"))


#: Weights of the fixed score: word overlap of names and of addresses, equal house numbers, the share credited to what is missing, the loss for a word added to the anchor's name.
EVIDENCE = {"name": 0.5, "addr": 0.2, "house": 0.3, "unknown": 0.6, "added": 0.2}
LEAST_SCORE = 0.75


@query()
def link_end_to_end(spark, sf_dir):
    """Records to id lists: candidates of four lexical channels, views and features, a score, one owner per record, one row per anchor. A test holds it against the known truth."""
    s1, pool, _ = fx.corpus(spark, sf_dir)
    own = competition.one_owner(link(s1, pool), "score").filter(F.col("score") >= LEAST_SCORE)
    ids = own.join(keys.large(pool.select("cand", "cand_id")), "cand").join(keys.large(s1.select("s1", "s1_id")), "s1")
    return io.id_lists(s1, ids.select("s1_id", "cand_id"), "s1_id", "cand_id", "matched")


@query()
def link_scores(spark, sf_dir):
    """The chain against the known truth: the report of its selection."""
    s1, pool, truth = fx.corpus(spark, sf_dir)
    scored = link(s1, pool)
    own = competition.one_owner(scored, "score").filter(F.col("score") >= LEAST_SCORE)
    marked = own.join(keys.large(truth.withColumn("label", F.lit(1))), ["s1", "cand"], "left").fillna(0, ["label"])
    counts = evaluate.truth_counts(s1, truth, scored)
    return evaluate.report(evaluate.row_scores(marked.select("s1", "cand", "label"), counts)).select("country", "mb", "n", *[_r(c).alias(c) for c in ("macro_f05", "micro_precision", "micro_recall", "oracle_ceiling")])


def entry(spark, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return link_end_to_end(spark, sf_dir)
