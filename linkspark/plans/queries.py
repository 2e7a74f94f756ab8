"""Every operator as a query over the tables of a folder, with the SQL that another engine runs for the same rows.

Names begin with the group of the operator: io, proj (projection and filters), join, agg, win (windows), sort, set, norm
(normalisers), sim (similarity), rec (records), block, feat, comp (competition), learn, words, dec (decisions), pat
(patterns), eval.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, similarity, text
from ..operators import blocking, competition, decide, evaluate, features, keys, learning, patterns, records, wordlists
from ..sources import io
from . import fixture as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, needs: str = "") -> Callable:
    """Register a query under its function's name; `needs`: the fixture's views that its SQL uses."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            with_ = {"": "", "er": fx.WITH, "pairs": fx.WITH_PAIRS}[needs]
            body = sql.strip()
            ORACLE_SQL[f.__name__] = body if not with_ else f"WITH {with_}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, n: int = 6):
    return F.round(c, n)


def _list(items) -> str:
    return "[" + ", ".join(text.sql_text(x) for x in items) + "]"


def _map(table: dict) -> str:
    return "MAP {" + ", ".join(f"{text.sql_text(k)}: {text.sql_text(v)}" for k, v in table.items()) + "}"


def _toks(expr: str) -> str:
    return f"list_filter(string_split({expr}, ' '), lambda t: t <> '')"


# ---------------------------------------------------------------- normalisers
#: Names and addresses with what the corpus lacks: accents, dots, ampersands, web names, placeholders, units.
_ODD_NAME = "CASE s1 % 9 WHEN 0 THEN name || ' & Co.' WHEN 1 THEN 'Formerly known as: ' || name WHEN 2 THEN name || ' | www.' || replace(split_part(name, ' ', 1), ' ', '') || '.com' WHEN 3 THEN '@' || split_part(name, ' ', 2) WHEN 4 THEN 'https://www.' || split_part(name, ' ', 1) || '-x.co.in/' WHEN 5 THEN 'Société ' || name WHEN 6 THEN 'M/S. ' || upper(name) WHEN 7 THEN 'Ça & ' || name ELSE name END"
_ODD_ADDR = "CASE s1 % 8 WHEN 0 THEN 'P.O. Box 12, ' || addr WHEN 1 THEN 'null' WHEN 2 THEN 'N° 00' || addr WHEN 3 THEN 'Apt 4 ' || addr || ' n/a' WHEN 4 THEN 'E-16-' || addr WHEN 5 THEN upper(addr) || ' & 2nd Ave' ELSE addr END"


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    s1, _, _ = fx.corpus(spark, sf_dir)
    return s1.select("s1", "country", F.expr(_ODD_NAME).alias("name"), F.expr(_ODD_ADDR).alias("addr"))


_ODD_SQL = f"WITH odd AS (SELECT s1, country, {_ODD_NAME} AS name, {_ODD_ADDR} AS addr FROM er_s1)"
_FOLD_NAME, _FOLD_ADDR = text.latin_fold_sql("name"), text.latin_fold_sql("addr")
_HEAD = "head"
_NAME_SQL = f"""{_ODD_SQL},
h AS (SELECT s1, {text.NAME_HEAD.sql(_FOLD_NAME)} AS head, trim(lower({_FOLD_NAME})) AS low FROM odd),
u AS (SELECT *, regexp_matches(head, '{text.URL_FULL}') AND NOT contains(head, ' ') AS f_url, regexp_matches(head, '^@\\S+$') AS f_handle FROM h),
n AS (SELECT *, {text.NAME.sql(f"(CASE WHEN f_url OR f_handle THEN {text.WEB_STEM.sql('head')} ELSE head END)")} AS name_n FROM u),
c AS (SELECT *, array_to_string(list_filter({_toks('name_n')}, lambda t: NOT list_contains({_list(text.LEGAL)}, t)), ' ') AS core0 FROM n),
k AS (SELECT *, CASE WHEN core0 = '' THEN name_n ELSE core0 END AS name_core FROM c)"""


@query(f"""{_NAME_SQL} SELECT s1, name_n, name_core, replace(name_core, ' ', '') AS name_ns, {text.skeleton_sql('name_core')} AS name_skel, f_url,
  regexp_matches(low, '{text.URL_TAIL}') AS f_urltail, regexp_matches(low, '\\bformerly\\b') AS f_formerly, f_handle FROM k""", "er")
def norm_name_views(spark, sf_dir):
    return _odd(spark, sf_dir).select("s1", *[c.alias(k) for k, c in text.name_views(F.col("name")).items()])


_ADDR_SQL = f"""{_ODD_SQL}, a AS (SELECT s1, country, {text.ADDR.sql(_FOLD_ADDR)} AS clean, lower({_FOLD_ADDR}) AS low FROM odd),
w AS (SELECT *, list_transform({_toks(text.Steps((("pad",), *text._words(text.STATES_OF_WORDS), ("trim",))).sql('clean'))}, lambda t: coalesce({_map(text.ADDR_ABBR | text.STATES)}[t], t)) AS w1 FROM a),
v AS (SELECT *, CASE WHEN country = 'India' THEN list_transform(w1, lambda t: coalesce({_map(text.INDIA_CODES)}[t], t)) ELSE w1 END AS w2 FROM w)"""


@query(f"""{_ADDR_SQL} SELECT s1, array_to_string(list_filter(w2, lambda t: NOT list_contains({_list(text.ADDR_NOISE)}, t)), ' ') AS addr_n,
  array_to_string(list_transform(regexp_extract_all(clean, '\\d+'), lambda x: (right(x, 9)::BIGINT)::VARCHAR), ',') AS nums, regexp_matches(low, '\\b(null|none|n/a)\\b') AS addr_null,
  regexp_matches(low, '(\\b(apt|apartment|suite|ste|unit|flat|floor|fl|flr|room|bldg|building)\\b|#)') AS has_unit FROM v""", "er")
def norm_addr_views(spark, sf_dir):
    v = text.addr_views(F.col("addr"), F.col("country"))
    v["nums"] = F.array_join(v["nums"].cast("array<string>"), ",")
    return _odd(spark, sf_dir).select("s1", *[c.alias(k) for k, c in v.items()])


@query(f"""{_ODD_SQL}, b AS (SELECT s1, {text.BLOCK_NAME.sql(_FOLD_NAME)} AS name_c, {text.BLOCK_ADDR.sql(_FOLD_ADDR)} AS addr_c FROM odd)
SELECT s1, name_c, addr_c, {text.ADDR_PLACEHOLDER.sql('addr_c')} = '' AS addr_empty FROM b""", "er")
def norm_blocking_views(spark, sf_dir):
    return blocking.block_views(_odd(spark, sf_dir)).select("s1", "name_c", "addr_c", "addr_empty")


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT word, {text.collapse_sql(text.WORD_SKELETON.sql('word'))} AS skeleton, {text.collapse_sql(text.TRANSLIT_SKELETON.sql('word'))} AS translit,
  {text.TRANSLIT_SPELLING.sql('word')} AS spelling, translate(word, '{text.HOMOGLYPHS[0]}', '{text.HOMOGLYPHS[1]}') AS glyphs FROM w""")
def norm_word_skeletons(spark, sf_dir):
    w = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    c = F.col("word")
    return w.select("word", text.word_skeleton(c).alias("skeleton"), text.translit_skeleton(c).alias("translit"), text.TRANSLIT_SPELLING(c).alias("spelling"), text.homoglyphs(c).alias("glyphs"))


_HOUSE_SQL = f"""{_ODD_SQL}, t AS (SELECT s1, regexp_extract(regexp_replace(lower(addr), '{text.PO_BOX}', ' ', 'g'), '{text.HOUSE_TOKEN}', 1) AS tok FROM odd)"""


@query(f"""{_HOUSE_SQL} SELECT s1,
  array_to_string(list_transform(regexp_extract_all(tok, '[a-z]*\\d+[a-z]*|[a-z]+')[1:8], lambda p: CASE WHEN regexp_matches(p, '^\\d+$') THEN regexp_replace(p, '^0+(\\d)', '\\1') ELSE p END), '/') AS parts,
  array_to_string(list_transform(regexp_extract_all(tok, '\\d+')[1:6], lambda x: (right(x, 9)::BIGINT)::VARCHAR), '/') AS numbers FROM t""", "er")
def norm_house_numbers(spark, sf_dir):
    return _odd(spark, sf_dir).select("s1", F.array_join(text.house_parts(F.col("addr")), "/").alias("parts"), F.array_join(text.number_parts(F.col("addr")).cast("array<string>"), "/").alias("numbers"))


@query("""SELECT doc_id, lang, CASE WHEN NOT regexp_matches(text, '[^\\x00-\\x7F]') THEN 0 WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 2 WHEN regexp_matches(text, '[\\x{0980}-\\x{0DFF}]') THEN 3
  WHEN regexp_matches(text, '[\\x{00C0}-\\x{024F}]') THEN 1 ELSE 4 END::INTEGER AS script, CASE WHEN lang = '' OR source = '' THEN -1 WHEN lang = source THEN 1 ELSE 0 END::INTEGER AS agree,
  'query: ' || lang || ' | ' || source AS pair_text FROM documents""")
def norm_script_and_pair_text(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", text.script(F.col("text")).cast("int").alias("script"), text.agree(F.col("lang"), F.col("source")).cast("int").alias("agree"), text.pair_text(F.col("lang"), F.col("source")).alias("pair_text"))


@query("""SELECT l_orderkey, l_linenumber, round(ln(least(greatest(l_discount, 1e-6), 1 - 1e-6) / (1 - least(greatest(l_discount, 1e-6), 1 - 1e-6))), 6) AS z,
  round(1 / (1 + exp(-l_tax)), 6) AS p FROM lineitem""")
def norm_logit_expit(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", _r(text.logit(F.col("l_discount"))).alias("z"), _r(text.expit(F.col("l_tax"))).alias("p"))


#: Words of another script, and a table of regions, for the fixture.
_SCRIPT = {"नमस्ते": "namaste", "दुकान": "dukan", "சாலை": "salai"}
_REGION = {"nord": "hdf", "hauts de france": "hdf", "gironde": "naq", "nouvelle aquitaine": "naq", "new york": "ny"}
_INDIC_NAME = "CASE s1 % 4 WHEN 0 THEN 'नमस्ते ' || name WHEN 1 THEN name || ' दु\u200dकान' WHEN 2 THEN 'சாலை' ELSE name || ' अज्ञात' END"
_FRENCH = "CASE s1 % 6 WHEN 0 THEN '98 bis st. martin' WHEN 1 THEN '5b ste-anne' WHEN 2 THEN '12 main st north' WHEN 3 THEN '7 ter rue x' WHEN 4 THEN '3 quater' ELSE '40' END || ', ' || addr"


@query(f"""WITH d AS (SELECT s1, {_INDIC_NAME} AS s FROM er_s1) SELECT s1, replace(replace(replace(replace(s, 'नमस्ते', 'namaste'), 'दु\u200dकान', 'dukan'), 'दुकान', 'dukan'), 'சாலை', 'salai') AS latin FROM d""", "er")
def norm_transliteration(spark, sf_dir):
    s1, _, _ = fx.corpus(spark, sf_dir)
    return s1.select("s1", text.transliterate(F.expr(_INDIC_NAME), _SCRIPT).alias("latin"))


@query(f"""WITH d AS (SELECT s1, {_FRENCH} AS a FROM er_s1), e AS (SELECT s1, {text.SAINTS.sql('a')} AS a FROM d)
SELECT s1, CASE WHEN regexp_matches(a, '\\b\\d+\\s*bis\\b') THEN 'b' WHEN regexp_matches(a, '\\b\\d+\\s*ter\\b') THEN 't' WHEN regexp_matches(a, '\\b\\d+\\s*quater\\b') THEN 'q' ELSE regexp_extract(a, '\\b\\d+([a-d])\\b', 1) END AS suffix,
  array_to_string(list_transform(string_split(regexp_replace(regexp_replace(a, '\\b(\\d+)\\s*(bis|ter|quater)\\b', '\\1', 'g'), '\\b(\\d+)[a-d]\\b', '\\1', 'g'), ','), lambda c: coalesce(' ' || {_map(_REGION)}[trim(regexp_replace(regexp_replace(c, '[-''.]', ' ', 'g'), ' +', ' ', 'g'))] || ' ', c)), ',') AS addr FROM e""", "er")
def norm_french_addresses(spark, sf_dir):
    s1, _, _ = fx.corpus(spark, sf_dir)
    x = s1.select("s1", text.SAINTS(F.expr(_FRENCH)).alias("a"))
    return x.select("s1", text.house_suffix(F.col("a")).alias("suffix"), text.admin_components(text.without_suffix(F.col("a")), _REGION).alias("addr"))


# ---------------------------------------------------------------- projection, filters, keys
@query(f"""SELECT p_partkey, (('0x' || substr(md5('7' || p_partkey::VARCHAR), 1, 8))::BIGINT % 1000)::INTEGER AS bucket,
  CASE WHEN ('0x' || substr(md5('7' || p_partkey::VARCHAR), 1, 8))::BIGINT % 1000 < 25 THEN 'locked' WHEN ('0x' || substr(md5('7' || p_partkey::VARCHAR), 1, 8))::BIGINT % 1000 < 100 THEN 'val' ELSE 'sample' END AS split,
  (('0x' || substr(md5('7' || p_partkey::VARCHAR), 1, 8))::BIGINT % 1000 % 2)::INTEGER AS fold, ('0x' || substr(md5('7' || p_partkey::VARCHAR), 1, 8))::BIGINT % 1000 < 150 AS es,
  p_partkey * {keys.PACK} + p_size AS packed, p_partkey AS a, p_size::BIGINT AS b FROM part""")
def proj_hash_splits_and_packed_keys(spark, sf_dir):
    p = _table(spark, sf_dir, "part").withColumn("packed", keys.pack(F.col("p_partkey"), F.col("p_size")))
    s = keys.splits(F.col("p_partkey"))
    a, b = keys.unpack(F.col("packed"))
    return p.select("p_partkey", keys.bucket(F.col("p_partkey"), 1000, "7").alias("bucket"), *[c.alias(k) for k, c in s.items()], "packed", a.alias("a"), b.alias("b"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN -1 ELSE least(greatest(o_totalprice, -1e6), 1e6) END AS capped, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent, o_custkey BETWEEN 10 AND 500 AS mid, greatest(o_custkey, 100) AS hi, least(o_custkey, 100) AS lo,
  (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS at FROM orders WHERE o_orderstatus <> 'P'""")
def proj_conditions_and_row_index(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(
        "o_orderkey", keys.finite(F.col("o_totalprice")).alias("capped"), F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("open")).alias("status"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("urgent"),
        F.col("o_custkey").between(10, 500).alias("mid"), F.greatest("o_custkey", F.lit(100)).cast("long").alias("hi"), F.least("o_custkey", F.lit(100)).cast("long").alias("lo"), at.cast("long").alias("at"),
    )


@query("SELECT s1, CASE WHEN country IN ('France') THEN 2.0 * house ELSE 1.0 * house END::DOUBLE AS feature FROM er_s1", "er")
def proj_gated_columns(spark, sf_dir):
    s1, _, _ = fx.corpus(spark, sf_dir)
    return s1.select("s1", features.gated(F.col("country"), ["France"], 2.0 * F.col("house"), 1.0 * F.col("house")).cast("double").alias("feature"))


# ---------------------------------------------------------------- joins
@query("""SELECT a.s1, b.cand, (b.house - a.house)::BIGINT AS k FROM er_s1 a JOIN er_pool b ON a.country = b.country AND a.street = b.street AND b.house - a.house BETWEEN -3 AND 3""", "er")
def join_offset_range(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    a, b = s1.select("s1", "country", "street", "house"), pool.select("cand", "country", "street", "house")
    return keys.offset_join(a, b, ["country", "street"], "house", "house", range(-3, 4)).select("s1", "cand", F.col("k").cast("long").alias("k"))


@query("""SELECT e.event_id, (SELECT count(*) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.value > e.value)::BIGINT AS n_greater FROM events e WHERE e.event_type <> 'purchase'""")
def join_count_greater(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    left = e.filter("event_type <> 'purchase'").select("event_id", "user_id", "value")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("value").alias("v2"))
    return keys.count_greater(left, right, "user_id", "value", "v2", "n_greater").select("event_id", "n_greater")


@query("""SELECT c_custkey, count(o_orderkey)::BIGINT AS n_orders, (SELECT count(*) FROM nation WHERE n_nationkey = c_nationkey)::BIGINT AS n_nations FROM customer LEFT JOIN orders ON o_custkey = c_custkey
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') GROUP BY c_custkey, c_nationkey""")
def join_semi_anti_left(spark, sf_dir):
    c, o, n = (_table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    big, low = o.filter("o_totalprice > 1000").select("o_custkey"), o.filter("o_orderpriority = '5-LOW'").select("o_custkey")
    on = c["c_custkey"] == F.col("o_custkey")
    kept = c.join(big, on, "left_semi").join(low, on, "left_anti")
    out = kept.join(o.select("o_custkey", "o_orderkey"), on, "left").groupBy("c_custkey", "c_nationkey").agg(F.count("o_orderkey").alias("n_orders"))
    return out.join(n.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n_nations")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_orders", F.coalesce("n_nations", F.lit(0)).cast("long").alias("n_nations"))


_S = "SELECT vec_id // 2 AS s1, embedding, label FROM embeddings WHERE vec_id % 2 = 0"
_P = "SELECT vec_id // 2 AS cand, embedding, label FROM embeddings WHERE vec_id % 2 = 1"
_KNN_SQL = f"""WITH s AS ({_S}), p AS ({_P}),
d AS (SELECT s1, cand, round(list_inner_product(s.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM s JOIN p USING (label)),
fwd AS (SELECT s1, cand, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cand) AS rank FROM d) WHERE rank <= 50),
rev AS (SELECT s1, cand, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY score DESC, s1) AS rank FROM d) WHERE rank <= 5)"""


def _dense(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    half = lambda m, n: e.filter(F.col("vec_id") % 2 == m).select(F.floor(F.col("vec_id") / 2).alias(n), "embedding", "label")
    s, p = half(0, "s1"), half(1, "cand")
    return blocking.nearest(s, p, "s1", "cand", "embedding", "label", 50), blocking.nearest(p, s, "cand", "s1", "embedding", "label", 5)


@query(f"{_KNN_SQL} SELECT s1, cand, score, rank::INTEGER AS rank, 'fwd' AS list FROM fwd UNION ALL SELECT s1, cand, score, rank::INTEGER, 'rev' FROM rev")
def join_nearest_vectors(spark, sf_dir):
    f, r = _dense(spark, sf_dir)
    return f.select("s1", "cand", "score", "rank", F.lit("fwd").alias("list")).unionByName(r.select("s1", "cand", "score", "rank", F.lit("rev").alias("list")))


_DENSE_SQL = f"""{_KNN_SQL}, cands AS (SELECT coalesce(f.s1, r.s1) AS s1, coalesce(f.cand, r.cand) AS cand, f.s1 IS NOT NULL AS ch_fwd, r.s1 IS NOT NULL AS ch_rev
  FROM (SELECT * FROM fwd WHERE rank <= 20) f FULL JOIN (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY cand) AS t FROM rev) WHERE rank = 1 OR score >= t - 0.02) r ON f.s1 = r.s1 AND f.cand = r.cand)"""


@query(f"{_DENSE_SQL} SELECT * FROM cands")
def block_dense_candidates(spark, sf_dir):
    return blocking.dense_candidates(*_dense(spark, sf_dir)).select("s1", "cand", "ch_fwd", "ch_rev")


@query(f"""{_DENSE_SQL}, t AS (SELECT c.*, coalesce(f.score, r.score) AS cos, coalesce(f.rank, 51)::INTEGER AS fwd_rank, coalesce(r.rank, 6)::INTEGER AS rev_rank
  FROM cands c LEFT JOIN fwd f USING (s1, cand) LEFT JOIN rev r USING (s1, cand)),
a AS (SELECT s1, max(CASE WHEN rank = 1 THEN score END) AS s1_top1, max(CASE WHEN rank = 2 THEN score END) AS s2 FROM fwd GROUP BY s1),
b0 AS (SELECT *, max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY cand) AS t1 FROM rev),
b AS (SELECT cand, max(t1) AS rev_top1, max(CASE WHEN rank = 2 THEN score END) AS r2, sum(CASE WHEN score >= t1 - 0.02 THEN 1 ELSE 0 END)::BIGINT AS n_claim_gate FROM b0 GROUP BY cand)
SELECT s1, cand, fwd_rank, rev_rank, round(cos - s1_top1, 6) AS rel_s1, round(s1_top1 - s2, 6) AS s1_gap12, round(cos - rev_top1, 6) AS rel_rec, round(rev_top1 - r2, 6) AS rev_gap12, n_claim_gate,
  row_number() OVER (PARTITION BY s1 ORDER BY cos DESC, cand)::INTEGER AS rank_s1, count(*) OVER (PARTITION BY s1) AS n_cands_s1, row_number() OVER (PARTITION BY cand ORDER BY cos DESC, s1)::INTEGER AS rank_rec_tab,
  count(*) OVER (PARTITION BY cand) AS n_s1_rec_tab, round(cos - max(cos) OVER (PARTITION BY cand), 6) AS rel_rec_tab, (ch_fwd::INTEGER + ch_rev::INTEGER)::INTEGER AS n_channels, ch_fwd AND ch_rev AS ch_both
FROM t LEFT JOIN a USING (s1) LEFT JOIN b USING (cand)""")
def feat_retrieval_table(spark, sf_dir):
    f, r = _dense(spark, sf_dir)
    c = blocking.dense_candidates(f, r).join(f.select("s1", "cand", F.col("score").alias("_f")), ["s1", "cand"], "left").join(r.select("s1", "cand", F.col("score").alias("_r")), ["s1", "cand"], "left")
    t = competition.table_features(c.withColumn("cos", F.coalesce("_f", "_r")).drop("_f", "_r"), f, r)
    gaps = ("rel_s1", "s1_gap12", "rel_rec", "rev_gap12", "rel_rec_tab")
    return t.withColumns({g: _r(g) for g in gaps}).drop("ch_fwd", "ch_rev", "cos", "s1_top1", "rev_top1")


# ---------------------------------------------------------------- aggregates, sorts, sets
@query("""SELECT l_suppkey, count(*)::BIGINT AS n, round(sum(l_extendedprice), 4) AS s, round(avg(l_quantity), 6) AS m, max(l_discount) AS hi, min(l_discount) AS lo, round(stddev_samp(l_quantity), 6) AS sd,
  count(DISTINCT l_partkey)::BIGINT AS parts, count(*) FILTER (l_discount > 0.05)::BIGINT AS n05, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS first_q, bool_or(l_returnflag = 'R') AS any_r,
  arg_max(l_orderkey, (l_extendedprice, -l_orderkey)) AS best_order, array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS statuses, quantile_cont(l_quantity, 0.95) AS q95 FROM lineitem GROUP BY l_suppkey""")
def agg_group_statistics(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 4).alias("s"), _r(F.avg("l_quantity")).alias("m"), F.max("l_discount").alias("hi"), F.min("l_discount").alias("lo"),
        _r(F.stddev_samp("l_quantity")).alias("sd"), F.countDistinct("l_partkey").alias("parts"), F.count_if(F.col("l_discount") > 0.05).alias("n05"),
        F.max(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("first_q"), F.bool_or(F.col("l_returnflag") == "R").alias("any_r"),
        F.max_by("l_orderkey", F.struct(F.col("l_extendedprice"), -F.col("l_orderkey"))).alias("best_order"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("statuses"),
        F.percentile("l_quantity", F.lit(0.95)).alias("q95"),
    )


@query("""SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS m FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""")
def agg_grouping_sets(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.groupingSets([["o_orderpriority"], ["o_orderstatus"], []], "o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("m"))


_DOCWORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"


@query(f"""WITH w AS (SELECT lang, unnest({_DOCWORDS}) AS word FROM documents), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, word, df, round(ln(n / df), 6) AS idf FROM (SELECT lang, word, count(*)::BIGINT AS df FROM w GROUP BY lang, word) JOIN n USING (lang)""")
def agg_document_frequency_idf(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("words"))
    return records.document_frequencies(d, "doc_id", "words", ["lang"]).select("lang", "word", "df", _r("idf").alias("idf"))


@query("""SELECT user_id, event_id, value, row_number() OVER w::INTEGER AS rk, round(value - coalesce(lead(value) OVER w, 0), 6) AS gap_next, round(max(value) OVER (PARTITION BY user_id) - value, 6) AS gap_top,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING), 4) AS running, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id)::BIGINT AS clicks,
  round(coalesce(CASE WHEN row_number() OVER w = 1 THEN nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE max(value) OVER (PARTITION BY user_id) END, -1), 6) AS other
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)""")
def win_ranks_gaps_and_best_other(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    w, a = Window.partitionBy("user_id").orderBy(F.desc("value"), F.asc("event_id")), Window.partitionBy("user_id")
    x = keys.with_max_other(e, "user_id", "value", "event_id", "other", -1.0)
    return x.select(
        "user_id", "event_id", "value", F.row_number().over(w).alias("rk"), _r(F.col("value") - F.lead("value", 1, 0.0).over(w)).alias("gap_next"), _r(F.max("value").over(a) - F.col("value")).alias("gap_top"),
        F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.count_if(F.col("event_type") == "click").over(a).alias("clicks"), _r("other").alias("other"),
    )


@query("""SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def sort_top_k_per_group(spark, sf_dir):
    return keys.top_k(_table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("""WITH a AS (SELECT l_partkey AS s1, l_suppkey AS cand FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey AS s1, l_suppkey AS cand FROM lineitem WHERE l_discount > 0.05),
c AS (SELECT l_partkey AS s1, l_suppkey AS cand FROM lineitem WHERE l_quantity < 5), n AS ((SELECT * FROM a UNION SELECT * FROM b) EXCEPT SELECT * FROM c)
SELECT s1, cand, '-' AS side FROM (SELECT DISTINCT * FROM a EXCEPT SELECT * FROM n) UNION ALL SELECT s1, cand, '+' FROM (SELECT * FROM n EXCEPT SELECT * FROM a)""")
def set_selection_algebra(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("s1"), F.col("l_suppkey").alias("cand"), "l_returnflag", "l_discount", "l_quantity")
    on = ["s1", "cand"]
    a, b, c = li.filter("l_returnflag = 'R'"), li.filter("l_discount > 0.05"), li.filter("l_quantity < 5")
    return keys.changes(a.select(on).distinct(), keys.set_algebra(a, b, c, on), on)


@query("""WITH w AS (SELECT a.doc_id, regexp_extract_all(lower(a.text), '[a-z]+') AS x, regexp_extract_all(lower(b.text), '[a-z]+') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
e AS (SELECT doc_id, unnest(x) AS t, 1 AS n FROM w UNION ALL SELECT doc_id, unnest(y), -1 FROM w), g AS (SELECT doc_id, t, sum(n) AS n FROM e GROUP BY doc_id, t), h AS (SELECT doc_id, sum(n) AS lost FROM g WHERE n > 0 GROUP BY doc_id)
SELECT w.doc_id, coalesce(lost, 0)::BIGINT AS lost,
  CASE WHEN len(x) = 0 OR len(y) = 0 THEN -1.0 ELSE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) END::DOUBLE AS jaccard,
  CASE WHEN len(x) = 0 OR len(y) = 0 THEN -1.0 ELSE round(len(list_intersect(x, y)) / len(list_distinct(x)), 6) END::DOUBLE AS inside FROM w LEFT JOIN h USING (doc_id)""")
def set_multisets_and_jaccard(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("x"))
    x = keys.multiset_lost(d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id"), "doc_id", "x", "y")
    a, b = F.col("x"), F.col("y")
    return x.select("doc_id", "lost", _r(arrays.jaccard(a, b)).alias("jaccard"), _r(arrays.containment(a, b)).alias("inside"))


# ---------------------------------------------------------------- similarity
@query("""SELECT a.p_partkey, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS jw, damerau_levenshtein(a.p_name, b.p_name)::INTEGER AS damerau, levenshtein(a.p_name, b.p_name)::INTEGER AS lev
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def sim_edit_distances(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    x = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n2")), "p_partkey")
    x = x.withColumn("s", similarity.struct_of(["jaro_winkler", "damerau"])(F.col("p_name"), F.col("n2")))
    return x.select("p_partkey", _r("s.jaro_winkler").alias("jw"), F.col("s.damerau").alias("damerau"), F.levenshtein("p_name", "n2").alias("lev"))


@query("""SELECT a.vec_id AS s1, b.vec_id AS cand, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def sim_pair_cosine(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    x = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("cand"), F.col("embedding").alias("e2")), "vec_id")
    return x.select(F.col("vec_id").alias("s1"), "cand", _r(arrays.dot(F.col("embedding"), F.col("e2"))).alias("cos"))


# ---------------------------------------------------------------- records
def _views(spark, sf_dir):
    s1, pool, truth = fx.corpus(spark, sf_dir)
    return records.views(s1), records.views(pool), truth


_VIEW_SQL = f"""WITH s AS (SELECT s1, country, house, street, {text.NAME.sql('lower(name)')} AS name_n, {text.BLOCK_ADDR.sql('addr')} AS ad FROM er_s1),
p AS (SELECT cand, country, house, street, {text.NAME.sql('lower(name)')} AS name_n, {text.BLOCK_ADDR.sql('addr')} AS ad FROM er_pool)"""
_CORE = f"array_to_string(list_filter({_toks('name_n')}, lambda t: NOT list_contains({_list(text.LEGAL)}, t)), ' ')"


@query(f"""{_VIEW_SQL}, a AS (SELECT s1, {_CORE} AS core FROM s), b AS (SELECT cand, {_CORE} AS core FROM p)
SELECT s1, core AS name_core, (SELECT count(*) FROM a x WHERE x.core = a.core)::BIGINT AS freq_s1, (SELECT count(*) FROM b x WHERE x.core = a.core)::BIGINT AS freq_pool FROM a""", "er")
def rec_name_frequencies(spark, sf_dir):
    a, b, _ = _views(spark, sf_dir)
    return records.frequencies(a.select("s1", "name_core"), b.select("cand", "name_core"), "name_core", "freq")[0].select("s1", "name_core", "freq_s1", "freq_pool")


@query(f"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(p_name, '[a-z]+')) AS w FROM part WHERE p_partkey % 2 = 0 AND p_name NOT LIKE '%widget%'),
l AS (SELECT split_part(p_name, ' ', 2) AS name_core, p_size AS addr_key FROM part)
SELECT name_core, count(DISTINCT addr_key)::BIGINT AS n_addr FROM l WHERE regexp_matches(name_core, '^[a-z]{{5,12}}$') AND name_core NOT IN (SELECT w FROM v) GROUP BY name_core HAVING count(DISTINCT addr_key) >= 3""")
def rec_fake_names(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    s1 = p.filter("p_partkey % 2 = 0 AND p_name NOT LIKE '%widget%'").select(F.col("p_name").alias("name_core"))
    return records.fake_names(s1, p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name_core"), F.col("p_size").alias("addr_key")))


@query(f"""{_VIEW_SQL} SELECT word, count(*)::BIGINT AS n FROM (SELECT s1, unnest(list_distinct({_toks(_CORE)})) AS word FROM s) GROUP BY word HAVING count(*) >= 100""", "er")
def rec_generic_words(spark, sf_dir):
    return records.generic_words(_views(spark, sf_dir)[0], least=100)


# ---------------------------------------------------------------- blocking
def _skel_sql(w: str) -> str:
    return text.collapse_sql(text.WORD_SKELETON.sql(w))


def _tokens_sql(table: str, i: str, out: str) -> str:
    """The tables out_sk, out_c, out_num, out_w: tokens of a view (i, country, name_c, addr_c)."""
    words = f"list_filter(string_split(name_c, ' '), lambda t: len(t) >= 2 AND NOT list_contains({_list(text.NAME_STOP)}, t))"
    return f"""{out}_v AS (SELECT {i}, country, {text.BLOCK_NAME.sql('name')} AS name_c, {text.BLOCK_ADDR.sql('addr')} AS addr_c FROM {table}),
{out}_sk AS (SELECT DISTINCT {i} AS id, country, sk AS t FROM (SELECT {i}, country, {_skel_sql('tok')} AS sk FROM (SELECT {i}, country, unnest({words}) AS tok FROM {out}_v)) WHERE len(sk) >= 2),
{out}_c AS (SELECT {i} AS id, country, c AS t FROM (SELECT {i}, country, {_skel_sql(f"array_to_string({words}, '')")} AS c FROM {out}_v) WHERE len(c) >= 3),
{out}_n0 AS (SELECT {i} AS id, country, regexp_replace(x, '^0+(\\d)', '\\1') AS t, p FROM (SELECT {i}, country, unnest(regexp_extract_all(addr_c, '\\d+')) AS x, generate_subscripts(regexp_extract_all(addr_c, '\\d+'), 1) AS p FROM {out}_v)),
{out}_num AS (SELECT id, country, t FROM (SELECT id, country, t, row_number() OVER (PARTITION BY id ORDER BY min(p)) AS r FROM {out}_n0 GROUP BY id, country, t) WHERE r <= 2),
{out}_w AS (SELECT DISTINCT id, country, t FROM (SELECT {i} AS id, country, coalesce({_map(text.BLOCK_ABBR)}[x], x) AS t FROM (SELECT {i}, country, unnest(regexp_extract_all(addr_c, '[a-z]+')) AS x FROM {out}_v))
  WHERE len(t) >= 2 AND NOT list_contains({_list(text.ADDR_STOP)}, t))"""


def _rare_sql(out: str, kind: str, k: int) -> str:
    return f"""{out}_{kind}{k} AS (SELECT id, country, t, r FROM (SELECT x.*, row_number() OVER (PARTITION BY id ORDER BY coalesce(df, 0), t) AS r FROM {out}_{kind} x LEFT JOIN (SELECT country, t, count(*) AS df FROM p_{kind} GROUP BY country, t) USING (country, t)) WHERE r <= {k})"""


def _keys_sql(o: str) -> str:
    cross = lambda kind, a, b, cond="": f"SELECT a.id, a.country, '{kind}:' || a.t || '|' || b.t AS key FROM {a} a JOIN {b} b ON a.id = b.id{cond}"
    return f"""{_rare_sql(o, 'sk', 4)}, {_rare_sql(o, 'w', 6)},
{o}_k1 AS (SELECT DISTINCT * FROM (SELECT id, country, 's:' || t AS key FROM {o}_sk4 UNION ALL {cross('ss', f'{o}_sk4', f'{o}_sk4', ' AND a.t < b.t')} UNION ALL {cross('sd', f'{o}_sk4', f'{o}_num')}
  UNION ALL {cross('dw', f'{o}_num', f'{o}_w6')} UNION ALL {cross('sw', f'{o}_sk4', f'{o}_w6', ' AND b.r <= 4')} UNION ALL SELECT id, country, 'c:' || t FROM {o}_c)),
{o}_k2 AS (SELECT DISTINCT * FROM ({cross('dw', f'{o}_num', f'{o}_w6')} UNION ALL {cross('dd', f'{o}_num', f'{o}_num', ' AND a.t < b.t')} UNION ALL {cross('ww', f'{o}_w6', f'{o}_w6', ' AND a.t < b.t')} UNION ALL SELECT id, country, 'w:' || t FROM {o}_w6))"""


def _channel_sql(name: str, q: str, x: str, size: str, qid: str, xid: str, max_df: int, k: int) -> str:
    return f"""{name}_post AS (SELECT country, key, ln(n / df) AS idf FROM (SELECT country, key, count(*) AS df FROM {x} GROUP BY country, key) JOIN (SELECT country, count(*) AS n FROM {size} GROUP BY country) USING (country) WHERE df <= {max_df}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY score DESC, nk DESC, {xid}) AS rank FROM (
  SELECT q.id AS {qid}, x.id AS {xid}, round(sum(idf), 6) AS score, count(*) AS nk FROM {q} q JOIN {x} x USING (country, key) JOIN {name}_post USING (country, key) GROUP BY q.id, x.id)) WHERE rank <= {k})"""


_LEX_SQL = f"""WITH {_tokens_sql('er_pool', 'cand', 'p')}, {_tokens_sql('er_s1', 's1', 's')}, {_keys_sql('p')}, {_keys_sql('s')}"""


@query(f"""{_LEX_SQL}, {_channel_sql('c1', 's_k1', 'p_k1', 'er_pool', 's1', 'cand', 200, 50)}, {_channel_sql('c2', 's_k2', 'p_k2', 'er_pool', 's1', 'cand', 200, 50)}
SELECT 'c1' AS channel, s1, cand, rank::INTEGER AS rank, score, nk::BIGINT AS nk FROM c1 UNION ALL SELECT 'c2', s1, cand, rank::INTEGER, score, nk::BIGINT FROM c2""", "er")
def block_lexical_forward(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    ch = blocking.lexical_channels(s1, pool)
    one = lambda c: ch[c].select(F.lit(c).alias("channel"), "s1", "cand", "rank", "score", "nk")
    return one("c1").unionByName(one("c2"))


@query(f"""{_LEX_SQL}, {_channel_sql('c1r', 'p_k1', 's_k1', 'er_s1', 'cand', 's1', 20, 3)}, {_channel_sql('c2r', 'p_k2', 's_k2', 'er_s1', 'cand', 's1', 20, 3)}
SELECT 'c1r' AS channel, s1, cand, rank::INTEGER AS rank, score, round(max(score) OVER (PARTITION BY cand) - score, 6) AS gap FROM c1r
UNION ALL SELECT 'c2r', s1, cand, rank::INTEGER, score, round(max(score) OVER (PARTITION BY cand) - score, 6) FROM c2r""", "er")
def block_lexical_reverse(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    ch = blocking.lexical_channels(s1, pool)
    one = lambda c: ch[c].select(F.lit(c).alias("channel"), "s1", "cand", "rank", "score", "gap")
    return one("c1r").unionByName(one("c2r"))


def _gram_sql(table: str, i: str, out: str, where: str = "") -> str:
    words = f"list_filter(string_split(name_c, ' '), lambda t: len(t) >= 2 AND NOT list_contains({_list(text.NAME_STOP)}, t))"
    return f"""{out}_b AS (SELECT {i} AS id, country, {text.BLOCK_NAME.sql('name')} AS name_c, {text.BLOCK_ADDR.sql('addr')} AS addr_c FROM {table}),
{out}_e AS (SELECT * FROM {out}_b {where}),
{out}_g AS (SELECT id, country, gram, count(*) AS tf FROM (SELECT id, country, substr(' ' || w || ' ', i, 3) AS gram FROM (SELECT id, country, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT id, country, unnest({words}) AS w FROM {out}_e))) GROUP BY id, country, gram)"""


def _tfidf_sql(name: str, q: str, x: str, qid: str, xid: str, k: int) -> str:
    unit = lambda t: f"(SELECT id, country, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, country, gram, tf * idf AS w FROM {t}_g JOIN {name}_df USING (country, gram)))"
    return f"""{name}_df AS (SELECT country, gram, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT country, gram, count(*) AS df FROM {x}_g GROUP BY country, gram) JOIN (SELECT country, count(*) AS n FROM {x}_e GROUP BY country) USING (country) WHERE n * 0.05 < 1 OR df <= n * 0.05),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY score DESC, {xid}) AS rank FROM (SELECT a.id AS {qid}, b.id AS {xid}, round(sum(a.w * b.w), 6) AS score FROM {unit(q)} a JOIN {unit(x)} b USING (country, gram) GROUP BY a.id, b.id) WHERE score > 0) WHERE rank <= {k})"""


_EMPTY = f"WHERE {text.ADDR_PLACEHOLDER.sql('addr_c')} = ''"


@query(f"""WITH {_gram_sql('er_pool', 'cand', 'p', _EMPTY)}, {_gram_sql('er_s1', 's1', 's')}, {_tfidf_sql('c3', 's', 'p', 's1', 'cand', 10)}, {_tfidf_sql('c3r', 'p', 's', 'cand', 's1', 5)}
SELECT 'c3' AS channel, s1, cand, score FROM c3 UNION ALL SELECT 'c3r', s1, cand, score FROM c3r""", "er")
def block_name_trigrams(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    a, b = blocking.block_views(s1), blocking.block_views(pool).filter("addr_empty")
    f, r = blocking.name_channel(a, b, "s1", "cand", 10), blocking.name_channel(b, a, "cand", "s1", 5)
    return f.select(F.lit("c3").alias("channel"), "s1", "cand", "score").unionByName(r.select(F.lit("c3r").alias("channel"), "s1", "cand", "score"))


#: Made-up channel lists with exact figures, so that the union's arithmetic can be compared to the last digit.
_CH_SQL = """WITH f AS (SELECT s1, cand, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS fr, p AS fs FROM pairs),
r AS (SELECT s1, cand, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rr, p AS rs, max(p) OVER (PARTITION BY cand) - p AS rd FROM pairs WHERE cand % 3 <> 0),
c AS (SELECT s1, cand, row_number() OVER (PARTITION BY s1 ORDER BY cand % 17, cand) AS c1, cand % 17 AS c1nk FROM pairs WHERE cand % 5 <> 1),
u AS (SELECT s1, cand, fr, fs, rr, rs, rd, c1, c1nk, coalesce(fr <= 20, false) AS in_fwd, coalesce(rr = 1 OR (rr <= 5 AND rd < 0.02), false) AS in_rev, coalesce(c1 <= 20, false) AS in_c1
  FROM f FULL JOIN r USING (s1, cand) FULL JOIN c USING (s1, cand)),
v AS (SELECT *, CASE WHEN in_fwd THEN 1.0::DOUBLE / fr ELSE 0 END AS a, CASE WHEN in_rev THEN 1.0::DOUBLE / rr ELSE 0 END AS b, CASE WHEN in_c1 THEN 1.0::DOUBLE / c1 ELSE 0 END AS d,
  least(1.0, 20.0 / greatest(sum(in_rev::INTEGER::DOUBLE) OVER (PARTITION BY s1), 1)) AS h FROM u WHERE in_fwd OR in_rev OR in_c1),
w AS (SELECT *, round(greatest(a, b, d) + 0.01 * (a + b + d) + 1e-4 * greatest(coalesce(fs, 0), coalesce(rs, 0)), 9) AS fused, round(greatest(a, b * h, d) + 0.01 * (a + b * h + d) + 1e-4 * greatest(coalesce(fs, 0), coalesce(rs, 0)), 9) AS fused_hd FROM v),
x AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY fused DESC, cand) AS fused_rank, row_number() OVER (PARTITION BY s1 ORDER BY fused_hd DESC, cand) AS fused_hd_rank FROM w)"""


def _union(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    rk = lambda by, *o: F.row_number().over(Window.partitionBy(by).orderBy(*o))
    f = p.select("s1", "cand", rk("s1", F.desc("p"), F.asc("cand")).alias("fr"), F.col("p").alias("fs"))
    r = p.filter("cand % 3 <> 0").select("s1", "cand", rk("cand", F.desc("p"), F.asc("s1")).alias("rr"), F.col("p").alias("rs"), (F.max("p").over(Window.partitionBy("cand")) - F.col("p")).alias("rd"))
    c = p.filter("cand % 5 <> 1").select("s1", "cand", rk("s1", F.col("cand") % 17, F.asc("cand")).alias("c1"), (F.col("cand") % 17).alias("c1nk"))
    return blocking.union_candidates({"fwd": f, "rev": r, "c1": c})


@query(f"""{_CH_SQL} SELECT s1, cand, coalesce(fr, 0)::INTEGER AS fr, coalesce(rr, 0)::INTEGER AS rr, coalesce(c1, 0)::INTEGER AS c1, in_fwd, in_rev, in_c1, (in_fwd::INTEGER + in_rev::INTEGER + in_c1::INTEGER)::INTEGER AS n_member_channels,
  fused, fused_hd, fused_rank::INTEGER AS fused_rank, fused_hd_rank::INTEGER AS fused_hd_rank FROM x""", "pairs")
def block_union_fusion(spark, sf_dir):
    return _union(spark, sf_dir).select("s1", "cand", "fr", "rr", "c1", "in_fwd", "in_rev", "in_c1", "n_member_channels", "fused", "fused_hd", "fused_rank", "fused_hd_rank")


@query(f"""{_CH_SQL} SELECT s1, cand, in_fwd::INTEGER AS u_in_fwd, in_rev::INTEGER AS u_in_rev, in_c1::INTEGER AS u_in_c1, (in_fwd::INTEGER + in_rev::INTEGER + in_c1::INTEGER)::INTEGER AS u_n_member_channels,
  fused_rank::INTEGER AS u_fused_rank, fused_hd_rank::INTEGER AS u_fused_hd_rank, fr::DOUBLE AS u_fr, round(fs, 6) AS u_fs, rr::DOUBLE AS u_rr, round(rs, 6) AS u_rs, round(rd, 6) AS u_rd, c1::DOUBLE AS u_c1, c1nk::DOUBLE AS u_c1nk,
  count(*) OVER (PARTITION BY s1) AS u_n_s1, 0::BIGINT AS u_n_lexrev_s1 FROM x""", "pairs")
def feat_channels(spark, sf_dir):
    f = competition.channel_features(_union(spark, sf_dir))
    return f.withColumns({c: _r(c) for c in ("u_fs", "u_rs", "u_rd")} | {c: F.col(c).cast("double") for c in ("u_fr", "u_rr", "u_c1", "u_c1nk")})


# ---------------------------------------------------------------- pair features
_WORDPAIR = f"""WITH a AS (SELECT s1, {_toks(text.BLOCK_NAME.sql('name'))} AS x, {text.BLOCK_NAME.sql('name')} AS n FROM er_s1), b AS (SELECT cand, {_toks(text.BLOCK_NAME.sql('name'))} AS y, {text.BLOCK_NAME.sql('name')} AS m FROM er_pool)"""


@query(f"""{_WORDPAIR}, t AS (SELECT s1, unnest(list_distinct(x)) AS w FROM a), i AS (SELECT w, ln((SELECT count(*) FROM a) / count(*)) AS idf FROM t GROUP BY w),
ta AS (SELECT s1, w, idf FROM t JOIN i USING (w)), tb AS (SELECT DISTINCT cand, w, idf FROM (SELECT cand, unnest(y) AS w FROM b) JOIN i USING (w)),
j AS (SELECT s1, cand, ta.w AS wa, tb.w AS wb, coalesce(ta.idf, tb.idf) AS idf FROM pairs JOIN ta USING (s1) JOIN tb USING (cand) WHERE ta.w = tb.w),
sh AS (SELECT s1, cand, sum(idf) AS sh, list(wa) AS ws FROM j GROUP BY s1, cand), sa AS (SELECT s1, sum(idf) AS sa, list({{'w': w, 'i': idf}}) AS la FROM ta GROUP BY s1), sb AS (SELECT cand, sum(idf) AS sb, list({{'w': w, 'i': idf}}) AS lb FROM tb GROUP BY cand),
z AS (SELECT s1, cand, coalesce(sh, 0) AS sh, coalesce(sa, 0) AS sa, coalesce(sb, 0) AS sb, coalesce(ws, []) AS ws, coalesce(la, []) AS la, coalesce(lb, []) AS lb FROM pairs LEFT JOIN sh USING (s1, cand) LEFT JOIN sa USING (s1) LEFT JOIN sb USING (cand))
SELECT s1, cand, len(ws)::INTEGER AS n_inter, round(CASE WHEN sa + sb - sh > 0 THEN sh / (sa + sb - sh) ELSE -1 END, 6) AS n_wjac, round(CASE WHEN sa > 0 THEN sh / sa ELSE -1 END, 6) AS n_cov1, round(CASE WHEN sb > 0 THEN sh / sb ELSE -1 END, 6) AS n_cov2,
  round(coalesce(list_max(list_transform(list_filter(la, lambda e: NOT list_contains(ws, e.w)), lambda e: e.i)), 0), 6) AS n_miss_max, round(coalesce(list_max(list_transform(list_filter(lb, lambda e: NOT list_contains(ws, e.w)), lambda e: e.i)), 0), 6) AS n_extra_max,
  (len(la) - len(ws))::INTEGER AS n_miss_cnt, (len(lb) - len(ws))::INTEGER AS n_extra_cnt FROM z""", "pairs")
def feat_idf_overlap(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    words = lambda df, i: df.select(i, text.tokens(text.BLOCK_NAME(F.col("name"))).alias("words"))
    a, b = words(s1, "s1"), words(pool, "cand")
    out = features.idf_overlap(fx.pairs(spark, sf_dir).select("s1", "cand"), a, b, records.document_frequencies(a, "s1", "words").select("word", "idf"), "n")
    return out.withColumns({c: _r(c) for c in ("n_wjac", "n_cov1", "n_cov2", "n_miss_max", "n_extra_max")})


@query("""WITH x AS (SELECT p.s1, p.cand, list_transform(regexp_extract_all(a.addr, '\\d+'), lambda v: v::BIGINT) AS x, list_transform(regexp_extract_all(b.addr, '\\d+'), lambda v: v::BIGINT) AS y FROM pairs p JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand))
SELECT s1, cand, len(list_intersect(x, y))::INTEGER AS num_inter, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN -1 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6)::DOUBLE AS num_jac,
  len(list_distinct(x))::INTEGER AS num_cnt1, len(list_distinct(y))::INTEGER AS num_cnt2, (len(list_distinct(x)) - len(list_intersect(x, y)))::INTEGER AS num_miss1, (len(list_distinct(y)) - len(list_intersect(x, y)))::INTEGER AS num_extra2,
  (len(x) > 0 AND len(y) > 0)::INTEGER AS num_first_both, CASE WHEN len(x) > 0 AND len(y) > 0 THEN (x[1] = y[1])::INTEGER ELSE -1 END AS num_first_eq, CASE WHEN len(x) > 0 AND len(y) > 0 THEN (abs(x[1] - y[1]) = 1)::INTEGER ELSE -1 END AS num_first_off1,
  round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN ln(1 + abs(x[1] - y[1])) ELSE -1 END, 6) AS num_first_ldiff FROM x""", "pairs")
def feat_numbers(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    nums = lambda df, i, n: df.select(i, F.regexp_extract_all("addr", F.lit(r"(\d+)"), F.lit(1)).cast("array<long>").alias(n))
    x = fx.pairs(spark, sf_dir).select("s1", "cand").join(nums(s1, "s1", "x"), "s1").join(nums(pool, "cand", "y"), "cand")
    f = features.numbers(F.col("x"), F.col("y"))
    return x.select("s1", "cand", *[(_r(c) if k in ("num_jac", "num_first_ldiff") else c).alias(k) for k, c in f.items()])


_OFF = ", ".join(map(str, features.OFFSETS))


@query(f"""{_HOUSE_SQL.replace('odd AS', 'odd0 AS').replace('FROM odd)', 'FROM odd0)')}, n AS (SELECT s1, list_transform(regexp_extract_all(tok, '\\d+')[1:6], lambda v: right(v, 9)::BIGINT) AS x,
  list_transform(regexp_extract_all(tok, '[a-z]*\\d+[a-z]*|[a-z]+')[1:8], lambda p: CASE WHEN regexp_matches(p, '^\\d+$') THEN regexp_replace(p, '^0+(\\d)', '\\1') ELSE p END) AS hx FROM t),
z AS (SELECT a.s1, b.s1 AS cand, a.x, b.x AS y, a.hx, b.hx AS hy, len(list_filter(range(1, least(len(a.x), len(b.x)) + 1), lambda i: a.x[i] <> b.x[i])) AS nd, len(list_filter(range(1, least(len(a.hx), len(b.hx)) + 1), lambda i: a.hx[i] <> b.hx[i])) AS hd
  FROM n a JOIN n b ON b.s1 = a.s1 + 8),
y AS (SELECT *, len(x) > 0 AND len(y) > 0 AS nb, len(hx) > 0 AND len(hy) > 0 AS hb FROM z),
q AS (SELECT *, CASE WHEN nb THEN least(greatest(y[1] - x[1], -999), 999) ELSE -999 END AS dec_off FROM y),
r AS (SELECT *, CASE WHEN nb AND len(x) = len(y) AND nd = 1 THEN least(greatest(list_sum(list_transform(range(1, len(x) + 1), lambda i: y[i] - x[i])), -999), 999) ELSE dec_off END AS dec_off_all FROM q)
SELECT s1, cand, dec_off::BIGINT AS dec_off, dec_off_all::BIGINT AS dec_off_all, CASE WHEN nb THEN (dec_off_all IN ({_OFF}))::INTEGER ELSE -1 END AS dec_ind, CASE WHEN nb THEN (abs(dec_off_all) IN ({_OFF}))::INTEGER ELSE -1 END AS dec_absind,
  hb::INTEGER AS hn_both, len(hx)::INTEGER AS hn_np1, len(hy)::INTEGER AS hn_np2, CASE WHEN hb THEN (len(hx) = len(hy) AND hd = 0)::INTEGER ELSE -1 END AS hn_eq_all, CASE WHEN hb THEN (hx[1] = hy[1])::INTEGER ELSE -1 END AS hn_first_eq, CASE WHEN hb THEN hd ELSE -1 END::INTEGER AS hn_pos_diff,
  CASE WHEN hb THEN (len(hx) = len(hy) AND len(hx) >= 2 AND hd = 1 AND hx[-1] <> hy[-1])::INTEGER ELSE -1 END AS hn_head_eq_tail_diff, round(CASE WHEN hb THEN len(list_filter(hx, lambda p: list_contains(hy, p))) / greatest(len(hx), 1) ELSE -1 END, 6)::DOUBLE AS hn_s1_in_c FROM r""", "er")
def feat_house_numbers_and_offsets(spark, sf_dir):
    o = _odd(spark, sf_dir).select("s1", text.number_parts(F.col("addr")).alias("x"), text.house_parts(F.col("addr")).alias("hx"))
    z = o.join(o.select((F.col("s1") - 8).alias("s1"), F.col("s1").alias("cand"), F.col("x").alias("y"), F.col("hx").alias("hy")), "s1")
    f = features.decoy_offsets(F.col("x"), F.col("y")) | features.house(F.col("hx"), F.col("hy"))
    return z.select("s1", "cand", *[(_r(c) if k == "hn_s1_in_c" else c).alias(k) for k, c in f.items()])


@query(f"""{_WORDPAIR}, d AS (SELECT p.s1, p.cand, x, y, b0.house - a0.house AS k, list_concat(list_transform(x, lambda w: {{'w': w, 'n': -1}}), list_transform(y, lambda w: {{'w': w, 'n': 1}})) AS l FROM pairs p JOIN a USING (s1) JOIN b USING (cand) JOIN er_s1 a0 USING (s1) JOIN er_pool b0 USING (cand)),
g AS (SELECT s1, cand, min(n) AS lo, sum(CASE WHEN n > 0 THEN n ELSE 0 END) AS more, max(CASE WHEN n > 0 THEN w END) AS w FROM (SELECT s1, cand, e.w AS w, sum(e.n) AS n FROM (SELECT s1, cand, unnest(l) AS e FROM d) GROUP BY s1, cand, e.w) GROUP BY s1, cand),
h AS (SELECT s1, cand, k IN ({_OFF}) AS hit, CASE WHEN len(x) > 0 AND len(y) = len(x) + 1 AND lo >= 0 AND more = 1 THEN w END AS added FROM d JOIN g USING (s1, cand))
SELECT s1, cand, added, (added IS NOT NULL)::INTEGER AS dec_plus1, coalesce(added IN ('group', 'holdings'), false)::INTEGER AS dec_add_decoy, coalesce(added IN ('llc'), false)::INTEGER AS dec_add_filler, 0 AS dec_add_ctag,
  (added IS NOT NULL AND hit)::INTEGER AS dec_plus1_ind, (coalesce(added IN ('group', 'holdings'), false) AND hit)::INTEGER AS dec_add_decoy_ind, (coalesce(added IN ('llc'), false) AND hit)::INTEGER AS dec_add_filler_ind, 0 AS dec_add_ctag_ind FROM h""", "pairs")
def feat_added_words(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    x = fx.pairs(spark, sf_dir).select("s1", "cand").join(s1.select("s1", F.col("house").alias("h1"), text.BLOCK_NAME(F.col("name")).alias("a")), "s1").join(pool.select("cand", "house", text.BLOCK_NAME(F.col("name")).alias("b")), "cand")
    x = x.withColumns({"added": features.added_word(F.col("a"), F.col("b")), "at": (F.col("house") - F.col("h1")).isin(*features.OFFSETS).cast("int")})
    return x.select("s1", "cand", "added", *[c.alias(k) for k, c in features.decoy_words(F.col("added"), F.col("at"), ["group", "holdings"], ["llc"]).items()])


@query("""WITH n AS (SELECT p_partkey AS s1, p_partkey + 100 AS x, (p_partkey * 7919) % 2000 AS y FROM part),
s AS (SELECT s1, x, y, x::VARCHAR AS a, y::VARCHAR AS b FROM n), l AS (SELECT *, CASE WHEN len(a) >= len(b) THEN a ELSE b END AS lo, CASE WHEN len(a) >= len(b) THEN b ELSE a END AS sh FROM s)
SELECT s1, CASE WHEN x = y THEN 1 WHEN len(a) > 1 AND len(lo) > len(sh) AND (starts_with(lo, sh) OR ends_with(lo, sh) OR (len(lo) = len(sh) + 1 AND len(list_filter(range(1, len(lo) + 1), lambda i: substr(lo, 1, i - 1) || substr(lo, i + 1) = sh)) > 0)) THEN 4
  WHEN len(a) = len(b) AND len(a) > 1 AND levenshtein(a, b) = 1 THEN 5 WHEN abs(x - y) <= 2 OR abs(x - y) = 10 THEN 6 WHEN x = y + 50 THEN 7 ELSE 8 END::INTEGER AS rel FROM l""")
def feat_number_relation(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("s1"), (F.col("p_partkey") + 100).alias("x"), ((F.col("p_partkey") * 7919) % 2000).alias("y"))
    return p.select("s1", features.number_relation(F.col("x"), F.col("y"), F.array(F.col("y"), F.col("y") + 50)).cast("int").alias("rel"))


_GRAMS = f"""{_WORDPAIR}, t AS (SELECT 'a' AS side, s1 AS id, unnest(x) AS w, n AS nm FROM a UNION ALL SELECT 'b', cand, unnest(y), m FROM b),
u AS (SELECT side, id, ' ' || w || ' ' AS p, unnest([3, 4, 5]) AS n FROM t), v AS (SELECT side, id, p, n, unnest(range(1, greatest(len(p) + 1 - n, 1) + 1)) AS i FROM u),
g AS (SELECT side, id, substr(p, i, n) AS g, count(*) AS tf FROM v GROUP BY ALL), f AS (SELECT g, count(*) AS df FROM g WHERE side = 'a' GROUP BY g), fb AS (SELECT g, count(*) AS df FROM g WHERE side = 'b' GROUP BY g),
wa AS (SELECT id, g, tf * (ln((1 + (SELECT count(*) FROM a)) / (1 + df)) + 1) AS w FROM g JOIN f USING (g) WHERE side = 'a'), wb AS (SELECT id, g, tf * (ln((1 + (SELECT count(*) FROM b)) / (1 + df)) + 1) AS w FROM g JOIN fb USING (g) WHERE side = 'b'),
na AS (SELECT id, g, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM wa), nb AS (SELECT id, g, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM wb)"""


@query(f"""{_GRAMS}, c AS (SELECT p.s1, p.cand, sum(na.w * nb.w) AS c FROM pairs p JOIN na ON na.id = p.s1 JOIN nb ON nb.id = p.cand AND nb.g = na.g GROUP BY p.s1, p.cand)
SELECT s1, cand, round(coalesce(c, 0), 6)::DOUBLE AS cosine FROM pairs LEFT JOIN c USING (s1, cand)""", "pairs")
def sim_gram_cosine(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    name = lambda df, i: features.gram_texts(df.select(i, text.BLOCK_NAME(F.col("name")).alias("n")), i, "n")
    x = features.gram_cosine(fx.pairs(spark, sf_dir).select("s1", "cand"), name(s1, "s1"), name(pool, "cand"), "cosine")
    return x.select("s1", "cand", F.coalesce(_r("cosine"), F.lit(0.0)).alias("cosine"))


_IDF = {"small": 1.5, "group": 4.0, "holdings": 3.5, "widget": 2.0, "llc": 0.5}
_IDF_SQL = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in _IDF.items()) + "}"


@query(f"""WITH x AS (SELECT p.s1, p.cand, list_distinct({_toks(text.BLOCK_NAME.sql('a.name'))}) AS x, list_distinct({_toks(text.BLOCK_NAME.sql('b.name'))}) AS y, len(b.name) / greatest(len(a.name), 1) AS lr, regexp_extract_all(a.addr, '\\d+') AS na, regexp_extract_all(b.addr, '\\d+') AS nb FROM pairs p JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand)),
y AS (SELECT *, list_filter(y, lambda w: NOT list_contains(x, w)) AS ad, list_filter(x, lambda w: NOT list_contains(y, w)) AS dr FROM x)
SELECT s1, cand, round(coalesce(list_sum(list_transform(list_intersect(x, y), lambda w: coalesce({_IDF_SQL}[w], 0))), 0), 6)::DOUBLE AS bp_n_shared_idf, len(ad)::INTEGER AS bp_n_added_count, coalesce(list_max(list_transform(ad, lambda w: coalesce({_IDF_SQL}[w], 0))), 0)::DOUBLE AS bp_n_added_max_idf,
  coalesce(list_max(list_transform(dr, lambda w: coalesce({_IDF_SQL}[w], 0))), 0)::DOUBLE AS bp_n_dropped_max_idf, (len(ad) > 0 AND len(list_filter(ad, lambda w: w NOT IN ('group', 'llc', 'inc'))) = 0)::INTEGER AS bp_n_added_all_filler, round(lr, 6) AS bp_n_len_ratio,
  CASE WHEN len(na) > 0 AND len(nb) > 0 THEN least(greatest(nb[1]::BIGINT - na[1]::BIGINT, -100), 100) ELSE -999 END::BIGINT AS bp_a_num_offset FROM y""", "pairs")
def feat_second_view(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    side = lambda df, i, t: df.select(i, F.col("name").alias(f"n{t}"), F.array_distinct(text.tokens(text.BLOCK_NAME(F.col("name")))).alias(f"w{t}"), F.regexp_extract_all("addr", F.lit(r"(\d+)"), F.lit(1)).cast("array<long>").alias(f"d{t}"))
    x = fx.pairs(spark, sf_dir).select("s1", "cand").join(side(s1, "s1", "a"), "s1").join(side(pool, "cand", "b"), "cand")
    idf = F.create_map(*[F.lit(v) for kv in _IDF.items() for v in kv])
    f = features.second_view(*[F.col(c) for c in ("wa", "wb", "na", "nb", "da", "db")], idf, ["group", "llc", "inc"])
    return x.select("s1", "cand", *[(_r(c) if k in ("bp_n_shared_idf", "bp_n_len_ratio") else c.cast("long") if k == "bp_a_num_offset" else c).alias(k) for k, c in f.items()])


# ---------------------------------------------------------------- competition


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS a, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS b, coalesce(lead(p) OVER (PARTITION BY s1 ORDER BY p DESC, cand), 0) AS nx FROM pairs),
y AS (SELECT *, max(p) OVER (PARTITION BY s1) AS m1, max(CASE WHEN a = 2 THEN p END) OVER (PARTITION BY s1) AS m2, max(p) OVER (PARTITION BY cand) AS r1, max(CASE WHEN b = 2 THEN p END) OVER (PARTITION BY cand) AS r2 FROM x),
z AS (SELECT *, coalesce(CASE WHEN b = 1 THEN r2 ELSE r1 END, 0) AS o FROM y)
SELECT s1, cand, a::INTEGER AS p_rank_s1, m1 AS p_max_s1, coalesce(m2, 0) AS p_second_s1, round(p - nx, 6) AS p_gap_next, round(m1 - p, 6) AS p_gap_top, count(*) FILTER (p > 0.5) OVER (PARTITION BY s1)::BIGINT AS p_n05_s1,
  count(*) FILTER (p > 0.8) OVER (PARTITION BY s1)::BIGINT AS p_n08_s1, round(sum(p) OVER (PARTITION BY s1), 6) AS p_sum_s1, o AS p_max_other_rec, round(p - o, 6) AS p_rel_other, b::INTEGER AS p_rank_rec,
  (count(*) FILTER (p > 0.5) OVER (PARTITION BY cand) - (p > 0.5)::INTEGER)::BIGINT AS p_n05_other_rec FROM z""", "pairs")
def comp_stage2_features(spark, sf_dir):
    x = competition.stage2(fx.pairs(spark, sf_dir).select("s1", "cand", "p"))
    return x.withColumns({c: _r(c) for c in ("p_gap_next", "p_gap_top", "p_sum_s1", "p_rel_other")}).drop("p").withColumn("p_n05_other_rec", F.col("p_n05_other_rec").cast("long"))


_RIVAL = "SELECT s1, cand, round(1 - p, 4) AS q FROM pairs WHERE (s1 + cand) % 3 <> 0"


@query(f"""WITH c AS ({_RIVAL}), o AS (SELECT a.s1, a.cand, a.p, count(c.s1) AS n, max(c.q) AS m, count(*) FILTER (c.q > 0.5) AS n5, count(*) FILTER (c.q > a.p) AS gt FROM pairs a LEFT JOIN c ON a.cand = c.cand AND a.s1 <> c.s1 GROUP BY a.s1, a.cand, a.p)
SELECT s1, cand, CASE WHEN n = 0 THEN -1 ELSE m END::DOUBLE AS p_other, gt = 0 AS is_argmax, n5::BIGINT AS p_n05_other_rec, (gt + 1)::BIGINT AS p_rank_rec FROM o""", "pairs")
def comp_external_rivals(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).select("s1", "cand", "p")
    rivals = p.filter("(s1 + cand) % 3 <> 0").select("s1", "cand", F.round(1 - F.col("p"), 4).alias("q"))
    a = competition.competition(p, rivals)
    b = competition.record_side_external(p, rivals).select("s1", "cand", "p_n05_other_rec", "p_rank_rec")
    return a.select("s1", "cand", "p_other", "is_argmax").join(b, ["s1", "cand"])


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r FROM pairs WHERE p >= 0.3) SELECT s1, cand, p FROM o WHERE r = 1""", "pairs")
def comp_one_owner(spark, sf_dir):
    return competition.one_owner(fx.pairs(spark, sf_dir).filter("p >= 0.3")).select("s1", "cand", "p")


@query("""WITH g AS (SELECT cand, count(*) AS n FROM pairs WHERE p >= 0.3 GROUP BY cand HAVING count(*) > 1) SELECT count(*)::BIGINT AS records, coalesce(sum(n), 0)::BIGINT AS pairs FROM g""", "pairs")
def comp_multi_owner(spark, sf_dir):
    return competition.multi_owner(fx.pairs(spark, sf_dir).filter("p >= 0.3"))


@query("""WITH own AS (SELECT s1, cand, p AS q FROM pairs WHERE s1 % 2 = 0), oth AS (SELECT s1, cand, round(p / 2, 6) AS q FROM pairs)
SELECT * FROM own UNION ALL SELECT * FROM oth WHERE (s1, cand) NOT IN (SELECT (s1, cand) FROM own)""", "pairs")
def comp_own_overlay(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return competition.own_competition(p.filter("s1 % 2 = 0"), p.select("s1", "cand", F.round(F.col("p") / 2, 6).alias("q"))).select("s1", "cand", "q")


@query("""WITH t AS (SELECT s1, cand, p AS cos FROM pairs WHERE p > 0.2), d AS (SELECT s1, cand, round(p * 0.9, 6) AS cos FROM pairs WHERE cand % 2 = 0)
SELECT t.s1, t.cand, (SELECT count(*) FROM d WHERE d.cand = t.cand AND d.cos > t.cos) + 1 AS rank_rec_tab, ((SELECT count(*) FROM d WHERE d.cand = t.cand) + CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.cand = t.cand AND d.s1 = t.s1) THEN 0 ELSE 1 END)::BIGINT AS n_s1_rec_tab,
  round(coalesce(least(0, t.cos - (SELECT max(cos) FROM d WHERE d.cand = t.cand)), 0), 6)::DOUBLE AS rel_rec_tab FROM t""", "pairs")
def comp_record_side_table(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    out = competition.record_side_table(p.filter("p > 0.2").select("s1", "cand", F.col("p").alias("cos")), p.filter("cand % 2 = 0").select("s1", "cand", F.round(F.col("p") * 0.9, 6).alias("cos")))
    return out.select("s1", "cand", "rank_rec_tab", F.col("n_s1_rec_tab").cast("long").alias("n_s1_rec_tab"), _r("rel_rec_tab").alias("rel_rec_tab"))


@query("""SELECT s1, cand, round(sum(p) OVER w, 6) AS p_sum, count(*) FILTER (p > 0.5) OVER w::BIGINT AS p_n50, count(*) FILTER (p > 0.9) OVER w::BIGINT AS p_n90, max(p) OVER w AS p_max, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand)::INTEGER AS p_rank
FROM (SELECT * FROM pairs WHERE p > 0.005 AND p < 0.995) WINDOW w AS (PARTITION BY s1)""", "pairs")
def comp_list_aggregates_in_band(spark, sf_dir):
    return competition.list_aggregates(competition.band(fx.pairs(spark, sf_dir), 0.005, 0.995)).select("s1", "cand", _r("p_sum").alias("p_sum"), "p_n50", "p_n90", "p_max", "p_rank")


_SIBLING = f"""WITH r AS (SELECT cand, src, {text.BLOCK_NAME.sql('name')} AS name_n, {text.BLOCK_ADDR.sql('addr')} AS addr_n, list_transform(regexp_extract_all(addr, '\\d+'), lambda v: v::BIGINT) AS nums FROM er_pool),
k AS (SELECT s1, cand AS sib, p AS sp FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rk FROM pairs) WHERE p >= 0.3 AND rk <= 6),
x AS (SELECT s1, p.cand, sp, a.src, b.src AS src2, a.name_n, b.name_n AS name2, CASE WHEN a.addr_n = '' OR b.addr_n = '' THEN -1 ELSE 100.0 - levenshtein(a.addr_n, b.addr_n) END AS ad, 100.0 - levenshtein(a.name_n, b.name_n) AS nm, len(list_intersect(a.nums, b.nums)) > 0 AS ns,
  coalesce(a.nums[1] = b.nums[1], false) AS hn FROM pairs p JOIN k USING (s1) JOIN r a ON a.cand = p.cand JOIN r b ON b.cand = sib WHERE sib <> p.cand)"""


def _sibling_input(spark, sf_dir):
    _, pool, _ = fx.corpus(spark, sf_dir)
    recs = pool.select("cand", "src", text.BLOCK_NAME(F.col("name")).alias("name_n"), text.BLOCK_ADDR(F.col("addr")).alias("addr_n"), F.regexp_extract_all("addr", F.lit(r"(\d+)"), F.lit(1)).cast("array<long>").alias("nums"))
    return fx.pairs(spark, sf_dir), recs.withColumn("num_first", F.coalesce(F.try_element_at("nums", F.lit(1)), F.lit(-1)))


@query(f"""{_SIBLING}, g AS (SELECT s1, cand, count(*) AS n, sum(ns::INTEGER) AS a, sum(hn::INTEGER) AS h, max(ad) AS m, max(nm) AS nm, arg_max(sp, (ad, sp)) AS bp FROM x GROUP BY s1, cand)
SELECT s1, cand, coalesce(n, 0)::BIGINT AS sib_n, coalesce(a, 0)::BIGINT AS sib_num_share, coalesce(h, 0)::BIGINT AS sib_hn_eq, coalesce(m, -1)::DOUBLE AS sib_addr_max, coalesce(nm, -1)::DOUBLE AS sib_name_max, coalesce(bp, -1)::DOUBLE AS sib_addr_best_p FROM pairs LEFT JOIN g USING (s1, cand)""", "pairs")
def comp_siblings(spark, sf_dir):
    p, recs = _sibling_input(spark, sf_dir)
    return competition.siblings(p, recs.drop("src"), lambda a, b: 100.0 - F.levenshtein(a, b), confident=0.3)


@query(f"""{_SIBLING}, g AS (SELECT s1, cand, count(*) AS n, max(nm) AS m, max(CASE WHEN src = src2 THEN nm END) AS sm, count(*) FILTER (name_n = name2) AS e, count(*) FILTER (nm > 95) AS nr, sum(sp * nm) / sum(sp) AS w FROM x GROUP BY s1, cand)
SELECT s1, cand, coalesce(n, 0)::BIGINT AS g_n, coalesce(m, -1)::DOUBLE AS g_max, coalesce(sm, -1)::DOUBLE AS g_same_max, coalesce(e, 0)::BIGINT AS g_exact, coalesce(nr, 0)::BIGINT AS g_near, round(coalesce(w, -1) + 1e-9, 4)::DOUBLE AS g_weighted FROM pairs LEFT JOIN g USING (s1, cand)""", "pairs")
def comp_graph_features(spark, sf_dir):
    p, recs = _sibling_input(spark, sf_dir)
    return competition.graph_features(p, recs, lambda a, b: 100.0 - F.levenshtein(a, b), sure=0.3, most=6).withColumn("g_weighted", _r(F.col("g_weighted") + 1e-9, 4))


# ---------------------------------------------------------------- decisions
_COMP = """o AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rk, max(p) OVER (PARTITION BY cand) AS m1 FROM pairs),
o2 AS (SELECT *, max(CASE WHEN rk = 2 THEN p END) OVER (PARTITION BY cand) AS m2 FROM o), comp AS (SELECT s1, cand, src, country, p, label, coalesce(CASE WHEN rk = 1 THEN m2 ELSE m1 END, -1) AS p_other, rk = 1 AS is_argmax FROM o2)"""
_TRUTH = "tc AS (SELECT s.s1, s.country, count(t.cand) AS m, count(t.cand) FILTER ((t.s1, t.cand) IN (SELECT (s1, cand) FROM pairs)) AS r FROM er_s1 s LEFT JOIN er_truth t USING (s1) GROUP BY s.s1, s.country)"
_F = "CASE WHEN m = 0 THEN (k = 0)::INTEGER::DOUBLE WHEN t > 0 THEN 5.0 * t / (4 * k + m) ELSE 0 END"


def _comp(spark, sf_dir):
    return competition.competition(fx.pairs(spark, sf_dir))


def _truth(spark, sf_dir):
    s1, _, truth = fx.corpus(spark, sf_dir)
    return evaluate.truth_counts(s1, truth, fx.pairs(spark, sf_dir))


@query(f"WITH {_COMP} SELECT s1, cand, p, p_other FROM comp WHERE p >= 0.4 AND p >= p_other + 0.05", "pairs")
def dec_margin_policy(spark, sf_dir):
    return decide.policy(_comp(spark, sf_dir), 0.4, "margin", 0.05).select("s1", "cand", "p", "p_other")


@query(f"""WITH {_COMP}, {_TRUTH}, g AS (SELECT * FROM (SELECT unnest([0.2, 0.4, 0.6]::DOUBLE[]) AS tau), (SELECT unnest([0.0, 0.1]::DOUBLE[]) AS delta)),
h AS (SELECT s1, tau, delta, count(*) AS k, sum(label) AS t FROM comp JOIN g ON p >= tau AND p >= p_other + delta GROUP BY s1, tau, delta),
tg AS (SELECT * FROM tc, g), x AS (SELECT tau, delta, m, coalesce(k, 0) AS k, coalesce(t, 0) AS t FROM tg LEFT JOIN h USING (s1, tau, delta)) SELECT tau, delta, round(avg({_F}), 9) AS macro FROM x GROUP BY tau, delta""", "pairs")
def dec_threshold_sweep(spark, sf_dir):
    return decide.sweep(_comp(spark, sf_dir), _truth(spark, sf_dir), [0.2, 0.4, 0.6], [0.0, 0.1])


_UNI = f"{_COMP}, u AS (SELECT *, CASE WHEN p >= p_other THEN 1 ELSE 2 END AS qr FROM comp)"


@query(f"""WITH {_UNI}, q AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rk2 FROM u WHERE qr = 1),
f AS (SELECT s1, max(p) AS pmax, sum(p) AS psum, count(*) FILTER (p > 0.5) AS n50, count(*) FILTER (p > 0.2) AS n20, count(*) FILTER (p > 0.8) AS n80, count(*) AS ncand_best, min(CASE WHEN rk2 <= 2 THEN p END) AS p2nd,
  count(*) FILTER (src = 2 AND p > 0.5) AS n50_s2, count(*) FILTER (src = 3 AND p > 0.5) AS n50_s3 FROM q GROUP BY s1), g AS (SELECT s1, max(p) AS pmax_all, count(*) AS ncand_all FROM u GROUP BY s1)
SELECT s1, coalesce(pmax, 0) AS pmax, round(coalesce(psum, 0), 6) AS psum, coalesce(n50, 0)::BIGINT AS n50, coalesce(n20, 0)::BIGINT AS n20, coalesce(n80, 0)::BIGINT AS n80, coalesce(ncand_best, 0)::BIGINT AS ncand_best, coalesce(p2nd, 0) AS p2nd,
  coalesce(n50_s2, 0)::BIGINT AS n50_s2, coalesce(n50_s3, 0)::BIGINT AS n50_s3, pmax_all, ncand_all FROM g LEFT JOIN f USING (s1)""", "pairs")
def dec_anchor_features(spark, sf_dir):
    return decide.anchor_features(decide.universe(_comp(spark, sf_dir))).withColumn("psum", _r("psum"))


_PREFIX = f"""{_UNI}, s AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY s1) AS n, coalesce(lead(p) OVER w, 0) AS pn, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS cs, sum(p) OVER (PARTITION BY s1) AS total, max(p) OVER (PARTITION BY s1) AS pf,
  sum((src = 3)::INTEGER) OVER (w ROWS UNBOUNDED PRECEDING) AS c3, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS t FROM u WHERE qr = 1 AND p > 0.02 WINDOW w AS (PARTITION BY s1 ORDER BY p DESC, cand)),
px AS (SELECT s1, k, p AS pk, pn, cs, total - cs AS tail, n, c3, t FROM s WHERE k <= 10 UNION ALL SELECT s1, 0, 1.0, pf, 0.0, total, n, 0, 0 FROM s WHERE k = 1)"""


@query(f"""WITH {_PREFIX} SELECT s1, k::INTEGER AS k, pk::DOUBLE AS pk, pn, round(cs, 6)::DOUBLE AS cs, round(tail, 6) AS tail, round(pk - pn, 6)::DOUBLE AS gap, n::BIGINT AS n, c3::BIGINT AS c3, (k - c3)::BIGINT AS c2, round(cs / greatest(k, 1), 6)::DOUBLE AS avg, t::BIGINT AS t FROM px""", "pairs")
def dec_prefix_table(spark, sf_dir):
    x = decide.prefix_table(decide.universe(_comp(spark, sf_dir)))
    return x.select("s1", "k", "pk", "pn", _r("cs").alias("cs"), _r("tail").alias("tail"), _r("gap").alias("gap"), "n", "c3", F.col("c2").cast("long").alias("c2"), _r("avg").alias("avg"), "t")


@query(f"""WITH {_PREFIX}, sc AS (SELECT s1, k, round(1.25 * cs / (0.25 * (cs + tail) + k + 1e-9), 9) AS utility FROM px), b AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY utility DESC, k) AS r FROM sc)
SELECT s.s1, s.cand, s.p FROM s JOIN b ON b.s1 = s.s1 AND b.r = 1 AND s.k <= CASE WHEN s.s1 % 7 = 0 THEN 0 ELSE b.k END""", "pairs")
def dec_choose_prefix_with_guard(spark, sf_dir):
    u = decide.universe(_comp(spark, sf_dir))
    scored = decide.prefix_table(u).withColumn("utility", F.round(1.25 * F.col("cs") / (0.25 * (F.col("cs") + F.col("tail")) + F.col("k") + 1e-9), 9))
    s1, _, _ = fx.corpus(spark, sf_dir)
    return decide.take_prefix(u, decide.guard(decide.choose_prefix(scored), s1.filter("s1 % 7 = 0"))).select("s1", "cand", "p")


@query()
def dec_expected_score_prefix(spark, sf_dir):
    """Exact expected F0.5 of every prefix; checked against enumeration of all outcomes."""
    return decide.choose_expected(_comp(spark, sf_dir).filter("p >= p_other"), 0.1, 0.2)


@query(f"""WITH {_TRUTH}, r AS (SELECT s1, sum(label) AS r FROM pairs GROUP BY s1), x AS (SELECT m, coalesce(r.r, 0) AS r FROM tc LEFT JOIN r USING (s1))
SELECT round(avg(CASE WHEN r > 0 THEN m - r END), 9) AS lam, round(avg(CASE WHEN r = 0 THEN (m > 0)::INTEGER END), 9) AS q0 FROM x""", "pairs")
def dec_missing_rates(spark, sf_dir):
    r = decide.missing_rates(fx.pairs(spark, sf_dir), _truth(spark, sf_dir))
    return r.select(_r("lam", 9).alias("lam"), _r("q0", 9).alias("q0"))


@query(f"""WITH {_COMP}, e AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rk FROM comp WHERE is_argmax),
t AS (SELECT s1, max(CASE WHEN rk = 1 THEN p END) AS r_p1, max(CASE WHEN rk = 2 THEN p END) AS r_p2, max(CASE WHEN rk = 3 THEN p END) AS r_p3, count(*) FILTER (p > 0.3) AS r_n03, count(*) FILTER (p > 0.5) AS r_n05, count(*) FILTER (p > 0.8) AS r_n08, sum(p) AS r_sum, count(*) AS r_nelig, max(CASE WHEN rk = 1 THEN p_other END) AS t_pother FROM e GROUP BY s1),
g AS (SELECT s1, max(p) AS r_pmax_all, count(*) AS r_ncand FROM comp GROUP BY s1)
SELECT s1, r_pmax_all, r_ncand, coalesce(r_p1, 0) AS r_p1, coalesce(r_p2, 0) AS r_p2, coalesce(r_p3, 0) AS r_p3, coalesce(r_n03, 0)::BIGINT AS r_n03, coalesce(r_n05, 0)::BIGINT AS r_n05, coalesce(r_n08, 0)::BIGINT AS r_n08, round(coalesce(r_sum, 0), 6) AS r_sum, coalesce(r_nelig, 0)::BIGINT AS r_nelig,
  coalesce(t_pother, 0) AS t_pother, round(coalesce(r_p1, 0) - coalesce(r_p2, 0), 6) AS r_gap12 FROM g LEFT JOIN t USING (s1)""", "pairs")
def dec_row_features(spark, sf_dir):
    x = decide.row_features(_comp(spark, sf_dir).withColumn("elig", F.col("is_argmax")))
    return x.withColumns({"r_sum": _r("r_sum"), "r_gap12": _r("r_gap12")})


@query(f"""WITH {_COMP}, x AS (SELECT *, (s1 % 10) / 10.0 AS pe FROM comp), k AS (SELECT * FROM x WHERE is_argmax AND p >= 0.6 AND pe <= 0.8),
a AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS r FROM x WHERE is_argmax AND pe < 0.3 AND p >= 0.2 AND s1 NOT IN (SELECT s1 FROM k)) SELECT s1, cand, p FROM k UNION ALL SELECT s1, cand, p FROM a WHERE r = 1""", "pairs")
def dec_apply_row_model(spark, sf_dir):
    x = _comp(spark, sf_dir).withColumns({"elig": F.col("is_argmax"), "p_empty": (F.col("s1") % 10) / 10.0})
    return decide.apply_row(x, x.filter("elig AND p >= 0.6"), 0.8, 0.3, 0.2)


@query(f"""WITH {_UNI}, n AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rk FROM u WHERE qr = 1) SELECT s1, cand, p FROM n WHERE (s1 % 10) / 10.0 <= 0.6 AND rk <= greatest(round_even((s1 % 4) - 0.25, 0), 0) AND p > 0.3""", "pairs")
def dec_count_gate(spark, sf_dir):
    u = decide.universe(_comp(spark, sf_dir))
    counts = u.select("s1").distinct().select("s1", ((F.col("s1") % 10) / 10.0).alias("p_single"), (F.col("s1") % 4).cast("double").alias("n_expected"))
    return decide.count_gate(u, counts, threshold=0.3).select("s1", "cand", "p")


# ---------------------------------------------------------------- patterns
_CONTENT = lambda e: f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(replace(lower({text.latin_fold_sql(e)}), '.', ''), '[a-z0-9]+'), lambda w: NOT list_contains({_list(sorted({*patterns.LEGAL_FR, *patterns.LEGAL_EN}))}, w)))), ' ')"
_NEAR = f"""a AS (SELECT s1, country, street, house, string_split({_CONTENT('name')}, ' ') AS ca FROM er_s1), b AS (SELECT cand, country, street, house, string_split({_CONTENT('name')}, ' ') AS cb FROM er_pool),
j AS (SELECT s1, cand, a.country, b.house - a.house AS k, ca, list_sort(list_filter(cb, lambda w: NOT list_contains(ca, w))) AS extra, len(list_filter(ca, lambda w: NOT list_contains(cb, w))) AS lost FROM a JOIN b ON a.country = b.country AND a.street = b.street AND b.house - a.house BETWEEN -25 AND 25),
near AS (SELECT s1, cand, country, k, CASE len(extra) WHEN 0 THEN 'equal' WHEN 1 THEN 'superset+1' ELSE 'superset+2' END AS rel, CASE WHEN len(extra) > 0 THEN array_to_string(extra, ' ') END AS added FROM j WHERE lost = 0)"""


def _sides(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    return s1.withColumn("content", patterns.content(F.col("name"))), pool.withColumn("content", patterns.content(F.col("name")))


@query(f"WITH {_NEAR} SELECT s1, cand, country, k::BIGINT AS k, rel, added FROM near", "er")
def pat_neighbours(spark, sf_dir):
    return patterns.neighbours(*_sides(spark, sf_dir)).withColumn("k", F.col("k").cast("long"))


@query(f"""WITH {_NEAR}, g AS (SELECT added, count(*) FILTER (k > 0) AS n_pos, count(*) FILTER (k < 0) AS n_neg, count(*) FILTER (k = 0) AS n_zero FROM near WHERE rel = 'superset+1' GROUP BY added HAVING count(*) FILTER (k >= 0) > 0)
SELECT added, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, n_zero::BIGINT AS n_zero, n_pos >= 100 AND n_pos / (n_neg + 1) >= 2 AS decoy FROM g ORDER BY n_pos + n_zero DESC, added LIMIT 120""", "er")
def pat_added_and_decoy_words(spark, sf_dir):
    w = patterns.added_words(patterns.neighbours(*_sides(spark, sf_dir)))
    d = patterns.decoy_words(w, 100, 2).select("added", F.lit(True).alias("decoy"))
    return w.join(d, "added", "left").fillna(False, ["decoy"])


@query(f"""WITH {_NEAR} SELECT s1, cand, country, k::BIGINT AS k, CASE WHEN rel = 'equal' THEN 'EQ' WHEN rel = 'superset+2' THEN 'ADD2' WHEN added IN ('group', 'holdings') THEN 'ADDW' ELSE 'ADDO' END AS family,
  CASE WHEN abs(k) IN (1, 2) THEN 'D12' WHEN abs(k) IN ({_OFF}) THEN 'D3' ELSE 'ND' END AS bucket, CASE WHEN k > 0 THEN '+' WHEN k < 0 THEN '-' ELSE '0' END AS side, added FROM near""", "er")
def pat_families(spark, sf_dir):
    near = patterns.neighbours(*_sides(spark, sf_dir)).withColumn("k", F.col("k").cast("long"))
    return patterns.families(near, ["group", "holdings"], ["services"], features.COUNTRY_TAGS)


def _patterns(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    words = spark.createDataFrame([(c, w) for c in ("US", "India", "France") for w in ("group", "holdings")], "country string, added string")
    return patterns.pattern_pairs(fx.pairs(spark, sf_dir), a, b, words)


@query(f"""WITH {_NEAR}, six AS (SELECT DISTINCT n.s1, n.cand, n.country, n.k FROM near n JOIN pairs p ON p.s1 = n.s1 AND p.cand = n.cand WHERE rel = 'superset+1' AND added IN ('group', 'holdings') AND k IN ({_OFF}))
SELECT s1, cand, p FROM pairs WHERE p >= 0.1 AND (s1, cand) NOT IN (SELECT (s1, cand) FROM six)""", "pairs")
def pat_veto_sixword(spark, sf_dir):
    rules = {"sixword": patterns.RULES["sixword"]}
    return patterns.veto(fx.pairs(spark, sf_dir).filter("p >= 0.1"), _patterns(spark, sf_dir), rules).select("s1", "cand", "p")


_ROWS_FR, _ROWS_EN = (_map(t) for t in (patterns.LEGAL_FR, patterns.LEGAL_EN))
_FORM = lambda w: f"(CASE WHEN country = 'France' THEN {_ROWS_FR}[{w}] ELSE {_ROWS_EN}[{w}] END)"
_NUMS = lambda c: f"list_transform(regexp_extract_all(lower({c}), '(?:^|[^a-z0-9])([0-9]+)', 1), lambda v: regexp_replace(v, '^0+([0-9])', '\\1'))"
_PATTERN_SQL = f"""WITH {_NEAR}, w AS (SELECT p.s1, p.cand, a.country, b.house - a.house AS k, a.house, regexp_extract_all(replace(lower(a.name), '.', ''), '[a-z0-9]+') AS x, regexp_extract_all(replace(lower(b.name), '.', ''), '[a-z0-9]+') AS y, {_NUMS('a.addr')} AS na, {_NUMS('b.addr')} AS nb
  FROM pairs p JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand) WHERE a.street = b.street AND a.street <> '' AND (b.house = a.house OR abs(b.house - a.house) IN ({_OFF}))),
v AS (SELECT *, list_sort(list_filter(x, lambda v: {_FORM('v')} IS NULL)) AS ca, list_sort(list_filter(y, lambda v: {_FORM('v')} IS NULL)) AS cb, list_sort(list_filter(list_transform(x, lambda v: {_FORM('v')}), lambda v: v IS NOT NULL)) AS la,
  list_sort(list_filter(list_transform(y, lambda v: {_FORM('v')}), lambda v: v IS NOT NULL)) AS lb FROM w),
pat AS (SELECT DISTINCT n.s1, n.cand, n.country, n.k::BIGINT AS k, 'sixword' AS kind, added AS extra, NULL::BOOLEAN AS allnum FROM near n JOIN pairs p ON p.s1 = n.s1 AND p.cand = n.cand WHERE rel = 'superset+1' AND added IN ('group', 'holdings') AND abs(k) IN ({_OFF})
  UNION ALL SELECT s1, cand, country, k::BIGINT, 'legal', array_to_string(la, '+') || '>' || array_to_string(lb, '+'), CASE WHEN k = 0 THEN list_sort(na) = list_sort(nb)
    ELSE list_filter(nb, lambda v: NOT list_contains(na, v)) = [(house + k)::VARCHAR] AND list_filter(na, lambda v: NOT list_contains(nb, v)) = [house::VARCHAR] END FROM v WHERE len(ca) > 0 AND ca = cb AND len(lb) > 0 AND la <> lb)"""


@query(f"{_PATTERN_SQL} SELECT s1, cand, country, k, kind, extra, coalesce(allnum::INTEGER, -1)::INTEGER AS allnum FROM pat", "pairs")
def pat_pattern_pairs(spark, sf_dir):
    """The full pattern table (legal switches, all-number check, added decoy words); country tags don't occur in the fixture and are checked by literals."""
    return _patterns(spark, sf_dir).withColumns({"k": F.col("k").cast("long"), "allnum": F.coalesce(F.col("allnum").cast("int"), F.lit(-1))})


@query(f"""{_PATTERN_SQL}, gone AS (SELECT s1, cand FROM pat WHERE (kind = 'sixword' AND k IN ({_OFF})) OR (kind = 'legal' AND allnum AND ((country = 'France' AND k IN ({_OFF})) OR (country = 'US' AND k IN ({_OFF}) AND k > 2)))),
kept AS (SELECT s1, cand, p FROM pairs WHERE p >= 0.2 AND (s1, cand) NOT IN (SELECT (s1, cand) FROM gone))
SELECT s1, cand, p FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rk FROM kept) WHERE rk = 1""", "pairs")
def pat_post_pass(spark, sf_dir):
    """All rules in order, then one owner: removal only."""
    sel = fx.pairs(spark, sf_dir).filter("p >= 0.2")
    return competition.one_owner(patterns.veto(sel, _patterns(spark, sf_dir))).select("s1", "cand", "p")


@query("""WITH sel AS (SELECT s1, cand, p FROM pairs WHERE p >= 0.5), rem AS (SELECT s1, cand FROM pairs WHERE cand % 2 = 0), g AS (SELECT s1, cand FROM sel WHERE (s1, cand) IN (SELECT (s1, cand) FROM rem)),
n AS (SELECT s1, count(*) AS n FROM sel GROUP BY s1), m AS (SELECT s1, count(*) AS m FROM g GROUP BY s1) SELECT s1, cand FROM g WHERE s1 IN (SELECT s1 FROM n JOIN m USING (s1) WHERE m < n)""", "pairs")
def pat_never_empty(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return patterns.never_empty(p.filter("cand % 2 = 0").select("s1", "cand"), p.filter("p >= 0.5"))


@query(f"""WITH x AS (SELECT p.s1, p.cand, a.house AS h1, b.house AS h2, a.street AS s1s, b.street AS s2s, {_toks(text.BLOCK_NAME.sql('a.name'))} AS x, {_toks(text.BLOCK_NAME.sql('b.name'))} AS y FROM pairs p JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand)),
z AS (SELECT *, len(list_filter(x, lambda w: NOT list_contains(y, w))) AS ab, len(list_filter(y, lambda w: NOT list_contains(x, w))) AS ba FROM x)
SELECT s1, cand, CASE WHEN h2 = h1 THEN 'same' WHEN h2 - h1 IN ({_OFF}) THEN 'plus' WHEN h1 - h2 IN ({_OFF}) THEN 'minus' ELSE 'far' END || '/' || CASE WHEN s1s = s2s THEN 'same' ELSE 'other' END || '/' ||
  CASE WHEN ab = 0 AND ba = 0 THEN 'equal' WHEN ab = 0 THEN 'superset' WHEN ba = 0 THEN 'subset' WHEN len(list_intersect(x, y)) > 0 THEN 'overlap' ELSE 'apart' END AS archetype FROM z""", "pairs")
def pat_archetypes(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    side = lambda df, i, t: df.select(i, F.col("house").alias(f"h{t}"), F.col("street").alias(f"s{t}"), text.tokens(text.BLOCK_NAME(F.col("name"))).alias(f"w{t}"))
    x = fx.pairs(spark, sf_dir).select("s1", "cand").join(side(s1, "s1", "a"), "s1").join(side(pool, "cand", "b"), "cand")
    return x.select("s1", "cand", patterns.archetype(*[F.col(c) for c in ("ha", "hb", "sa", "sb", "wa", "wb")]).alias("archetype"))


@query(f"""WITH {_COMP}, x AS (SELECT c.*, b.house - a.house AS k FROM comp c JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand)), sel AS (SELECT DISTINCT cand FROM pairs WHERE p >= 0.6),
f AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r FROM x WHERE cand NOT IN (SELECT cand FROM sel) AND k > 0 AND p >= 0.3 AND p >= p_other) SELECT s1, cand, p FROM f WHERE r = 1""", "pairs")
def pat_specialist_additions(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    x = _comp(spark, sf_dir).join(s1.select("s1", F.col("house").alias("ha")), "s1").join(pool.select("cand", "house"), "cand").withColumn("k", F.col("house") - F.col("ha"))
    return patterns.additions(x, fx.pairs(spark, sf_dir).filter("p >= 0.6"), 0.3).select("s1", "cand", "p")


@query("""WITH a AS (SELECT s1, country, street, house, array_to_string(list_transform(string_split(name, ' '), lambda x: x[1]), '') AS w FROM er_s1), b AS (SELECT s1 AS cand, country, street, house + 2 AS house, substr(split_part(name, ' ', 1), 1, 1) || substr(split_part(name, ' ', 2), 1, 1) || 'b' || substr(name, 1, 0) AS w0, name FROM er_s1),
c AS (SELECT cand, country, street, house, array_to_string(list_transform(string_split(name, ' '), lambda x: x[1]), '') AS w FROM b)
SELECT a.s1, c.cand, a.country, (c.house - a.house)::BIGINT AS k FROM a JOIN c ON a.country = c.country AND a.street = c.street AND a.w = c.w AND c.house - a.house BETWEEN -25 AND 25 WHERE len(a.w) BETWEEN 2 AND 6""", "er")
def pat_acronym_neighbours(spark, sf_dir):
    s1, _, _ = fx.corpus(spark, sf_dir)
    initials = F.array_join(F.transform(F.split("name", " "), lambda x: F.substring(x, 1, 1)), "")
    return patterns.acronym_neighbours(s1.withColumn("words", F.col("name")), s1.select(F.col("s1").alias("cand"), "country", "street", (F.col("house") + 2).alias("house"), initials.alias("words"))).withColumn("k", F.col("k").cast("long"))


# ---------------------------------------------------------------- word lists
_LISTS = f"""WITH x AS (SELECT list_distinct({_toks(text.BLOCK_NAME.sql('a.name'))}) AS a, list_distinct({_toks(text.BLOCK_NAME.sql('b.name'))}) AS b FROM pairs p JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand) WHERE label = 1)"""


def _word_pairs(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    w = lambda df, i, n: df.select(i, F.array_distinct(text.tokens(text.BLOCK_NAME(F.col("name")))).alias(n))
    return fx.pairs(spark, sf_dir).filter("label = 1").select("s1", "cand").join(w(s1, "s1", "words_a"), "s1").join(w(pool, "cand", "words_b"), "cand")


@query(f"""{_LISTS}, e AS (SELECT unnest(list_filter(b, lambda w: NOT list_contains(a, w))) AS word, 1 AS n_added, 0 AS n_dropped, 0 AS n_both FROM x UNION ALL SELECT unnest(list_filter(a, lambda w: NOT list_contains(b, w))), 0, 1, 0 FROM x UNION ALL SELECT unnest(list_intersect(a, b)), 0, 0, 1 FROM x)
SELECT word, sum(n_added)::BIGINT AS n_added, sum(n_dropped)::BIGINT AS n_dropped, sum(n_both)::BIGINT AS n_both, sum(n_added) >= 20 AND sum(n_added) >= 0.2 * (sum(n_added) + sum(n_dropped) + sum(n_both)) AS filler FROM e GROUP BY word""", "pairs")
def words_insertions_and_fillers(spark, sf_dir):
    n = wordlists.insertions(_word_pairs(spark, sf_dir))
    return n.join(wordlists.select_words(n, 20, 0.2).select("word", F.lit(True).alias("filler")), "word", "left").fillna(False, ["filler"])


@query(f"""{_LISTS}, y AS (SELECT list_filter(a, lambda w: NOT list_contains(b, w)) AS o, list_filter(b, lambda w: NOT list_contains(a, w)) AS n FROM x) SELECT o[1] AS old, n[1] AS new, count(*)::BIGINT AS n FROM y WHERE len(o) = 1 AND len(n) = 1 GROUP BY 1, 2 HAVING count(*) >= 2""", "pairs")
def words_substitutions(spark, sf_dir):
    return wordlists.substitutions(_word_pairs(spark, sf_dir))


@query("""WITH k AS (SELECT s1, regexp_replace(lower(addr), '^0+', '') AS k FROM er_s1), l AS (SELECT k, min(s1) AS s1 FROM k GROUP BY k HAVING count(*) = 1) SELECT l.s1, b.cand FROM l JOIN er_pool b ON regexp_replace(lower(b.addr), '^0+', '') = l.k""", "er")
def words_unique_key_pairs(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    key = lambda df: df.withColumn("key", F.regexp_replace(F.lower("addr"), "^0+", ""))
    return wordlists.unique_key_pairs(key(s1), key(pool), ["key"]).select("s1", "cand")


@query("""WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS total, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM n)
SELECT c_nationkey, c_mktsegment, n::BIGINT AS n, total::BIGINT AS total FROM r WHERE k = 1 AND total >= 3 AND n >= 0.25 * total""")
def words_value_purity(spark, sf_dir):
    return wordlists.purity(_table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", 3, 0.25)


@query("""SELECT split_part(p_name, ' ', 2) AS name, count(DISTINCT p_size)::BIGINT AS n_addr FROM part WHERE split_part(p_name, ' ', 2) NOT IN ('ring', 'bolt') GROUP BY 1 HAVING count(DISTINCT p_size) >= 5""")
def words_junk_names(spark, sf_dir):
    r = _table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"), F.col("p_size").cast("string").alias("addr"))
    return wordlists.junk_names(r, spark.createDataFrame([("ring",), ("bolt",)], "word string"))


@query("""WITH n AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) SELECT p_name, n::BIGINT AS n, round(cume_dist() OVER (ORDER BY n), 9) AS percentile FROM n""")
def words_frequency_percentiles(spark, sf_dir):
    return wordlists.frequency_percentile(_table(spark, sf_dir, "part"), "p_name").select("p_name", "n", _r("percentile", 9).alias("percentile"))


@query("""WITH w AS (SELECT string_split(regexp_replace(lower(a.addr), '[^a-z0-9]+', ' ', 'g'), ' ') AS x, string_split(regexp_replace(lower(b.addr), '[^a-z0-9]+', ' ', 'g'), ' ') AS y FROM pairs p JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand) WHERE label = 1),
d AS (SELECT list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i]) AS spot, x, y FROM w WHERE len(x) = len(y)), o AS (SELECT x[spot[1]] AS x, y[spot[1]] AS y FROM d WHERE len(spot) = 1),
b AS (SELECT CASE WHEN len(x) < len(y) THEN x ELSE y END AS short, CASE WHEN len(x) < len(y) THEN y ELSE x END AS long FROM o),
n AS (SELECT short, long, count(*) AS n FROM b WHERE regexp_full_match(short, '[a-z]+') AND len(short) < len(long) AND regexp_matches(long, '^' || array_to_string(string_split(short, ''), '.*')) GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY short) AS t, row_number() OVER (PARTITION BY short ORDER BY n DESC, long) AS k FROM n) SELECT short, long, n::BIGINT AS n FROM r WHERE k = 1 AND n >= 2 AND n >= 0.5 * t""", "pairs")
def words_abbreviations(spark, sf_dir):
    """Short forms of street words, from copies' addresses."""
    s1, pool, _ = fx.corpus(spark, sf_dir)
    w = lambda df, i, n: df.select(i, F.split(F.regexp_replace(F.lower("addr"), "[^a-z0-9]+", " "), " ").alias(n))
    return wordlists.abbreviations(fx.pairs(spark, sf_dir).filter("label = 1").join(w(s1, "s1", "words_a"), "s1").join(w(pool, "cand", "words_b"), "cand"))


# ---------------------------------------------------------------- evaluation
_ROWS = f"{_TRUTH}, sel AS (SELECT s1, count(*) AS k, sum(label) AS t FROM pairs WHERE p >= 0.3 GROUP BY s1), rs0 AS (SELECT tc.*, coalesce(k, 0) AS k, coalesce(t, 0) AS t FROM tc LEFT JOIN sel USING (s1)), rs AS (SELECT *, {_F} AS f FROM rs0)"


@query(f"WITH {_ROWS} SELECT s1, country, m::BIGINT AS m, r::BIGINT AS r, k::BIGINT AS k, t::BIGINT AS t, round(f, 9)::DOUBLE AS f FROM rs", "pairs")
def eval_row_scores(spark, sf_dir):
    return evaluate.row_scores(fx.pairs(spark, sf_dir).filter("p >= 0.3"), _truth(spark, sf_dir)).withColumn("f", _r("f", 9))


@query(f"""WITH {_ROWS}, x AS (SELECT *, CASE WHEN m >= 4 THEN '4+' ELSE m::VARCHAR END AS mb, CASE WHEN m = 0 THEN 1.0 WHEN r > 0 THEN 5.0 * r / (4 * r + m) ELSE 0 END AS c, CASE WHEN m = 0 THEN 1.0 WHEN t > 0 THEN 5.0 * t / (4 * t + m) ELSE 0 END AS b FROM rs)
SELECT country, mb, count(*)::BIGINT AS n, round(avg(f), 9) AS macro_f05, round(avg(CASE WHEN k > 0 THEN t / k ELSE 1 END), 9) AS macro_precision, round(avg(CASE WHEN m > 0 THEN t / m ELSE (k = 0)::INTEGER END), 9) AS macro_recall, round(sum(t) / greatest(sum(k), 1), 9) AS micro_precision,
  round(sum(t) / greatest(sum(m), 1), 9) AS micro_recall, round(avg((k > 0)::INTEGER), 9) AS frac_nonempty, round(avg(k), 9) AS matches_per_s1, round(avg(c), 9) AS oracle_ceiling, round(1 - avg(c), 9) AS loss_not_in_candidates, round(avg(c) - avg(b), 9) AS loss_below_threshold, round(avg(b) - avg(f), 9) AS loss_false_positives
FROM x GROUP BY GROUPING SETS ((country), (mb), ())""", "pairs")
def eval_report(spark, sf_dir):
    r = evaluate.report(evaluate.row_scores(fx.pairs(spark, sf_dir).filter("p >= 0.3"), _truth(spark, sf_dir)))
    return r.select("country", "mb", "n", *[_r(c, 9).alias(c) for c in r.columns[3:]])


@query(f"""WITH {_TRUTH}, n AS (SELECT s1, count(*) AS n FROM pairs GROUP BY s1), x AS (SELECT m, r, coalesce(n, 0) AS n FROM tc LEFT JOIN n USING (s1))
SELECT round(avg(CASE WHEN m = 0 THEN 1.0 WHEN r > 0 THEN 5.0 * r / (4 * r + m) ELSE 0 END), 9) AS oracle, round(sum(r) / sum(m), 9) AS recall, round(avg(n), 9) AS mean_n, quantile_cont(n, 0.95)::DOUBLE AS p95_n, max(n)::BIGINT AS max_n FROM x""", "pairs")
def eval_candidate_ceiling(spark, sf_dir):
    c = evaluate.ceiling(_truth(spark, sf_dir), fx.pairs(spark, sf_dir))
    return c.select(_r("oracle", 9).alias("oracle"), _r("recall", 9).alias("recall"), _r("mean_n", 9).alias("mean_n"), "p95_n", "max_n")


@query(f"""WITH {_TRUTH}, a AS (SELECT * FROM pairs WHERE p >= 0.3), b AS (SELECT * FROM pairs WHERE p >= 0.4 OR cand % 11 = 0),
ra AS (SELECT s1, country, {_F} AS f FROM (SELECT tc.*, coalesce(k, 0) AS k, coalesce(t, 0) AS t FROM tc LEFT JOIN (SELECT s1, count(*) AS k, sum(label) AS t FROM a GROUP BY s1) USING (s1))),
rb AS (SELECT s1, {_F} AS g FROM (SELECT tc.*, coalesce(k, 0) AS k, coalesce(t, 0) AS t FROM tc LEFT JOIN (SELECT s1, count(*) AS k, sum(label) AS t FROM b GROUP BY s1) USING (s1))),
x AS (SELECT country, round(avg(f - g), 9) AS delta, count(*) FILTER (f > g)::BIGINT AS improved, count(*) FILTER (f < g)::BIGINT AS harmed FROM ra JOIN rb USING (s1) GROUP BY country),
mv AS (SELECT country, 'added' AS side, label FROM a WHERE (s1, cand) NOT IN (SELECT (s1, cand) FROM b) UNION ALL SELECT country, 'removed', label FROM b WHERE (s1, cand) NOT IN (SELECT (s1, cand) FROM a)),
y AS (SELECT country, count(*) FILTER (side = 'added' AND label = 1)::BIGINT AS added_true, count(*) FILTER (side = 'added' AND label = 0)::BIGINT AS added_false, count(*) FILTER (side = 'removed' AND label = 1)::BIGINT AS removed_true, count(*) FILTER (side = 'removed' AND label = 0)::BIGINT AS removed_false FROM mv GROUP BY country)
SELECT x.*, coalesce(added_true, 0) AS added_true, coalesce(added_false, 0) AS added_false, coalesce(removed_true, 0) AS removed_true, coalesce(removed_false, 0) AS removed_false FROM x LEFT JOIN y USING (country)""", "pairs")
def eval_compare_selections(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return evaluate.compare(p.filter("p >= 0.3"), p.filter("p >= 0.4 OR cand % 11 = 0"), _truth(spark, sf_dir))


@query("""WITH t AS (SELECT s1, cand, 0 AS i FROM pairs WHERE p >= 0.3 UNION ALL SELECT s1, cand, 1 FROM pairs WHERE p >= 0.4 UNION ALL SELECT s1, cand, 2 FROM pairs WHERE cand % 5 = 0),
g AS (SELECT s1, cand, string_agg(i::VARCHAR, '' ORDER BY i) AS signature, count(*) AS n FROM t GROUP BY s1, cand) SELECT n::BIGINT AS n_models, signature, count(*)::BIGINT AS pairs FROM g GROUP BY n, signature""", "pairs")
def eval_votes(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return evaluate.votes([p.filter("p >= 0.3"), p.filter("p >= 0.4"), p.filter("cand % 5 = 0")])


@query(f"""WITH {_NEAR}, f AS (SELECT CASE WHEN rel = 'equal' THEN 'EQ' WHEN rel = 'superset+2' THEN 'ADD2' ELSE 'ADD1' END AS family, k FROM near),
g AS (SELECT family, count(*) FILTER (k > 0) AS a, count(*) FILTER (k < 0) AS b FROM f GROUP BY family), h AS (SELECT *, (b + 0.5) / (a + b + 1) AS q FROM g)
SELECT family, a::BIGINT AS n_plus, b::BIGINT AS n_minus, round(CASE WHEN a > 0 THEN greatest(0, 1 - b / a) END, 9)::DOUBLE AS decoy_share, round(greatest(0, q - 1.96 * sqrt(q * (1 - q) / (a + b + 2))), 9) AS p_low, round(least(1, q + 1.96 * sqrt(q * (1 - q) / (a + b + 2))), 9) AS p_high FROM h""", "er")
def eval_mirror_estimate(spark, sf_dir):
    near = patterns.neighbours(*_sides(spark, sf_dir))
    fam = F.when(F.col("rel") == "equal", "EQ").when(F.col("rel") == "superset+2", "ADD2").otherwise("ADD1")
    m = evaluate.mirror_estimate(near.withColumn("family", fam))
    return m.select("family", "n_plus", "n_minus", *[_r(c, 9).alias(c) for c in ("decoy_share", "p_low", "p_high")])


@query()
def eval_removal_value(spark, sf_dir):
    """Expected change of an anchor's score per removal; checked against enumeration of all outcomes."""
    sel = fx.pairs(spark, sf_dir).filter("p >= 0.4")
    lists = sel.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct("cand", "p"))).alias("l"))
    x = sel.join(lists, "s1").withColumn("rest", F.transform(F.filter("l", lambda e: e["cand"] != F.col("cand")), lambda e: e["p"]))
    return x.select("s1", "cand", _r(evaluate.removal_value(F.size("l"), F.col("rest"), F.col("p"), F.lit(0.0)), 9).alias("value"))


# ---------------------------------------------------------------- learning
@query("""WITH g AS (SELECT p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM pairs GROUP BY p),
x AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(pos + neg) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS a FROM g)
SELECT round(sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)), 9) AS auc, round(sum(pos * tp / a) / sum(pos), 9) AS ap, round(-sum(pos * ln(p) + neg * ln(1 - p)) / sum(pos + neg), 9) AS logloss FROM x""", "pairs")
def learn_ranking_metrics(spark, sf_dir):
    m = learning.ranking_metrics(fx.pairs(spark, sf_dir), "p", "label")
    return m.select(*[_r(c, 9).alias(c) for c in m.columns])


def _logit(e: str) -> str:
    return f"ln(least(greatest({e}, 1e-6), 1 - 1e-6) / (1 - least(greatest({e}, 1e-6), 1 - 1e-6)))"


@query(f"""WITH x AS (SELECT s1, cand, p, (1 + (cand * 31) % 97) / 100.0 AS a, (1 + (s1 * 17) % 89) / 100.0 AS b FROM pairs), z AS (SELECT *, {_logit('p')} + {_logit('a')} - {_logit('b')} AS zz, [{_logit('p')}, {_logit('a')}, {_logit('b')}] AS l FROM x),
w AS (SELECT *, list_avg(l) AS m FROM z)
SELECT s1, cand, round(1 / (1 + exp(-least(greatest(zz, -13.8), 13.8))) + 1e-9, 5) AS blend, round(list_max(l) - list_min(l), 6) AS z_spread, round(sqrt(list_avg(list_transform(l, lambda v: (v - m) * (v - m)))), 6) AS z_std,
  len(list_filter(l, lambda v: v > 0))::INTEGER AS vote05, round({_logit('p')} - m, 6) AS anchor_vs_mean, round(CASE WHEN s1 % 2 = 0 THEN 1 / (1 + exp(-({_logit('a')} + {_logit('b')}) / 2)) ELSE p END, 6) AS seeds FROM w""", "pairs")
def learn_logit_blends(spark, sf_dir):
    x = fx.pairs(spark, sf_dir).withColumns({"a": (1 + (F.col("cand") * 31) % 97) / 100.0, "b": (1 + (F.col("s1") * 17) % 89) / 100.0})
    p, a, b = F.col("p"), F.col("a"), F.col("b")
    f = learning.agreement_features([p, a, b], p)
    return x.select("s1", "cand", _r(learning.anchored_blend(p, [(a, b, 1.0)]) + 1e-9, 5).alias("blend"), _r(f["z_spread"]).alias("z_spread"), _r(f["z_std"]).alias("z_std"), f["vote05"].alias("vote05"), _r(f["anchor_vs_mean"]).alias("anchor_vs_mean"), _r(learning.seed_mean(p, [a, b], F.col("s1") % 2 == 0)).alias("seeds"))


@query("""SELECT s1, cand, CASE s1 % 3 WHEN 0 THEN 0.2 WHEN 1 THEN p ELSE (p + 0.2) / 2 END AS oof, CASE WHEN src = 2 THEN p ELSE 0.1 END AS hybrid FROM pairs""", "pairs")
def learn_oof_and_hybrid(spark, sf_dir):
    x = fx.pairs(spark, sf_dir).withColumn("fold", F.when(F.col("s1") % 3 < 2, F.col("s1") % 3))
    return x.select("s1", "cand", learning.out_of_fold([F.col("p"), F.lit(0.2)], F.col("fold")).alias("oof"), learning.hybrid(F.col("p"), F.lit(0.1), F.col("src") == 2).alias("hybrid"))


@query("""WITH a AS (SELECT s1, list_sort(list(cand)) AS c FROM pairs WHERE p >= 0.3 GROUP BY s1), b AS (SELECT s1, list_sort(list(cand)) AS c FROM pairs WHERE p >= 0.32 GROUP BY s1), z AS (SELECT s1, list_sort(list(cand)) AS c FROM pairs WHERE p >= 0.5 GROUP BY s1),
n AS (SELECT a.s1, a.c FROM a JOIN b ON a.s1 = b.s1 AND a.c = b.c) SELECT coalesce(n.s1, z.s1) AS s1, array_to_string(coalesce(n.c, z.c), ',') AS cands FROM n FULL JOIN z ON n.s1 = z.s1""", "pairs")
def learn_seed_consensus(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    out = learning.seed_consensus([p.filter("p >= 0.3"), p.filter("p >= 0.32")], p.filter("p >= 0.5"))
    return out.select("s1", F.array_join(F.col("cands").cast("array<string>"), ",").alias("cands"))


@query("""WITH sq AS (SELECT quantile_cont(l_quantity, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS a FROM lineitem WHERE l_returnflag = 'R'),
rq AS (SELECT quantile_cont(l_extendedprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS b FROM lineitem WHERE l_returnflag = 'N'),
k AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, a, b, len(list_filter(a, lambda v: v <= l_quantity)) AS i FROM lineitem, sq, rq WHERE l_returnflag = 'A')
SELECT l_orderkey, l_linenumber, round(CASE WHEN x < a[1] THEN b[1] WHEN x >= a[11] THEN b[11] WHEN a[i + 1] > a[i] THEN b[i] + (b[i + 1] - b[i]) * (x - a[i]) / (a[i + 1] - a[i]) ELSE b[i] END + 1e-9, 4) AS mapped FROM k""")
def learn_quantile_map(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    table = (learning.quantile_map(li.filter("l_returnflag = 'R'"), li, "l_quantity", 11)[0], learning.quantile_map(li, li.filter("l_returnflag = 'N'"), "l_extendedprice", 11)[1])
    return li.filter("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", F.round(learning.apply_quantile_map(F.col("l_quantity"), table) + 1e-9, 4).alias("mapped"))


def _trainable(spark, sf_dir):
    x = competition.stage2(fx.pairs(spark, sf_dir).select("s1", "cand", "src", "label", "p"))
    return x.withColumn("fold", keys.bucket(F.col("s1"), 2)), ["p", "p_rank_s1", "p_gap_next", "p_max_other_rec", "p_rank_rec"]


@query()
def learn_cross_fit_trees(spark, sf_dir):
    """Out-of-fold probabilities of two-fold boosted trees."""
    x, f = _trainable(spark, sf_dir)
    return learning.cross_fit(x, f, "label", "fold", rounds=5, depth=3).select("s1", "cand", "label", "p1")


@query()
def learn_residual_boosting(spark, sf_dir):
    x, f = _trainable(spark, sf_dir)
    return learning.residual_boost(x, f[1:], "label", "p", rounds=2).select("s1", "cand", "label", "p3")


@query()
def learn_set_decoder(spark, sf_dir):
    """Prefixes scored by a regression of their realised F0.5, the best prefix taken."""
    u = decide.universe(_comp(spark, sf_dir))
    px = decide.prefix_table(u).join(_truth(spark, sf_dir).select("s1", "m"), "s1").withColumn("y", decide.prefix_target(F.col("k"), F.col("t"), F.col("m")))
    scored = learning.prefix_model(px, ["k", "pk", "pn", "cs", "tail", "gap", "n", "avg"], "y", rounds=5, depth=3)
    return decide.take_prefix(u, decide.choose_prefix(scored)).select("s1", "cand", "p")


# ---------------------------------------------------------------- sources and sinks
@query("""WITH sel AS (SELECT s1, cand FROM pairs WHERE p >= 0.5) SELECT s.s1, coalesce(string_agg(DISTINCT cand::VARCHAR, ',' ORDER BY cand::VARCHAR), '') AS ids FROM er_s1 s LEFT JOIN sel USING (s1) GROUP BY s.s1""", "pairs")
def io_id_lists(spark, sf_dir):
    s1, _, _ = fx.corpus(spark, sf_dir)
    return io.id_lists(s1, fx.pairs(spark, sf_dir).filter("p >= 0.5").select("s1", F.col("cand").cast("string").alias("cand")), "s1", "cand")


@query("""WITH l AS (SELECT s1, cand::VARCHAR AS id FROM pairs WHERE p >= 0.5) SELECT s1, id FROM l""", "pairs")
def io_id_pairs(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).filter("p >= 0.5").select("s1", F.col("cand").cast("string").alias("cand"))
    return io.id_pairs(io.id_lists(p.select("s1").distinct(), p, "s1", "cand"), "s1", "ids")


@query("""WITH sel AS (SELECT s1, cand FROM pairs WHERE p >= 0.4 UNION ALL SELECT s1, cand FROM pairs WHERE p >= 0.9 UNION ALL SELECT s1 + 1000000, cand FROM pairs WHERE s1 = 3), c AS (SELECT s1, cand FROM pairs WHERE p >= 0.45)
SELECT 'duplicate_pairs' AS fault, count(*)::BIGINT AS n FROM (SELECT 1 FROM sel GROUP BY s1, cand HAVING count(*) > 1) UNION ALL SELECT 'many_owners', count(*) FROM (SELECT 1 FROM (SELECT DISTINCT * FROM sel) GROUP BY cand HAVING count(*) > 1)
UNION ALL SELECT 'unknown_s1', count(*) FROM sel WHERE s1 NOT IN (SELECT s1 FROM er_s1) UNION ALL SELECT 'unknown_cand', count(*) FROM sel WHERE cand NOT IN (SELECT cand FROM er_pool) UNION ALL SELECT 'not_candidates', count(*) FROM sel WHERE (s1, cand) NOT IN (SELECT (s1, cand) FROM c)
UNION ALL SELECT 'other_country', count(*) FROM sel JOIN er_s1 a USING (s1) JOIN er_pool b USING (cand) WHERE a.country <> b.country""", "pairs")
def io_submission_faults(spark, sf_dir):
    s1, pool, _ = fx.corpus(spark, sf_dir)
    p = fx.pairs(spark, sf_dir).select("s1", "cand", "p")
    sel = p.filter("p >= 0.4").unionByName(p.filter("p >= 0.9")).unionByName(p.filter("s1 = 3").withColumn("s1", F.col("s1") + 1000000)).select("s1", "cand")
    return io.violations(sel, p.filter("p >= 0.45"), s1, pool)


@query("""SELECT count(*)::BIGINT AS n_rows, sum(('0x' || substr(md5(p_brand || chr(31) || p_name || chr(31) || p_partkey::VARCHAR), 1, 12))::BIGINT)::VARCHAR AS checksum FROM part""")
def io_fingerprint(spark, sf_dir):
    return keys.fingerprint(_table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey"))


@query("""WITH a AS (SELECT s1 FROM er_s1 WHERE ('0x' || substr(md5('smoke' || s1::VARCHAR), 1, 8))::BIGINT % 10 = 0), m AS (SELECT cand FROM er_truth WHERE s1 IN (SELECT s1 FROM a))
SELECT 's1' AS part, s1 AS id FROM a UNION ALL SELECT 'pool', cand FROM er_pool WHERE cand IN (SELECT cand FROM m) OR ('0x' || substr(md5('smoke' || cand::VARCHAR), 1, 8))::BIGINT % 50 = 0""", "er")
def io_smoke_sample(spark, sf_dir):
    a, b = io.smoke_sample(*fx.corpus(spark, sf_dir))
    return a.select(F.lit("s1").alias("part"), F.col("s1").alias("id")).unionByName(b.select(F.lit("pool").alias("part"), F.col("cand").alias("id")))
