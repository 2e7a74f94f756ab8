"""A linkage corpus derived from the part table by SQL that both engines run, so that the truth is known.

er_s1: one anchor per part. er_pool: up to four records per part: an upper-case copy, a restyled copy, a decoy at a
neighbouring house (its name has one word more) and a mirror decoy on the other side. er_truth: the copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.keys import large

_STREET = (
    "CASE (p_partkey / 40) % 7 WHEN 0 THEN 'main' WHEN 1 THEN 'oak hill' WHEN 2 THEN 'gandhi' WHEN 3 THEN 'concord' WHEN 4 THEN 'lake view' WHEN 5 THEN 'de dieppe' ELSE 'station' END"
)
_COUNTRY = "CASE (p_partkey / 40) % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END"
_CITY = "CASE (p_partkey / 280) % 6 WHEN 0 THEN 'troy, new york' WHEN 1 THEN 'salem, tamil nadu' WHEN 2 THEN 'lille, nord' WHEN 3 THEN 'portland, oregon' WHEN 4 THEN 'billings, montana' ELSE 'goa, goa' END"
_LEGAL = "CASE p_partkey % 5 WHEN 0 THEN ' llc' WHEN 1 THEN ' pvt ltd' WHEN 2 THEN ' sarl' WHEN 3 THEN ' inc' ELSE '' END"
_OTHER_LEGAL = "CASE p_partkey % 5 WHEN 0 THEN ' inc' WHEN 1 THEN ' ltd' WHEN 2 THEN ' sas' WHEN 3 THEN ' corp' ELSE ' llc' END"
_BASE = "p_name || ' ' || lower(replace(p_brand, '#', ' ')) || ' ' || lower(p_type)"
_HOUSE = "(p_partkey % 40 + 1)"
_K = "CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 5 END"


def _int(expr: str) -> str:
    """Whole-number division differs between the engines: floor is asked for by name."""
    return expr.replace("(p_partkey / 40)", "cast(floor(p_partkey / 40.0) as bigint)").replace("(p_partkey / 280)", "cast(floor(p_partkey / 280.0) as bigint)")


STREET, COUNTRY, CITY = map(_int, (_STREET, _COUNTRY, _CITY))


def _addr(house: str, street_type: str) -> str:
    return f"cast({house} as varchar(20)) || ' ' || {STREET} || ' {street_type}, ' || {CITY}"


S1_SQL = f"""
SELECT p_partkey AS s1, 'S1-' || cast(p_partkey as varchar(20)) AS s1_id, {_BASE} || {_LEGAL} AS name, {_addr(_HOUSE, 'street')} AS addr,
  {COUNTRY} AS country, cast({_HOUSE} as bigint) AS house, {STREET} AS street
FROM part"""


def _record(op: str, n: int, src: int, name: str, addr: str, house: str, where: str) -> str:
    return f"""SELECT p_partkey * 4 + {n} AS cand, 'S{src}-' || cast(p_partkey * 4 + {n} as varchar(20)) AS cand_id, cast({src} as int) AS src, {name} AS name, {addr} AS addr,
  {COUNTRY} AS country, cast({house} as bigint) AS house, {STREET} AS street, p_partkey AS of_s1, '{op}' AS op FROM part WHERE {where}"""


POOL_SQL = " UNION ALL ".join([
    _record("copy", 0, 2, f"upper({_BASE} || {_LEGAL})", f"upper({_addr(_HOUSE, 'st')})", _HOUSE, "p_partkey % 4 <> 3"),
    _record("restyle", 1, 3, f"{_BASE} || {_OTHER_LEGAL}", f"CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '00' || {_addr(_HOUSE, 'street')} END", _HOUSE, "p_partkey % 3 <> 1"),
    _record("decoy", 2, 2, f"{_BASE} || ' group' || {_LEGAL}", _addr(f"({_HOUSE} + {_K})", "street"), f"{_HOUSE} + {_K}", "p_partkey % 5 = 0"),
    _record("mirror", 3, 3, f"{_BASE} || ' holdings'", _addr(f"({_HOUSE} - {_K})", "street"), f"{_HOUSE} - {_K}", f"p_partkey % 25 = 0 AND {_HOUSE} > 5"),
])
TRUTH_SQL = "SELECT of_s1 AS s1, cand FROM er_pool WHERE op IN ('copy', 'restyle')"

#: Scored pairs: every record against the anchors of its own block of 40 ids and street within five houses, with a made-up but exact score.
#: Street and country recur every 21 blocks; records and anchors of different blocks are not paired, here and in the oracle SQL alike.
PAIRS_SQL = """
SELECT a.s1, b.cand, b.src, a.country,
  (1 + (a.s1 * 7919 + b.cand * 104729) % 997) / 1000.0 * CASE WHEN b.of_s1 = a.s1 AND b.op IN ('copy', 'restyle') THEN 1.0 ELSE 0.5 END AS p,
  CASE WHEN b.of_s1 = a.s1 AND b.op IN ('copy', 'restyle') THEN 1 ELSE 0 END AS label
FROM er_s1 a JOIN er_pool b ON a.street = b.street AND a.country = b.country AND cast(floor(a.s1 / 40.0) as bigint) = cast(floor(b.of_s1 / 40.0) as bigint)
WHERE b.house - a.house BETWEEN -5 AND 5"""

WITH = f"er_s1 AS ({S1_SQL}), er_pool AS ({POOL_SQL}), er_truth AS ({TRUTH_SQL})"
WITH_PAIRS = f"{WITH}, pairs0 AS ({PAIRS_SQL}), pairs AS (SELECT s1, cand, src, country, cast(p as double) AS p, label FROM pairs0)"


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """er_s1, er_pool, er_truth."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    s1 = spark.sql(S1_SQL.replace("FROM part", "FROM {part}"), part=part)
    pool = spark.sql(POOL_SQL.replace("FROM part", "FROM {part}"), part=part)
    return s1, pool, spark.sql(TRUTH_SQL.replace("er_pool", "{pool}"), pool=pool)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs within a block of 40 ids (see PAIRS_SQL): s1, cand, src, country, p, label."""
    s1, pool, _ = corpus(spark, sf_dir)
    out = spark.sql(PAIRS_SQL.replace("er_s1 a", "{s1} a").replace("er_pool b", "{pool} b"), s1=s1, pool=large(pool))
    return out.selectExpr("s1", "cand", "src", "country", "cast(p as double) as p", "label")
