"""How the roles of the operators bind to the tables: carriers are orders, entities are parts and suppliers.

Order status gives the modality (F base, O and P the two follow-ups), the order year the period; line items are mentions.
The same views are given as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.functions import expr

MODALITIES = {"F": "base", "O": "trial", "P": "patent"}
# fixed values: part types as entity types; STANDARD is the type that pairs leave out
ENTITY_TYPES = {"promo": "chemical", "economy": "chemical", "medium": "chemical", "small": "gene", "large": "gene", "standard": "species"}
PAIR_TYPES = [("chemical", "disease"), ("gene", "disease"), ("chemical", "gene")]
CUTOFFS = [(1996, "train"), (1997, "validation"), (1998, "test")]
HORIZON = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carriers(spark, d) -> DataFrame:
    """carrier_id, carrier_type, year, project_id."""
    o = table(spark, d, "orders")
    kind = F.element_at(F.create_map(*(F.lit(x) for p in MODALITIES.items() for x in p)), F.col("o_orderstatus"))
    return o.select(expr.key(F.col("o_orderkey")).alias("carrier_id"), kind.alias("carrier_type"), F.year("o_orderdate").alias("year"), expr.key(F.col("o_custkey")).alias("project_id"))


def entities(spark, d) -> DataFrame:
    """entity_id, entity_type, entity_name, of parts and suppliers."""
    p = table(spark, d, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("entity_id"), expr.alias(F.col("p_type"), ENTITY_TYPES).alias("entity_type"), F.col("p_name").alias("entity_name")
    )
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("entity_id"), F.lit("disease").alias("entity_type"), F.col("s_name").alias("entity_name"))
    return p.unionByName(s)


def raw_mentions(spark, d) -> DataFrame:
    """carrier_id, entity_id, field, prob, start: one row for each mention of a part or supplier."""
    li = table(spark, d, "lineitem")
    side = F.explode(F.array(F.concat(F.lit("P"), F.col("l_partkey")), F.concat(F.lit("S"), F.col("l_suppkey"))))
    return li.select(
        F.col("l_orderkey").cast("string").alias("carrier_id"), side.alias("entity_id"), F.col("l_returnflag").alias("field"), F.col("l_discount").alias("prob"), F.col("l_linenumber").alias("start")
    )


CTE = """
carriers AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS carrier_id,
    CASE o_orderstatus WHEN 'F' THEN 'base' WHEN 'O' THEN 'trial' WHEN 'P' THEN 'patent' END AS carrier_type,
    CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey AS VARCHAR) AS project_id
  FROM orders),
entities AS (
  SELECT 'P' || p_partkey AS entity_id,
    CASE WHEN p_type IN ('PROMO', 'ECONOMY', 'MEDIUM') THEN 'chemical' WHEN p_type IN ('SMALL', 'LARGE') THEN 'gene'
      WHEN p_type = 'STANDARD' THEN 'species' ELSE lower(p_type) END AS entity_type, p_name AS entity_name
  FROM part
  UNION ALL SELECT 'S' || s_suppkey, 'disease', s_name FROM supplier),
raw_mentions AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS carrier_id, 'P' || l_partkey AS entity_id, l_returnflag AS field, l_discount AS prob, l_linenumber AS start FROM lineitem
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR), 'S' || l_suppkey, l_returnflag, l_discount, l_linenumber FROM lineitem),
mentions AS (
  SELECT c.carrier_type, c.carrier_id, c.carrier_type || ':' || c.carrier_id AS carrier_key, c.year, e.entity_id, e.entity_type, count(*) AS mention_count
  FROM raw_mentions m JOIN carriers c ON m.carrier_id = c.carrier_id JOIN entities e ON m.entity_id = e.entity_id
  WHERE e.entity_type <> 'species' AND c.year IS NOT NULL
  GROUP BY ALL),
pair_types(type_a, type_b) AS (VALUES ('chemical', 'disease'), ('gene', 'disease'), ('chemical', 'gene')),
evidence AS (
  SELECT 'ku_' || substr(md5(p.type_a || '-' || p.type_b || '||' || a.entity_id || '||' || b.entity_id), 1, 16) AS unit_id,
    p.type_a || '-' || p.type_b AS pair_type, a.entity_id AS entity_a, b.entity_id AS entity_b,
    a.carrier_type, a.carrier_id, a.carrier_key, a.year, a.mention_count AS mention_count_a, b.mention_count AS mention_count_b,
    sqrt(a.mention_count * b.mention_count) AS pair_weight
  FROM mentions a JOIN mentions b ON a.carrier_key = b.carrier_key AND a.year = b.year
  JOIN pair_types p ON a.entity_type = p.type_a AND b.entity_type = p.type_b),
supported AS (SELECT unit_id FROM evidence GROUP BY unit_id HAVING count(DISTINCT carrier_key) >= 2),
unit_evidence AS (SELECT e.* FROM evidence e JOIN supported s ON e.unit_id = s.unit_id),
units AS (
  SELECT unit_id, pair_type, entity_a, entity_b, count(DISTINCT carrier_key) AS carrier_count, round(sum(pair_weight), 6) AS total_weight,
    round(avg(pair_weight), 6) AS mean_weight, round(max(pair_weight), 6) AS max_weight, min(year) AS first_year, max(year) AS last_year,
    count(DISTINCT CASE WHEN carrier_type = 'base' THEN carrier_key END) AS base_count,
    count(DISTINCT CASE WHEN carrier_type = 'patent' THEN carrier_key END) AS patent_count,
    count(DISTINCT CASE WHEN carrier_type = 'trial' THEN carrier_key END) AS trial_count
  FROM unit_evidence GROUP BY unit_id, pair_type, entity_a, entity_b)
"""


def sql(select: str, more: str = "") -> str:
    return f"WITH {CTE}{', ' + more if more else ''} {select}"
