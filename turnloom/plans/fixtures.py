"""Dialogue-shaped tables derived from the generic ones, in Spark and, as CTEs, in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import DELETE
from ..operators.dialogue import fold
from ..operators.search import unit
from ..session import table

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SLOTS = [f"shop-{e}" for e in EVENT_TYPES]


def gold_events(spark: SparkSession, sf: str) -> DataFrame:
    """id, turn_id, event_id, slot, value (gold), pvalue (predicted; null where a deletion was missed)."""
    e = table(spark, sf, "events")
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    level = F.pmod(F.floor("value").cast("int"), F.lit(5))
    deleted = F.col("event_id") % 10 == 0
    gold = F.when(deleted, DELETE).otherwise(level.cast("string"))
    pred = F.when(F.col("event_id") % 20 == 0, None).when(deleted, DELETE).when(F.col("event_id") % 7 == 0, ((level + 1) % 5).cast("string")).otherwise(level.cast("string"))
    return e.select(F.col("user_id").alias("id"), turn.alias("turn_id"), "event_id", F.concat(F.lit("shop-"), "event_type").alias("slot"), gold.alias("value"), pred.alias("pvalue"))


SQL_GOLD = """gold AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn_id, event_id,
  'shop-' || event_type AS slot,
  CASE WHEN event_id % 10 = 0 THEN '[DELETE]' ELSE CAST(CAST(floor(value) AS INT) % 5 AS VARCHAR) END AS value,
  CASE WHEN event_id % 20 = 0 THEN NULL WHEN event_id % 10 = 0 THEN '[DELETE]'
       WHEN event_id % 7 = 0 THEN CAST((CAST(floor(value) AS INT) % 5 + 1) % 5 AS VARCHAR)
       ELSE CAST(CAST(floor(value) AS INT) % 5 AS VARCHAR) END AS pvalue
  FROM events)"""


def states(spark: SparkSession, sf: str) -> DataFrame:
    """id, turn_id, event_id, slot, value, gold and pred (the states after the turn, maps)."""
    e = gold_events(spark, sf)
    return e.withColumn("gold", fold(e, SLOTS)).withColumn("pred", fold(e, SLOTS, "pvalue"))


#: state: a row a turn and slot of the universe, with the gold and predicted value (null: not in the state).
SQL_STATE = (
    SQL_GOLD
    + """, slots AS (SELECT unnest(['shop-click', 'shop-error', 'shop-purchase', 'shop-signup', 'shop-view']) AS s),
filled AS (SELECT id, turn_id, event_id, s,
  last_value(CASE WHEN slot = s THEN value END IGNORE NULLS) OVER w AS g0,
  last_value(CASE WHEN slot = s THEN pvalue END IGNORE NULLS) OVER w AS p0
  FROM gold, slots WINDOW w AS (PARTITION BY id, s ORDER BY turn_id ROWS UNBOUNDED PRECEDING)),
state AS (SELECT id, turn_id, event_id, s, nullif(g0, '[DELETE]') AS g, nullif(p0, '[DELETE]') AS p FROM filled),
turns AS (SELECT id, turn_id, count(*) FILTER (WHERE g IS NOT NULL AND g = p) AS tp, count(*) FILTER (WHERE g IS NULL AND p IS NOT NULL) AS fp,
  count(*) FILTER (WHERE g IS NOT NULL AND (p IS NULL OR p <> g)) AS fn FROM state GROUP BY id, turn_id),
metrics AS (SELECT id, turn_id, tp, fp, fn, CASE WHEN fp = 0 AND fn = 0 THEN 1 ELSE 0 END AS jga, (5 - fn - fp) / 5e0 AS acc,
  CASE WHEN tp = 0 THEN 0e0 ELSE 2e0 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / ((tp / (tp + fp)::DOUBLE) + (tp / (tp + fn)::DOUBLE)) END AS f1 FROM turns)"""
)


def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    """id, turn_id, sys, usr: each user row with the closest earlier other row of its conversation."""
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("sys", F.coalesce(F.last(F.when(F.col("role") != "user", F.col("text")), ignorenulls=True).over(before), F.lit("none")))
    u = c.where("role = 'user'").withColumn("turn_id", F.row_number().over(w) - 1)
    return u.select(F.col("conv_id").alias("id"), "turn_id", "sys", F.col("text").alias("usr"))


SQL_CONV = """conv AS (SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_id, sys, text AS usr FROM (
  SELECT *, coalesce(last_value(CASE WHEN role <> 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'none') AS sys
  FROM conversations) WHERE role = 'user')"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return unit(table(spark, sf, "embeddings"), "vec_id", "embedding")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set of all searches: rows whose id is divisible by 50."""
    return vectors(spark, sf).where(F.col("label") % 50 == 0)


SQL_DENSE = """vec AS (SELECT vec_id AS label, label AS cls, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
uvec AS (SELECT label, cls, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM vec),
dense AS (SELECT q.label AS q, d.label AS label, list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS score
  FROM uvec q JOIN uvec d ON q.label <> d.label WHERE q.label % 50 = 0)"""


def sql_bm25(query: str, docs: str) -> str:
    """CTEs up to bm25(q, label, score); ``query`` gives (q, qtext), ``docs`` (label, text)."""
    return f"""qs AS ({query}), ds AS ({docs}),
dt AS (SELECT label, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS toks FROM ds),
st AS (SELECT count(*) AS n, avg(len(toks)::DOUBLE) AS avgdl FROM dt),
tf AS (SELECT label, len(toks) AS dl, tok, count(*) AS f FROM (SELECT label, toks, unnest(toks) AS tok FROM dt) GROUP BY label, toks, tok),
dfr AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
w AS (SELECT tok, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS w FROM dfr, st),
idf AS (SELECT tok, CASE WHEN w < 0 THEN 0.25e0 * (SELECT avg(w) FROM w) ELSE w END AS idf FROM w),
qt AS (SELECT q, tok, count(*) AS qn FROM (SELECT q, unnest(list_filter(string_split_regex(qtext, '\\s+'), lambda t: t <> '')) AS tok FROM qs) GROUP BY q, tok),
bm25 AS (SELECT q, label, sum(qn * idf * f * 2.5e0 / (f + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score FROM qt JOIN idf USING (tok) JOIN tf USING (tok), st GROUP BY q, label)"""
