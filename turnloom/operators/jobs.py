"""What surrounds a run of the model, as plans over whole tables: examples for the prompt, replayed predictions, runs scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.state import evaluated


def demonstrations(queries: DataFrame, retrieved: DataFrame, fixed: list[tuple[int, int]], k: int) -> DataFrame:
    """q, label, place of the at most ``k`` examples of each prompt, worst first.

    ``queries``: q, dialogue; ``retrieved``: q, label, dialogue, rk (1 is the best); ``fixed``: label and dialogue of the
    configured examples that every prompt begins with. Examples of a query's own dialogue go. Where more than ``k`` stay,
    the last ones do, so retrieved ones before fixed ones; with ``k`` or more fixed ones nothing is retrieved.
    """
    # counted from the end of the prompt: the best retrieved example, ..., the worst, the last fixed one, ...
    own = retrieved.join(queries.select("q", F.col("dialogue").alias("_own")), "q").where(~F.col("dialogue").eqNullSafe(F.col("_own")))
    ends = own.select("q", "label", F.col("rk").cast("long").alias("_at")).where(F.lit(len(fixed) < k))
    if fixed:
        listed = F.array(*(F.struct(F.lit(x).cast("long").alias("label"), F.lit(d).cast("long").alias("_d"), F.lit((1 << 40) - i).alias("_at")) for i, (x, d) in enumerate(fixed)))
        always = queries.select("q", "dialogue", F.inline(listed))
        ends = ends.unionByName(always.where(~F.col("dialogue").eqNullSafe(F.col("_d"))).select("q", "label", "_at"))
    last = ends.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy("_at", "label"))).where(F.col("_n") <= k)
    return last.select("q", "label", F.row_number().over(Window.partitionBy("q").orderBy(F.col("_n").desc())).alias("place"))


def replay(log: DataFrame, cached: DataFrame) -> DataFrame:
    """``log`` (id, turn_id, pred, ...) with the prediction of ``cached`` (id, turn_id, pred) where there is one, and
    ``replayed``, whether it is. A cached turn that the log lacks is nothing; of
    repeated ones the one of the greatest JSON counts."""
    c = cached.where("pred is not null").groupBy("id", "turn_id").agg(F.max_by("pred", F.to_json("pred")).alias("_pred"))
    both = log.join(c, ["id", "turn_id"], "left")
    return both.withColumn("replayed", F.col("_pred").isNotNull()).withColumn("pred", F.coalesce("_pred", "pred")).drop("_pred")


def score_runs(configs: DataFrame, logs: DataFrame, gold: DataFrame, n_slots: int, table: str | None = None, turn: int = -1) -> DataFrame:
    """A row a configuration (path): status, grp, split, jga, slot_acc, joint_f1, n_total.

    A configuration without a log is ``missing``; one whose ``logs`` (path, id, turn_id, pred) hold a turn that ``gold``
    (id, turn_id, gold) lacks, or a turn twice, is an ``error``; else it is ``scored`` over the turns that its log has, or
    those of the number ``turn`` if that isn't negative. ``table``: only paths that contain it.
    """
    configs = configs.select("path").distinct()
    if table:
        configs = configs.where(F.col("path").contains(table))
    logs = logs.join(configs, "path", "left_semi").groupBy("path", "id", "turn_id").agg(F.first("pred").alias("pred"), F.count("*").alias("_times"))
    each = logs.join(gold.select("id", "turn_id", "gold"), ["id", "turn_id"], "left")
    each = each.withColumn("_m", evaluated(F.col("gold"), F.col("pred"), n_slots))
    counted = F.col("gold").isNotNull() & (F.lit(turn < 0) | (F.col("turn_id") == turn))
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(counted, c)), F.lit(0.0)), 6)
    sums = each.groupBy("path").agg(F.max((F.col("_times") > 1) | F.col("gold").isNull()).alias("_bad"), mean(F.col("_m.jga")).alias("jga"), mean(F.col("_m.acc")).alias("slot_acc"), mean(F.col("_m.f1")).alias("joint_f1"), F.count(F.when(counted, 1)).alias("n_total"))
    r = configs.join(sums, "path", "left")
    status = F.when(F.col("_bad").isNull(), "missing").when(F.col("_bad"), "error").otherwise("scored")
    only = lambda c: F.when(status == "scored", F.col(c)).alias(c)
    group = F.regexp_replace("path", "/[^/]*$", "")
    return r.select("path", status.alias("status"), group.alias("grp"), F.substring_index("path", "/", -1).alias("split"), only("jga"), only("slot_acc"), only("joint_f1"), only("n_total"))


def asserted_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``; an action on it fails if a row's ``keys`` occur twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated: "), F.to_json(F.struct(*keys)))).cast("boolean")).otherwise(True)).drop("_n")


def training_rows(pairs: DataFrame, texts: str, width: int, label: str = "label") -> DataFrame:
    """sentence_0 to sentence_{width - 1} of an array of texts, and the label unless it is 0 or null in every row."""
    columns = [F.get(texts, F.lit(i)).alias(f"sentence_{i}") for i in range(width)]
    told = not pairs.where(F.col(label) != 0).isEmpty()
    return pairs.select(*columns, *([F.col(label).alias("label")] if told else []))


def masked_mean(vectors: Column | str, mask: Column | str) -> Column:
    """The mean of an array of equally long vectors over those whose mask is 1 (zeros if none is)."""
    v, m = (F.col(c) if isinstance(c, str) else c for c in (vectors, mask))
    weighted = F.zip_with(v, m, lambda x, k: F.transform(x, lambda y: y.cast("double") * k))
    total = F.aggregate(F.slice(weighted, 2, F.greatest(F.size(weighted), F.lit(1))), F.get(weighted, F.lit(0)), lambda a, x: F.zip_with(a, x, lambda y, z: y + z))
    n = F.aggregate(m, F.lit(0.0), lambda a, k: a + k)
    return F.transform(total, lambda y: y / F.greatest(n, F.lit(1e-9)))


def remembered(both: DataFrame) -> DataFrame:
    """q, and what takes its candidates' scores (s: cosines, b: BM25) to z-scores: a row a query."""
    s01 = (F.col("s") + 1) / 2
    return both.groupBy("q").agg(F.avg(s01).alias("s_less"), F.stddev_pop(s01).alias("s_by"), F.avg("b").alias("b_less"), F.stddev_pop("b").alias("b_by"))


def standardized_by(new: DataFrame, parameters: DataFrame) -> DataFrame:
    """q, label, zs, zb of new candidates (q, label, s, b) by the ``remembered`` parameters, not by their own. Without
    parameters of its query, or with equal scores there, a candidate gets 0."""

    def z(x: Column, side: str) -> Column:
        return F.when(F.col(f"{side}_by") > 1e-12, (x - F.col(f"{side}_less")) / F.col(f"{side}_by")).otherwise(0.0)

    return new.join(parameters, "q", "left").select("q", "label", z((F.col("s") + 1) / 2, "s").alias("zs"), z(F.col("b"), "b").alias("zb"))
