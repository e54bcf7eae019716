"""Mixing sources to target weights, with DataFrame functions alone.

1. Every source's target comes from its weight, capped at a multiple of its own size (water filling).
2. A fixed number of blocks is shared out among the sources in proportion to their targets, and a splitting tree cuts
   these quotas exactly among the output shards: at each node the blocks, in an order drawn for that node, go half to
   the left and half to the right, so each side's counts per source are multivariate hypergeometric.
3. A source's documents stand in a permuted order, repeated as often as the target asks; its blocks are disjoint runs
   of that order. Which run a copy is in depends on its own permutation number and one boundary a source, so documents
   with their texts are never shuffled or sorted for it; the last, partial pass ends before the target
   and takes one later document, whose size is nearest to what then lacks.
4. Copies get an order number within their shard, by which a writer shuffles each shard locally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

#: Bits of a permutation number, and of the bucket that its highest bits name.
PERM, BUCKET = 52, 12


def n_words(text: str = "text") -> Column:
    """How many runs of characters other than U+0020 and U+0009-U+000D a text has; 0 if it is null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _number(*parts: Column | str) -> Column:
    """A 52-bit number drawn from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Add rank and target to a row a source (source, source_size).

    Sources by code point, null last, take the weights in turn. All sizes together are shared by weight; a target stops
    at ``cap`` times the source's size and the excess is shared anew. In ascending order of cap over weight, a source is
    capped while its cap is at most its share of what the capped ones before it leave; the first other one sets the
    level for all that follow. A row a source in one task.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy("ratio", "rank")
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumn("rank", F.row_number().over(w))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + F.when(F.col("rank") % len(weights) == 0, len(weights)).otherwise(0)).cast("double"))
    s = s.withColumn("top", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("weight"))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    return s.withColumn("target", F.when(F.col("ratio") > F.col("level"), F.col("weight") * F.col("level")).otherwise(F.col("top"))).select("source", "rank", "source_size", "target")


def quotas(targeted: DataFrame, blocks: int) -> DataFrame:
    """Add quota: ``blocks`` shared in proportion to the targets, the remainders largest first."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    exact = F.coalesce(F.col("target") * blocks / F.nullif(F.sum("target").over(everything), F.lit(0.0)), F.lit(0.0))
    q = targeted.withColumn("exact", exact).withColumn("quota", F.floor("exact").cast("long"))
    q = q.withColumn("place", F.row_number().over(Window.orderBy((F.col("quota") - F.col("exact")).asc(), "rank")))
    more = F.when(F.col("place") <= blocks - F.sum("quota").over(everything), 1).otherwise(0)
    return q.withColumn("quota", F.when(F.col("target") > 0, F.col("quota") + more).otherwise(0).cast("long")).drop("exact", "place")


def splitting_tree(quoted: DataFrame, levels: int, seed: int) -> DataFrame:
    """rank, block, shard for each block of each quota: ``levels`` halvings of the blocks, each by a fresh order."""
    b = quoted.where("quota > 0").select("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("block"), F.lit(0).cast("long").alias("shard"))
    for level in range(levels):
        node = Window.partitionBy("shard")
        b = b.withColumn("draw", _number(F.lit(f"split{seed}"), F.lit(str(level)), F.col("rank").cast("string"), F.col("block").cast("string")))
        place = F.row_number().over(node.orderBy("draw", "rank", "block"))
        b = b.withColumn("right", (2 * place > F.count("*").over(node)).cast("long"))
        b = b.select("rank", "block", (2 * F.col("shard") + F.col("right")).alias("shard"))
    return b


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, shards: int = 16, blocks_per_shard: int = 64, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of ``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_shards``.

    ``mix_shards`` (array of long) has the shard of each copy that the mix takes; it is empty for a row that it leaves
    out and never longer than the cap. Null texts have size 0; null sources are one source, the last; rows that repeat id
    and text are taken alike; an empty table gives no rows. Columns of ``docs`` with the four names are replaced.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_shards")
    size, perm = n_words(text_col), _number(F.lit(f"perm{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    rows = written(docs.select(F.col(source_col).alias("source"), size.alias("size"), perm.alias("perm")), "mix-rows")
    cells = written(rows.groupBy("source", F.shiftright("perm", PERM - BUCKET).alias("bucket")).agg(F.sum("size").alias("size")), "mix-cells")
    sources = cells.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(quotas(targets(sources, weights, cap), shards * blocks_per_shard), "mix-plan")
    plan = plan.withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long"))
    plan = plan.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))

    # the bucket in which the last, partial pass ends, then the document in it
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ends = cells.withColumn("before", before).alias("c").join(plan.alias("p"), F.expr("c.source <=> p.source")).where("c.before < p.left and c.before + c.size >= p.left")
    ends = written(ends.select("p.source", "c.bucket", "c.before", "p.left"), "mix-ends")
    inside = rows.alias("r").join(ends.alias("e"), F.expr(f"r.source <=> e.source and shiftright(r.perm, {PERM - BUCKET}) = e.bucket")).select("r.source", "r.perm", "r.size", "e.before", "e.left")
    run = inside.groupBy("source", "perm", "before", "left").agg(F.sum("size").alias("size"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("perm").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")) + F.col("before")
    run = run.withColumn("words", ahead + F.col("size")).where("words <= left").groupBy("source").agg(F.max("perm").alias("last"), F.max("words").alias("words"))
    # all buckets before that one are in, and nothing of it if its first document is already too much
    first = F.shiftleft(F.col("e.bucket").cast("long"), PERM - BUCKET) - 1
    last = ends.alias("e").join(run.alias("r"), F.expr("e.source <=> r.source"), "left").select("e.source", F.coalesce("r.last", first).alias("last"), (F.col("e.left") - F.coalesce("r.words", "e.before")).alias("lack"))
    last = written(last, "mix-last")  # of known size, so that a hot source's rows needn't meet in one task
    # of the documents after the run, the one whose size is nearest to what lacks comes too, if that brings the sum nearer
    after = rows.alias("r").join(last.alias("l"), F.expr("r.source <=> l.source")).where("r.perm > l.last").groupBy("r.source", "r.perm", "l.lack").agg(F.sum("r.size").alias("size"))
    one = after.where("abs(size - lack) < lack").groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("lack")), "perm"))["perm"].alias("one"))
    last = last.alias("l").join(one.alias("o"), F.expr("l.source <=> o.source"), "left").select("l.source", "l.last", F.coalesce("o.one", F.lit(-1).cast("long")).alias("one"))
    none = F.lit(-1).cast("long")
    plan = plan.alias("p").join(last.alias("l"), F.expr("p.source <=> l.source"), "left").select("p.*", F.coalesce("l.last", none).alias("last"), F.coalesce("l.one", none).alias("one"))
    leaves = splitting_tree(plan, shards.bit_length() - 1, seed)
    by_source = leaves.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("block", "shard"))).alias("leaves"))  # blocks are bounded: shards * blocks_per_shard
    plan = plan.join(by_source, "rank", "left").select("source", "source_size", "target", "whole", "last", "one", "quota", F.transform("leaves", lambda x: x["shard"]).alias("leaves"))
    plan = written(plan, "mix-decisions")

    s, p = fresh(docs, "_size"), fresh(docs, "_perm")
    d = docs.withColumns({s: size, p: perm}).alias("d").join(plan.alias("p"), F.expr(f"d.{source_col} <=> p.source"))
    unit = float(1 << PERM)
    length = F.col("p.whole") + (F.col("p.last") + 1) / F.lit(unit)
    copies = F.col("p.whole") + (F.col(f"d.{p}") <= F.greatest("p.last", F.when(F.col(f"d.{p}") == F.col("p.one"), F.col("p.one")))).cast("long")

    def shard(c: Column) -> Column:
        block = F.least(F.floor((c + F.col(f"d.{p}") / F.lit(unit)) / length * F.col("p.quota")).cast("int"), F.col("p.quota").cast("int") - 1)
        return F.when(F.col("p.quota") > 0, F.element_at("p.leaves", F.when(F.col("p.quota") > 0, block + 1).otherwise(1))).otherwise(F.col(f"d.{p}") % shards)

    taken = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), shard)).otherwise(F.array().cast("array<bigint>"))
    return d.select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col(f"d.{s}").alias("mix_size"), F.col("p.source_size").alias("mix_source_size"), F.col("p.target").alias("mix_target"), taken.alias("mix_shards"))


def mixed(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` once a copy taken, with ``mix_shard`` and ``mix_order`` (its place within the
    shard's local shuffle; ties are possible, and in any order). Null texts have a size of 0; null sources are one source;
    very long texts count whole; repeated rows are documents of their own; an empty table gives no rows; other columns stay."""
    planned = mix(docs, seed=seed, **options)
    kept = [c for c in docs.columns if c not in ("mix_shard", "mix_order", "mix_size", "mix_source_size", "mix_target", "mix_shards")]
    id_col = options.get("id_col", "doc_id")
    copy = fresh(planned, "_copy")
    copies = planned.select(*(F.col(f"`{c}`") for c in kept), F.posexplode("mix_shards").alias(copy, "mix_shard"))
    order = _number(F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(copy).cast("string"))
    return copies.withColumn("mix_order", order).drop(copy)
