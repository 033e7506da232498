"""Weighted fair queueing: mix sources to target weights by virtual finish times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
DEFAULT_WEIGHTS = (3, 1, 2)


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, passes: int) -> DataFrame:
    """``(source, source_size)`` -> ``target``: ``share`` of all sizes by weight, each at most ``passes`` times its
    source's size, the excess dealt again by weight until none is above.

    Solved in closed form: sources fill up in the order of ``passes * size / weight``; the level at which the others
    stop follows from sums over that order.  One row per source, so the table is as small as the list of sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    whole = Window.partitionBy()
    w = sizes.withColumn("_w", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    w = w.withColumn("_cap", F.col("source_size") * F.lit(float(passes))).withColumn("_budget", F.sum("source_size").over(whole) * F.lit(share))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    w = w.withColumn("_rest", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    w = w.withColumn("_level", F.col("_left") / F.col("_rest"))
    # the first source that does not fill up sets the level of all that follow it
    level = F.min_by("_level", F.col("_cap") / F.col("_w")).alias("_stop")
    stop = w.where(F.col("_cap") > F.col("_level") * F.col("_w")).agg(level)
    return w.select("source", "source_size", F.least("_cap", F.coalesce(stop.scalar() * F.col("_w"), F.col("_cap"))).alias("target"))


def fair_queue(docs: DataFrame, *, weights: tuple[int, ...] = DEFAULT_WEIGHTS, share: float = 1.5, passes: int = 2, seed: int = 7, buckets: int = 256, bins: int = 4096, key: str = "doc_id", text: str = "text", source: str = "source", size: F.Column | None = None, order: tuple[str, ...] | None = None) -> DataFrame:
    """One row per row of ``docs`` with what the mix takes of it.

    Documents of a source are shuffled by a seeded hash of ``order`` (key and text by default); the n-th word served has virtual time ``n / target``, and a
    document's finish time is that of its last word (one for each of ``passes`` repeats).  The merged queue is
    ordered globally by finish time in equal-width bins and cut where its running sum of words passes the budget;
    the document across the cut is taken when at least half of it fits.  Whole documents only.

    Running sums never put a source into one task: hash order is cut into ``buckets`` ranges per source, finish time
    into ``bins`` ranges, and tables of ``sources x buckets`` and of ``bins`` sums give each range's start.
    Result: ``doc_id, size, source, source_size, target, taken`` (words, repeats counted) and ``first_finish``.
    Null texts and keys are rows of size 0 and key null; size 0 is never taken.  Null source is a source (last).
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), (word_count(text) if size is None else size).alias("size"), F.xxhash64(F.lit(seed), *map(F.col, order or (key, text))).alias("_h"))
    rows = rows.withColumn("_bucket", F.floor((F.shiftright("_h", 40) + F.lit(1 << 23)) * F.lit(buckets / float(1 << 24))).cast("int"))
    parts = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_s"))
    sizes = parts.groupBy("source").agg(F.sum("_s").alias("source_size"))
    targets = source_targets(sizes, weights, share, passes)
    run = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "_bucket", F.coalesce(F.sum("_s").over(run), F.lit(0)).alias("_before"))
    plan = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["source"].alias("_src"), F.col("_bucket").alias("_b"), "_before", "source_size", "target")
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    queue = rows.withColumn("_run", F.sum("size").over(inside))
    queue = queue.join(plan, queue["source"].eqNullSafe(plan["_src"]) & (queue["_bucket"] == plan["_b"]))
    end = F.col("_before") + F.col("_run")
    queue = queue.select("doc_id", "size", "source", "source_size", "target", "_h", end.alias("_end"))
    return _cut(queue, passes, bins)


def _finish(p: int) -> F.Column:
    return (F.col("_end") + F.lit(p) * F.col("source_size")) / F.col("target")


def _cut(queue: DataFrame, passes: int, bins: int) -> DataFrame:
    """Truncate the merged queue at the total budget.  All sources end near virtual time 1, so bins of time
    ``1 / bins`` hold even shares; only the one bin that the cut falls into is sorted row by row."""
    served = F.array(*[F.struct(F.lit(p).alias("p"), F.when((F.col("target") > 0) & (F.col("size") > 0), _finish(p)).alias("f")) for p in range(passes)])
    turns = queue.select("doc_id", "_h", "size", "source", F.explode(served).alias("_t")).where(F.col("_t.f").isNotNull())
    turns = turns.select("doc_id", "_h", "size", "source", F.col("_t.p").alias("p"), F.col("_t.f").alias("f"))
    turns = turns.withColumn("_bin", F.least(F.floor(F.col("f") * bins), F.lit(2 * bins)).cast("long"))
    sums = turns.groupBy("_bin").agg(F.sum("size").alias("_words"))
    upto = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    budget = queue.groupBy("source").agg(F.max("target").alias("_t")).agg(F.sum("_t").alias("_budget"))
    edge = sums.withColumn("_upto", F.sum("_words").over(upto)).withColumn("_budget", budget.scalar())
    over = edge.where(F.col("_upto") > F.col("_budget"))
    edge_bin = over.agg(F.min(F.struct("_bin", (F.col("_budget") - (F.col("_upto") - F.col("_words"))).alias("_room"))).alias("_edge"))
    last = turns.withColumn("_edge", edge_bin.scalar()).where(F.col("_bin") == F.col("_edge._bin"))
    order = Window.partitionBy("_bin").orderBy("f", F.col("source").asc_nulls_last(), "_h", F.col("doc_id").asc_nulls_first(), "p").rowsBetween(Window.unboundedPreceding, 0)
    # the finish time of the last turn in that bin that the budget still takes
    fits = F.sum("size").over(order) - F.col("size") / 2 <= F.col("_edge._room")
    cut = last.withColumn("_fits", fits).agg(F.max(F.when(F.col("_fits"), F.col("f"))).alias("_cut"), F.min("_bin").alias("_edge2"))
    cut = cut.select(F.when(F.col("_edge2").isNull(), F.lit(float("inf"))).otherwise(F.coalesce("_cut", F.col("_edge2") / F.lit(float(bins)) - F.lit(1e-15))).alias("_cut"))
    turns_taken = sum((F.when(_finish(p) <= F.col("_cut"), 1).otherwise(0) for p in range(passes)), F.lit(0))
    times = F.when((F.col("target") > 0) & (F.col("size") > 0), turns_taken).otherwise(F.lit(0))
    out = queue.withColumn("_cut", cut.scalar())
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), times.cast("int").alias("times"), F.when(F.col("target") > 0, _finish(0)).alias("first_finish"))


def op7_weighted_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return fair_queue(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "times")
