"""Joins of parameters, results and traces by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from safespan.operators.ranges import PART, dealt
from safespan.scenario import ERROR


def last_params(params: DataFrame) -> DataFrame:
    """The last sent row of each run."""
    best = params.groupBy("loop_num").agg(F.max_by(F.struct(*[c for c in params.columns if c != "loop_num"]), F.struct("ts", "seq")).alias("_p"))
    return best.select("loop_num", "_p.*")


def merge_results(params: DataFrame, results: DataFrame) -> DataFrame:
    """Parameters with their first result (of several at one time the one with the least labels), joined by run; parameter values win on shared names."""
    labels = [c for c in results.columns if c not in params.columns]
    first = results.groupBy("loop_num").agg(F.min_by(F.struct(*labels), F.struct("ts", *labels)).alias("_r"))
    return last_params(params).join(first, "loop_num").select(*[c for c in params.columns if c != "seq"], "_r.*")


def orphan_results(params: DataFrame, results: DataFrame) -> DataFrame:
    return results.join(params.select("loop_num"), "loop_num", "left_anti")


def stale_params(params: DataFrame, results: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Parameters no result came for, older than `seconds` at `now`."""
    waiting = last_params(params).join(results.select("loop_num"), "loop_num", "left_anti")
    return waiting.withColumn("age", F.unix_timestamp(now) - F.unix_timestamp("ts")).where(F.col("age") > seconds)


def timeout_flush(params: DataFrame, results: DataFrame, labels: list[str]) -> DataFrame:
    """Every run's last parameters with the labels of its first result, -1 where no result came."""
    first = results.groupBy("loop_num").agg(F.min_by(F.struct(*labels), F.struct("ts", *labels)).alias("_r"))
    out = last_params(params).join(first, "loop_num", "left").select("*", "_r.*").withColumn("_came", F.col("_r").isNotNull()).drop("_r")
    late = ~F.col("_came")
    reason = F.when(late, F.concat("reason", F.lit(" [ERROR: TIMEOUT]"))).otherwise(F.col("reason"))
    return out.withColumns({c: F.when(late, ERROR).otherwise(F.col(c)) for c in labels} | {"reason": reason}).drop("_came", "seq")


def new_traces(traces: DataFrame, processed: DataFrame) -> DataFrame:
    return traces.join(processed.select("loop_num"), "loop_num", "left_anti")


def processed_union(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("loop_num")
    for p in parts[1:]:
        out = out.union(p.select("loop_num"))
    return out.distinct()


def new_ids(scanned: DataFrame, processed: DataFrame) -> DataFrame:
    return scanned.select("loop_num").subtract(processed.select("loop_num"))


def dispatch_ids(tasks: DataFrame, start: int, order: str = "enqueue_seq", partitions: int | None = None) -> DataFrame:
    """tasks with global_loop_num = start + place in the queue. The rows are dealt by range of the order, numbered within
    each range, and moved up by the sizes of the ranges before: no task sees the whole queue."""
    ranges = dealt(tasks, order, partitions)
    sizes = ranges.groupBy(PART).count()
    before = sizes.select(PART, (F.sum("count").over(Window.orderBy(PART)) - F.col("count")).alias("_before"))  # a row for each range
    numbered = ranges.withColumn("_place", F.row_number().over(Window.partitionBy(PART).orderBy(order)))
    out = numbered.join(F.broadcast(before), PART)
    return out.withColumn("global_loop_num", F.lit(start) + F.col("_before") + F.col("_place")).drop(PART, "_before", "_place")
