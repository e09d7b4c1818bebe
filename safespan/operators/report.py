"""Reports over a run dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from safespan.functions.theory import stopping
from safespan.operators.clean import execution_class, metrics, severity, severity_label, worker_label, worker_normal
from safespan.operators.ranges import PART, dealt
from safespan.scenario import Scenario


def resume_point(df: DataFrame, column: str = "loop_num") -> DataFrame:
    """The greatest run number; rows that aren't numbers are skipped; 0 without any."""
    return df.agg(F.coalesce(F.max(F.col(column).try_cast("bigint")), F.lit(0)).alias("resume_at"))


def outcome_totals(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    counts = [F.count_if(F.col(outcome) == o).alias(f"n_{o.lower()}") for o in ("Safe", "Unsafe", "Error")]
    return df.agg(*counts, F.count("*").alias("n_total"))


def violation_count(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.count_if(F.col(target) == 1).alias("n_violations"))


def best_target(df: DataFrame, priorities: tuple[str, ...]) -> DataFrame:
    """The first label by priority that shows both a 0 and a 1; null if none does. One pass."""
    both = df.agg(*[(F.coalesce(F.bool_or(F.col(c) == 0), F.lit(False)) & F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))).alias(c) for c in priorities])
    return both.select(F.coalesce(*[F.when(F.col(c), F.lit(c)) for c in priorities]).alias("target"))


def worker_violation_rate(df: DataFrame) -> DataFrame:
    """Per worker and metric: percent of violations among labels 0 and 1, and the worker's number of rows."""
    names = metrics(df)
    base = df.where(F.col("worker_id").isNotNull()).withColumn("worker", worker_normal(F.col("worker_id")))
    rates = []
    for c in names:
        valid = F.count_if(F.col(c).isin(0, 1))
        rates.append(F.when(valid > 0, F.round(100 * F.count_if(F.col(c) == 1) / valid, 6)).otherwise(0.0).alias(c))
    wide = base.groupBy("worker").agg(F.count("*").alias("n_rows"), *rates)
    return wide.unpivot(["worker", "n_rows"], names, "metric", "violation_percent").withColumn("label", worker_label(F.col("worker")))


def severity_distribution(df: DataFrame, scenario: Scenario = Scenario()) -> DataFrame:
    return severity_label(df.select(severity(df, scenario).alias("severity")).groupBy("severity").agg(F.count("*").alias("n_runs")))


def severity_by_execution(df: DataFrame, scenario: Scenario = Scenario()) -> DataFrame:
    worker = worker_normal(F.col("worker_id"))
    split = df.select(execution_class(worker).alias("execution"), severity(df, scenario).alias("severity")).where("execution is not null")
    return split.groupBy("execution", "severity").agg(F.count("*").alias("n_runs"))


def zone_distribution(df: DataFrame) -> DataFrame:
    """Runs by zone under both approaches; both are counted in one pass."""
    long = df.select(F.explode(F.array(F.struct(F.lit("A").alias("approach"), F.col("theory_zone_a").alias("zone")), F.struct(F.lit("B").alias("approach"), F.col("theory_zone_b").alias("zone")))).alias("z"))
    return long.select("z.*").groupBy("approach", "zone").agg(F.count("*").alias("n_runs"))


def speed_extent(df: DataFrame) -> DataFrame:
    """Least and greatest speeds; an axis of one value is widened by 10."""
    out = df.agg(*[f(c).alias(f"{c}_{n}") for c in ("ego_speed", "npc_speed") for n, f in (("min", F.min), ("max", F.max))])
    return out.withColumns({f"{c}_max": F.when(F.col(f"{c}_min") == F.col(f"{c}_max"), F.col(f"{c}_max") + 10).otherwise(F.col(f"{c}_max")) for c in ("ego_speed", "npc_speed")})


def boundary_surface(extent: DataFrame, profiles: DataFrame, nodes: int = 30) -> DataFrame:
    """Stopping distances on a nodes x nodes mesh over the extents: ego speed along i, npc speed along j."""
    mesh = extent.select("*", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("j"))
    for k, c in (("i", "ego_speed"), ("j", "npc_speed")):
        mesh = mesh.withColumn(c, F.col(f"{c}_min") + (F.col(f"{c}_max") - F.col(f"{c}_min")) * F.col(k) / (nodes - 1))
    both = mesh.join(F.broadcast(profiles), F.lit(True))
    d, _ = stopping(F.col("ego_speed") / 3.6, F.col("t_delay"), F.col("t_jerk"), F.col("a_max"))
    return both.select("i", "j", "profile", F.round("ego_speed", 6).alias("ego_speed"), F.round("npc_speed", 6).alias("npc_speed"), F.round(d, 4).alias("distance"))


def theory_vs_observed(df: DataFrame, approach: str = "a", scenario: Scenario = Scenario()) -> DataFrame:
    """Runs by theoretical zone and observed severity, with the two kinds of mismatch: in a zone where all is safe, but
    collided; in a zone with danger, but nothing violated."""
    zone = F.col(f"theory_zone_{approach}")
    counted = df.select(zone.alias("zone"), severity(df, scenario).alias("severity")).groupBy("zone", "severity").agg(F.count("*").alias("n_runs"))
    mismatch = F.when((F.col("zone") == "A") & (F.col("severity") == 5), "safe zone, collided").when((F.col("zone") != "A") & (F.col("severity") == 0), "danger zone, no violation")
    return counted.withColumn("mismatch", mismatch)


def worker_latest_status(status: DataFrame) -> DataFrame:
    return status.groupBy("worker_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))


def status_line(latest: DataFrame) -> DataFrame:
    """All workers in one line; a campaign has few workers."""
    parts = F.array_sort(F.collect_list(F.concat(F.lit("["), F.col("worker_id"), F.lit("] "), F.col("status"))))
    return latest.agg(F.array_join(parts, " | ").alias("summary"))


def campaign_progress(finished: DataFrame, queued: DataFrame, target: int, start: DataFrame | None = None) -> DataFrame:
    """Completed and waiting runs. A resumed campaign counts on from the resume point, `start` (one row, resume_at)."""
    done = finished.agg(F.count("*").alias("n_completed"))
    if start is not None:
        done = done.join(F.broadcast(start), F.lit(True)).select((F.col("n_completed") + F.col("resume_at")).alias("n_completed"))
    waiting = queued.agg(F.count("*").alias("n_queued"))
    return done.join(F.broadcast(waiting), F.lit(True)).withColumn("target_reached", F.col("n_completed") >= target)


def worker_list(df: DataFrame) -> DataFrame:
    return df.where("worker_id is not null").select(worker_normal(F.col("worker_id")).alias("worker")).distinct()


def final_report(df: DataFrame, priorities: tuple[str, ...], reason: str) -> DataFrame:
    return resume_point(df).join(F.broadcast(best_target(df, priorities)), F.lit(True)).withColumn("reason", F.lit(reason))


def running_totals(df: DataFrame, key: str = "loop_num", outcome: str = "outcome") -> DataFrame:
    """Totals after each run, in order of key. Ranges of the key are summed first, so that each window covers one range and
    starts from the totals of the ranges before."""
    names = ("Safe", "Unsafe", "Error")
    ranges = dealt(df.select(key, *[(F.col(outcome) == o).cast("long").alias(o) for o in names]), key)
    sums = ranges.groupBy(PART).agg(*[F.sum(o).alias(o) for o in names])
    w = Window.orderBy(PART)  # a row for each range
    before = sums.select(PART, *[(F.sum(o).over(w) - F.col(o)).alias(f"_{o}") for o in names])
    run = Window.partitionBy(PART).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.join(F.broadcast(before), PART)
    return out.select(key, *[(F.sum(o).over(run) + F.col(f"_{o}")).alias(f"n_{o.lower()}") for o in names])
