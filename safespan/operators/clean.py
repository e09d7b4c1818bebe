"""Cleaning, derived labels and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from safespan.functions.decimals import rounded
from safespan.operators.ingest import repair
from safespan.scenario import ERROR, Scenario
from safespan.session import materialize


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def metrics(df: DataFrame) -> list[str]:
    """Label columns by name."""
    return [c for c in df.columns if c.startswith(("c_", "formula_"))]


def drop_errors(df: DataFrame) -> DataFrame:
    """Without rows that have a label -1; nulls stay."""
    return df.where(_all([F.coalesce(F.col(c), F.lit(0)) != ERROR for c in metrics(df)]))


def drop_stuck(df: DataFrame) -> DataFrame:
    return df.where(_all([F.coalesce(F.col(c), F.lit(0)) != 1 for c in df.columns if "stuck" in c]))


def drop_missing(df: DataFrame, target: str, features: tuple[str, ...]) -> DataFrame:
    return df.dropna(subset=["loop_num", target, *features])


def keep_binary(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isin(0, 1))


def repair_train(df: DataFrame, ttc: tuple[str, ...]) -> DataFrame:
    """The repair after rows with -1 are gone: it only lifts 0."""
    return repair(df, ttc, lift=(0,))


def class_guard(df: DataFrame, target: str) -> DataFrame:
    """One row: rows, classes (of labels 0 and 1) and whether there is enough to train on."""
    classes = [F.coalesce(F.bool_or(F.col(target) == x), F.lit(False)).cast("long") for x in (0, 1)]
    stats = df.agg(F.count("*").alias("n_rows"), (classes[0] + classes[1]).alias("n_classes"))
    return stats.withColumn("trainable", (F.col("n_rows") >= 2) & (F.col("n_classes") >= 2))


def trainable(df: DataFrame, target: str, scenario: Scenario = Scenario()) -> DataFrame:
    """loop_num, features and target of the rows a model may learn from, however few."""
    clean = repair_train(drop_stuck(drop_errors(df)), scenario.ttc)
    return keep_binary(drop_missing(clean, target, scenario.features), target).select("loop_num", *scenario.features, F.col(target).alias("y"))


def training_set(df: DataFrame, target: str, scenario: Scenario = Scenario()) -> DataFrame:
    """The rows of `trainable`; none if they can't be trained on."""
    clean = materialize(trainable(df, target, scenario), "training")  # read twice below
    guard = class_guard(clean, "y").where("trainable").select(F.lit(1).alias("ok"))
    return clean.join(F.broadcast(guard), F.lit(True)).drop("ok")


def plot_clean(df: DataFrame, scenario: Scenario = Scenario()) -> DataFrame:
    """Rows whose plotted labels are all 0 or 1."""
    return df.where(_all([F.col(c).isin(0, 1) for c in ("c_collision", *scenario.plotted_ttc) if c in df.columns]))


def zone_clean(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["dx0", "npc_speed", "ego_speed", "theory_zone_a", "theory_zone_b"])


def severity(df: DataFrame, scenario: Scenario = Scenario()) -> Column:
    """5 for a collision, 4 to 1 by the tightest violated plotted threshold, 0 for safe; absent columns count as 0."""
    ladder = [(c, s) for c, s in zip(("c_collision", *scenario.plotted_ttc), range(5, 0, -1), strict=True) if c in df.columns]
    return reduce(lambda out, x: F.when(F.col(x[0]) == 1, x[1]).otherwise(out), reversed(ladder), F.lit(0))


SEVERITIES = ((0, "Safe"), (1, "TTC < 1.1s"), (2, "TTC < 0.9s"), (3, "TTC < 0.5s"), (4, "TTC < 0.3s"), (5, "Collision"))
ZONES = (("A", "Zone A: Both Safe"), ("B", "Zone B: AI Safe, Human Danger"), ("C", "Zone C: Both Danger"), ("D", "Zone D: Human Safe, AI Danger (Rare)"))


def severity_label(df: DataFrame) -> DataFrame:
    names = df.sparkSession.createDataFrame(list(SEVERITIES), "severity int, severity_name string")
    return df.join(F.broadcast(names), "severity", "left")


def zone_label(df: DataFrame) -> DataFrame:
    names = df.sparkSession.createDataFrame(list(ZONES), "zone string, zone_name string")
    return df.join(F.broadcast(names), "zone", "left")


def worker_normal(worker: Column) -> Column:
    """The id as text without a trailing .0."""
    return F.regexp_replace(worker.cast("string"), r"\.0$", "")


def worker_label(worker: Column) -> Column:
    return F.when(worker == "21", "Node 21 (Host)").when(worker.isin("22", "23"), F.concat(F.lit("Node "), worker, F.lit(" (Container)"))).otherwise(F.concat(F.lit("Node "), worker))


def worker_stamp(worker: Column) -> Column:
    return F.coalesce(worker, F.lit("master"))


def execution_class(worker: Column) -> Column:
    """host, container, or null for other workers."""
    return F.when(worker == "21", "host").when(worker.isin("22", "23"), "container")


def metric_label(metric: Column) -> Column:
    """A display name: without the leading c_, words capitalised."""
    return F.initcap(F.replace(F.regexp_replace(metric, "^c_", ""), F.lit("_"), F.lit(" ")))


def unpivot_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.unpivot(keys, metrics(df), "metric", "value")


def format_values(df: DataFrame) -> DataFrame:
    """Fractions at four decimals."""
    return df.withColumns({c: rounded(c) if t == "double" else F.round(c, 4) for c, t in df.dtypes if t in ("double", "float")})


def executed_params(df: DataFrame, features: tuple[str, ...] = Scenario().features) -> DataFrame:
    """The two-decimal values a run was started with, and how far they are from the stored ones."""
    out = df.withColumns({f"{c}_executed": F.round(c, 2) for c in features})
    return out.withColumns({f"{c}_drift": F.abs(F.col(c) - F.col(f"{c}_executed")) for c in features})


def speed_band_offset(ego: Column) -> Column:
    return F.when(ego < 32.5, 38).when(ego < 37.5, 17).otherwise(4)
