"""Files at the edge: run datasets, trace folders, formula files, snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from safespan.scenario import Scenario

_THEORY = ("theory_d_total_human", "theory_d_total_ai", "theory_margin_a_human", "theory_margin_a_ai", "theory_margin_b_human", "theory_margin_b_ai")


def dataset_schema(scenario: Scenario = Scenario()) -> T.StructType:
    """The 25 columns in file order: names sorted with dots where labels have them."""
    kinds = {c: T.IntegerType() for c in scenario.labels} | {c: T.DoubleType() for c in (*scenario.features, *_THEORY)}
    kinds |= {"loop_num": T.LongType(), "reason": T.StringType(), "worker_id": T.StringType(), "theory_zone_a": T.StringType(), "theory_zone_b": T.StringType()}
    return T.StructType([T.StructField(c, kinds[c]) for c in sorted(kinds, key=dotted)])


def dotted(name: str) -> str:
    """The name in files: the threshold in a label has a dot."""
    return ".".join(name.rsplit("_", 1)) if name.startswith(("c_ttc_", "c_pos_diff_")) else name


def read_dataset(spark: SparkSession, path: str, scenario: Scenario = Scenario()) -> DataFrame:
    """A run dataset in CSV with header, under its fixed schema: short rows get nulls at the end. No file: no rows."""
    schema = dataset_schema(scenario)
    try:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_dataset(df: DataFrame, path: str, scenario: Scenario = Scenario()) -> None:
    """Append runs in file order and under file names, fractions at four decimals."""
    cols = [F.round(f.name, 4) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in dataset_schema(scenario)]
    names = [dotted(f.name) for f in dataset_schema(scenario)]
    df.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)]).write.mode("append").option("header", True).csv(path)


def _append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def append_labels(df: DataFrame, path: str, scenario: Scenario = Scenario()) -> None:
    """Append run numbers and labels, under file names."""
    _append_csv(df.select("loop_num", *[F.col(c).alias(dotted(c)) for c in scenario.labels]), path)


def read_labels(spark: SparkSession, path: str, scenario: Scenario = Scenario()) -> DataFrame:
    schema = T.StructType([T.StructField("loop_num", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in scenario.labels])
    return spark.read.schema(schema).option("header", True).csv(path)


def append_params(df: DataFrame, path: str, scenario: Scenario = Scenario()) -> None:
    """Append run numbers, parameters at four decimals and the reason, in this order."""
    _append_csv(param_table(df, scenario).withColumns({c: F.format_string("%.4f", c) for c in scenario.features}), path)


def read_params(spark: SparkSession, path: str, scenario: Scenario = Scenario()) -> DataFrame:
    schema = T.StructType([T.StructField("loop_num", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in scenario.features] + [T.StructField("reason", T.StringType())])
    return spark.read.schema(schema).option("header", True).csv(path)


def append_processed(ids: DataFrame, path: str) -> None:
    """Append run numbers to a history, one on a line."""
    ids.select(F.col("loop_num").cast("string").alias("value")).write.mode("append").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def append_errors(errors: DataFrame, path: str) -> None:
    """Append entries of error_detail as text: time, file, header and both logs, with a rule below."""
    stamp = F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss")
    entry = F.concat(F.lit("["), stamp, F.lit("] "), "file", F.lit(" | "), "header", F.lit("\nSTDOUT: "), "output_log", F.lit("\nSTDERR: "), "error_log", F.lit("\n" + "-" * 30))
    errors.select(entry.alias("value")).write.mode("append").text(path)


def label_table(df: DataFrame, scenario: Scenario = Scenario()) -> DataFrame:
    return df.select("loop_num", *scenario.labels)


def param_table(df: DataFrame, scenario: Scenario = Scenario()) -> DataFrame:
    return df.select("loop_num", *[F.round(c, 4).alias(c) for c in scenario.features], "reason")


def error_detail(verdicts: DataFrame, logs: DataFrame, at: Column | None = None, name: str = "uturn") -> DataFrame:
    """One row for each missing verdict, with the run's logs, its trace file and the time (now, unless given)."""
    missing = verdicts.where("verdict = -1").select("loop_num", F.col("label").alias("header")).join(logs, "loop_num")
    file = F.concat(F.lit(f"{name}_eval_sim"), "loop_num", F.lit(".json"))
    return missing.withColumns({"file": file, "logged_at": (F.current_timestamp() if at is None else at).cast("timestamp_ntz")})


def write_snapshot(df: DataFrame, path: str, stamp: str) -> None:
    """A snapshot in place of what was written under its stamp before; the others stay."""
    out = df.withColumn("snapshot", F.lit(stamp)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("snapshot").parquet(path)


def read_snapshot(spark: SparkSession, path: str, stamp: str) -> DataFrame:
    """One snapshot; other partitions aren't read."""
    return spark.read.parquet(path).where(F.col("snapshot") == stamp).drop("snapshot")


@dataclass(frozen=True)
class LiveTable:
    """A table that can be archived under a stamp and then starts empty. Rows are appended to the current generation, which
    the last line of a small table names; archiving writes the generation's rows as a snapshot and then that line. So one
    that was stopped can be repeated, and one that was done changes nothing when it is. One writer at a time."""

    path: str

    def _lines(self, spark: SparkSession) -> list:
        try:
            return spark.read.schema("generation long, stamp string").parquet(f"{self.path}/generations").orderBy("generation").collect()  # one for each archive
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _current(self, spark: SparkSession) -> str:
        return f"{self.path}/runs/generation={len(self._lines(spark))}"

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self._current(df.sparkSession))

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows since the last archive; without any, an empty table of the columns there were."""
        try:
            return spark.read.parquet(self._current(spark))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], spark.read.parquet(f"{self.path}/runs").drop("generation").schema)

    def archive(self, spark: SparkSession, stamp: str) -> None:
        lines = self._lines(spark)
        if any(x.stamp == stamp for x in lines):
            return
        write_snapshot(self.read(spark), f"{self.path}/snapshots", stamp)
        spark.createDataFrame([(len(lines), stamp)], "generation long, stamp string").coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def snapshot(self, spark: SparkSession, stamp: str) -> DataFrame:
        return read_snapshot(spark, f"{self.path}/snapshots", stamp)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """path, content and modified of each file of a folder."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"))


def processed_history(lines: DataFrame) -> DataFrame:
    """Run numbers of a history file; only lines of digits count."""
    return lines.where(F.col("line").rlike(r"^\d+$")).select(F.col("line").cast("bigint").alias("loop_num"))
