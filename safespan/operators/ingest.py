"""From raw traces and checker logs to labels and outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from safespan.scenario import ERROR, FORMULAS

VERDICT = r"Model checking result: (True|False)"


def scan_traces(files: DataFrame) -> DataFrame:
    """Evaluation traces among files (path, ...): .json with _eval_sim, no footage; loop_num from the digits after sim."""
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(name.endswith(".json") & name.contains("_eval_sim") & ~name.contains("footage"))
    return kept.withColumn("loop_num", F.regexp_extract("path", r"sim(\d+)", 1).cast("bigint"))


def content_state(content: Column) -> Column:
    """timeout, valid or corrupt."""
    return F.when(F.regexp_replace(content, r"^\s+|\s+$", "") == "TIMEOUT", "timeout").when(F.try_parse_json(content).isNotNull(), "valid").otherwise("corrupt")


def formula_dimension(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(line_no, line) of a formula file with the labels (pos, label) of the same positions; blank lines don't count. A
    formula file is a handful of lines."""
    order = Window.orderBy("line_no")
    used = lines.select("line_no", F.trim("line").alias("formula")).where("formula <> ''").withColumn("pos", F.row_number().over(order) - 1)
    named = used.join(F.broadcast(labels), "pos", "left")
    return named.select("pos", "formula", F.coalesce("label", F.concat(F.lit("formula_"), F.col("pos") + 1)).alias("label"))


def verdicts(logs: DataFrame, formulas: list[tuple[str, str]]) -> DataFrame:
    """A row for each log and formula (label, text): 0 for True, 1 for False, -1 without a verdict behind the formula.
    The next verdict counts even if it belongs to a later formula; verdict_borrowed says so."""
    parts = []
    for pos, (label, text) in enumerate(formulas):
        found = F.regexp_extract("output_log", rf"(?s)\Q{text}\E.*?{VERDICT}", 1)
        between = F.regexp_extract("output_log", rf"(?s)\Q{text}\E(.*?){VERDICT}", 1)
        other = reduce(lambda a, b: a | b, [between.contains(t) for _, t in formulas if t != text], F.lit(False))
        value = F.when(found == "True", 0).when(found == "False", 1).otherwise(ERROR)
        parts.append(F.struct(F.lit(pos).alias("pos"), F.lit(label).alias("label"), value.alias("verdict"), other.alias("verdict_borrowed")))
    return logs.select("loop_num", F.explode(F.array(*parts)).alias("v")).select("loop_num", "v.*")


def pivot_verdicts(long: DataFrame, labels: list[str]) -> DataFrame:
    """One row for each run, a column for each known label."""
    return long.groupBy("loop_num").pivot("label", labels).agg(F.first("verdict"))


def repair(df: DataFrame, ttc: tuple[str, ...] | list[str], collision: str = "c_collision", lift: tuple[int, ...] = (0, -1)) -> DataFrame:
    """A collision violates every TTC label, and a violated threshold all looser ones; only labels in `lift` are raised.
    ttc: tightest first."""
    out, before = {}, F.coalesce(F.col(collision) == 1, F.lit(False))
    for c in ttc:
        hit = before & F.col(c).isin(*lift)
        out[c] = F.when(hit, 1).otherwise(F.col(c))
        before = before | F.coalesce(F.col(c) == 1, F.lit(False))
    return df.withColumns(out)


def outcome_live(labels: tuple[str, ...], stuck: str = "c_npc_stuck") -> Column:
    """Error for a missing verdict or a stuck vehicle, else Unsafe for any violation, else Safe; from unrepaired labels."""
    values = F.array(*[F.coalesce(F.col(c), F.lit(ERROR)) for c in labels])
    rest = F.array(*[F.col(c) for c in labels if c != stuck])
    error = F.array_contains(values, ERROR) | (F.col(stuck) == 1)
    return F.when(error, "Error").when(F.exists(rest, lambda x: x == 1), "Unsafe").otherwise("Safe")


def outcome_restored(labels: tuple[str, ...]) -> Column:
    """Error for any label -1, else Unsafe for any violation (a stuck vehicle included), else Safe."""
    values = F.array(*[F.col(c) for c in labels])
    return F.when(F.exists(values, lambda x: x == ERROR), "Error").when(F.exists(values, lambda x: x == 1), "Unsafe").otherwise("Safe")


def timeout_rows(tasks: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Tasks that ran out of time: all labels -1, and the reason says so."""
    return tasks.withColumns({"reason": F.concat("reason", F.lit(" [ERROR: TIMEOUT]"))} | {c: F.lit(ERROR) for c in labels})


def corrupt_rows(traces: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Traces (with state) whose content can't be read: all labels -1."""
    return traces.where(F.col("state") == "corrupt").withColumns({c: F.lit(ERROR) for c in labels})


def trace_predicates(frames: DataFrame, formulas: tuple = FORMULAS) -> DataFrame:
    """Labels of each run from its frames: `always` must hold in all of them, `eventually` in one; 0 if it holds, 1 if not.
    One pass: the least TTC and distance, the greatest speed and any collision decide all of them."""
    agg = frames.groupBy("loop_num").agg(F.min("ttc").alias("ttc"), F.min("pos_diff").alias("pos_diff"), F.max("npc_speed").alias("npc_speed"), F.bool_or("collision").alias("collision"))
    out = []
    for label, _, _, _, signal, at in formulas:
        holds = ~F.col(signal) if signal == "collision" else F.col(signal) >= at
        out.append(F.when(holds.isNull(), ERROR).when(holds, 0).otherwise(1).alias(label))
    return agg.select("loop_num", *out)

