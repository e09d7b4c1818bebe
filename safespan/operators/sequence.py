"""Ordered histories: TTC cascade, stability, phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from safespan.scenario import Scenario
from safespan.session import materialize


def ttc_cascade(long: DataFrame) -> DataFrame:
    """(loop_num, threshold, label): each label raised to the greatest of itself and all tighter thresholds of the run. Where a
    run number occurs twice, lower labels come first, so that reruns agree."""
    w = Window.partitionBy("loop_num").orderBy("threshold", "label").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("label", F.max("label").over(w))


def hysteresis_state(mean: Column, low: float = 0.40, high: float = 0.60) -> Column:
    return F.when(mean < low, 0).when(mean > high, 1).otherwise(-1)


def stability_history(states: DataFrame, length: int = 50, hysteresis: tuple[float, float] = (0.40, 0.60)) -> DataFrame:
    """(iter, point_id, mean) with the state and that of length - 1 iterations before; null before there are that many."""
    w = Window.partitionBy("point_id").orderBy("iter")
    return states.withColumn("state", hysteresis_state(F.col("mean"), *hysteresis)).withColumn("old_state", F.lag("state", length - 1).over(w))


def packed_history(states: DataFrame, length: int = 50, hysteresis: tuple[float, float] = (0.40, 0.60)) -> DataFrame:
    """(iter, point_id, state, old_state) of stability_history, for many points and whole-numbered iterations.

    The states of a point in 32 iterations are packed into words, a bit each, before anything is shuffled, and old states
    are words moved by length - 1 bits. That counts iterations, not rows: points that miss some between their first and last
    or have one twice go through stability_history."""
    names = ("iter", "point_id", "state", "old_state")
    if length < 1:
        return stability_history(states, length, hysteresis).select(*names)
    state = hysteresis_state(F.col("mean"), *hysteresis)
    rows = states.select("point_id", state.alias("state"), F.expr("shiftright(cast(iter as long), 5)").alias("word"), F.expr("shiftleft(1L, cast(iter & 31 as int))").alias("bit"))
    words = rows.groupBy("point_id", "word").agg(F.count("*").alias("n"), F.bit_or("bit").alias("given"), *[F.bit_or(F.when(F.col("state") == x, F.col("bit")).otherwise(0)).alias(f"is_{x}") for x in (0, 1)])
    lowest = F.expr("given & -given")
    words = words.withColumn("first", F.col("word") * 32 + F.bit_count(lowest - 1))
    # a word without gaps: its lowest bit, added, leaves none of its bits
    words = words.withColumn("full", F.coalesce((F.col("n") == F.bit_count("given")) & ((F.col("given") + lowest).bitwiseAND(F.col("given")) == 0), F.lit(False)))
    point = Window.partitionBy("point_id")
    dense = F.min("full").over(point) & (F.sum("n").over(point) == F.max(F.col("first") + F.col("n")).over(point) - F.min("first").over(point))
    steps, bits = divmod(length - 1, 32)

    def moved(name: str) -> Column:
        near, far = (F.lag(name, n).over(point.orderBy("word")) if n else F.col(name) for n in (steps, steps + 1))
        low = F.shiftleft(F.coalesce(near, F.lit(0)), bits).bitwiseOR(F.shiftright(F.coalesce(far, F.lit(0)), 32 - bits))
        return low.bitwiseAND(F.lit((1 << 32) - 1)).alias(f"old_{name}")

    masks = ("given", "is_0", "is_1")
    table = materialize(words.select("point_id", "word", *masks, *map(moved, masks), dense.alias("dense")), "words")

    def at(old: str) -> Column:
        has = {m: F.expr(f"shiftright({old}{m}, k) & 1 = 1") for m in masks}
        return F.when(has["given"], F.when(has["is_0"], 0).when(has["is_1"], 1).otherwise(-1))

    each = table.where("dense").withColumn("k", F.explode(F.array(*map(F.lit, range(32))))).where("shiftright(given, k) & 1 = 1")
    found = each.select((F.col("word") * 32 + F.col("k")).cast(states.schema["iter"].dataType).alias("iter"), "point_id", at("").alias("state"), at("old_").alias("old_state"))
    odd = table.where("not dense")
    if odd.isEmpty():
        return found
    rest = states.join(odd.select(F.col("point_id").alias("_odd")).distinct(), F.col("point_id").eqNullSafe(F.col("_odd")), "left_semi")
    return found.unionByName(stability_history(rest, length, hysteresis).select(*names))


def boundary_shift(history: DataFrame) -> DataFrame:
    """Per iteration with a full history: share of points that went from 0 to 1 or back; -1 never counts as a flip."""
    flip = ((F.col("state") == 0) & (F.col("old_state") == 1)) | ((F.col("state") == 1) & (F.col("old_state") == 0))
    return history.where("old_state is not null").groupBy("iter").agg((F.count_if(flip) / F.count("*")).alias("shift_rate"))


def stability_streak(shifts: DataFrame, limit: float = 0.01, needed: int = 3) -> DataFrame:
    """(iter, shift_rate) with the number of iterations in a row below the limit, and whether they suffice. One row for each
    decision, so one ordered window."""
    order = Window.orderBy("iter")
    marked = shifts.withColumn("calm", F.col("shift_rate") < limit).withColumn("island", F.sum((~F.col("calm")).cast("int")).over(order))
    streak = F.sum(F.col("calm").cast("int")).over(Window.partitionBy("island").orderBy("iter"))
    return marked.withColumn("streak", streak.cast("int")).withColumn("stable", F.col("streak") >= needed).select("iter", "shift_rate", "streak", "stable")


def phase_timeline(decisions: DataFrame, scenario: Scenario = Scenario(), mode: str = "explore") -> DataFrame:
    """(idx, violations, trained, stable) with the phase each decision is taken in. STEP1 while idx is below the limit or
    nothing was violated; STEP2 once a model exists, else a Sobol fallback; STEP3 from the decision where stability holds
    in STEP2 or STEP2 has had its share. In margin mode all is STEP3 from the start, with a fallback as long as nothing was
    violated or no model exists."""
    if mode == "margin":
        return decisions.select("idx", F.when((F.col("violations") == 0) | ~F.col("trained"), "FALLBACK").otherwise("STEP3").alias("phase"))
    starts = (F.col("idx") >= scenario.first_phase) & (F.col("violations") > 0) & F.col("trained")
    start = decisions.agg(F.min(F.when(starts, F.col("idx"))).alias("start"))
    second = decisions.join(F.broadcast(start), F.col("idx") >= F.col("start"))
    calm = second.agg(F.min(F.when(F.col("stable"), F.col("idx"))).alias("calm"))
    # the decision after STEP2's share, from a fixed number of least indices
    share = second.select("idx").orderBy("idx").limit(scenario.second_phase + 1).agg(F.when(F.count("*") > scenario.second_phase, F.max("idx")).alias("share"))
    marks = start.crossJoin(calm).crossJoin(share)  # one row
    step = decisions.crossJoin(F.broadcast(marks)).withColumn("started", F.col("idx") >= F.col("start")).withColumn("done", F.col("idx") >= F.least("calm", "share"))
    early = (F.col("idx") < scenario.first_phase) | (F.col("violations") == 0)
    phase = F.when(F.col("done"), "STEP3").when(F.col("started"), "STEP2").when(early, "STEP1").otherwise("FALLBACK")
    return step.select("idx", phase.alias("phase"))


def next_phases(decisions: DataFrame, start: int | None, seen: int, done: bool, scenario: Scenario = Scenario(), mode: str = "explore") -> DataFrame:
    """One batch of decisions with the phases that phase_timeline gives them behind all earlier ones. Of those it is enough to
    know: start, the index of the first decision past STEP1 (None before); seen, how many there were from it on; done,
    whether STEP3 has begun. One row for each decision of the batch, so ordered windows."""
    if mode == "margin":
        return decisions.join(phase_timeline(decisions, scenario, mode), "idx")
    if done:
        return decisions.withColumn("phase", F.lit("STEP3"))
    order = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.col("idx") >= scenario.first_phase) & (F.col("violations") > 0) & F.col("trained")
    begun = F.lit(True) if start is not None else F.max(starts.cast("int")).over(order) == 1
    step = decisions.withColumn("_begun", begun)
    place = F.lit(seen) + F.sum(F.col("_begun").cast("int")).over(order)
    step = step.withColumn("_ends", F.col("_begun") & (F.col("stable") | (place > scenario.second_phase)))
    third = F.max(F.col("_ends").cast("int")).over(order) == 1
    early = (F.col("idx") < scenario.first_phase) | (F.col("violations") == 0)
    phase = F.when(third, "STEP3").when(F.col("_begun"), "STEP2").when(early, "STEP1").otherwise("FALLBACK")
    return step.withColumn("phase", phase).drop("_begun", "_ends")
