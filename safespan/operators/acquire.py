"""Picks among scored candidates (draw_id, cand_id, features, mean, std): one decision for each draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from safespan.operators.design import hash_unit, sobol_design
from safespan.operators.sequence import boundary_shift, packed_history, stability_streak
from safespan.scenario import FOCUS_POINTS, Scenario

_ROW = ("cand_id", "dx0", "ego_speed", "npc_speed", "mean", "std")


def _row() -> Column:
    return F.struct(*_ROW)


def _best(score: Column, when: Column | None = None) -> Column:
    """The row of the greatest score; of equal ones that of the least id."""
    key = F.struct(score, -F.col("cand_id"))
    return F.max_by(_row(), F.when(when, key) if when is not None else key)


def pick_max_uncertainty(scored: DataFrame) -> DataFrame:
    return scored.groupBy("draw_id").agg(_best(F.col("std")).alias("p")).select("draw_id", "p.*")


def pick_boundary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("draw_id").agg(_best(-F.abs(F.col("mean") - 0.5)).alias("p")).select("draw_id", "p.*")


def safe_candidates(scored: DataFrame) -> DataFrame:
    return scored.where("mean <= 0.5")


def safe_uncertainty(scored: DataFrame, limit: float = 0.05) -> DataFrame:
    """Per draw the greatest std among candidates predicted safe, and whether that is small enough to be done."""
    out = scored.groupBy("draw_id").agg(F.max(F.when(F.col("mean") <= 0.5, F.col("std"))).alias("max_std"))
    return out.withColumn("complete", F.coalesce(F.col("max_std") < limit, F.lit(False)))


def pick_safe_cleanup(scored: DataFrame) -> DataFrame:
    """The most uncertain candidate predicted safe; without any, the most uncertain one, as a backup."""
    safe = F.col("mean") <= 0.5
    out = scored.groupBy("draw_id").agg(_best(F.col("std"), safe).alias("s"), _best(F.col("std")).alias("b"))
    return out.select("draw_id", F.coalesce("s", "b").alias("p"), F.when(F.col("s").isNull(), "STEP3: Backup Search").otherwise("STEP3: Safe Area Cleanup").alias("reason")).select("draw_id", "p.*", "reason")


def next_batch(scored: DataFrame, phase: str, first_idx: int, scenario: Scenario = Scenario(), dice: Column | None = None) -> DataFrame:
    """A decision of one phase for each draw, in order of draw_id from first_idx on, as `decide` makes it with a model and
    violations at hand. dice: a function of draw_id."""
    idx = (F.lit(first_idx) + F.col("draw_id")).cast("long")
    known = {"idx": idx, "violations": F.lit(1), "trained": F.lit(True), "phase": F.lit(phase), "_dice": hash_unit(F.col("draw_id"), 11) if dice is None else dice}
    out = _decided(_picks(scored, None).withColumns(known), "explore", FOCUS_POINTS, scenario)
    return out.select((F.col("idx") - first_idx).cast(scored.schema["draw_id"].dataType).alias("draw_id"), *out.columns)


def refill_batch(scored: DataFrame, outstanding: int, target: int = 15) -> DataFrame:
    """As many boundary picks as are missing from the queue, one for each draw, in order of draws."""
    return pick_boundary(scored.where(F.col("draw_id") < target - outstanding))


def boundary_stability(states: DataFrame, scenario: Scenario = Scenario()) -> DataFrame:
    return stability_streak(boundary_shift(packed_history(states, scenario.history, scenario.hysteresis)), scenario.shift, scenario.streak)


def decide(decisions: DataFrame, scored: DataFrame, mode: str = "explore", points: tuple = FOCUS_POINTS, scenario: Scenario = Scenario(), dice: Column | None = None, luck: Column | None = None) -> DataFrame:
    """The whole decision for each row of decisions (idx, draw_id, violations, trained, phase), phase being that of
    phase_timeline under the mode: idx, parameters, reason and system_command.

    In focus mode the first decisions repeat the focus points and STEP1 searches their neighbourhood (a random candidate of
    the draw); else STEP1 takes the design's point. Without violations, a model or candidates the design's point stands in.
    STEP2 explores or follows the boundary, STEP3 cleans up the safe area or stops; both stop at the last index. Reasons of
    STEP3 have the greatest deviation in the safe area, or the mean at the backup point. scored
    (draw_id, candidates, mean, std) are the candidates of each draw. dice (below 0.3: explore) and luck (the candidate of
    the least is the random one) are drawn from ids unless given."""
    dice = hash_unit(F.col("idx"), 11) if dice is None else dice
    rows = decisions.select("idx", "draw_id", "violations", "trained", "phase", dice.alias("_dice"))
    return _decided(rows.join(_picks(scored, luck), "draw_id", "left"), mode, points, scenario)


def _picks(scored: DataFrame, luck: Column | None) -> DataFrame:
    """For each draw its most uncertain candidate (u), the one nearest the boundary (b), the most uncertain safe one (s) and a
    random one (r)."""
    safe = F.col("mean") <= 0.5
    luck = hash_unit(F.col("cand_id"), 12) if luck is None else luck
    return scored.groupBy("draw_id").agg(
        _best(F.col("std")).alias("u"), _best(-F.abs(F.col("mean") - 0.5)).alias("b"), _best(F.col("std"), safe).alias("s"),
        F.max(F.when(safe, F.col("std"))).alias("safe_std"), F.min_by(_row(), F.struct(luck, "cand_id")).alias("r"),
    )


def _decided(rows: DataFrame, mode: str, points: tuple, scenario: Scenario) -> DataFrame:
    """The decision of each row, which has its picks and its dice."""
    focus, names = mode == "focus", tuple(scenario.ranges)
    rows = sobol_design(rows, scenario=scenario)
    design_point = F.struct(*names)

    def point(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(*[F.col(f"{name}.{c}").alias(c) for c in names]))

    repeats, n = scenario.focus_repeats, len(points)
    nth = F.floor(F.col("idx") / repeats).cast("int")
    middle = [(low + high) / 2 for low, high in scenario.ranges.values()]
    exact = F.get(F.array(*[F.struct(*[F.lit(float(m if v is None else v)).alias(c) for c, v, m in zip(names, p, middle, strict=True)]) for p in points]), nth)
    exact_reason = F.concat(F.lit("[FOCUS] Exact Point "), nth + 1, F.lit(f"/{n} (Repeat "), F.col("idx") % repeats + 1, F.lit(f"/{repeats})"))
    is_exact = (F.col("idx") < n * repeats) if focus else F.lit(False)
    first = F.col("phase") == "STEP1"
    no_violation = (F.col("violations") == 0) & F.lit(mode == "margin")
    no_model = ~F.col("trained") | F.col("u").isNull()
    third, explore = F.col("phase") == "STEP3", F.col("_dice") < 0.3
    found = F.concat(F.lit("(V:"), "violations", F.lit(")"))
    mark = "[FOCUS] " if focus else ""
    neighbour = point("r") if focus else design_point
    cases = (
        (is_exact, exact, exact_reason),
        (first, F.coalesce(neighbour, design_point), F.concat(F.lit("STEP1: Focus Neighborhood Search " if focus else "STEP1: Global Search "), found)),
        (no_violation, design_point, F.lit("STEP3 Fallback: Global Search (No Violations)")),
        (no_model, design_point, F.lit("Fallback (Error)")),
        (third & F.col("s").isNotNull(), point("s"), F.format_string(f"{mark}STEP3: Safe Area Cleanup (σ=%.4f)", "safe_std")),
        (third, point("u"), F.format_string(f"{mark}STEP3: Backup Search (M:%.2f)", F.col("u.mean"))),
        (explore, point("u"), F.lit(f"{mark}STEP2: Exploration (Max σ)")),
        (F.lit(True), point("b"), F.lit(f"{mark}STEP2: Boundary 0.5")),
    )
    pick, reason = (F.coalesce(*[F.when(c[0], c[i]) for c in cases]) for i in (1, 2))
    modelled = ~(is_exact | first | no_violation | no_model)
    stop = F.when(modelled & third & (F.col("safe_std") < scenario.uncertainty), "Safe Area Verification Complete").when(modelled & (F.col("idx") >= scenario.max_samples), "Max Samples Reached")
    out = rows.select("idx", pick.alias("p"), reason.alias("why"), stop.alias("stop"))
    values = [F.when(F.col("stop").isNull(), F.col(f"p.{c}")).alias(c) for c in names]
    return out.select("idx", *values, F.coalesce("stop", "why").alias("reason"), F.when(F.col("stop").isNotNull(), "stop").alias("system_command"))
