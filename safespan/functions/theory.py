"""Stopping-distance model, margins and zones as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from safespan.scenario import PROFILES

FEATURES = ("dx0", "ego_speed", "npc_speed")
NUMBERS = ("d_total_human", "d_total_ai", "margin_a_human", "margin_a_ai", "margin_b_human", "margin_b_ai")


def meters_per_second(kmh: Column | str) -> Column:
    return (F.col(kmh) if isinstance(kmh, str) else kmh) / 3.6


def _build_up(jerk: Column) -> Column:
    return F.when(jerk <= 0, F.lit(1e-5)).otherwise(jerk)


def early_stop(v0: Column, jerk: Column, a: Column) -> Column:
    """Seconds of braking to a stop if it builds up until then; NaN for a vehicle that can't brake."""
    return F.when(a <= 0, F.lit(float("nan"))).otherwise(F.sqrt(2 * v0 * _build_up(jerk) / a))


def stopping(v0: Column, delay: Column, jerk: Column, a: Column, early: Column | None = None) -> tuple[Column, Column]:
    """Distance and time to a stop: free running, then braking that builds up over `jerk` seconds, then full braking. A
    vehicle that can't brake needs both without end; one that stops while braking builds up has no full braking. early: the
    column of early_stop, where there is one."""
    tj = _build_up(jerk)
    v1 = v0 - a * tj / 2
    ts = F.sqrt(2 * v0 * tj / a) if early is None else early
    endless = F.lit(float("inf"))
    distance = F.when(a <= 0, endless).when(v1 < 0, v0 * delay + (v0 * ts - (a / tj) * ts * ts * ts / 6)).otherwise(v0 * delay + (v0 * tj - a * tj * tj / 6) + v1 * v1 / (2 * a))
    time = F.when(a <= 0, endless).when(v1 < 0, delay + ts).otherwise(delay + tj + v1 / a)
    return distance, time


def zone(human: Column, ai: Column) -> Column:
    """A: both safe; B: only ai; C: none; D: the rest, NaN margins included."""
    odd = F.isnan(human) | F.isnan(ai)
    return F.when(human.isNull() | ai.isNull(), None).when(odd, "D").when((human >= 0) & (ai >= 0), "A").when((human < 0) & (ai >= 0), "B").when((human < 0) & (ai < 0), "C").otherwise("D")


def margin_wall(dx0: Column, distance: Column) -> Column:
    return dx0 - distance


def margin_moving(dx0: Column, npc_speed: Column, distance: Column, time: Column) -> Column:
    return dx0 + meters_per_second(npc_speed) * time - distance


def with_margins(df: DataFrame, profiles: tuple = PROFILES, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """df with d_*, t_* and unrounded margin_a_*, margin_b_* for the human and the ai profile.

    What is used more than once is a column of its own: it is worked out once, and the code that Spark makes of a step stays
    short. Java runs methods of more than 8,000 bytes without compiling them, several times slower."""
    dx0, ego_speed, npc_speed = features
    df, v0 = df.withColumn("_v0", meters_per_second(ego_speed)), F.col("_v0")
    df = df.withColumns({f"_early_{name}": early_stop(v0, F.lit(jerk), F.lit(a)) for name, (*_, jerk, a) in zip(("human", "ai"), profiles, strict=True)})
    for name, (_, *values) in zip(("human", "ai"), profiles, strict=True):
        d, t = stopping(v0, *map(F.lit, values), early=F.col(f"_early_{name}"))
        df = df.withColumns({f"d_{name}": d, f"t_{name}": t})
        df = df.withColumns({
            f"margin_a_{name}": margin_wall(F.col(dx0), F.col(f"d_{name}")),
            f"margin_b_{name}": margin_moving(F.col(dx0), F.col(npc_speed), F.col(f"d_{name}"), F.col(f"t_{name}")),
        })
    return df.drop("_v0", "_early_human", "_early_ai")


def enrich(df: DataFrame, profiles: tuple = PROFILES) -> DataFrame:
    """df with the eight theory_* columns; null where a parameter is null. Zones come from unrounded margins. Nulls
    are taken out before and put back behind, as code for numbers that may be null is several times as long."""
    filled = tuple(f"_{c}" for c in FEATURES)
    full = df.withColumns({f: F.coalesce(c, F.lit(0.0)) for f, c in zip(filled, FEATURES, strict=True)} | {"_given": F.expr(" AND ".join(f"{c} IS NOT NULL" for c in FEATURES))})
    full, given = with_margins(full, profiles, filled), F.col("_given")
    source = {"theory_d_total_human": "d_human", "theory_d_total_ai": "d_ai"} | {f"theory_{m}": m for m in NUMBERS[2:]}
    out = {k: F.when(given, F.round(v, 4)) for k, v in source.items()}
    out |= {f"theory_zone_{x}": F.when(given, zone(F.col(f"margin_{x}_human"), F.col(f"margin_{x}_ai"))) for x in "ab"}
    return full.withColumns(out).select(*df.columns, *out)
