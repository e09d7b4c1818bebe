"""Designs and candidates over the parameter ranges. All draws are functions of ids, so any slice gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from safespan.scenario import Scenario

#: Degree, coefficients and first direction numbers of the second and third dimension (Joe and Kuo 2008); fixed values.
SOBOL = ((1, 0, (1,)), (2, 1, (1, 3)))
BITS = 52


def directions(dimensions: int = 3) -> list[list[int]]:
    """Direction numbers of each dimension as integers of BITS bits."""
    out = [[1 << (BITS - 1 - i) for i in range(BITS)]]
    for s, a, m in SOBOL[: dimensions - 1]:
        v = [x << (BITS - 1 - i) for i, x in enumerate(m)]
        for i in range(s, BITS):
            x = v[i - s] ^ (v[i - s] >> s)
            for k in range(1, s):
                x ^= ((a >> (s - 1 - k)) & 1) * v[i - k]
            v.append(x)
        out.append(v)
    return out


def sobol_unit(index: Column, numbers: list[int], shift: int, bits: int = BITS) -> Column:
    """The index-th number in [0, 1) for indices below 2**bits: direction numbers of the set bits of the index's Gray code,
    XORed together and with a digital shift. The numbers of each byte of the code are looked up together."""
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    out = F.lit(shift).cast("bigint")
    for low in range(0, bits, 8):
        table = [0]
        for v in numbers[low : min(low + 8, bits)]:
            table += [x ^ v for x in table]
        out = out.bitwiseXOR(F.get(F.expr(f"array({', '.join(f'{x}L' for x in table)})"), F.shiftright(gray, low).bitwiseAND(len(table) - 1).cast("int")))
    return out / float(1 << BITS)


def shifts(seed: int, dimensions: int = 3) -> list[int]:
    """A digital shift of BITS bits for each dimension."""
    x, out = seed, []
    for _ in range(dimensions):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x >> (64 - BITS))
    return out


def scale(unit: Column, low: float, high: float) -> Column:
    return F.lit(low) + unit * (high - low)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def sobol_design(ids: DataFrame, index: str = "idx", seed: int = 42, scenario: Scenario = Scenario()) -> DataFrame:
    """ids with the parameters of the design's idx-th point."""
    for (c, (low, high)), numbers, shift in zip(scenario.ranges.items(), directions(), shifts(seed), strict=True):
        ids = ids.withColumn(c, F.round(scale(sobol_unit(F.col(index), numbers, shift), low, high), 6))
    return ids


def hash_unit(*keys: Column | int) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    h = F.xxhash64(*[F.lit(k) if isinstance(k, int) else k for k in keys])
    return (F.pmod(h, F.lit(1 << 40)) + 0.5) / float(1 << 40)


def uniform_candidates(ids: DataFrame, index: str = "cand_id", seed: int = 1, scenario: Scenario = Scenario()) -> DataFrame:
    return ids.withColumns({c: scale(hash_unit(F.col(index), seed, i), *r) for i, (c, r) in enumerate(scenario.ranges.items())})


def focus_candidates(ids: DataFrame, points: list[tuple], total: int, index: str = "cand_id", seed: int = 1, scenario: Scenario = Scenario()) -> DataFrame:
    """The first total div n ids of each point are normal around it (standard deviation noise * range, missing coordinate
    mid-range), clipped to the ranges; the remainder is uniform."""
    n = len(points)
    each = total // n
    out = {}
    which = F.floor(F.col(index) / each).cast("int")
    for i, (c, (low, high)) in enumerate(scenario.ranges.items()):
        centers = F.array(*[F.lit(float(p[i]) if p[i] is not None else (low + high) / 2) for p in points])
        u, v = hash_unit(F.col(index), seed, i, 1), hash_unit(F.col(index), seed, i, 2)
        normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
        near = F.get(centers, which) + normal * (scenario.focus_noise * (high - low))
        out[c] = F.when(which < n, clip(near, low, high)).otherwise(scale(u, low, high))
    return ids.withColumns(out)


def focus_plan(points: DataFrame, repeats: int = 20, scenario: Scenario = Scenario()) -> DataFrame:
    """Each focus point `repeats` times in a row, with the decision index it has; missing coordinate: half the sum of the
    range's ends."""
    n = points.agg(F.count("*").alias("n"))
    rows = points.join(F.broadcast(n), F.lit(True)).select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    middle = {c: F.coalesce(c, F.lit((low + high) / 2)) for c, (low, high) in scenario.ranges.items()}
    reason = F.concat(F.lit("[FOCUS] Exact Point "), F.col("point") + 1, F.lit("/"), F.col("n"), F.lit(" (Repeat "), F.col("repeat"), F.lit(f"/{repeats})"))
    return rows.withColumns(middle | {"idx": F.col("point") * repeats + F.col("repeat") - 1, "reason": reason}).drop("n")


def parse_points(spark: SparkSession, text: str, scenario: Scenario = Scenario()) -> tuple[tuple[float | None, ...], ...]:
    """Focus points from JSON, a list of objects with a number for each parameter; a parameter that is missing or null is
    None, for the middle of its range. Anything else is an error."""
    kind = "array<struct<" + ", ".join(f"{c}: double" for c in scenario.ranges) + ">>"
    row = spark.range(1).select(F.from_json(F.lit(text), kind, {"mode": "FAILFAST"}).alias("points"))
    try:
        found = row.first().points
    except Exception as e:
        raise ValueError(f"focus points are not a JSON list of objects: {text[:100]}") from e
    if not found or any(p is None for p in found):
        raise ValueError("focus points are an empty list or have empty entries")
    return tuple(tuple(p) for p in found)


def ids(spark: SparkSession, n: int, name: str) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", name)
