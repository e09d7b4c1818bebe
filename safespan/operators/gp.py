"""Gaussian-process classification of runs with inducing points (the DTC approximation of Quinonero-Candela and Rasmussen
2005), fitted by sums over all rows.

Under a frame (scale of the features, inducing points, length scales) everything that a fit needs of the rows are sums:
for each length scale K_uf K_fu and K_uf y, and y'y and n. Equal points are put together first; each task then works out
the distances of its points once for all length scales and adds up its part; the parts are added in Spark by length scale
and matrix row, and only these sums, M x M numbers for each length scale (M inducing points, a parameter), reach the
driver. Sums of new rows can be added to those of earlier ones (`added`), so that a model grows without a look at old rows.

Amplitude and length scale are those of the greatest marginal likelihood over all rows, on the frame's grid of lengths and,
in `fit`, on a finer one around the best. With all training points as inducing points, mean and deviation are those of the
exact process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from safespan.scenario import Scenario
from safespan.session import materialize

#: Ranges of the hyperparameters: 0.01 to 100 and 0.001 to 1000.
LENGTHS = (0.01, 0.03, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5, 2.5, 5.0, 10.0, 30.0, 100.0)
AMPLITUDES = (0.001, 1000.0)
NOISE = 0.01
INDUCING = 512
#: Directions of the inducing points' kernel below this share of the greatest are left out: rounding hides what rows say there.
TINY = 1e-7
SUMS = "length int, part long, sums array<double>"


def scaler_fit(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Mean and population deviation of each feature; a deviation of 0 counts as 1."""
    stats = [x for c in features for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    out = df.agg(*stats)
    return out.withColumns({f"{c}_std": F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in features})


def standardize(df: DataFrame, fit: DataFrame, features: tuple[str, ...]) -> DataFrame:
    out = df.join(F.broadcast(fit), F.lit(True))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in features}).drop(*fit.columns)


@dataclass(frozen=True)
class Frame:
    """What sums are relative to: they can be added under one frame only."""

    features: tuple[str, ...]
    mean: np.ndarray
    std: np.ndarray
    inducing: np.ndarray
    lengths: tuple[float, ...] = LENGTHS


@dataclass
class Model:
    features: tuple[str, ...]
    mean: np.ndarray
    std: np.ndarray
    inducing: np.ndarray
    amplitude: float
    length: float
    weights: np.ndarray
    spread: np.ndarray
    evidence: float
    #: How many of the outcomes 0 and 1 the rows have.
    classes: int = 2


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    return np.exp(-0.5 * squares(a, b) / length**2)


def design_frame(scenario: Scenario = Scenario(), inducing: int = INDUCING, lengths: tuple[float, ...] = LENGTHS) -> Frame:
    """A frame that depends on no rows, for models that grow: the scale of the parameter ranges, and the first points of a
    low-discrepancy sequence over them (fractions of multiples of the powers of a root of x**(d + 1) = x + 1)."""
    low, high = (np.array(x, float) for x in zip(*scenario.ranges.values(), strict=True))
    root, d = 1.5, len(low)
    for _ in range(60):
        root = (1 + root) ** (1 / (d + 1))
    unit = (0.5 + np.arange(1, inducing + 1)[:, None] * root ** -np.arange(1.0, d + 1)) % 1
    mean, std = (low + high) / 2, (high - low) / np.sqrt(12)
    return Frame(tuple(scenario.ranges), mean, std, (low + unit * (high - low) - mean) / std, lengths)


def points(df: DataFrame, features: tuple[str, ...], target: str) -> DataFrame:
    """The different points with their numbers of rows, sums of the target and of its square."""
    y = F.col(target).cast("double")
    return df.groupBy(*features).agg(F.count("*").alias("_n"), F.sum(y).alias("_y"), F.sum(y * y).alias("_yy"))


def sums(counted: DataFrame, frame: Frame) -> DataFrame:
    """The sums over `points` under a frame, as a row for each length scale and matrix row; y'y and n are in row M."""
    features, m = frame.features, len(frame.inducing)
    shared = counted.sparkSession.sparkContext.broadcast(frame)  # M points

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        total = np.zeros((len(f.lengths), m + 1, max(m + 1, 2)))
        for batch in batches:
            x = (np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features]).astype(float) - f.mean) / f.std
            n, y, yy = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_n", "_y", "_yy"))
            for lo in range(0, len(x), 2048):
                part = slice(lo, lo + 2048)
                d = -0.5 * squares(f.inducing, x[part])
                for i, length in enumerate(f.lengths):
                    k = np.exp(d / length**2)
                    total[i, :m, :m] += (k * n[part]) @ k.T
                    total[i, :m, m] += k @ y[part]
            total[:, m, :2] += (yy.sum(), n.sum())
        for i in range(len(f.lengths)):
            yield _rows(((i, part), total[i, part]) for part in range(m + 1))

    context = counted.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _add(counted.repartition(tasks).mapInArrow(make, SUMS))  # stored points are few bytes, but much work


def added(*parts: DataFrame) -> DataFrame:
    """The sums of several sets of rows under one frame."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _add(out)


def _add(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys = zip(batch.column("length").to_pylist(), batch.column("part").to_pylist(), strict=True)
            for key, values in zip(keys, batch.column("sums"), strict=True):
                v = np.asarray(values.values)
                total[key] = total[key] + v if key in total else v.copy()
        yield _rows(total.items())

    # a task holds the sums of some matrix rows only, whatever the number of parts they come from
    return parts.repartition(32, "length", "part").mapInArrow(run, SUMS)


def _rows(items) -> pa.RecordBatch:
    keys, values = [], []
    for k, v in items:
        keys.append(k)
        values.append(v)
    width = len(values[0]) if values else 0
    flat = pa.array(np.concatenate(values)) if values else pa.array([], pa.float64())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), flat)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), lists], ["length", "part", "sums"])


def solve(found: DataFrame, frame: Frame) -> Model | None:
    """The model of the greatest likelihood; None without rows. Tasks work out a length scale each, from the M + 1 rows of
    its sums; the best one's matrices reach the driver."""
    shared = found.sparkSession.sparkContext.broadcast(frame)

    def one(table: pa.Table) -> pa.Table:
        f = shared.value
        m = len(f.inducing)
        a = np.zeros((m + 1, max(m + 1, 2)))
        flat = table.column("sums").combine_chunks()
        a[table.column("part").to_numpy()] = np.asarray(flat.flatten()).reshape(len(flat), -1)
        length = f.lengths[table.column("length")[0].as_py()]
        own, axes = np.linalg.eigh(kernel(f.inducing, f.inducing, length))
        kept = own > TINY * own[-1]
        white = axes[:, kept] / np.sqrt(own[kept])
        values, vectors = np.linalg.eigh(white.T @ a[:m, :m] @ white)
        values, w = np.maximum(values, 0), vectors.T @ (white.T @ a[:m, m])
        evidence, c = _amplitude(values, w, a[m, 0], a[m, 1])
        back, shrunk = white @ vectors, 1 / (1 + c * values / NOISE)
        weights, spread = back @ (shrunk * w) / NOISE, (back * (values / NOISE * shrunk)) @ back.T
        columns = [[a[m, 1]], [a[m, 0]], [evidence], [c], [length], [weights.tobytes()], [spread.tobytes()]]
        return pa.table([pa.array(x, t) for x, t in zip(columns, [pa.float64()] * 5 + [pa.binary()] * 2, strict=True)], ["n", "ones", "evidence", "amplitude", "length", "weights", "spread"])

    models = found.groupBy("length").applyInArrow(one, "n double, ones double, evidence double, amplitude double, length double, weights binary, spread binary")
    best = models.where("n > 0").orderBy(F.desc("evidence"), "length").limit(1).collect()
    if not best:
        return None
    r, m = best[0], len(frame.inducing)
    return Model(frame.features, frame.mean, frame.std, frame.inducing, r.amplitude, r.length, np.frombuffer(r.weights), np.frombuffer(r.spread).reshape(m, m), r.evidence, 2 if 0 < r.ones < r.n else 1)


def _amplitude(values: np.ndarray, w: np.ndarray, yy: float, n: float) -> tuple[float, float]:
    """The greatest log marginal likelihood over amplitudes, and the amplitude. In the eigenbasis of the whitened sums each
    amplitude costs M operations."""

    def evidence(c: np.ndarray) -> np.ndarray:
        grown = 1 + c[:, None] * values / NOISE
        fit_ = yy / NOISE - (c[:, None] * w * w / NOISE**2 / grown).sum(1)
        return -0.5 * (fit_ + np.log(grown).sum(1) + n * np.log(2 * np.pi * NOISE))

    low, high = np.log(AMPLITUDES[0]), np.log(AMPLITUDES[1])
    for _ in range(5):
        grid = np.linspace(low, high, 33)
        found = evidence(np.exp(grid))
        i = int(np.argmax(found))
        low, high = grid[max(i - 1, 0)], grid[min(i + 1, 32)]
    return float(found[i]), float(np.exp(grid[i]))


def data_frame(counted: DataFrame, features: tuple[str, ...], inducing: int = INDUCING, lengths: tuple[float, ...] = LENGTHS, spread: bool = False) -> Frame | None:
    """The frame of rows put together by `points`: their mean and deviation, and at most `inducing` of their points, those
    of the least hashes or, with `spread`, the centres of as many groups of near points. None without rows."""
    n = F.sum("_n")
    first = [(F.sum(F.col(c) * F.col("_n")) / n).alias(f"{c}_mean") for c in features]
    row = counted.agg(*first).first()
    if row[f"{features[0]}_mean"] is None:
        return None
    mean = np.array([row[f"{c}_mean"] for c in features])
    wide = counted.agg(*[F.sqrt(F.sum((F.col(c) - float(a)) ** 2 * F.col("_n")) / n).alias(c) for c, a in zip(features, mean, strict=True)]).first()
    std = np.array([wide[c] or 1.0 for c in features])
    chosen = counted.select(*features).orderBy(F.xxhash64(*features), *features).limit(max(1, inducing // 6) if spread else inducing).collect()
    frame = Frame(features, mean, std, (np.array([[p[c] for c in features] for p in chosen], float) - mean) / std, lengths)
    return _spread(counted, frame, inducing) if spread else frame


def _spread(counted: DataFrame, frame: Frame, inducing: int, rounds: int = 5, moves: int = 4) -> Frame:
    """More inducing points in rounds, each drawn by its rows and its squared distance from those there are (Bahmani and
    others 2012; a draw is a race of exponential times from hashes), and then moved to the means of the rows nearest to
    them. A round reads the points once; at most `inducing` rows reach the driver."""
    features = frame.features

    def near(z: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = (np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features]).astype(float) - frame.mean) / frame.std
        parts = [squares(x[lo : lo + 2048], z) for lo in range(0, len(x), 2048)]
        return x, np.concatenate([d.argmin(1) for d in parts]), np.concatenate([d.min(1) for d in parts])

    for r in range(1, rounds + 1):
        z = frame.inducing
        wanted = (inducing - len(z)) // (rounds + 1 - r)

        def race(batches: Iterator[pa.RecordBatch], z: np.ndarray = z) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    _, _, d = near(z, batch)
                    weight = d * batch.column("_n").to_numpy(zero_copy_only=False)
                    time = -np.log(batch.column("_u").to_numpy(zero_copy_only=False)) / np.maximum(weight, 1e-300)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(pa.float64()) for c in features], pa.array(np.where(d > 1e-12, time, np.inf))], [*features, "time"])

        unit = (F.pmod(F.xxhash64(*features, F.lit(r)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        raced = counted.select(*features, "_n", unit.alias("_u")).mapInArrow(race, ", ".join(f"`{c}` double" for c in features) + ", time double")
        got = raced.where(F.col("time") < float("inf")).orderBy("time", *features).limit(wanted).collect()
        new = (np.array([[p[c] for c in features] for p in got], float).reshape(-1, len(features)) - frame.mean) / frame.std
        frame = replace(frame, inducing=np.vstack([z, new]))
    for _ in range(moves):
        z = frame.inducing

        def gather(batches: Iterator[pa.RecordBatch], z: np.ndarray = z) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(z), len(features) + 1))
            for batch in batches:
                if batch.num_rows:
                    x, who, _ = near(z, batch)
                    n = batch.column("_n").to_numpy(zero_copy_only=False).astype(float)
                    for j, v in enumerate([*(x * n[:, None]).T, n]):
                        total[:, j] += np.bincount(who, v, len(z))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(z))), *map(pa.array, total.T.copy())], ["_who", *features, "_n"])

        sums_ = ", ".join(f"`{c}` double" for c in (*features, "_n"))
        rows = counted.select(*features, "_n").mapInArrow(gather, f"_who long, {sums_}").groupBy("_who").agg(*[F.sum(c).alias(c) for c in (*features, "_n")]).where("_n > 0").orderBy("_who").collect()
        frame = replace(frame, inducing=np.array([[r[c] / r["_n"] for c in features] for r in rows]))
    return frame


def fit(df: DataFrame, features: tuple[str, ...], target: str = "y", inducing: int = INDUCING, lengths: tuple[float, ...] = LENGTHS, spread: bool = False) -> Model | None:
    """The model of all rows, by the likelihood of all rows; None without rows. The best of the lengths is followed by a
    second look at lengths around it. spread: see data_frame."""
    counted = materialize(points(df, features, target), "points")
    frame = data_frame(counted, features, inducing, lengths, spread)
    if frame is None:
        return None
    first = solve(sums(counted, frame), frame)
    finer = replace(frame, lengths=tuple(float(np.clip(first.length * s, LENGTHS[0], LENGTHS[-1])) for s in (0.7, 0.84, 1.19, 1.4)))
    second = solve(sums(counted, finer), finer)
    return second if second.evidence > first.evidence else first


def predict(df: DataFrame, model: Model) -> DataFrame:
    """df with mean and std of the latent value."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in ("mean", "std")] + [T.StructField(n, T.DoubleType()) for n in ("mean", "std")])
    shared = df.sparkSession.sparkContext.broadcast(model)  # M x M numbers
    features = model.features

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features]).astype(float)
            k = m.amplitude * kernel((x - m.mean) / m.std, m.inducing, m.length)
            var = np.maximum(m.amplitude - np.einsum("ij,jk,ik->i", k, m.spread, k, optimize=True), 0)
            keep = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("mean", "std")}
            yield pa.RecordBatch.from_arrays([*keep.values(), pa.array(k @ m.weights), pa.array(np.sqrt(var))], [*keep, "mean", "std"])

    return df.mapInArrow(make, schema)
