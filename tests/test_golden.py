"""Hand-made cases for the rules that data alone rarely reaches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from safespan.functions import theory
from safespan.operators import acquire, clean, design, gp, ingest, merge, report, sequence
from safespan.scenario import FOCUS_POINTS, Scenario, focus_points
from safespan.sources import files

S = Scenario()
RUN = "loop_num long, dx0 double, ego_speed double, npc_speed double"


def one(df):
    return df.collect()[0]


def test_stopping_branches(spark):
    rows = [(1, 10.0, 0.75, 0.6, 7.58), (2, 1.0, 0.75, 0.6, 7.58), (3, 10.0, 0.5, 0.5, 0.0), (4, 10.0, 0.5, 0.0, 5.0), (5, 10.0, 0.5, 1e-5, 5.0)]
    d, t = theory.stopping(F.col("v0"), F.col("td"), F.col("tj"), F.col("a"))
    got = {r.n: (r.d, r.t) for r in spark.createDataFrame(rows, "n int, v0 double, td double, tj double, a double").select("n", d.alias("d"), t.alias("t")).collect()}
    v1 = 10 - 7.58 * 0.3
    assert got[1] == pytest.approx((7.5 + 6 - 7.58 * 0.36 / 6 + v1 * v1 / 15.16, 1.35 + v1 / 7.58))
    assert got[2][1] == pytest.approx(0.75 + math.sqrt(2 * 0.6 / 7.58))
    assert got[3] == (math.inf, math.inf)
    assert got[4] == got[5]


def test_zones(spark):
    nan, rows = float("nan"), [(1.0, 1.0), (-1.0, 0.0), (-1.0, -1.0), (1.0, -1.0), (float("nan"), 1.0), (0.0, 0.0)]
    got = [r.z for r in spark.createDataFrame(rows, "h double, a double").select(theory.zone(F.col("h"), F.col("a")).alias("z")).collect()]
    assert got == ["A", "B", "C", "D", "D", "A"] and nan != nan


def test_theory_needs_all_parameters(spark):
    df = spark.createDataFrame([(1, None, 36.0, 15.0), (2, 15.0, 36.0, 15.0)], RUN)
    a, b = sorted(theory.enrich(df).collect(), key=lambda r: r.loop_num)
    assert a.theory_zone_a is None and a.theory_d_total_ai is None and b.theory_zone_a in "ABCD"


def test_endless_stop_is_zone_d(spark):
    df = spark.createDataFrame([(1, 15.0, 36.0, 15.0)], RUN)
    r = one(theory.enrich(df, (("human", 0.7, 0.6, 0.0), ("ai_aeb", 0.1, 0.1, 8.33))))
    assert r.theory_zone_a == "B" and r.theory_zone_b == "D"


def labels(spark, **given):
    row = {c: 0 for c in S.labels} | given
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} int" for c in row))


def test_repairs(spark):
    r = one(ingest.repair(labels(spark, c_ttc_0_3=1, c_ttc_0_5=-1), S.ttc))
    assert all(r[c] == 1 for c in S.ttc)
    r = one(ingest.repair(labels(spark, c_collision=1), S.ttc))
    assert all(r[c] == 1 for c in S.ttc)
    r = one(clean.repair_train(labels(spark, c_ttc_0_5=1, c_ttc_0_9=-1), S.ttc))
    assert (r.c_ttc_0_3, r.c_ttc_0_7, r.c_ttc_0_9, r.c_ttc_1_5) == (0, 1, -1, 1)
    again = ingest.repair(ingest.repair(labels(spark, c_ttc_0_7=1), S.ttc), S.ttc)
    assert one(again) == one(ingest.repair(labels(spark, c_ttc_0_7=1), S.ttc))


@pytest.mark.parametrize(("given", "live", "restored"), [({}, "Safe", "Safe"), ({"c_npc_stuck": 1}, "Error", "Unsafe"), ({"c_ttc_0_9": 1}, "Unsafe", "Unsafe"), ({"c_ttc_0_9": -1, "c_collision": 1}, "Error", "Error")])
def test_outcomes(spark, given, live, restored):
    r = one(labels(spark, **given).select(ingest.outcome_live(S.labels).alias("l"), ingest.outcome_restored(S.labels).alias("r")))
    assert (r.l, r.r) == (live, restored)


def test_severity_ladder(spark):
    for given, want in (({}, 0), ({"c_ttc_1_1": 1}, 1), ({"c_ttc_0_9": 1}, 2), ({"c_ttc_0_5": 1}, 3), ({"c_ttc_0_3": 1}, 4), ({"c_collision": 1}, 5)):
        df = labels(spark, **given)
        assert one(df.select(clean.severity(df).alias("s"))).s == want


def test_verdicts_borrow_from_later_formulas(spark):
    text = 'x [] a >= 1.5\nno verdict\n[] b >= 2 says Model checking result: False'
    logs = spark.createDataFrame([(1, text, "")], "loop_num long, output_log string, error_log string")
    got = {r.label: (r.verdict, r.verdict_borrowed) for r in ingest.verdicts(logs, [("a", "[] a >= 1.5"), ("b", "[] b >= 2"), ("c", "[] c")]).collect()}
    assert got == {"a": (1, True), "b": (1, False), "c": (-1, False)}


def test_trace_states(spark):
    df = spark.createDataFrame([(" TIMEOUT\n",), ('{"a": 1}',), ('{"a":',), ("NaN",)], "c string")
    assert [r.s for r in df.select(ingest.content_state(F.col("c")).alias("s")).collect()] == ["timeout", "valid", "corrupt", "corrupt"]


def test_hysteresis_and_streak(spark):
    df = spark.createDataFrame([(0.40,), (0.60,), (0.39,), (0.61,)], "m double")
    assert [r.s for r in df.select(sequence.hysteresis_state(F.col("m")).alias("s")).collect()] == [-1, -1, 0, 1]
    shifts = spark.createDataFrame(list(enumerate([0.005, 0.005, 0.02, 0.005, 0.005, 0.005])), "iter int, shift_rate double")
    assert [r.stable for r in sequence.stability_streak(shifts).orderBy("iter").collect()] == [False] * 5 + [True]


def test_focus_plan(spark):
    rows = design.focus_plan(focus_points(spark)).orderBy("idx").collect()
    assert len(rows) == 120 and all(r.point == r.idx // 20 and r.repeat == r.idx % 20 + 1 for r in rows)
    assert rows[25].reason == "[FOCUS] Exact Point 2/6 (Repeat 6/20)"


def test_one_class_gives_no_target_and_no_training_set(spark):
    runs = labels(spark).withColumns({"loop_num": F.lit(1), "dx0": F.lit(1.0), "ego_speed": F.lit(1.0), "npc_speed": F.lit(1.0)})
    runs = runs.union(runs)
    assert one(report.best_target(runs, S.priorities)).target is None
    assert clean.training_set(runs, "c_collision").count() == 0


def test_expiry_is_strict(spark):
    p = spark.createDataFrame([(1, 1.0, 1), (2, 1.0, 1)], "loop_num long, dx0 double, seq int").withColumn("ts", F.when(F.col("loop_num") == 1, F.timestamp_seconds(F.lit(1000))).otherwise(F.timestamp_seconds(F.lit(999))))
    r = spark.createDataFrame([], "loop_num long, ts timestamp")
    assert [x.loop_num for x in merge.stale_params(p, r, F.timestamp_seconds(F.lit(1600)), 600).collect()] == [2]


def test_sobol_fills_bins(spark):
    rows = design.sobol_design(spark.range(64).withColumnRenamed("id", "idx")).collect()
    for c, (low, high) in S.ranges.items():
        assert sorted(int((r[c] - low) / (high - low) * 64 + 1e-3) for r in rows) == list(range(64))


def test_candidates_stay_in_range(spark):
    ids = spark.range(700).withColumnRenamed("id", "cand_id")
    for df in (design.uniform_candidates(ids), design.focus_candidates(ids, list(FOCUS_POINTS), 700)):
        for c, (low, high) in S.ranges.items():
            r = one(df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")))
            assert low <= r.lo <= r.hi <= high and r.n == 700


def test_ties_go_to_the_least_candidate(spark):
    df = spark.createDataFrame([(0, 5, 1.0, 1.0, 1.0, 0.9, 0.2), (0, 3, 2.0, 1.0, 1.0, 0.1, 0.2)], "draw_id int, cand_id long, dx0 double, ego_speed double, npc_speed double, mean double, std double")
    assert one(acquire.pick_max_uncertainty(df)).cand_id == 3
    assert one(acquire.pick_safe_cleanup(df.where("mean > 0.5"))).reason == "STEP3: Backup Search"
    assert one(acquire.next_batch(df.withColumn("std", F.lit(0.01)), "STEP3", 10)).system_command == "stop"


def test_gp_equals_exact_process_with_all_points(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(40, 3))
    y = (x.sum(1) > 1.5).astype(float)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "dx0 double, ego_speed double, npc_speed double, y double")
    m = gp.fit(df, S.features, inducing=64, lengths=(1.0, 2.5))
    got = gp.predict(df, m).orderBy("dx0").collect()
    z = (x - x.mean(0)) / x.std(0)
    k = m.amplitude * gp.kernel(z, z, m.length)
    inv = np.linalg.inv(k + gp.NOISE * np.eye(40))
    order = np.argsort(x[:, 0])
    assert np.allclose([r["mean"] for r in got], (k @ inv @ y)[order], atol=1e-4)
    assert np.allclose([r["std"] for r in got], np.sqrt(np.maximum(np.diag(k - k @ inv @ k), 0))[order], atol=1e-3)


def test_short_and_missing_files(spark, tmp_path):
    assert files.read_dataset(spark, f"{tmp_path}/none").count() == 0
    names = [files.dotted(f.name) for f in files.dataset_schema()]
    (tmp_path / "d.csv").write_text(",".join(names) + "\n" + ",".join(["-1"] * 11 + ["15.0", "36.0", "7", "12.5", "late"]) + "\n")
    r = one(files.read_dataset(spark, f"{tmp_path}/d.csv"))
    assert r.loop_num == 7 and r.reason == "late" and r.worker_id is None and r.theory_zone_a is None


def test_empty_tables_pass(spark):
    runs = labels(spark).limit(0).withColumns({"loop_num": F.lit(1), "worker_id": F.lit("21"), "outcome": F.lit("Safe")})
    assert one(report.resume_point(runs)).resume_at == 0
    assert report.running_totals(runs).count() == 0 and report.worker_violation_rate(runs).count() == 0


def test_design_goes_on_beyond_old_periods(spark):
    near, far = (design.sobol_design(spark.createDataFrame([(5 + k,), (6 + k,)], "idx long")).collect() for k in (0, 1 << 25))
    assert all(a[c] != b[c] for a, b in zip(near, far, strict=True) for c in S.ranges)


def test_design_has_the_published_points():
    """The first points of three dimensions without a shift, as published."""
    want = [(0, 0, 0), (0.5, 0.5, 0.5), (0.75, 0.25, 0.25), (0.25, 0.75, 0.75), (0.375, 0.375, 0.625), (0.875, 0.875, 0.125), (0.625, 0.125, 0.875), (0.125, 0.625, 0.375)]
    for i, point in enumerate(want):
        gray = i ^ (i >> 1)
        for numbers, x in zip(design.directions(), point, strict=True):
            out = 0
            for k in range(design.BITS):
                out ^= numbers[k] if gray >> k & 1 else 0
            assert out / (1 << design.BITS) == x


def test_first_of_several_results_counts(spark):
    p = spark.createDataFrame([(1, 1.0, 1)], "loop_num long, dx0 double, seq int").withColumns({"ts": F.timestamp_seconds(F.lit(0)), "reason": F.lit("r")})
    r = spark.createDataFrame([(1, 1, 20), (1, 0, 10), (1, 1, 30)], "loop_num long, c_collision int, at int").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    assert one(merge.timeout_flush(p, r, ["c_collision"])).c_collision == 0 and one(merge.merge_results(p, r)).c_collision == 0


def test_an_intermediate_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from safespan.session import shared_dir

    unset = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_expiry_within_the_join(spark, tmp_path):
    """A result within the limit joins, also exactly at it; one beyond it is an orphan, and the parameters expire."""
    from safespan.streaming import campaign

    p = spark.createDataFrame([(1, 1, 1000), (2, 1, 1000), (3, 1, 1000), (4, 1, 1000), (4, 2, 1300)], "loop_num long, seq int, at long")
    p.select("loop_num", "seq", F.timestamp_seconds("at").alias("ts"), *[F.lit(1.0).alias(c) for c in S.features]).coalesce(1).write.parquet(f"{tmp_path}/p")
    r = spark.createDataFrame([(1, 1500), (2, 1600), (3, 1601), (4, 1700), (9, 5000)], "loop_num long, at long")
    r.select("loop_num", F.timestamp_seconds("at").alias("ts"), F.lit(0).alias("c_collision"), F.lit(1).alias("c_ttc_0_5")).coalesce(1).write.parquet(f"{tmp_path}/r")
    streams = [campaign.watch(spark, f"{tmp_path}/{x}", spark.read.parquet(f"{tmp_path}/{x}").schema) for x in "pr"]
    got = sorted((x.loop_num, x.status) for x in campaign.drain(campaign.merge_stream(*streams, seconds=600)).collect())
    assert got == [(1, "merged"), (2, "merged"), (3, "expired"), (3, "orphan"), (4, "merged"), (9, "orphan")]
