"""Streams across restarts: keyed state, batches that are given again, a live folder, repeats, models that grow."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from safespan.operators import clean, gp, sequence
from safespan.scenario import Scenario
from safespan.streaming import campaign
from safespan.streaming.store import BatchStore, FirstOf, Upsert, append_once

S = Scenario()


def sent(spark, folder, params=(), results=()):
    """Further files of parameters (run, seq, time) and results (run, time)."""
    p = spark.createDataFrame(list(params), "loop_num long, seq int, at long")
    p.select("loop_num", "seq", F.timestamp_seconds("at").alias("ts"), *[(F.col("seq") * 10.0).alias(c) for c in S.features]).coalesce(1).write.mode("append").parquet(f"{folder}/p")
    r = spark.createDataFrame(list(results), "loop_num long, at long")
    r.select("loop_num", F.timestamp_seconds("at").alias("ts"), F.lit(0).alias("c_collision"), F.lit(1).alias("c_ttc_0_5")).coalesce(1).write.mode("append").parquet(f"{folder}/r")


def streams(spark, folder):
    return [campaign.watch(spark, f"{folder}/{x}", spark.read.parquet(f"{folder}/{x}").schema) for x in "pr"]


def merged(spark, folder, **kind):
    out = campaign.drain(campaign.merge_stream(*streams(spark, folder), **kind), base=f"{folder}/query").collect()
    return sorted((x.loop_num, x.status, x.dx0) for x in out)


def test_parameters_wait_across_restarts(spark, tmp_path):
    """Each restart goes on with the parameters in wait: taken once, replaced by newer ones, expired by their timer."""
    sent(spark, tmp_path, [(1, 1, 1000), (2, 1, 1000), (3, 1, 1000)], [(9, 1000)])
    first = merged(spark, tmp_path)
    assert first == [(9, "orphan", None)]
    sent(spark, tmp_path, [(2, 2, 1100)], [(1, 1200)])
    second = merged(spark, tmp_path)
    assert second == sorted([*first, (1, "merged", 10.0)], key=str) or set(second) == {*first, (1, "merged", 10.0)}
    sent(spark, tmp_path, [], [(1, 1300), (2, 1650)])
    third = merged(spark, tmp_path)
    assert set(third) - set(second) == {(1, "orphan", None), (2, "merged", 20.0), (3, "expired", 10.0)} and len(third) == 5
    assert merged(spark, tmp_path) == third  # nothing new


def test_outer_join_agrees_with_the_keyed_state(spark, tmp_path):
    """Where parameters are sent once and results come once, also at the limit and beyond it."""
    params = [(i, 1, 1000 + i) for i in range(40)] + [(98, 1, 5000)]
    results = [(i, 1000 + i + {0: 5, 1: 200, 2: 201}[i % 4]) for i in range(40) if i % 4 < 3] + [(99, 5000)]
    sent(spark, tmp_path, params, results)
    kinds = dict(seconds=200, status="timeout", labels=-1)
    keyed = campaign.drain(campaign.merge_stream(*streams(spark, tmp_path), **kinds)).where("status <> 'orphan'")
    joined = campaign.drain(campaign.merge_once(*streams(spark, tmp_path), **kinds))
    assert sorted(map(tuple, joined.select(keyed.columns).collect())) == sorted(map(tuple, keyed.collect()))
    assert {r.status: r["count"] for r in joined.groupBy("status").count().collect()} == {"merged": 20, "timeout": 20}


def test_a_batch_counts_once(spark, tmp_path):
    store = BatchStore(f"{tmp_path}/t")
    sink = append_once(store)
    a, b = spark.range(5), spark.range(5, 9)
    assert store.last(spark) == -1
    sink(a, 0)
    sink(a, 0)
    store.write(b, "rows", 1)  # stopped before its mark
    assert store.read(spark, "rows").count() == 5
    sink(b, 1)
    sink(b, 1)
    assert sorted(r.id for r in store.read(spark, "rows").collect()) == list(range(9))


class Stop(Exception):
    pass


def test_a_round_is_done_once(spark, tmp_path, monkeypatch):
    """A round given twice, or stopped before any of its writes and given again, leaves what one whole round leaves."""
    from safespan.plans.queries import dataset

    runs = dataset(spark, "/root/testdata/sf0.001").withColumn("loop_num", F.expr("loop_num div 10000000000 * 8 + loop_num % 10")).where("loop_num < 2400").cache()
    batches = [runs.where("loop_num < 900"), runs.where("loop_num between 900 and 1500"), runs.where("loop_num > 1500")]
    made = {}

    def loop(name):
        return campaign.Loop(f"file://{tmp_path}/{name}", batch_size=3, candidates=40, references=30, inducing=24, lengths=(0.7, 1.5), scenario=Scenario(max_samples=10_000, first_phase=300, history=2))

    def content(name):
        store = loop(name).store
        return {t: sorted(map(str, store.read(spark, t).drop("sums").collect())) for t in ("dataset", "states", "decisions", "rounds")}

    for i, b in enumerate(batches):
        loop("whole")(b, i)
    made = content("whole")
    assert len(made["decisions"]) == 9 and len(made["rounds"]) == 3 and len(made["dataset"]) == runs.count()
    write, count = BatchStore.write, 0

    def stopping(self, df, table, number):
        nonlocal count
        out = write(self, df, table, number)
        count += 1
        if number == 1 and count == at:
            raise Stop
        return out

    monkeypatch.setattr(BatchStore, "write", stopping)
    tables = ("dataset", "sums", "states", "decisions", "rounds")
    for at in range(1, len(tables) + 1):
        one = loop(f"stopped{at}")
        one(batches[0], 0)
        one(batches[0], 0)
        count = 0
        with pytest.raises(Stop):
            one(batches[1], 1)
        assert len(one.store.read(spark, "decisions").collect()) == 3
        one(batches[1], 1)
        one(batches[1], 1)
        one(batches[2], 2)
        assert content(f"stopped{at}") == made
    rounds = loop("whole").store.read(spark, "rounds").orderBy("batch").collect()
    assert [r.n_runs for r in rounds] == np.cumsum([b.count() for b in batches]).tolist()


def test_rounds_read_new_rows_only(spark, tmp_path):
    """The plan of a later round has neither earlier runs nor states but those of one round."""
    read, batch = [], BatchStore.batch
    from safespan.plans.queries import dataset

    runs = dataset(spark, "/root/testdata/sf0.001").withColumn("loop_num", F.expr("loop_num div 10000000000 * 8 + loop_num % 10")).cache()
    loop = campaign.Loop(f"file://{tmp_path}/l", batch_size=2, candidates=20, references=10, inducing=16, lengths=(1.0,), scenario=Scenario(max_samples=10_000, first_phase=10, history=3))
    for i in range(5):
        loop(runs.where(f"loop_num between {i * 1000} and {i * 1000 + 999}"), i)
    try:
        BatchStore.batch = lambda self, s, table, number: (read.append((table, number)), batch(self, s, table, number))[1]
        whole = BatchStore.read
        BatchStore.read = lambda self, s, table, *a: (read.append((table, "all")), whole(self, s, table, *a))[1]
        loop(runs.where("loop_num between 5000 and 5999"), 5)
    finally:
        BatchStore.batch, BatchStore.read = batch, whole
    assert set(read) == {("rounds", 4), ("sums", 4), ("states", 3), *((t, 5) for t in ("dataset", "sums", "states", "decisions", "rounds"))}


def test_sums_of_batches_equal_those_of_everything(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform([10, 30, 10], [25, 40, 25], size=(3000, 3))
    rows = [(*map(float, a), float(a[0] < 14 + rng.normal())) for a in x]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, dx0 double, ego_speed double, npc_speed double, y double")
    frame = gp.design_frame(S, 60, (0.4, 1.0, 2.5))
    parts = [gp.sums(gp.points(df.where(f"id % 4 = {k}"), frame.features, "y"), frame) for k in range(4)]
    grown = parts[0]
    for p in parts[1:]:
        grown = gp.added(grown, p)
    a, b = gp.solve(grown, frame), gp.solve(gp.sums(gp.points(df, frame.features, "y"), frame), frame)
    assert (a.length, a.classes) == (b.length, 2) and a.amplitude == pytest.approx(b.amplitude, rel=1e-8) and a.evidence == pytest.approx(b.evidence, rel=1e-8)
    ids = spark.range(200).withColumnRenamed("id", "cand_id")
    from safespan.operators.design import uniform_candidates

    got = [gp.predict(uniform_candidates(ids), m).orderBy("cand_id").select("mean", "std").collect() for m in (a, b)]
    assert np.allclose(got[0], got[1], atol=1e-8)
    mean = np.array([r["mean"] for r in gp.predict(df, a).orderBy("id").collect()])
    y = np.array([r[3] for r in rows])
    assert np.mean((mean > 0.5) == (y > 0.5)) > 0.9


def test_likelihood_is_that_of_the_dense_process(spark):
    """Evidence from sums against the log density of the targets under the approximate process, and the best of a fine grid."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 2))
    y = (np.sin(2 * x[:, 0]) + x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] * 2, "a double, b double, y double")
    m = gp.fit(df, ("a", "b"), inducing=40, lengths=(0.4, 1.0, 2.5))
    z = (np.vstack([x, x]) - m.mean) / m.std
    kuf, kuu = gp.kernel(m.inducing, z, m.length), gp.kernel(m.inducing, m.inducing, m.length)

    def density(c):
        q = c * kuf.T @ np.linalg.pinv(kuu, 1e-9) @ kuf + gp.NOISE * np.eye(300)
        t = np.concatenate([y, y])
        return -0.5 * (t @ np.linalg.solve(q, t) + np.linalg.slogdet(q)[1] + 300 * np.log(2 * np.pi))

    assert m.evidence == pytest.approx(density(m.amplitude), abs=0.05)
    assert all(density(m.amplitude * s) <= m.evidence + 0.05 for s in (0.5, 0.8, 1.25, 2))


def test_phases_of_batches_equal_those_of_all_decisions(spark):
    rng = np.random.default_rng(3)
    s = Scenario(first_phase=12, second_phase=17)
    for stable_at in (20, 31, 10_000):
        rows = [(i, max(0, i - 8), bool(i >= 14), bool(i >= stable_at and rng.random() < 0.7)) for i in range(60)]
        df = spark.createDataFrame(rows, "idx long, violations long, trained boolean, stable boolean").cache()
        want = {r.idx: r.phase for r in sequence.phase_timeline(df, s).collect()}
        got, start, seen, done = {}, None, 0, False
        for lo in range(0, 60, 7):
            part = sequence.next_phases(df.where(f"idx between {lo} and {lo + 6}"), start, seen, done, s).collect()
            got |= {r.idx: r.phase for r in part}
            begun = [r.idx for r in part if r.phase in ("STEP2", "STEP3")]
            start, seen, done = start if start is not None else min(begun, default=None), seen + len(begun), done or any(r.phase == "STEP3" for r in part)
        assert got == want


def test_a_live_folder(spark, tmp_path):
    """Files renamed into a folder over three triggers with a restart before each: whole, corrupt, timed out, a repeated run,
    other files and half-written ones elsewhere; each run once, also when its file comes again under another name."""
    live, staging, archive = (tmp_path / x for x in ("live", "staging", "archive"))
    for x in (live, staging):
        x.mkdir()

    def put(name, text):
        (staging / name).write_text(text)
        os.rename(staging / name, live / name)

    first = FirstOf(f"{tmp_path}/first", span=4)

    def trigger():
        traces = campaign.watch_traces(spark, str(live), archive=str(archive))
        campaign.drain_into(campaign.dedup(traces.withColumn("ts", F.col("modified")), "ts", "1 hour").select("loop_num", "state"), first, str(tmp_path / "query"))
        return sorted((r.loop_num, r.state) for r in first.read(spark).collect())

    put("uturn_eval_sim1.json", '{"frames": [1,\n 2]}')
    put("uturn_eval_sim2.json", '{"frames":')
    put("uturn_eval_sim3_footage.json", "{}")
    put("notes.txt", "sim8")
    (staging / "uturn_eval_sim7.json").write_text("{")  # still being written
    assert trigger() == [(1, "valid"), (2, "corrupt")]
    put("uturn_eval_sim4.json", " TIMEOUT\n")
    put("again_eval_sim1.json", "{}")
    assert trigger() == [(1, "valid"), (2, "corrupt"), (4, "timeout")]
    put("uturn_eval_sim7.json", "{}")
    put("late_eval_sim2.json", "{}")
    want = [(1, "valid"), (2, "corrupt"), (4, "timeout"), (7, "valid")]
    assert trigger() == want and trigger() == want
    from safespan.operators.ingest import content_state, scan_traces
    from safespan.sources.files import read_traces

    put("uturn_eval_sim8.json", '{"frames":\n []}')
    put("uturn_eval_sim9.json", '{"frames":\n [')
    batch = scan_traces(read_traces(spark, str(live))).select("loop_num", content_state(F.col("content")).alias("state"))
    assert {(8, "valid"), (9, "corrupt")} <= {(r.loop_num, r.state) for r in batch.collect()}  # what was seen is archived


def test_repeats_are_dropped_whatever_their_distance(spark, tmp_path):
    """Keys are held against the stored ranges that the batch has keys in; a repeated batch changes nothing."""
    first = FirstOf(f"{tmp_path}/k", span=10)
    batches = [[1, 2, 2, 15], [2, 3, 15, 99], [], [1, 99, 1000], [None, None]]
    got = []
    for i, keys in enumerate(batches):
        df = spark.createDataFrame([(k, i) for k in keys], "loop_num long, n int")
        first(df, i)
        first(df, i)
        got.append(sorted((r.loop_num, r.n) for r in first.read(spark).where("loop_num is not null").collect()))
    assert got[-1] == [(1, 0), (2, 0), (3, 1), (15, 0), (99, 1), (1000, 3)]


def test_upserts_keep_the_newest_row_of_each_key(spark, tmp_path):
    sink = Upsert(f"{tmp_path}/u", "k")
    state = {}
    for i in range(7):
        rows = {(i * 3 + j) % 5: i for j in range(3)}
        df = spark.createDataFrame(list(rows.items()), "k int, v int")
        sink(df, i)
        sink(df, i)
        state |= rows
        assert dict(map(tuple, sink.read(spark).collect())) == state


def test_trainable_rows(spark):
    rows = [(1, 1.0, 1.0, 1.0, 0, 0), (2, 1.0, 1.0, 1.0, -1, 0), (3, None, 1.0, 1.0, 0, 0), (4, 1.0, 1.0, 1.0, 1, 1)]
    df = spark.createDataFrame(rows, "loop_num long, dx0 double, ego_speed double, npc_speed double, c_collision int, c_npc_stuck int")
    for c in S.ttc:
        df = df.withColumn(c, F.lit(0))
    assert [r.loop_num for r in clean.trainable(df, "c_collision").collect()] == [1]
    assert clean.training_set(df, "c_collision").count() == 0


def test_spread_inducing_points_do_as_well_at_half_the_number(spark):
    """On runs that crowd together, as those of a campaign that follows the boundary do."""
    rng = np.random.default_rng(8)
    crowd = rng.normal([12.0, 36.0, 15.0], 0.3, size=(4500, 3))
    x = np.vstack([crowd, rng.uniform([10, 30, 10], [25, 40, 25], size=(1500, 3))])
    y = (x[:, 0] < 13 + 2 * np.sin(x[:, 1]) + 0.2 * (x[:, 2] - 15)).astype(float)
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, dx0 double, ego_speed double, npc_speed double, y double").cache()
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0 and id >= 4500")

    def error(inducing, spread):
        m = gp.fit(train, S.features, inducing=inducing, lengths=(0.4, 0.7, 1.0, 1.5), spread=spread)
        return len(m.inducing), gp.predict(test, m).select(F.avg((F.col("mean") - F.col("y")) ** 2)).first()[0]

    hashed, spread = error(120, False), error(60, True)
    assert hashed[0] == 120 and 50 <= spread[0] <= 60 and spread[1] <= hashed[1]
    few = spark.createDataFrame([(1.0, 1.0, 1.0, 0.0), (2.0, 1.0, 1.0, 1.0), (2.0, 1.0, 1.0, 1.0)], "dx0 double, ego_speed double, npc_speed double, y double")
    assert len(gp.fit(few, S.features, inducing=30, lengths=(1.0,), spread=True).inducing) == 2
    assert gp.fit(few.limit(0), S.features, spread=True) is None
