"""Focus points and scenarios as data, live tables and their archives, reasons with figures."""

import json

import pytest
from pyspark.sql import functions as F

from safespan.operators import acquire, design
from safespan.scenario import Scenario, scenario
from safespan.sources.files import LiveTable, read_snapshot, write_snapshot


def test_focus_points_from_json(spark):
    text = '[{"dx0": 10.5, "ego_speed": 38, "npc_speed": 14.2}, {"dx0": 12, "npc_speed": null, "other": 1}]'
    points = design.parse_points(spark, text)
    assert points == ((10.5, 38.0, 14.2), (12.0, None, None))
    for bad in ('[{"dx0": 1', '{"dx0"}', "[]", "null", "[null]", '[{"dx0": "near"}]'):
        with pytest.raises(ValueError):
            design.parse_points(spark, bad)
    rows = spark.createDataFrame([(0, 0, 0, False, "STEP1"), (25, 0, 0, False, "STEP1")], "idx long, draw_id int, violations long, trained boolean, phase string")
    none = spark.createDataFrame([], "draw_id int, cand_id long, dx0 double, ego_speed double, npc_speed double, mean double, std double")
    got = {r.idx: r for r in acquire.decide(rows, none, "focus", points).collect()}
    assert got[25].dx0 == 12 and got[25].ego_speed == 35 and got[25].npc_speed == 17.5 and got[25].reason == "[FOCUS] Exact Point 2/2 (Repeat 6/20)"


def test_scenarios_by_name(spark, tmp_path):
    assert scenario("uturn") == Scenario()
    with pytest.raises(ValueError, match="no scenario"):
        scenario("cutin")
    (tmp_path / "near.json").write_text(json.dumps({"ranges": {"dx0": [5, 8], "ego_speed": [20, 30]}, "hysteresis": [0.3, 0.7], "history": 9}, indent=1))
    s = scenario("near", spark, str(tmp_path))
    assert s.ranges == {"dx0": (5, 8), "ego_speed": (20, 30)} and s.features == ("dx0", "ego_speed") and s.hysteresis == (0.3, 0.7) and s.history == 9 and s.labels == Scenario().labels
    (tmp_path / "odd.json").write_text('{"rangs": {}}')
    with pytest.raises(ValueError, match="rangs"):
        scenario("odd", spark, str(tmp_path))


def test_snapshots_written_twice_have_their_rows_once(spark, tmp_path):
    for n, stamp in ((5, "a"), (3, "b"), (5, "a"), (4, "a")):
        write_snapshot(spark.range(n), f"{tmp_path}/s", stamp)
    assert [read_snapshot(spark, f"{tmp_path}/s", x).count() for x in "ab"] == [4, 3]


def test_archives_leave_an_empty_live_table(spark, tmp_path, monkeypatch):
    t = LiveTable(f"{tmp_path}/t")
    t.append(spark.range(3))
    t.append(spark.range(3, 5))
    from safespan.sources import files

    real = files.write_snapshot

    def stopped(*a):
        real(*a)
        raise RuntimeError

    monkeypatch.setattr(files, "write_snapshot", stopped)
    with pytest.raises(RuntimeError):
        t.archive(spark, "one")
    monkeypatch.setattr(files, "write_snapshot", real)
    assert t.read(spark).count() == 5  # not archived yet
    for _ in range(2):
        t.archive(spark, "one")
        assert t.read(spark).count() == 0 and t.read(spark).columns == ["id"]
    t.append(spark.range(7, 9))
    t.archive(spark, "one")  # done before: the new rows stay
    assert t.read(spark).count() == 2 and t.snapshot(spark, "one").count() == 5
    t.archive(spark, "two")
    assert (t.read(spark).count(), t.snapshot(spark, "two").count()) == (0, 2)


def test_reasons_have_figures(spark):
    rows = [(0, 1, 10.0, 30.0, 10.0, 0.2, 0.0512), (0, 2, 11.0, 30.0, 10.0, 0.9, 0.3), (1, 3, 12.0, 30.0, 10.0, 0.613, 0.4)]
    scored = spark.createDataFrame(rows, "draw_id int, cand_id long, dx0 double, ego_speed double, npc_speed double, mean double, std double")
    got = {r.draw_id: r for r in acquire.next_batch(scored, "STEP3", 10).collect()}
    assert got[0].reason == "STEP3: Safe Area Cleanup (σ=0.0512)" and got[0].dx0 == 10 and got[0].idx == 10
    assert got[1].reason == "STEP3: Backup Search (M:0.61)" and got[1].dx0 == 12
    second = acquire.next_batch(scored, "STEP2", 0, dice=F.when(F.col("draw_id") == 0, 0.0).otherwise(1.0)).orderBy("draw_id").collect()
    assert [r.reason for r in second] == ["STEP2: Exploration (Max σ)", "STEP2: Boundary 0.5"]
