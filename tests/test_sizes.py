"""Steps that grow with the tables: the same results as the plain way, without its cost."""

import math
import re

import pytest
from pyspark.sql import functions as F

from safespan.functions.decimals import rounded
from safespan.operators import acquire, sequence
from safespan.streaming import campaign
from safespan.streaming import queries as streaming


def events(spark, rows):
    """Rows (run, kind, seq, time) as campaign.events gives them."""
    df = spark.createDataFrame(rows, "loop_num long, kind int, seq int, at double")
    param, label = F.when(F.col("kind") == 0, F.col("seq") * 10.0), F.when(F.col("kind") == 1, 1)
    return df.select("loop_num", F.timestamp_seconds("at").alias("ts"), "at", "kind", "seq", *[param.alias(c) for c in ("dx0", "ego_speed", "npc_speed")], *[label.alias(c) for c in ("c_collision", "c_ttc_0_5")])


def test_parameters_wait_in_a_table(spark, tmp_path):
    """Taken by the first result alone, replaced, at the limit, beyond it within a batch and by the stream's time; batches
    that are given twice change nothing."""
    sink = campaign.MergeTable(f"{tmp_path}/t", 200, 0, "timeout", -1)
    batches = [
        [(1, 0, 1, 1000.0), (2, 0, 1, 1000.0), (3, 0, 1, 1000.0), (9, 1, 0, 1000.0), (8, 0, 1, 700.0), (8, 1, 0, 901.0)],
        [(2, 0, 2, 1100.0), (1, 1, 0, 1200.0), (4, 0, 1, 1190.0), (4, 0, 2, 1190.0), (4, 1, 0, 1190.0)],
        [(1, 1, 0, 1201.0)],
        [(2, 1, 0, 1150.0), (None, 1, 0, 1300.0)],
    ]
    first = [(9, "orphan", None, 1, 1000), (8, "timeout", 10.0, -1, 900), (8, "orphan", None, 1, 901)]
    want = [first, first + [(1, "merged", 10.0, 1, 1200), (4, "merged", 20.0, 1, 1190)]]
    want.append(want[1] + [(1, "orphan", None, 1, 1201), (3, "timeout", 10.0, -1, 1200)])
    want.append(want[2] + [(2, "merged", 20.0, 1, 1150), (None, "orphan", None, 1, 1300)])
    for i, rows in enumerate(batches):
        sink(events(spark, rows), i)
        sink(events(spark, rows), i)
        got = sink.read(spark).select("loop_num", "status", "dx0", "c_collision", F.col("ts").cast("long"))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want[i]))


@pytest.mark.parametrize("name", ["stream_merge", "stream_late", "stream_timeout"])
def test_merges_run_without_a_call_of_python_for_each_run(spark, monkeypatch, name):
    def slow(*args, **kind):
        raise AssertionError("a state in Python for each run")

    monkeypatch.setattr(campaign, "merge_stream", slow)
    assert streaming.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


@pytest.mark.parametrize("length", [1, 2, 20, 32, 33, 34, 50, 65, 120])
def test_packed_histories_are_those_of_rows(spark, length):
    """Points that begin late or below zero, miss iterations, have one twice, have no number, no mean or no iteration."""
    spans = {1: range(150), 2: range(-70, 40), 3: [*range(5), *range(9, 140)], 4: [*range(100), 60], None: range(31, 97), 6: [32], 7: [*range(70), *range(128, 180)], 8: [*range(60), None], 9: range(64, 200)}
    rows = [(i, p, None if (i or 0) % 41 == 7 else float("nan") if (i or 0) % 43 == 5 else ((i or 0) * 37 + (p or 0) * 11) % 19 / 18) for p, span in spans.items() for i in span]
    rows = [(i, p, 0.1 if (i, p) == (60, 4) else m) for i, p, m in rows]  # of the repeated one, either may come first
    df = spark.createDataFrame(rows, "iter long, point_id long, mean double").repartition(5)
    names = ["iter", "point_id", "state", "old_state"]
    want = sequence.stability_history(df, length).select(names)
    got = sequence.packed_history(df, length)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, map(tuple, got.select(names).collect()))) == sorted(map(str, map(tuple, want.collect())))


@pytest.mark.parametrize("name", ["stability_history", "boundary_shift", "stability_streak", "boundary_stability", "boundary_stability_settings"])
def test_histories_shuffle_words_not_rows(spark, monkeypatch, name):
    """What is shuffled and sorted by point is one row for 32 iterations, and nothing where no point is odd."""
    from safespan.plans import queries as campaign_queries

    def rows(*args, **kind):
        raise AssertionError("a row for each iteration")

    monkeypatch.setattr(sequence, "stability_history", rows)
    monkeypatch.setattr(acquire, "stability_history", rows, raising=False)
    assert campaign_queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_profiles_cross_without_grouping_runs(spark):
    """On the smallest tables one run number occurs twice: both of its rows are there."""
    from oracle import connect, same
    from safespan.plans import queries as campaign_queries

    small = "/root/testdata/sf0.001"
    assert same(campaign_queries.QUERIES["profile_cross"](spark, small), connect(small), campaign_queries.ORACLE["profile_cross"]) > 0


def test_counts_remember_what_a_task_meets():
    """A second pass over 150,000 different words finds them all; 62,500 of each kind were remembered before."""
    import public_tokenizers
    from safespan.llm.bpe import Vocabulary
    from safespan.llm.tokencount import Counter

    class Counting(Counter):
        def word(self, word):
            self.seen = getattr(self, "seen", 0) + 1
            return super().word(word)

    c = Counting(Vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    letters = "abcdefghij"
    text = " ".join("x" + "".join(letters[int(d)] for d in str(i)) for i in range(150_000))
    assert c.text(text) == c.text(text) > 150_000 and c.seen == 150_000


def method_bytes(df):
    """The size of the largest method in the code that Spark makes of a plan."""
    debug = df.sparkSession._jvm.org.apache.spark.sql.execution.debug
    return max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", getattr(debug, "package").codegenString(df._jdf.queryExecution().executedPlan())))


def test_runs_are_worked_out_by_compiled_code(spark, tmp_path, monkeypatch):
    """Java runs methods above 8,000 bytes without compiling them: those of a stream's theory and of a batch's rows are below."""
    from safespan.functions.theory import enrich
    from safespan.sources.tables import load
    from safespan.streaming.store import BatchStore

    kept, write = {}, BatchStore.write

    def keep(self, df, table, number):
        kept.setdefault(table, df)
        return write(self, df, table, number)

    monkeypatch.setattr(BatchStore, "write", keep)
    monkeypatch.setattr(streaming.campaign, "drain_into", lambda stream, sink, base: sink(spark.createDataFrame(stream.rdd, stream.schema), 0))
    monkeypatch.setattr(streaming, "stream", load)
    assert streaming.QUERIES["stream_loop"](spark, "/root/testdata/sf0.001").count() == 15
    assert method_bytes(enrich(load(spark, "/root/testdata/sf0.01", "runs"))) < 8000
    assert method_bytes(kept["dataset"]) < 8000


def test_quick_rounding_is_that_of_spark(spark):
    """Middles of two decimals and their neighbours, all magnitudes, both zeros, what isn't finite, null."""
    x = [(k + 0.5) / 1e4 for k in range(-3000, 3000)] + [s * m * 10.0**e for e in range(-9, 25) for m in (1.00005, 2.675, 0.99995, 7.0, 1 / 3) for s in (1, -1)]
    x += [math.nextafter(v, w) for v in x for w in (math.inf, -math.inf)] + [0.0, -0.0, 1e308, 5e-324, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 4).cast("string").alias("want"), rounded("x").cast("string").alias("got"))
    assert df.where("not want <=> got").count() == 0


def test_cascades_of_repeated_runs_agree(spark):
    """Two rows of a run at one threshold, in either order."""
    for labels in ([1, 0], [0, 1]):
        df = spark.createDataFrame([(1, 1.2, x) for x in labels], "loop_num long, threshold double, label int").coalesce(1)
        assert sorted(r.label for r in sequence.ttc_cascade(df).collect()) == [0, 1]
