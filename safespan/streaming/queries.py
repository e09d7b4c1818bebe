"""Streaming queries over the campaign tables: each runs until its input is used up and returns what came out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from safespan.functions.theory import enrich
from safespan.operators.ingest import content_state, outcome_live, scan_traces
from safespan.plans.sql import LABELS, sql
from safespan.scenario import Scenario
from safespan.session import shared_dir
from safespan.sources.tables import VIEWS
from safespan.streaming import campaign
from safespan.streaming.store import FirstOf, Upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql(oracle)
        return f

    return keep


def stream(s: SparkSession, d: str, view: str) -> DataFrame:
    """One of the campaign tables as a stream."""
    text = VIEWS[view]
    names = [t for t in ("lineitem", "orders", "events") if "{" + t + "}" in text]
    # as a pattern, the path may be a file or a folder
    tables = {t: campaign.watch(s, f"{d}/{t}.parque[t]", s.read.parquet(f"{d}/{t}.parquet").schema) for t in names}
    out = s.sql(text, **tables)
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in out.columns else out


@query("SELECT loop_num, state FROM states_of")
def stream_traces(s, d):
    traces = scan_traces(stream(s, d, "traces"))
    return campaign.drain(traces.select("loop_num", content_state(F.col("content")).alias("state")))


@query("SELECT DISTINCT loop_num FROM (SELECT user_id AS loop_num FROM events)")
def stream_dedup(s, d):
    """Repeats within an hour are dropped by the stream's state, all others by the stored keys."""
    base = f"{shared_dir(s).rstrip('/')}/dedup-{uuid.uuid4().hex}"
    first = FirstOf(f"{base}/first")
    campaign.drain_into(campaign.dedup(stream(s, d, "frames").select("loop_num", "ts"), "ts", "1 hour"), first, base)
    return first.read(s).select("loop_num")


_MERGED = "SELECT p.loop_num, 'merged' AS status, p.dx0, p.ego_speed, p.npc_speed, r.c_collision, r.c_ttc_0_5, r.ts FROM last_params p JOIN results r USING (loop_num)"
_ORPHAN = "SELECT r.loop_num, 'orphan' AS status, CAST(NULL AS DOUBLE) AS dx0, CAST(NULL AS DOUBLE) AS ego_speed, CAST(NULL AS DOUBLE) AS npc_speed, r.c_collision, r.c_ttc_0_5, r.ts FROM results r ANTI JOIN params p USING (loop_num)"


def _merge(s, d, **kind):
    base = f"{shared_dir(s).rstrip('/')}/merge-{uuid.uuid4().hex}"
    sink = campaign.MergeTable(f"{base}/table", **kind)
    campaign.drain_into(campaign.events(stream(s, d, "params"), stream(s, d, "results")), sink, base)
    return sink.read(s).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(_MERGED)
def stream_merge(s, d):
    return _merge(s, d).where("status = 'merged'")


@query(_ORPHAN)
def stream_late(s, d):
    return _merge(s, d).where("status = 'orphan'")


@query("SELECT p.loop_num, 'timeout' AS status, -1 AS c_collision, -1 AS c_ttc_0_5 FROM last_params p ANTI JOIN results r USING (loop_num) WHERE epoch(p.ts) + 200 < (SELECT max(epoch(ts)) FROM params)")
def stream_timeout(s, d):
    out = _merge(s, d, seconds=200, status="timeout", labels=-1)
    return out.where("status = 'timeout'").select("loop_num", "status", "c_collision", "c_ttc_0_5")


def _upserted(s, frame, key):
    """Update mode: a batch changes the rows of its keys only."""
    base = f"{shared_dir(s).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    sink = Upsert(f"{base}/table", key)
    campaign.drain_into(frame, sink, base, "update")
    return sink.read(s)


@query("SELECT outcome, count(*) AS n_runs FROM live GROUP BY outcome")
def stream_totals(s, d):
    runs = stream(s, d, "runs").withColumn("outcome", outcome_live(LABELS))
    return _upserted(s, campaign.outcome_totals(runs), "outcome")


@query("SELECT worker_id, status FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY ts DESC, event_id DESC) AS n FROM worker_status) WHERE n = 1")
def stream_status(s, d):
    return _upserted(s, campaign.latest_status(stream(s, d, "worker_status")), "worker_id")


def finished(runs):
    """Runs with theory, without that of late ones. They are numbered anew, by order and line, so that numbers can go on from
    the last."""
    runs = runs.withColumns({c: F.when(~F.col("late"), F.col(c)) for c in runs.columns if c.startswith("theory_")}).drop("late")
    return runs.withColumn("loop_num", F.expr("loop_num div 10000000000 * 8 + loop_num % 10"))


def stream_loop(s, d):
    """Decisions of a campaign that appends, fits and picks after each batch of finished runs."""
    path = f"{shared_dir(s).rstrip('/')}/loop-{uuid.uuid4().hex}"
    return campaign.campaign_loop(enrich(stream(s, d, "runs")), campaign.Loop(path, scenario=Scenario(max_samples=1 << 40)), finished)


QUERIES["stream_loop"] = stream_loop  # random candidates: tested by its properties
