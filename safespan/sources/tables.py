"""The campaign tables as views of the driver's tables: one SQL text for each, with the tables as {placeholders}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TTC = {"c_ttc_1_5": 1.5, "c_ttc_1_3": 1.3, "c_ttc_1_2": 1.2, "c_ttc_1_1": 1.1, "c_ttc_0_9": 0.9, "c_ttc_0_7": 0.7, "c_ttc_0_5": 0.5, "c_ttc_0_3": 0.3}


def _ttc_label(name: str, at: float) -> str:
    forced = {"c_ttc_0_3": "l_suppkey % 7 = 0", "c_ttc_0_9": "l_suppkey % 11 = 0"}.get(name)
    hit = f"CASE WHEN ttc < {at}e0" + (f" AND NOT ({forced})" if forced else "") + " THEN 1 ELSE 0 END"
    return f"CASE WHEN late OR bad THEN -1 ELSE {hit} END AS {name}"


RUNS = f"""
SELECT loop_num, dx0, ego_speed, npc_speed,
  CASE WHEN late OR bad THEN -1 WHEN ttc <= 0.1e0 THEN 1 ELSE 0 END AS c_collision,
  {", ".join(_ttc_label(n, t) for n, t in _TTC.items())},
  CASE WHEN late OR bad THEN -1 WHEN dx0 - l_tax*100 < 4 THEN 1 ELSE 0 END AS c_pos_diff_4_0,
  CASE WHEN late THEN -1 WHEN l_partkey % 89 = 0 THEN 1 ELSE 0 END AS c_npc_stuck,
  CASE WHEN NOT late THEN CAST(21 + l_suppkey % 3 AS STRING) || CASE WHEN l_linenumber = 7 THEN '.0' ELSE '' END END AS worker_id,
  CASE l_returnflag WHEN 'A' THEN 'STEP1: Global Search (V:0)' WHEN 'N' THEN 'STEP2: Boundary 0.5' ELSE 'STEP3: Safe Area Cleanup' END
    || CASE WHEN late THEN ' [ERROR: TIMEOUT]' ELSE '' END AS reason,
  late
FROM (
  SELECT *, dx0*0.6e0/((ego_speed - npc_speed)/3.6e0 + 1) - l_tax*12 AS ttc, l_partkey % 97 = 0 AS bad, l_partkey % 101 = 0 AS late
  FROM (
    SELECT *, ((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber AS loop_num,
      round(10e0 + (l_quantity - 1)*15/49, 4) AS dx0, round(30e0 + l_discount*100, 4) AS ego_speed,
      round(10e0 + (l_partkey % 151)*0.1e0, 4) AS npc_speed
    FROM {{lineitem}}) a) b"""

PARAMS = """
SELECT loop_num, CASE WHEN seq = 2 THEN dx0 + 0.5e0 ELSE dx0 END AS dx0, ego_speed, npc_speed, worker_id, reason, ts, seq
FROM (
  SELECT ((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber AS loop_num, round(10e0 + (l_quantity - 1)*15/49, 4) AS dx0,
    round(30e0 + l_discount*100, 4) AS ego_speed, round(10e0 + (l_partkey % 151)*0.1e0, 4) AS npc_speed,
    CAST(21 + l_suppkey % 3 AS STRING) AS worker_id, 'STEP1' AS reason, l_shipdate AS ts, l_linenumber
  FROM {lineitem} WHERE l_partkey % 103 <> 0) p
JOIN (SELECT 1 AS seq UNION ALL SELECT 2 AS seq) s ON seq = 1 OR l_linenumber = 1"""

RESULTS = """
SELECT ((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber AS loop_num,
  CASE WHEN l_partkey % 97 = 0 THEN -1 WHEN l_quantity < 5 THEN 1 ELSE 0 END AS c_collision,
  CASE WHEN l_partkey % 97 = 0 THEN -1 WHEN l_quantity < 9 THEN 1 ELSE 0 END AS c_ttc_0_5,
  l_shipdate AS ts
FROM {lineitem} WHERE l_partkey % 107 <> 0"""

FRAMES = """
SELECT user_id AS loop_num, ts, event_id, round(value/10 + (user_id % 20)*0.1e0, 4) AS ttc,
  event_type = 'error' AND value < 0.5e0 AS collision, round(value/5 + (user_id % 11)*0.5e0, 4) AS pos_diff,
  CASE WHEN user_id % 13 = 0 THEN 0e0 ELSE event_id % 97 / 10e0 END AS npc_speed
FROM {events}"""

TRACES = """
SELECT event_id, CASE event_id % 10 WHEN 3 THEN 'uturn_test_sim' || CAST(event_id AS STRING) || '.json'
    WHEN 7 THEN 'uturn_eval_sim' || CAST(event_id AS STRING) || '_footage.meta.json'
    ELSE 'uturn_eval_sim' || CAST(event_id AS STRING) || '.json' END AS path,
  CASE WHEN event_id % 50 = 0 THEN ' TIMEOUT ' WHEN event_id % 37 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END AS content, ts AS modified
FROM {events}"""

CHECKER_LOG = """
SELECT o_orderkey AS loop_num,
  'rewrite: ' || '[] ~ collision("ego", "npc1")' || ' in 10ms. Model checking result: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END
  || ' next: ' || '[] ttc("npc1") >= 0.5' || ' in 12ms. ' || CASE WHEN o_orderkey % 29 = 0 THEN 'error' ELSE 'Model checking result: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'True' ELSE 'False' END END
  || CASE WHEN o_orderkey % 31 = 0 THEN ' next: stopped'
     ELSE ' next: ' || '[] pos-diff("ego", "npc1") >= 4.0' || ' in 9ms. Model checking result: ' || CASE WHEN o_orderkey % 5 = 0 THEN 'True' ELSE 'False' END END AS output_log,
  CASE WHEN o_orderkey % 31 = 0 THEN 'killed' ELSE '' END AS error_log
FROM {orders}"""

TASKS = """
SELECT o_orderkey AS enqueue_seq, 10e0 + o_orderkey % 16 AS dx0, 30e0 + o_custkey % 11 AS ego_speed, 10e0 + o_custkey % 16 AS npc_speed,
  'STEP1' AS reason, CASE WHEN o_orderkey % 5000 = 4999 THEN 'stop' END AS system_command
FROM {orders}"""

WORKER_STATUS = """
SELECT CAST(21 + user_id % 5 AS STRING) AS worker_id, ts, event_id, event_type AS status
FROM {events}"""

SCORED = """
SELECT l_suppkey % 15 AS draw_id, ((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber AS cand_id, dx0, ego_speed, npc_speed,
  least(1e0, greatest(0e0, 1 - (dx0*0.6e0/((ego_speed - npc_speed)/3.6e0 + 1) - l_tax*12)/2)) AS mean, l_tax*1.5e0 + (l_partkey % 10)*0.001e0 AS std
FROM (
  SELECT *, round(10e0 + (l_quantity - 1)*15/49, 4) AS dx0, round(30e0 + l_discount*100, 4) AS ego_speed, round(10e0 + (l_partkey % 151)*0.1e0, 4) AS npc_speed
  FROM {lineitem}) c"""

#: A reference point for each order, followed over 150 decisions.
BOUNDARY = """
SELECT iter, o_orderkey AS point_id, ((o_orderkey*7919) % 1000)/1000e0 + 0.3e0/(1 + iter*0.1e0) - 0.1e0 AS mean
FROM {orders} CROSS JOIN (SELECT CAST(a.i*10 + b.i AS BIGINT) AS iter
  FROM (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9
    UNION ALL SELECT 10 UNION ALL SELECT 11 UNION ALL SELECT 12 UNION ALL SELECT 13 UNION ALL SELECT 14) a
  CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9) b) d"""

VIEWS = {
    "runs": RUNS, "params": PARAMS, "results": RESULTS, "frames": FRAMES, "traces": TRACES, "checker_log": CHECKER_LOG, "tasks": TASKS,
    "worker_status": WORKER_STATUS, "scored": SCORED, "boundary_states": BOUNDARY,
}


#: Reference points of one task.
POINTS = 100_000


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One of VIEWS over the tables in sf_dir."""
    text = VIEWS[view]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "events") if "{" + t + "}" in text}
    if view == "boundary_states":
        # an order becomes 150 rows: orders are dealt by point beforehand, so that these needn't be
        points = tables["orders"].select("o_orderkey")
        tables["orders"] = points.repartition(max(spark.sparkContext.defaultParallelism, points.count() // POINTS), "o_orderkey")
    return spark.sql(text, **tables)
