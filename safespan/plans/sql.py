"""SQL of the campaign tables and of the stopping model, to hold the operators against."""

from __future__ import annotations

import re

from safespan.operators.clean import SEVERITIES, ZONES
from safespan.scenario import PROFILES, Scenario
from safespan.sources.tables import VIEWS

S = Scenario()
TTC, LABELS, PLOTTED = S.ttc, S.labels, ("c_collision", *S.plotted_ttc)


def stop_sql(v0: str, td: float, tj: float, a: float) -> tuple[str, str]:
    tj = tj if tj > 0 else 1e-5
    tdx, tjx, ax = (f"{x!r}" if "e" in repr(x) else f"{x!r}e0" for x in (td, tj, a))
    v1, ts = f"({v0} - {ax}*{tjx}/2)", f"sqrt(2*{v0}*{tjx}/{ax})"
    d = f"CASE WHEN {v1} < 0 THEN {v0}*{tdx} + ({v0}*{ts} - ({ax}/{tjx})*{ts}*{ts}*{ts}/6) ELSE {v0}*{tdx} + ({v0}*{tjx} - {ax}*{tjx}*{tjx}/6) + {v1}*{v1}/(2*{ax}) END"
    return d, f"CASE WHEN {v1} < 0 THEN {tdx} + {ts} ELSE {tdx} + {tjx} + {v1}/{ax} END"


def zone_sql(h: str, a: str) -> str:
    return f"CASE WHEN isnan({h}) OR isnan({a}) THEN 'D' WHEN {h} >= 0 AND {a} >= 0 THEN 'A' WHEN {h} < 0 AND {a} >= 0 THEN 'B' WHEN {h} < 0 AND {a} < 0 THEN 'C' ELSE 'D' END"


def repair_sql(ttc: tuple[str, ...], lift: str) -> str:
    out, before = [], "coalesce(c_collision = 1, false)"
    for c in ttc:
        out.append(f"CASE WHEN ({before}) AND {c} IN ({lift}) THEN 1 ELSE {c} END AS {c}")
        before += f" OR coalesce({c} = 1, false)"
    return ", ".join(out)


def severity_sql() -> str:
    return "CASE " + " ".join(f"WHEN {c} = 1 THEN {s}" for c, s in zip(PLOTTED, range(5, 0, -1), strict=True)) + " ELSE 0 END"


def sobol_sql(n: int, index: str, bits: int = 52) -> str:
    """Coordinate n (0, 1 or 2) of the index-th point, rounded and in its range. Direction integers by the recurrence of Joe
    and Kuo, m_k = 2 a_1 m_(k-1) ^ 4 a_2 m_(k-2) ^ ... ^ 2^s m_(k-s) ^ m_(k-s), and v_k = m_k / 2^k."""
    if n == 0:
        m = [1] * bits
    elif n == 1:  # polynomial of degree 1, m_1 = 1
        m = [1]
        while len(m) < bits:
            m.append(2 * m[-1] ^ m[-1])
    else:  # degree 2 with a_1 = 1, m_1 = 1, m_2 = 3
        m = [1, 3]
        while len(m) < bits:
            m.append(2 * m[-1] ^ 4 * m[-2] ^ m[-2])
    shift, state = 0, 42
    for _ in range(n + 1):
        state = (6364136223846793005 * state + 1442695040888963407) & ((1 << 64) - 1)
        shift = state >> (64 - bits)
    gray = f"xor({index}, {index} >> 1)"
    parts = [f"CASE WHEN ({gray} >> {k}) & 1 = 1 THEN {x << (bits - 1 - k)} ELSE 0 END" for k, x in enumerate(m)]
    out = f"CAST({shift} AS BIGINT)"
    for p in parts:
        out = f"xor({out}, {p})"
    low, high = list(S.ranges.values())[n]
    return f"round({low}e0 + {out} / {float(1 << bits)!r} * {high - low}e0, 6)"


def values(rows, names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) AS t({names})"


(DH, TH), (DA, TA) = (stop_sql("v0", *p[1:]) for p in PROFILES)
_rest = [c for c in LABELS]
_theory = {"d_total_human": "d_human", "d_total_ai": "d_ai"} | {m: m for m in ("margin_a_human", "margin_a_ai", "margin_b_human", "margin_b_ai")}

CTES: dict[str, str] = {k: re.sub(r"\{(\w+)\}", r"\1", v) for k, v in VIEWS.items()} | {
    "profiles": values(PROFILES, "profile, t_delay, t_jerk, a_max"),
    "severities": values(SEVERITIES, "severity, severity_name"),
    "zones": values(ZONES, "zone, zone_name"),
    "stops": f"SELECT *, {DH} AS d_human, {TH} AS t_human, {DA} AS d_ai, {TA} AS t_ai FROM (SELECT *, ego_speed/3.6e0 AS v0 FROM runs) r",
    "margins": "SELECT *, dx0 - d_human AS margin_a_human, dx0 - d_ai AS margin_a_ai, dx0 + npc_speed/3.6e0*t_human - d_human AS margin_b_human, dx0 + npc_speed/3.6e0*t_ai - d_ai AS margin_b_ai FROM stops",
    "dataset": "SELECT loop_num, dx0, ego_speed, npc_speed, " + ", ".join(LABELS) + ", reason, worker_id, "
    + ", ".join(f"CASE WHEN NOT late THEN round({v}, 4) END AS theory_{k}" for k, v in _theory.items())
    + f", CASE WHEN NOT late THEN {zone_sql('margin_a_human', 'margin_a_ai')} END AS theory_zone_a, CASE WHEN NOT late THEN {zone_sql('margin_b_human', 'margin_b_ai')} END AS theory_zone_b FROM margins",
    "plotted": f"SELECT * FROM dataset WHERE {' AND '.join(f'{c} IN (0, 1)' for c in PLOTTED)}",
    "repaired": f"SELECT * EXCLUDE ({', '.join(S.plotted_ttc)}), {repair_sql(S.plotted_ttc, '0')} FROM plotted",
    "graded": f"SELECT *, {severity_sql()} AS severity, regexp_replace(worker_id, '\\.0$', '') AS worker FROM repaired",
    "live": "SELECT *, CASE WHEN " + " OR ".join(f"coalesce({c}, -1) = -1" for c in LABELS) + " OR c_npc_stuck = 1 THEN 'Error' WHEN "
    + " OR ".join(f"{c} = 1" for c in LABELS if c != "c_npc_stuck") + " THEN 'Unsafe' ELSE 'Safe' END AS outcome FROM runs",
    "restored": "SELECT *, CASE WHEN " + " OR ".join(f"{c} = -1" for c in LABELS) + " THEN 'Error' WHEN " + " OR ".join(f"{c} = 1" for c in LABELS) + " THEN 'Unsafe' ELSE 'Safe' END AS outcome FROM runs",
    "scanned": "SELECT *, CAST(regexp_extract(path, 'sim(\\d+)', 1) AS BIGINT) AS loop_num FROM traces WHERE path LIKE '%.json' AND contains(path, '_eval_sim') AND NOT contains(path, 'footage')",
    "states_of": "SELECT *, CASE WHEN trim(content) = 'TIMEOUT' THEN 'timeout' WHEN json_valid(content) THEN 'valid' ELSE 'corrupt' END AS state FROM scanned",
    "processed": "SELECT event_id AS loop_num FROM events WHERE event_id % 4 = 0 UNION SELECT event_id FROM events WHERE event_id % 6 = 0",
    "last_params": "SELECT * FROM params QUALIFY row_number() OVER (PARTITION BY loop_num ORDER BY ts DESC, seq DESC) = 1",
    "first_results": "SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY loop_num ORDER BY ts, c_collision, c_ttc_0_5) = 1",
    "history": "SELECT *, CASE WHEN mean < 0.4e0 THEN 0 WHEN mean > 0.6e0 THEN 1 ELSE -1 END AS state FROM boundary_states",
    "lagged": "SELECT *, lag(state, 49) OVER (PARTITION BY point_id ORDER BY iter) AS old_state FROM history",
    "shifts": "SELECT iter, count(*) FILTER (WHERE state + old_state = 1 AND state * old_state = 0)::DOUBLE / count(*) AS shift_rate FROM lagged WHERE old_state IS NOT NULL GROUP BY iter",
    "islands": "SELECT *, shift_rate < 0.01e0 AS calm, sum(CASE WHEN shift_rate < 0.01e0 THEN 0 ELSE 1 END) OVER (ORDER BY iter) AS island FROM shifts",
    "cleaned": f"SELECT * EXCLUDE ({', '.join(TTC)}), {repair_sql(TTC, '0')} FROM dataset WHERE {' AND '.join(f'coalesce({c}, 0) <> -1' for c in LABELS)} AND coalesce(c_npc_stuck, 0) <> 1",
    "trainable": "SELECT loop_num, dx0, ego_speed, npc_speed, c_ttc_0_5 AS y FROM cleaned WHERE loop_num IS NOT NULL AND dx0 IS NOT NULL AND ego_speed IS NOT NULL AND npc_speed IS NOT NULL AND c_ttc_0_5 IN (0, 1)",
}


def sql(body: str) -> str:
    """The body behind the tables it names."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if name in CTES and name not in order:
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(body)
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" if order else "") + body
