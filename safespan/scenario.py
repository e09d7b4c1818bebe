"""Settings of a test scenario, and its dimensions as small tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

SAFE, VIOLATION, ERROR = 0, 1, -1

# Fixed values of the U-turn scenario: formulas, thresholds, ranges, profiles and focus points.
FORMULAS = (
    # label, formula, quantifier, negated, signal, threshold
    ("c_collision", '[] ~ collision("ego", "npc1")', "always", True, "collision", None),
    ("c_ttc_1_5", '[] ttc("npc1") >= 1.5', "always", False, "ttc", 1.5),
    ("c_ttc_1_3", '[] ttc("npc1") >= 1.3', "always", False, "ttc", 1.3),
    ("c_ttc_1_2", '[] ttc("npc1") >= 1.2', "always", False, "ttc", 1.2),
    ("c_ttc_1_1", '[] ttc("npc1") >= 1.1', "always", False, "ttc", 1.1),
    ("c_ttc_0_9", '[] ttc("npc1") >= 0.9', "always", False, "ttc", 0.9),
    ("c_ttc_0_7", '[] ttc("npc1") >= 0.7', "always", False, "ttc", 0.7),
    ("c_ttc_0_5", '[] ttc("npc1") >= 0.5', "always", False, "ttc", 0.5),
    ("c_ttc_0_3", '[] ttc("npc1") >= 0.3', "always", False, "ttc", 0.3),
    ("c_pos_diff_4_0", '[] pos-diff("ego", "npc1") >= 4.0', "always", False, "pos_diff", 4.0),
    ("c_npc_stuck", '<> speed("npc1") >= 0.1', "eventually", False, "npc_speed", 0.1),
)
PROFILES = (("human", 0.75, 0.6, 7.58), ("ai_aeb", 0.1, 0.1, 8.33))
FOCUS_POINTS = (
    (10.09, 37.98, 14.20), (14.81, 39.80, 13.49), (10.23, 35.96, 17.80),
    (13.29, 39.33, 13.95), (14.16, 35.43, 10.02), (11.17, 31.90, 11.91),
)
FIXED = {"ego_init_lane": "514", "ego_init_offset": 30, "ego_goal_lane": "516", "ego_goal_offset": 20, "npc_init_lane": "521", "npc_init_offset": 32, "uturn_next_lane": "514", "acceleration": 7.0}


@dataclass(frozen=True)
class Scenario:
    """What operators need to know about a scenario; every setting has a default."""

    labels: tuple[str, ...] = tuple(f[0] for f in FORMULAS)
    features: tuple[str, ...] = ("dx0", "ego_speed", "npc_speed")
    ranges: dict[str, tuple[float, float]] = field(default_factory=lambda: {"dx0": (10.0, 25.0), "ego_speed": (30.0, 40.0), "npc_speed": (10.0, 25.0)})
    plotted_ttc: tuple[str, ...] = ("c_ttc_0_3", "c_ttc_0_5", "c_ttc_0_9", "c_ttc_1_1")
    priorities: tuple[str, ...] = ("c_collision", "c_ttc_0_3", "c_ttc_0_5", "c_ttc_0_7", "c_ttc_0_9", "c_ttc_1_1", "c_ttc_1_2", "c_ttc_1_3", "c_ttc_1_5")
    target_runs: int = 3000
    first_phase: int = 100
    second_phase: int = 500
    max_samples: int = 3000
    hysteresis: tuple[float, float] = (0.40, 0.60)
    history: int = 50
    shift: float = 0.01
    streak: int = 3
    uncertainty: float = 0.05
    focus_repeats: int = 20
    focus_noise: float = 0.05
    run_seconds: int = 200
    params_seconds: int = 600

    @property
    def ttc(self) -> tuple[str, ...]:
        """TTC labels, tightest threshold first."""
        return tuple(sorted((c for c in self.labels if c.startswith("c_ttc_")), key=threshold))


SCENARIOS: dict[str, Scenario] = {"uturn": Scenario()}


def scenario(name: str, spark: SparkSession | None = None, folder: str | None = None) -> Scenario:
    """The scenario of a name: of SCENARIOS, or of the file <folder>/<name>.json, whose settings stand in for the defaults.
    Unknown names and settings are errors."""
    if folder is None:
        if name not in SCENARIOS:
            raise ValueError(f"no scenario {name}; there are {sorted(SCENARIOS)}")
        return SCENARIOS[name]
    given = json.loads(spark.read.text(f"{folder}/{name}.json", wholetext=True).first()[0])
    unknown = sorted(set(given) - {f.name for f in fields(Scenario)})
    if unknown:
        raise ValueError(f"scenario {name} has unknown settings: {unknown}")
    listed = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
    if "ranges" in listed:
        listed["ranges"] = {c: tuple(r) for c, r in listed["ranges"].items()}
        listed.setdefault("features", tuple(listed["ranges"]))
    return Scenario(**listed)


def threshold(label: str) -> float:
    """The threshold in a label's name: c_ttc_0_3 is 0.3."""
    return float(".".join(label.rsplit("_", 2)[-2:]))


def formulas(spark: SparkSession) -> DataFrame:
    rows = [(i, f, label, q, neg, s, t) for i, (label, f, q, neg, s, t) in enumerate(FORMULAS)]
    return spark.createDataFrame(rows, "pos int, formula string, label string, quantifier string, negated boolean, signal string, threshold double")


def profiles(spark: SparkSession, rows: tuple = PROFILES) -> DataFrame:
    return spark.createDataFrame(list(rows), "profile string, t_delay double, t_jerk double, a_max double")


def focus_points(spark: SparkSession, rows: tuple = FOCUS_POINTS) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "point int, dx0 double, ego_speed double, npc_speed double")
