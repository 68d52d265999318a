"""Anchors: a run's logged configuration, read back and replayed as a plan of columns over its stored scores."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.files import cached_table
from . import rules as P
from .evaluate import prob_fallback
from .models import calibrate
from .release import fingerprint

KEY = ["League", "Season", "T1", "T2"]
#: What a step's configuration may say, and the rule that it stands for; each takes the probability so far.
STEPS: dict[str, Callable[[Column, dict], Column]] = {
    "AdaptiveMarketBlend": lambda p, c: P.market_blend(p, P.adaptive_weight(float(c.get("base", 0.0)), int(c.get("close_at", 0)), float(c.get("close", 0.0)), int(c.get("wide_at", 99)), float(c.get("wide", 0.0)))),
    "ChalkExtremes": lambda p, c: P.seed_floor(p, int(c["top"]), int(c["dog"]), float(c["floor"])),
    "MarketExtremes": lambda p, c: P.market_floor(p, float(c["threshold"]), float(c["floor"]), int(c.get("gap", 0))),
    "SpreadExtremes": lambda p, c: P.spread_floor(p, float(c["threshold"]), float(c["floor"])),
}


@dataclass(frozen=True)
class Run:
    """What a run was: its raw column, calibration, shrinkage towards one half, and its steps in order."""

    league: str
    run_id: str
    raw: str = "ProbMean"
    calibration: str = "none"
    shrinkage: float = 0.0
    steps: tuple[tuple[str, dict], ...] = field(default=())

    @property
    def tag(self) -> str:
        return hashlib.sha256(json.dumps([self.league, self.raw, self.calibration, self.shrinkage, self.steps], sort_keys=True).encode()).hexdigest()[:16]


def _truth(value: object) -> bool:
    return str(value).strip().lower() in ("1", "true", "yes", "y")


def _config(value: object) -> dict:
    try:
        found = json.loads(str(value))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def latest_runs(log: DataFrame) -> list[Run]:
    """The newest run of each league that has a score: one row a league comes to the driver.

    log: League, RunID, TimestampUTC, BestCVBrier, SelectedRawColumn, CalibrationMethod, Shrinkage, and Has<step> with
    <step>Config (JSON) for the steps; missing columns and values that can't be read are defaults, a step needs
    its flag and a configuration. Runs of one time go by their name, the last first.
    """
    newest = log.where("BestCVBrier is not null").groupBy("League").agg(F.max_by(F.struct(*log.columns), F.struct("TimestampUTC", "RunID")).alias("r"))
    runs = []
    for row in newest.select("r.*").orderBy("League").collect():
        r = row.asDict()
        steps = tuple((s, _config(r.get(f"{s}Config"))) for s in STEPS if _truth(r.get(f"Has{s}")) and _config(r.get(f"{s}Config")))
        shrinkage = r.get("Shrinkage")
        runs.append(Run(str(r["League"]), str(r["RunID"]), str(r.get("SelectedRawColumn") or "ProbMean"), str(r.get("CalibrationMethod") or "none"), 0.0 if shrinkage is None else float(shrinkage), steps))
    return runs


def replay(oof: DataFrame, run: Run, columns: list[str]) -> DataFrame:
    """The run's scores again: (key, Label, AnchorProb) of its league's rows.

    A raw column that is not there, or null, falls back to the mean of `columns`, then to one half; calibration
    sees earlier seasons alone; shrinkage comes next, then the steps in order.
    """
    rows = oof.where(F.col("League") == run.league)
    raw = prob_fallback(rows, run.raw, [c for c in columns if c != run.raw]) if run.raw in columns else X.clip_prob(F.coalesce(X.row_mean(*columns), F.lit(0.5)))
    rows = rows.withColumn("_raw", raw)
    if run.calibration in ("platt", "isotonic"):
        fitted = calibrate(rows, "_raw", run.calibration).select("GameID", "Season", F.col("Calibrated").alias("_c"))
        rows = rows.join(fitted, ["GameID", "Season"], "left").withColumn("_raw", F.coalesce("_c", "_raw")).drop("_c")
    rows = rows.withColumn("_p", X.shrink_half("_raw", run.shrinkage))
    for name, config in run.steps:  # a projection each: a rule mentions what came before several times
        rows = rows.withColumn("_p", STEPS[name](F.col("_p"), config))
    return rows.select("GameID", *KEY, "Label", X.clip_prob(F.coalesce("_p", F.lit(0.5))).alias("AnchorProb"))


def anchor_merge(base: DataFrame, oof: DataFrame, log: DataFrame, columns: list[str], root: str | None = None) -> DataFrame:
    """base with the AnchorProb of its league's newest run; a league without a run, and rows the run lacks, have null.

    oof: GameID, League, Season, T1, T2, Label, the probability columns and what the steps read. With `root` a replay is kept there as
    Parquet under the hash of the configuration and of the rows' content, and read instead of being made again.
    """
    parts = []
    for run in latest_runs(log):
        if root is None:
            parts.append(replay(oof, run, columns))
        else:
            mark = fingerprint(oof.where(F.col("League") == run.league), *oof.columns).first()  # one row
            tag = f"{run.tag}-{hashlib.sha256(repr(tuple(mark)).encode()).hexdigest()[:16]}"
            parts.append(cached_table(oof.sparkSession, root, tag, lambda run=run: replay(oof, run, columns)))
    none = oof.limit(0).select("GameID", F.lit(0.0).alias("AnchorProb"))
    return base.join(reduce(DataFrame.unionByName, (p.select("GameID", "AnchorProb") for p in parts), none), "GameID", "left")
