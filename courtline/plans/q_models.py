"""Queries of season-forward models; SQL cannot state them, tests check that no fit sees its own or a later season."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..sources.files import checkpoint
from .inputs import view, with_views
from .q_features import rounded
from .q_market import team_rows
from .registry import query

FEATURES = ["D_WinRate", "D_AvgMargin", "D_Games"]


def matchups(spark, sf_dir):
    from ..operators import matchup as U

    rows = U.matchup_table(view(spark, sf_dir, "tourney"), team_rows(spark, sf_dir), required="WinRate")
    return rows.select("GameID", "Season", "T1", "T2", "Label", "MarginLabel", *(F.col(c).cast("double").alias(c) for c in FEATURES))


MODELS = {"lr": M.linear, "gbt": M.trees, "margin": M.margins}


def oof(spark, sf_dir, models=tuple(MODELS)):
    """Season-forward probabilities of these models; each is fitted by itself, so what is not asked for is not fitted."""
    return M.season_forward_oof(matchups(spark, sf_dir), FEATURES, {m: MODELS[m] for m in models})


@query("season_forward_oof")
def season_forward_oof(spark, sf_dir):
    return rounded(oof(spark, sf_dir))


@query("calibrate_platt")
def calibrate_platt(spark, sf_dir):
    return rounded(M.calibrate(oof(spark, sf_dir, ("lr",)), "Prob_lr", "platt"))


@query("calibrate_isotonic")
def calibrate_isotonic(spark, sf_dir):
    return rounded(M.calibrate(oof(spark, sf_dir, ("lr",)), "Prob_lr", "isotonic"))


@query("stack_meta")
def stack_meta(spark, sf_dir):
    return rounded(M.stack_meta(oof(spark, sf_dir), ["Prob_lr", "Prob_gbt", "Prob_margin"]))


@query("full_fit_and_score")
def full_fit_and_score(spark, sf_dir):
    rows = checkpoint(matchups(spark, sf_dir))
    return rounded(M.full_fit_and_score(rows.where("Season < 2000"), rows.where("Season >= 2000"), FEATURES, M.linear).select("GameID", "Season", "Prob"))


CURVE = with_views("tourney glog", """, tf AS (SELECT Season, TeamID, avg(Win) AS w, avg(Margin) AS m FROM glog GROUP BY 1, 2), l AS (SELECT Season, least(WTeamID, LTeamID) AS T1, greatest(WTeamID, LTeamID) AS T2, CASE WHEN WTeamID < LTeamID THEN 1 ELSE 0 END AS Label FROM tourney),
r AS (SELECT Label, a.m - b.m AS d FROM l JOIN tf a ON a.Season = l.Season AND a.TeamID = T1 JOIN tf b ON b.Season = l.Season AND b.TeamID = T2), v AS (SELECT list(d ORDER BY d) AS v, count(d) AS n, greatest(1, least(24, count(d) // 16)) AS bins FROM r WHERE d IS NOT NULL),
q AS (SELECT v, n, unnest(generate_series(1, greatest(bins - 1, 1))) / CAST(CASE WHEN bins = 1 THEN 1 ELSE bins END AS DOUBLE) AS p FROM v), x AS (SELECT v, p * (n - 1) AS k FROM q),
e AS (SELECT list(v[CAST(floor(k) AS BIGINT) + 1] * (1 - (k - floor(k))) + coalesce(v[CAST(floor(k) AS BIGINT) + 2], 0) * (k - floor(k))) AS e FROM x)
SELECT CAST(len(list_filter(e, lambda x: x < d)) AS INT) AS Bin, round(avg(d), 6) AS Margin, round(avg(Label), 6) AS Rate, count(*) AS n FROM r, e GROUP BY 1 HAVING count(*) >= 8""")


@query("binned_margin_curve", CURVE)
def binned_margin_curve(spark, sf_dir):
    return rounded(M.binned_margin_curve(matchups(spark, sf_dir), "D_AvgMargin"))
