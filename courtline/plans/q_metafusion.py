"""Queries of the fusion decision and of what it is fitted with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metafusion as U
from ..operators import rules as R
from . import q_live  # noqa: F401
from .inputs import view, with_views
from .q_features import rounded
from .q_rules import clip
from .registry import query

ROUTES = {"Prob_stats": "RawProb", "Prob_market_public": "MarketProb", "Prob_legacy_anchor": "ModelMatchupProb", "Prob_women_min_lr": "Prob_route"}
CONTEXT = ["MarketProb", "AbsSeedDiff", "D_HostLikely", "IsRound1Or2"]
GATES = {"M": U.Gates(selector=(1996, 1996), recent_linear=1999), "W": U.Gates(recent_selector=2000)}  # the tables' seasons end in 2001
RULE = R.Rule(("MarketProb",), (">=",), (0.9,))


def routes(spark, sf_dir):
    """Scored pairs with four routes, three of which have gaps."""
    return view(spark, sf_dir, "live").select("GameID", "League", "Season", "Label", *CONTEXT, *(F.col(c).alias(n) for n, c in ROUTES.items()))


def _decision_sql() -> str:
    names = list(ROUTES)
    total, there = " + ".join(f"coalesce({c}, 0)" for c in names), " + ".join(f"({c} IS NOT NULL)::INT" for c in names)
    blends = {n: " + ".join(f"{w} * Prob_{g}_mean" for g, w in b.items()) for n, b in U.GROUP_BLENDS.items() if "text" not in b}
    candidates = [*names, U.MEAN, "Prob_market_mean", "Prob_stats_mean", "Prob_legacy_mean", *blends]
    long = " UNION ALL ".join(f"SELECT League, Season, Label, '{c}' AS name, {i} AS k, {c} AS p FROM s" for i, c in enumerate(candidates))
    best = "CASE BestName " + " ".join(f"WHEN '{c}' THEN {c}" for c in candidates) + " END"
    public = "contains(BestName, 'market_public')"
    return f""", f AS (SELECT GameID, League, Season, Label, MarketProb, D_HostLikely, IsRound1Or2, RawProb, {', '.join(f'{c} AS {n}' for n, c in ROUTES.items())} FROM live),
m AS (SELECT *, coalesce(({total}) / nullif({there}, 0), 0.5) AS mm FROM f),
r AS (SELECT * REPLACE ({', '.join(f'coalesce({c}, mm) AS {c}' for c in names)}) FROM m),
g AS (SELECT *, ({' + '.join(names)}) / 4 AS {U.MEAN}, Prob_market_public AS Prob_market_mean, (Prob_stats + Prob_women_min_lr) / 2 AS Prob_stats_mean, Prob_legacy_anchor AS Prob_legacy_mean FROM r),
s AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in blends.items())} FROM g),
l AS (SELECT League, Season, name, k, sum(({clip('p')} - Label) ** 2) AS e, count(*) AS n FROM ({long}) t GROUP BY 1, 2, 3, 4),
c AS (SELECT League, Season, name, k, sum(e) OVER w / sum(n) OVER w AS score FROM l WINDOW w AS (PARTITION BY League, name ORDER BY Season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT League, Season, name AS BestName, score AS BestScore, max(score) FILTER (WHERE name = 'Prob_legacy_anchor') OVER (PARTITION BY League, Season) AS AnchorScore FROM c WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY League, Season ORDER BY round(score, 9), k) = 1),
b AS (SELECT s.*, coalesce(BestName, '{U.MEAN}') AS BestName, coalesce(BestScore, CAST('inf' AS DOUBLE)) AS BestScore, AnchorScore, 0.6 * RawProb + 0.2 AS lin, 0.8 * RawProb + 0.1 AS boo, 0.5 * RawProb + 0.25 AS sel FROM s LEFT JOIN h USING (League, Season)),
d AS (SELECT *, {clip(best)} AS bp, {public} AS pub FROM b),
m1 AS (SELECT *, CASE WHEN pub THEN 0.15 * bp + 0.85 * lin ELSE 0.85 * bp + 0.15 * (0.35 * lin + 0.65 * boo) END AS p1, CASE WHEN pub THEN 0 WHEN coalesce(BestScore + 0.015 < AnchorScore, false) THEN 1 WHEN coalesce(AnchorScore <= BestScore + 0.01, false) THEN 2 ELSE 3 END AS way FROM d),
m2 AS (SELECT *, CASE way WHEN 0 THEN p1 WHEN 1 THEN 0.9 * bp + 0.1 * p1 WHEN 2 THEN Prob_legacy_anchor ELSE 0.6 * Prob_legacy_anchor + 0.4 * p1 END AS p2 FROM m1),
m3 AS (SELECT *, CASE WHEN Season = 1996 THEN sel ELSE p2 END AS p3, way IN (0, 2) OR Season = 1996 AS settled FROM m2),
men AS (SELECT GameID, BestName, CASE WHEN pub AND Season >= 1999 AND MarketProb >= 0.4 THEN lin WHEN NOT settled AND MarketProb >= 0.9 THEN greatest(p3, 0.93) ELSE p3 END AS p,
  CASE WHEN pub AND Season >= 1999 AND MarketProb >= 0.4 THEN 'recent linear' WHEN NOT settled AND MarketProb >= 0.9 THEN 'rule MarketProb_>=_0.9' WHEN Season = 1996 THEN 'selector' WHEN way > 0 THEN 'anchor' ELSE 'best with models' END AS DecidedBy FROM m3 WHERE League = 'M'),
women AS (SELECT GameID, BestName, CASE WHEN MarketProb IS NOT NULL AND D_HostLikely >= 1 AND IsRound1Or2 >= 1 THEN Prob_women_min_lr WHEN Season >= 2000 THEN sel ELSE Prob_legacy_anchor END AS p,
  CASE WHEN MarketProb IS NOT NULL AND D_HostLikely >= 1 AND IsRound1Or2 >= 1 THEN 'host specialist' WHEN Season >= 2000 THEN 'recent selector' ELSE 'anchor' END AS DecidedBy FROM d WHERE League = 'W')
SELECT GameID, BestName, round({clip('p')}, 6) AS FinalProb, DecidedBy FROM (SELECT * FROM men UNION ALL SELECT * FROM women) t"""


@query("fusion_decision", with_views("live", _decision_sql()))
def fusion_decision(spark, sf_dir):
    raw = F.col("Prob_stats")
    rows = routes(spark, sf_dir).withColumns({"LinearMetaProb": raw * 0.6 + 0.2, "BoostedMetaProb": raw * 0.8 + 0.1, "SelectorProb": raw * 0.5 + 0.25})
    rule = U.rule_steps([(RULE, 1, 0.2, 0.93)])
    out = U.fusion_decision(rows, list(ROUTES), GATES, "Prob_legacy_anchor", "Prob_women_min_lr", {"M": rule, "W": rule})
    return rounded(out.select("GameID", "BestName", "FinalProb", "DecidedBy"))


@query("loss_selector_oof")
def loss_selector_oof(spark, sf_dir):
    return rounded(U.loss_selector_oof(routes(spark, sf_dir), list(ROUTES), CONTEXT).select("GameID", "Season", "SelectorProb"))


@query("fusion_oof")
def fusion_oof(spark, sf_dir):
    mined = R.candidate_rules({"MarketProb": (0.80, 0.85, 0.90, 0.94), "AbsSeedDiff": (2.0, 4.0, 6.0, 8.0), "D_HostLikely": (0.5,)}, ("MarketProb", "AbsSeedDiff"))
    return rounded(U.fusion_oof(routes(spark, sf_dir), list(ROUTES), GATES, mined, CONTEXT, "Prob_legacy_anchor", "Prob_women_min_lr"))
