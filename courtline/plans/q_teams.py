"""The whole feature table of a team and season, put together from the registered feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compose as C
from . import q_compose, q_features, q_ratings  # noqa: F401
from .inputs import view, with_views
from .q_features import rounded, some_seeds
from .registry import QUERIES, SQL, query

KEY = ["Season", "TeamID"]
EFF = ("OffRtg", "DefRtg", "Tempo", "FGPct", "FG3Pct", "FTPct", "OR", "DR", "Ast", "TO", "Stl", "Blk", "eFG", "TOVPct", "FTR", "ORBPct", "AdjOffRtg", "AdjDefRtg", "OppEFG", "OppTOVPct", "OppFTR", "OppORBPct", "NetRtg", "AdjNetRtg", "OffRtg_z", "DefRtg_z", "NetRtg_z", "AdjOffRtg_z", "AdjDefRtg_z", "AdjNetRtg_z")
PARTS = {
    "win_rate": ("WinRate", "AvgMargin", "Games"),
    "recent_form": ("RecentWinRate", "RecentMargin"),
    "recent_quality": ("Last10WinRate", "Last10Margin", "Last10SOS", "CloseGameWinRate", "CloseGameCount", "CloseGameMargin", "Top5Games", "Top5Wins", "Top5WinRate", "Top50Games", "Top50Wins", "Top50WinRate"),
    "recent_quality_days": ("Last30WinRate", "Last30Margin", "Last30SOS", "Last30CloseWinRate", "Last30CloseCount", "Last30Top50Games", "Last30Top50Wins", "Last30Top50WinRate"),
    "strength_of_schedule": ("SOS",),
    "rpi_metrics": ("OWP", "OOWP", "RPIStyle", "RPIStyleSOS"),
    "pagerank_strength": ("PageRank", "PageRank_z", "PageRankSOS"),
    "conf_tourney_wins": ("ConfTourneyWins",),
    "conference_strength": ("ConfAbbrev", "ConfNonConfWinRate", "ConfNonConfAvgMargin", "ConfNonConfGames", "ConfMeanRating", "ConfTeamCount"),
    "season_efficiency": (*EFF, "NeutralNetRtg_z", "NeutralAdjNetRtg_z"),
    "recent_efficiency_n": ("RecentEffGames", "RecentEffWinRate", *(f"RecentEff{c}" for c in EFF), "RecentEffAvgMargin"),
    "recent_efficiency_days": ("Recent30EffGames", "Recent30EffWinRate", *(f"Recent30Eff{c}" for c in EFF), "Recent30EffAvgMargin"),
    "rank_consensus": ("RankMean", "RankStd", "RankMin", "Rank_2-HIGH", "Rank_5-LOW"),
    "rank_momentum": ("RankMomentum",),
    "tenure_features": ("CoachTenure", "CoachChange", "CoachCount", "CoachMidseasonChange"),
    "external_composite": ("Ext_Power", "Ext_Defense", "Ext_Power_z", "Ext_Defense_z", "ExtCompositeStrength"),
}
ZERO = {"ConfTourneyWins", "CloseGameCount", "CoachChange", "CoachMidseasonChange", "CloseGameWinRate", "RankMomentum", "OWP", "OOWP", "RPIStyle", "RPIStyleSOS", "PageRank", "PageRank_z", "PageRankSOS", "Last30CloseWinRate", "Last30CloseCount"}
PATHS = ("PathDifficulty", "PathSeedMean")


def _of(name: str) -> str:
    """A registered query's SQL, whose roundings are not to be steadied once more."""
    return SQL[name].replace(", 6)", ",6)")


def _sql() -> str:
    joins, cols = [f"({with_views('rating', 'SELECT * FROM rating')}) b"], ["b.Season", "b.TeamID", "round(b.Rating, 6) AS Rating"]
    of = {}
    for i, (name, names) in enumerate(PARTS.items()):
        joins.append(f"LEFT JOIN ({_of(name)}) p{i} ON p{i}.Season = b.Season AND p{i}.TeamID = b.TeamID")
        for c in names:
            of[c] = f'p{i}."{c}"'
            zero = c in ZERO or (c.removeprefix("Last30").startswith("Top") and c.endswith(("Games", "Wins", "WinRate")))
            cols.append(f'coalesce({of[c]}, {0 if zero else 1}) AS "{c}"' if zero or c in ("CoachTenure", "CoachCount") else f'{of[c]} AS "{c}"')
    seeds = with_views("seeds", "SELECT Season, TeamID FROM seeds WHERE TeamID % 3 <> 0")
    joins += [f"LEFT JOIN ({_of('impute_seeds')}) s ON s.Season = b.Season AND s.TeamID = b.TeamID", f"LEFT JOIN ({seeds}) t ON t.Season = b.Season AND t.TeamID = b.TeamID"]
    joins.append(f"LEFT JOIN ({_of('seed_priors')}) r ON r.League = CASE b.TeamID % 2 WHEN 0 THEN 'M' ELSE 'W' END AND r.Season = b.Season AND r.SeedBucket = greatest(1, least(17, s.SeedNum))")
    wide = ", ".join(f"max(CASE WHEN Round = {k} THEN {c} END) AS {c}R{k}" for c in PATHS for k in range(1, 7))
    joins.append(f"LEFT JOIN (SELECT Season, TeamID, {wide} FROM ({_of('seed_path_features')}) x GROUP BY 1, 2) w ON w.Season = b.Season AND w.TeamID = b.TeamID")
    cols += ["s.SeedNum", "CASE WHEN t.TeamID IS NULL THEN 1 ELSE 0 END AS SeedImputed", "CAST(greatest(1, least(17, s.SeedNum)) AS INT) AS SeedBucket", "round(coalesce(r.SeedPriorExpectedWins, 0), 6) AS SeedPriorExpectedWins", "round(coalesce(r.SeedPriorWinPct, 0), 6) AS SeedPriorWinPct"]
    for c in PATHS:
        cols += [f"coalesce(w.{c}R{k}, 0) AS {c}R{k}" for k in range(1, 7)]
        cols += [f"round(coalesce((coalesce(w.{c}R{i}, 0) + coalesce(w.{c}R{j}, 0)) / nullif((w.{c}R{i} IS NOT NULL)::INT + (w.{c}R{j} IS NOT NULL)::INT, 0), 0), 6) AS {c}{stage}" for stage, (i, j) in C.STAGES.items()]
    late = {"MomentumWinRate": ("Last10WinRate", "WinRate"), "MomentumMargin": ("Last10Margin", "AvgMargin"), "Momentum30WinRate": ("Last30WinRate", "WinRate"), "Momentum30Margin": ("Last30Margin", "AvgMargin")}
    late |= {f"{new}{c}": (f"{old}{c}", c) for new, old in (("Momentum", "RecentEff"), ("Momentum30", "Recent30Eff")) for c in ("NetRtg", "NetRtg_z", "AdjNetRtg", "AdjNetRtg_z")}
    cols += [f"round({of[a]} - {of[z]}, 6) AS {n}" for n, (a, z) in late.items()]
    return f"SELECT {', '.join(cols)} FROM {' '.join(joins)}"


@query("team_features", _sql())
def team_features(spark, sf_dir):
    parts = [QUERIES[name](spark, sf_dir).select(*KEY, *names) for name, names in PARTS.items()]
    base = view(spark, sf_dir, "rating").withColumn("League", F.when(F.col("TeamID") % 2 == 0, "M").otherwise("W"))
    paths = C.path_columns(QUERIES["seed_path_features"](spark, sf_dir), ["League", "Season"])
    return rounded(C.team_features(base, parts, some_seeds(spark, sf_dir), QUERIES["seed_priors"](spark, sf_dir), paths).drop("League"))
