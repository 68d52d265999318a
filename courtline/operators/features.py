"""Strength features of a (Season, TeamID): form, efficiency, schedule, ranks, tenure, priors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relational as R

KEY = ["Season", "TeamID"]
BOX = ("FGM", "FGA", "FGM3", "FGA3", "FTM", "FTA", "OR", "DR", "Ast", "TO", "Stl", "Blk")
RATES = ("OffRtg", "DefRtg", "Poss", "FGPct", "FG3Pct", "FTPct", "OR", "DR", "Ast", "TO", "Stl", "Blk", "Margin", "eFG", "TOVPct", "FTR", "ORBPct", "AdjOffRtg", "AdjDefRtg", "OppEFG", "OppTOVPct", "OppFTR", "OppORBPct")
#: Output names where they differ from the log's.
RENAMED = {"Poss": "Tempo", "Margin": "AvgMargin"}


def compact_game_log(games: DataFrame) -> DataFrame:
    """Two rows a contest, from one scan: winner and loser with points, result, home flag and margin."""
    has_place = "WLoc" in games.columns

    def side(a: str, b: str, win: float, home: str) -> Column:
        fields = [F.col(f"{a}TeamID").alias("TeamID"), F.col(f"{b}TeamID").alias("OppID"), F.col(f"{a}Score").alias("Pts"), F.col(f"{b}Score").alias("OppPts"), F.lit(win).alias("Win")]
        if has_place:
            fields.append((F.col("WLoc") == home).cast("int").alias("IsHome"))
        return F.struct(*fields, (F.col(f"{a}Score") - F.col(f"{b}Score")).alias("Margin"))

    kept = [c for c in ("GameID", "League", "Season", "DayNum") if c in games.columns]
    return games.select(*kept, F.inline(F.array(side("W", "L", 1.0, "H"), side("L", "W", 0.0, "A"))))


def detailed_game_log(games: DataFrame) -> DataFrame:
    """Two rows a box score with the rates of a possession game; adjusted ratings come from adjusted_efficiency."""
    poss = lambda s: F.greatest(F.col(f"{s}FGA") - F.col(f"{s}OR") + F.col(f"{s}TO") + F.col(f"{s}FTA") * 0.475, F.lit(1.0))

    def side(a: str, b: str, win: float, home: str) -> Column:
        named = [F.col(f"{a}TeamID").alias("TeamID"), F.col(f"{b}TeamID").alias("OppID"), F.col(f"{a}Score").alias("Pts"), F.col(f"{b}Score").alias("OppPts"), F.lit(win).alias("Win")]
        if "WLoc" in games.columns:
            named.append((F.col("WLoc") == home).cast("int").alias("IsHome"))
        named += [poss(a).alias("Poss"), poss(b).alias("OppPoss")]
        named += [F.col(f"{a}{c}").alias(c) for c in BOX] + [F.col(f"{b}{c}").alias(f"Opp{c}") for c in ("FGM", "FGA", "FGM3", "FTA", "OR", "DR", "TO")]
        return F.struct(*named)

    kept = [c for c in ("GameID", "League", "Season", "DayNum") if c in games.columns]
    log = games.select(*kept, F.inline(F.array(side("W", "L", 1.0, "H"), side("L", "W", 0.0, "A"))))
    per = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1))
    efg = lambda o: (F.col(f"{o}FGM") + F.col(f"{o}FGM3") * 0.5) / F.greatest(F.col(f"{o}FGA"), F.lit(1))
    return log.withColumns(
        {
            "OffRtg": F.col("Pts") * 100.0 / F.col("Poss"),
            "DefRtg": F.col("OppPts") * 100.0 / F.col("OppPoss"),
            "FGPct": per("FGM", "FGA"),
            "FG3Pct": per("FGM3", "FGA3"),
            "FTPct": per("FTM", "FTA"),
            "Margin": F.col("Pts") - F.col("OppPts"),
            "eFG": efg(""),
            "TOVPct": per("TO", "Poss"),
            "FTR": per("FTA", "FGA"),
            "ORBPct": F.col("OR") / F.greatest(F.col("OR") + F.col("OppDR"), F.lit(1)),
            "OppEFG": efg("Opp"),
            "OppTOVPct": per("OppTO", "OppPoss"),
            "OppFTR": per("OppFTA", "OppFGA"),
            "OppORBPct": F.col("OppOR") / F.greatest(F.col("OppOR") + F.col("DR"), F.lit(1)),
        }
    )


def adjusted_efficiency(log: DataFrame) -> DataFrame:
    """Game ratings corrected by how far the opponent's season is from the mean of all teams' seasons."""
    season = log.groupBy(*KEY).agg(F.avg("OffRtg").alias("_off"), F.avg("DefRtg").alias("_def"))
    w = Window.partitionBy("Season")
    opponent = season.select("Season", F.col("TeamID").alias("OppID"), (F.avg("_def").over(w) - F.col("_def")).alias("_more_off"), (F.avg("_off").over(w) - F.col("_off")).alias("_more_def"))
    out = log.join(opponent, ["Season", "OppID"], "left").withColumns({"AdjOffRtg": F.col("OffRtg") + F.col("_more_off"), "AdjDefRtg": F.col("DefRtg") + F.col("_more_def")})
    return out.withColumn("AdjNetRtg", F.col("AdjOffRtg") - F.col("AdjDefRtg")).drop("_more_off", "_more_def")


def season_efficiency(log: DataFrame, prefix: str = "", neutral: bool = False) -> DataFrame:
    """Season means of the rates, net ratings and their z-scores.

    With `neutral`, z-scores of the games a team did not play at home are added, away games
    included.
    """
    rates = [c for c in RATES if c in log.columns]
    away = F.col("IsHome") == 0
    sums = [F.count("Win").alias("Games"), F.avg("Win").alias("WinRate"), *(F.avg(c).alias(RENAMED.get(c, c)) for c in rates)]
    if neutral:
        sums += [(F.avg(F.when(away, F.col(f"{k}OffRtg"))) - F.avg(F.when(away, F.col(f"{k}DefRtg")))).alias(f"_Neutral{k}NetRtg") for k in ("", "Adj")]
    out = log.groupBy(*KEY).agg(*sums).withColumn("NetRtg", F.col("OffRtg") - F.col("DefRtg"))
    scored = ["OffRtg", "DefRtg", "NetRtg"]
    if "AdjOffRtg" in rates:
        out = out.withColumn("AdjNetRtg", F.col("AdjOffRtg") - F.col("AdjDefRtg"))
        scored += ["AdjOffRtg", "AdjDefRtg", "AdjNetRtg"]
    out = out.withColumns({f"{c}_z": R.zscore(c) for c in scored} | ({f"Neutral{k}NetRtg_z": R.zscore(f"_Neutral{k}NetRtg") for k in ("", "Adj")} if neutral else {}))
    out = out.drop("_NeutralNetRtg", "_NeutralAdjNetRtg")
    return out.select(*KEY, *(F.col(c).alias(f"{prefix}{c}") for c in out.columns if c not in KEY))


def win_rate(log: DataFrame) -> DataFrame:
    return log.groupBy(*KEY).agg(F.avg("Win").alias("WinRate"), F.avg("Margin").alias("AvgMargin"), F.count("Win").alias("Games"))


def recent_form(log: DataFrame, n: int = 15, decay: float = 0.14) -> DataFrame:
    weight = F.exp(-decay * (F.col("_rn") - 1))
    mean = lambda c: F.sum(F.col(c) * weight) / F.sum(weight)
    return R.last_n(log, n, KEY).groupBy(*KEY).agg(mean("Win").alias("RecentWinRate"), mean("Margin").alias("RecentMargin"))


def with_opponent(log: DataFrame, rating: DataFrame, value: str = "Rating") -> DataFrame:
    """The log with the opponent's rating and its rank in the season (ties by TeamID)."""
    w = Window.partitionBy("Season").orderBy(F.desc(value), "TeamID")
    opponent = rating.select("Season", F.col("TeamID").alias("OppID"), F.col(value).alias("OppRating"), F.row_number().over(w).alias("OppRank"))
    return log.join(opponent, ["Season", "OppID"], "left")


def recent_quality(log: DataFrame, rating: DataFrame, n: int = 10, close: int = 5, tops: tuple[int, ...] = (50, 100)) -> DataFrame:
    """Last-n means, close games, and games and wins against the best, from one pass over ranked games."""
    games = with_opponent(log, rating).withColumn("_rn", R.recency(KEY))
    recent, tight = F.col("_rn") <= n, F.abs("Margin") <= close
    aggs = [F.avg(F.when(recent, F.col(c))).alias(f"Last{n}{k}") for c, k in (("Win", "WinRate"), ("Margin", "Margin"), ("OppRating", "SOS"))]
    aggs += [F.avg(F.when(tight, F.col("Win"))).alias("CloseGameWinRate"), F.nullif(F.count(F.when(tight, 1)), F.lit(0)).alias("CloseGameCount"), F.avg(F.when(tight, F.col("Margin"))).alias("CloseGameMargin")]
    for t in tops:
        top = F.coalesce(F.col("OppRank") <= t, F.lit(False))
        aggs += [F.count(F.when(top, 1)).alias(f"Top{t}Games"), F.count(F.when(top & (F.col("Win") == 1), 1)).alias(f"Top{t}Wins"), F.avg(F.when(top, F.col("Win"))).alias(f"Top{t}WinRate")]
    return games.groupBy(*KEY).agg(*aggs)


def recent_quality_days(log: DataFrame, rating: DataFrame, days: int = 30, close: int = 5, top: int = 50) -> DataFrame:
    games = R.lookback_days(with_opponent(log, rating), days)
    tight, best = F.abs("Margin") <= close, F.coalesce(F.col("OppRank") <= top, F.lit(False))
    p = f"Last{days}"
    return games.groupBy(*KEY).agg(
        F.avg("Win").alias(f"{p}WinRate"),
        F.avg("Margin").alias(f"{p}Margin"),
        F.avg("OppRating").alias(f"{p}SOS"),
        F.avg(F.when(tight, F.col("Win"))).alias(f"{p}CloseWinRate"),
        F.nullif(F.count(F.when(tight, 1)), F.lit(0)).alias(f"{p}CloseCount"),
        F.count(F.when(best, 1)).alias(f"{p}Top{top}Games"),
        F.count(F.when(best & (F.col("Win") == 1), 1)).alias(f"{p}Top{top}Wins"),
        F.avg(F.when(best, F.col("Win"))).alias(f"{p}Top{top}WinRate"),
    )


def strength_of_schedule(log: DataFrame, rating: DataFrame, value: str = "Rating") -> DataFrame:
    opponent = rating.select("Season", F.col("TeamID").alias("OppID"), F.col(value).alias("_r"))
    return log.join(opponent, ["Season", "OppID"], "left").groupBy(*KEY).agg(F.avg("_r").alias("SOS"))


def rpi_metrics(log: DataFrame) -> DataFrame:
    """Own, opponents' and opponents' opponents' win rates; opponents' games against the team itself don't count."""
    pair = log.groupBy(*KEY, "OppID").agg(F.count("*").alias("n"), F.sum("Win").alias("w"))
    team = pair.groupBy(*KEY).agg(F.sum("n").alias("tn"), F.sum("w").alias("tw"))
    opponent = team.select("Season", F.col("TeamID").alias("OppID"), F.col("tn").alias("on"), F.col("tw").alias("ow"))
    met = pair.join(opponent, ["Season", "OppID"])  # the opponent's record against the team is the mirror of the pair
    share = F.try_divide(F.col("ow") - (F.col("n") - F.col("w")), F.col("on") - F.col("n"))
    owp = met.withColumn("s", share).groupBy(*KEY).agg(F.try_divide(F.sum(F.col("s") * F.col("n")), F.sum(F.when(F.col("s").isNotNull(), F.col("n")))).alias("OWP"))
    far = pair.join(owp.select("Season", F.col("TeamID").alias("OppID"), F.col("OWP").alias("o")), ["Season", "OppID"], "left")
    oowp = far.groupBy(*KEY).agg(F.try_divide(F.sum(F.col("o") * F.col("n")), F.sum(F.when(F.col("o").isNotNull(), F.col("n")))).alias("OOWP"))
    joined = team.withColumn("_rate", F.col("tw") / F.greatest("tn", F.lit(1))).join(owp, KEY, "left").join(oowp, KEY, "left")
    filled = joined.withColumn("OWP", F.coalesce("OWP", "_rate")).withColumn("OOWP", F.coalesce("OOWP", "OWP"))
    return filled.select(*KEY, "OWP", "OOWP", (F.col("_rate") * 0.25 + F.col("OWP") * 0.5 + F.col("OOWP") * 0.25).alias("RPIStyle"), (F.col("OWP") * 0.5 + F.col("OOWP") * 0.5).alias("RPIStyleSOS"))


def conf_tourney_wins(games: DataFrame) -> DataFrame:
    return games.groupBy("Season", F.col("WTeamID").alias("TeamID")).agg(F.count("*").alias("ConfTourneyWins"))


def conference_strength(log: DataFrame, conferences: DataFrame, rating: DataFrame, value: str = "Rating") -> DataFrame:
    """Record of a team's conference against others, its mean rating and size, for every team."""
    lookup = conferences.select(*KEY, "ConfAbbrev").distinct()
    games = log.join(lookup, KEY).join(lookup.select("Season", F.col("TeamID").alias("OppID"), F.col("ConfAbbrev").alias("_other")), ["Season", "OppID"]).where("ConfAbbrev <> _other")
    record = games.groupBy("Season", "ConfAbbrev").agg(F.avg("Win").alias("ConfNonConfWinRate"), F.avg("Margin").alias("ConfNonConfAvgMargin"), F.count("*").alias("ConfNonConfGames"))
    strength = lookup.join(rating.select(*KEY, F.col(value).alias("_r")), KEY, "left").groupBy("Season", "ConfAbbrev").agg(F.avg("_r").alias("ConfMeanRating"), F.countDistinct("TeamID").alias("ConfTeamCount"))
    return lookup.join(record, ["Season", "ConfAbbrev"], "left").join(strength, ["Season", "ConfAbbrev"], "left")


def tenure_features(coaches: DataFrame) -> DataFrame:
    """Tenure and change of the coach with most days (ties by name), and how many there were."""
    days = F.greatest(F.col("LastDayNum") - F.col("FirstDayNum") + 1, F.lit(1))
    spans = coaches.groupBy(*KEY, "CoachName").agg(F.sum(days).alias("d"))
    primary = R.keep_last(spans, KEY, F.desc("d"), F.col("CoachName"))
    runs = R.streaks(primary, "TeamID", "Season", "CoachName").select(*KEY, F.col("Streak").alias("CoachTenure"), F.col("Changed").alias("CoachChange"))
    counts = spans.groupBy(*KEY).agg(F.count("*").alias("CoachCount"))
    return runs.join(counts, KEY).withColumn("CoachMidseasonChange", (F.col("CoachCount") > 1).cast("int"))


def _latest_ranks(ordinals: DataFrame, day: int, skip: tuple[str, ...]) -> DataFrame:
    used = ordinals.where(~F.col("SystemName").isin(*skip)) if skip else ordinals
    latest = R.join_asof_latest(used, [*KEY, "SystemName"], "RankingDayNum", day, ["OrdinalRank"])
    return latest.withColumn("Pct", R.rank_pct_average("OrdinalRank", "Season", "SystemName"))


def rank_consensus(ordinals: DataFrame, key_systems: tuple[str, ...], day: int = 133, skip: tuple[str, ...] = ()) -> DataFrame:
    """Mean, deviation (0 for one system) and best of the latest percentile ranks, and key systems' ranks as columns."""
    latest = _latest_ranks(ordinals, day, skip)
    keyed = [F.avg(F.when(F.col("SystemName") == s, F.col("OrdinalRank"))).alias(f"Rank_{s}") for s in key_systems]
    return latest.groupBy(*KEY).agg(F.avg("Pct").alias("RankMean"), F.coalesce(F.stddev_samp("Pct"), F.lit(0.0)).alias("RankStd"), F.min("Pct").alias("RankMin"), *keyed)


def rank_momentum(ordinals: DataFrame, day: int = 133, lookback: int = 14, skip: tuple[str, ...] = ()) -> DataFrame:
    now = _latest_ranks(ordinals, day, skip).select(*KEY, "SystemName", F.col("Pct").alias("now"))
    before = _latest_ranks(ordinals, day - lookback, skip).select(*KEY, "SystemName", F.col("Pct").alias("before"))
    return now.join(before, [*KEY, "SystemName"]).groupBy(*KEY).agg(F.avg(F.col("before") - F.col("now")).alias("RankMomentum"))


def seed_number(seeds: DataFrame) -> DataFrame:
    return seeds.withColumn("SeedNum", F.regexp_extract("Seed", r"(\d+)", 1).try_cast("int")).where("SeedNum is not null")


def seed_priors(tourney: DataFrame, seeds: DataFrame, by: list[str] = ["League", "Season"]) -> DataFrame:  # noqa: B006
    """Expected wins and win rate of a seed from earlier seasons only; 0 before there is any."""
    league = [c for c in by if c != "Season"]
    ranked = seed_number(seeds).withColumn("SeedBucket", F.greatest(F.lit(1), F.least(F.lit(16), F.col("SeedNum"))))
    grid = seeds.select(*by).distinct().withColumn("SeedBucket", F.explode(F.sequence(F.lit(1), F.lit(16))))
    teams = ranked.groupBy(*by, "SeedBucket").agg(F.count("*").alias("n"))
    sides = tourney.select(*by, F.inline(F.array(F.struct(F.col("WTeamID").alias("TeamID"), F.lit(1).alias("win")), F.struct(F.col("LTeamID").alias("TeamID"), F.lit(0).alias("win")))))
    played = sides.join(ranked.select(*by, "TeamID", "SeedBucket"), [*by, "TeamID"]).groupBy(*by, "SeedBucket").agg(F.count("*").alias("g"), F.sum("win").alias("w"))
    rows = grid.join(teams, [*by, "SeedBucket"], "left").join(played, [*by, "SeedBucket"], "left").fillna(0, ["n", "g", "w"])
    before = lambda c: R.prior_sum(c, [*league, "SeedBucket"], "Season")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    prior = rows.withColumns({f"_{c}": before(c) for c in ("n", "g", "w")})
    return prior.select(*by, "SeedBucket", share(F.col("_w"), F.col("_n")).alias("SeedPriorExpectedWins"), share(F.col("_w"), F.col("_g")).alias("SeedPriorWinPct"))


def impute_seeds(teams: DataFrame, strength: str, ascending: bool = False, period: list[str] = ["Season"]) -> DataFrame:  # noqa: B006
    """Missing seeds from the rank among all teams of the period: four to a seed, 17 beyond the 64th."""
    order = F.col(strength).asc_nulls_last() if ascending else F.col(strength).desc_nulls_last()
    rank = F.row_number().over(Window.partitionBy(*period).orderBy(order, "TeamID"))
    guess = F.when(rank <= 64, F.least(F.ceil(rank / 4), F.lit(16))).otherwise(17).cast("int")
    return teams.withColumn("_guess", guess).withColumn("SeedNum", F.coalesce("SeedNum", "_guess")).drop("_guess")


def external_composite(tables: list[DataFrame], negative: tuple[str, ...] = ("rank", "def")) -> DataFrame:
    """Full join of rating tables; z-scores by season, turned so that more is better, and their mean."""
    named = [t.select(*KEY, *(F.col(c).cast("double").alias(c if c.startswith("Ext_") else f"Ext_{c}") for c in t.columns if c not in KEY)) for t in tables]
    joined = reduce(lambda a, b: a.join(b, KEY, "full_outer"), named)
    cols = [c for c in joined.columns if c not in KEY]
    out = joined.withColumns({f"{c}_z": R.zscore(c) for c in cols})
    signed = [F.col(f"{c}_z") * (-1.0 if any(t in c.lower() for t in negative) else 1.0) for c in cols]
    total = reduce(lambda a, b: a + b, (F.coalesce(s, F.lit(0.0)) for s in signed))
    count = reduce(lambda a, b: a + b, (s.isNotNull().cast("int") for s in signed))
    return out.withColumn("ExtCompositeStrength", F.try_divide(total, count))


def recent_vectors(docs: DataFrame, short: int = 3, long: int = 5) -> DataFrame:
    """Per team: documents, those in the window, mean vector of the last `short` and `long`, and a mean weighted 1 to 2 towards the latest.

    docs: Season, TeamID, vec_id (the order), vector (doubles; its length is the data's, shorter ones
    count as zeros at the end). Only the last `long` vectors of a team are put together; null vectors are left out.
    """
    w = Window.partitionBy(*KEY).orderBy(F.desc("vec_id"))
    known = docs.where("vector is not null").select(*KEY, "vec_id", "vector")
    ranked = known.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*KEY))).where(F.col("_rn") <= long)
    size = F.least("_n", F.lit(long))
    weight = F.when(size > 1, F.lit(2.0) - (F.col("_rn") - 1) / (size - 1)).otherwise(1.0)
    rows = ranked.groupBy(*KEY).agg(F.max("_n").alias("DocCount"), F.count("*").alias("WindowDocCount"), F.array_sort(F.collect_list(F.struct("_rn", weight.alias("w"), "vector"))).alias("_v"))

    def mean(some: Column, use: Callable[[Column], Column]) -> Column:
        total = F.aggregate(some, F.array().cast("array<double>"), lambda a, x: F.zip_with(a, x["vector"], lambda s, v: F.coalesce(s, F.lit(0.0)) + F.coalesce(v, F.lit(0.0)) * use(x)))
        return F.transform(total, lambda s: s / F.aggregate(some, F.lit(0.0), lambda a, x: a + use(x)))

    one = lambda _: F.lit(1.0)
    return rows.select(*KEY, "DocCount", "WindowDocCount", mean(F.slice("_v", 1, short), one).alias(f"Mean{short}"), mean(F.col("_v"), one).alias(f"Mean{long}"), mean(F.col("_v"), lambda x: x["w"]).alias(f"Weighted{long}"))
