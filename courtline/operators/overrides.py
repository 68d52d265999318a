"""Overrides of a scored table: who plays whom, why a pair is or isn't changed, how far, and what a person should look at."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relational as R

PAIR = ["Season", "T1", "T2"]
#: The largest change, the share of the way to the target, and the least gap that is worth a change or a look.
MOST_CHANGE, WEIGHT, LEAST_GAP, LEAST_LOOK, CLOSER = 0.12, 0.35, 0.07, 0.08, 0.03


def team_context(pairs: DataFrame, teams: DataFrame, seeds: DataFrame, watch: DataFrame, rounds: DataFrame) -> DataFrame:
    """Pairs (Season, T1, T2, ...) with league, names, seeds, availability and the round in which they can meet.

    teams: League, TeamID, TeamName; a pair is of league M if both sides are known there, else of W, else of '?'. seeds: League,
    Season, TeamID, Seed. watch: Season, TeamID, SeverityScore, OutCount, GTDCount (league M only). rounds:
    Season, T1, T2, Round. Each of these has one row for its key.
    """
    names = teams.groupBy("TeamID").agg(*(F.max(F.when(F.col("League") == g, F.col("TeamName"))).alias(f"_{g}") for g in "MW"))
    out = pairs
    for t in ("T1", "T2"):
        out = out.join(names.select(F.col("TeamID").alias(t), F.col("_M").alias(f"_{t}M"), F.col("_W").alias(f"_{t}W")), t, "left")
    known = lambda g: F.col(f"_T1{g}").isNotNull() & F.col(f"_T2{g}").isNotNull()
    out = out.withColumn("League", F.when(known("M"), "M").when(known("W"), "W").otherwise("?"))
    for n, t in ((1, "T1"), (2, "T2")):
        named = F.when(F.col("League") == "M", F.col(f"_{t}M")).otherwise(F.col(f"_{t}W"))
        side = seeds.select("League", "Season", F.col("TeamID").alias(t), F.col("Seed").alias(f"Team{n}Seed"))
        out = out.withColumn(f"Team{n}Name", F.coalesce(named, F.lit(""))).join(side, ["League", "Season", t], "left")
        out = out.withColumns({f"Team{n}SeedNum": F.regexp_extract(f"Team{n}Seed", r"(\d+)", 1).try_cast("int"), f"Team{n}InField": F.coalesce(F.col(f"Team{n}Seed") != "", F.lit(False))})
        out = out.join(watch.select("Season", F.col("TeamID").alias(t), *(F.col(c).alias(f"Team{n}_{c}") for c in ("SeverityScore", "OutCount", "GTDCount"))), ["Season", t], "left")
    hurt = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"Team{n}_SeverityScore") > 0, F.lit(False)) for n in (1, 2)))
    out = out.withColumns({"BothInField": F.col("Team1InField") & F.col("Team2InField"), "InjuryRisk": (F.col("League") == "M") & hurt}).join(rounds.select(*PAIR, "Round"), PAIR, "left")
    at = lambda r: F.coalesce(F.col("Round") == r, F.lit(False))
    return out.withColumns({"IsPlayIn": at(0), "IsRound1": at(1), "IsRound2": at(2)}).drop("_T1M", "_T1W", "_T2M", "_T2W")


def favourite(prob: Column, spread: Column) -> Column:
    """T1 or T2 by the market's probability, else by the spread; Unknown if both are even or missing."""
    return F.when(prob > 0.5, "T1").when(prob < 0.5, "T2").when(spread < 0, "T1").when(spread > 0, "T2").otherwise("Unknown")


def guarded(current: Column, target: Column, market: Column, spread: Column, model: Column, weight: float = WEIGHT, most: float = MOST_CHANGE) -> Column:
    """A bounded step from current towards target; only a game that is clear by market, spread or model may change sides."""
    safe = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    c = safe(current)
    step = F.greatest(F.lit(-most), F.least(F.lit(most), (safe(target) - c) * weight))
    bounded = safe(c + step)
    sure = lambda p: F.coalesce((p >= 0.80) | (p <= 0.20), F.lit(False))
    clear = sure(market) | F.coalesce(F.abs(spread) >= 6.0, F.lit(False)) | sure(model)
    return F.when(~clear & (c > 0.5) & (bounded < 0.5), 0.500001).when(~clear & (c < 0.5) & (bounded > 0.5), 0.499999).otherwise(bounded)


def first_reason(reasons: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first condition that holds; null conditions don't."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons), F.lit(otherwise))


def override_candidates(rows: DataFrame) -> DataFrame:
    """What would be changed in every pair, and the first reason why not.

    rows: the columns of team_context with Pred (the current score), Baseline, and the market's and model's
    MarketProb, Spread, ModelProb, SourceCount, BookCountMax, BookCountTotal, RowCount. Adds RealGameScope, Gap, TargetProb, AutoNewPred,
    AutoChange, AutoApply, AutoDecision and ManualEligible, ManualReason.
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    market, model, spread = c("MarketProb"), c("ModelProb"), c("Spread")
    seed = F.least("Team1SeedNum", "Team2SeedNum")
    scope = c("BothInField") & (yes(c("Round").isin(0, 1)) | (yes(c("Round") == 2) & (yes(seed <= 4) | c("InjuryRisk"))))
    books = F.greatest("BookCountMax", "BookCountTotal", "RowCount")
    consensus = yes(c("SourceCount") >= 2) & yes(books >= 3)
    agree = yes(favourite(market, F.lit(None)) == favourite(F.lit(None).cast("double"), spread)) & market.isNotNull() & spread.isNotNull() & (market != 0.5)
    aligned = yes(((model > 0.5) == (market > 0.5)) & (model != 0.5) & (market != 0.5))
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    out_of = lambda n: (zero(f"Team{n}_SeverityScore") >= 4) & ((zero(f"Team{n}_OutCount") >= 1) | (zero(f"Team{n}_GTDCount") >= 2))
    facts = {
        "RealGameScope": scope, "EffectiveBookCount": books, "MarketConsensusOK": consensus, "MarketSpreadConsistent": agree, "ModelAligned": aligned, "FavoriteSide": favourite(market, spread),
        "Gap": F.abs(c("Pred") - market), "BaselineCloser": yes(F.abs(c("Baseline") - market) + CLOSER < F.abs(c("Pred") - market)), "TargetProb": F.when(aligned, market * 0.7 + model * 0.3).otherwise(market),
    }
    known = rows.withColumns(facts)
    side = c("FavoriteSide")
    known = known.withColumns({"FavoriteInjured": (c("League") == "M") & (((side == "T1") & out_of(1)) | ((side == "T2") & out_of(2))), "_moved": guarded(c("Pred"), c("TargetProb"), market, spread, model)})
    towards = ((side == "T1") & (c("_moved") > c("Pred"))) | ((side == "T2") & (c("_moved") < c("Pred")))
    order = [
        ("OutOfScope", ~c("RealGameScope")), ("NoMarket", market.isNull()), ("LowMarketConsensus", ~c("MarketConsensusOK")), ("MarketSpreadConflict", ~c("MarketSpreadConsistent")),
        ("GapTooSmall", c("Gap").isNull() | (c("Gap") < LEAST_GAP)), ("ModelConflict", model.isNotNull() & ~c("ModelAligned")), ("MissingTarget", c("TargetProb").isNull()),
    ]
    known = known.withColumn("_failed", first_reason(order, "")).withColumn("AutoDecision", first_reason([*((n, c("_failed") == n) for n, _ in order), ("FavoriteInjuryVeto", c("FavoriteInjured") & towards)], "AutoApply"))
    known = known.withColumn("AutoNewPred", F.when(c("_failed") == "", c("_moved")).otherwise(c("Pred")))
    manual = c("RealGameScope") & market.isNotNull() & c("MarketSpreadConsistent") & yes(c("Gap") >= LEAST_LOOK) & (c("BaselineCloser") | c("ModelAligned")) & ~c("FavoriteInjured")
    why = F.when(c("BaselineCloser") & c("ModelAligned"), "BaselineAndModelAgainstCurrent").when(c("BaselineCloser"), "BaselineCloserToMarket").otherwise("ModelAlignedAgainstCurrent")
    return known.withColumns({"AutoChange": F.abs(c("AutoNewPred") - c("Pred")), "ManualEligible": manual, "ManualReason": F.when(manual, why)}).withColumn("AutoApply", (c("AutoDecision") == "AutoApply") & (c("AutoChange") > 1e-12)).drop("_moved", "_failed")


def manual_shortlist(candidates: DataFrame, key: str, by: Sequence[str] = ("Season",), most: int = 10) -> DataFrame:
    """The first `most` eligible pairs of each scope `by`: early rounds, then wide gaps, then many sources and books."""
    order = [F.coalesce("Round", F.lit(9)), F.desc_nulls_last("Gap"), F.desc_nulls_last("SourceCount"), F.desc_nulls_last("BookCountMax"), F.col(key)]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return candidates.where("ManualEligible").withColumn("Rank", rank).where(F.col("Rank") <= most)


def override_summary(candidates: DataFrame, by: Sequence[str] = ("Season",)) -> DataFrame:
    """Counts of a review for each scope."""
    n = lambda cond: F.count(F.when(cond, 1))
    a = F.col("AutoApply")
    return candidates.groupBy(*by).agg(F.count("*").alias("Rows"), n(F.col("RealGameScope")).alias("InScope"), n(a).alias("Applied"), n(a & F.col("IsPlayIn")).alias("AppliedPlayIn"), n(a & F.col("IsRound1")).alias("AppliedRound1"), n(a & F.col("IsRound2")).alias("AppliedRound2"), n(a & F.col("ModelAligned")).alias("AppliedModel"), n(F.col("ManualEligible")).alias("ManualEligible"))


def apply_auto(scored: DataFrame, candidates: DataFrame, manual: DataFrame, key: str = "ID") -> DataFrame:
    """The scored table with automatic changes, and manual ones (key, NewPred) before these."""
    from .release import apply_overrides

    return apply_overrides(scored, candidates.where("AutoApply").select(key, F.col("AutoNewPred").alias("NewPred")), R.keep_last(manual, [key], F.desc("NewPred")), key)


def review_checklist(rows: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """Which score is nearer to the market, why a pair is looked at, what to do and how urgent it is.

    rows: Pred, Baseline, MarketProb, SourceCount, BookCountMax, BookCountTotal, RowCount, BothInField, EarlyHost, InjuryRisk. Adds AbsPredDiff,
    CloserToMarket, ReviewEligible, ReviewReason, RecommendedAction and Priority.
    """
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0))
    flags = {n: F.coalesce(c(n), F.lit(False)) for n in ("BothInField", "EarlyHost", "InjuryRisk")}
    both, host, hurt = flags.values()
    own, other = F.abs(c("Pred") - c("MarketProb")), F.abs(c("Baseline") - c("MarketProb"))
    closer = F.when(c("MarketProb").isNull(), "NoMarket").when(own + tolerance < other, "Current").when(other + tolerance < own, "Baseline").otherwise("Tie")
    known = rows.withColumns({
        "AbsPredDiff": F.abs(c("Pred") - c("Baseline")), "CloserToMarket": closer, "ReviewEligible": both | host | hurt, "EffectiveBookCount": F.greatest("BookCountMax", "BookCountTotal", "RowCount"),
        "ReviewReason": F.concat_ws("|", *(F.when(f, n) for n, f in flags.items())), "RecommendedAction": F.when(closer == "Baseline", "CheckBaseline").when(closer == "Current", "KeepCurrent").otherwise("NeedContext"),
    })
    gap, sources = zero(c("AbsPredDiff")), zero(c("SourceCount"))
    critical = both & (c("CloserToMarket") == "Baseline") & (gap >= 0.08) & (sources >= 2) & (zero(c("EffectiveBookCount")) >= 2)
    high = (both & (gap >= 0.05) & (sources >= 1)) | (hurt & (gap >= 0.05)) | (host & (gap >= 0.03) & (sources >= 1))
    return known.withColumn("Priority", F.when(~c("ReviewEligible"), "Skip").when(critical, "Critical").when(high, "High").when(gap >= 0.03, "Medium").otherwise("Low"))


def recommend(counts: DataFrame) -> DataFrame:
    """Which of four tables to publish, from one row of counts for each scope.

    counts: Applied, Changed, InRounds, ModelSupported (overrides), RuntimeActive (live rules of weight), Opposed (urgent pairs in which the
    market is nearer to the baseline). Overrides if they are few, all in the rounds looked at and at least half backed by the model; else
    the live rules if any acted; else the baseline if it is backed three times; else the current one.
    """
    c = F.col
    share = F.when(c("Applied") > 0, c("ModelSupported") / c("Applied")).otherwise(F.lit(0.0))
    few = c("Changed").between(3, 12) & (c("InRounds") == c("Changed")) & (share >= 0.5)
    return counts.withColumns({"ModelShare": share, "Recommended": F.when(few, "overrides").when(c("RuntimeActive") > 0, "runtime").when(c("Opposed") >= 3, "baseline").otherwise("current")})
