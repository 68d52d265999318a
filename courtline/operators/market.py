"""Quotes: orientation of pairs, standard forms, consensus, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import relational as R

PAIR = ["Season", "T1", "T2"]


def canonicalize_pairs(df: DataFrame, swap: tuple[tuple[str, str], ...] = (), complement: tuple[str, ...] = (), negate: tuple[str, ...] = ()) -> DataFrame:
    """T1 < T2: where it is not, sided columns are swapped, probabilities complemented and spreads negated."""
    flip = F.col("T1") > F.col("T2")
    out = {"T1": F.least("T1", "T2"), "T2": F.greatest("T1", "T2")}
    for a, b in swap:
        out |= {a: F.when(flip, F.col(b)).otherwise(F.col(a)), b: F.when(flip, F.col(a)).otherwise(F.col(b))}
    out |= {c: F.when(flip, F.lit(1.0) - F.col(c)).otherwise(F.col(c)) for c in complement if c in df.columns}
    out |= {c: F.when(flip, -F.col(c)).otherwise(F.col(c)) for c in negate if c in df.columns}
    return df.select(*(out[c].alias(c) if c in out else F.col(c) for c in df.columns))


def choose_probability(existing: Column, corrected: Column, mode: str, live: Column) -> Column:
    """The quoted or the bias-corrected probability, as the mode prefers."""
    modes = {"goto_only": corrected, "goto_prefer": F.coalesce(corrected, existing), "existing_prefer": F.coalesce(existing, corrected), "existing_live_goto": F.when(live, F.coalesce(corrected, existing)).otherwise(existing)}
    return modes[mode]


def market_standardize(quotes: DataFrame, existing: Column, mode: str, live_from: int, odds: tuple[str, str] = ("Team1DecimalOdds", "Team2DecimalOdds")) -> DataFrame:
    """Pair means of the chosen probability (0.5 where unknown) and spread, with logit and |p - 0.5|."""
    p = choose_probability(existing, F.col("_corrected"), mode, F.col("Season") >= live_from)
    rows = X.with_bias_corrected_prob(quotes, *odds, "_corrected").select(*PAIR, X.clip_prob(F.coalesce(p, F.lit(0.5))).alias("MarketProb"), "LastSpread")
    means = canonicalize_pairs(rows, complement=("MarketProb",), negate=("LastSpread",)).groupBy(*PAIR).agg(F.avg("MarketProb").alias("MarketProb"), F.avg("LastSpread").alias("LastSpread"))
    return means.withColumns({"MarketLogit": X.logit("MarketProb"), "MarketConfidence": F.abs(F.col("MarketProb") - 0.5)})


def market_mean(markets: DataFrame) -> DataFrame:
    """Means over sources of already standard pair rows."""
    names = ("MarketProb", "MarketLogit", "MarketConfidence", "LastSpread")
    return markets.groupBy(*PAIR).agg(*(F.avg(c).alias(c) for c in names)).withColumn("AbsLastSpread", F.abs("LastSpread"))


def market_fill(quotes: DataFrame) -> DataFrame:
    """MarketProb from the quoted probability, decimal odds, money lines or NoVigProb, whichever is there first; books counted."""
    have = set(quotes.columns)
    num = lambda c: X.number(c) if c in have else F.lit(None).cast("double")
    share = lambda a, b: F.try_divide(a, a + b)
    decimal = share(X.decimal_to_prob(num("Team1DecimalOdds")), X.decimal_to_prob(num("Team2DecimalOdds")))
    american = share(X.american_to_prob(num("Team1Moneyline")), X.american_to_prob(num("Team2Moneyline")))
    books = [X.count_distinct_tokens(c).cast("double") for c in ("Book", "Bookmakers", "BookmakersUsed", "BookTitle") if c in have]
    filled = {"MarketProb": F.coalesce(num("MarketProb"), decimal, american, num("NoVigProb")), "LastSpread": num("LastSpread"), "BookCount": F.coalesce(num("BookCount"), *books), "Source": F.coalesce(F.col("Source"), F.lit("unknown")) if "Source" in have else F.lit("unknown")}
    return R.drop_missing_keys(quotes.withColumns(filled), PAIR)


def _latest(column: str, *order: Column) -> Column:
    """The last non-null value; a row without time counts as the newest."""
    return R.last_non_null(column, F.col("SnapshotTime").isNull(), F.col("SnapshotTime"), *order)


def market_consensus(quotes: DataFrame, *tie: str) -> DataFrame:
    """One row a pair: the latest probability and spread, their means, medians and deviations, books and sources."""
    order = [F.col("Source"), *(F.col(t) for t in tie)]
    p = F.col("MarketProb")
    out = quotes.groupBy(*PAIR).agg(
        _latest("MarketProb", *order).alias("MarketProb"),
        _latest("LastSpread", *order).alias("LastSpread"),
        F.avg(p).alias("MarketProbMean"),
        F.median(p).alias("MarketProbMedian"),
        F.stddev_pop(p).alias("MarketProbStd"),
        F.avg("LastSpread").alias("SpreadMean"),
        F.median("LastSpread").alias("SpreadMedian"),
        F.stddev_pop("LastSpread").alias("SpreadStd"),
        F.avg("BookCount").alias("BookCountMean"),
        F.max("BookCount").alias("BookCountMax"),
        F.sum("BookCount").alias("BookCountTotal"),
        F.count("*").alias("MarketRowCount"),
        F.countDistinct("Source").alias("MarketSourceCount"),
    )
    return out.withColumns({"MarketLogit": X.logit("MarketProb"), "MarketConfidence": F.abs(F.col("MarketProb") - 0.5) * 2, "AbsLastSpread": F.abs("LastSpread")})


def model_consensus(rows: DataFrame, *tie: str) -> DataFrame:
    """As market_consensus, but with the values of the latest row, null or not."""
    order = F.struct(F.col("SnapshotTime").isNull(), "SnapshotTime", "Source", *tie)
    last = F.max_by(F.struct("ModelProb", "ModelSpread", "Source"), order)
    out = rows.groupBy(*PAIR).agg(
        last.alias("_last"),
        F.avg("ModelProb").alias("ModelMatchupProbMean"),
        F.median("ModelProb").alias("ModelMatchupProbMedian"),
        F.stddev_pop("ModelProb").alias("ModelMatchupProbStd"),
        F.avg("ModelSpread").alias("ModelMatchupSpreadMean"),
        F.countDistinct("Source").alias("ModelSourceCount"),
        F.count("*").alias("ModelRowCount"),
        R.sorted_concat("Source").alias("ModelSourceList"),
    )
    return out.select(*PAIR, F.col("_last.ModelProb").alias("ModelMatchupProb"), F.col("_last.ModelSpread").alias("ModelMatchupSpread"), F.col("_last.Source").alias("Source"), *out.columns[4:])


def spread_curve(lines: DataFrame, spread: str, won: str, weight: str) -> DataFrame:
    """Weighted win rate of every closing spread."""
    return lines.where(F.col(spread).isNotNull()).groupBy(F.col(spread).alias("Spread")).agg(R.weighted_mean(F.col(won), F.col(weight)).alias("WinPct"), F.sum(weight).alias("Games"))


def flatten_events(events: DataFrame, column: str = "event") -> DataFrame:
    """Nested event snapshots to a row for each event and book: head-to-head prices and the home spread.

    The column holds JSON text; unknown markets, one-sided outcomes and empty books leave nulls.
    """
    schema = "struct<id:string,home_team:string,away_team:string,bookmakers:array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>>"
    parsed = events.select(F.from_json(column, schema).alias("e")).where("e.id is not null")
    books = parsed.select("e.id", "e.home_team", "e.away_team", F.explode_outer("e.bookmakers").alias("b"))
    outcome = lambda market, team, field: F.get(F.filter(F.flatten(F.transform(F.filter("b.markets", lambda m: m["key"] == market), lambda m: m["outcomes"])), lambda o: o["name"] == F.col(team)), F.lit(0))[field]
    return books.select(F.col("id"), "home_team", "away_team", F.col("b.key").alias("book"), outcome("h2h", "home_team", "price").alias("home_price"), outcome("h2h", "away_team", "price").alias("away_price"), outcome("spreads", "home_team", "point").alias("home_spread"))


def prediction_contracts(rows: DataFrame) -> DataFrame:
    """Two-sided probabilities of contract rows: the midpoint of bid and ask, else the last price, else the one quote.

    rows: event, side (1 or 2), bid, ask, last. A missing side is one minus the other; both are
    made to add up and kept within 0.001 and 0.999.
    """
    price = F.coalesce((F.col("bid") + F.col("ask")) / 2, "last", "bid", "ask")
    sides = rows.groupBy("event").agg(*(F.avg(F.when(F.col("side") == i, price)).alias(f"q{i}") for i in (1, 2)))
    full = sides.withColumns({"p1": F.coalesce("q1", F.lit(1.0) - F.col("q2")), "p2": F.coalesce("q2", F.lit(1.0) - F.col("q1"))}).where("p1 is not null")
    return full.select("event", F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.try_divide(F.col("p1"), F.col("p1") + F.col("p2")))).alias("p1"))
