"""Fusion of route probabilities: filled meta features, learned losses, a decision held as data, all season by season.

Every season is fitted and decided from earlier seasons of its league alone. The seasons and leagues are a
short list at the driver; what each fit reads stays distributed, and only model coefficients and one row of
scores for each fold come back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.files import checkpoint
from .compose import average, fill_routes, loss_weights, route_group_features, spread
from .models import linear, probability, trees
from .rules import Rule, mine_rules, rule_features

BY = ["League", "Season"]
MEAN = "ProbSimpleMean"
# What in a route's name puts it into a group.
GROUP_WORDS = {"market": ("market", "spread"), "stats": ("stats", "women_min", "fallback", "_et"), "legacy": ("legacy",), "text": ("text",), "tabpfn": ("tabpfn",)}
# Blends of group means that are candidates of their own, and the weights.
GROUP_BLENDS = {
    "Prob_market_stats_blend": {"market": 0.6, "stats": 0.4},
    "Prob_stats_market_blend": {"market": 0.35, "stats": 0.65},
    "Prob_legacy_stats_blend": {"legacy": 0.65, "stats": 0.35},
    "Prob_legacy_market_blend": {"legacy": 0.6, "market": 0.4},
    "Prob_market_text_blend": {"market": 0.7, "text": 0.3},
}


def grouped(columns: Sequence[str]) -> dict[str, list[str]]:
    return {g: [c for c in columns if any(w in c for w in words)] for g, words in GROUP_WORDS.items()}


def meta_features(df: DataFrame, columns: Sequence[str], context: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Filled routes with what a stacked model reads: flags, row statistics, groups and how far groups differ."""
    filled = fill_routes(df, columns)
    rows, names = route_group_features(filled, grouped(columns))
    several = len(columns) > 1
    least, most = (F.least(*columns), F.greatest(*columns)) if several else (F.col(columns[0]), F.col(columns[0]))
    rows = rows.withColumns({"ProbMean": average(columns), "ProbStd": spread(columns), "ProbMin": least, "ProbMax": most, "ProbRange": most - least, "ProbAvailableCount": reduce(lambda a, b: a + b, (F.col(f"{c}_avail") for c in columns))})
    gap = lambda a, b: F.col(f"{a}_mean") - F.col(f"{b}_mean")
    apart = {"MarketVsStats": gap("market", "stats"), "LegacyVsStats": gap("legacy", "stats"), "LegacyVsMarket": gap("legacy", "market"), "TextVsMarket": gap("text", "market"), "MarketVsTabPFN": gap("market", "tabpfn")}
    apart["RouteDisagreement"] = reduce(lambda a, b: a + b, (F.abs(gap(g, "stats")) for g in ("market", "legacy", "text", "tabpfn")))
    rows = rows.withColumns({"ProbFavoriteConfidence": F.abs(F.col("ProbMean") - 0.5) * 2} | apart | {f"Context_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in context})
    stats = ["ProbMean", "ProbStd", "ProbMin", "ProbMax", "ProbRange", "ProbFavoriteConfidence", "ProbAvailableCount"]
    return rows, [*columns, *(f"{c}_avail" for c in columns), *stats, *names, *apart, *(f"Context_{c}" for c in context)]


def simple_frame(filled: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Candidates that need no fit: the filled routes, their mean, group means and fixed blends of those."""
    present = {g: cols for g, cols in grouped(columns).items() if cols}
    rows = filled.withColumns({MEAN: average(columns)} | {f"Prob_{g}_mean": average(cols) for g, cols in present.items()})
    blends = {n: reduce(lambda a, b: a + b, (F.col(f"Prob_{g}_mean") * w for g, w in b.items())) for n, b in GROUP_BLENDS.items() if set(b) <= set(present)}
    return rows.withColumns(blends) if blends else rows, [*columns, MEAN, *(f"Prob_{g}_mean" for g in present), *blends]


def _squared(column: str) -> Column:
    return F.pow(X.clip_prob(F.coalesce(F.col(column), F.lit(0.5))) - F.col("Label"), 2)


def prior_choices(rows: DataFrame, candidates: Sequence[str], anchor: str | None = None, least_seasons: int = 1) -> DataFrame:
    """(League, Season, BestName, BestScore, AnchorScore): the candidate with the least Brier score over all earlier rows.

    One row for each season with `least_seasons` earlier ones; ties go to the candidate that is listed first.
    """
    order = {c: i for i, c in enumerate(candidates)}
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.lit(i).alias("at"), _squared(c).alias("loss")) for c, i in order.items())))
    sums = rows.select(*BY, "Label", each).where("loss is not null").groupBy(*BY, "name", "at").agg(F.sum("loss").alias("s"), F.count("*").alias("n"))
    before = Window.partitionBy("League", "name").orderBy("Season").rowsBetween(Window.unboundedPreceding, -1)
    prior = sums.select(*BY, "name", "at", (F.sum("s").over(before) / F.sum("n").over(before)).alias("score"), F.count("*").over(before).alias("seasons")).where(F.col("seasons") >= least_seasons)
    first = F.min_by(F.struct("name", "score"), F.struct(F.round("score", 9), F.col("at")))
    picked = prior.groupBy(*BY).agg(first.alias("b"), F.max(F.when(F.col("name") == anchor, F.col("score")) if anchor else F.lit(None).cast("double")).alias("AnchorScore"))
    return picked.select(*BY, F.col("b.name").alias("BestName"), F.col("b.score").alias("BestScore"), "AnchorScore")


# A decision as data


@dataclass(frozen=True)
class Branch:
    """Where `when` holds the probability becomes a mix of columns ("current" is what it was), then is kept within bounds.

    A branch that settles keeps later steps of `unsettled` rows away.
    """

    when: Column
    mix: dict[str, float]
    settles: bool = False
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Step:
    """The first branch that holds acts; `unsettled` steps pass over rows that an earlier step settled."""

    name: str
    branches: tuple[Branch, ...]
    unsettled: bool = False


def decide(df: DataFrame, start: Column, steps: Sequence[Step], out: str = "FinalProb") -> DataFrame:
    """Runs the steps in order, one projection each; adds the clipped result and DecidedBy, the last step that acted."""
    rows = df.withColumns({"_p": start, "_settled": F.lit(False), "DecidedBy": F.lit("start")})
    for step in steps:
        p, settled, by = F.col("_p"), F.col("_settled"), F.col("DecidedBy")
        for b in reversed(step.branches):
            value = reduce(lambda a, c: a + c, (F.col("_p" if c == "current" else c) * w for c, w in b.mix.items()))
            value = value if b.low is None else F.greatest(value, F.lit(b.low))
            value = value if b.high is None else F.least(value, F.lit(b.high))
            holds = F.coalesce(b.when & ~F.col("_settled") if step.unsettled else b.when, F.lit(False))
            p, settled, by = F.when(holds, value).otherwise(p), F.when(holds, F.col("_settled") | F.lit(b.settles)).otherwise(settled), F.when(holds, F.lit(step.name)).otherwise(by)
        rows = rows.withColumns({"_p": p, "_settled": settled, "DecidedBy": by})
    return rows.withColumn(out, X.clip_prob("_p")).drop("_p", "_settled")


@dataclass(frozen=True)
class Gates:
    """What the decision is made with; seasons in (from, to], None for a gate that is shut."""

    primary: tuple[float, float] = (0.35, 0.65)
    trust: float = 0.015
    margin: float = 0.01
    selector: tuple[int, int] | None = None
    boosted: tuple[int, int] | None = None
    linear: tuple[int, int] | None = None
    recent_linear: int = 2024
    recent_market: float = 0.40
    recent_selector: int = 2024
    overrides: dict[int, tuple[str, str, float]] = field(default_factory=dict)


def rule_steps(rules: Sequence[tuple[Rule, int, float, float]], least_edge: float = 0.08, most: int = 8) -> list[Step]:
    """Mined rules (rule, direction, edge, target mean) as bounds of rows that nothing settled: strong ones among the first `most`."""
    steps = []
    for rule, direction, edge, target in rules[:most]:
        target = min(max(target, 0.01), 0.999)
        if edge >= least_edge and direction > 0 and target >= 0.80:
            steps.append(Step(f"rule {rule.name}", (Branch(rule.mask(), {"current": 1.0}, low=min(0.999, target)),), unsettled=True))
        elif edge >= least_edge and direction < 0 and target <= 0.20:
            steps.append(Step(f"rule {rule.name}", (Branch(rule.mask(), {"current": 1.0}, high=max(0.001, target)),), unsettled=True))
    return steps


def _within(seasons: tuple[int, int] | None) -> Column:
    return F.lit(False) if seasons is None else F.col("Season").between(*seasons)


def league_steps(league: str, gates: Gates, anchor: str | None, specialist: str | None, rules: Sequence[Step] = ()) -> tuple[Column, list[Step]]:
    """Start and steps for a league. Read: BestProb, BestName, BestScore, AnchorScore, SelectorProb, LinearMetaProb, BoostedMetaProb.

    In league W the anchor, then recent seasons' selector, then a specialist for early games at a likely host;
    elsewhere the best candidate with the stacked models, held against the anchor by what both scored before.
    """
    has_anchor = F.lit(False) if anchor is None else F.col(anchor).isNotNull()
    override = tuple(Branch(F.col("Season") == s, {a: w, b: 1 - w} if a != b else {a: 1.0}, settles=True) for s, (a, b, w) in gates.overrides.items())
    if league == "W":
        steps = [Step("anchor", (Branch(has_anchor, {anchor: 1.0}, settles=True),))] if anchor else []
        steps.append(Step("recent selector", (*override, Branch(F.col("Season") >= gates.recent_selector, {"SelectorProb": 1.0}, settles=True))))
        steps += rules
        if specialist:
            early = F.col("MarketProb").isNotNull() & (F.col("D_HostLikely") >= 1) & (F.col("IsRound1Or2") >= 1)
            steps.append(Step("host specialist", (Branch(early, {specialist: 1.0}),)))
        return F.col("BestProb"), steps
    public = F.col("BestName").contains("market_public")
    best, held = F.coalesce("BestScore", F.lit(float("inf"))), F.col("AnchorScore")
    steps = [Step("best with models", (Branch(public, {"BestProb": 0.15, "LinearMetaProb": 0.85}, settles=True), Branch(F.lit(True), {"BestProb": 0.85, "current": 0.15})))]
    if anchor:
        ours = has_anchor & ~public
        steps.append(Step("anchor", (Branch(ours & (best + gates.trust < held), {"BestProb": 0.90, "current": 0.10}), Branch(ours & (held <= best + gates.margin), {anchor: 1.0}, settles=True), Branch(ours, {anchor: 0.60, "current": 0.40}))))
    for name, seasons, column in (("selector", gates.selector, "SelectorProb"), ("boosted", gates.boosted, "BoostedMetaProb"), ("linear", gates.linear, "LinearMetaProb")):
        steps.append(Step(name, (Branch(_within(seasons), {column: 1.0}, settles=True),)))
    if override:
        steps.append(Step("season override", override))
    steps += rules
    recent = public & (F.col("Season") >= gates.recent_linear) & (F.col("MarketProb") >= gates.recent_market)
    return F.col("LinearMetaProb") * gates.primary[0] + F.col("BoostedMetaProb") * gates.primary[1], [*steps, Step("recent linear", (Branch(recent, {"LinearMetaProb": 1.0}),))]


def with_best(rows: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """BestProb: the clipped value of the column that BestName names; the mean of all if it names none."""
    named = reduce(lambda rest, c: F.when(F.col("BestName") == c, F.col(c)).otherwise(rest), candidates, F.col(MEAN))
    return rows.withColumn("BestProb", X.clip_prob(F.coalesce(named, F.lit(0.5))))


def fusion_decision(rows: DataFrame, columns: Sequence[str], gates: dict[str, Gates], anchor: str | None = None, specialist: str | None = None, rules: dict[str, Sequence[Step]] | None = None, least_seasons: int = 1) -> DataFrame:
    """The final probability of rows that have SelectorProb, LinearMetaProb and BoostedMetaProb already.

    Each league's best candidate and the anchor's standing come from its earlier seasons; rows of a
    season without any have the mean of all routes as best. Adds BestName, BestScore, FinalProb and DecidedBy.
    """
    filled = fill_routes(rows, columns)
    frame, candidates = simple_frame(filled, columns)
    choices = prior_choices(frame, candidates, anchor, least_seasons)
    known = with_best(frame.join(choices, BY, "left").fillna({"BestName": MEAN}), candidates)  # a row for each league and season
    parts = []
    for league, g in gates.items():
        start, steps = league_steps(league, g, anchor, specialist, (rules or {}).get(league, ()))
        parts.append(decide(known.where(F.col("League") == league), start, steps))
    return reduce(DataFrame.unionByName, parts)


# Learned losses


def fit_losses(train: DataFrame, test: DataFrame, candidates: Sequence[str], features: list[str], depth: int = 4, least: int = 20) -> DataFrame:
    """test with Loss_<candidate>: the squared error that a regression tree on train's rows expects of it."""
    assemble = VectorAssembler(inputCols=features, outputCol="_x")
    known = checkpoint(assemble.transform(train).select("_x", *(_squared(c).alias(f"_l{i}") for i, c in enumerate(candidates))))
    scored = assemble.transform(test)
    for i, c in enumerate(candidates):
        model = DecisionTreeRegressor(featuresCol="_x", labelCol=f"_l{i}", predictionCol=f"_e{i}", maxDepth=depth, minInstancesPerNode=least, seed=7).fit(known)
        scored = model.transform(scored).withColumn(f"Loss_{c}", F.greatest(F.lit(1e-5), F.least(F.lit(1.0), F.col(f"_e{i}")))).drop(f"_e{i}")
    return scored.drop("_x")


def select_by_loss(rows: DataFrame, candidates: Sequence[str], top: int = 3) -> DataFrame:
    """SelectorProb: the blend of the candidates with the least expected losses."""
    mixed = loss_weights(rows, list(candidates), [f"Loss_{c}" for c in candidates], top)
    return mixed.withColumn("SelectorProb", X.clip_prob(F.coalesce("Selected", MEAN))).drop("Selected", *(f"Loss_{c}" for c in candidates))


def _folds(rows: DataFrame, least_seasons: int) -> list[tuple[str, int]]:
    """(league, season) pairs with enough earlier seasons: a short list."""
    found = sorted((r.League, r.Season) for r in rows.select(*BY).distinct().collect())
    return [(lg, s) for lg, s in found if sum(1 for a, b in found if a == lg and b < s) >= least_seasons]


def loss_selector_oof(rows: DataFrame, columns: Sequence[str], context: Sequence[str] = (), top: int = 3, least_seasons: int = 1) -> DataFrame:
    """Season-forward SelectorProb: losses learned in a league's earlier seasons, each row blended by its own.

    Equal rows get equal results; null routes are filled; seasons with too few earlier ones are left out.
    """
    kept = rows.columns
    frame, features = meta_features(rows, columns, context)
    frame, candidates = simple_frame(frame, columns)
    frame = checkpoint(frame)
    parts = []
    for league, season in _folds(frame, least_seasons):
        own = frame.where(F.col("League") == league)
        scored = fit_losses(own.where(F.col("Season") < season), own.where(F.col("Season") == season), candidates, features)
        parts.append(select_by_loss(scored, candidates, top).select(*kept, "SelectorProb"))
    return reduce(DataFrame.unionByName, parts, frame.limit(0).select(*kept, F.lit(None).cast("double").alias("SelectorProb")))


# All of it, season by season


def fusion_oof(rows: DataFrame, columns: Sequence[str], gates: dict[str, Gates], mined: list[Rule], context: Sequence[str] = (), anchor: str | None = None, specialist: str | None = None, least_seasons: int = 5) -> DataFrame:
    """Out-of-sample decisions: rules, stacked models, losses and choices of a season come from the seasons before it.

    rows: GameID, League, Season, Label, the routes `columns`, `context`. For each league and season with
    `least_seasons` earlier ones: rules are mined (a few dozen rows come back), their flags join the meta
    features, a linear and a boosted model and the candidates' losses are fitted, and the gates decide.
    A fold whose earlier rows have one label only takes the mean of the routes for both models.
    """
    frame, features = meta_features(rows, columns, context)
    frame, candidates = simple_frame(frame, columns)
    frame = checkpoint(frame)
    by_name = {r.name: r for r in mined}
    parts = []
    for league, season in _folds(frame, least_seasons):
        own = frame.where(F.col("League") == league)
        early = own.where(F.col("Season") < season)
        rules = [(by_name[r["rule"]], r.direction, r.edge, r.target_mean) for r in mine_rules(early, mined).collect()] if mined else []  # `most` rows
        flagged = checkpoint(rule_features(own.where(F.col("Season") <= season), [(r, d, e) for r, d, e, _ in rules]))
        flags = [c for c in flagged.columns if c not in frame.columns]
        train, test = flagged.where(F.col("Season") < season), flagged.where(F.col("Season") == season)
        inputs = [*features, *flags]
        train, test = (t.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in flags}) for t in (train, test))
        scored = select_by_loss(fit_losses(train, test, candidates, inputs), candidates)
        both = train.select("Label").distinct().count() == 2
        for name, make in (("LinearMetaProb", linear), ("BoostedMetaProb", trees)):
            if both:
                keep = scored.columns
                out = make(inputs).fit(train).transform(scored)
                scored = out.select(*keep, probability(out).alias(name))
            else:
                scored = scored.withColumn(name, F.col(MEAN))
        sums = train.agg(*(F.avg(_squared(c)).alias(c) for c in candidates)).first()  # one row
        best = min(candidates, key=lambda c: (round(sums[c], 9), candidates.index(c)))
        chosen = scored.withColumns({"BestName": F.lit(best), "BestScore": F.lit(sums[best]), "AnchorScore": F.lit(sums[anchor] if anchor else None).cast("double"), "RuleCount": F.lit(len(rules))})
        start, steps = league_steps(league, gates[league], anchor, specialist, rule_steps(rules))
        parts.append(decide(with_best(chosen, candidates), start, steps))
    names = ["GameID", *BY, "Label", "BestName", "RuleCount", "BestProb", "SelectorProb", "LinearMetaProb", "BoostedMetaProb", "FinalProb", "DecidedBy"]
    none = frame.limit(0).select("GameID", *BY, "Label", F.lit("").alias("BestName"), F.lit(0).alias("RuleCount"), *(F.lit(0.0).alias(c) for c in names[6:11]), F.lit("").alias("DecidedBy"))
    return reduce(DataFrame.unionByName, (p.select(*names) for p in parts), none)
