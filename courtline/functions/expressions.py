"""Scalar expressions: odds, probabilities, names, seeds, times, row-wise statistics.

All are column in, column out, stay in generated code, and treat null as "missing". Invalid
numbers and times become null; NaN is turned into null where text is read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP = 1e-6

# Common short names of teams and the names they stand for.
NAME_ALIASES = {
    "ar pine bluff": "ark pine bluff",
    "app state": "appalachian st",
    "byu": "brigham young",
    "fau": "fl atlantic",
    "lsu": "louisiana state",
    "lmu ca": "loy marymount",
    "loyola chi": "loyola chicago",
    "miami": "miami fl",
    "miami university oh": "miami oh",
    "u miami fl": "miami fl",
    "niu": "n illinois",
    "mississippi valley st": "mississippi valley state",
    "ole miss": "mississippi",
    "presbyterian college": "presbyterian",
    "queens": "queens nc",
    "saint francis": "st francis pa",
    "saint mary s college": "st mary s ca",
    "saint thomas": "st thomas mn",
    "seattle university": "seattle",
    "southeast missouri": "se missouri st",
    "southeast missouri st": "se missouri st",
    "southern ind": "southern indiana",
    "ualbany": "suny albany",
    "uiw": "incarnate word",
    "uconn": "connecticut",
    "ucf": "central florida",
    "unc": "north carolina",
    "uta": "ut arlington",
    "ut rio grande valley": "texas rio grande valley",
    "vcu": "virginia commonwealth",
    "west ga": "west georgia",
}


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Coercion and choice of columns


def number(c: Column | str) -> Column:
    """Text as a double; what is no number, and NaN, is null."""
    value = column(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def timestamp(c: Column | str) -> Column:
    return F.try_to_timestamp(column(c).cast("string"))


def first_present(df: DataFrame, names: Iterable[str], kind: str = "double") -> Column:
    """The first of these columns that exists, even if all its values are null; a null column if none does."""
    found = next((n for n in names if n in df.columns), None)
    return F.lit(None).cast(kind) if found is None else F.col(found)


def coalesce_aliases(df: DataFrame, names: Iterable[str]) -> Column:
    """Row by row the first alias that holds a number."""
    there = [number(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("double")


# Odds and probabilities


def american_to_prob(odds: Column | str) -> Column:
    o = column(odds).cast("double")
    return F.when(o < 0, -o / (-o + 100)).when(o.isNotNull(), F.lit(100.0) / (o + 100))


def american_to_decimal(odds: Column | str) -> Column:
    o = column(odds).cast("double")
    return F.when(o < 0, F.lit(1.0) + F.lit(100.0) / -o).when(o.isNotNull(), F.lit(1.0) + o / 100)


def decimal_to_prob(odds: Column | str) -> Column:
    o = column(odds).cast("double")
    return F.when(o > 0, F.lit(1.0) / o)


def prob_to_american(prob: Column | str) -> Column:
    """Favourites negative; rounded half to even, no value outside (0, 1)."""
    p = column(prob)
    return F.when((p > 0) & (p < 1), F.bround(F.when(p >= 0.5, p * -100 / (F.lit(1.0) - p)).otherwise((F.lit(1.0) - p) * 100 / p)).cast("long"))


def no_vig_prob(p1: Column | str, p2: Column | str) -> tuple[Column, Column]:
    """The first side's share, 0.5 where it is unknown, within 0.001 and 0.999; and the hold."""
    a, b = column(p1), column(p2)
    share = F.coalesce(F.try_divide(a, a + b), F.lit(0.5))
    return F.greatest(F.lit(0.001), F.least(F.lit(0.999), share)), a + b - 1


def clip_prob(p: Column | str, low: float = CLIP, high: float = 1 - CLIP) -> Column:
    """Within bounds; null stays null."""
    c = column(p)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def logit(p: Column | str) -> Column:
    c = clip_prob(p)
    return F.ln(c / (F.lit(1.0) - c))


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-column(x)))


def logit_shift(p: Column | str, shift: Column) -> Column:
    return clip_prob(sigmoid(logit(p) + shift))


def shrink_half(p: Column | str, alpha: float) -> Column:
    c = clip_prob(p)
    return c if alpha <= 0 else clip_prob((c - 0.5) * (1 - alpha) + 0.5)


def _standard_error(q: Column) -> Column:
    return F.sqrt(F.greatest(q - q * q, F.lit(0.0)) / F.greatest(q, F.lit(1e-12)))


def _bias_step(a: Column, b: Column, sa: Column, sb: Column) -> Column:
    return (a + b - 1) / F.greatest(sa + sb, F.lit(1e-12))


def _bias_choice(a: Column, b: Column, pa: Column, pb: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.when((pa <= 0) | (pb <= 0) | (a + b <= 1), a / F.greatest(a + b, F.lit(1e-12))).otherwise(pa))


def bias_corrected_prob(d1: Column | str, d2: Column | str) -> Column:
    """First side's probability from two decimal odds, taking from each in proportion to its standard error.

    Falls back to shares of the inverses where the book is below 1 or a side would vanish. For tables see with_bias_corrected_prob.
    """
    a, b = decimal_to_prob(d1), decimal_to_prob(d2)
    sa, sb = _standard_error(a), _standard_error(b)
    step = _bias_step(a, b, sa, sb)
    return clip_prob(_bias_choice(a, b, a - sa * step, b - sb * step))


def with_bias_corrected_prob(df: DataFrame, d1: str, d2: str, out: str = "p") -> DataFrame:
    """df with bias_corrected_prob as a column, in a projection for each step.

    As one expression every step is written out, and computed, as often as later ones mention it.
    """
    names = [f"_bias_{c}" for c in ("a", "b", "sa", "sb", "step", "pa", "pb", "p")]
    a, b, sa, sb, step, pa, pb, p = map(F.col, names)
    odds = df.withColumns({"_bias_a": decimal_to_prob(d1), "_bias_b": decimal_to_prob(d2)})
    steps = odds.withColumns({"_bias_sa": _standard_error(a), "_bias_sb": _standard_error(b)}).withColumn("_bias_step", _bias_step(a, b, sa, sb))
    chosen = steps.withColumns({"_bias_pa": a - sa * step, "_bias_pb": b - sb * step}).withColumn("_bias_p", _bias_choice(a, b, pa, pb))
    return chosen.withColumn(out, clip_prob(p)).drop(*names)


def margin_to_prob(margin: Column | str, scale: Column | float = 10.0) -> Column:
    return sigmoid(column(margin) / scale)


def temperature_soften(p: Column | str, t: float) -> Column:
    return column(p) if t <= 1 else sigmoid(logit(p) / t)


def possessions(fga: str, oreb: str, to: str, fta: str) -> Column:
    """Attempts that ended a possession, at least 1."""
    return F.greatest(F.col(fga) - F.col(oreb) + F.col(to) + F.col(fta) * 0.475, F.lit(1.0))


# Names, seeds and ids


def normalize_name(c: Column | str) -> Column:
    text = F.lower(F.trim(column(c)))
    text = F.regexp_replace(text, r"\(\d+\)", "")
    text = F.trim(F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    aliases = F.create_map(*(F.lit(x) for pair in NAME_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(aliases, text), text)


def parse_seed(seed: Column | str) -> tuple[Column, Column, Column]:
    """Region letter, number, play-in suffix (empty if none)."""
    s = column(seed)
    return F.substring(s, 1, 1), F.regexp_extract(s, r"(\d+)", 1).try_cast("int"), F.regexp_extract(s, r"\d([ab])$", 1)


def split_pair_id(c: Column | str) -> tuple[Column, Column, Column]:
    parts = F.split(column(c), "_")
    return tuple(F.get(parts, i).try_cast("long") for i in range(3))


def pair_id(season: Column, t1: Column, t2: Column) -> Column:
    return F.concat_ws("_", season, F.least(t1, t2), F.greatest(t1, t2))


def count_distinct_tokens(c: Column | str) -> Column:
    """Different non-blank tokens of a list with | or , between them; null for a blank list."""
    tokens = F.filter(F.transform(F.split(column(c), "[|,]"), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(F.trim(column(c)) != "", F.size(F.array_distinct(tokens)))


def source_host(url: Column | str, default: str = "unknown") -> Column:
    host = F.regexp_extract(column(url), r"^[a-z]+://([^/?#]+)", 1)
    return F.coalesce(F.nullif(host, F.lit("")), F.lit(default))


# Times


def event_time(columns: Iterable[Column], url: Column | None = None) -> Column:
    """The first time that can be read, else a date in the URL."""
    found = [timestamp(c) for c in columns]
    if url is not None:
        found.append(F.try_to_timestamp(F.regexp_extract(url, r"(\d{4}-\d{2}-\d{2})", 1)))
    return F.coalesce(*found)


def round_down_time(c: Column | str, minutes: int) -> Column:
    step = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(column(c).cast("timestamp")) / step) * step)


# Row-wise statistics that skip nulls


def row_count(*cols: str) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))


def row_mean(*cols: str) -> Column:
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(total, row_count(*cols))


def row_std(*cols: str) -> Column:
    """Population standard deviation."""
    mean = row_mean(*cols)
    squares = sum((F.coalesce(F.pow(F.col(c) - mean, 2), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.sqrt(F.try_divide(squares, row_count(*cols)))


def row_min(*cols: str) -> Column:
    return F.least(*cols)


def row_max(*cols: str) -> Column:
    return F.greatest(*cols)


#: Points of a curve that is looked up by interpolate().
MOST_POINTS = 10_000


def interpolate(df: DataFrame, x: str, curve: DataFrame, cx: str, cy: str, out: str) -> DataFrame:
    """y of a piecewise linear curve at x, clamped at its ends; points without x or y don't count, an empty curve gives null.

    The curve is a lookup table: its points, counted first, travel as one sorted array that each row searches by halving.
    """
    points = curve.where(F.col(cx).isNotNull() & F.col(cy).isNotNull()).select(F.col(cx).cast("double").alias("x"), F.col(cy).cast("double").alias("y"))
    if (n := points.count()) > MOST_POINTS:
        raise ValueError(f"{n} points; a curve has at most {MOST_POINTS}")
    one = points.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("_c"))
    rows = df.crossJoin(F.broadcast(one))  # one row
    at = lambda i: F.get("_c", i.cast("int"))

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"] + 1) / 2).cast("int")
        inside = at(middle)["x"] <= F.col(x)
        return F.struct(F.when(inside, middle).otherwise(span["lo"]).alias("lo"), F.when(inside, span["hi"]).otherwise(middle - 1).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(max(n - 1, 0)).alias("hi"))
    rows = rows.withColumn("_i", F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n.bit_length()))), start, lambda s, i: F.when(s["lo"] < s["hi"], halve(s, i)).otherwise(s))["lo"])
    a, b = at(F.col("_i")), at(F.col("_i") + 1)
    y = F.when(F.col(x) <= a["x"], a["y"]).when(b.isNull(), a["y"]).otherwise(a["y"] + (F.col(x) - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"]))
    return rows.withColumn(out, F.when(F.col(x).isNotNull(), y)).drop("_c", "_i")
