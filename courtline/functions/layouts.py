"""Texts of fixed layouts as columns: lines of a forecast, dates in names of events and files, rounds. What doesn't fit is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = r"(?i)^(.+?)\s+(Pick|PK|[+-]?\d+(?:\.\d+)?)\s*,\s*(\d+)\s*-\s*(\d+)\s*\((\d+)%\)$"
STAMP = r"(?i)(January|February|March|April|May|June|July|August|September|October|November|December)_(\d{1,2})(?:_(\d{1,2})(\d{2})(am|pm))?"
# What a round's label holds, and the round's number; the first that fits counts.
ROUNDS = (("first four", 0), ("first round", 1), ("second round", 2), ("sweet 16", 3), ("elite 8", 4), ("final four", 5), ("championship", 6), ("title", 6))
#: Date formats of plain texts, tried in this order.
DATES = ("yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "M/d/yyyy")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def forecast_line(text: Column, team1: Column, team2: Column) -> tuple[Column, Column, Column]:
    """(probability, spread, total) of the first team from "Winner -4.5, 70-65 (63%)"; Pick and PK are no points.

    The winner must be named as one of the teams is; the sign of the line doesn't count.
    """
    clean = squeezed(text)
    part = lambda i: F.regexp_extract(clean, LINE, i)
    fits = clean.rlike(LINE)
    points = F.when(F.lower(part(2)).isin("pick", "pk"), 0.0).otherwise(F.abs(part(2).try_cast("double")))
    p = part(5).try_cast("double") / 100
    first, second = fits & (F.trim(part(1)) == team1), fits & (F.trim(part(1)) == team2)
    prob = F.when(first, p).when(second, F.lit(1.0) - p)
    spread = F.when(first, -points).when(second, points)
    return prob, spread, F.when(first | second, part(3).try_cast("double") + part(4).try_cast("double"))


def dated(text: Column) -> Column:
    """The date that a text is, in any of the formats."""
    clean = squeezed(text)
    return F.coalesce(*(F.try_to_timestamp(clean, F.lit(f)).cast("date") for f in DATES), F.try_to_timestamp(clean).cast("date"))


def event_date(ticker: Column, texts: Sequence[Column] = (), stamps: Sequence[Column] = ()) -> Column:
    """The day of an event: from "-26MAR21" in its ticker, else the first text that is a date, else the first time stamp."""
    code = F.upper(F.regexp_extract(F.coalesce(ticker, F.lit("")), r"(?i)-(\d{2}[A-Z]{3}\d{2})", 1))
    named = F.concat(F.substring(code, 1, 2), F.initcap(F.substring(code, 3, 3)), F.substring(code, 6, 2))
    return F.coalesce(F.try_to_timestamp(F.nullif(named, F.lit("")), F.lit("yyMMMdd")).cast("date"), *(dated(t) for t in texts), *(F.try_to_timestamp(s.cast("string")).cast("date") for s in stamps))


def file_time(name: Column, year: Column | int) -> Column:
    """The time that a file's name tells: "..._20260315_14...", or month, day and perhaps "_530pm" in a given year."""
    digits = F.try_to_timestamp(F.regexp_extract(name, r"(\d{8}_\d{2})", 1), F.lit("yyyyMMdd_HH"))
    part = lambda i: F.regexp_extract(name, STAMP, i)
    hour = F.coalesce(part(3).try_cast("int"), F.lit(0))
    hour = F.when(F.lower(part(5)) == "pm", F.when(hour == 12, 12).otherwise(hour + 12)).when((F.lower(part(5)) == "am") & (hour == 12), 0).otherwise(hour)
    year = F.lit(year) if isinstance(year, int) else year
    text = F.format_string("%d %s %s %d:%s", year, F.initcap(part(1)), part(2), hour, F.coalesce(F.nullif(part(4), F.lit("")), F.lit("00")))
    return F.coalesce(digits, F.when(name.rlike(STAMP), F.try_to_timestamp(text, F.lit("yyyy MMMM d H:mm"))))


def round_number(label: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.coalesce(*(F.when(clean.contains(words), F.lit(n)) for words, n in ROUNDS))
