"""Contest tables derived from the given star schema.

The same SQL text makes the Spark input of a query and the first part of its SQL twin, so the
two only differ in the operator under test. Suppliers are the teams; two neighbouring lines of
an order are a contest, and the larger quantity wins.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import checkpoint_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "lines": "SELECT l_orderkey AS k, l_linenumber AS n, min(l_suppkey) AS s, sum(l_quantity) AS q, min(l_partkey) AS p FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "contest": """
        SELECT a.k * 10 + a.n AS GameID, CAST(year(o_orderdate) AS INT) AS Season, CAST(dayofyear(o_orderdate) AS INT) AS DayNum,
               CASE WHEN a.q > b.q THEN a.s ELSE b.s END AS WTeamID, CASE WHEN a.q > b.q THEN b.s ELSE a.s END AS LTeamID,
               greatest(a.q, b.q) AS WScore, least(a.q, b.q) AS LScore,
               CASE a.k % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'A' ELSE 'N' END AS WLoc, CASE a.s % 2 WHEN 0 THEN 'M' ELSE 'W' END AS League,
               CASE WHEN a.q > b.q THEN a.p ELSE b.p END AS wp, CASE WHEN a.q > b.q THEN b.p ELSE a.p END AS lp
        FROM lines a JOIN lines b ON a.k = b.k AND b.n = a.n + 1 JOIN {orders} ON o_orderkey = a.k
        WHERE a.s <> b.s AND a.q <> b.q AND a.s % 2 = b.s % 2""",
    "regular": "SELECT * FROM contest WHERE DayNum <= 330",
    "tourney": "SELECT * FROM contest WHERE DayNum > 330",
    "sides": """
        SELECT *, w3 + 12 + wp % 11 AS wm, l3 + 12 + lp % 11 AS lm, wp % 25 AS wfa, lp % 25 AS lfa FROM (SELECT *, wp % 9 AS w3, lp % 9 AS l3 FROM regular) t""",
    "boxscore": """
        SELECT GameID, Season, DayNum, WTeamID, LTeamID, WScore, LScore, WLoc, League,
               wm AS WFGM, wm + 18 + wp % 20 AS WFGA, w3 AS WFGM3, w3 + wp % 10 AS WFGA3, least(wfa, wp % 13) AS WFTM, wfa AS WFTA, wp % 15 AS WOR, 15 + wp % 12 AS WDR, wp % 16 AS WAst, wp % 17 AS WTO, wp % 7 AS WStl, wp % 5 AS WBlk,
               lm AS LFGM, lm + 18 + lp % 20 AS LFGA, l3 AS LFGM3, l3 + lp % 10 AS LFGA3, least(lfa, lp % 13) AS LFTM, lfa AS LFTA, lp % 15 AS LOR, 15 + lp % 12 AS LDR, lp % 16 AS LAst, lp % 17 AS LTO, lp % 7 AS LStl, lp % 5 AS LBlk
        FROM sides""",
    "conferences": "SELECT Season, s_suppkey AS TeamID, 'C' || CAST(s_nationkey AS STRING) AS ConfAbbrev FROM {supplier} CROSS JOIN (SELECT DISTINCT Season FROM contest) seasons",
    "wins": "SELECT League, Season, WTeamID AS TeamID, count(*) AS Wins FROM regular GROUP BY League, Season, WTeamID",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY League, Season ORDER BY Wins DESC, TeamID) AS rk FROM wins",
    "seeds": "SELECT League, Season, substr('WXYZ', CAST((rk - 1) % 4 + 1 AS INT), 1) || lpad(CAST(CAST(ceil(rk / 4.0) AS INT) AS STRING), 2, '0') AS Seed, TeamID FROM ranked WHERE rk <= 64",
    "ordinals": """
        SELECT Season, RankingDayNum, SystemName, TeamID, CAST(rank() OVER (PARTITION BY Season, RankingDayNum, SystemName ORDER BY Total DESC, TeamID) AS INT) AS OrdinalRank
        FROM (SELECT CAST(year(o_orderdate) AS INT) AS Season, CAST(14 * floor(dayofyear(o_orderdate) / 14.0) AS INT) AS RankingDayNum, o_orderpriority AS SystemName, l_suppkey AS TeamID, round(sum(l_extendedprice), 2) AS Total
              FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4) t""",
    "quotes": """
        SELECT GameID, Season, WTeamID AS T1, LTeamID AS T2, League, l_linenumber AS Line, l_partkey AS Part,
               CASE WHEN l_linenumber < 7 THEN round(1.2 + 20 * l_discount, 4) END AS Team1DecimalOdds, CASE WHEN l_linenumber < 7 THEN round(1.2 + 25 * l_tax, 4) END AS Team2DecimalOdds,
               (l_linenumber - 4) * CAST(2.5 AS DOUBLE) AS LastSpread, l_returnflag || l_linestatus AS Book, l_shipdate AS SnapshotTime, o_orderpriority AS Source
        FROM contest JOIN {lineitem} ON l_orderkey = CAST(floor(GameID / 10.0) AS BIGINT) JOIN {orders} ON o_orderkey = l_orderkey""",
    "coaches": """
        SELECT Season, s_suppkey AS TeamID, 'coach_' || CAST((7 * s_suppkey + CAST(floor(Season / 2.0) AS BIGINT)) % 23 AS STRING) AS CoachName, 0 AS FirstDayNum, CASE WHEN s_suppkey % 10 = 0 THEN 70 ELSE 132 END AS LastDayNum
        FROM {supplier} CROSS JOIN (SELECT DISTINCT Season FROM contest) seasons
        UNION ALL
        SELECT Season, s_suppkey, 'deputy_' || CAST(s_suppkey % 7 AS STRING), 71, 132 FROM {supplier} CROSS JOIN (SELECT DISTINCT Season FROM contest) seasons WHERE s_suppkey % 10 = 0""",
    "glog": """
        SELECT GameID, League, Season, DayNum, WTeamID AS TeamID, LTeamID AS OppID, WScore AS Pts, LScore AS OppPts, CAST(1 AS DOUBLE) AS Win, CASE WHEN WLoc = 'H' THEN 1 ELSE 0 END AS IsHome, WScore - LScore AS Margin FROM regular
        UNION ALL
        SELECT GameID, League, Season, DayNum, LTeamID, WTeamID, LScore, WScore, CAST(0 AS DOUBLE), CASE WHEN WLoc = 'A' THEN 1 ELSE 0 END, LScore - WScore FROM regular""",
    "lab": "SELECT GameID, League, Season, DayNum, least(WTeamID, LTeamID) AS T1, greatest(WTeamID, LTeamID) AS T2, CASE WHEN WTeamID < LTeamID THEN 1 ELSE 0 END AS Label, CASE WHEN WTeamID < LTeamID THEN WScore - LScore ELSE LScore - WScore END AS MarginLabel FROM tourney",
    "mk": """
        SELECT Season, least(T1, T2) AS T1, greatest(T1, T2) AS T2, round(avg(CASE WHEN T1 > T2 THEN 1 - q ELSE q END), 9) AS MarketProb, round(avg(CASE WHEN T1 > T2 THEN -LastSpread ELSE LastSpread END), 9) AS LastSpread
        FROM (SELECT *, CASE WHEN Book NOT LIKE 'R%' THEN (1 / Team1DecimalOdds) / (1 / Team1DecimalOdds + 1 / Team2DecimalOdds) END AS q FROM quotes) t GROUP BY 1, 2, 3""",
    "seednum": "SELECT League, Season, TeamID, CAST(substr(Seed, 2) AS INT) AS SeedNum FROM seeds",
    "scored": """
        SELECT lab.GameID, lab.League, lab.Season, lab.T1, lab.T2, Label, MarginLabel, 1 / (1 + exp(-CAST(coalesce(a.Wins, 0) - coalesce(b.Wins, 0) AS DOUBLE) / 8)) AS RawProb, sa.SeedNum AS T1_SeedNum, sb.SeedNum AS T2_SeedNum, abs(sa.SeedNum - sb.SeedNum) AS AbsSeedDiff, MarketProb, LastSpread
        FROM lab LEFT JOIN wins a ON a.Season = lab.Season AND a.TeamID = lab.T1 LEFT JOIN wins b ON b.Season = lab.Season AND b.TeamID = lab.T2
        LEFT JOIN seednum sa ON sa.Season = lab.Season AND sa.TeamID = lab.T1 LEFT JOIN seednum sb ON sb.Season = lab.Season AND sb.TeamID = lab.T2
        LEFT JOIN mk ON mk.Season = lab.Season AND mk.T1 = lab.T1 AND mk.T2 = lab.T2""",
    "rating": "SELECT Season, TeamID, avg(Win) AS Rating FROM glog GROUP BY Season, TeamID",
}


def _bracket() -> str:
    """The rows of a 64-team bracket of regions W, X, Y, Z: slot, stronger side, weaker side."""
    rows = []
    for r in "WXYZ":
        rows += [(f"R1{r}{i}", f"{r}{i:02d}", f"{r}{17 - i:02d}") for i in range(1, 9)]
        rows += [(f"R2{r}{i}", f"R1{r}{i}", f"R1{r}{9 - i}") for i in range(1, 5)]
        rows += [(f"R3{r}{i}", f"R2{r}{i}", f"R2{r}{5 - i}") for i in range(1, 3)]
        rows.append((f"R4{r}1", f"R3{r}1", f"R3{r}2"))
    rows += [("R5WX", "R4W1", "R4X1"), ("R5YZ", "R4Y1", "R4Z1"), ("R6CH", "R5WX", "R5YZ")]
    return ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows)


def _box_log() -> str:
    """The long log of box scores: a row for each side of a game."""
    sides = []
    for a, b in (("W", "L"), ("L", "W")):
        poss = {s: f"greatest({s}FGA - {s}OR + {s}TO + {s}FTA * CAST(0.475 AS DOUBLE), CAST(1 AS DOUBLE))" for s in (a, b)}
        own = [f"{a}{c} AS {c}" if c != "OR" else f"{a}OR AS Oreb" for c in ("FGM", "FGA", "FGM3", "FGA3", "FTM", "FTA", "OR", "DR", "Ast", "TO", "Stl", "Blk")]
        other = [f"{b}{c} AS Opp{c}" for c in ("FGM", "FGA", "FGM3", "FTA", "OR", "DR", "TO")]
        home = "H" if a == "W" else "A"
        sides.append(f"SELECT GameID, Season, DayNum, {a}TeamID AS TeamID, {b}TeamID AS OppID, {a}Score AS Pts, {b}Score AS OppPts, CAST({int(a == 'W')} AS DOUBLE) AS Win, CASE WHEN WLoc = '{home}' THEN 1 ELSE 0 END AS IsHome, {poss[a]} AS Poss, {poss[b]} AS OppPoss, {', '.join(own + other)} FROM boxscore")
    return " UNION ALL ".join(sides)


VIEWS["boxlog"] = _box_log()
VIEWS["slots"] = f"SELECT Slot, StrongSeed, WeakSeed FROM (VALUES {_bracket()}) AS t(Slot, StrongSeed, WeakSeed)"


def _needed(names: tuple[str, ...], given: tuple[str, ...] = ()) -> list[str]:
    """The names after all views that they read, in order; what those `given` read is left out."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in VIEWS if name not in given else ():
            if other != name and re.search(rf"\b(FROM|JOIN)\s+{other}\b", VIEWS[name]):
                visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def with_views(names: str, select: str, recursive: bool = False) -> str:
    """A SQL twin: the named views (and what they need) before a select, or before more views and a select."""
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in _needed(tuple(names.split())))
    sql = f"WITH {'RECURSIVE ' * recursive}{parts} {select}"
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("AS STRING)", "AS VARCHAR)")


#: Views that a registered query makes once, as a table beside its checkpoints, however many other views and features read them.
SHARED = ("contest", "ordinals", "scored", "live")

_tables: ContextVar[dict[tuple[str, str], DataFrame] | None] = ContextVar("_tables", default=None)


@contextmanager
def shared_views() -> Iterator[None]:
    """Within it each of SHARED is made once; nothing is kept beyond, so a later query sees changed tables. Within another it is that one."""
    if _tables.get() is not None:
        yield
        return
    token = _tables.set({})
    try:
        yield
    finally:
        _tables.reset(token)


def _text(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    sql = re.sub(r"\{(\w+)\}", lambda m: m[0] if m[1] in frames else f"parquet.`{sf_dir}/{m[1]}.parquet`", sql)
    return spark.sql(sql, **frames)


def _contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view contest, with each line beside the next of its order by a window instead of a join: lines are shuffled once."""
    lines = _text(spark, sf_dir, VIEWS["lines"].replace("FROM {lineitem}", "FROM (SELECT * FROM {lineitem} WHERE l_orderkey IS NOT NULL DISTRIBUTE BY l_orderkey)"))
    line = F.struct(*lines.columns)
    beside = lines.select("k", line.alias("a"), F.lead(line).over(Window.partitionBy("k").orderBy("n")).alias("b")).where("b.n = a.n + 1")
    return _text(spark, sf_dir, VIEWS["contest"].replace("FROM lines a JOIN lines b ON a.k = b.k AND b.n = a.n + 1 JOIN {orders} ON o_orderkey = a.k", "FROM {beside} JOIN {orders} ON o_orderkey = {beside}.k"), beside=beside)


#: The view quotes within scored, which looks up the pairs of lab alone: other contests' lines are not joined.
QUOTES_OF_LAB = VIEWS["quotes"].replace(
    "FROM contest JOIN",
    "FROM (SELECT GameID, Season, WTeamID, LTeamID, League FROM contest LEFT SEMI JOIN (SELECT Season AS s, T1 AS a, T2 AS b FROM lab) l ON Season = s AND least(WTeamID, LTeamID) = a AND greatest(WTeamID, LTeamID) = b) c JOIN",
).replace("SELECT GameID", "SELECT /*+ SHUFFLE_HASH(c) */ GameID", 1)  # lines are not sorted for it


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame over the tables in sf_dir."""
    made = _tables.get()
    if made is None:
        return _text(spark, sf_dir, f"WITH {', '.join(f'{n} AS ({VIEWS[n]})' for n in _needed((name,)))} SELECT * FROM {name}")
    if name in SHARED and (sf_dir, name) in made:
        return made[sf_dir, name]
    own = _needed((name,), tuple(n for n in SHARED if n != name))
    if name == "contest":
        rows = _contest(spark, sf_dir)
    else:
        frames = {n: view(spark, sf_dir, n) for n in own if n in SHARED and n != name}
        texts = VIEWS | {"quotes": QUOTES_OF_LAB} if name == "scored" else VIEWS
        rows = _text(spark, sf_dir, f"WITH {', '.join(f'{n} AS (SELECT * FROM {{{n}}})' if n in frames else f'{n} AS ({texts[n]})' for n in own)} SELECT * FROM {name}", **frames)
    if name in SHARED:
        path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        made[sf_dir, name] = rows = spark.read.parquet(path)
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
