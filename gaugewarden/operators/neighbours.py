"""Distances between stations, nearest neighbours and features taken from them.

Pairs of all stations are made block by block and go nowhere but to the
result; nothing else builds the square of the station table. Pairs within a radius
meet through a grid of cells; nearest neighbours through a stack of grids in
which every station searches at the finest level that surely holds enough.
"""

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import KEYS
from ..session import stage_table
from .clean import derive_department
from .profile import station_validity
from .series import rank_within_group

KM = 1000.0
#: Grids get finer, by so many levels at a time, until no cell holds more than so many spots.
LEVEL_STEP = 9
CROWDED = 64
FINEST = 45
#: Stations within a radius meet on a grid of so many cells to the radius, in blocks of about so many stations of a cell.
CELLS = 2
BLOCK = 512
#: A task compares about so many pairs of stations.
TASK_PAIRS = 1 << 22
#: Where every station meets every other, blocks are so many times as large and so sent fewer times.
WIDER = 2
#: A station meets so many of a block at a time, whose rows come in one order and then in the other.
STRIP = 32
#: Measured days look for their stretch of days within spans of so many.
SPAN_DAYS = 32


def planar_km(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy) / KM


def pairwise_distance(stations: DataFrame, max_km: float | None = None, x: str = "Lambert93x", y: str = "Lambert93y",
                      attrs: list[str] = ()) -> DataFrame:
    """Ordered pairs of different stations: all of them, or those at most ``max_km`` apart.

    Stations are packed into blocks, which meet once, are dealt evenly to as many
    tasks as their pairs of stations ask for, and give both orders of a pair.
    The blocks sent are few beside the pairs, which are made in the last step
    and go nowhere else. A station meets a block in strips of ``STRIP``, all in
    one order and then all in the other: ids then come in runs and a distance
    comes again soon, which writers of columns store in far fewer bytes than
    orders in turn. Without a limit stations whose place is unknown stay, at an
    unknown distance; with one, stations without a finite place are near no other.
    """
    one = F.struct(F.col("station_id").alias("id"), F.col(x).alias("x"), F.col(y).alias("y"),
                   *[F.col(a).alias(f"a{i}") for i, a in enumerate(attrs)])
    dealt = _all_units(stations.select(one.alias("row"))) if max_km is None else _near_units(stations, max_km, x, y, one)

    extra = [f"a{i}" for i in range(len(attrs))]
    strips = F.transform(F.sequence(F.lit(1), F.size("other_rows"), F.lit(STRIP)), lambda i: F.slice("other_rows", i, STRIP))
    met = dealt.select("turns", strips.alias("strips"), F.inline("rows").alias("id", "x", "y", *extra)).withColumn(
        "strip", F.explode("strips")).withColumn("turned", F.explode("turns"))
    pairs = met.select("turned", "id", "x", "y", *extra, F.inline("strip").alias("oid", "ox", "oy", *[f"o{c}" for c in extra]))
    km = planar_km(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))
    near = pairs.filter(F.col("id") != F.col("oid")).withColumn("km", km)
    near = near if max_km is None else near.filter(F.col("km") <= max_km)
    pick = lambda a, b, name: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(name)
    return near.select(pick("id", "oid", "station_id"), pick("oid", "id", "other_id"), "km",
                       *[pick(c, f"o{c}", a) for c, a in zip(extra, attrs)],
                       *[pick(f"o{c}", c, f"other_{a}") for c, a in zip(extra, attrs)])


def _all_units(rows: DataFrame) -> DataFrame:
    """Units of work (rows, other_rows, turns): every two blocks of stations once, and each with itself.

    A block is sent once to each of its units, which are keyed by the numbers of both blocks.
    """
    rows = stage_table(rows, "placed")
    n, size = rows.count(), WIDER * BLOCK
    chunks = max(1, -(-n // size))
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("chunk")
    blocks = stage_table(rows.select(chunk, "row").groupBy("chunk").agg(F.collect_list("row").alias("rows")), "blocks")
    tasks = n * (n + size) // 2 // TASK_PAIRS + 1
    left = blocks.select(F.col("chunk").alias("a"), F.explode(F.sequence("chunk", F.lit(chunks - 1))).alias("b"), "rows")
    right = blocks.select(F.explode(F.sequence(F.lit(0), "chunk")).alias("a"), F.col("chunk").alias("b"), F.col("rows").alias("other_rows"))
    met = left.repartition(tasks, "a", "b").join(right.repartition(tasks, "a", "b").hint("merge"), ["a", "b"])
    return met.select("rows", "other_rows", _turns(F.col("a") == F.col("b")).alias("turns"))


def _turns(itself: Column) -> Column:
    """The orders in which two blocks give their pairs: a block with itself holds both orders already."""
    return F.when(itself, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))


def _near_units(stations: DataFrame, max_km: float, x: str, y: str, one: Column) -> DataFrame:
    """Units of work as in ``_all_units``, for blocks within reach of each other.

    Blocks hold about ``BLOCK`` stations of one cell, chosen by a hash of the
    row, so that neither a town nor a spot makes a large one.
    """
    reach = max_km * KM * (1 + 1e-9)  # so that rounding puts no pair out of reach
    side = reach / CELLS
    placed = stations.filter((F.col(x) - F.col(x) == 0) & (F.col(y) - F.col(y) == 0)).select(
        F.floor(F.col(x) / side).alias("cx"), F.floor(F.col(y) / side).alias("cy"), one.alias("row"))
    blocks = _blocks(stage_table(placed, "placed"))

    steps = range(-CELLS, CELLS + 1)
    ahead = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps if (i, j) >= (0, 0)])
    left = blocks.withColumn("d", F.explode(ahead)).withColumns({"cx": F.col("cx") + F.col("d.i"), "cy": F.col("cy") + F.col("d.j")})
    right = blocks.select("cx", "cy", *[F.col(c).alias(f"other_{c}") for c in blocks.columns if c not in ("cx", "cy")])
    home = (F.col("d.i") == 0) & (F.col("d.j") == 0)
    gaps = [F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(f"other_{c}1"), F.col(f"other_{c}0") - F.col(f"{c}1")) for c in "xy"]
    units = left.join(right, ["cx", "cy"]).filter(~home | (F.col("chunk") <= F.col("other_chunk"))).filter(
        gaps[0] * gaps[0] + gaps[1] * gaps[1] <= reach * reach)
    work = units.agg(F.sum(F.col("n") * F.col("other_n")).alias("pairs")).first()["pairs"] or 0
    return units.repartition(work // TASK_PAIRS + 1, "cx", "cy", "chunk", "d", "other_chunk").select(
        "rows", "other_rows", _turns(home & (F.col("chunk") == F.col("other_chunk"))).alias("turns"))


def _blocks(placed: DataFrame) -> DataFrame:
    """Staged rows of a cell in chunks of about ``BLOCK``, each with its size and the box around it."""
    chunks = placed.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks"))
    numbered = placed.withColumn("_n", F.monotonically_increasing_id()).join(chunks, ["cx", "cy"])
    chunk = F.pmod(F.xxhash64("_n"), F.col("chunks")).alias("chunk")
    box = [f(f"row.{c}").alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]
    return stage_table(numbered.groupBy("cx", "cy", chunk).agg(
        F.count(F.lit(1)).alias("n"), *box, F.collect_list("row").alias("rows")), "blocks")


def matrix_to_pairs(stations: DataFrame, max_km: float, altitude: str = "Altitude") -> DataFrame:
    """Pairs with their distance, altitude gap and the department of the first station."""
    pairs = pairwise_distance(stations, max_km, attrs=[altitude])
    gap = F.abs(F.col(altitude) - F.col(f"other_{altitude}"))
    return derive_department(pairs.withColumn("altitude_gap", gap).drop(altitude, f"other_{altitude}"))


def nearest(queries: DataFrame, points: DataFrame, k: int, within: list[str] = ()) -> DataFrame:
    """Exact ``k`` nearest other stations: columns ``within``, ``station_id``, ``neighbour_id``, ``km``, ``rank``.

    Both inputs have ``station_id``, ``x``, ``y`` (and ``within``, to search
    separately in each of its groups). Stations at the same spot are folded
    into one point holding its ``k + 1`` smallest ids, which is all a result
    can use. Grids halve their cells level by level. A query searches at the
    finest level where the nine cells around it hold more than ``k`` ids: these
    are within 2*sqrt(2) cells, so the cells up to three away hold every
    closer one. Few queries share a cell at their own level, which keeps the
    candidate pairs near linear in the number of stations, wherever they crowd.
    """
    within = list(within)
    box = queries.select("x", "y").union(points.select("x", "y")).agg(F.struct(
        F.min("x").alias("x"), F.min("y").alias("y"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("side"))).scalar()
    cell = [*within, "level", "cx", "cy"]

    box = df_literal(queries, box)
    by_spot = rank_within_group(points.select(*within, "x", "y", "station_id"), [*within, "x", "y"], ["station_id"], k + 1)
    spots = by_spot.groupBy(*within, "x", "y").agg(F.collect_list("station_id").alias("ids"))
    spots = stage_table(spots, "spots")
    levels = _levels(spots, within, box)
    spot_cells = _at_levels(spots, box, levels)
    crowd = _shifted(spot_cells.groupBy(*cell).agg(F.sum(F.size("ids")).alias("c")), 1).groupBy(*cell).agg(
        F.sum("c").alias("around"))

    asked = queries.select(*within, "station_id", "x", "y")
    enough = _at_levels(asked, box, levels).join(crowd, cell).filter(F.col("around") > k).groupBy(*within, "station_id").agg(
        F.max("level").alias("level"))
    placed = asked.join(enough, [*within, "station_id"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    probes = _shifted(_cell_of(placed, box), 3)
    found = probes.join(spot_cells.select(*cell, F.col("x").alias("px"), F.col("y").alias("py"), "ids"), cell)
    km = planar_km(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    candidates = found.select(*within, "station_id", km.alias("km"), F.explode("ids").alias("neighbour_id")).filter(
        F.col("station_id") != F.col("neighbour_id"))
    return rank_within_group(candidates, [*within, "station_id"], ["km", "neighbour_id"], k)


def _cell_of(df: DataFrame, box: Column) -> DataFrame:
    """Cell of each row on the grid of its ``level``."""
    scale = F.pow(F.lit(2.0), F.col("level"))
    placed = df.withColumn("_box", box).withColumns({
        "cx": F.floor((F.col("x") - F.col("_box.x")) / F.col("_box.side") * scale),
        "cy": F.floor((F.col("y") - F.col("_box.y")) / F.col("_box.side") * scale)})
    return placed.drop("_box")


def df_literal(df: DataFrame, one: Column) -> Column:
    """A scalar subquery of three numbers worked out once, as literals for the many places that use it."""
    row = df.sparkSession.range(1).select(one.alias("b")).first()["b"]
    return F.struct(*[F.lit(row[c]).cast("double").alias(c) for c in ("x", "y", "side")])


def _levels(spots: DataFrame, within: list[str], box: Column) -> int:
    """Depth at which no cell is crowded, so that one far station does not press all others into a few cells."""
    levels = 2 * LEVEL_STEP
    while levels < FINEST:
        finest = _cell_of(spots.withColumn("level", F.lit(levels)), box).groupBy(*within, "cx", "cy").count()
        if finest.filter(F.col("count") > CROWDED).isEmpty():
            break
        levels += LEVEL_STEP
    return levels


def _at_levels(df: DataFrame, box: Column, levels: int) -> DataFrame:
    """Each row once per grid."""
    return _cell_of(df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))), box)


def _shifted(df: DataFrame, reach: int) -> DataFrame:
    """Each row once per cell at most ``reach`` cells away."""
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    return df.withColumn("cx", F.explode(F.transform(offsets, lambda i: F.col("cx") + i))).withColumn(
        "cy", F.explode(F.transform(offsets, lambda i: F.col("cy") + i)))


def nearest_neighbours(stations: DataFrame, k: int = 5, x: str = "Lambert93x", y: str = "Lambert93y") -> DataFrame:
    """The ``k`` nearest other stations of each station, with distance and rank."""
    points = stage_table(_points(stations, x, y), "station-points")
    return nearest(points, points, k)


def _points(stations: DataFrame, x: str, y: str) -> DataFrame:
    """One place per station, the first one of a station listed at several."""
    return stations.groupBy("station_id").agg(F.min(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("p")).select(
        "station_id", "p.x", "p.y")


def neighbour_table(stations: DataFrame, neighbours: DataFrame, k: int = 5) -> DataFrame:
    """Stations with ``stationproche1..k`` and ``distance_station1..k`` for export."""
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    ranks = range(1, k + 1)
    wide = neighbours.groupBy("station_id").agg(*[at("neighbour_id", r).alias(f"stationproche{r}") for r in ranks],
                                                *[at("km", r).alias(f"distance_station{r}") for r in ranks])
    return stations.join(wide, "station_id", "left")


def neighbour_altitudes(neighbours: DataFrame, stations: DataFrame, altitude: str = "Altitude") -> DataFrame:
    """Altitude of each neighbour."""
    right = stations.select(F.col("station_id").alias("neighbour_id"), F.col(altitude).alias("neighbour_altitude"))
    return neighbours.join(right, "neighbour_id")


def neighbour_lag_features(df: DataFrame, neighbours: DataFrame, params: list[str], ranks: int = 3,
                           days: int = 3) -> DataFrame:
    """Columns ``{p}_j{rank}_t{days}``: the value at a neighbour that many calendar days before.

    Measurements are first turned into one row per station and target day
    holding all its lags, then handed to the stations that have it as a
    neighbour. Everything meets by equi-joins; a cell is null unless exactly
    one measurement matches it.
    """
    span = range(1, days + 1)
    lagged = df.select(F.col("station_id").alias("neighbour_id"), "day", *params).withColumn(
        "t", F.explode(F.sequence(F.lit(1), F.lit(days)))).withColumn("day", F.expr("date_add(day, t)"))

    def once(p: str, t: int) -> Column:
        here = F.col("t") == t
        return F.when(F.count(F.when(here, 1)) == 1, F.max(F.when(here, F.col(p)))).alias(f"{p}_t{t}")

    lags = lagged.groupBy("neighbour_id", "day").agg(*[once(p, t) for p in params for t in span])
    given = lags.join(neighbours.filter(F.col("rank") <= ranks).select("station_id", "neighbour_id", "rank"),
                      "neighbour_id")
    wide = given.groupBy(*KEYS).agg(*[
        F.max(F.when(F.col("rank") == r, F.col(f"{p}_t{t}"))).alias(f"{p}_j{r}_t{t}")
        for p in params for r in range(1, ranks + 1) for t in span])
    return df.join(wide, KEYS, "left")


def active_neighbour_intervals(df: DataFrame, stations: DataFrame, k: int = 3, pool: int = 10,
                               x: str = "Lambert93x", y: str = "Lambert93y") -> DataFrame:
    """Segments of each station's life with the ``k`` nearest stations active at the segment's start.

    A segment ends on the earliest last day among them and the next starts a
    day later, or when the next station near or far opens. Who is nearest on
    each day is settled for all stations at once (``_ranked_stretches``). What is walked
    per station are its own stretches of days, at most one per day of its
    life, whatever the number of stations around.
    """
    ranked, short, own = _ranked_stretches(df, stations, k, pool, x, y)
    queries = short.withColumn("day", F.explode(F.sequence("seg_start", "seg_end"))).select("station_id", "day", "x", "y")
    last = own.select(F.col("station_id").alias("neighbour_id"), F.col("last_day").alias("n_last"))
    searched = _nearest_on_days(queries, own, k).withColumns({"seg_start": F.col("day"), "seg_end": F.col("day")}).drop("day")
    near = stage_table(ranked.unionByName(searched).join(last, "neighbour_id"), "stretches")
    life = own.select("station_id", "last_day")
    ends = near.groupBy("station_id", "seg_start", "seg_end").agg(F.min("n_last").alias("until")).join(life, "station_id")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("seg_start")
        starts, stops, until, over = g["seg_start"].to_numpy(), g["seg_end"].to_numpy(), g["until"].to_numpy(), g["last_day"].iat[0]
        out, day = [], starts[0]
        while True:
            i = int(np.searchsorted(stops, day))  # the first stretch that ends on the day or later
            if i == len(starts) or max(day, starts[i]) >= over:
                break
            begin = max(day, starts[i])
            out.append((starts[i], begin, until[i]))
            day = until[i] + timedelta(days=1)
        return pd.DataFrame(out, columns=["stretch", "begin", "until"]).assign(station_id=g["station_id"].iat[0])[
            ["station_id", "stretch", "begin", "until"]]

    walked = ends.groupBy("station_id").applyInPandas(walk, "station_id long, stretch date, begin date, until date")
    met = walked.withColumnRenamed("stretch", "seg_start").join(near.drop("seg_end", "n_last"), ["station_id", "seg_start"])
    return met.select("station_id", F.col("begin").alias("seg_start"), F.col("until").alias("seg_end"), "rank", "neighbour_id", "km")


def _with_validity(neighbours: DataFrame, validity: DataFrame) -> DataFrame:
    right = validity.select(F.col("station_id").alias("neighbour_id"), F.col("first_day").alias("n_first"),
                            F.col("last_day").alias("n_last"))
    return neighbours.join(right, "neighbour_id")


def active_neighbours_daily(df: DataFrame, stations: DataFrame, k: int = 3, pool: int = 10,
                            x: str = "Lambert93x", y: str = "Lambert93y") -> DataFrame:
    """The ``k`` nearest stations active on each measured day: station, day, rank, neighbour, distance.

    Who is active among a station's ``k * pool`` nearest changes only on their
    first and last days, so ranks are settled per segment between such days and
    joined to the measured days. A segment with fewer than ``k`` of them active
    is searched again day by day among all stations active that day, so the
    pool never limits the result.
    """
    ranked, short, own = _ranked_stretches(df, stations, k, pool, x, y)
    days = df.select(*KEYS).distinct()
    place = ranked.groupBy("station_id", "seg_start", "seg_end").agg(F.collect_list(F.struct("rank", "neighbour_id", "km")).alias("near"))
    settled = _days_within(days, place).select(*KEYS, F.inline("near"))
    queries = _days_within(days, short).select(*KEYS, "x", "y")
    out = [*KEYS, "rank", "neighbour_id", "km"]
    return settled.select(*out).unionByName(_nearest_on_days(queries, own, k).select(*out))


def _days_within(days: DataFrame, stretches: DataFrame) -> DataFrame:
    """Measured days with the stretch of their station that holds them.

    Both meet by station and span of ``SPAN_DAYS`` days, so a long stretch is a row per span and not
    one per day, whether anything was measured on it or not. Such rows are made above a small
    aggregate, whose size says nothing of theirs, so the join is never a broadcast.
    """
    span = lambda c: F.floor(F.unix_date(c) / SPAN_DAYS)
    spans = stretches.withColumn("_span", F.explode(F.sequence(span("seg_start"), span("seg_end"))))
    met = days.withColumn("_span", span("day")).join(spans.hint("merge"), ["station_id", "_span"])
    return met.filter(F.col("day").between(F.col("seg_start"), F.col("seg_end"))).drop("_span")


def _ranked_stretches(df: DataFrame, stations: DataFrame, k: int, pool: int, x: str, y: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the ``k * pool`` nearest of each station settle: ranks per stretch of days, the stretches left open, and places with validity.

    Among the candidates the active ones change only on their first and last
    days. A stretch with fewer than ``k`` of them active is left open (station_id, seg_start, seg_end, x, y).
    """
    validity = station_validity(df)
    points = stage_table(_points(stations, x, y), "station-points")
    # Every step below reads the candidates, so they are searched once and written.
    candidates = stage_table(_with_validity(nearest(points, points, k * pool), validity).drop("rank"), "candidates")
    own = stage_table(points.join(validity, "station_id"), "lives")

    inside = (F.col("day") >= F.col("first_day")) & (F.col("day") <= F.col("last_day"))
    turning = own.select("station_id", "first_day", "last_day", F.col("first_day").alias("day")).union(
        candidates.join(own, "station_id").select("station_id", "first_day", "last_day", F.explode(
            F.array("n_first", "n_last")).alias("day")).filter(inside)).distinct()
    following = F.lead("day").over(W.partitionBy("station_id").orderBy("day"))
    segments = turning.select("station_id", F.col("day").alias("seg_start"),
                              F.coalesce(F.date_sub(following, 1), F.col("last_day")).alias("seg_end"))
    segments = stage_table(segments, "segments")
    active = segments.join(candidates, "station_id").filter(
        (F.col("n_first") <= F.col("seg_start")) & (F.col("n_last") > F.col("seg_start")))
    ranked = stage_table(
        rank_within_group(active, ["station_id", "seg_start", "seg_end"], ["km", "neighbour_id"], k).select(
            "station_id", "seg_start", "seg_end", "rank", "neighbour_id", "km"), "ranked")
    key = ["station_id", "seg_start", "seg_end"]
    filled = ranked.groupBy(*key).agg(F.count("*").alias("c")).filter(F.col("c") == k)
    short = segments.join(filled, key, "left_anti").join(points, "station_id")
    return ranked.join(filled.drop("c"), key, "left_semi"), short, own


def _nearest_on_days(queries: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest among all stations active on the day of each query."""
    queries = stage_table(queries, "open-days")
    active = own.filter(F.col("first_day") < F.col("last_day")).withColumn(
        "day", F.explode(F.expr("sequence(first_day, date_sub(last_day, 1))")))
    return nearest(queries, active.join(queries.select("day").distinct(), "day", "left_semi"), k, ["day"])


def attach_active_neighbours(df: DataFrame, active: DataFrame, params: list[str], k: int = 3) -> DataFrame:
    """Columns ``{p}_0 .. {p}_{k-1}``: the day's values at the active neighbours, nearest first."""
    there = df.select(F.col("station_id").alias("neighbour_id"), "day", *params)
    wide = active.join(there, ["neighbour_id", "day"]).groupBy(*KEYS).agg(*[
        F.max(F.when(F.col("rank") == i + 1, F.col(p))).alias(f"{p}_{i}") for i in range(k) for p in params])
    return df.join(wide, KEYS, "left")


def attach_neighbour_attributes(df: DataFrame, active: DataFrame, stations: DataFrame, cols: list[str], k: int = 3) -> DataFrame:
    """Columns ``{c}_0 .. {c}_{k-1}``: attributes of the active neighbours of each day, nearest first."""
    there = stations.groupBy("station_id").agg(F.min(F.struct(*cols)).alias("_a")).select(
        F.col("station_id").alias("neighbour_id"), "_a.*")
    wide = active.join(there, "neighbour_id").groupBy(*KEYS).agg(*[
        F.max(F.when(F.col("rank") == i + 1, F.col(c))).alias(f"{c}_{i}") for i in range(k) for c in cols])
    return df.join(wide, KEYS, "left")
