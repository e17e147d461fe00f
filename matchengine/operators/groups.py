"""Grouping of records by energy, match strength and window-like operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchengine.durable import keep


def gap_islands(rows: DataFrame, by: list[str], x: Column, gap: float, name: str = "island", tie: list[str] | None = None) -> DataFrame:
    """Number of the island of each row: a new one after a gap above ``gap``."""
    order = Window.partitionBy(*by).orderBy("__x", *(tie or []))
    ahead = F.col("__x") - F.lag("__x").over(order)
    marked = rows.withColumn("__x", x).withColumn("__new", F.coalesce((ahead > gap).cast("int"), F.lit(0)))
    return marked.withColumn(name, F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__x", "__new")


def by_island(rows: DataFrame, key: list[str], columns: list[str], solve: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """``solve(*columns)`` of each island (rows of one key, as lists) in Python.

    Islands come one after the other in the order of a sorted partition, so a task
    holds one of them and a batch of rows, however many there are; ``solve`` gives
    tuples, the result is the key and ``schema``.
    """
    names = [x.split(" ")[0].strip("`") for x in schema.split(", ")]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)

    def answers(part: pd.DataFrame, edges: list[int]) -> pd.DataFrame:
        lists, keys = [part[c].tolist() for c in columns], [part[c].tolist() for c in key]
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            head = tuple(None if pd.isna(k[a]) else k[a] for k in keys)
            out += [(*head, *row) for row in solve(*[x[a:b] for x in lists])]
        return pd.DataFrame(out, columns=[*key, *names])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[pd.DataFrame] = []  # pieces of the island that may go on
        for part in parts:
            if not len(part):
                continue
            if open_ and not _begins(pd.concat([open_[-1].tail(1), part.head(1)]), key)[1]:
                # It goes on: only what is complete behind it can be answered.
                starts = np.flatnonzero(_begins(part, key))[1:]
                if not len(starts):
                    open_.append(part)
                    continue
                whole = pd.concat([*open_, part.iloc[: starts[0]]])
                yield answers(whole, [0, len(whole)])
                part = part.iloc[starts[0] :]
            elif open_:
                whole = pd.concat(open_)
                yield answers(whole, [0, len(whole)])
            starts = np.flatnonzero(_begins(part, key)).tolist()
            if len(starts) > 1:
                yield answers(part, starts)
            open_ = [part.iloc[starts[-1] :]]
        if open_:
            whole = pd.concat(open_)
            yield answers(whole, [0, len(whole)])

    ordered = rows.select(*key, *columns).repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInPandas(run, f"{kinds}, {schema}")


def _begins(part: pd.DataFrame, key: list[str]) -> np.ndarray:
    """Whether a row's key is another than that of the row before; nulls are equal."""
    new = np.zeros(len(part), bool)
    new[0] = True
    for c in key:
        now, before = part[c].iloc[1:].reset_index(drop=True), part[c].iloc[:-1].reset_index(drop=True)
        new[1:] |= ~((now == before) | (now.isna() & before.isna())).to_numpy(bool)
    return new


def coarse_groups(rows: DataFrame, by: str, delta: float) -> DataFrame:
    """Groups along the energies of one nuclide: cut at a gap above delta, or
    above delta / 2 in a group wider than delta.  ``rows``: by, x and, if given, dx:
    neighbours whose energies agree within their uncertainties are not parted.  The
    width of a group depends on its first member, so islands are cut one by one."""
    given = "dx" in rows.columns
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    order = Window.partitionBy(by).orderBy("x", "__row")
    ahead = F.col("x") - F.lag("x").over(order)
    agree = ahead <= F.sqrt(F.col("dx") * F.col("dx") + F.lag("dx").over(order) * F.lag("dx").over(order)) if given else F.lit(False)
    marked = numbered.withColumn("__agree", F.coalesce(agree, F.lit(False))).withColumn("__new", F.coalesce(((ahead > delta) & ~F.col("__agree")).cast("int"), F.lit(0)))
    islands = keep(marked.withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new"), "islands")

    def cut(x: list[float], row: list[int], agrees: list[bool]) -> list[tuple]:
        number, first, last, out = 0, None, None, []
        for value, name, same in sorted(zip(x, row, agrees, strict=True)):
            if last is not None and not same and value - last > delta / 2 and last - first > delta:
                number, first = number + 1, value
            first = value if first is None else first
            last = value
            out.append((name, number))
        return out

    parts = by_island(islands, [by, "island"], ["x", "__row", "__agree"], cut, "__row bigint, part int")
    return islands.drop("__agree").join(parts.select("__row", "part"), "__row").drop("__row")


def fixed_bins(x: Column, low: Column, width: float) -> Column:
    return F.floor((x - low) / width)


def match_order(energy: Column, jpi: Column, gammas: Column, n_matched: Column, n_gammas: Column, distance: Column, delta: float, spin_gap: Column, parity_conflict: Column) -> Column:
    """Strength of a match from 1 (best) to 7; -1 for none.

    Inputs are what has been found out before: energies comparable, spin-parity
    options overlap, gammas consistent, how many of them match."""
    some = n_gammas > 0
    close = F.coalesce((spin_gap <= 2) & ~parity_conflict, F.lit(True))
    return (
        F.when(energy & jpi & ~some, 1)
        .when(energy & jpi & gammas & (n_matched >= 2), 1)
        .when(energy & jpi & ~gammas & (((distance <= 0.5) & (n_matched > 0)) | ((spin_gap == 0) & (n_matched == n_gammas))), 2)
        .when(energy & jpi & gammas & (n_matched == 1), F.when(n_gammas == 1, 3).when(distance <= 5, 4).when(distance <= 10, 5).when(distance <= 15, 6).otherwise(7))
        .when(~(energy & jpi) & (jpi | close) & (distance <= F.least(F.lit(5.0), F.lit(delta))) & (gammas | ~some), 3)
        .when(~(energy & jpi) & (jpi | close) & (distance <= 10) & gammas, F.when(n_matched >= 2, 3).otherwise(4))
        .when(~(energy & jpi) & (jpi | close) & (distance <= delta), F.when(gammas, 5).otherwise(6))
        .when(energy & gammas & ~jpi & (F.coalesce(spin_gap, F.lit(0)) <= 6), 3)
        .otherwise(-1)
    )


def prefilter_candidates(rows: DataFrame, record: list[str]) -> DataFrame:
    """Of a record's candidate groups the one with most consistent gammas and the
    nearest stay, and farther ones of no better order; weak orders go if there
    is a strong one."""
    by_gammas = Window.partitionBy(*record).orderBy(F.desc("n_matched"), "distance", "group_id")
    by_distance = Window.partitionBy(*record).orderBy("distance", F.desc("n_matched"), "group_id")
    best = F.min(F.when(F.col("match_order") > 0, F.col("match_order"))).over(Window.partitionBy(*record))
    ranked = rows.withColumn("__g", F.row_number().over(by_gammas)).withColumn("__d", F.row_number().over(by_distance)).withColumn("__best", best)
    kept = ((F.col("__g") == 1) | (F.col("__d") == 1)) & (F.col("match_order") > 0) & ~((F.col("__best") < 5) & (F.col("match_order") > 5))
    return ranked.where(kept).drop("__g", "__d", "__best")


def assign_in_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """Records to groups, both ascending in energy, without crossing: of all such
    assignments the one with most records placed and the least total distance.
    ``rows``: by, record (rank), grp (rank), cost; ``by`` should name an island
    of energies, beyond which no pair reaches."""
    def solve(record: list[int], grp: list[int], costs: list[float]) -> list[tuple]:
        records, sides = sorted(set(record)), sorted(set(grp))
        cost = dict(zip(zip(record, grp, strict=True), costs, strict=True))
        width = len(sides) + 1
        # best[j]: (records placed, -distance) with groups up to j in use.
        best = [[(0, 0.0)] * width]
        for r in records:
            before, now = best[-1], [(0, 0.0)]
            for j, g in enumerate(sides, 1):
                choice = max(before[j], now[j - 1])
                if (r, g) in cost:
                    n, d = before[j - 1]
                    choice = max(choice, (n + 1, d - cost[r, g]))
                now.append(choice)
            best.append(now)
        out, i, j = [], len(records), width - 1
        while i and j:
            n, d = best[i - 1][j - 1]
            pair = (records[i - 1], sides[j - 1])
            if pair in cost and best[i][j] == (n + 1, d - cost[pair]):
                out.append(pair)
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out

    return by_island(rows, by, ["record", "grp", "cost"], solve, "record int, grp int")


def assign_near(rows: DataFrame, by: list[str], reach: float) -> DataFrame:
    """What ``assign_in_order`` gives for all pairs no farther apart than ``reach``,
    their distance the cost, without forming them.  ``rows``: by, side (``record`` or
    ``grp``), place (rank on its side, ascending in x) and x.

    An island is read as its records and groups; of a comparison only the step is
    kept, in a byte.
    """

    def solve(sides: list[str], places: list[int], xs: list[float]) -> list[tuple]:
        one, two = (sorted((p, x) for s, p, x in zip(sides, places, xs, strict=True) if s == name) for name in ("record", "grp"))
        taken = _near_in_order([x for _, x in one], [x for _, x in two], reach)
        return [(one[i][0], two[j][0]) for i, j in taken]

    return by_island(rows.where("x IS NOT NULL"), by, ["side", "place", "x"], solve, "record int, grp int")


def _near_in_order(xs: list[float], centres: list[float], reach: float) -> list[tuple[int, int]]:
    """Pairs (place of x, place of centre) of ascending values, as many as can be, then
    as near; of equal choices the pair, then no centre for the x.  Left of the centres
    in reach of an x the best so far stays as it was, right of them it is one value."""
    best = [(0, 0.0)] * (len(centres) + 1)
    steps: list[tuple[int, bytearray, int]] = []
    first = last = 0  # centres[first:last] may be in reach, best holds up to last
    for x in xs:
        top, before = best[last], last
        while last < len(centres) and (centres[last] <= x or abs(x - centres[last]) <= reach):
            last += 1
        while first < last and abs(x - centres[first]) > reach:
            first += 1
        best[before + 1 : last + 1] = [top] * (last - before)
        codes = bytearray(last - first)
        corner = left = best[first]
        for j in range(first, last):
            up = best[j + 1]
            pair = (corner[0] + 1, corner[1] - abs(x - centres[j]))
            new = max(up, left, pair)
            codes[j - first] = 2 if new == pair else 0 if new == up else 1
            best[j + 1] = left = new
            corner = up
        steps.append((first, codes, int(best[last] != top)))
    out: list[tuple[int, int]] = []
    i, j = len(xs), len(centres)
    while i and j:
        start, codes, beyond = steps[i - 1]
        step = 0 if j <= start else codes[j - start - 1] if j <= start + len(codes) else beyond
        if step == 2:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif step == 0:
            i -= 1
        else:
            j -= 1
    return out


def drop_marked_groups(members: DataFrame) -> DataFrame:
    """Groups all of whose tags are ``*`` and that hold no adopted record go; a
    star on a tag that has become unique goes with them."""
    per_group = members.groupBy("group_id").agg(F.bool_and(F.coalesce(F.col("marker") == "*", F.lit(False))).alias("starred"), F.bool_or("is_adopted").alias("adopted"))
    kept = members.join(per_group.where("NOT starred OR adopted").select("group_id"), "group_id", "left_semi")
    uses = kept.groupBy("record_id").agg(F.count("*").alias("uses"))
    return kept.join(uses, "record_id").withColumn("marker", F.when((F.col("marker") == "*") & (F.col("uses") == 1), F.lit(None)).otherwise(F.col("marker"))).drop("uses")


def best_record(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def look_around(rows: DataFrame, by: list[str], order: list[str], flag: Column, reach: int, name: str) -> DataFrame:
    """Whether ``flag`` holds within ``reach`` rows before or after."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)
    return rows.withColumn(name, F.max(flag.cast("int")).over(frame) == 1)


def spread_labels(positions: DataFrame, by: str, least: float, sweeps: int = 200) -> DataFrame:
    """Label heights moved apart until neighbours are ``least`` apart.  Labels
    of one figure (``by``) are moved together."""
    kind = positions.schema[by].dataType.simpleString()

    def move(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("y", kind="stable")
        y = part.y.to_numpy(float).copy()
        for _ in range(sweeps):
            moved = False
            for k in range(len(y) - 1):
                lack = least - (y[k + 1] - y[k])
                if lack > 1e-9:
                    y[k] -= lack / 2
                    y[k + 1] += lack / 2
                    moved = True
            if not moved:
                break
        return part.assign(label_y=y)[[by, "label_id", "y", "label_y"]]

    return positions.groupBy(by).applyInPandas(move, f"`{by}` {kind}, label_id string, y double, label_y double")


def bar_offsets(rows: DataFrame, by: list[str], near: float = 150.0, step: int = 30) -> DataFrame:
    """Sideways offset of crowded level bars."""
    order = Window.partitionBy(*by).orderBy("x", "id")
    up, down = F.lead("x").over(order) - F.col("x"), F.col("x") - F.lag("x").over(order)
    return rows.withColumn("offset", F.when(up < near, -step).otherwise(0) + F.when(down < near, step).otherwise(0))




def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Rows with their place in an order, inside each ``by`` if there is any.

    A place in the whole table is a place in a range of the order plus the rows of
    the ranges before; only the ranges' counts meet in one task.
    """
    if by:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ordered-rows")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + inside).cast("long")).drop("__range", "__before")


def dataset_rank(dataset: Column, order: list[str]) -> Column:
    """Place of a dataset in a given order; others come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), dataset), F.lit(0)) - 1, F.lit(len(order)))


def datasets_of(members: DataFrame, key: str, dataset: str) -> DataFrame:
    """The distinct datasets of each cluster, sorted."""
    return members.groupBy(key).agg(F.sort_array(F.collect_set(dataset)).alias("datasets"))
