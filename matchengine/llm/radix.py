"""Radix selection: the k-th value of every group from histograms of value bits.

A group's values are never sorted or gathered.  Each round counts, per group, the
next few bits of the values that agree with what is settled so far; counts
are summed before and after the shuffle, and a group has at most 2^digit of them.
The bin that holds the k-th value settles these bits; what lies before it is in,
what lies behind it is out.  After the last bits the bin is one value, and
``need`` says how many of its rows belong to the first k.

``top`` ranks rows by a value, largest first, and equal ones by the UTF-8 bytes of
an item: rows of the threshold value that are too many are divided further by the
bytes behind their longest common prefix, again by histograms, so that each round
splits them.

Group columns must not be null.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchengine.durable import keep

DIGIT = 8
#: For rankings, whose groups are few.
WIDE_DIGIT = 10
#: Rows of one value that are sorted without further division.
SETTLED = 256


def _bin_of_kth(counts: DataFrame, group: list[str], digit: str) -> DataFrame:
    """Of counts (group, digit, n, need) the bin that holds the need-th row."""
    whole = Window.partitionBy(*group)
    running = whole.orderBy(digit).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("__upto", F.sum("n").over(running)).withColumn("__need", F.least("need", F.sum("n").over(whole)))
    here = placed.where((F.col("__upto") - F.col("n") < F.col("__need")) & (F.col("__upto") >= F.col("__need")))
    return here.select(*group, digit, "n", (F.col("__need") - F.col("__upto") + F.col("n")).alias("need"))


def kth_values(rows: DataFrame, group: list[str], value: str, k: str, bits: int, digit: int = DIGIT) -> DataFrame:
    """Per group: ``cut``, the k-th smallest value (the largest if there are
    fewer), ``n`` rows that have it, and ``need``, how many of these are among the
    first k.

    ``value`` is a long from 0 below 2^bits, ``k`` a long column, the same in all
    rows of a group; groups with k below 1 have no row in the result.
    """
    width = -(-bits // -(-bits // digit))
    shift = max(0, bits - width)
    rows = rows.where(F.col(k) > 0).select(*group, F.col(value).alias("__v"), F.col(k).alias("__k"))
    leading = lambda s: F.shiftright("__v", s).alias("__d")
    state = _bin_of_kth(rows.groupBy(*group, leading(shift)).agg(F.count("*").alias("n"), F.max("__k").alias("need")), group, "__d")
    while shift:
        width = min(width, shift)
        inside = rows.join(state.withColumnRenamed("__d", "__prefix").drop("n"), group).where(F.shiftright("__v", shift) == F.col("__prefix"))
        shift -= width
        state = _bin_of_kth(inside.groupBy(*group, leading(shift)).agg(F.count("*").alias("n"), F.max("need").alias("need")), group, "__d")
    return state.withColumnRenamed("__d", "cut")


@F.pandas_udf(T.LongType())
def _common_bytes(low: pd.Series, high: pd.Series) -> pd.Series:
    """Bytes that two strings share at their start."""
    return pd.Series([len(os.path.commonprefix([a.encode(), b.encode()])) for a, b in zip(low, high, strict=True)], dtype="int64")


def _refined(ties: DataFrame, group: list[str], item: str, settled: int) -> DataFrame:
    """Rows (group, item) that hold the first ``need`` items of each group by
    UTF-8 bytes, and at most ``settled`` others."""
    done: DataFrame | None = None
    while True:
        stats = ties.groupBy(*group).agg(F.count("*").alias("n"), F.max("need").alias("need"), F.min(item).alias("__low"), F.max(item).alias("__high"))
        # Equal items cannot be divided; any need of them will do.
        stats = keep(stats.withColumn("open", (F.col("n") > F.col("need") + settled) & (F.col("__low") < F.col("__high"))), "radix-ties")
        closed = ties.join(stats.where("NOT open").select(*group), group, "left_semi").select(*group, item)
        done = closed if done is None else done.unionByName(closed)
        if stats.where("open").isEmpty():
            return done
        split = ties.join(stats.where("open").select(*group, _common_bytes("__low", "__high").alias("__from")), group)
        split = split.withColumn("__d", F.expr(f"substring(encode(`{item}`, 'UTF-8'), CAST(__from AS INT) + 1, 2)")).drop("__from")
        bins = _bin_of_kth(split.groupBy(*group, "__d").agg(F.count("*").alias("n"), F.max("need").alias("need")), group, "__d")
        both = keep(split.drop("need").join(bins.select(*group, F.col("__d").alias("__at"), "need"), group).where("__d <= __at"), "radix-bytes")
        done = done.unionByName(both.where("__d < __at").select(*group, item))
        ties = both.where("__d = __at").select(*group, item, "need")


def top(rows: DataFrame, group: list[str], value: str, item: str, k: int, *, settled: int = SETTLED) -> DataFrame:
    """The first ``k`` rows of each group by value, largest first, then by item:
    group, item, value and ``rank`` from 1.  Values are longs from 0."""
    rows = rows.select(*group, item, value)
    largest = rows.agg(F.max(value)).first()[0]
    bits = max(1, int(largest or 0).bit_length())
    mirrored = rows.withColumn("__v", F.lit((1 << bits) - 1) - F.col(value)).withColumn("__k", F.lit(k).cast("long"))
    cuts = keep(kth_values(mirrored, group, "__v", "__k", bits, WIDE_DIGIT), "radix-cuts")
    near = keep(mirrored.join(cuts.select(*group, "cut", "need"), group).where("__v <= cut"), "radix-near")
    ties = _refined(near.where("__v = cut").select(*group, item, "need"), group, item, settled)
    found = near.where("__v < cut").select(*group, item, value).unionByName(ties.join(cuts.select(*group, (F.lit((1 << bits) - 1) - F.col("cut")).alias(value)), group).select(*group, item, value))
    return ranked(found, group, value, item).where(F.col("rank") <= k)


def ranked(rows: DataFrame, group: list[str], value: str, item: str | Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), item)))
