"""Reference tables in versions: masses and spins of ground states, upper limits of
transition strengths.

A table has a row for each key and version, with the date from which it holds.  A
record is looked up as of its own date: the version that held then, not the newest.
Versions become intervals that do not overlap, so a record joins one row at most and
a key of very many records is split like any other join's.  Intervals that have ended
are spread over blocks of ``DAYS``, so a record meets those of its own block only,
however many versions its key has, and the one that still holds.  Of several versions of
one date the one of the highest number holds.

A record before the first version, of an unknown key, or without a date finds nothing
and gets nulls; null keys are unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a block; a key has as many intervals in it at most, and one more.
DAYS = 8


def intervals(versions: DataFrame, key: list[str]) -> DataFrame:
    """``versions`` (key, since, version and values) with ``until``, null for the one
    that still holds; versions that another of the same date replaces are left out."""
    order = Window.partitionBy(*key).orderBy("since", "version")
    closed = versions.where("since IS NOT NULL").withColumn("until", F.lead("since").over(order))
    return closed.where("until IS NULL OR until > since")


def as_of(rows: DataFrame, versions: DataFrame, key: list[str], at: str, columns: dict[str, str]) -> DataFrame:
    """``rows`` with the values that held at their date: ``columns`` names the values
    of the table and what they are called in the result."""
    dim = intervals(versions, key).select(*[F.col(k).alias(f"__{k}") for k in key], F.col("since").alias("__since"), F.col("until").alias("__until"), *[F.col(c).alias(f"__v_{c}") for c in columns])
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return _held(rows, dim, same, at, {f"__v_{c}": n for c, n in columns.items()})


def _held(rows: DataFrame, dim: DataFrame, same: Column, at: str, values: dict[str, str]) -> DataFrame:
    """``rows`` with the ``values`` (and their new names) of the interval of ``dim``
    (__since, __until and others) that is the ``same`` and holds at the date."""
    block = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / DAYS)
    past = dim.where("__until IS NOT NULL").withColumn("__of", F.explode(F.sequence(block("__since"), block("__until"))))
    inside = (F.col("__since") <= F.col(at)) & (F.col(at) < F.col("__until"))
    ended = rows.withColumn("__block", block(at)).join(past, same & (F.col("__block") == F.col("__of")) & inside, "left").select(*rows.columns, *[F.col(v).alias(f"{v}_past") for v in values])
    found = ended.join(dim.where("__until IS NULL"), same & (F.col("__since") <= F.col(at)), "left")
    return found.select(*rows.columns, *[F.coalesce(f"{v}_past", v).alias(n) for v, n in values.items()])


def with_limits(gammas: DataFrame, limits: DataFrame, at: str = "date") -> DataFrame:
    """Gammas (mult, mass, ``at``) with ``limit``, the upper limit of the strength of
    their multipolarity in their region of masses (R20).  ``limits``: mult, low, high
    (masses, both inside), since, version, limit; regions of one multipolarity do not
    overlap.  The first part of a mixture counts."""
    dim = intervals(limits, ["mult", "low", "high"]).select(F.col("mult").alias("__m"), F.col("low").alias("__low"), F.col("high").alias("__high"), F.col("since").alias("__since"), F.col("until").alias("__until"), F.col("limit").alias("__limit"))
    part = F.upper(F.regexp_extract(F.coalesce("mult", F.lit("")), r"([EM][0-9])", 1))
    same = (F.col("__part") == F.col("__m")) & F.col("mass").between(F.col("__low"), F.col("__high"))
    return _held(gammas.withColumn("__part", part), dim, same, at, {"__limit": "limit"}).drop("__part")


def with_decay_energy(parents: DataFrame, masses: DataFrame, at: str = "date") -> DataFrame:
    """Parents (parent, daughter, ``at``) with ``adopted_q``, the difference of their
    mass excesses as of the date (R11), null if either has none.  ``masses``: nuclide,
    since, version, excess, two_j, parity."""
    table = masses.withColumnRenamed("nuclide", "parent")
    one = as_of(parents, table, ["parent"], at, {"excess": "__from"})
    two = as_of(one, masses.withColumnRenamed("nuclide", "daughter"), ["daughter"], at, {"excess": "__to"})
    return two.withColumn("adopted_q", F.col("__from") - F.col("__to")).drop("__from", "__to")


def with_targets(rows: DataFrame, masses: DataFrame, at: str = "date") -> DataFrame:
    """Rows (target, ``at``) with two_j_target and target_parity of the target's
    ground state as of the date (R16)."""
    return as_of(rows, masses.withColumnRenamed("nuclide", "target"), ["target"], at, {"two_j": "two_j_target", "parity": "target_parity"})


def decay_energy_rule(parents: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Messages on Q-values of decay parents against those of the masses.
    ``parents``: key, q and adopted_q."""
    message = F.when(F.col("q").isNull(), F.lit(None)).when(F.col("adopted_q").isNull(), F.lit("no masses of that time")).when(F.abs(F.col("q") - F.col("adopted_q")) > tolerance, F.lit("parent Q-value differs from the masses"))
    return parents.select(key, F.lit("R11").alias("rule"), message.alias("message")).where("message IS NOT NULL")


def strength_rule(gammas: DataFrame, key: list[str]) -> DataFrame:
    """Messages on strengths above their limit (R20); ``?`` marks of a multipolarity
    and limits that are not there say nothing.  ``gammas``: key, strength, limit."""
    told: Column = F.when(F.col("strength") > F.col("limit"), F.lit("transition strength is above the recommended upper limit"))
    return gammas.select(*key, F.lit("R20").alias("rule"), told.alias("message")).where("message IS NOT NULL")
