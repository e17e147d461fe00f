"""Spin-parity options carried along gammas until nothing changes.

Every gamma says which spins and parities of one of its levels go with those of the
other (``transitions``).  A level keeps the options that every gamma to a level of
known options allows; a level without options gets all that these gammas allow, and
then limits its own neighbours.  Rounds go on until no level changes: what is left is
arc consistent, so no option that is part of a consistent scheme is lost.

A level that keeps no option contradicts its neighbours.  That is flagged, and from
then on the level says nothing: it neither gets options nor limits others.

A round compares only the levels next to those that changed in the round before.  A
level's gammas are counted, not gathered, so a level of very many is no burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchengine.durable import discard, keep
from matchengine.functions import nuclear

OPTIONS = "array<struct<two_j:int,parity:string>>"


def reachable(option: Column, alternatives: Column) -> Column:
    """Spins and parities that a transition of one of the alternatives, each an array
    of (l, changes) that all take part, joins to ``option``."""
    two_j, parity = option["two_j"], option["parity"]

    def fits(part: Column, other: Column) -> Column:
        triangle = (F.abs(two_j - other["two_j"]) <= 2 * part["l"]) & (two_j + other["two_j"] >= 2 * part["l"])
        return triangle & (part["changes"].isNull() | ((parity != other["parity"]) == part["changes"]))

    def of(parts: Column) -> Column:
        most = F.array_max(F.transform(parts, lambda p: p["l"]))
        spins = F.sequence(F.pmod(two_j, F.lit(2)), two_j + 2 * most, F.lit(2))
        both = F.flatten(F.transform(spins, lambda j: F.transform(F.array(F.lit("+"), F.lit("-")), lambda p: F.struct(j.cast("int").alias("two_j"), p.alias("parity")))))
        return F.filter(both, lambda o: F.forall(parts, lambda p: fits(p, o)))

    return F.array_distinct(F.flatten(F.transform(alternatives, of)))


def propagated_options(levels: DataFrame, gammas: DataFrame, key: str = "level", rounds: int | None = None) -> DataFrame:
    """key, options (sorted), contradiction, and derived (options that came from the
    gammas alone).

    ``levels``: key, options as array of (two_j, parity); null or empty ones are
    unknown, a null parity is either.  ``gammas``: initial, final, mult (text; null
    or empty is unknown, see ``nuclear.transitions``).  Gammas of levels that are not
    there, or from a level to itself, say nothing.  ``rounds`` ends the loop early.
    """
    given = F.coalesce("options", F.array().cast(OPTIONS))
    signs = lambda o: F.when(o["parity"].isNull(), F.array(F.lit("+"), F.lit("-"))).otherwise(F.array(o["parity"]))
    spread = F.flatten(F.transform(given, lambda o: F.transform(signs(o), lambda p: F.struct(o["two_j"].cast("int").alias("two_j"), p.alias("parity")))))
    state = levels.select(F.col(key).alias("level"), F.array_sort(F.array_distinct(spread)).alias("options"))
    state = keep(state.withColumn("contradiction", F.lit(False)).withColumn("derived", F.lit(False)).withColumn("changed", F.size("options") > 0), "spin-options")
    named = gammas.where("initial <> final").select("initial", "final", nuclear.transitions(F.col("mult")).alias("alternatives")).withColumn("gamma", F.monotonically_increasing_id())
    turned = F.inline(F.array(F.struct(F.col("initial").alias("level"), F.col("final").alias("other")), F.struct(F.col("final").alias("level"), F.col("initial").alias("other"))))
    arcs = keep(named.select("gamma", "alternatives", turned), "spin-arcs")
    done = 0
    while (rounds is None or done < rounds) and not state.where("changed").isEmpty():
        grown = keep(_round(state, arcs), "spin-options")
        discard(state)
        state, done = grown, done + 1
    return state.select(F.col("level").alias(key), "options", "contradiction", "derived")


def _round(state: DataFrame, arcs: DataFrame) -> DataFrame:
    touched = arcs.join(state.where("changed").select(F.col("level").alias("other")), "other", "left_semi").select("level").distinct()
    known = state.where((F.size("options") > 0) & ~F.col("contradiction")).select(F.col("level").alias("other"), F.col("options").alias("theirs"))
    told = arcs.join(touched, "level", "left_semi").join(known, "other")
    limits = told.select("level", F.array_distinct(F.flatten(F.transform("theirs", lambda o: reachable(o, F.col("alternatives"))))).alias("allowed"))
    # An option is allowed by all gammas if as many allow it as there are; the row of
    # no option counts them.
    votes = limits.select("level", F.explode(F.concat("allowed", F.array(F.lit(None).cast("struct<two_j:int,parity:string>")))).alias("o")).groupBy("level", "o").agg(F.count("*").alias("n"))
    counted = votes.groupBy("level").agg(F.collect_list(F.struct("o", "n")).alias("votes"))
    joined = state.join(counted, "level", "left")
    every = F.get(F.filter("votes", lambda v: v["o"].isNull()), 0)["n"]
    agreed = F.transform(F.filter("votes", lambda v: v["o"].isNotNull() & (v["n"] == F.col("every"))), lambda v: v["o"])
    joined = joined.withColumn("every", every).withColumn("allowed", F.coalesce(agreed, F.array().cast(OPTIONS)))
    allowed = F.col("allowed")
    unknown = (F.size("options") == 0) & ~F.col("contradiction")
    new = F.when(F.col("every").isNull() | F.col("contradiction"), F.col("options")).when(unknown, F.array_sort(allowed)).otherwise(F.filter("options", lambda o: F.array_contains(allowed, o)))
    empty = F.col("contradiction") | (F.col("every").isNotNull() & (F.size("new") == 0))
    return joined.withColumn("new", new).select(
        "level",
        F.col("new").alias("options"),
        empty.alias("contradiction"),
        F.when(empty, F.lit(False)).otherwise(F.col("derived") | (unknown & (F.size("new") > 0))).alias("derived"),
        ((F.size("new") != F.size("options")) & (F.size("new") > 0)).alias("changed"),
    )
