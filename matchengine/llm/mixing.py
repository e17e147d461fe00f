"""Mixing of sources to target weights by Pareto order sampling.

Every source gets a target, its share by weight of all words; none is taken more
than ``most`` times, and what such sources leave is shared again among the others
(``targets``).  A source with a target of r times its words takes each document
floor(r) times, for certain, and a sample of its documents once more.

The sample is of fixed size in each stratum, the documents of a source whose
sizes are of one step (exact below ``EXACT``, then within 1/EXACT).  Strata are
settled from the longest documents down: each takes the number of documents
nearest to the words it should give, and hands the difference to the next, so a
source ends within about its shortest documents of its target.  Inside a stratum
inclusion probabilities rise or fall with the size so that the expected words are
what the stratum should give (as far as probabilities stay in [0, 1]), and an
optional column of preferences multiplies the odds.

Pareto order sampling: of a stratum's documents the n with the least
``u / (1 - u) / (p / (1 - p))`` are taken, u the random number of a document, p its
inclusion probability.  The n-th is found by radix selection, so a stratum is
neither sorted nor gathered, however many of the rows it holds.

Random numbers are hashes of id, source and text, so reruns agree.

Defined results: null and empty texts have no words and are taken 0; null sources
are one source, the last; a source without words has target 0; rows that are equal
in id, source and text are documents of their own, of which any may be the ones
taken; an empty table gives no rows; other columns are not read.  A preference must
be above 0, null is 1.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchengine.durable import keep
from matchengine.llm import radix
from matchengine.operators.groups import numbered

SPACE = " \t-\r"
EXACT = 256
#: Bits of random numbers and of the order they give.
BITS = 52


def measure(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", preference: str | None = None) -> DataFrame:
    """doc_id, source, size (words), u (random, in [0, 2^52)), step (the stratum in
    its source), odds (the preference) and row, a number of each row."""
    body, name = F.col(f"`{text}`"), F.col(f"`{source}`").cast("string")
    size = F.size(F.array_remove(F.split(F.coalesce(body, F.lit("")), f"[{SPACE}]+"), "")).cast("long")
    odds = F.lit(1.0) if preference is None else F.coalesce(F.col(f"`{preference}`").cast("double"), F.lit(1.0))
    u = F.shiftrightunsigned(F.xxhash64(F.col(f"`{doc_id}`"), name, body), 64 - BITS)
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), name.alias("source"), size.alias("size"), u.alias("u"), odds.alias("odds"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("step", step(F.col("size")))


def step(size: Column) -> Column:
    """The lower end of the step that holds a size."""
    low_bits = F.length(F.bin(size)) - EXACT.bit_length()
    return F.when(size < EXACT, size).otherwise(size - F.pmod(size, F.pow(F.lit(2.0), low_bits).cast("long")))


def targets(sizes: DataFrame, most: int) -> DataFrame:
    """``sizes`` (source, size, weight) with target: shares by weight of all sizes,
    at most ``most`` times a source's own; what is above goes to the others by
    weight, until none is above.  A round is one sum over the sources."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    share, stopped, left = None, 0, total
    while True:
        if share is None:
            above = F.lit(False)
        else:
            # share is words * weight / weights, compared without rounding
            above = F.expr(f"CAST({most} * size AS DECIMAL(38,0)) * {share[1]} <= CAST({share[0]} AS DECIMAL(38,0)) * weight")
        found = sizes.agg(F.sum(F.when(above, most * F.col("size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.sum(F.when(above, 1).otherwise(0))).first()
        held, weight, count = (found[0] or 0), (found[1] or 0), (found[2] or 0)
        left = total - held
        if share is not None and count == stopped or not weight:
            break
        share, stopped = (left, weight), count
    if share is None:
        return sizes.withColumn("target", F.lit(0.0))
    even = F.lit(float(share[0])) * F.col("weight") / F.lit(float(share[1]))
    return sizes.withColumn("target", F.when(above, (most * F.col("size")).cast("double")).otherwise(even))


def settle(strata: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each stratum of one source are taken once more.

    ``strata`` has step, m documents, their words, squares (sum of squared
    differences to step), the least and largest size, and the source's size and
    target.  Adds whole, n, and the inclusion probability of a document of size z
    as base + slope * (z - mean).
    """
    out, carry = [], 0.0
    for r in strata.sort_values("step", ascending=False).itertuples(index=False):
        size, target = int(r.source_size), float(r.target)
        whole = int(target // size) if size else 0
        part = (target - whole * size) / size if size else 0.0
        m, words = int(r.m), int(r.words)
        mean, want = words / m, part * words + carry
        n = min(m, max(0, round(want / mean))) if mean else 0
        base, slope = n / m, 0.0
        spread = float(int(r.squares) - (words - m * int(r.step)) ** 2 / m)
        reach = max(int(r.most) - mean, mean - int(r.least))
        if reach > 0 and spread > 0 and 0 < n < m:
            slope = (want - n * mean) / spread
            most = min(base, 1 - base) / reach
            slope = min(most, max(-most, slope))
        carry = want - n * mean - slope * spread
        out.append((r.sid, int(r.step), whole, n, base, slope, mean))
    return pd.DataFrame(out, columns=["sid", "step", "whole", "n", "base", "slope", "mean"])


def mix(documents: DataFrame, *, weights: Sequence[int] = (1, 2, 3), most: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", preference: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (words of
    its source), copies, and taken, the words that the mix takes.

    ``weights`` go to the sources in the order of their names, null last, and
    repeat.
    """
    rows = keep(measure(documents, doc_id=doc_id, text=text, source=source, preference=preference), "mix-measured")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    places = numbered(sizes, [], [F.col("source").isNull(), F.col("source")], "sid")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    aimed = keep(targets(keep(places.withColumn("weight", weight.cast("long")), "mix-sources"), most).withColumnRenamed("size", "source_size"), "mix-targets")
    offset = (F.col("size") - F.col("step")).cast("decimal(18,0)")
    strata = rows.groupBy("source", "step").agg(F.count("*").alias("m"), F.sum("size").alias("words"), F.sum(offset * offset).alias("squares"), F.min("size").alias("least"), F.max("size").alias("most"))
    strata = strata.join(aimed, strata["source"].eqNullSafe(aimed["source"])).select("sid", "step", "m", "words", "squares", "least", "most", "source_size", "target")
    planned = keep(strata.groupBy("sid").applyInPandas(settle, "sid long, step long, whole long, n long, base double, slope double, mean double"), "mix-plan")
    names = aimed.select(F.col("source").alias("__name"), "sid", "source_size", "target")
    ordered = rows.join(names, F.col("source").eqNullSafe(F.col("__name"))).join(planned, ["sid", "step"])
    chance = F.col("base") + F.col("slope") * (F.col("size") - F.col("mean"))
    u = (F.col("u") + 0.5) / F.lit(float(1 << BITS))
    # The quotient q of the odds as q / (1 + q), which has the same order, in 52 bits.
    against, along = u * (1 - chance), (1 - u) * chance * F.col("odds")
    order = F.least(F.floor(against / (against + along) * F.lit(float(1 << BITS))), F.lit((1 << BITS) - 1)).cast("long")
    ordered = ordered.withColumn("order", F.when(F.col("n") > 0, order).otherwise(F.lit(0).cast("long")))
    cuts = keep(radix.kth_values(ordered.where("n > 0"), ["sid", "step"], "order", "n", BITS).withColumnRenamed("n", "at_cut"), "mix-cuts")
    marked = ordered.join(cuts, ["sid", "step"], "left")
    extra = F.coalesce((F.col("order") < F.col("cut")) | (F.col("order") == F.col("cut")), F.lit(False))
    if not cuts.where("at_cut > need").isEmpty():
        # Equal rows: as many as are missing, by their numbers.
        equal = marked.where("at_cut > need AND order = cut").select("sid", "step", "row", "need")
        last = radix.kth_values(equal, ["sid", "step"], "row", "need", 63).select("sid", "step", F.col("cut").alias("last"))
        marked = marked.join(keep(last, "mix-equal"), ["sid", "step"], "left")
        extra = extra & ((F.col("order") < F.col("cut")) | F.col("last").isNull() | (F.col("row") <= F.col("last")))
    copies = F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(F.lit(0).cast("long"))
    return marked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
