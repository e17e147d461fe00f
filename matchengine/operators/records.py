"""Small operators on records, datasets and groups: carried values, filters,
statistics, set comparisons and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the last ``value`` that is not null, up to the row itself."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(before))


def statistics(rows: DataFrame, levels: list[str], value: str) -> DataFrame:
    """n, lowest, highest and mean value of each group, of each coarser one (its finer
    columns null) and of all."""
    return rows.rollup(*levels).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))


def source_texts(members: DataFrame, by: list[str], order: list[str], name: Column, percent: Column) -> DataFrame:
    """by, sources: ``A(100%) + B(85%)``, members in order."""
    text = F.concat(name.cast("string"), F.lit("("), percent.cast("int").cast("string"), F.lit("%)"))
    listed = F.sort_array(F.collect_list(F.struct(*order, text.alias("__t"))))
    return members.groupBy(*by).agg(F.concat_ws(" + ", F.transform(listed, lambda x: x["__t"])).alias("sources"))


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among those of ``gone``, such as adopted records."""
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def marked(rows: DataFrame, marks: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is among those of ``marks``, such as levels of a band."""
    return rows.join(marks.select(*key), key, "left_semi")


def clique_counts(members: DataFrame, by: list[str], x: str, reach: float) -> DataFrame:
    """by, members, valid_pairs (no farther apart than ``reach``) and is_clique.

    Pairs are counted along the order of values, not formed: those above a value
    within reach, and half of those equal to it.
    """
    at = Window.partitionBy(*by).orderBy(x)
    rows = members.select(*by, F.col(x).alias("__x"), F.count("*").over(at.rangeBetween(0, reach)).alias("__near"), F.count("*").over(Window.partitionBy(*by, x)).alias("__same"))
    pairs = F.sum(F.col("__near") - F.col("__same")) + F.expr("sum(__same - 1) div 2")
    found = rows.groupBy(*by).agg(F.count("*").alias("members"), pairs.cast("long").alias("valid_pairs"))
    return found.withColumn("is_clique", F.col("valid_pairs") == F.expr("members * (members - 1) div 2"))


def extremes_by_count(children: DataFrame, parents: DataFrame, parent: str, by: str) -> DataFrame:
    """by, fewest and most (the parent with least and with most children, ties by
    name) and n_most.  Parents without children do not count."""
    rank = F.struct("__n", parent)
    counted = parents.join(children.groupBy(parent).agg(F.count("*").alias("__n")), parent)
    return counted.groupBy(by).agg(F.min_by(parent, rank).alias("fewest"), F.max_by(parent, rank).alias("most"), F.max("__n").alias("n_most"))


def most_common(rows: DataFrame, by: str, tag: str) -> DataFrame:
    """by, tag (the most frequent, ties to the last name) and uses."""
    n = rows.groupBy(by, tag).agg(F.count("*").alias("__n"))
    return n.groupBy(by).agg(F.max_by(tag, F.struct("__n", tag)).alias("tag"), F.max("__n").alias("uses"))


def nuclides(datasets: DataFrame, z: str, mass: Column, dataset: str, rank: str) -> DataFrame:
    """z, n_datasets, adopted (the dataset of highest rank) and even_even, of each
    nuclide; ``mass`` is that of its charge ``z``."""
    rows = datasets.groupBy(F.col(z).alias("z")).agg(F.count("*").alias("n_datasets"), F.max_by(dataset, F.struct(rank, dataset)).alias("adopted"))
    return rows.withColumn("even_even", (F.col("z") % 2 == 0) & (mass % 2 == 0))


def ratio_of_places(rows: DataFrame, by: str, place: str, value: str, over: int, under: int) -> DataFrame:
    """by, ratio of the values at two places (the largest of several); groups that
    lack one, or whose lower one is not positive, have none."""
    at = lambda n: F.max(F.when(F.col(place) == n, F.col(value)))
    both = rows.where(F.col(place).isin(over, under)).groupBy(by).agg(at(over).alias("__a"), at(under).alias("__b"))
    return both.where("__a IS NOT NULL AND __b > 0").select(by, (F.col("__a") / F.col("__b")).alias("ratio"))


def shared(x: Column, y: Column) -> Column:
    return F.size(F.array_intersect(x, y)).cast("long")


def disjoint(x: Column, y: Column) -> Column:
    return ~F.arrays_overlap(x, y)


def without_known_texts(rows: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """Rows whose text, apart from case and blanks, is not one of ``known``; compared
    by two hashes of the whole text."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[ \t\n]+", " "))
    hashed = lambda frame: frame.withColumns({"__k": F.xxhash64(plain), "__l": F.xxhash64(F.lit(1), plain)})
    return hashed(rows).join(hashed(known).select("__k", "__l").distinct(), ["__k", "__l"], "left_anti").drop("__k", "__l")


def is_record(name: Column, kind: Column, least: int = 8) -> Column:
    """Whether a line is long enough and has a type."""
    return (F.length(name) >= least) & (F.trim(kind) != "")


def is_theory(kind: Column, word: str) -> Column:
    return kind.contains(word)


def is_strong(size: Column, value: Column, least_size: int, least_value: float) -> Column:
    return (size > least_size) & (value >= least_value)


def average_in_place(values: Column) -> Column:
    """Weighted mean of an array of (x, dx), without a shuffle; values without an
    uncertainty do not weigh."""
    some = F.filter(values, lambda v: v["dx"] > 0)
    total = lambda f: F.aggregate(some, F.lit(0.0), lambda s, v: s + f(v))
    return total(lambda v: v["x"] / (v["dx"] * v["dx"])) / total(lambda v: 1 / (v["dx"] * v["dx"]))
