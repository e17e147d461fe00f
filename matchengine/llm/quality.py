"""Quality rules with thresholds from mergeable quantile sketches.

Counts come from built-in functions inside one projection per document.  Every
ratio is an integer (per thousand, word length in tenths of a character), so a
histogram of one (language, source) is a quantile sketch whose merge is
addition: partial counts are summed before and after the shuffle, a hot source
costs no more than a small one, and the sketch of a language is the sum of its
sources'.  Values below ``EXACT`` have a step of their own; above, a step is a
relative one of 1/1024, so a sketch stays small and nothing is clipped.

Thresholds come from the documents that pass the base rules.  A group's
quantiles are shrunk towards those of its language by ``SHRINK`` documents, so
that a small group, or one full of junk, borrows from the rest.  A ratio is too
high above an upper quantile plus ``fence`` times its distance to a base
quantile (word length also too low, likewise); the distance counts as one step
at least, which is all the slack there is.  Ratios that clean text has only now
and then (repeated lines and words) take a quantile far out in the tail, the
others one that junk of a fifth of a group does not move.

Defined results: a null or empty text has no words and fails the base rules;
null languages and sources are groups of their own; a group of a few documents
has nearly the limits of its language; repeated rows count as often as they
occur and are judged alike; only the named input columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchengine.durable import keep

EXACT = 1024
SHRINK = 100
SPACE = " \t-\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Fence:
    """Quantiles per thousand: the limit is ``upper`` plus ``times`` its distance
    to ``base``; with ``below`` also ``base`` less that."""

    upper: int
    base: int
    times: int
    below: bool = False


RATIOS = {
    "symbol_ratio": Fence(800, 500, 8),
    "dup_line_ratio": Fence(980, 500, 2),
    "repeat_ratio": Fence(980, 500, 2),
    "word_length": Fence(750, 250, 8, below=True),
}


def counts(documents: DataFrame, *, text: str, carry: dict[str, str]) -> DataFrame:
    """``carry`` (new name: column) and the base counts of each document."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = documents.select(
        *[F.col(f"`{c}`").alias(n) for n, c in carry.items()],
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.array_remove(F.split(body, f"[{SPACE}]+"), "").alias("__w"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{SPACE}]")).alias("__l"),
    )
    word, at = F.col("__w"), lambda i, j: F.get(F.col("__w"), i + j)
    windows = F.when(F.size(word) >= 5, F.transform(F.sequence(F.lit(0), F.size(word) - 5), lambda i: F.xxhash64(*[at(i, j) for j in range(5)]))).otherwise(F.array().cast("array<long>"))
    hashed = split.select(
        *carry,
        F.size(word).cast("long").alias("n_words"),
        F.length(F.array_join(word, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        windows.alias("__h"),
    )
    plain = [c for c in hashed.columns if c != "__h"]
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:long,i:int>>")
    paired = hashed.select(*plain, F.when(F.size(F.array_distinct("__h")) == F.size("__h"), none).otherwise(pairs).alias("__p"))
    return paired.select(*plain, _repeated_words(F.col("__p")).cast("long").alias("n_repeat_words"))


def _repeated_words(pairs: Column) -> Column:
    """Words inside five-word windows whose hash occurs twice or more.

    ``pairs`` holds the windows' hashes and places, sorted: equal hashes are
    neighbours.
    """
    twice = F.filter(pairs, lambda x, k: F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    return F.aggregate(places, F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n")), lambda acc: acc["n"])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _ratios() -> dict[str, Column]:
    """Integers from 0; null where the denominator is zero."""
    part = lambda a, b, scale: F.expr(f"({scale} * {a}) div nullif({b}, 0)")
    return {
        "symbol_ratio": part("n_symbols", "word_chars", 1000),
        "dup_line_ratio": part("n_dup_lines", "n_lines", 1000),
        "repeat_ratio": part("n_repeat_words", "n_words", 1000),
        "word_length": part("word_chars", "n_words", 10),
    }


def _step(value: Column) -> Column:
    """The lower end of the sketch's step that holds a value."""
    low_bits = F.length(F.bin(value)) - EXACT.bit_length()
    return F.when(value < EXACT, value).otherwise(value - F.pmod(value, F.pow(F.lit(2.0), low_bits).cast("long")))


def sketches(counted: DataFrame, group: list[str]) -> DataFrame:
    """Histogram sketch of each ratio in each group: bin and count."""
    stacked = counted.select(*group, F.posexplode(F.array(*[r.cast("long") for r in _ratios().values()])).alias("ratio", "value")).where("value IS NOT NULL")
    return stacked.groupBy(*group, "ratio", _step(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, group: list[str]) -> DataFrame:
    """The sum of the sketches of each (coarser) group."""
    return sketch.groupBy(*group, "ratio", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, group: list[str], points: list[int]) -> DataFrame:
    """n and the least bin up to which ``points`` per thousand lie, as q<point>."""
    whole = sketch.groupBy(*group, "ratio").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))

    def at(point: int) -> Column:
        step = lambda acc, x: F.struct((acc["sum"] + x["n"]).alias("sum"), F.when((acc["bin"] < 0) & (1000 * (acc["sum"] + x["n"]) >= point * F.col("total")), x["bin"]).otherwise(acc["bin"]).alias("bin"))
        return F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("bin")), step, lambda acc: acc["bin"])

    return whole.select(*group, "ratio", F.col("total").alias("n"), *[at(p).alias(f"q{p}") for p in points])


def thresholds(counted: DataFrame, lang: str, source: str, shrink: int = SHRINK) -> DataFrame:
    """One row per (lang, source): the highest (and lowest) value of each ratio."""
    points = sorted({p for f in RATIOS.values() for p in (f.upper, f.base)})
    own = sketches(counted, [lang, source])
    group = quantiles(own, [lang, source], points)
    wide = quantiles(merged(own, [lang]), [lang], points).select(F.col(lang).alias("__wide"), F.col("ratio").alias("__ratio"), *[F.col(f"q{p}").alias(f"w{p}") for p in points])
    both = group.join(wide, F.col(lang).eqNullSafe(F.col("__wide")) & (F.col("ratio") == F.col("__ratio")))
    q = {p: F.expr(f"(n * q{p} + {shrink} * w{p}) div (n + {shrink})") for p in points}
    columns = []
    for k, (name, f) in enumerate(RATIOS.items()):
        reach = f.times * F.greatest(q[f.upper] - q[f.base], F.lit(1))
        columns.append(F.max(F.when(F.col("ratio") == k, q[f.upper] + reach)).alias(f"{name}_most"))
        if f.below:
            columns.append(F.max(F.when(F.col("ratio") == k, q[f.base] - reach)).alias(f"{name}_least"))
    return both.groupBy(lang, source).agg(*columns)


def judge(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: doc_id, lang, source, the counts, base_failed and
    kept."""
    return _judged(documents, text, {"doc_id": doc_id, "__lang": lang, "__source": source}).withColumnsRenamed({"__lang": "lang", "__source": "source"})


def _judged(documents: DataFrame, text: str, carry: dict[str, str]) -> DataFrame:
    counted = keep(counts(documents, text=text, carry=carry).withColumn("base_failed", base_failed()), "quality-counts")
    limits = thresholds(counted.where("NOT base_failed"), "__lang", "__source").withColumnsRenamed({"__lang": "__l", "__source": "__s"})
    ratios = _ratios()
    tests = []
    for name, f in RATIOS.items():
        tests.append(ratios[name] > F.col(f"{name}_most"))
        if f.below:
            tests.append(ratios[name] < F.col(f"{name}_least"))
    outlier = reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])
    joined = counted.join(limits, F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s")), "left")
    return joined.select(*counted.columns, (~F.col("base_failed") & ~outlier).alias("kept"))


def keep_good(documents: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``documents`` without the rejected ones, columns unchanged.

    A verdict depends on the text, language and source alone, so it is joined
    by these (the text by two hashes) and by doc_id.
    """
    column = lambda c: F.col(f"`{c}`")
    row = F.struct(*[column(c) for c in documents.columns])
    marked = documents.select(row.alias("row"), column(text).alias("text"), column(doc_id).alias("k0"), F.xxhash64(column(text)).alias("k1"), F.xxhash64(F.lit(1), column(text)).alias("k2"), column(lang).alias("k3"), column(source).alias("k4"))
    judged = _judged(marked, "text", {"b0": "k0", "b1": "k1", "b2": "k2", "__lang": "k3", "__source": "k4"})
    bad = judged.where("NOT kept").select("b0", "b1", "b2", F.col("__lang").alias("b3"), F.col("__source").alias("b4")).distinct()
    same = [F.col(f"k{n}").eqNullSafe(F.col(f"b{n}")) for n in range(5)]
    return marked.join(bad, reduce(lambda a, b: a & b, same), "left_anti").select("row.*")
