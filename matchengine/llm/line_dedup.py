"""Removal of repeated line runs by prefix doubling over line sequences.

The suffixes of all documents' line sequences are named, not moved: the name
of a suffix at length k is the earliest position whose first k lines are the
same.  Names at length 2k come from the pairs (name at i, name at i + k), so
each round doubles the length, and a position whose k lines occur only once
drops out for good.  The last round uses the offset that ends at ``min_lines``
exactly.  Positions with a common name form a longest-common-prefix interval
of at least that many lines; every member but the earliest is a later copy,
and overlapping copies join into the maximal repeated run, which is deleted.
A line of ``long_line`` characters or more is a run by itself.

A repeated run of fewer than ``min_lines`` lines is deleted too where it has
``run_words`` words or ``run_chars`` characters (line ends between its lines
included).  Every length below ``min_lines`` is named then, one line more a round.

Only hashes of lines and positions are shuffled; texts meet the deletions in
one join by document.  Names are aggregated before they are joined, so a line
that a third of all documents share costs one row a task; the joins read
written tables, whose hot keys adaptive execution can split.

Defined results: a document is its id and its text; rows that repeat both are
one document and are all treated alike.  Documents are ordered by id (null
first), then by a hash of the text.  Null text stays null and has no lines;
an empty text is one empty line.  A document may lose all its lines; its text
is then empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from matchengine.durable import keep
from matchengine.functions.similarity import once

KEY = ["__id", "__h"]


def _place() -> Column:
    return F.struct("__id", "__h", "__p")


def _named(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose ``key`` occurs at two places or more, with its earliest."""
    names = rows.groupBy(*key).agg(F.min(_place()).alias("__name"), F.max(_place()).alias("__last")).where("__name < __last")
    names = keep(names.select(*key, F.xxhash64("__name").alias("__r1"), F.xxhash64(F.lit(1), "__name").alias("__r2"), "__name"), "line-names")
    return rows.join(names, key).select(*KEY, "__p", *[c for c in rows.columns if c in ("__long", "__least")], F.col("__r1").alias("__n1"), F.col("__r2").alias("__n2"), (_place() > F.col("__name")).alias("__later"))


def _pairs(named: DataFrame, offset: int) -> DataFrame:
    """Each position with the names at itself and ``offset`` lines on."""
    order = Window.partitionBy(*KEY).orderBy("__p")
    ahead = lambda c: F.lead(c, offset).over(order)
    found = named.select(*KEY, "__p", *[c for c in named.columns if c == "__least"], "__n1", "__n2", ahead("__p").alias("__q"), ahead("__n1").alias("__m1"), ahead("__n2").alias("__m2"))
    return found.where(F.col("__q") == F.col("__p") + offset).drop("__q")


def _least(sizes: Column, at: Column, min_lines: int, run_chars: int | None, run_words: int | None) -> Column:
    """Lines from ``at`` on that a run needs to pass a bound, at most ``min_lines``;
    ``sizes`` holds the characters and words of each line."""
    passes, chars, words = [], F.lit(-1), F.lit(0)
    for size in range(1, min_lines):
        line = F.get(sizes, at + (size - 1))
        chars, words = chars + F.coalesce(line["chars"] + 1, F.lit(0)), words + F.coalesce(line["words"], F.lit(0))
        long = (chars >= run_chars if run_chars is not None else F.lit(False)) | (words >= run_words if run_words is not None else F.lit(False))
        passes.append(F.when(long, size))
    return F.coalesce(*passes, F.lit(min_lines))


def repeated_lines(documents: DataFrame, *, doc_id: str, text: str, min_lines: int, long_line: int, run_chars: int | None = None, run_words: int | None = None) -> DataFrame:
    """Lines to delete: __id, __h (hash of the text) and the sorted ``__gone``."""
    bounded = min_lines > 1 and (run_chars is not None or run_words is not None)
    split = F.split(f"`{text}`", "\n")
    plain = lambda x: [F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.length(x) >= long_line).alias("long")]
    if bounded:
        count = lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")) if run_words is not None else F.lit(0)
        sized = F.transform(split, lambda x: F.struct(*plain(x), F.length(x).alias("chars"), count(x).alias("words")))
        parts = once(sized, lambda all_: F.transform(all_, lambda x, k: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["long"].alias("long"), _least(all_, k, min_lines, run_chars, run_words).alias("least"))))
    else:
        parts = F.transform(split, lambda x: F.struct(*plain(x)))
    lines = documents.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("__id"), F.xxhash64(f"`{text}`").alias("__h"), F.posexplode(parts).alias("__p", "__x"))
    rows = lines.select(*KEY, "__p", F.col("__x.a").alias("__n1"), F.col("__x.b").alias("__n2"), F.col("__x.long").alias("__long"), *([F.col("__x.least").alias("__least")] if bounded else []))
    named = _named(rows, ["__n1", "__n2"])
    if min_lines > 1:
        named = keep(named, "line-ranks")
        gone = named.where("(__long OR __least <= 1) AND __later" if bounded else "__long AND __later").select(*KEY, "__p", F.lit(1).alias("__size"))
    else:
        return _collected(named.where("__later").select(*KEY, "__p", F.lit(1).alias("__size")))
    length = 1
    while length < min_lines:
        offset = 1 if bounded else min(length, min_lines - length)
        named = _named(keep(_pairs(named, offset), "line-pairs"), ["__n1", "__n2", "__m1", "__m2"])
        length += offset
        if length < min_lines:
            named = keep(named, "line-ranks")
            if bounded:
                gone = gone.unionByName(named.where(F.col("__later") & (F.col("__least") <= length)).select(*KEY, "__p", F.lit(length).alias("__size")))
    return _collected(gone.unionByName(named.where("__later").select(*KEY, "__p", F.lit(min_lines).alias("__size"))))


def _collected(runs: DataFrame) -> DataFrame:
    lines = runs.select(*KEY, F.explode(F.expr("sequence(__p, __p + __size - 1)")).alias("__p"))
    return lines.groupBy(*KEY).agg(F.sort_array(F.collect_set("__p")).alias("__gone"))


def dedup_lines(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_lines: int = 3, long_line: int = 200, run_chars: int | None = None, run_words: int | None = 50, report: bool = False, drop_empty: bool = False) -> DataFrame:
    """``documents`` with later copies of repeated line runs deleted.

    ``report`` adds n_lines and n_removed; ``drop_empty`` leaves out documents
    of which every line was a later copy.
    """
    gone = repeated_lines(documents, doc_id=doc_id, text=text, min_lines=min_lines, long_line=long_line, run_chars=run_chars, run_words=run_words).withColumnsRenamed({"__id": "__gid", "__h": "__gh"})
    column = lambda c: F.col(f"`{c}`")
    marked = documents.select(F.struct(*[column(c) for c in documents.columns]).alias("row"), column(doc_id).alias("__id"), column(text).alias("__text"), F.xxhash64(column(text)).alias("__h"))
    body = F.col("__text")
    joined = marked.join(gone, F.col("__id").eqNullSafe(F.col("__gid")) & (F.col("__h") == F.col("__gh")) & body.isNotNull(), "left")
    lines = F.split(body, "\n")
    kept = F.array_join(F.filter(F.transform(F.arrays_zip(lines.alias("x"), F.col("__keep").alias("k")), lambda z: F.when(z["k"], z["x"])), lambda x: x.isNotNull()), "\n")
    joined = joined.withColumn("__keep", F.when(F.col("__gone").isNotNull(), _flags(F.size(lines))))
    new_text = F.when(F.col("__gone").isNull(), body).otherwise(kept)
    columns = [new_text.alias(c) if c == text else F.col(f"row.`{c}`") for c in documents.columns]
    if drop_empty:
        joined = joined.where(F.col("__gone").isNull() | (F.size("__gone") < F.size(lines)))
    if report:
        columns += [F.when(body.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*columns)


def _flags(size: Column) -> Column:
    """True for each line that stays: the gaps between deleted lines, in turn."""
    edges = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(size))
    gaps = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.when(b < size, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))))
    return F.flatten(gaps)
