"""Average reports read back, and their comments put into fixed-column records.

A report has a block for each group: its name, the values, and the comments that
should stand in the dataset, each with the field it is about (``E$...``).  Long
comments go on in lines that begin with ``CONTINUED``.

In a dataset a comment is a record of 80 columns, ``c`` in column 7 and the type of
its record in column 8, the field and text from column 10 on; what does not fit goes
on in records with a mark in column 6: 2 to 9, A to Z, and Z for all beyond.  Text is
broken between words; one longer than a line makes a longer line.  Runs of blanks
count as one.

Report, parse, patch and parse again give the same comments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchengine.durable import discard, keep
from matchengine.functions import text as tx
from matchengine.sources import logs

#: Width of a record's text, and how lines of a report begin.
WIDTH = 71
GROUP, VALUE, COMMENT, CONTINUED = "GROUP ", "  VALUE ", "  COMMENT ", "  CONTINUED "
MARKS = "23456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _plain(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " "))


def average_report(values: DataFrame, comments: DataFrame) -> DataFrame:
    """name, place and line of the report.  ``values``: name, place, value_text,
    source; ``comments``: name, field, body.  Order by name and place."""
    one = values.select("name").unionByName(comments.select("name")).distinct().select("name", F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("c")).alias("place"), F.concat(F.lit(GROUP), "name").alias("line"))
    two = values.select("name", F.struct(F.lit(1).alias("a"), F.lit("").alias("b"), F.col("place").cast("long").alias("c")).alias("place"), F.concat(F.lit(VALUE), "value_text", F.lit(" from "), "source").alias("line"))
    folded = tx.wrap_line(F.concat("field", F.lit("$"), _plain(F.col("body"))), WIDTH)
    split = comments.select("name", "field", F.posexplode(folded).alias("at", "part"))
    three = split.select("name", F.struct(F.lit(2).alias("a"), F.col("field").alias("b"), F.col("at").cast("long").alias("c")).alias("place"), F.concat(F.when(F.col("at") == 0, COMMENT).otherwise(CONTINUED), F.col("part")).alias("line"))
    return one.unionByName(two).unionByName(three)


def parse_average_report(lines: DataFrame) -> DataFrame:
    """file, name, field and body of the comments of reports.  ``lines``: file,
    line_no, line (and block, see ``logs.read_lines``).  A comment before the first
    group, and a line that continues none, is left out."""
    name = F.when(F.col("line").startswith(GROUP), F.substring("line", len(GROUP) + 1, 10_000))
    named = logs._carried(lines, name, "name")
    # Anything but a continued line ends a comment: it starts a run of its own.
    start = F.when(~F.col("line").startswith(CONTINUED), F.col("line_no"))
    runs = logs._carried(named, start, "start").where("name IS NOT NULL")
    begins, goes_on = F.col("line").startswith(COMMENT), F.col("line").startswith(CONTINUED)
    text = F.when(begins, F.substring("line", len(COMMENT) + 1, 10_000_000)).otherwise(F.substring("line", len(CONTINUED) + 1, 10_000_000))
    parts = runs.where(begins | goes_on).groupBy("file", "name", "start").agg(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t"), begins.alias("first")))).alias("p"))
    whole = parts.where(F.get("p", 0)["first"]).select("file", "name", F.array_join("p.t", " ").alias("text"))
    return whole.select("file", "name", F.regexp_extract("text", r"^([^$]*)\$", 1).alias("field"), F.regexp_replace("text", r"^[^$]*\$", "").alias("body"))


def comment_lines(nucid: Column, kind: Column, field: Column, body: Column) -> Column:
    """The records of one comment, as an array."""
    folded = tx.wrap_line(F.concat(field, F.lit("$"), _plain(body)), WIDTH)
    mark = lambda k: F.when(k == 0, F.lit(" ")).otherwise(F.substring(F.lit(MARKS), F.least(k, F.lit(len(MARKS))), F.lit(1)))
    return F.transform(folded, lambda t, k: F.concat(F.lpad(nucid, 5, " "), mark(k), F.lit("c"), kind, F.lit(" "), F.when(F.length(t) < WIDTH, F.rpad(t, WIDTH, " ")).otherwise(t)))


def _owned(records: DataFrame) -> DataFrame:
    """Lines with ``owner``, the line of the level or gamma record they belong to, and
    ``start``, the first line of their record."""
    owned = logs._carried(records, F.when(_plain_record(), F.col("line_no")), "owner")
    return logs._carried(owned, F.when(_starts(), F.col("line_no")), "start")


def owned_in_blocks(records: DataFrame) -> DataFrame:
    """The same by blocks of a file: more steps, but no task sorts a whole file."""
    return logs.last_lines(records, {"owner": _plain_record(), "start": _starts()})


def _starts() -> Column:
    return F.substring("line", 6, 1).isin(" ", "1", "")


def _plain_record() -> Column:
    return F.substring("line", 6, 2).isin("  ", "1 ") & F.substring("line", 8, 1).isin("L", "G")


def _comment_field() -> Column:
    return F.when(F.substring("line", 7, 1) == "c", F.regexp_extract(F.substring("line", 10, WIDTH), r"^([^$]*)\$", 1))


def parse_comments(records: DataFrame) -> DataFrame:
    """file, owner, kind, field and body of the comments of level and gamma records.
    ``records``: file, line_no, line (and block)."""
    own = _owned(records).where((F.substring("line", 7, 1) == "c") & F.col("owner").isNotNull())
    parts = own.groupBy("file", "owner", "start").agg(F.array_sort(F.collect_list(F.struct("line_no", F.rtrim(F.substring("line", 10, 10_000_000)).alias("t"), F.substring("line", 8, 1).alias("kind")))).alias("p"))
    text = F.array_join("p.t", " ")
    return parts.where(F.get("p", 0)["line_no"] == F.col("start")).select("file", "owner", F.get("p", 0)["kind"].alias("kind"), F.regexp_extract(text, r"^([^$]*)\$", 1).alias("field"), F.regexp_replace(text, r"^[^$]*\$", "").alias("body"))


def patch_comments(records: DataFrame, comments: DataFrame) -> DataFrame:
    """``records`` (file, line_no, line) with comments put in: one of equal field is
    replaced with all its lines, others stay; new ones stand behind the record and
    its own continuations.  ``comments``: file, owner (the record's line), field,
    body.  Lines are numbered anew from 0."""
    own = keyed = _owned(records)
    heads = keyed.where("line_no = start").withColumn("field", _comment_field()).where("field IS NOT NULL").select("file", "owner", "start", "field")
    gone = heads.join(comments.select("file", "owner", "field").distinct(), ["file", "owner", "field"], "left_semi").select("file", "start")
    kept = own.join(gone, ["file", "start"], "left_anti").select("file", "line_no", F.lit("").alias("field"), F.lit(-1).alias("at"), "line")
    bodies = own.where((F.substring("line", 7, 1) != "c") & F.col("owner").isNotNull()).groupBy("file", "owner").agg(F.max("line_no").alias("line_no"), F.min_by("line", "line_no").alias("record"))
    lines = comment_lines(F.substring("record", 1, 5), F.substring("record", 8, 1), F.col("field"), F.col("body"))
    new = comments.join(bodies, ["file", "owner"]).select("file", "line_no", "field", F.posexplode(lines).alias("at", "line"))
    order = Window.partitionBy("file").orderBy("line_no", "field", "at")
    return kept.unionByName(new).select("file", (F.row_number().over(order) - 1).cast("long").alias("line_no"), "line")


def patch_xrefs(records: DataFrame, xrefs: DataFrame) -> DataFrame:
    """``records`` (file, line_no, line) with new cross-references: the ``X L XREF``
    lines of the levels named go, and theirs stand behind the level's record.  All else
    stays as it is; lines are numbered anew.  ``xrefs``: file, owner (the level's line),
    lines (array, see ``best_values.cross_reference_lines``; empty removes them)."""
    xrefs = keep(xrefs, "xrefs")
    own = owned_in_blocks(records)
    old = (F.substring("line", 6, 3) == "X L") & F.substring("line", 10, 5).isin("XREF=", "XREF+")
    named = xrefs.select("file", "owner", F.lit(True).alias("named"))
    kept = own.join(named, ["file", "owner"], "left").where(~(F.coalesce("named", F.lit(False)) & old)).select("file", "line_no", F.lit(-1).alias("at"), "line")
    heads = records.where(_plain_record()).select("file", F.col("line_no").alias("owner"), F.substring("line", 1, 5).alias("nucid"))
    new = xrefs.join(heads, ["file", "owner"]).select("file", F.col("owner").alias("line_no"), "nucid", F.posexplode("lines").alias("at", "part"))
    lines = new.select("file", "line_no", "at", F.rpad(F.concat(F.lpad("nucid", 5, " "), F.lit("X L "), F.col("part")), 80, " ").alias("line"))
    patched = logs.numbered_anew(kept.unionByName(lines), ["at"])
    discard(xrefs)
    return patched
