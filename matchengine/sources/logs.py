"""Fixed-width record logs.

A log holds several datasets, each opened by a ``# Dataset X:`` line.  Column 8
of a record is its type (L level, G gamma).  Records that do not parse go to a
reject table instead of ending the run.  Datasets, levels and lines are numbered
by windows inside one file; files are independent of each other, also where their
datasets have one code.  Levels and gammas keep file and line, so a message about
one leads back to its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchengine.durable import keep
from matchengine.functions import text as tx
from matchengine.operators.pairs import nearest

#: Line numbers of a file that one task sorts at once.
BLOCK = 1 << 18
HEADER = r"^#\s*Dataset\s+([^:]+):"


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Lines with their file, the block of it that a task read (its first byte) and
    their number in the file from 0.

    A large file is read by many tasks.  Inside a block lines have the order of the
    rows; the lines of the blocks before are counted, and only these counts meet.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", "\r$", "").alias("line"))
    rows = keep(raw, "log-lines")
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("shift", before - F.col("first")).select("file", "block", "shift")
    return rows.join(F.broadcast(starts), ["file", "block"]).select("file", "block", (F.col("row") + F.col("shift")).alias("line_no"), "line")


def _carried(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """``value`` of the last line of the file that has one, as ``name``: inside a
    block by a window, from the blocks before by a row for each block."""
    by = ["file", "block"] if "block" in lines.columns else ["file"]
    here = F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumn(name, here)
    if "block" not in lines.columns:
        return marked
    ends = lines.where(value.isNotNull()).groupBy("file", "block").agg(F.max_by(value, "line_no").alias("__last"))
    every = lines.select("file", "block").distinct().join(ends, ["file", "block"], "left")
    earlier = every.select("file", "block", F.last("__last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"))
    return marked.join(F.broadcast(earlier), ["file", "block"]).withColumn(name, F.coalesce(name, "__earlier")).drop("__earlier")


def last_lines(lines: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """For each name the number of the last line of the file, up to this one, of which
    its condition holds.

    A file is worked on in blocks of line numbers, by many tasks; a row for each block
    brings the numbers of the blocks before.
    """
    if "block" in lines.columns:
        for name, mark in marks.items():
            lines = _carried(lines, F.when(mark, F.col("line_no")), name)
        return lines
    spot = ["file", "__block"]
    dealt = lines.select("*", _block(), *[F.when(mark, F.col("line_no")).alias(name) for name, mark in marks.items()])
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*spot).agg(*[F.max(name).alias(name) for name in marks])
    earlier = ends.select(*spot, *[F.max(name).over(before).alias(name) for name in marks])
    rows = dealt.withColumn("__of", F.lit(1)).unionByName(earlier.withColumn("__of", F.lit(0)), allowMissingColumns=True)
    here = Window.partitionBy(*spot).orderBy("__of", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.max(name).over(here) for name in marks}).where("__of = 1").drop("__of", "__block")


def _block() -> Column:
    return F.floor(F.col("line_no") / BLOCK).alias("__block")


def numbered_anew(lines: DataFrame, order: list[str]) -> DataFrame:
    """file, line_no and line: lines in the order of their old number and ``order``,
    numbered from 0 in blocks; only the numbers of lines of the blocks before meet."""
    spot = ["file", "__block"]
    rows = keep(lines.select("*", _block()), "lines")
    upto = F.sum("n").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(*spot).agg(F.count("*").alias("n")).select(*spot, F.coalesce(upto, F.lit(0)).alias("__start"))
    every = rows.withColumn("__of", F.lit(1)).unionByName(starts.withColumn("__of", F.lit(0)), allowMissingColumns=True)
    window = Window.partitionBy(*spot).orderBy("__of", "line_no", *order)
    # The first row of a block is the one with its start.
    number = F.max("__start").over(window.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(window) - 2
    return every.select("file", number.cast("long").alias("line_no"), "line", "__of").where("__of = 1").drop("__of")


def carry_forward(lines: DataFrame) -> DataFrame:
    """Each record line with the dataset whose header stands before it."""
    code = F.when(F.col("line").rlike(HEADER), F.trim(F.regexp_extract("line", HEADER, 1)))
    return _carried(lines, code, "dataset_code").where(F.col("dataset_code").isNotNull() & (F.trim("line") != "") & ~F.col("line").rlike("^#"))


def with_continuations(lines: DataFrame) -> DataFrame:
    """Records of ``carry_forward`` with their continuations: file, dataset_code,
    line_no (of the first line), n_lines, record (columns 6 to 8 without the mark of
    the continuation) and text, the fields of all lines parted by a blank.

    Column 6 of a line that continues the one before is neither blank nor 1.
    """
    first = F.when(F.substring("line", 6, 1).isin(" ", "1", ""), F.col("line_no"))
    started = _carried(lines, first, "start").where("start IS NOT NULL")
    entry = F.struct("line_no", F.rtrim(F.substring("line", 10, 71)).alias("text"), F.concat(F.lit(" "), F.substring("line", 7, 2)).alias("record"))
    gathered = started.groupBy("file", "dataset_code", F.col("start").alias("line_no")).agg(F.array_sort(F.collect_list(entry)).alias("parts"))
    # A line that continues a record of the dataset before belongs to none.
    return gathered.where(F.get("parts", 0)["line_no"] == F.col("line_no")).select("file", "dataset_code", "line_no", F.size("parts").cast("long").alias("n_lines"), F.get("parts", 0)["record"].alias("record"), F.array_join("parts.text", " ").alias("text"))


def parse_records(lines: DataFrame) -> DataFrame:
    """Fields of L and G records; ``rejected`` says why a record is unusable."""
    field = lambda first, size: F.trim(F.substring("line", first, size))
    cut = lines.where((F.length("line") >= 8) & F.substring("line", 8, 1).isin("L", "G") & F.substring("line", 6, 2).isin("  ", "")).select(
        "*",
        F.substring("line", 8, 1).alias("record"),
        field(10, 10).alias("energy_text"),
        field(20, 2).alias("uncertainty_text"),
        field(23, 17).alias("spin_parity_text"),
        field(23, 7).alias("intensity_text"),
        field(30, 2).alias("intensity_uncertainty_text"),
    )
    energy = tx.number_in(F.col("energy_text"), "double")
    reject = F.when(energy.isNull(), "energy is not a number").when((F.col("uncertainty_text") != "") & tx.number_in(F.col("uncertainty_text"), "double").isNull(), "uncertainty is not a number")
    return cut.where("energy_text <> ''").withColumn("energy", energy).withColumn("rejected", reject)


def number_levels(records: DataFrame) -> DataFrame:
    """Levels and gammas of each dataset in order; a gamma belongs to the level
    before it, and one without a level is left out."""
    order = Window.partitionBy("file", "dataset_code").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    good = records.where("rejected IS NULL")
    is_level = F.col("record") == "L"
    counted = good.select("*", (F.sum(is_level.cast("int")).over(order) - 1).alias("level_index"), (F.sum((~is_level).cast("int")).over(order) - 1).alias("gamma_index"))
    return counted.where("level_index >= 0")


def levels(numbered: DataFrame) -> DataFrame:
    unc = tx.energy_uncertainty(F.col("energy_text"), F.col("uncertainty_text"))
    return numbered.where("record = 'L'").select("file", "dataset_code", "level_index", "line_no", F.col("energy").alias("energy_value"), unc.alias("uncertainty"), tx.evaluator_input(F.col("energy_text"), F.col("uncertainty_text")).alias("evaluator_input"), F.col("spin_parity_text").alias("spin_parity_string"), tx.parse_spin_parity(F.col("spin_parity_text")).alias("spin_parity_list"))


def gammas(numbered: DataFrame, reach: float = 50.0) -> DataFrame:
    """Gammas with initial and final level: the level nearest to what is left
    of the energy, the ground state if none is within ``reach``."""
    dataset = ["file", "dataset_code"]
    lines = numbered.where("record = 'G'").select(
        *dataset,
        "gamma_index",
        "line_no",
        F.col("level_index").alias("initial_level"),
        F.col("energy").alias("energy_value"),
        tx.energy_uncertainty(F.col("energy_text"), F.col("uncertainty_text")).alias("uncertainty"),
        F.coalesce(tx.number_in(F.col("intensity_text"), "double"), F.lit(0.0)).alias("intensity"),
        tx.intensity_uncertainty(F.col("intensity_text"), F.col("intensity_uncertainty_text")).alias("intensity_uncertainty"),
    )
    known = numbered.where("record = 'L'").select(*dataset, F.col("level_index").alias("li"), F.col("energy").alias("le"))
    initial = lines.join(known.withColumnRenamed("li", "initial_level"), [*dataset, "initial_level"]).withColumn("left", F.col("le") - F.col("energy_value")).drop("le")
    found = nearest(initial, known, F.col("left"), F.col("le"), ["gamma_index"], F.col("li"), reach, by=dataset)
    return found.withColumn("final_level", F.coalesce("nearest.tie", F.lit(0))).drop("left", "nearest")


def blocks(lines: DataFrame) -> DataFrame:
    """Blank-line-separated blocks with their numbers of levels and gammas."""
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("block", F.sum((F.trim("line") == "").cast("int")).over(order)).where("trim(line) <> ''")
    kind = F.substring("line", 8, 1)
    return marked.groupBy("file", "block").agg(F.count("*").alias("n_lines"), F.count_if(kind == "L").alias("n_levels"), F.count_if(kind == "G").alias("n_gammas"))
