"""Line index of comment texts, kept up to date as text files arrive.

Messages about records point to a line of a text, and averages start from the
values that evaluators print in comments.  This job turns tables of texts into an
index with one row for each line that has a word: the document, the line's number,
its size, and the values printed in it with the least of their uncertainties
(printed, or inferred from the last digit).

    spark-submit jobs/line_index.py --input TEXTS --output INDEX --checkpoint STATE

``--input`` is a folder of Parquet files that may grow (or one file).  A stream
takes the files that the checkpoint has not seen, in batches of ``max_files``, and
ends when there are no more.  A batch writes the partitions ``batch=<its number>``
and replaces them when it runs again, so a run that broke off, and one that finds
nothing new, leave the index as it should be.  Batch 0 replaces the whole output:
with a new checkpoint the index is built anew.

Defined results: null texts, empty ones and blank lines have no rows; a text's
lines end at ``\\n`` and are numbered from 0; repeated documents have rows of their
own; an empty folder gives an empty index.  The partition folder of a null or empty
language is ``none``.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs.common import command_line, load_config
from matchengine.functions import text as tx

log = logging.getLogger("line_index")
CONFIG_FILE = Path(__file__).with_suffix(".json")
SCHEMA = "doc_id long, lang string, line_no long, n_chars long, n_words long, n_values long, value_texts string, least_uncertainty double, batch long, language string"
SPACE = r"[ \t-\r]+"


@dataclass(frozen=True)
class Config:
    id_column: str = "doc_id"
    text_column: str = "text"
    language_column: str = "lang"
    max_files: int = 1000


def index_lines(texts: DataFrame) -> DataFrame:
    """Rows of the index for ``texts``: doc_id, text, lang."""
    lines = texts.where("text IS NOT NULL").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = F.array_remove(F.split("line", SPACE), "")
    found = lines.select("doc_id", "lang", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("n_chars"), words.alias("words")).where(F.size("words") > 0)
    read = found.withColumn("values", tx.printed_values(F.col("words")))
    return read.select(
        "doc_id",
        "lang",
        "line_no",
        "n_chars",
        F.size("words").cast("long").alias("n_words"),
        F.size("values").cast("long").alias("n_values"),
        F.array_join("values.text", " ").alias("value_texts"),
        F.array_min("values.dx").alias("least_uncertainty"),
    )


def _pattern(path: str) -> str:
    """The path as a pattern that fits it alone: a file stream takes a plain path
    for a folder, but a pattern may stand for a file as well."""
    path = path.rstrip("/")
    return path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: Config = Config()) -> dict[str, int]:
    """Bring the index up to date; returns the numbers of batches, documents read
    and lines written in this run."""
    done = {"batches": 0, "documents": 0, "lines": 0}
    spark.createDataFrame([], SCHEMA).write.mode("ignore").partitionBy("batch", "language").parquet(output)

    def write(batch: DataFrame, number: int) -> None:
        came, went = Observation(), Observation()
        texts = batch.observe(came, F.count(F.lit(1)).alias("n")).select(F.col(f"`{config.id_column}`").alias("doc_id"), F.col(f"`{config.text_column}`").alias("text"), F.col(f"`{config.language_column}`").alias("lang"))
        rows = index_lines(texts).withColumn("batch", F.lit(number).cast("long")).withColumn("language", F.coalesce(F.nullif("lang", F.lit("")), F.lit("none")))
        mode = "static" if number == 0 else "dynamic"
        rows.observe(went, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("batch", "language").parquet(output)
        done["batches"] += 1
        done["documents"] += came.get["n"]
        done["lines"] += went.get["n"]
        log.info("batch %d: read %d documents of %s, wrote %d lines to %s", number, came.get["n"], source, went.get["n"], output)

    columns = [T.StructField(config.id_column, T.LongType()), T.StructField(config.text_column, T.StringType()), T.StructField(config.language_column, T.StringType())]
    stream = spark.readStream.schema(T.StructType(columns)).option("maxFilesPerTrigger", config.max_files).parquet(_pattern(source))
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("read %(documents)d documents, wrote %(lines)d lines in %(batches)d batches", done)
    return done


def read_index(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(output)


if __name__ == "__main__":
    command_line(
        __doc__,
        {"input": "folder of Parquet files with texts", "output": "folder of the index", "checkpoint": "folder of the stream's state"},
        CONFIG_FILE,
        lambda spark, a: run(spark, a.input, a.output, a.checkpoint, load_config(a.config, Config)),
    )
