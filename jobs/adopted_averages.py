"""Adopted averages of measured quantities, with the measurements that disagree.

For each quantity, in each part of the output (a year, say), the job takes the
weighted mean of all measurements and of those that carry enough weight, decides
which average is adopted by the library's rules, and gives it the larger of its
internal and external uncertainty.  Measurements that lie more than ``reach`` of
their own uncertainties away are counted, and listed for those who have to look at
them: OUTPUT/averages has a row for each quantity, OUTPUT/outliers one for each such
measurement, both partitioned by part.

    spark-submit jobs/adopted_averages.py --input MEASUREMENTS --output AVERAGES

``--input`` is Parquet; the config says, in SQL, what is the quantity, the dataset,
the value, its uncertainty and the part.  Each run writes whole parts and replaces just those
it computed (dynamic partition overwrite), so running again, also after a run that
broke off, gives the same output; with ``only`` (a condition in SQL) a run computes
the parts that it selects and leaves the others.

Defined results: rows without a quantity, part, value or positive uncertainty are
counted in the log and left out; a quantity of one measurement adopts it; repeated
rows are measurements of their own; an empty input gives an empty table.
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

from jobs.common import command_line, load_config
from matchengine.durable import discard, keep
from matchengine.operators import averages

log = logging.getLogger("adopted_averages")
CONFIG_FILE = Path(__file__).with_suffix(".json")
AVERAGES = "quantity long, n long, kind string, adopted double, uncertainty double, chi2 double, n_outliers long, part int"
OUTLIERS = "quantity long, dataset string, x double, dx double, deviation double, part int"


@dataclass(frozen=True)
class Config:
    quantity: str
    dataset: str
    value: str
    uncertainty: str
    part: str
    only: str = "true"
    reach: float = 3.0


def decide(measured: DataFrame) -> DataFrame:
    """The adopted average of each part and quantity.  ``measured``: part, quantity,
    x, dx (all of them usable)."""
    decided = averages.average_decision(measured, ["part", "quantity"], "x", "dx")
    error = F.when(F.col("kind") == "Unweighted-Average", F.col("unweighted_error")).otherwise(F.greatest("internal", "external"))
    return decided.select("quantity", "n", "kind", "adopted", error.alias("uncertainty"), "chi2", "part")


def outliers_of(measured: DataFrame, best: DataFrame, reach: float) -> DataFrame:
    """Measurements farther than ``reach`` uncertainties from what is adopted; the
    slack keeps one just at the limit in, however its average was summed."""
    apart = F.abs(F.col("x") - F.col("adopted")) / F.col("dx")
    joined = measured.join(best.select("part", "quantity", "adopted"), ["part", "quantity"]).withColumn("deviation", apart)
    return joined.where(F.col("deviation") > reach * (1 + 1e-9)).select("quantity", "dataset", "x", "dx", "deviation", "part")


def run(spark: SparkSession, source: str, output: str, config: Config) -> dict[str, int]:
    """Write averages and outliers of ``source``; returns the numbers of measurements
    read, of those that can be used, and of rows written."""
    for name, schema in (("averages", AVERAGES), ("outliers", OUTLIERS)):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("part").parquet(f"{output}/{name}")
    columns = {"part": "int", "quantity": "long", "dataset": "string", "value": "double", "uncertainty": "double"}
    rows = spark.read.parquet(source).select(*[F.expr(getattr(config, c)).cast(kind).alias({"value": "x", "uncertainty": "dx"}.get(c, c)) for c, kind in columns.items()])
    usable = F.expr("part IS NOT NULL AND quantity IS NOT NULL AND x IS NOT NULL AND NOT isnan(x) AND dx > 0 AND NOT isnan(dx)")
    came = Observation()
    asked = rows.where(config.only).observe(came, F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(usable, F.lit(False))).alias("used"))
    measured = keep(asked.where(usable), "measurements")
    best = keep(decide(measured), "adopted")
    far = keep(outliers_of(measured, best, config.reach), "outliers")
    counts = far.groupBy("part", "quantity").agg(F.count("*").alias("n_outliers"))
    found = best.join(counts, ["part", "quantity"], "left").withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0).cast("long")))
    done = {"measurements": came.get["n"], "used": came.get["used"]}
    done["averages"] = _replace(found.select("quantity", "n", "kind", "adopted", "uncertainty", "chi2", "n_outliers", "part"), f"{output}/averages")
    # A part whose outliers have all gone must lose its old ones: it gets an empty row.
    parts = best.select("part").distinct().join(far.select("part").distinct(), "part", "left_anti")
    empty = parts.select(*[F.lit(None).cast(kind).alias(c) for c, kind in (("quantity", "long"), ("dataset", "string"), ("x", "double"), ("dx", "double"), ("deviation", "double"))], "part")
    done["outliers"] = _replace(far.unionByName(empty), f"{output}/outliers")
    discard(measured, best, far)
    log.info("read %d measurements of %s, used %d, wrote %d averages and %d outliers to %s", done["measurements"], source, done["used"], done["averages"], done["outliers"], output)
    return done


def _replace(rows: DataFrame, path: str) -> int:
    """Write the parts that ``rows`` have in place of the old ones; their number."""
    went = Observation()
    counted = rows.observe(went, F.count("quantity").alias("n"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return went.get["n"]


def read_averages(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(AVERAGES).parquet(f"{output}/averages")


def read_outliers(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(OUTLIERS).parquet(f"{output}/outliers").where("quantity IS NOT NULL")


if __name__ == "__main__":
    command_line(
        __doc__,
        {"input": "Parquet with measurements", "output": "folder of averages and outliers"},
        CONFIG_FILE,
        lambda spark, a: run(spark, a.input, a.output, load_config(a.config, Config)),
    )
