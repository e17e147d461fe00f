"""Nested JSON datasets: one file a dataset, levels with indices of gammas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchengine.functions import text as tx
from matchengine.schema import CONFIG, DATASET, GAMMAS, SPIN_OPTIONS


def read_datasets(spark: SparkSession, path: str, code: str = r"([A-Za-z0-9]+)\.json$") -> DataFrame:
    """Standard levels of all files; the dataset's code comes from the name.  A file is
    one dataset: an object with its tables, or a bare list of levels without gammas."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), code, 1).alias("dataset_code"), "value")
    bare = F.concat(F.lit('{"levelsTable": {"levels": '), "value", F.lit("}}"))
    read = F.from_json(F.when(F.col("value").rlike(r"^\s*\["), bare).otherwise(F.col("value")), DATASET)
    return standard_levels(raw.select("dataset_code", read.alias("d")).select("dataset_code", "d.levelsTable", "d.gammasTable"))


def standard_levels(raw: DataFrame) -> DataFrame:
    table = F.coalesce(F.col("gammasTable.gammas"), F.array())
    spread = raw.select("dataset_code", table.alias("table"), F.posexplode("levelsTable.levels").alias("level_index", "level")).where("level.energy.value IS NOT NULL")
    default = F.lit(CONFIG.default_uncertainty)

    def line(i):
        g = F.get(F.col("table"), i)
        return F.struct(
            F.coalesce(g["energy"]["value"], F.lit(0.0)).alias("energy"),
            F.coalesce(g["energy"]["uncertainty"]["value"], default).alias("energy_uncertainty"),
            F.coalesce(g["gammaIntensity"]["value"], F.lit(0.0)).alias("intensity"),
            F.coalesce(g["gammaIntensity"]["uncertainty"]["value"], F.lit(0.0)).alias("intensity_uncertainty"),
        )

    indices = F.filter(F.coalesce("level.gammas", F.array().cast("array<int>")), lambda i: (i >= 0) & (i < F.size("table")))
    return spread.select(
        "dataset_code",
        "level_index",
        tx.level_id(F.col("dataset_code"), F.col("level.energy.value")).alias("level_id"),
        F.col("level.energy.value").alias("energy_value"),
        F.coalesce("level.energy.uncertainty.value", default).alias("energy_uncertainty"),
        F.coalesce("level.spinParity.values", F.array().cast(SPIN_OPTIONS)).alias("spin_parity_list"),
        F.coalesce("level.spinParity.evaluatorInput", F.lit("")).alias("spin_parity_string"),
        F.transform(indices, line).cast(GAMMAS).alias("gamma_decays"),
    )


def to_documents(levels: DataFrame, gammas: DataFrame) -> DataFrame:
    """One nested row per dataset of a file, from the parsed levels and gammas of
    logs: file, dataset_code, levelsTable, gammasTable."""
    dataset = ["file", "dataset_code"]
    measure = lambda value, unc, given: F.struct(F.lit("keV").alias("unit"), F.col(value).alias("value"), F.col(unc).alias("uncertainty"), given.alias("evaluatorInput"))
    own = gammas.groupBy(*dataset, F.col("initial_level").alias("level_index")).agg(F.sort_array(F.collect_list("gamma_index")).alias("gammas"))
    joined = levels.join(own, [*dataset, "level_index"], "left")
    spin = F.when(F.size("spin_parity_list") > 0, F.struct(F.col("spin_parity_list").alias("values"), F.col("spin_parity_string").alias("evaluatorInput")))
    level = F.struct("level_index", F.struct(measure("energy_value", "uncertainty", F.col("evaluator_input")).alias("energy"), (F.col("energy_value") == 0).alias("isStable"), spin.alias("spinParity"), "gammas").alias("v"))
    gamma = F.struct("gamma_index", F.struct(measure("energy_value", "uncertainty", F.col("energy_value").cast("string")).alias("energy"), F.struct(F.col("intensity").alias("value"), F.col("intensity_uncertainty").alias("uncertainty")).alias("gammaIntensity"), F.col("initial_level").alias("initialLevel"), F.col("final_level").alias("finalLevel")).alias("v"))
    top = joined.groupBy(*dataset).agg(F.struct(F.transform(F.sort_array(F.collect_list(level)), lambda x: x["v"]).alias("levels")).alias("levelsTable"))
    under = gammas.groupBy(*dataset).agg(F.struct(F.transform(F.sort_array(F.collect_list(gamma)), lambda x: x["v"]).alias("gammas")).alias("gammasTable"))
    return top.join(under, dataset, "left")


def write_datasets(documents: DataFrame, path: str) -> None:
    """One folder of JSON per dataset, ``dataset_code=<code>/log=<name of its file>``;
    keys of absent parts are left out."""
    name = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.[^.]*$", "")
    documents.withColumn("log", name).drop("file").write.mode("overwrite").partitionBy("dataset_code", "log").json(path)
