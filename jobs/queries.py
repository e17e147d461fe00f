"""The jobs as registered queries: each runs twice into one new folder, over whole
tables, and gives back its whole output."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import adopted_averages, line_index
from jobs.common import load_config
from matchengine.durable import own_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _folder(spark, "line-index")
    for _ in range(2):
        line_index.run(spark, f"{sf_dir}/documents.parquet", f"{top}/index", f"{top}/checkpoint", load_config(line_index.CONFIG_FILE, line_index.Config))
    return line_index.read_index(spark, f"{top}/index").drop("batch")


def job2_adopted_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _folder(spark, "adopted-averages")
    for _ in range(2):
        adopted_averages.run(spark, f"{sf_dir}/lineitem.parquet", top, load_config(adopted_averages.CONFIG_FILE, adopted_averages.Config))
    number = lambda c, digits, name: F.round(c, digits).alias(name)
    one = adopted_averages.read_averages(spark, top).select(F.lit("average").alias("record"), "part", "quantity", F.lit("").alias("dataset"), "n", "kind", number("adopted", 6, "value"), number("uncertainty", 4, "uncertainty"), number("chi2", 4, "measure"), "n_outliers")
    two = adopted_averages.read_outliers(spark, top).select(F.lit("outlier").alias("record"), "part", "quantity", "dataset", F.lit(1).cast("long").alias("n"), F.lit("Outlier").alias("kind"), number("x", 6, "value"), number("dx", 4, "uncertainty"), number("deviation", 4, "measure"), F.lit(0).cast("long").alias("n_outliers"))
    return one.unionByName(two)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_line_index, job2_adopted_averages)}


def oracle_sql() -> dict[str, str]:
    return {
        "job1_line_index": r"""
            WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
            w AS (SELECT *, list_filter(string_split_regex(line, '[ \t-\r]+'), lambda x: x <> '') AS words FROM l),
            v AS (SELECT *, list_filter(list_transform(words, lambda x: regexp_replace(x, '[.,;:!?]+$', '')), lambda x: regexp_matches(x, '^[-+]?[0-9]+(\.[0-9]+)?(\([0-9]+\))?$')) AS vals FROM w WHERE len(words) > 0),
            p AS (SELECT *, list_transform(vals, lambda x: regexp_extract(x, '^([^(]*)', 1)) AS numbers, list_transform(vals, lambda x: regexp_extract(x, '\(([0-9]+)\)$', 1)) AS errors FROM v),
            u AS (
              SELECT *, list_transform(range(1, len(vals) + 1), lambda i: CASE
                WHEN errors[i] <> '' THEN errors[i]::DOUBLE * ('1E-' || length(regexp_extract(numbers[i], '\.([0-9]*)', 1)))::DOUBLE
                WHEN numbers[i]::DOUBLE = 0 THEN 0
                WHEN contains(numbers[i], '.') THEN 5 * ('1E-' || length(regexp_extract(numbers[i], '\.([0-9]*)', 1)))::DOUBLE
                ELSE 5.0 END) AS dx FROM p)
            SELECT doc_id, lang, CAST(line_no AS BIGINT) AS line_no, CAST(length(line) AS BIGINT) AS n_chars, CAST(len(words) AS BIGINT) AS n_words, CAST(len(vals) AS BIGINT) AS n_values,
                   array_to_string(vals, ' ') AS value_texts, CAST(list_min(dx) AS DOUBLE) AS least_uncertainty, coalesce(nullif(lang, ''), 'none') AS language FROM u""",
        "job2_adopted_averages": """
            WITH l AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS part, l_partkey AS quantity, 'S' || l_suppkey AS dataset, l_extendedprice AS x, l_extendedprice * (0.01::DOUBLE + l_discount) AS dx FROM lineitem WHERE l_shipdate IS NOT NULL AND l_partkey IS NOT NULL AND l_extendedprice * (0.01::DOUBLE + l_discount) > 0),
            w AS (SELECT *, (1 / (dx * dx)) / sum(1 / (dx * dx)) OVER (PARTITION BY part, quantity) >= 0.02 AS used FROM l),
            a AS (SELECT part, quantity, count(*) AS n, sum(x / (dx * dx)) / sum(1 / (dx * dx)) AS wa, avg(x) AS u, coalesce(stddev_samp(x), 0) / sqrt(count(*)) AS eu, min(x) AS low, max(x) AS high, sum(1 / (dx * dx)) AS sw FROM w GROUP BY ALL),
            b AS (SELECT part, quantity, count(*) AS n, sum(x / (dx * dx)) / sum(1 / (dx * dx)) AS wu FROM w WHERE used GROUP BY ALL),
            c AS (
              SELECT w.part, w.quantity, coalesce(sum((x - wa) * (x - wa) / (dx * dx)) / nullif(max(a.n) - 1, 0), 0) AS chi_all,
                     coalesce(sum(CASE WHEN used THEN (x - wu) * (x - wu) / (dx * dx) END) / nullif(max(b.n) - 1, 0), 0) AS chi, bool_or(round(x, 6) = round(wu, 6)) AS equals
              FROM w JOIN a USING (part, quantity) JOIN b USING (part, quantity) GROUP BY ALL),
            k AS (
              SELECT *, CASE WHEN low = high OR equals THEN 'Non-Average' WHEN least(chi, chi_all) > 3.5 THEN 'Unweighted-Average' WHEN round(wu, 6) = round(wa, 6) THEN 'Weighted-Of-All'
                             WHEN chi_all < chi OR chi_all < 3.0 THEN 'Weighted-Of-All' ELSE 'Weighted-Average' END AS kind
              FROM a JOIN (SELECT part, quantity, wu FROM b) USING (part, quantity) JOIN c USING (part, quantity)),
            d AS (SELECT *, CASE kind WHEN 'Unweighted-Average' THEN u WHEN 'Weighted-Of-All' THEN wa ELSE wu END AS adopted, CASE kind WHEN 'Unweighted-Average' THEN eu ELSE greatest(1, sqrt(chi_all)) / sqrt(sw) END AS uncertainty FROM k)
            SELECT 'average' AS record, part, quantity, '' AS dataset, max(d.n) AS n, max(kind) AS kind, round(max(adopted), 6) AS value, round(max(uncertainty), 4) AS uncertainty, round(max(chi_all), 4) AS measure,
                   count(*) FILTER (abs(x - adopted) / dx > 3 * (1 + 1e-9)) AS n_outliers
            FROM d JOIN w USING (part, quantity) GROUP BY part, quantity
            UNION ALL SELECT 'outlier', part, quantity, dataset, 1, 'Outlier', round(x, 6), round(dx, 4), round(abs(x - adopted) / dx, 4), 0 FROM d JOIN w USING (part, quantity) WHERE abs(x - adopted) / dx > 3 * (1 + 1e-9)""",
    }
