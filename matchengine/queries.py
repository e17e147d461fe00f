"""Registered queries: every operator on the driver's tables, with its SQL.

The tables play the parts of measured records: customers are levels (account
balance as energy, market segment as dataset, nation as block), suppliers are
adopted levels, line items are lines of an order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchengine.functions import comments, nuclear, text
from matchengine.functions import similarity as sim
from matchengine.operators import adopted, averages, boosting, cluster, groups, learning, pairs, records, rules
from matchengine.operators.components import components
from matchengine.plans import matching
from matchengine.schema import GAMMAS, SPIN_OPTIONS
from matchengine.sources import logs, reports

REACH = 25.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(c: Column) -> Column:
    return F.round(c, 6)


# --- levels and pairs ---------------------------------------------------------


def customer_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    option = F.struct((2 * (k % 5)).cast("int").alias("twoTimesSpin"), (k % 3 == 0).alias("isTentativeSpin"), F.when(F.col("c_acctbal") < 0, "-").otherwise("+").alias("parity"), (k % 7 == 0).alias("isTentativeParity"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("dataset_code"), k.alias("key"), F.col("c_acctbal").alias("energy_value"),
        F.when(k % 2 == 0, 5.0).otherwise(0.5).alias("energy_uncertainty"), F.array(option).cast(SPIN_OPTIONS).alias("spin_parity_list"),
    )


def customer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers of one nation and different segments, near in energy."""
    levels = customer_levels(spark, sf_dir)
    one = levels.select("nation", *[F.col(c).alias(f"{c}_1") for c in levels.columns if c != "nation"])
    two = levels.select("nation", *[F.col(c).alias(f"{c}_2") for c in levels.columns if c != "nation"])
    near = pairs.range_join(one, two, F.col("energy_value_1"), F.col("energy_value_2"), REACH, ["nation"]).where("dataset_code_1 < dataset_code_2")
    c = F.col
    # There are 40 lists of options at most, so what two of them say is found once.
    lists = levels.select("spin_parity_list").distinct()
    told = lists.select(c("spin_parity_list").alias("spin_parity_list_1")).crossJoin(lists.select(c("spin_parity_list").alias("spin_parity_list_2"))).select(
        "spin_parity_list_1", "spin_parity_list_2",
        sim.spin_similarity(c("spin_parity_list_1"), c("spin_parity_list_2")).alias("spin"),
        sim.parity_similarity(c("spin_parity_list_1"), c("spin_parity_list_2")).alias("parity"),
        sim.specificity(F.size("spin_parity_list_1"), F.size("spin_parity_list_2")).alias("specificity"),
    )
    scored = near.join(F.broadcast(told), ["spin_parity_list_1", "spin_parity_list_2"]).select(
        "nation", "key_1", "key_2", "dataset_code_1", "dataset_code_2",
        sim.energy_similarity(c("energy_value_1"), c("energy_uncertainty_1"), c("energy_value_2"), c("energy_uncertainty_2")).alias("energy"),
        "spin", "parity", "specificity",
    )
    return scored.withColumn("probability", sim.physics_label(c("energy"), c("spin"), c("parity"), c("specificity"), F.lit(0.5)))


_LEVELS = """
    lev AS (SELECT c_nationkey AS nation, c_mktsegment AS ds, c_custkey AS k, c_acctbal AS e, CASE WHEN c_custkey % 2 = 0 THEN 5.0::DOUBLE ELSE 0.5::DOUBLE END AS s,
                   2 * (c_custkey % 5) AS j, c_custkey % 3 = 0 AS tj, CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END AS p, c_custkey % 7 = 0 AS tp FROM customer),
    feat AS (
      SELECT a.nation, a.k AS key_1, b.k AS key_2, exp(-0.1::DOUBLE * pow(abs(a.e - b.e) / sqrt(a.s * a.s + b.s * b.s), 2)) AS energy,
             CASE WHEN a.j = b.j THEN CASE WHEN a.tj OR b.tj THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END WHEN abs(a.j - b.j) = 2 THEN CASE WHEN a.tj OR b.tj THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END ELSE 0.0::DOUBLE END AS spin,
             CASE WHEN a.p = b.p THEN CASE WHEN a.tp OR b.tp THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END ELSE CASE WHEN a.tp OR b.tp THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END END AS parity
      FROM lev a JOIN lev b ON a.nation = b.nation AND a.ds < b.ds AND abs(a.e - b.e) <= 25),
    scored AS (
      SELECT *, CASE WHEN spin <= 0.05 OR parity <= 0.025 THEN 0.0::DOUBLE
                ELSE least(0.99::DOUBLE, (CASE WHEN spin >= 0.85 AND parity >= 0.85 THEN sqrt(energy) ELSE energy END) * sqrt(spin * parity * 0.85::DOUBLE)) END AS probability
      FROM feat)"""


@query(f"WITH {_LEVELS} SELECT nation, key_1, key_2, round(energy, 6) AS energy, spin, parity, round(probability, 6) AS probability FROM scored")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_pairs(spark, sf_dir).select("nation", "key_1", "key_2", r6(F.col("energy")).alias("energy"), "spin", "parity", r6(F.col("probability")).alias("probability"))


@query(f"""WITH {_LEVELS}, ranked AS (SELECT key_1, key_2, round(probability, 6) AS probability, row_number() OVER (PARTITION BY key_1 ORDER BY round(probability, 6) DESC, key_2) AS place FROM scored)
    SELECT key_1, key_2, probability, place FROM ranked WHERE place <= 3""")
def pair_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = customer_pairs(spark, sf_dir).select("key_1", "key_2", r6(F.col("probability")).alias("probability"))
    return pairs.top_partners(found, ["key_1"], [F.desc("probability"), F.asc("key_2")], 3).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {_LEVELS} SELECT count(*) FILTER (probability >= 0.7) AS n_high, count(*) FILTER (probability >= 0.3 AND probability < 0.7) AS n_medium, count(*) FILTER (probability >= 0.15 AND probability < 0.3) AS n_low,
    round(stddev_pop(probability), 6) AS spread, round(coalesce(avg(probability) FILTER (probability >= 0.7) - avg(probability) FILTER (probability >= 0.15 AND probability < 0.3), 0), 6) AS separation FROM scored""")
def probability_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = averages.probability_bands(customer_pairs(spark, sf_dir), "probability")
    return found.select("n_high", "n_medium", "n_low", r6(F.col("spread")).alias("spread"), r6(F.col("separation")).alias("separation"))


@query("""SELECT c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal), 6) AS distance FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 40""")
def range_join_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    found = pairs.range_join(c, s, F.col("c_acctbal"), F.col("s_acctbal"), 40.0, ["nation"])
    return found.select("c_custkey", "s_suppkey", r6(F.abs(F.col("c_acctbal") - F.col("s_acctbal"))).alias("distance"))


@query("""WITH near AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS d, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS place
      FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 50)
    SELECT s.s_suppkey, coalesce(n.c_custkey, 0) AS final_level, round(n.d, 6) AS distance FROM supplier s LEFT JOIN near n ON n.s_suppkey = s.s_suppkey AND n.place = 1""")
def nearest_final_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    found = pairs.nearest(s, c, F.col("s_acctbal"), F.col("c_acctbal"), ["s_suppkey"], F.col("c_custkey"), 50.0, ["nation"])
    return found.select("s_suppkey", F.coalesce("nearest.tie", F.lit(0)).cast("long").alias("final_level"), r6(F.col("nearest.distance")).alias("distance"))


@query("""WITH d AS (SELECT c_nationkey AS nation, c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS d FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 200),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS r1, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) AS r2 FROM d)
    SELECT nation, c_custkey, s_suppkey, round(d, 6) AS distance FROM r WHERE r1 = 1 AND r2 = 1""")
def mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    found = pairs.mutually_nearest(c, s, F.col("c_acctbal"), F.col("s_acctbal"), "c_custkey", "s_suppkey", 200.0, ["nation"])
    return found.select("nation", "c_custkey", "s_suppkey", r6(F.col("distance")).alias("distance"))


# --- printed values -----------------------------------------------------------

_CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"
_PRINTED = f"""CASE p_partkey % 4 WHEN 0 THEN CAST({_CENTS} // 100 AS VARCHAR) WHEN 1 THEN CAST({_CENTS} // 100 AS VARCHAR) || '.' || lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0')
    WHEN 2 THEN CAST({_CENTS} // 100 AS VARCHAR) || '.0' ELSE CAST({_CENTS} // 100000 AS VARCHAR) || '.' || CAST({_CENTS} % 10 AS VARCHAR) || 'E' || CAST(p_size % 4 AS VARCHAR) END"""


def printed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    whole = F.floor(cents / 100).cast("string")
    kind = F.col("p_partkey") % 4
    shown = (
        F.when(kind == 0, whole)
        .when(kind == 1, F.concat(whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))
        .when(kind == 2, F.concat(whole, F.lit(".0")))
        .otherwise(F.concat(F.floor(cents / 100000).cast("string"), F.lit("."), (cents % 10).cast("string"), F.lit("E"), (F.col("p_size") % 4).cast("string")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", shown.alias("printed"))


@query(f"""SELECT p_partkey, {_PRINTED} AS printed,
      round(CASE p_partkey % 4 WHEN 0 THEN 5.0 WHEN 1 THEN 0.05 WHEN 2 THEN 0.5 ELSE 5.0 * pow(10, p_size % 4 - 1) END, 6) AS inferred,
      round(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size / 100.0 WHEN 2 THEN p_size / 10.0 ELSE p_size * pow(10, p_size % 4 - 1) END, 6)::DOUBLE AS absolute FROM part""")
def uncertainty_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("printed")
    return printed_prices(spark, sf_dir).select("p_partkey", "printed", r6(text.uncertainty_from_precision(p)).alias("inferred"), r6(text.absolute_uncertainty(p, F.col("p_size").cast("string"))).alias("absolute"))


_SPINS = ["1:3", "2-,3-", "(4)-", "5(+)", "(1,2)+", "(3,4)(+)", "(1+,2+)", "(3/2+,5/2-)", "3/2,5/2,7/2(+)", "(3/2,5/2,7/2)+", "1/2:11/2", "unknown", "", "0+", "2.", "9/2-"]


@query("""WITH t AS (SELECT p_partkey, ([""" + ", ".join(f"'{s}'" for s in _SPINS) + r"""])[CAST(p_partkey % 16 AS INT) + 1] AS s FROM part),
    b AS (SELECT p_partkey, s, regexp_replace(s, '\.$', '') AS b FROM t),
    w AS (SELECT *, regexp_matches(b, '^\(.*,.*\)$') AS whole, CASE WHEN regexp_matches(b, '^\(.*,.*\)$') THEN regexp_extract(b, '^\((.*)\)$', 1) ELSE b END AS inner_text FROM b),
    span AS (SELECT p_partkey, s, unnest(generate_series(CAST(split_part(b, ':', 1) AS INT), CAST(split_part(b, ':', 2) AS INT))) AS k FROM w WHERE regexp_matches(b, '^[0-9]+:[0-9]+$')),
    part_of AS (SELECT p_partkey, s, whole, unnest(string_split(inner_text, ',')) AS x, unnest(range(len(string_split(inner_text, ',')))) AS i FROM w WHERE NOT contains(b, ':') AND lower(b) NOT IN ('', 'unknown', 'none')),
    opt AS (SELECT p_partkey, s, i, whole OR contains(x, '(') OR contains(x, ')') AS tentative, CASE WHEN contains(x, '+') THEN '+' WHEN contains(x, '-') THEN '-' END AS parity, trim(regexp_replace(x, '[-+()]', '', 'g')) AS n FROM part_of),
    val AS (SELECT *, CASE WHEN regexp_matches(n, '^[0-9]+$') THEN 2 * CAST(n AS INT) WHEN regexp_matches(n, '^[0-9]+/[0-9]+$') THEN 2 * CAST(split_part(n, '/', 1) AS INT) // CAST(split_part(n, '/', 2) AS INT) END AS two FROM opt),
    every AS (SELECT p_partkey, s, k AS i, (2 * k) || ':false::false' AS o FROM span UNION ALL SELECT p_partkey, s, i, two || ':' || tentative || ':' || coalesce(parity, '') || ':' || (tentative AND parity IS NOT NULL) FROM val WHERE two IS NOT NULL)
    SELECT t.p_partkey, t.s AS text, coalesce(string_agg(e.o, ' ' ORDER BY e.i), '') AS options FROM t LEFT JOIN every e USING (p_partkey) GROUP BY t.p_partkey, t.s""")
def spin_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.element_at(F.array(*map(F.lit, _SPINS)), (F.col("p_partkey") % 16 + 1).cast("int"))
    shown = F.transform(text.parse_spin_parity(F.col("text")), lambda o: F.concat_ws(":", o["twoTimesSpin"].cast("string"), o["isTentativeSpin"].cast("string"), F.coalesce(o["parity"], F.lit("")), o["isTentativeParity"].cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", chosen.alias("text")).select("p_partkey", "text", F.array_join(shown, " ").alias("options"))


def order_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    option = F.struct((F.col("l_quantity") % 5 * 2).cast("int").alias("twoTimesSpin"), (F.col("l_linenumber") % 2 == 0).alias("isTentativeSpin"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("parity"), (F.col("l_linenumber") % 3 == 0).alias("isTentativeParity"))
    lines = table(spark, sf_dir, "lineitem").withColumn("o", option)
    side = lambda flag: F.collect_list(F.when(flag, F.col("o"))).cast(SPIN_OPTIONS)
    return lines.groupBy("l_orderkey").agg(side(F.col("l_returnflag") == "R").alias("a"), side(F.col("l_returnflag") != "R").alias("b"))


@query("""WITH l AS (SELECT l_orderkey, l_returnflag = 'R' AS left_side, CAST(l_quantity % 5 * 2 AS INT) AS j, l_linenumber % 2 = 0 AS tj, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS p, l_linenumber % 3 = 0 AS tp FROM lineitem),
    s AS (SELECT a.l_orderkey, max(CASE WHEN a.j = b.j THEN CASE WHEN a.tj OR b.tj THEN 0.8 ELSE 1.0 END WHEN abs(a.j - b.j) = 2 THEN CASE WHEN a.tj OR b.tj THEN 0.2 ELSE 0.05 END ELSE 0.0 END) AS spin,
             max(CASE WHEN a.p = b.p THEN CASE WHEN a.tp OR b.tp THEN 0.8 ELSE 1.0 END ELSE CASE WHEN a.tp OR b.tp THEN 0.05 ELSE 0.0 END END) AS parity
      FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.left_side AND NOT b.left_side GROUP BY a.l_orderkey)
    SELECT o.l_orderkey, coalesce(s.spin, 0.5)::DOUBLE AS spin, coalesce(s.parity, 0.5)::DOUBLE AS parity FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN s USING (l_orderkey)""")
def option_match_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_options(spark, sf_dir).select("l_orderkey", sim.spin_similarity(F.col("a"), F.col("b")).alias("spin"), sim.parity_similarity(F.col("a"), F.col("b")).alias("parity"))


@query("""SELECT l_orderkey, round(1 / sqrt(count(*) * count(DISTINCT l_suppkey)), 6) AS root, round(1.0::DOUBLE / (count(*) * count(DISTINCT l_suppkey)), 6) AS linear,
    round(1 / (1 + log10(count(*) * count(DISTINCT l_suppkey))), 6) AS logarithm, round(1 / (1 + 0.5::DOUBLE * (count(*) * count(DISTINCT l_suppkey) - 1)), 6) AS tunable FROM lineitem GROUP BY l_orderkey""")
def specificity_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n1"), F.count_distinct("l_suppkey").alias("n2"))
    form = lambda f: r6(sim.specificity(F.col("n1"), F.col("n2"), f))
    return n.select("l_orderkey", form("sqrt").alias("root"), form("linear").alias("linear"), form("log").alias("logarithm"), form("tunable").alias("tunable"))


def order_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as gammas, with the customer's next order."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.struct(F.col("l_quantity").alias("energy"), F.lit(1.0).alias("energy_uncertainty"), (F.col("l_extendedprice") / 1000).alias("intensity"), (F.col("l_discount") * 100).alias("intensity_uncertainty")).alias("g"))
    spectra = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["g"]).cast(GAMMAS).alias("gammas"))
    following = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lead("o_orderkey").over(following).alias("next_key")).where("next_key IS NOT NULL")
    one = spectra.select(F.col("l_orderkey").alias("o_orderkey"), F.col("gammas").alias("a"))
    two = spectra.select(F.col("l_orderkey").alias("next_key"), F.col("gammas").alias("b"))
    return orders.join(one, "o_orderkey").join(two, "next_key")


@query()
def gamma_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_spectra(spark, sf_dir).select("o_orderkey", "next_key", r6(sim.gamma_similarity(F.col("a"), F.col("b"))).alias("similarity"))


@query()
def gamma_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = lambda c: F.transform(c, lambda g: g.withField("intensity", F.lit(0.0))).cast(GAMMAS)
    return order_spectra(spark, sf_dir).select("o_orderkey", "next_key", r6(sim.gamma_similarity(bare(F.col("a")), bare(F.col("b")))).alias("similarity"))


@query("""WITH v AS (SELECT vec_id AS id_1, CAST(embedding AS DOUBLE[]) AS a, lead(vec_id) OVER w AS id_2, lead(CAST(embedding AS DOUBLE[])) OVER w AS b FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
    SELECT id_1, id_2, round(list_cosine_similarity(a, b), 5) AS cosine FROM v WHERE id_2 IS NOT NULL""")
def cosine_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next one of its label."""
    following = Window.partitionBy("label").orderBy("vec_id")
    v = table(spark, sf_dir, "embeddings")
    pair = v.select(F.col("vec_id").alias("id_1"), F.col("embedding").alias("a"), F.lead("vec_id").over(following).alias("id_2"), F.lead("embedding").over(following).alias("b"))
    return pair.where("id_2 IS NOT NULL").select("id_1", "id_2", F.round(sim.cosine(F.col("a"), F.col("b")), 5).alias("cosine"))


@query("""WITH h AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT user_id, sum(n) AS total FROM h GROUP BY user_id),
    s AS (SELECT a.user_id AS u1, b.user_id AS u2, sum(least(a.n, b.n)) AS shared FROM h a JOIN h b ON b.user_id = a.user_id + 1 AND a.event_type = b.event_type GROUP BY ALL)
    SELECT a.user_id AS user_1, b.user_id AS user_2, round(2.0::DOUBLE * coalesce(s.shared, 0) / (a.total + b.total), 6) AS similarity FROM u a JOIN u b ON b.user_id = a.user_id + 1 LEFT JOIN s ON s.u1 = a.user_id AND s.u2 = b.user_id""")
def bray_curtis(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    h = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.col("n").cast("double")))).alias("h"))
    pair = h.select(F.col("user_id").alias("user_1"), F.col("h").alias("x"), (F.col("user_id") + 1).alias("user_2")).join(h.select(F.col("user_id").alias("user_2"), F.col("h").alias("y")), "user_2")
    keys = F.array_union(F.map_keys("x"), F.map_keys("y"))
    amount = lambda m: F.transform(keys, lambda k: F.coalesce(F.try_element_at(F.col(m), k), F.lit(0.0)))
    pair = pair.select("user_1", "user_2", amount("x").alias("a"), amount("y").alias("b"))
    return pair.select("user_1", "user_2", r6(sim.bray_curtis(F.col("a"), F.col("b"))).alias("similarity"))


# --- training data and models ---------------------------------------------------

_LABEL = """CASE WHEN spin <= 0.05 OR parity <= 0.025 THEN 0.0::DOUBLE ELSE least(0.99::DOUBLE, (CASE WHEN (spin >= 0.85 AND parity >= 0.85) OR gamma >= 0.85 THEN sqrt(energy) ELSE energy END)
    * sqrt(CASE WHEN spin = 0.5 THEN 0.85 ELSE spin END * CASE WHEN parity = 0.5 THEN 0.85 ELSE parity END * CASE WHEN gamma = 0.5 THEN 0.85 ELSE gamma END) * specificity) END"""
_D = lambda *x: "[" + ", ".join(f"{v!r}::DOUBLE" for v in x) + "]"


@query(f"""WITH e AS (SELECT 0.0::DOUBLE + k * (0.3::DOUBLE / 9) AS energy FROM range(10) t(k) UNION ALL SELECT 0.3::DOUBLE + k * ((0.8::DOUBLE - 0.3::DOUBLE) / 9) FROM range(10) t(k) UNION ALL SELECT 0.8::DOUBLE + k * ((1.0::DOUBLE - 0.8::DOUBLE) / 19) FROM range(20) t(k)),
    g AS (SELECT energy, spin, parity, specificity, gamma FROM e, (SELECT unnest({_D(*learning.SPIN_SCORES)}) AS spin), (SELECT unnest({_D(*learning.PARITY_SCORES)}) AS parity), (SELECT unnest({_D(*learning.SPECIFICITIES)}) AS specificity), (SELECT unnest({_D(*learning.GAMMA_SCORES)}) AS gamma))
    SELECT round(energy, 6) AS energy, spin, parity, specificity, gamma, round({_LABEL}, 6) AS label FROM g""")
def physics_label_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.physics_grid(spark).withColumns({"energy": r6(F.col("energy")), "label": r6(F.col("label"))})


@query(f"""WITH g AS (SELECT energy, c.s AS spin, c.p AS parity, 1.0::DOUBLE AS specificity, c.g AS gamma FROM (SELECT unnest({_D(*learning.TEACHING_ENERGIES)}) AS energy),
      (SELECT unnest([{", ".join(f"{{'s': {s}::DOUBLE, 'p': {p}::DOUBLE, 'g': {g}::DOUBLE}}" for s, p, g in learning.TEACHING_CASES)}]) AS c))
    SELECT energy, spin, parity, specificity, gamma, round({_LABEL}, 6) AS label FROM g""")
def teaching_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.teaching_set(spark).withColumn("label", r6(F.col("label")))


@query()
def kmeans_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_pairs(spark, sf_dir).withColumn("gamma", F.lit(0.5))
    scorer = learning.ClusterScorer().fit(learning.training_set(spark))
    return scorer.score(rows).select("key_1", "key_2", F.col("probability").alias("is_match"))


@query()
def boosted_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_pairs(spark, sf_dir).drop("probability").withColumn("gamma", F.lit(0.5))
    scorer = learning.BoostedScorer().fit(learning.training_set(spark))
    return scorer.score(rows).select("key_1", "key_2", r6(F.col("probability")).alias("probability"))


@query()
def monotone_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs scored by trees that learn the labels of all pairs, one in five held."""
    rows = customer_pairs(spark, sf_dir).withColumnRenamed("probability", "label").withColumn("held", F.pmod(F.xxhash64("key_1", "key_2"), F.lit(5)) == 0)
    scorer = boosting.MonotoneScorer(boosting.Settings(trees=20, depth=5), ["energy", "spin", "parity"]).fit(rows)
    return scorer.score(rows).select("key_1", "key_2", r6(F.col("label")).alias("label"), r6(F.col("probability")).alias("probability"))


@query("""WITH p AS (SELECT quality::DOUBLE AS y, least(0.99::DOUBLE, greatest(0.01::DOUBLE, n_chars / 5000.0::DOUBLE)) AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)
    SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss FROM p""")
def metrics_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").where("quality IS NOT NULL").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select(F.col("quality").cast("double").alias("y"), F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / 5000.0)).alias("p"))
    found = averages.regression_metrics(rows, "y", "p")
    return found.select(*[r6(F.col(c)).alias(c) for c in found.columns])


@query("""WITH v AS (SELECT p_partkey, p_retailprice * 1.0123457::DOUBLE AS x, p_size / 7.0::DOUBLE AS dx, CAST(greatest(0, least(6, floor(log10(35.0::DOUBLE / (p_size / 7.0::DOUBLE))))) AS INT) AS d FROM part)
    SELECT p_partkey, round(round(x * pow(10.0::DOUBLE, d)) / pow(10.0::DOUBLE, d), 6) AS x, round(round(dx * pow(10.0::DOUBLE, d)) / pow(10.0::DOUBLE, d), 6) AS up, round(CASE WHEN p_partkey % 2 = 0 THEN round(dx * pow(10.0::DOUBLE, d)) ELSE p_partkey % 9 + 1 END / pow(10.0::DOUBLE, d), 6) AS down, CASE WHEN p_partkey % 3 = 0 THEN 'NS' END AS unit FROM v""")
def values_from_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values printed, with units and uncertainties of one or two sides, and read."""
    k = F.col("p_partkey")
    shown = text.value_text(F.col("p_retailprice") * 1.0123457, F.col("p_size") / 7.0)
    number, error = F.regexp_extract(shown, r"^([^(]*)", 1), F.regexp_extract(shown, r"\(([0-9]+)\)", 1)
    sides = F.when(k % 2 == 0, error).otherwise(F.concat(F.lit("+"), error, F.lit("-"), (k % 9 + 1).cast("string")))
    printed = F.when(k % 3 == 0, F.concat(number, F.lit(" NS "), sides)).otherwise(F.concat(number, F.lit("("), sides, F.lit(")")))
    v = F.col("v")
    return table(spark, sf_dir, "part").select("p_partkey", text.printed_value(printed).alias("v")).select("p_partkey", r6(v["x"]).alias("x"), r6(v["up"]).alias("up"), r6(v["down"]).alias("down"), v["unit"].alias("unit"))


# --- averages -------------------------------------------------------------------


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"), (1 + 100 * F.col("l_discount")).alias("dx"))


_SUMS = """l AS (SELECT l_partkey AS part, l_extendedprice / l_quantity AS x, 1 + 100 * l_discount AS dx FROM lineitem),
    s AS (SELECT part, count(*) AS n, sum(1 / (dx * dx)) AS sw, sum(x / (dx * dx)) AS swx, sum(x * x / (dx * dx)) AS swxx, avg(x) AS u FROM l GROUP BY part)"""


@query(f"""WITH {_SUMS} SELECT part, n, round(swx / sw, 4) AS weighted, round(1 / sqrt(sw), 6) AS internal, round(u, 4) AS unweighted FROM s""")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = averages.weighted_mean(priced_lines(spark, sf_dir), ["part"], "x", "dx")
    return found.select("part", "n", F.round("weighted", 4).alias("weighted"), r6(F.col("internal")).alias("internal"), F.round("unweighted", 4).alias("unweighted"))


@query("""WITH l AS (SELECT l_partkey AS part, l_quantity AS x, 1 + l_linenumber::DOUBLE AS dx FROM lineitem),
    w AS (SELECT *, (1 / (dx * dx)) / sum(1 / (dx * dx)) OVER (PARTITION BY part) >= 0.02 AS used FROM l),
    a AS (SELECT part, count(*) AS n, sum(x / (dx * dx)) / sum(1 / (dx * dx)) AS wa, avg(x) AS u, min(x) AS low, max(x) AS high, sum(1 / (dx * dx)) AS sw FROM w GROUP BY part),
    b AS (SELECT part, count(*) AS n, sum(x / (dx * dx)) / sum(1 / (dx * dx)) AS wu FROM w WHERE used GROUP BY part),
    c AS (SELECT w.part, coalesce(sum((x - wa) * (x - wa) / (dx * dx)) / nullif(max(a.n) - 1, 0), 0) AS chi_all, coalesce(sum(CASE WHEN used THEN (x - wu) * (x - wu) / (dx * dx) END) / nullif(max(b.n) - 1, 0), 0) AS chi, bool_or(round(x, 6) = round(wu, 6)) AS equals FROM w JOIN a USING (part) JOIN b USING (part) GROUP BY w.part),
    k AS (SELECT a.part, a.n, a.wa, a.u, b.wu, CASE WHEN low = high OR equals THEN 'Non-Average' WHEN least(chi, chi_all) > 3.5 THEN 'Unweighted-Average' WHEN round(wu, 6) = round(wa, 6) THEN 'Weighted-Of-All' WHEN chi_all < chi OR chi_all < 3.0 THEN 'Weighted-Of-All' ELSE 'Weighted-Average' END AS kind FROM a JOIN b USING (part) JOIN c USING (part))
    SELECT part, n, kind, round(CASE kind WHEN 'Unweighted-Average' THEN u WHEN 'Weighted-Of-All' THEN wa ELSE wu END, 4) AS adopted FROM k""")
def average_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("x"), (1 + F.col("l_linenumber").cast("double")).alias("dx"))
    return averages.average_decision(rows, ["part"], "x", "dx").select("part", "n", "kind", F.round("adopted", 4).alias("adopted"))


@query(f"""WITH {_SUMS}, t AS (SELECT part, max(struct_pack(w := 1 / (dx * dx), x := x)) AS top FROM l GROUP BY 1), j AS (SELECT s.*, top.w AS w, top.x AS x FROM s JOIN t USING (part))
    SELECT part, round(CASE WHEN n >= 3 AND w > 0.5 * sw * (1 + 1e-12) THEN (swx - w * x + (sw - w) * x) / (2 * (sw - w)) ELSE swx / sw END, 4) AS value, round(CASE WHEN n >= 3 AND w > 0.5 * sw * (1 + 1e-12) THEN 1 / sqrt(2 * (sw - w)) ELSE 1 / sqrt(sw) END, 6) AS uncertainty FROM j""")
def limited_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = averages.other_averages(priced_lines(spark, sf_dir), "part", "x", "dx", ["LWM"])
    return found.select("part", F.round("value", 4).alias("value"), r6(F.col("uncertainty")).alias("uncertainty"))


@query("""WITH RECURSIVE l AS (SELECT l_suppkey % 40 AS part, l_linenumber AS k, l_discount * 100 + l_quantity / 7 AS x, (1 + l_linenumber % 3) / 2.0::DOUBLE AS dx FROM lineitem),
    mp(part, i, extra, done) AS (
      SELECT DISTINCT part, 0, 0.0::DOUBLE, false FROM l
      UNION ALL
      SELECT part, i + 1, CASE WHEN stop THEN extra ELSE greatest(0, extra + e / q) END, stop FROM (
        SELECT *, n < 2 OR abs(e) <= 0.01 OR (e < 0 AND extra = 0) AS stop FROM (
          SELECT part, i, extra, n, sum(w * (x - m) * (x - m)) - (n - 1) AS e, sum(w * w * (x - m) * (x - m)) AS q FROM (
            SELECT *, 1 / (dx * dx + extra) AS w, sum(x / (dx * dx + extra)) OVER o / sum(1 / (dx * dx + extra)) OVER o AS m, count(*) OVER o AS n
            FROM (SELECT mp.part, mp.i, mp.extra, l.x, l.dx FROM mp JOIN l ON l.part = mp.part WHERE NOT mp.done AND mp.i < 60) WINDOW o AS (PARTITION BY part)) GROUP BY part, i, extra, n))),
    f AS (SELECT part, arg_max(extra, i) AS extra FROM mp GROUP BY part)
    SELECT part, round(sum(x / (dx * dx + extra)) / sum(1 / (dx * dx + extra)), 4) AS value, round(1 / sqrt(sum(1 / (dx * dx + extra))), 5) AS uncertainty FROM l JOIN f USING (part) GROUP BY part""")
def mandel_paule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_suppkey") % 40).alias("part"), (c("l_discount") * 100 + c("l_quantity") / 7).alias("x"), ((1 + c("l_linenumber") % 3) / 2.0).alias("dx"))
    found = averages.other_averages(rows, "part", "x", "dx", ["MP"])
    return found.select("part", F.round("value", 4).alias("value"), F.round("uncertainty", 5).alias("uncertainty"))


@query("""WITH l AS (SELECT l_partkey AS part, l_returnflag AS flag, l_extendedprice * 1.0123457::DOUBLE AS x, l_extendedprice * (0.013::DOUBLE + l_discount) AS dx FROM lineitem),
    w AS (SELECT *, (1 / (dx * dx)) / sum(1 / (dx * dx)) OVER (PARTITION BY part, flag) >= 0.02 AS used FROM l),
    a AS (SELECT part, flag, count(*) AS n, sum(x / (dx * dx)) / sum(1 / (dx * dx)) AS wa, avg(x) AS u, min(x) AS low, max(x) AS high FROM w GROUP BY ALL),
    b AS (SELECT part, flag, count(*) AS n, sum(x / (dx * dx)) / sum(1 / (dx * dx)) AS wu FROM w WHERE used GROUP BY ALL),
    c AS (SELECT w.part, w.flag, coalesce(sum((x - wa) * (x - wa) / (dx * dx)) / nullif(max(a.n) - 1, 0), 0) AS chi_all, coalesce(sum(CASE WHEN used THEN (x - wu) * (x - wu) / (dx * dx) END) / nullif(max(b.n) - 1, 0), 0) AS chi, bool_or(round(x, 6) = round(wu, 6)) AS equals FROM w JOIN a USING (part, flag) JOIN b USING (part, flag) GROUP BY ALL),
    k AS (SELECT a.part, a.flag, a.n, wa, u, wu, chi, chi_all, CASE WHEN low = high OR equals THEN 'Non-Average' WHEN least(chi, chi_all) > 3.5 THEN 'Unweighted-Average' WHEN round(wu, 6) = round(wa, 6) THEN 'Weighted-Of-All' WHEN chi_all < chi OR chi_all < 3.0 THEN 'Weighted-Of-All' ELSE 'Weighted-Average' END AS kind FROM a JOIN b USING (part, flag) JOIN c USING (part, flag))
    SELECT part, flag, kind, n, round(CASE kind WHEN 'Unweighted-Average' THEN u WHEN 'Weighted-Of-All' THEN wa ELSE wu END, 3) AS adopted FROM k""")
def decision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines on the averages of gamma groups (flags) in level groups (parts),
    read back."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") * 1.0123457).alias("x"), (F.col("l_extendedprice") * (0.013 + F.col("l_discount"))).alias("dx"))
    lines = reports.decision_lines(averages.average_decision(rows, ["part", "flag"], "x", "dx"), ["part", "flag"])
    told = lambda pattern, kind: F.regexp_extract("line", pattern, 1).cast(kind)
    return lines.select(told(r"^(\d+) /", "long").alias("part"), told(r"/ (\w+):", "string").alias("flag"), told(r": (\S+) ", "string").alias("kind"), told(r"n=(\d+)", "long").alias("n"), told(r": \S+ (-?[0-9.]+),", "double").alias("adopted"))


@query()
def average_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = averages.other_averages(priced_lines(spark, sf_dir), "part", "x", "dx", ["LWM", "NRM", "RT", "EVM", "MP"])
    return found.select("part", "method", F.round("value", 4).alias("value"), F.round("uncertainty", 4).alias("uncertainty"))


@query("""WITH l AS (SELECT l_partkey AS part, l_extendedprice / l_quantity AS x, 1 + 100 * l_discount AS dx, row_number() OVER () AS i FROM lineitem),
    d AS (SELECT a.part, a.i, a.x, a.dx, sum(exp(-0.5::DOUBLE * pow((a.x - b.x) / b.dx, 2)) / b.dx) AS w FROM l a JOIN l b USING (part) GROUP BY ALL),
    n AS (SELECT *, w / sum(w) OVER (PARTITION BY part) AS p, count(*) OVER (PARTITION BY part) AS n FROM d), m AS (SELECT *, sum(p * x) OVER (PARTITION BY part) AS mean FROM n)
    SELECT part, round(max(mean), 4) AS value, round(greatest(sqrt(sum(p * p * dx * dx)), sqrt(sum(p * (x - mean) * (x - mean)) / max(n))), 4) AS uncertainty FROM m GROUP BY part""")
def expected_value_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = averages.other_averages(priced_lines(spark, sf_dir), "part", "x", "dx", ["EVM"])
    return found.select("part", F.round("value", 4).alias("value"), F.round("uncertainty", 4).alias("uncertainty"))


@query("""WITH m AS (SELECT l_orderkey AS g, l_quantity AS x, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 1 + l_tax * 10 END AS dx, CASE WHEN l_returnflag = 'A' THEN '*' WHEN l_returnflag = 'R' THEN '?' END AS marker FROM lineitem),
    s AS (SELECT *, CASE WHEN marker IS NOT NULL THEN greatest(5 * coalesce(nullif(dx, 0), 5.0), 5.0) ELSE coalesce(nullif(dx, 0), 5.0) END AS sg, coalesce(marker = '?', false) AS doubt FROM m),
    c AS (SELECT s.* FROM s JOIN (SELECT g, bool_or(NOT doubt) AS firm FROM s GROUP BY g) f USING (g) WHERE NOT doubt OR NOT firm),
    a AS (SELECT g, count(*) AS n, sum(x / (sg * sg)) / sum(1 / (sg * sg)) AS e, 1 / sqrt(sum(1 / (sg * sg))) AS internal, min(sg) AS least_sg, sum(1 / (sg * sg)) AS sw FROM c GROUP BY g),
    b AS (SELECT c.g, coalesce(sqrt(sum((x - e) * (x - e) / (sg * sg)) / (nullif(max(a.n) - 1, 0) * max(sw))), 0) AS external FROM c JOIN a USING (g) GROUP BY c.g)
    SELECT g AS group_id, n, round(e, 4) AS energy, round(greatest(internal, external, least_sg), 4) AS uncertainty FROM a JOIN b USING (g)""")
def group_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_quantity").alias("x"), F.when(F.col("l_linenumber") % 4 != 0, 1 + F.col("l_tax") * 10).alias("dx"), F.when(F.col("l_returnflag") == "A", "*").when(F.col("l_returnflag") == "R", "?").alias("marker"))
    return averages.group_energy(rows, ["group_id"]).select("group_id", "n", F.round("energy", 4).alias("energy"), F.round("uncertainty", 4).alias("uncertainty"))


@query("""SELECT s_nationkey, arg_min(s_suppkey, struct_pack(a := abs(s_acctbal), b := s_suppkey)) AS anchor, count(*) AS n FROM supplier GROUP BY s_nationkey""")
def anchor_min_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    rows = s.select("s_nationkey", F.col("s_suppkey").alias("level_id"), F.abs("s_acctbal").alias("energy_uncertainty"), F.col("s_suppkey").alias("seq"))
    return cluster.anchors(rows, ["s_nationkey"]).join(s.groupBy("s_nationkey").agg(F.count("*").alias("n")), "s_nationkey")


# --- windows and groups -----------------------------------------------------------


@query("""WITH t AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations)
    SELECT conv_id, turn, coalesce(asked, -1) AS asked FROM t WHERE role = 'assistant'""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    rows = records.carried(turns, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "asked")
    return rows.where("role = 'assistant'").select("conv_id", "turn", F.coalesce("asked", F.lit(-1)).cast("long").alias("asked"))


@query("""WITH m AS (SELECT event_id, user_id, ts, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 AS INT), 0) AS fresh FROM events)
    SELECT event_id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM m""")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return groups.gap_islands(rows, ["user_id"], F.col("us"), 3_600_000_000, "session", ["event_id"]).select("event_id", "user_id", "session")


@query("""WITH RECURSIVE o AS (SELECT c_nationkey AS nation, c_custkey, c_acctbal AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS n FROM customer),
    s(nation, c_custkey, x, n, island, part, first_x) AS (
      SELECT nation, c_custkey, x, n, CAST(0 AS BIGINT), CAST(0 AS INT), x FROM o WHERE n = 1
      UNION ALL SELECT o.nation, o.c_custkey, o.x, o.n, CASE WHEN o.x - s.x > 20 THEN s.island + 1 ELSE s.island END, CAST(CASE WHEN o.x - s.x > 20 THEN 0 WHEN o.x - s.x > 10 AND s.x - s.first_x > 20 THEN s.part + 1 ELSE s.part END AS INT),
        CASE WHEN o.x - s.x > 20 OR (o.x - s.x > 10 AND s.x - s.first_x > 20) THEN o.x ELSE s.first_x END FROM s JOIN o ON o.nation = s.nation AND o.n = s.n + 1)
    SELECT nation, c_custkey, island, part FROM s""")
def coarse_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("x"))
    return groups.coarse_groups(rows, "nation", 20.0).select("nation", "c_custkey", "island", "part")


@query("""SELECT CAST(floor((p_retailprice - 900) / 20) AS BIGINT) AS bin, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1""")
def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(groups.fixed_bins(F.col("p_retailprice"), F.lit(900.0), F.lit(20.0)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS previous FROM lineitem)
    SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) AS ship_us, epoch_us(previous) AS previous_us FROM o WHERE l_shipdate < previous""")
def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ship_us"))
    return rules.order_rule(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "ship_us"], "ship_us").select("l_orderkey", "l_linenumber", "ship_us", F.col("previous").alias("previous_us"))


@query("""SELECT event_id, max(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS near_3,
    max(CAST(value > 90 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 1 AS near_5 FROM events""")
def lookaround(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    one = groups.look_around(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", 3, "near_3")
    return groups.look_around(one, ["user_id"], ["ts", "event_id"], F.col("value") > 90, 5, "near_5").select("event_id", "near_3", "near_5")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(100 * l_extendedprice / max(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS branching, round(l_extendedprice / (1 + l_tax), 6) AS reduced FROM lineitem""")
def branching_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.max("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(100 * F.col("l_extendedprice") / top).alias("branching"), r6(nuclear.ti_to_branching(F.col("l_extendedprice"), F.col("l_tax"))).alias("reduced"))


@query("""SELECT r_name, n_name, count(*) AS n_levels, round(min(c_acctbal), 2) AS low, round(max(c_acctbal), 2) AS high, round(avg(c_acctbal), 4) AS mean
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = records.statistics(per, ["r_name", "n_name"], "c_acctbal")
    return found.select("r_name", "n_name", F.col("n").alias("n_levels"), F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), F.round("mean", 4).alias("mean"))


@query("""SELECT l_orderkey, string_agg(l_suppkey || '(' || CAST(l_quantity AS INT) || '%)', ' + ' ORDER BY l_linenumber, l_suppkey, l_quantity) AS sources FROM lineitem GROUP BY l_orderkey""")
def xref_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.source_texts(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_suppkey", "l_quantity"], F.col("l_suppkey"), F.col("l_quantity"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exclude_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return records.without(table(spark, sf_dir, "customer"), orders, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("""WITH l AS (SELECT l_orderkey, l_quantity, row_number() OVER () AS i FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM l GROUP BY 1),
    v AS (SELECT a.l_orderkey, count(*) AS m FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.i < b.i AND abs(a.l_quantity - b.l_quantity) <= 20 GROUP BY 1)
    SELECT n.l_orderkey, n.n AS members, coalesce(v.m, 0) AS valid_pairs, coalesce(v.m, 0) = n.n * (n.n - 1) // 2 AS is_clique FROM n LEFT JOIN v USING (l_orderkey)""")
def clique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.clique_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", 20)


@query("""WITH RECURSIVE e AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + a.p_size AND a.p_brand = b.p_brand),
    both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(v, w) AS (SELECT a, a FROM both_ways UNION SELECT r.v, x.b FROM reach r JOIN both_ways x ON x.a = r.w)
    SELECT v AS vertex, min(w) AS component FROM reach GROUP BY v""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    other = p.select(F.col("p_partkey").alias("b"), F.col("p_brand").alias("brand"))
    edges = p.join(other, (F.col("b") == F.col("p_partkey") + F.col("p_size")) & (F.col("p_brand") == F.col("brand"))).select(F.col("p_partkey").alias("a"), "b")
    return components(edges)


@query()
def greedy_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = customer_pairs(spark, sf_dir)
    name = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    edges = found.select(name("key_1").alias("level_1_id"), name("key_2").alias("level_2_id"), "probability", F.concat(name("key_1"), name("key_2")).alias("pair_rank"))
    levels = customer_levels(spark, sf_dir).select("dataset_code", name("key").alias("level_id"), "energy_value", "energy_uncertainty", name("key").alias("seq"))
    return cluster.greedy_clusters(levels, edges).select("component", "n", "dataset_code", "level_id", F.round("mean_energy", 4).alias("mean_energy"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
    b AS (SELECT *, sum(CAST(trim(line) = '' AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM l)
    SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n_lines, count(*) FILTER (substr(line, 8, 1) = 'L') AS n_levels, count(*) FILTER (substr(line, 8, 1) = 'G') AS n_gammas FROM b WHERE trim(line) <> '' GROUP BY doc_id, block""")
def wholetext_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return logs.blocks(lines).withColumnRenamed("file", "doc_id")


@query("""SELECT p_partkey, CAST(2 AS BIGINT) AS n_values, round(p_size + 0.5, 6)::DOUBLE AS first_value, round((p_partkey % 9 + 1) / 10.0, 6)::DOUBLE AS first_error, round(p_size * 2, 6)::DOUBLE AS second_value, -1.0::DOUBLE AS second_error FROM part""")
def comment_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    body = F.concat(F.lit("other value 7. T="), size, F.lit(".5 {I"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit("} (1973Pa02) and "), (F.col("p_size") * 2).cast("string"), F.lit("; weighted average."))
    v = F.col("v")
    rows = table(spark, sf_dir, "part").select("p_partkey", text.comment_values(body, "T").alias("v"))
    return rows.select("p_partkey", F.size("v").cast("long").alias("n_values"), r6(v[0]["x"]).alias("first_value"), r6(v[0]["dx"]).alias("first_error"), r6(v[1]["x"]).alias("second_value"), r6(v[1]["dx"]).alias("second_error"))


@query("""SELECT s_suppkey, s_suppkey % 4 IN (0, 3) AS quoted FROM supplier""")
def quoted_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    body = F.when(k == 0, "From Adopted Levels.").when(k == 1, "rounded-off value from the table").when(k == 2, "see Adopted").otherwise("Same as in Adopted Levels")
    return table(spark, sf_dir, "supplier").select("s_suppkey", comments.says_from_adopted(body, F.lit("E")).alias("quoted"))


@query("""WITH s AS (SELECT s_suppkey AS k, n_name AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS dataset_code, CAST(abs(round(s_acctbal)) AS DOUBLE) AS e FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    l AS (SELECT *, row_number() OVER (PARTITION BY file, dataset_code ORDER BY k) - 1 AS i FROM s),
    n AS (SELECT a.file, a.dataset_code, a.i, a.e, a.k, min(struct_pack(d := abs(a.e - floor(a.e / 2) - b.e), i := b.i)) FILTER (abs(a.e - floor(a.e / 2) - b.e) <= 50) AS nearest
      FROM l a JOIN l b USING (file, dataset_code) GROUP BY ALL)
    SELECT file, dataset_code, CAST(i AS BIGINT) AS initial_level, floor(e / 2) AS energy, CAST(coalesce(nearest.i, 0) AS BIGINT) AS final_level, CAST(2 + k % 2 + 4 * (k // 2) AS BIGINT) AS line_no FROM n""")
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of nations, each with datasets A and B of its own, read again: gammas with
    initial and final levels and their lines."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k, energy = F.col("s_suppkey"), F.abs(F.round("s_acctbal")).cast("long")
    head = F.concat(F.lit("# Dataset "), F.when(k % 2 == 0, "A").otherwise("B"), F.lit(":"))
    record = lambda kind, e: F.rpad(F.concat(F.lit(f" 34S   {kind} "), F.rpad(e.cast("string"), 10, " ")), 80, " ")
    # Each supplier opens its dataset again, so both are spread over the file.
    lines = s.select(F.col("n_name").alias("file"), F.posexplode(F.array(head, record("L", energy), record("G", F.floor(energy / 2)))).alias("at", "line"), (4 * F.floor(k / 2) + k % 2).alias("first"))
    placed = lines.select("file", (F.col("first") * 3 + F.col("at")).alias("order"), (F.col("first") + F.col("at")).cast("long").alias("shown"), "line")
    found = logs.gammas(logs.number_levels(logs.parse_records(logs.carry_forward(placed.withColumnRenamed("order", "line_no")))))
    back = placed.select("file", F.col("order").alias("line_no"), "shown")
    return found.join(back, ["file", "line_no"]).select("file", "dataset_code", F.col("initial_level").cast("long").alias("initial_level"), F.col("energy_value").alias("energy"), F.col("final_level").cast("long").alias("final_level"), F.col("shown").alias("line_no"))


@query("""SELECT n_name AS dataset_code, CAST(row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS BIGINT) AS level_index, CAST(abs(round(s_acctbal)) AS DOUBLE) AS energy, CAST(s_suppkey % 9 + 1 AS DOUBLE) AS uncertainty
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier balances printed as 80-column level records and read again."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    energy = F.rpad(F.abs(F.round("s_acctbal")).cast("long").cast("string"), 10, " ")
    record = F.rpad(F.concat(F.lit(" 34S   L "), energy, F.rpad((F.col("s_suppkey") % 9 + 1).cast("string"), 2, " ")), 80, " ")
    lines = s.select(F.col("n_name").alias("file"), F.col("s_suppkey").alias("line_no"), record.alias("line"))
    heads = table(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), F.lit(-1).cast("long").alias("line_no"), F.concat(F.lit("# Dataset "), "n_name", F.lit(":")).alias("line"))
    found = logs.levels(logs.number_levels(logs.parse_records(logs.carry_forward(lines.unionByName(heads)))))
    return found.select("dataset_code", "level_index", F.col("energy_value").alias("energy"), F.col("uncertainty.value").alias("uncertainty"))


@query("""WITH m AS (SELECT l_suppkey AS cluster_no, max(l_returnflag) AS ds, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, max(l_quantity) AS e, 1 + l_linenumber::DOUBLE AS u, max(l_linestatus) AS sp, max(l_discount) AS p
      FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber, l_partkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_no ORDER BY u, id) = 1 AS anchor FROM m)
    SELECT cluster_no, round(sum(e / (u * u)) / sum(1 / (u * u)), 1) AS adopted_energy, max(sp) FILTER (anchor) AS adopted_spin_parity,
           string_agg(id || '(' || CASE WHEN anchor THEN '100' ELSE CAST(CAST(round(p * 100) AS INT) AS VARCHAR) END || '%)', ' + ' ORDER BY NOT anchor, ds, id || '(' || CAST(CAST(round(p * 100) AS INT) AS VARCHAR) || '%)') AS sources FROM r GROUP BY 1""")
def consensus_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max("l_returnflag").alias("dataset_code"), F.max("l_quantity").alias("energy_value"), F.max("l_linestatus").alias("spin_parity_string"), F.max("l_discount").alias("match_probability"))
    lines = lines.select("*", F.col("l_suppkey").alias("cluster_no"), F.concat_ws("-", *keys).alias("level_id"), (1 + F.col("l_linenumber").cast("double")).alias("energy_uncertainty"))
    first = cluster.anchors(lines.withColumn("seq", F.col("level_id")), ["cluster_no"])
    members = lines.join(first, "cluster_no").select("cluster_no", "dataset_code", "level_id", (F.col("level_id") == F.col("anchor")).alias("is_anchor"), "match_probability")
    return matching.consensus(members, lines.select("level_id", "energy_value", "energy_uncertainty", "spin_parity_string"))


# --- rules and strengths --------------------------------------------------------

_MATCH = """m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity % 2 = 0 AS e, l_partkey % 3 <> 0 AS j, l_suppkey % 2 = 0 AS g, l_linenumber % 3 AS nm, l_linenumber % 3 + l_suppkey % 2 AS ng, l_quantity AS d, l_partkey % 5 * 2 AS gap, l_partkey % 7 = 0 AS pc FROM lineitem)"""


@query(f"""WITH {_MATCH}, s AS (SELECT *, gap <= 2 AND NOT pc AS close FROM m)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN e AND j AND NOT ng > 0 THEN 1 WHEN e AND j AND g AND nm >= 2 THEN 1 WHEN e AND j AND NOT g AND ((d <= 0.5 AND nm > 0) OR (gap = 0 AND nm = ng)) THEN 2
      WHEN e AND j AND g AND nm = 1 THEN CASE WHEN ng = 1 THEN 3 WHEN d <= 5 THEN 4 WHEN d <= 10 THEN 5 WHEN d <= 15 THEN 6 ELSE 7 END
      WHEN NOT (e AND j) AND (j OR close) AND d <= 5 AND (g OR NOT ng > 0) THEN 3 WHEN NOT (e AND j) AND (j OR close) AND d <= 10 AND g THEN CASE WHEN nm >= 2 THEN 3 ELSE 4 END
      WHEN NOT (e AND j) AND (j OR close) AND d <= 30 THEN CASE WHEN g THEN 5 ELSE 6 END WHEN e AND g AND NOT j AND gap <= 6 THEN 3 ELSE -1 END AS match_order FROM s""")
def match_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    order = groups.match_order(c("l_quantity") % 2 == 0, c("l_partkey") % 3 != 0, c("l_suppkey") % 2 == 0, c("l_linenumber") % 3, c("l_linenumber") % 3 + c("l_suppkey") % 2, c("l_quantity"), 30.0, c("l_partkey") % 5 * 2, c("l_partkey") % 7 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", order.alias("match_order"))


@query("""WITH m AS (SELECT l_orderkey AS group_id, l_partkey AS record_id, CASE WHEN l_returnflag = 'R' THEN '*' END AS marker, l_linestatus = 'F' AND l_linenumber = 1 AS is_adopted FROM lineitem),
    g AS (SELECT group_id FROM m GROUP BY 1 HAVING NOT bool_and(coalesce(marker = '*', false)) OR bool_or(is_adopted)), k AS (SELECT m.* FROM m JOIN g USING (group_id)), u AS (SELECT record_id, count(*) AS n FROM k GROUP BY 1)
    SELECT k.group_id, k.record_id, CASE WHEN marker = '*' AND n = 1 THEN NULL ELSE marker END AS marker, is_adopted FROM k JOIN u USING (record_id)""")
def marked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("record_id"), F.when(F.col("l_returnflag") == "R", "*").alias("marker"), ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)).alias("is_adopted"))
    return groups.drop_marked_groups(rows).select("group_id", "record_id", "marker", "is_adopted")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount, l_returnflag, l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber FROM r WHERE n = 1""")
def best_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.asc(c) for c in ("l_discount", "l_returnflag", "l_orderkey", "l_linenumber")]
    return groups.best_record(table(spark, sf_dir, "lineitem"), ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""WITH c AS (SELECT l_suppkey AS record_id, l_partkey AS group_id, count(*) AS n_matched, min(l_quantity) AS distance, CAST(min(l_linenumber) AS INT) AS match_order FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY n_matched DESC, distance, group_id) AS g, row_number() OVER (PARTITION BY record_id ORDER BY distance, n_matched DESC, group_id) AS d, min(match_order) OVER (PARTITION BY record_id) AS best FROM c)
    SELECT record_id, group_id, n_matched, distance, match_order FROM r WHERE (g = 1 OR d = 1) AND match_order > 0 AND NOT (best < 5 AND match_order > 5)""")
def candidate_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("record_id"), F.col("l_partkey").alias("group_id")).agg(F.count("*").alias("n_matched"), F.min("l_quantity").alias("distance"), F.min("l_linenumber").alias("match_order"))
    return groups.prefilter_candidates(rows, ["record_id"]).select("record_id", "group_id", "n_matched", "distance", "match_order")


@query()
def ordered_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and groups of one island (gaps of energy above the reach)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("record").alias("side"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("x"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("grp").alias("side"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("x"))
    both = groups.gap_islands(c.unionByName(s), ["nation"], F.col("x"), 60.0, tie=["side", "key"])
    ranked = both.withColumn("place", F.row_number().over(Window.partitionBy("nation", "island", "side").orderBy("x", "key")))
    return groups.assign_near(ranked, ["nation", "island"], 60.0)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'R17' AS rule, 'final level is not below the initial one' AS message FROM lineitem WHERE l_linenumber >= l_quantity
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'R20', 'transition strength is above the recommended upper limit' FROM lineitem WHERE l_extendedprice > l_quantity * 1800""")
def consistency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").alias("final_level_index"), F.col("l_quantity").alias("level_index"), F.col("l_extendedprice").alias("strength"), (F.col("l_quantity") * 1800).alias("limit"))
    return rules.check(rows, rules.gamma_rules(), ["l_orderkey", "l_linenumber", "l_partkey"])


@query("""WITH p AS (SELECT l_orderkey, count(*) AS n, max(round(l_discount * 1000)) AS top, bool_or(round(l_discount * 1000) = 100 AND l_returnflag = 'R') AS und, bool_or(round(l_discount * 1000) = 100 AND l_returnflag = 'A') AS que FROM lineitem GROUP BY 1),
    m AS (SELECT l_orderkey, CASE WHEN n > 1 AND top <> 100 THEN 'strongest intensity is not 100' WHEN und THEN 'strongest line is undivided' WHEN que THEN 'strongest line is questionable' END AS message FROM p)
    SELECT l_orderkey, 'R5' AS rule, message FROM m WHERE message IS NOT NULL""")
def intensity_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_discount") * 1000).alias("ri"), F.when(F.col("l_returnflag") == "R", "&").when(F.col("l_returnflag") == "A", "?").otherwise("").alias("flag"))
    return rules.intensity_rule(rows, ["l_orderkey"])


@query("""WITH j AS (SELECT p_partkey, 2 * (p_partkey % 4) AS a, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS pa, 2 * (p_size % 4) AS b, CASE WHEN p_size % 3 = 0 THEN '+' ELSE '-' END AS pb FROM part),
    l AS (SELECT p_partkey, pa = pb AS same, unnest(range(CAST(greatest(abs(a - b), 2) AS BIGINT), CAST(least(a + b, 10) + 1 AS BIGINT), 2)) // 2 AS k FROM j),
    t AS (SELECT p_partkey, string_agg(CASE WHEN same = (k % 2 = 0) THEN 'E' ELSE 'M' END || k, ' ' ORDER BY k) AS m FROM l GROUP BY 1) SELECT part.p_partkey, coalesce(m, '') AS multipolarities FROM part LEFT JOIN t USING (p_partkey)""")
def selection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    found = nuclear.multipolarities((2 * (k % 4)).cast("int"), F.when(k % 2 == 0, "+").otherwise("-"), (2 * (s % 4)).cast("int"), F.when(s % 3 == 0, "+").otherwise("-"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, " ").alias("multipolarities"))


@query("""SELECT p_partkey, round(6.582119569e-16 * 0.6931471805599453 / (p_retailprice / 1e6) * 1e12, 6) AS half_life_ps, round((2 * (p_size % 4) + 1.0::DOUBLE) / (2 * (p_partkey % 3) + 1), 6) AS factor FROM part""")
def width_to_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    life = nuclear.half_life_from_width(F.col("p_retailprice") / 1e6)
    return table(spark, sf_dir, "part").select("p_partkey", r6(life * 1e12).alias("half_life_ps"), r6(nuclear.spin_factor(2 * (F.col("p_size") % 4), 2 * (F.col("p_partkey") % 3))).alias("factor"))


@query("""WITH w AS (SELECT p_partkey, p_retailprice / 1e6 AS v, p_partkey % 6 AS k, (2 * (p_size % 4) + 1.0::DOUBLE) / (2 * (p_partkey % 3) + 1) AS g, (p_size % 11) / 10.0::DOUBLE AS br FROM part),
    t AS (SELECT p_partkey, k, CASE WHEN k >= 3 THEN v / g ELSE v END / CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN nullif(br, 0) ELSE nullif(br * br, 0) END AS width FROM w)
    SELECT p_partkey, round(6.582119569e-16 * 0.6931471805599453 / width * 1e12, 6) AS half_life_ps FROM t""")
def half_lives_of_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-lives from widths in all forms, squared branchings included."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("G", "G0", "G02/G", "gG", "gG0", "gG02/G"))), (k % 6 + 1).cast("int"))
    width = nuclear.total_width(F.col("p_retailprice") / 1e6, kind, nuclear.spin_factor(2 * (size % 4), 2 * (k % 3)).cast("double"), (size % 11) / 10.0)
    return table(spark, sf_dir, "part").select("p_partkey", r6(nuclear.half_life_from_width(width) * 1e12).alias("half_life_ps"))


@query("""SELECT key_1, key_2 FROM (SELECT a.c_custkey AS key_1, b.c_custkey AS key_2, CASE WHEN a.c_custkey % 3 > 0 THEN abs(a.c_acctbal - b.c_acctbal) / 25 END AS p, (b.c_custkey % 10) / 10.0 AS q FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) <= 25) WHERE p > 0.7 OR q > 0.7""")
def shown_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that either of two scores shows."""
    c = table(spark, sf_dir, "customer")
    side = lambda n: c.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias(f"key_{n}"), F.col("c_acctbal").alias(f"x{n}"))
    near = pairs.range_join(side(1), side(2), F.col("x1"), F.col("x2"), REACH, ["nation"]).where("key_1 < key_2")
    scored = near.withColumns({"p": F.when(F.col("key_1") % 3 > 0, F.abs(F.col("x1") - F.col("x2")) / 25), "q": (F.col("key_2") % 10) / 10.0})
    return pairs.any_above(scored, ["p", "q"], 0.7).select("key_1", "key_2")


@query("""WITH l AS (SELECT o_custkey % 50 AS nuclide, o_orderpriority AS dsid, o_orderkey AS line_no, 'order ' || o_orderkey AS line FROM orders),
    b AS (SELECT nuclide, dsid, line_no, line FROM l UNION ALL SELECT DISTINCT nuclide, dsid, NULL, '' FROM l)
    SELECT nuclide, CAST(row_number() OVER (PARTITION BY nuclide ORDER BY CASE WHEN dsid = '3-MEDIUM' THEN 0 ELSE 1 END, dsid, line_no NULLS LAST, line) - 1 AS BIGINT) AS place, line FROM b""")
def merged_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all datasets of a nuclide in one text, the adopted one first."""
    o = table(spark, sf_dir, "orders")
    lines = o.select((F.col("o_custkey") % 50).alias("nuclide"), F.col("o_orderpriority").alias("dsid"), F.col("o_orderkey").alias("line_no"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("line"))
    ranks = lines.select("nuclide", "dsid").distinct().withColumn("rank", F.when(F.col("dsid") == "3-MEDIUM", 0).otherwise(1))
    return reports.merged_lines(lines, ranks)


@query("""WITH s AS (SELECT s_suppkey AS dsid FROM supplier), t AS (SELECT DISTINCT l_suppkey + 3 AS dsid FROM lineitem)
    SELECT dsid, 'cross-reference names no dataset' AS message FROM t WHERE dsid NOT IN (SELECT dsid FROM s) UNION ALL SELECT dsid, 'dataset has no cross-reference tag' FROM s WHERE dsid NOT IN (SELECT dsid FROM t)""")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 3).alias("dsid")).distinct()
    return rules.cross_reference_rule(tags, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dsid")))


# --- further joins, aggregations and reports ----------------------------------------


@query("""SELECT DISTINCT l_suppkey % 97 AS level_group, l_orderkey % 1000 AS gamma_group FROM lineitem WHERE l_partkey % 97 > l_suppkey % 97""")
def feeding_gammas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 97).alias("initial_group"), (F.col("l_suppkey") % 97).alias("final_group"), (F.col("l_orderkey") % 1000).alias("gamma_group"))
    return pairs.feeding(rows)


@query("""WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
    SELECT c_custkey, coalesce(f.o_orderkey, -1) AS parent FROM customer LEFT JOIN f ON f.o_custkey = c_custkey AND f.n = 1""")
def parent_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return pairs.first_match(c, o, ["c_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).cast("long").alias("parent"))


@query("""WITH t AS (SELECT c_custkey AS tag, c_nationkey AS nation, CAST(round(abs(c_acctbal)) AS BIGINT) AS whole, abs(c_acctbal) AS v FROM customer), d AS (SELECT s_suppkey AS dataset, s_nationkey AS nation, CAST(round(abs(s_acctbal)) AS BIGINT) AS whole, abs(s_acctbal) AS v FROM supplier),
    firm AS (SELECT tag, min(dataset) AS dataset FROM t JOIN d USING (nation, whole) GROUP BY tag),
    loose AS (SELECT t.tag, count(*) AS n, min(d.dataset) AS dataset FROM t JOIN d ON t.nation = d.nation AND t.v > 0 AND d.v > 0 AND abs(ln(t.v) - ln(d.v)) <= ln(1.02::DOUBLE) WHERE t.tag NOT IN (SELECT tag FROM firm) GROUP BY t.tag)
    SELECT tag, dataset, 'exact' AS how FROM firm UNION ALL SELECT tag, dataset, 'fuzzy' FROM loose WHERE n = 1""")
def fuzzy_dataset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda p, key, name: table(spark, sf_dir, p).select(F.col(key).alias(name), F.col(f"{p[0]}_nationkey").alias("nation"), F.round(F.abs(f"{p[0]}_acctbal")).cast("long").alias("whole"), F.abs(f"{p[0]}_acctbal").alias("v"))
    return pairs.exact_then_fuzzy(side("customer", "c_custkey", "tag"), side("supplier", "s_suppkey", "dataset"), "whole", "v", ["nation"], 1.02)


@query("""SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)""")
def band_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return records.marked(table(spark, sf_dir, "part"), lines, ["p_partkey"]).select("p_partkey", "p_brand")


@query("""SELECT l_orderkey AS record, round(sum(abs(l_quantity - 25) / (s * s)) / sum(1 / (s * s)), 6) AS distance FROM (SELECT *, coalesce(nullif(l_tax * 10, 0), 0.2::DOUBLE * l_quantity) AS s FROM lineitem) GROUP BY 1""")
def group_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 10).alias("dx"), F.lit(25.0).alias("e"))
    return averages.distance_to_group(rows, ["record"]).select("record", r6(F.col("distance")).alias("distance"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT o_custkey, arg_min(o_orderkey, struct_pack(a := n, b := o_orderkey)) AS fewest, arg_max(o_orderkey, struct_pack(a := n, b := o_orderkey)) AS most, max(n) AS n_most FROM n GROUP BY 1""")
def gamma_count_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.extremes_by_count(lines, table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


@query("""WITH n AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, arg_max(l_returnflag, struct_pack(a := n, b := l_returnflag)) AS tag, max(n) AS uses FROM n GROUP BY 1""")
def most_common_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.most_common(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag")


@query("""SELECT s_nationkey AS z, count(*) AS n_datasets, arg_max(s_suppkey, struct_pack(a := s_acctbal, b := s_suppkey)) AS adopted, s_nationkey % 2 = 0 AND (2 * s_nationkey + 1) % 2 = 0 AS even_even FROM supplier GROUP BY 1""")
def nuclide_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.nuclides(table(spark, sf_dir, "supplier"), "s_nationkey", 2 * F.col("z") + 1, "s_suppkey", "s_acctbal")


@query("""SELECT s_suppkey, CASE WHEN lead(s_acctbal) OVER w - s_acctbal < 150 THEN -30 ELSE 0 END + CASE WHEN s_acctbal - lag(s_acctbal) OVER w < 150 THEN 30 ELSE 0 END AS bar_offset FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)""")
def bar_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    return groups.bar_offsets(rows, ["s_nationkey"]).select(F.col("id").alias("s_suppkey"), F.col("offset").alias("bar_offset"))


@query()
def label_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_suppkey").cast("string").alias("label_id"), F.col("s_acctbal").alias("y"))
    return groups.spread_labels(rows, "s_nationkey", 250.0).select("s_nationkey", "label_id", F.round("label_y", 3).alias("label_y"))


_Z = "[" + ", ".join(f"{z!r}::DOUBLE" for z, _ in nuclear.Z_TABLE) + "]"
_P = "[" + ", ".join(f"{p!r}::DOUBLE" for _, p in nuclear.Z_TABLE) + "]"


@query(f"""WITH t AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS z, p_partkey % 5 = 0 AND p_size % 2 = 0 AS veto FROM part), i AS (SELECT *, len(list_filter({_Z}, lambda v: v <= z)) AS k FROM t)
    SELECT p_partkey, veto, round(CASE WHEN veto THEN 0 ELSE {_P}[k] + (z - {_Z}[k]) * ({_P}[k + 1] - {_P}[k]) / ({_Z}[k + 1] - {_Z}[k]) END, 6) AS probability FROM i""")
def legacy_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-score table with vetoes by spin (size parity) and parity (key)."""
    veto = sim.legacy_veto(F.col("p_size") % 2, F.when(F.col("p_partkey") % 5 == 0, 1), F.lit(None).cast("string"), F.lit("+"))
    rows = table(spark, sf_dir, "part").select("p_partkey", veto.alias("veto"), (F.col("p_size") / 10.0).alias("z"))
    return rows.select("p_partkey", "veto", r6(nuclear.table_probability(F.col("z"), F.col("veto"))).alias("probability"))


@query("""WITH l AS (SELECT l_orderkey, l_returnflag = 'R' AS left_side, CAST(l_quantity % 5 * 2 AS INT) AS j, l_linenumber % 2 = 0 AS tj, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS p FROM lineitem),
    s AS (SELECT a.l_orderkey, bool_or(a.j = b.j AND a.p = b.p) AS overlap, bool_or(abs(a.j - b.j) <= 2) AS close FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.left_side AND NOT b.left_side GROUP BY 1),
    t AS (SELECT l_orderkey, coalesce(bool_or(tj) FILTER (left_side), false) AS tentative, count(*) FILTER (left_side) = 1 AS is_unique FROM l GROUP BY 1)
    SELECT t.l_orderkey, t.tentative, t.is_unique, coalesce(s.overlap, false) AS overlap, coalesce(s.close, false) AS close FROM t LEFT JOIN s USING (l_orderkey)""")
def jpi_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return order_options(spark, sf_dir).select("l_orderkey", sim.is_tentative(a).alias("tentative"), (F.size(a) == 1).alias("is_unique"), sim.options_overlap(a, b).alias("overlap"), sim.options_close(a, b, 1).alias("close"))


@query("""WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN chr(CAST(65 + s_suppkey % 26 AS INT)) ELSE CAST(s_suppkey % 10 AS VARCHAR) END AS tag FROM supplier)
    SELECT s_suppkey, tag, row_number() OVER (ORDER BY CASE WHEN regexp_matches(tag, '^[0-9]') THEN '0' ELSE '1' END || tag, s_suppkey) AS place FROM t""")
def tag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    tags = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 2 == 0, F.char((65 + k % 26).cast("int"))).otherwise((k % 10).cast("string")).alias("tag"))
    # There are few distinct tags: their places are summed counts, not a sort of all rows.
    counts = tags.groupBy("tag").agg(F.count("*").alias("n")).withColumn("key", text.tag_order(F.col("tag")))
    before = counts.select("tag", F.coalesce(F.sum("n").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("tag").orderBy("s_suppkey"))
    return tags.withColumn("k", inside).join(before, "tag").select("s_suppkey", "tag", (F.col("before") + F.col("k")).cast("long").alias("place"))


@query("""WITH a AS (SELECT l_orderkey, max(l_extendedprice) FILTER (l_linenumber = 2) AS four, max(l_extendedprice) FILTER (l_linenumber = 1) AS two FROM lineitem GROUP BY 1) SELECT l_orderkey, round(four / two, 6) AS ratio FROM a WHERE four IS NOT NULL AND two > 0""")
def be2_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.ratio_of_places(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice", over=2, under=1)
    return found.select("l_orderkey", r6(F.col("ratio")).alias("ratio"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT a, b FROM e UNION SELECT b, a FROM e""")
def valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return pairs.valid_both_ways(edges, "a", "b")


@query("""WITH s AS (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS x, list_distinct(list(l_partkey % 100)) AS y FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(len(list_intersect(x, y)) AS BIGINT) AS shared, len(list_intersect(x, y)) = 0 AS disjoint FROM s""")
def dataset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("x"), F.collect_set(F.col("l_partkey") % 100).alias("y"))
    return sets.select("l_orderkey", records.shared(F.col("x"), F.col("y")).alias("shared"), records.disjoint(F.col("x"), F.col("y")).alias("disjoint"))


@query(r"""WITH a AS (SELECT DISTINCT trim(regexp_replace(lower(text), '[ \t\n]+', ' ', 'g')) AS k FROM conversations WHERE role = 'user') SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND trim(regexp_replace(lower(text), '[ \t\n]+', ' ', 'g')) NOT IN (SELECT k FROM a)""")
def comment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return records.without_known_texts(rows.where("role = 'assistant'"), rows.where("role = 'user'"), "text").select("conv_id", "turn")


@query("""WITH t AS (SELECT p_partkey, 2 * (p_partkey % 4) AS a, p_size % 6 AS b, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS p, p_size % 5 AS l FROM part)
    SELECT p_partkey, (SELECT string_agg(CAST(x AS VARCHAR), ' ' ORDER BY x) FROM unnest(generate_series(CAST(abs(a - b) AS BIGINT), CAST(a + b AS BIGINT), 2)) u(x)) AS spins, CASE WHEN l % 2 = 1 THEN CASE WHEN p = '+' THEN '-' ELSE '+' END ELSE p END AS parity FROM t""")
def l_transfer_spins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    spins = nuclear.coupled_spins((2 * (k % 4)).cast("int"), (s % 6).cast("int"))
    parity = nuclear.transferred_parity(F.when(k % 2 == 0, "+").otherwise("-"), s % 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(spins.cast("array<string>"), " ").alias("spins"), parity.alias("parity"))


@query("""SELECT p_partkey, round(0.0001::DOUBLE * pow(p_size, 4) - 0.0199::DOUBLE * pow(p_size, 3) + 1.4884::DOUBLE * p_size * p_size - 33.671::DOUBLE * p_size + 371.11::DOUBLE, 5) AS m1,
    round(4e-05::DOUBLE * pow(p_size, 4) - 0.0073::DOUBLE * pow(p_size, 3) + 0.441::DOUBLE * p_size * p_size - 4.2227::DOUBLE * p_size + 196.33::DOUBLE, 5) AS e2 FROM part""")
def conversion_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(nuclear.icc_energy(F.col("p_size"), "M1", 0.005), 5).alias("m1"), F.round(nuclear.icc_energy(F.col("p_size"), "E2", 0.01), 5).alias("e2"))


@query("""WITH b AS (SELECT l_suppkey AS band, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS dj FROM lineitem)
    SELECT band, count(DISTINCT dj) AS n_steps FROM b WHERE dj IS NOT NULL GROUP BY 1 HAVING count(DISTINCT dj) > 1""")
def band_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("band"), F.col("l_extendedprice").alias("energy"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("level_id"), F.col("l_linenumber").alias("two_j"))
    return rules.band_rule(rows)


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'R' AS q, l_quantity AS v, CASE WHEN l_tax > 0.02 THEN l_quantity + 1 END AS a FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q AND a IS NOT NULL THEN a ELSE v END AS v FROM q""")
def patch_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").alias("is_quoted"), F.col("l_quantity").alias("v"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity") + 1).alias("adopted_v"))
    return rules.patch_with_adopted(rows, ["v"]).select("l_orderkey", "l_linenumber", "l_partkey", "v")


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '2021Wa16,2020XY01' WHEN 1 THEN '2012WA38' ELSE '' END AS q, CASE WHEN p_partkey % 2 = 0 THEN 'CA' ELSE '12' END AS dq, CASE WHEN p_partkey % 7 = 0 THEN '34P B+ DECAY' ELSE '34P B- DECAY' END AS dsid, p_partkey % 4 AS dj, p_size % 2 = 0 AS pc FROM part)
    SELECT p_partkey, 'R3' AS rule, 'stale Q-value reference ' || q AS message FROM t WHERE q = '2012WA38' AND dq <> 'CA' UNION ALL SELECT p_partkey, 'R10', 'B+ DECAY should be EC DECAY or EC+B+ DECAY' FROM t WHERE contains(dsid, ' B+ DECAY')
    UNION ALL SELECT p_partkey, 'R22', 'decay branch is less likely' FROM t WHERE dj > 2 OR dj = 2 AND NOT pc""")
def level_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 3 == 0, "2021Wa16,2020XY01").when(k % 3 == 1, "2012WA38").otherwise("").alias("q_reference"), F.when(k % 2 == 0, "CA").otherwise("12").alias("q_uncertainties"),
        F.when(k % 7 == 0, "34P B+ DECAY").otherwise("34P B- DECAY").alias("dsid"), (k % 4).alias("dj"), (s % 2 == 0).alias("parity_change"),
    )
    return rules.check(rows, rules.level_rules(), ["p_partkey"])


def _expressions(columns: str) -> list[str]:
    return re.split(r",\s+", columns)


_LEVEL_COLUMNS = """p_partkey, CASE p_partkey % 3 WHEN 0 THEN '2021WA16' WHEN 1 THEN '2012WA38' ELSE 'CA' END AS q_reference, CASE WHEN p_size % 2 = 0 THEN 'CA' ELSE '12' END AS q_uncertainties,
    CASE p_partkey % 3 WHEN 0 THEN 'M1' WHEN 1 THEN 'E2' END AS moment, CASE p_partkey % 4 WHEN 0 THEN '2014StZZ' WHEN 1 THEN '2016StZV' WHEN 2 THEN '2019StZV,2021StZZ' END AS moment_reference, CASE WHEN p_size % 4 = 0 THEN 'see 2020StZV' END AS moment_comment,
    CASE WHEN p_partkey % 2 = 0 THEN 'B-' END AS decay_type, CASE WHEN p_partkey % 3 = 0 THEN 1.0D END AS nb, CASE WHEN p_partkey % 5 = 0 THEN 0.5D ELSE 1.0D END AS br, CASE WHEN p_partkey % 7 = 0 THEN '34P B+ DECAY' ELSE '34P B- DECAY' END AS dsid,
    p_size - 1.0D AS energy, CAST(p_size - 1 AS STRING) AS energy_text, p_size - 1 + p_partkey % 5 * 0.3D AS adopted_energy, p_partkey % 3 = 1 AS is_quoted,
    CASE WHEN p_partkey % 2 = 0 THEN '2+' ELSE '3-' END AS jpi_text, CASE WHEN p_size % 2 = 0 THEN '2+' ELSE '3-' END AS adopted_jpi, p_partkey % 5 = 2 AS is_decay,
    CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '5 NS' ELSE '7 PS' END AS t12_text, CASE WHEN p_partkey % 4 = 0 THEN '5 NS' ELSE CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '5 NS' ELSE '7 PS' END END AS adopted_t12,
    p_partkey % 9 = 0 AS is_isomer, CASE WHEN p_partkey % 8 = 2 THEN 1e-6D ELSE 1e-12D END AS t12_seconds, p_size / 5.0D AS hf, CASE WHEN p_partkey % 4 <> 1 THEN 0.3D END AS hf_unc, CASE WHEN p_size % 5 = 1 THEN 'LT' END AS hf_limit, p_partkey % 7 + 17.0D AS alpha, 1.1D AS alpha_unc, p_partkey % 5 = 1 AS to_ground, p_partkey % 2 = 1 AS odd_mass, p_partkey % 3 = 0 AS same_jpi, p_partkey % 5 <> 0 AS natural_parity,
    p_size / 5.0D AS log_ft, CASE WHEN p_partkey % 4 <> 1 THEN 0.3D END AS log_ft_unc, CASE p_size % 5 WHEN 0 THEN 'GT' WHEN 1 THEN 'LT' ELSE '' END AS log_ft_limit, p_partkey % 4 AS dj, p_size % 2 = 0 AS parity_change, CASE WHEN p_partkey % 3 = 0 THEN '1U' END AS unique, p_partkey % 5 = 0 AS zero_to_zero"""
_WIDTH = "coalesce(log_ft_unc, 0.2::DOUBLE * log_ft)"
_ALLOWED = f"((log_ft > 3.6 AND log_ft + {_WIDTH} < 5.9) OR (log_ft < 5.9 AND log_ft_limit = 'LT'))"
_HIGH = f"(log_ft - {_WIDTH} >= 8.5 OR (log_ft >= 8.5 AND log_ft_limit = 'GT'))"
_UNIQUE = "(coalesce(\"unique\", '') = '1U')"
_LEVEL_TOLD = {
    "R3": [("q_reference <> '2021WA16' AND q_uncertainties <> 'CA'", "'stale Q-value reference ' || q_reference")],
    "R8": [("moment = 'M1' AND coalesce(moment_reference, '') <> '2019StZV,2021StZZ' AND moment_comment IS NULL", "'reference of the M1 moment is not current'"), ("moment = 'E2' AND coalesce(moment_reference, '') <> '2019StZV,2021StZZ'", "'reference of the E2 moment is not current'")],
    "R9": [("decay_type IS NOT NULL AND nb IS NULL AND br < 1", "'NB is empty although BR is below 1'")],
    "R10": [("contains(dsid, ' B+ DECAY')", "'B+ DECAY should be EC DECAY or EC+B+ DECAY'")],
    "R13": [("is_quoted AND adopted_energy <> energy AND CAST(CAST(round(adopted_energy) AS BIGINT) AS VARCHAR) <> energy_text", "'energy quoted from Adopted differs'")],
    "R14": [("is_quoted AND jpi_text <> adopted_jpi", "'spin-parity quoted from Adopted differs'")],
    "R14 options": [("NOT is_quoted AND is_decay AND jpi_text <> adopted_jpi", "'spin-parity differs from Adopted'"), ("NOT is_quoted AND jpi_text = '3-' AND CAST(energy AS BIGINT) % 3 = 0", "'spin-parity contradicts Adopted'")],
    "R15": [("energy = 0 AND t12_text = ''", "'ground state has no half-life'"), ("t12_text <> adopted_t12", "'half-life differs from Adopted'"), ("t12_seconds >= 1e-7 AND NOT is_isomer", "'half-life of an isomer without its flag'")],
    "R21": [("odd_mass AND (hf + coalesce(hf_unc, 0.2::DOUBLE * hf) < 4 OR hf < 4 AND hf_limit = 'LT') AND NOT same_jpi", "'hindrance factor below 4 needs equal spin and parity'"), ("NOT odd_mass AND NOT natural_parity", "'alpha decay of an even nucleus goes to natural parity only'")],
    "R21 spread": [("to_ground AND (abs(hf_unc / hf / (alpha_unc / alpha) - 1) > 0.2 OR abs(hf_unc / hf / (alpha_unc / alpha) - 1) > 0.1 AND hf_unc / hf > 0.1)", "'relative uncertainties of hindrance factor and branching differ'")],
    "R22": [("dj > 2 OR dj = 2 AND NOT parity_change", "'decay branch is less likely'")],
    "R22 fit": [
        (f"({_ALLOWED} AND parity_change AND dj > 1) OR (NOT {_ALLOWED} AND {_UNIQUE} AND {_HIGH} AND NOT parity_change AND dj > 2)", "'log ft does not fit the parity and spin change'"),
        (f"({_ALLOWED} AND parity_change) OR (NOT {_ALLOWED} AND {_UNIQUE} AND {_HIGH} AND NOT parity_change)", "'log ft does not fit the parity change'"),
        (f"({_ALLOWED} AND dj > 1) OR (NOT {_ALLOWED} AND {_UNIQUE} AND {_HIGH} AND dj > 2)", "'log ft does not fit the spin change'"),
    ],
    "R22 flag": [(f"{_HIGH} AND dj = 2 AND parity_change AND NOT {_UNIQUE}", "'flag 1U is missing'")],
    "R22 window": [(f"zero_to_zero AND log_ft > 3.6 AND log_ft + {_WIDTH} < 6.4", "'log ft between 3.6 and 6.4 for 0+ to 0+'")],
}
_GAMMA_COLUMNS = """l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 5 <> 0 THEN l_linenumber END AS final_level_index, l_quantity AS level_index, CASE WHEN l_partkey % 11 = 0 THEN 'E0' WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN 'M1+E2' ELSE 'E3' END AS mult,
    CASE l_partkey % 4 WHEN 0 THEN 'E2+M1' WHEN 1 THEN 'E3' WHEN 2 THEN '[E2]' ELSE 'M1,E2' END AS adopted_mult, l_partkey % 3 = 0 AS mult_quoted, CASE WHEN l_partkey % 2 = 0 THEN '0.5 2' ELSE '' END AS mixing, CASE WHEN l_linenumber % 2 = 0 THEN '0.5 2' ELSE '-0.3 1' END AS adopted_mixing, l_partkey % 5 = 0 AS mixing_quoted,
    CASE WHEN l_linenumber % 2 = 0 THEN 'BE0=3' ELSE '' END AS computed_text, l_linenumber % 4 AS two_ji, l_partkey % 2 AS two_jf, CASE WHEN l_partkey % 7 <> 0 THEN l_suppkey % 2 = 0 END AS parity_change,
    CASE WHEN l_linenumber % 2 = 0 THEN 0.1D END AS icc, l_partkey % 3 = 1 AS is_absolute, 10 * l_linenumber AS z, l_partkey % 4 AS dj, l_suppkey % 3 = 0 AS questionable,
    l_extendedprice AS strength, l_quantity * 1800 AS "limit", CAST(l_quantity AS DOUBLE) AS energy, CAST(l_quantity + l_linenumber AS DOUBLE) AS adopted_energy, CAST(l_linenumber % 3 AS DOUBLE) AS unc, 2.0D AS adopted_unc,
    CAST(CAST(l_quantity AS BIGINT) AS STRING) AS energy_text, l_partkey % 6 = 5 AS energy_quoted, l_suppkey % 5 = 0 AS mult_said, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END AS adopted_gamma"""
_polynomial = lambda k: " + ".join(f"{x!r}::DOUBLE * pow(z, {4 - i})" for i, x in enumerate(nuclear.ICC_LIMITS[k, 0.01]))
_ICC_SQL = "CASE " + " ".join(f"WHEN {when} THEN {_polynomial(k)}" for when, k in (("parity_change AND dj >= 2", "M2"), ("parity_change", "E1"), ("NOT parity_change AND dj >= 2", "E2"), ("NOT parity_change", "M1"))) + " END"
_GAMMA_TOLD = {
    "R13": [("energy_quoted AND adopted_energy <> energy", "'energy quoted from Adopted differs'")],
    "R18 lacking": [("mult_said AND adopted_gamma IS NULL AND mult <> ''", "'multipolarity quoted from Adopted, which has no such gamma'")],
    "R17": [("final_level_index IS NULL", "'gamma has no final level'"), ("final_level_index >= level_index", "'final level is not below the initial one'")],
    "R18": [("mult = 'E3' OR mult = 'E0' OR mult = 'M1+E2'", "'multipolarity does not fit the spins'")],
    "R18 adopted": [("mult_quoted AND mult = '' AND adopted_mult <> '[E2]'", "'multipolarity quoted from Adopted is not given'"), ("mult_quoted AND adopted_mult <> '[E2]' AND mult <> adopted_mult AND NOT (mult = 'M1+E2' AND adopted_mult = 'E2+M1')", "'multipolarity quoted from Adopted differs'")],
    "R18 mixing": [("mixing_quoted AND mixing <> adopted_mixing", "'mixing ratio quoted from Adopted differs'")],
    "R18 E0": [("mult = 'E0' AND computed_text = 'BE0=3'", "'B(E0) should be from experiment'")],
    "R18 zero": [("two_ji = 0 AND two_jf = 0 AND parity_change", "'0 to 0 with a change of parity is not allowed'"), ("two_ji = 0 AND two_jf = 0 AND NOT parity_change", "'0 to 0 is an E0 transition'")],
    "R18 icc": [(f"is_absolute AND icc IS NULL AND energy < ({_ICC_SQL}) / CASE WHEN questionable THEN 2 ELSE 1 END", "'conversion may not be negligible'")],
    "R20": [("strength > \"limit\"", "'transition strength is above the recommended upper limit'")],
    "R24": [("abs(energy - adopted_energy) >= greatest(2.0::DOUBLE, 1.5::DOUBLE * sqrt(unc * unc + adopted_unc * adopted_unc))", "'energy differs from the adopted gamma'")],
}


def _told_sql(columns: str, source: str, key: str, told: dict[str, list[tuple[str, str]]]) -> str:
    """One SELECT a rule; the first case that holds gives the message."""
    cases = lambda some: "CASE " + " ".join(f"WHEN {c} THEN {m}" for c, m in some) + " END"
    parts = " UNION ALL ".join(f"SELECT {key}, '{rule.split()[0]}' AS rule, {cases(some)} AS message FROM t" for rule, some in told.items())
    # Suffixed literals are Spark's; the alias is a reserved word in DuckDB.
    plain = re.sub(r"(\d)D\b", r"\1::DOUBLE", columns).replace("AS unique", 'AS "unique"').replace("AS STRING", "AS VARCHAR")
    return f"WITH t AS (SELECT {plain} FROM {source}) SELECT * FROM ({parts}) WHERE message IS NOT NULL"


def rule_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels with the columns of all level rules."""
    rows = table(spark, sf_dir, "part").selectExpr(*_expressions(_LEVEL_COLUMNS))
    both, place = F.array(F.lit("2+"), F.lit("3-")), F.col("energy").cast("long") % 3
    known = F.when(place == 2, both).when(place == 0, F.array(F.lit("2+"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"jpi_options": F.array("jpi_text"), "adopted_options": known})


@query(_told_sql(_LEVEL_COLUMNS, "part", "p_partkey", _LEVEL_TOLD))
def every_level_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels with the columns of all level rules."""
    rows = rule_levels(spark, sf_dir)
    return rules.check(rows, rules.level_rules(), ["p_partkey"])


@query(_told_sql(_GAMMA_COLUMNS, "lineitem", "l_orderkey, l_linenumber, l_partkey", _GAMMA_TOLD))
def every_gamma_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gammas with the columns of all gamma rules."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_expressions(_GAMMA_COLUMNS.replace('"', "`")))
    even, odd = F.array(F.lit("E2"), F.lit("E4")), F.array(F.lit("E1"), F.lit("M2"))
    rows = rows.withColumn("expected_mult", F.when(F.col("level_index") % 2 == 0, even).otherwise(odd))
    return rules.check(rows, rules.gamma_rules(), ["l_orderkey", "l_linenumber", "l_partkey"])


@query("""WITH t(k, mult, a, b) AS (VALUES (0, '(M1+E2)', ['M1', 'E2'], []), (1, '[E2]', ['E2'], []), (2, 'M1(+E2)', ['M1', 'E2'], []), (3, 'E1,M2', ['E1', 'M2'], []), (4, 'D+Q', [], [1, 2]), (5, 'E2 ', ['E2'], []), (6, 'E1+E2', ['E1', 'E2'], []), (7, '(O)', [], [3]), (8, '', [], [])),
    x(j, expected, orders) AS (VALUES (0, ['M1', 'E2'], [1, 2]), (1, ['E1', 'M2'], [1, 2]), (2, ['E2', 'M3'], [2, 3]), (3, []::VARCHAR[], []))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'R18' AS rule FROM lineitem JOIN t ON t.k = l_partkey % 9 JOIN x ON x.j = l_suppkey % 4
    WHERE len(expected) > 0 AND (len(list_filter(a, lambda m: NOT list_contains(expected, m))) > 0 OR len(list_filter(b, lambda m: NOT list_contains(orders, m))) > 0)""")
def multipolarity_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipolarities in all notations against those that the spins allow."""
    names = F.array(*map(F.lit, ("(M1+E2)", "[E2]", "M1(+E2)", "E1,M2", "D+Q", "E2 ", "E1+E2", "(O)", "")))
    some = lambda *m: F.array(*map(F.lit, m)).cast("array<string>")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(*keys, F.element_at(names, (F.col("l_partkey") % 9 + 1).cast("int")).alias("mult"), F.element_at(F.array(some("M1", "E2"), some("E1", "M2"), some("E2", "M3"), some()), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("expected_mult"))
    return rules.check(rows, rules.gamma_rules(), keys).select(*keys, "rule")


@query("""WITH g AS (SELECT c_custkey, c_nationkey, c_acctbal AS x, c_custkey % 4 = 1 AS q FROM customer WHERE c_custkey % 3 <> 0),
    n AS (SELECT c_custkey, count(s_suppkey) AS n_similar, any_value(q) AS q FROM g LEFT JOIN supplier ON s_nationkey = c_nationkey AND abs(x - s_acctbal) <= 5 GROUP BY 1)
    SELECT c_custkey, 'R17' AS rule, CASE WHEN n_similar > 0 THEN 'similar gammas are placed elsewhere in Adopted' ELSE 'no such gamma in Adopted' END AS message, n_similar FROM n WHERE n_similar > 0 OR NOT q""")
def gamma_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    gammas = table(spark, sf_dir, "customer").select(k, F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("energy"), F.when(k % 3 == 0, k).alias("adopted_gamma"), (k % 4 == 1).alias("questionable"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("energy"))
    return rules.placement_rule(gammas, known, ["nation"], "c_custkey")


@query("""SELECT count(*) FILTER (length(p_name) >= 8 AND trim(p_type) <> '') AS n_records, count(*) FILTER (NOT contains(p_type, 'BRASS')) AS n_no_theory, count(*) FILTER (p_size > 25 AND p_retailprice >= 1000) AS n_strong FROM part""")
def record_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.count_if, F.col
    return table(spark, sf_dir, "part").agg(n(records.is_record(c("p_name"), c("p_type"))).alias("n_records"), n(~records.is_theory(c("p_type"), "BRASS")).alias("n_no_theory"), n(records.is_strong(c("p_size"), c("p_retailprice"), 25, 1000)).alias("n_strong"))


@query("""WITH m AS (SELECT CAST(s_nationkey AS INT) AS cluster_no, CAST(s_suppkey % 3 AS VARCHAR) AS ds, CAST(s_suppkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal), s_suppkey) = 1 AS anchor, s_suppkey % 8 / 8.0::DOUBLE AS p FROM supplier),
    e AS (SELECT cluster_no, ds, CASE WHEN anchor THEN '  ' || id || ' (anchor)' ELSE printf('  %s probability %.1f%%', id, p * 100) END AS t FROM m)
    SELECT cluster_no, printf('Cluster %d:', cluster_no) || chr(10) || string_agg(t, chr(10) ORDER BY ds, t) AS text FROM e GROUP BY 1""")
def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    first = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.abs("s_acctbal"), "s_suppkey")) == 1
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("cluster_no"), (k % 3).cast("string").alias("dataset_code"), k.cast("string").alias("level_id"), first.alias("is_anchor"), (k % 8 / 8.0).alias("match_probability"))
    return reports.cluster_report(members)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_tax = 0 THEN round(l_quantity * 1.37::DOUBLE) ELSE l_quantity END AS BIGINT) AS shown, round(l_quantity * 1.37::DOUBLE) = l_quantity AS same FROM lineitem""")
def printed_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact, shown = F.round(F.col("l_quantity") * 1.37), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_tax") == 0, exact).otherwise(shown).cast("long").alias("shown"), (text.rounded_like(shown * 1.37, shown.cast("long").cast("string")) == shown.cast("long").cast("string")).alias("same"))


# --- against adopted records -----------------------------------------------------------


@query("""WITH l AS (SELECT c_custkey AS level, c_nationkey AS nation, c_custkey % 3 AS dsid, c_acctbal AS x FROM customer), a AS (SELECT s_suppkey AS adopted, s_nationkey AS nation, s_acctbal AS y, s_suppkey % 3 AS listed_ds FROM supplier),
    n AS (SELECT level, adopted, listed_ds = dsid AS listed, abs(x - y) AS d, row_number() OVER (PARTITION BY level ORDER BY listed_ds = dsid DESC, abs(x - y), adopted) AS place, count(*) OVER (PARTITION BY level) AS n FROM l JOIN a USING (nation) WHERE abs(x - y) <= 200)
    SELECT l.level, coalesce(n.adopted, -1) AS adopted, round(n.d, 6) AS distance, CASE WHEN n.adopted IS NULL THEN 'none' WHEN n.d > 100 THEN 'discrepant' WHEN n.n = 1 THEN 'single' ELSE 'chosen' END AS status FROM l LEFT JOIN n ON n.level = l.level AND n.place = 1""")
def adopted_level_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("level"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 3).alias("dsid"), F.col("c_acctbal").alias("x"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("adopted"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("y"), F.array(F.col("s_suppkey") % 3).alias("xref"))
    return adopted.match_adopted(levels, known, ["nation"], 200.0, 100.0).select("level", F.coalesce("adopted", F.lit(-1)).cast("long").alias("adopted"), r6(F.col("distance")).alias("distance"), "status")


@query("""WITH t AS (SELECT p_partkey, 2 * (p_partkey % 4) AS jt, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS pt, p_size % 6 AS j, p_size % 5 AS l, p_partkey % 9 AS ja, CASE WHEN p_size % 3 = 0 THEN '+' ELSE '-' END AS pa FROM part),
    c AS (SELECT p_partkey, CASE WHEN NOT (ja BETWEEN abs(jt - j) AND jt + j AND (ja - abs(jt - j)) % 2 = 0) THEN 'adopted spin is outside the range of the transfer' WHEN (CASE WHEN l % 2 = 1 THEN CASE WHEN pt = '+' THEN '-' ELSE '+' END ELSE pt END) <> pa THEN 'adopted parity does not fit the transfer' END AS message FROM t)
    SELECT * FROM c WHERE message IS NOT NULL""")
def l_transfer_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    told = adopted.l_transfer_conflict((2 * (k % 4)).cast("int"), F.when(k % 2 == 0, "+").otherwise("-"), (s % 6).cast("int"), s % 5, (k % 9).cast("int"), F.when(s % 3 == 0, "+").otherwise("-"))
    return table(spark, sf_dir, "part").select("p_partkey", told.alias("message")).where("message IS NOT NULL")


@query("""WITH p AS (SELECT o_orderkey AS dataset, o_totalprice % 100 AS e, c_acctbal % 100 AS a, o_orderstatus AS j, c_custkey % 3 AS m, o_orderkey % 50 + 1 AS t, c_custkey % 50 + 1 AS ta FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT dataset, 'parent energy differs' AS message FROM p WHERE abs(e - a) > 50 UNION ALL SELECT dataset, 'parent spin-parity differs' FROM p WHERE j <> CASE m WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END UNION ALL SELECT dataset, 'parent half-life differs' FROM p WHERE abs(t - ta) > 0.5 * ta""")
def parent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("c_custkey") % 3
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.select(F.col("o_orderkey").alias("dataset"), (F.col("o_totalprice") % 100).alias("energy"), (F.col("c_acctbal") % 100).alias("adopted_energy"), F.col("o_orderstatus").alias("jpi"), F.when(m == 0, "O").when(m == 1, "F").otherwise("P").alias("adopted_jpi"), (F.col("o_orderkey") % 50 + 1).alias("t12"), (F.col("c_custkey") % 50 + 1).alias("adopted_t12"))
    return adopted.parent_conflict(rows, 50.0)


@query("""WITH p AS (SELECT o_orderkey AS dataset, ['EC', 'B+', 'EC+B+', 'A'][o_orderkey % 4 + 1] AS mode, o_orderkey % 10 * 10 AS br, CASE WHEN c_custkey % 7 <> 0 THEN ['EC', 'B+', 'EC+B+', 'EC+%B+', 'A'][c_custkey % 5 + 1] END AS name, c_custkey % 10 * 10 AS pc, o_orderkey % 3 AS q, c_custkey % 3 AS qa FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
    f AS (SELECT *, coalesce(name = mode OR (mode <> 'A' AND name IN ('EC+%B+', 'EC+B+')) OR (mode = 'EC+B+' AND name <> 'A'), false) AS fits FROM p)
    SELECT dataset, 'decay mode is missing in Adopted' AS message FROM f WHERE NOT fits UNION ALL SELECT dataset, 'decay mode is named differently in Adopted' FROM f WHERE fits AND name <> mode AND name <> 'EC+%B+'
    UNION ALL SELECT dataset, 'branching differs from Adopted' FROM f WHERE fits AND br <> pc UNION ALL SELECT dataset, 'parent Q-value differs' FROM f WHERE q <> qa""")
def parent_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("c_custkey")
    of = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    levels = table(spark, sf_dir, "customer")
    joined = table(spark, sf_dir, "orders").join(levels.select("c_custkey"), F.col("o_custkey") == n, "left")
    parents = joined.select(k.alias("dataset"), F.col("o_custkey").alias("level"), of(["EC", "B+", "EC+B+", "A"], k % 4).alias("mode"), (k % 10 / 10).alias("br"), (k % 3).alias("q"), (n % 3).alias("adopted_q"))
    modes = levels.where(n % 7 != 0).select(n.alias("level"), of(["EC", "B+", "EC+B+", "EC+%B+", "A"], n % 5).alias("mode"), (n % 10 * 10).alias("percent"))
    return adopted.branch_conflict(parents, modes)


@query("""WITH c AS (SELECT l_suppkey AS record, l_partkey AS candidate, max(l_tax) < 0.05 AS e, max(l_discount) < 0.05 AS j, count(*) AS m, min(l_returnflag) = 'A' AS f, min(l_quantity) AS d FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY e DESC, j DESC, m DESC, f DESC, d, candidate) AS n, count(*) OVER (PARTITION BY record) AS total FROM c) SELECT record, candidate AS best, total AS n FROM r WHERE r.n = 1""")
def better_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("record"), F.col("l_partkey").alias("candidate")).agg((F.max("l_tax") < 0.05).alias("energy_ok"), (F.max("l_discount") < 0.05).alias("jpi_ok"), F.count("*").alias("n_matched"), (F.min("l_returnflag") == "A").alias("firm"), F.min("l_quantity").alias("distance"))
    return adopted.better_match(c, ["record"])


@query("""WITH m AS (SELECT l_orderkey, CASE WHEN l_linenumber % 4 = 3 THEN [] WHEN l_quantity > 25 THEN ['1+', '2+'] ELSE ['2+', '3-'] END AS o FROM lineitem), s AS (SELECT * FROM m WHERE len(o) > 0),
    t AS (SELECT l_orderkey, count(*) AS members FROM s GROUP BY 1), e AS (SELECT l_orderkey, x, count(*) AS n FROM (SELECT l_orderkey, unnest(o) AS x FROM s) GROUP BY 1, 2)
    SELECT t.l_orderkey, t.members, (SELECT string_agg(x, ' ' ORDER BY x) FROM e WHERE e.l_orderkey = t.l_orderkey AND e.n = t.members) AS common FROM t""")
def jpi_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    options = F.when(F.col("l_linenumber") % 4 == 3, none).when(F.col("l_quantity") > 25, F.array(F.lit("1+"), F.lit("2+"))).otherwise(F.array(F.lit("2+"), F.lit("3-")))
    return adopted.common_options(table(spark, sf_dir, "lineitem").select("l_orderkey", options.alias("options")), ["l_orderkey"])


@query()
def fine_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("dsid"), F.col("c_custkey").alias("record"), F.col("c_acctbal").alias("x"))
    islands = groups.gap_islands(rows, ["nation"], F.col("x"), 20.0, tie=["record"])
    return adopted.fine_groups(islands, ["nation", "island"], 20.0)


@query("""SELECT s_suppkey AS block, s_name AS body FROM supplier WHERE s_suppkey % 4 <> 1 UNION ALL SELECT s_suppkey, 'new ' || s_name FROM supplier WHERE s_suppkey % 4 = 1""")
def replaced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("block"), F.col("s_name").alias("body"))
    return reports.replace_blocks(old, old.where("block % 4 = 1").withColumn("body", F.concat(F.lit("new "), "body")), "block")


@query("""WITH v AS (SELECT p_partkey, p_retailprice AS x, p_size / 7.0::DOUBLE AS dx, CAST(greatest(0, least(6, floor(log10(35.0::DOUBLE / (p_size / 7.0::DOUBLE))))) AS INT) AS d FROM part),
    s AS (SELECT *, CAST(round(x * pow(10.0::DOUBLE, d)) AS BIGINT) AS n, CAST(pow(10, d) AS BIGINT) AS u FROM v)
    SELECT p_partkey, CAST(n // u AS VARCHAR) || CASE WHEN d > 0 THEN '.' || lpad(CAST(n % u AS VARCHAR), d, '0') ELSE '' END || '(' || CAST(CAST(round(dx * pow(10.0::DOUBLE, d)) AS BIGINT) AS VARCHAR) || ')' AS shown FROM s""")
def value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.value_text(F.col("p_retailprice"), F.col("p_size") / 7.0).alias("shown"))


@query("""SELECT s_suppkey, rtrim(rpad(CAST(CAST(abs(round(s_acctbal)) AS BIGINT) AS VARCHAR), 10, ' ') || rpad(CAST(s_suppkey % 9 + 1 AS VARCHAR), 2, ' ') || ' ' || rpad(CASE WHEN s_suppkey % 2 = 0 THEN '(1,2)+' ELSE '' END, 18, ' ')) AS line FROM supplier""")
def level_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.abs(F.round("s_acctbal")).cast("long").cast("string").alias("energy_text"), (k % 9 + 1).cast("string").alias("uncertainty_text"), F.when(k % 2 == 0, "(1,2)+").otherwise("").alias("spin_parity_text"))
    return reports.level_lines(rows).select("s_suppkey", "line")


@query("""WITH v AS (SELECT p_partkey, p_size + 0.5::DOUBLE AS a, (p_partkey % 9 + 1) / 10.0::DOUBLE AS da, p_size * 2::DOUBLE AS b, p_partkey % 4 + 1::DOUBLE AS db FROM part)
    SELECT p_partkey, CAST(2 AS BIGINT) AS n, round((a / (da * da) + b / (db * db)) / (1 / (da * da) + 1 / (db * db)), 5) AS average FROM v""")
def comment_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values listed in a comment, averaged in place (no shuffle)."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    body = F.concat(F.lit("T="), size, F.lit(".5("), (k % 9 + 1).cast("string"), F.lit(") (1973Pa02), "), (F.col("p_size") * 2).cast("string"), F.lit(" ("), (k % 4 + 1).cast("string"), F.lit("); see text."))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.comment_values(body, "T").alias("v"))
    return rows.select("p_partkey", F.size(F.filter("v", lambda v: v["dx"] > 0)).cast("long").alias("n"), F.round(records.average_in_place(F.col("v")), 5).alias("average"))
