"""Further registered queries: comments, grouping, cross-references and reports.

Imported for its registrations; see ``queries`` for the parts the tables play.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchengine.functions import comments
from matchengine.functions import similarity as sim
from matchengine.operators import adopted, averages, best_values, checks, groups, grouping, insertion, propagation, provenance, reference_tables, rules
from matchengine.plans import matching
from matchengine.queries import _GAMMA_COLUMNS, _GAMMA_TOLD, _LEVEL_COLUMNS, _LEVEL_TOLD, _LEVELS, _expressions, _told_sql, customer_levels, order_spectra, priced_lines, query, r6, rule_levels, table
from matchengine.schema import GAMMAS, SPIN_OPTIONS
from matchengine.sources import comment_records, reports


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _choice(values, key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


# --- comments -------------------------------------------------------------------

#: (body, head, whether it says that the value is quoted, value it gives)
COMMENTS = [
    ("From Adopted dataset.", "J", True, ""),
    ("taken from the Adopted set", "E", True, ""),
    ("7/2- from Adopted Levels", "J", False, "7/2-"),
    ("Deduced here with the adopted spins", "J", False, ""),
    ("From 48Ca Adopted Levels", "T", True, ""),
    ("Line is placed by its coincidences, from Adopted Gammas", "E", False, ""),
    ("two runs, this work", "E", False, ""),
    ("Not adopted in the Adopted Levels", "J", False, ""),
    ("Half-life adopted in the Adopted Levels", "T", True, ""),
    ("the same is Adopted", "T", True, ""),
    ("Mult=Q+D from Adopted Gammas", "M", False, "Q+D"),
    ("Differences and comments from Adopted Levels", "J", False, ""),
    ("45.6 {I7} from Adopted Gammas", "E", False, "45.6 7"),
    ("Adopted value: 81 PS 6", "T", False, "81 PS 6"),
    ("E2+M3 and M1+E2 from Adopted Gammas", "M", False, "M1+E2"),
    ("Adopted value is unweighted mean of 8 and 9", "E", False, ""),
    ("(3,4-) adopted in Adopted Levels", "J", False, "(3,4-)"),
]


@query(f"SELECT p_partkey, ({_sql_list(c[2] for c in COMMENTS)})[CAST(p_partkey % {len(COMMENTS)} AS INT) + 1] AS quoted, ({_sql_list(c[3] for c in COMMENTS)})[CAST(p_partkey % {len(COMMENTS)} AS INT) + 1] AS value FROM part")
def comment_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    body, head = _choice([c[0] for c in COMMENTS], k), _choice([c[1] for c in COMMENTS], k)
    rows = table(spark, sf_dir, "part").select("p_partkey", body.alias("body"), head.alias("head"))
    return rows.select("p_partkey", comments.says_from_adopted(F.col("body"), F.col("head")).alias("quoted"), comments.adopted_value(F.col("body"), F.col("head")).alias("value"))


@query("SELECT p_partkey AS record_id, 'E' AS field, p_partkey % 7 = 2 OR (p_size % 3 = 0 AND p_partkey % 5 = 0) OR (p_size % 3 = 1 AND p_partkey % 5 <> 1 AND p_partkey % 7 <> 3) AS quoted FROM part")
def quoted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    records = part.select(k.alias("record_id"), (F.col("p_size") % 3).cast("int").alias("dataset"), F.lit("E").alias("field"), F.when(k % 5 == 0, "A").when(k % 5 == 1, "B").otherwise("").alias("flags"))
    own = part.where("p_partkey % 7 IN (2, 3)").select(k.alias("record_id"), F.lit("E").alias("field"), F.when(k % 7 == 2, "From Adopted Levels").otherwise("From 1999Ab01").alias("body"))
    notes = spark.createDataFrame([(0, "E", "A", "From Adopted Gammas"), (1, "E", None, "From Adopted Levels"), (1, "E", "B", "measured")], "dataset int, field string, flag string, body string")
    return provenance.quoted_records(records, own, notes)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 10.0::DOUBLE ELSE s_suppkey / 4.0::DOUBLE END AS dx FROM supplier")
def filled_uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", sim.filled_uncertainty(F.when(k % 3 != 0, k / 4.0)).alias("dx"))


# --- grouping -------------------------------------------------------------------


@query("""WITH r AS (SELECT c_nationkey AS nation, c_custkey AS record, abs(c_acctbal) AS e, least(greatest(least(greatest(abs(c_acctbal) * (0.2::DOUBLE + exp(-abs(c_acctbal) / 20)), 2.0::DOUBLE), 100.0::DOUBLE), CASE WHEN c_custkey % 2 = 0 THEN 5.0::DOUBLE ELSE 0.5::DOUBLE END), 100.0::DOUBLE) AS reach FROM customer),
    g AS (SELECT s_nationkey AS nation, s_suppkey AS grp, abs(s_acctbal) AS m, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal), s_suppkey) AS place FROM supplier),
    i AS (SELECT nation, record, grp, place, abs(e - m) AS d, place - row_number() OVER (PARTITION BY nation, record ORDER BY place) AS run FROM r JOIN g USING (nation) WHERE e >= m - 1 - reach AND e <= m + 1 + reach),
    n AS (SELECT *, first_value(run) OVER (PARTITION BY nation, record ORDER BY d, grp) AS nearest FROM i)
    SELECT nation, record, grp, round(d, 6) AS distance FROM n WHERE run = nearest""")
def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    records = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), k.alias("record"), F.abs("c_acctbal").alias("e"), F.when(k % 2 == 0, 5.0).otherwise(0.5).alias("dx"))
    mean = F.abs("s_acctbal")
    known = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("grp"), (mean - 1).alias("low"), (mean + 1).alias("high"), mean.alias("mean"))
    return grouping.candidate_groups(records, known, ["nation"]).select("nation", "record", "grp", r6(F.col("distance")).alias("distance"))


@query()
def consistent_gamma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_spectra(spark, sf_dir)
    return rows.select("o_orderkey", "next_key", grouping.consistent_gammas(F.col("a"), F.col("b"), 1.0).alias("n"))


@query("""WITH m AS (SELECT l_orderkey, l_quantity < 25 AS e, l_partkey % 3 <> 0 AS j, l_suppkey % 4 <> 0 AS h, l_linenumber % 4 AS n FROM lineitem)
    SELECT l_orderkey, count(*) FILTER (e) AS n_energy, count(*) FILTER (j AND h) AS n_jpi, count(*) FILTER (NOT j AND h) AS n_jpi_conflict, CAST(max(n) AS BIGINT) AS max_gammas FROM m GROUP BY 1""")
def group_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (c("l_quantity") < 25).alias("energy_ok"), (c("l_partkey") % 3 != 0).alias("jpi_ok"), (c("l_suppkey") % 4 != 0).alias("has_jpi"), (c("l_linenumber") % 4).alias("n_matched"))
    return grouping.group_counters(rows, ["l_orderkey"])


@query("SELECT s_nationkey AS grp, round(min(s_acctbal), 2) AS low, round(max(s_acctbal), 2) AS high, round(avg(s_acctbal), 4) AS mean, count(*) AS n FROM supplier GROUP BY 1")
def group_energy_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.group_range(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("x")), ["grp"])
    return found.select("grp", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), F.round("mean", 4).alias("mean"), "n")


@query("SELECT c_custkey, round(c_acctbal - lag(c_acctbal) OVER w, 4) AS to_previous, round(lead(c_acctbal) OVER w - c_acctbal, 4) AS to_next FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
def neighbour_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.neighbours(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey")
    return found.select("c_custkey", F.round("to_previous", 4).alias("to_previous"), F.round("to_next", 4).alias("to_next"))


#: Options and lines of record ``k``: spins 0 to 4, a parity in two of three, none at
#: all in one of eleven; one gamma in half of the records.
_OPTIONS = "CASE WHEN {k} % 11 = 0 THEN array() ELSE array(named_struct('twoTimesSpin', CAST(2 * ({k} % 5) AS INT), 'isTentativeSpin', {k} % 3 = 0, 'parity', CASE {k} % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' END, 'isTentativeParity', false)) END"
_LINES = "CASE WHEN {k} % 4 < 2 THEN array(named_struct('energy', 100 + {k} % 7 * 0.5D, 'energy_uncertainty', 0.1D, 'intensity', 1.0D, 'intensity_uncertainty', 0.1D)) ELSE array() END"


def _nuclide_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as levels: nations are nuclides, segments datasets."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("dsid"), k.alias("record"), F.abs("c_acctbal").alias("x"), F.when(k % 2 == 0, 5.0).otherwise(0.5).alias("dx"),
        F.expr(_OPTIONS.format(k="c_custkey")).cast(SPIN_OPTIONS).alias("spins"), F.expr(_LINES.format(k="c_custkey")).cast(GAMMAS).alias("lines"),
    )


def _adopted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_nationkey").alias("nation"), F.lit("ADOPTED").alias("dsid"), (-F.col("s_suppkey") - 1).alias("record"), F.abs("s_acctbal").alias("x"), F.lit(1.0).alias("dx"),
        F.expr(_OPTIONS.format(k="s_suppkey")).cast(SPIN_OPTIONS).alias("spins"), F.expr(_LINES.format(k="s_suppkey")).cast(GAMMAS).alias("lines"),
    )


_DELTA = 60.0
_RATED = """r AS (
      SELECT c_nationkey AS nation, c_custkey AS k, abs(c_acctbal) AS x, CASE WHEN c_custkey % 2 = 0 THEN 5.0::DOUBLE ELSE 0.5::DOUBLE END AS dx, CASE WHEN c_custkey % 11 > 0 THEN 2 * (c_custkey % 5) END AS j,
             CASE WHEN c_custkey % 11 > 0 THEN CASE c_custkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' END END AS p, c_custkey % 11 > 0 AND c_custkey % 3 = 0 AS tentative, CASE WHEN c_custkey % 4 < 2 THEN 100 + c_custkey % 7 * 0.5::DOUBLE END AS g
      FROM customer),
    a AS (SELECT *, greatest(least(greatest(x * (0.2::DOUBLE + exp(-x / 20)), 2.0::DOUBLE), 100.0::DOUBLE), dx) AS reach FROM r WHERE k % 2 = 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY x, k) AS place FROM r WHERE k % 2 = 0),
    i AS (SELECT a.nation, a.k AS record, b.k AS grp, place, abs(a.x - b.x) AS d, place - row_number() OVER (PARTITION BY a.nation, a.k ORDER BY place) AS run FROM a JOIN b ON a.nation = b.nation AND abs(a.x - b.x) <= a.reach),
    n AS (SELECT *, first_value(run) OVER (PARTITION BY nation, record ORDER BY d, grp) AS nearest FROM i),
    e AS (
      SELECT n.nation, record, grp, d, a.x, b.x AS mean, d <= least(60, 3 * sqrt(a.dx * a.dx + b.dx * b.dx)) AS energy, NOT coalesce(a.j <> b.j OR a.p <> b.p, false) AS jpi, coalesce(abs(a.g - b.g) <= 1, false) AS gam,
             coalesce(abs(a.g - b.g) <= 1, false)::INT AS matched, (a.g + b.g IS NOT NULL)::INT AS ng, coalesce(abs(a.g - b.g) <= 2, false)::INT AS loose, abs(a.j - b.j) AS gap, coalesce(a.p <> b.p, false) AS conflict, a.tentative
      FROM n JOIN a ON a.k = record JOIN b ON b.k = grp WHERE run = nearest),
    f AS (
      SELECT *, CASE WHEN energy AND jpi AND ng = 0 THEN 1
        WHEN energy AND jpi AND NOT gam AND ((d <= 0.5 AND matched > 0) OR coalesce(gap = 0 AND matched = ng, false)) THEN 2
        WHEN energy AND jpi AND gam THEN 3
        WHEN NOT (energy AND jpi) AND (jpi OR coalesce(gap <= 2 AND NOT conflict, true)) AND d <= 5 AND (gam OR ng = 0) THEN 3
        WHEN NOT (energy AND jpi) AND (jpi OR coalesce(gap <= 2 AND NOT conflict, true)) AND d <= 10 AND gam THEN 4
        WHEN NOT (energy AND jpi) AND (jpi OR coalesce(gap <= 2 AND NOT conflict, true)) AND d <= 60 THEN CASE WHEN gam THEN 5 ELSE 6 END
        WHEN energy AND gam AND NOT jpi AND coalesce(gap, 0) <= 6 THEN 3 ELSE -1 END AS first
      FROM e),
    h AS (
      SELECT *, row_number() OVER (PARTITION BY nation, record ORDER BY d, grp) = 1 AS near, count(*) OVER (PARTITION BY nation, record) AS n_groups, max(first) OVER (PARTITION BY nation, record) > 0 AS placed,
             sum((jpi AND d <= 10)::INT) OVER (PARTITION BY nation, grp) AS n_close
      FROM f),
    s AS (
      SELECT *, CASE WHEN first > 0 THEN first
        WHEN d <= 5 AND ng > 0 AND loose > 0 AND gap <= 4 AND jpi AND tentative AND near THEN 5
        WHEN n_groups = 1 AND NOT placed AND jpi AND d <= 10 AND n_close = 1 THEN 6 ELSE -1 END AS strength
      FROM h)"""


@query(f"WITH {_RATED} SELECT nation, record, grp, round(d, 6) AS distance, CAST(strength AS INTEGER) AS strength, CAST(matched AS BIGINT) AS n_matched FROM s")
def insertion_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of each candidate pair of records and groups of one member."""
    rated = insertion.strengths(*_odd_and_even(spark, sf_dir), ["nation"], _DELTA)
    return rated.select("nation", "record", "grp", r6(F.col("distance")).alias("distance"), "strength", "n_matched")


def _odd_and_even(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _nuclide_records(spark, sf_dir)
    return rows.where("record % 2 = 1"), rows.where("record % 2 = 0").withColumn("grp", F.col("record"))


@query(f"""WITH RECURSIVE {_RATED},
    c AS (SELECT *, row_number() OVER (PARTITION BY nation, record ORDER BY matched DESC, d, grp) AS pg, row_number() OVER (PARTITION BY nation, record ORDER BY d, matched DESC, grp) AS pd, min(strength) OVER (PARTITION BY nation, record) AS best FROM s WHERE strength > 0),
    kept AS (SELECT *, least(x, mean) AS low, greatest(x, mean) AS high FROM c WHERE (pg = 1 OR pd = 1) AND NOT (best < 5 AND strength > 5)),
    m AS (SELECT *, max(high) OVER (PARTITION BY nation ORDER BY low, high, record, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM kept),
    z AS (SELECT *, nation * 1000000 + sum((low > coalesce(reached, low))::INT) OVER (PARTITION BY nation ORDER BY low, high, record, grp ROWS UNBOUNDED PRECEDING) AS island FROM m),
    q AS (SELECT *, dense_rank() OVER (PARTITION BY island ORDER BY x, record) AS ri, dense_rank() OVER (PARTITION BY island ORDER BY mean, grp) AS gi FROM z),
    top AS (SELECT island, max(ri) AS last FROM q GROUP BY island),
    dp(island, i, j, s1, s2, s3, s4, s5, s6, m, d, path) AS (
      SELECT island, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::DOUBLE, []::BIGINT[] FROM top
      UNION ALL
      SELECT island, i, j, s1, s2, s3, s4, s5, s6, m, d, path FROM (
        SELECT *, row_number() OVER (PARTITION BY island, j ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC, s5 DESC, s6 DESC, m DESC, d) AS n FROM (
          SELECT dp.island, i + 1 AS i, j, s1, s2, s3, s4, s5, s6, m, d, path FROM dp JOIN top ON top.island = dp.island AND i < last
          UNION ALL
          SELECT dp.island, i + 1, q.gi, s1 + (strength = 1)::BIGINT, s2 + (strength = 2)::BIGINT, s3 + (strength = 3)::BIGINT, s4 + (strength = 4)::BIGINT, s5 + (strength = 5)::BIGINT, s6 + (strength = 6)::BIGINT, dp.m + matched, dp.d + q.d, list_append(path, record * 1000000 + grp)
          FROM dp JOIN q ON q.island = dp.island AND q.ri = dp.i + 1 AND q.gi > dp.j)) WHERE n = 1),
    ends AS (SELECT *, row_number() OVER (PARTITION BY dp.island ORDER BY s1 DESC, s2 DESC, s3 DESC, s4 DESC, s5 DESC, s6 DESC, m DESC, d) AS n FROM dp JOIN top ON top.island = dp.island AND i = last)
    SELECT u // 1000000 AS record, u % 1000000 AS grp FROM (SELECT unnest(path) AS u FROM ends WHERE n = 1)""")
def strength_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to groups in order of energy, by strength, gammas and distance."""
    pairs = insertion.chosen_pairs(*_odd_and_even(spark, sf_dir), ["nation"], _DELTA)
    return insertion.assign(pairs, ["nation"], repair=False).select("record", "grp")


@query()
def grouped_with_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all records, seeded by the adopted ones."""
    rows = _nuclide_records(spark, sf_dir).unionByName(_adopted_records(spark, sf_dir))
    return insertion.group_nuclides(rows, ["nation"], _DELTA, "ADOPTED").select("nation", "grp", "dsid", "record")


@query()
def grouped_without_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all records, seeded by the largest dataset of each nuclide."""
    return insertion.group_nuclides(_nuclide_records(spark, sf_dir), ["nation"], _DELTA).select("nation", "grp", "dsid", "record")


@query()
def gamma_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_orderkey") % 500).alias("level_group"), c("l_returnflag").alias("dsid"), (c("l_orderkey") * 10_000_000 + c("l_linenumber") * 1_000_000 + c("l_partkey")).alias("record"), (c("l_extendedprice") / 10).alias("x"))
    return grouping.gamma_subgroups(rows, ["level_group"], 20.0)


def _spin_rounds(n: int) -> str:
    """CTEs s0 to s<n> (options of levels), c0 to c<n> (levels that contradict):
    rounds of propagation, each from the tables of the one before."""
    fits = """CASE mult WHEN 'E2' THEN t2 AND same WHEN 'M1' THEN t1 AND same WHEN 'M1+E2' THEN t1 AND t2 AND same WHEN 'E1,M2' THEN (t1 OR t2) AND NOT same ELSE t1 OR (t2 AND same) END"""
    parts = []
    for k in range(n):
        parts.append(f"""
    g{k} AS MATERIALIZED (SELECT DISTINCT a, id, j, p FROM (
        SELECT e.a, e.id, mult, u.j, u.p, abs(b.j - u.j) <= 2 AND b.j + u.j >= 2 AS t1, abs(b.j - u.j) <= 4 AND b.j + u.j >= 4 AS t2, b.p = u.p AS same FROM e JOIN s{k} b ON b.level = e.b JOIN u ON abs(u.j - b.j) <= 4) WHERE {fits}),
    n{k} AS MATERIALIZED (SELECT a, count(DISTINCT id) AS n FROM e WHERE b IN (SELECT level FROM s{k}) GROUP BY a),
    a{k} AS MATERIALIZED (SELECT g.a, j, p FROM g{k} g JOIN n{k} USING (a) GROUP BY g.a, j, p HAVING count(*) = max(n)),
    s{k + 1} AS MATERIALIZED (
      SELECT s.* FROM s{k} s WHERE level NOT IN (SELECT a FROM n{k}) OR (level, j, p) IN (SELECT (a, j, p) FROM a{k})
      UNION ALL SELECT a, j, p FROM a{k} WHERE a NOT IN (SELECT level FROM s{k}) AND a NOT IN (SELECT level FROM c{k})),
    c{k + 1} AS MATERIALIZED (SELECT level FROM c{k} UNION SELECT a FROM n{k} WHERE a NOT IN (SELECT level FROM s{k + 1}))""")
    return ",".join(parts)


#: More rounds than the levels of any table here need.
_ROUNDS = 14


@query(f"""WITH u AS (SELECT 2 * x AS j, p FROM range(0, 60) r(x), (VALUES ('+'), ('-')) v(p)),
    m AS (SELECT p_partkey AS k, p_size, CASE p_size % 6 WHEN 0 THEN 'E2' WHEN 1 THEN 'M1' WHEN 2 THEN 'M1+E2' WHEN 3 THEN 'E1,M2' WHEN 4 THEN '[E1]' ELSE '' END AS mult FROM part),
    g AS (SELECT k AS i, k // 2 AS f, mult FROM m UNION ALL SELECT k, 2 * k // 3, '' FROM m WHERE p_size % 5 = 0),
    e AS (SELECT row_number() OVER () AS id, * FROM g WHERE i <> f), d AS (SELECT id, i AS a, f AS b, mult FROM e UNION ALL SELECT id, f, i, mult FROM e),
    s0 AS (SELECT k AS level, 2 * (k % 4) AS j, p FROM m, (VALUES ('+'), ('-')) v(p) WHERE k % 8 = 0 AND (k % 3 = 0 OR p = '+') UNION SELECT k, 2 * (k % 4) + 2, '+' FROM m WHERE k % 16 = 0),
    c0 AS (SELECT k AS level FROM m WHERE false), {_spin_rounds(_ROUNDS).replace(" e ", " d ").replace(" e.", " d.").replace("FROM e ", "FROM d ")}
    SELECT k AS level, (SELECT string_agg((j // 2) || p, ' ' ORDER BY j, p) FROM s{_ROUNDS} s WHERE s.level = k) AS options, k IN (SELECT level FROM c{_ROUNDS}) AS contradiction, k IN (SELECT level FROM s{_ROUNDS}) AND k % 8 <> 0 AS derived FROM m""")
def propagated_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spin-parities of one level in eight, carried along gammas through a tree."""
    k, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part")
    spin = (2 * (k % 4)).cast("int")
    one = lambda j, p: F.struct(j.cast("int").alias("two_j"), p.cast("string").alias("parity"))
    known = F.when(k % 16 == 0, F.array(one(spin, F.when(k % 3 != 0, F.lit("+"))), one(spin + 2, F.lit("+")))).when(k % 8 == 0, F.array(one(spin, F.when(k % 3 != 0, F.lit("+")))))
    names = F.element_at(F.array(*map(F.lit, ("E2", "M1", "M1+E2", "E1,M2", "[E1]", ""))), (size % 6 + 1).cast("int"))
    tree = part.select(k.alias("initial"), F.floor(k / 2).alias("final"), names.alias("mult"))
    more = part.where(size % 5 == 0).select(k.alias("initial"), F.floor(2 * k / 3).alias("final"), F.lit("").alias("mult"))
    found = propagation.propagated_options(part.select(k.alias("level"), known.alias("options")), tree.unionByName(more))
    text = F.array_join(F.transform("options", lambda o: F.concat((o["two_j"] / 2).cast("int").cast("string"), o["parity"])), " ")
    return found.select("level", F.nullif(text, F.lit("")).alias("options"), "contradiction", "derived")


@query(f"""WITH {_LEVELS}, a AS (SELECT nation, min(k) AS anchor FROM lev GROUP BY nation)
    SELECT m.k AS level_id, a.anchor, round(exp(-0.1::DOUBLE * pow(abs(m.e - b.e) / sqrt(m.s * m.s + b.s * b.s), 2)), 6) AS energy,
           CASE WHEN m.j = b.j THEN CASE WHEN m.tj OR b.tj THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END WHEN abs(m.j - b.j) = 2 THEN CASE WHEN m.tj OR b.tj THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END ELSE 0.0::DOUBLE END AS spin
    FROM lev m JOIN a USING (nation) JOIN lev b ON b.k = a.anchor WHERE m.k <> a.anchor""")
def member_rescoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every level of a nation against the nation's first one."""
    levels = customer_levels(spark, sf_dir).withColumn("level_id", F.col("key")).withColumn("gamma_decays", F.array().cast("array<struct<energy:double,energy_uncertainty:double,intensity:double,intensity_uncertainty:double>>"))
    first = levels.groupBy("nation").agg(F.min("key").alias("anchor"))
    members = levels.join(first, "nation").select("level_id", "anchor")
    return matching.rescored(members, levels).select("level_id", "anchor", r6(F.col("energy")).alias("energy"), "spin")


# --- orders and small aggregates ---------------------------------------------------


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey * 2 + s_suppkey % 3, s_nationkey, s_suppkey) AS BIGINT) AS place FROM supplier")
def nuclide_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("s_nationkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (z * 2 + F.col("s_suppkey") % 3).alias("mass"), z.alias("charge"))
    return groups.numbered(rows, [], ["mass", "charge", "s_suppkey"], "place").select("s_suppkey", "place")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_extendedprice, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS place FROM lineitem""")
def records_in_dataset_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = groups.dataset_rank(F.col("l_returnflag"), ["R", "A", "N"])
    rows = table(spark, sf_dir, "lineitem").withColumn("rank", rank)
    return groups.numbered(rows, ["l_orderkey"], ["rank", "l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey"], "place").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "place")


@query("SELECT s_nationkey AS cluster_no, string_agg(d, ' ' ORDER BY d) AS datasets FROM (SELECT DISTINCT s_nationkey, CAST(s_suppkey % 4 AS VARCHAR) AS d FROM supplier) GROUP BY 1")
def datasets_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster_no"), (F.col("s_suppkey") % 4).cast("string").alias("dataset_code"))
    return groups.datasets_of(members, "cluster_no", "dataset_code").select("cluster_no", F.array_join("datasets", " ").alias("datasets"))


@query("""WITH p AS (SELECT doc_id % 5 = 0 AS v, quality::DOUBLE AS y, least(0.99::DOUBLE, greatest(0.01::DOUBLE, n_chars / 5000.0::DOUBLE)) AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
    m AS (SELECT sqrt(avg((y - p) * (y - p)) FILTER (v)) - sqrt(avg((y - p) * (y - p)) FILTER (NOT v)) AS gap FROM p) SELECT round(gap, 6) AS gap, CASE WHEN gap > 0.05 THEN 'over-fitted' WHEN gap > 0.01 THEN 'slightly over-fitted' ELSE 'good' END AS verdict FROM m""")
def overfit_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").where("quality IS NOT NULL").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select((F.col("doc_id") % 5 == 0).alias("held"), F.col("quality").cast("double").alias("y"), F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / 5000.0)).alias("p"))
    found = averages.overfit(rows, "held", "y", "p")
    return found.select(r6(F.col("gap")).alias("gap"), "verdict")


# --- reports ----------------------------------------------------------------------


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) >= 2)")
def multi_member_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster_no"), "s_suppkey")
    return reports.multi_member(members).select("s_suppkey")


def _gamma_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    text = lambda e: e.cast("long").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("level"), (c("l_linenumber") * 1_000_000 + c("l_partkey")).alias("record"), c("l_quantity").alias("energy"), text(c("l_quantity")).alias("energy_text"), text(c("l_linenumber")).alias("uncertainty_text"),
        text(F.round(c("l_discount") * 100)).alias("intensity_text"), F.lit(None).cast("string").alias("intensity_uncertainty_text"), text(c("l_partkey")).alias("initial_text"), text(c("l_suppkey")).alias("final_text"),
    )


_GAMMA_LINE = "rtrim(rpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 10, ' ') || rpad(CAST(l_linenumber AS VARCHAR), 3, ' ') || rpad(CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), 8, ' ') || '   ' || rpad(CAST(l_partkey AS VARCHAR), 10, ' ') || '-> ' || rpad(CAST(l_suppkey AS VARCHAR), 10, ' '))"


@query(f"SELECT l_orderkey AS level, l_linenumber * 1000000 + l_partkey AS record, {_GAMMA_LINE} AS line FROM lineitem")
def gamma_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gamma_lines(_gamma_fields(spark, sf_dir)).select("level", "record", "line")


@query(f"SELECT l_orderkey AS level, string_agg({_GAMMA_LINE}, chr(10) ORDER BY l_quantity DESC, l_linenumber * 1000000 + l_partkey DESC, {_GAMMA_LINE} DESC) AS text FROM lineitem GROUP BY 1")
def gammas_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gammas_by_level(_gamma_fields(spark, sf_dir))


@query("""WITH l AS (SELECT l_partkey AS part, l_extendedprice / l_quantity AS x, 1 + 100 * l_discount AS dx FROM lineitem),
    s AS (SELECT part, count(*) AS n, sum(1 / (dx * dx)) AS sw, sum(x / (dx * dx)) / sum(1 / (dx * dx)) AS w, avg(x) AS u FROM l GROUP BY part),
    c AS (SELECT part, sum((x - w) * (x - w) / (dx * dx)) AS left_over FROM l JOIN s USING (part) GROUP BY part)
    SELECT part, printf('%d n=%d weighted=%.3f int=%.3f ext=%.3f chi2=%.2f unweighted=%.3f', part, n, w, 1 / sqrt(sw), coalesce(sqrt(left_over / (nullif(n - 1, 0) * sw)), 0), coalesce(left_over / nullif(n - 1, 0), 0), u) AS line FROM s JOIN c USING (part)""")
def average_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.average_lines(averages.weighted_mean(priced_lines(spark, sf_dir), ["part"], "x", "dx"), "part")


@query("""WITH r AS (SELECT l_orderkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' from ' || l_suppkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' from ' || l_suppkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    SELECT l_orderkey, 'average of ' || string_agg(t, ', ' ORDER BY k) || CASE WHEN max(n) > 3 THEN ', ...' ELSE '' END AS comment FROM r WHERE k <= 3 GROUP BY 1""")
def average_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), F.col("l_quantity").cast("long").cast("string").alias("value_text"), F.col("l_suppkey").cast("string").alias("source"))
    return reports.average_comment(rows, "l_orderkey")


@query("""WITH r AS (SELECT l_orderkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' from ' || l_suppkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' from ' || l_suppkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    a AS (SELECT l_orderkey, 'average of ' || string_agg(t, ', ' ORDER BY k) || CASE WHEN max(n) > 9 THEN ', ...' ELSE '' END AS body FROM r WHERE k <= 9 GROUP BY 1)
    SELECT o_orderkey AS record, 'E' AS field, coalesce(body, 'old energy of ' || o_orderkey) AS body FROM orders LEFT JOIN a ON l_orderkey = o_orderkey UNION ALL SELECT o_orderkey, 'J', 'of ' || o_orderpriority FROM orders""")
def comments_from_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of orders reported, the report parsed, its comments put into datasets
    (50 files of level records with old comments) and read from there."""
    c = F.col
    values = table(spark, sf_dir, "lineitem").select(c("l_orderkey").cast("string").alias("name"), c("l_linenumber").alias("place"), c("l_quantity").cast("long").cast("string").alias("value_text"), c("l_suppkey").cast("string").alias("source"))
    comments = reports.average_comment(values, "name", most=9).select("name", F.lit("E").alias("field"), c("comment").alias("body"))
    report = comment_records.average_report(values, comments)
    file = lambda name: F.concat(F.lit("log"), (name.cast("long") % 50).cast("string"))
    shown = groups.numbered(report.withColumn("file", file(c("name"))), ["file"], ["name", "place"], "line_no").select("file", "line_no", "line")
    parsed = comment_records.parse_average_report(shown)
    old = lambda kind, *text: F.concat(F.lit(f" 34S {kind} "), *text)
    key = c("o_orderkey").cast("string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", file(c("o_orderkey")).alias("file"), F.posexplode(F.array(old(" " + " L", key), old(" cL", F.lit("E$old energy")), old("2cL", F.lit("of "), key), old(" cL", F.lit("J$of "), c("o_orderpriority")))).alias("at", "line"))
    records = orders.withColumn("line_no", c("o_orderkey") * 4 + c("at"))
    owners = parsed.select("file", (c("name").cast("long") * 4).alias("owner"), "field", "body")
    patched = comment_records.patch_comments(records.select("file", "line_no", "line"), owners)
    found = comment_records.parse_comments(patched)
    names = patched.where(F.substring("line", 6, 3) == "  L").select("file", c("line_no").alias("owner"), F.trim(F.substring("line", 10, 71)).cast("long").alias("record"))
    return found.join(names, ["file", "owner"]).select("record", "field", "body")


@query("""WITH f AS (SELECT DISTINCT l_suppkey % 97 AS level_group, l_orderkey % 1000 AS gamma_group FROM lineitem WHERE l_partkey % 97 > l_suppkey % 97),
    r AS (SELECT level_group, 'G' || gamma_group AS t, row_number() OVER (PARTITION BY level_group ORDER BY (gamma_group * 7919) % 1009, gamma_group) AS k, count(*) OVER (PARTITION BY level_group) AS n FROM f)
    SELECT level_group, max(n) AS n, 'fed by ' || string_agg(t, ', ' ORDER BY k) || CASE WHEN max(n) > 3 THEN ', ...' ELSE '' END AS line FROM r WHERE k <= 3 GROUP BY 1""")
def feeding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchengine.operators import pairs

    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 97).alias("initial_group"), (F.col("l_suppkey") % 97).alias("final_group"), (F.col("l_orderkey") % 1000).alias("gamma_group"))
    known = spark.range(1000).select(F.col("id").alias("gamma_group"), F.concat(F.lit("G"), F.col("id").cast("string")).alias("energy_text"), (F.col("id") * 7919 % 1009).alias("energy"))
    return reports.feeding_lines(pairs.feeding(rows), known)


_TAG = "CASE WHEN l_suppkey % 5 = 0 THEN CAST(l_suppkey % 10 AS VARCHAR) ELSE chr(CAST(65 + l_suppkey % 26 AS INT)) END"


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("l_suppkey") % 5 == 0, (F.col("l_suppkey") % 10).cast("string")).otherwise(F.char(65 + F.col("l_suppkey") % 26))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), tag.alias("tag"), F.when(F.col("l_returnflag") == "R", "*").alias("marker"))


@query(f"""WITH t AS (SELECT DISTINCT l_orderkey AS record, {_TAG} AS tag, {_TAG} || CASE WHEN l_returnflag = 'R' THEN '(*)' ELSE '' END AS t FROM lineitem)
    SELECT record, string_agg(t, '' ORDER BY tag >= 'A', tag, t) AS xref FROM t GROUP BY 1""")
def xref_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.xref_lists(_tags(spark, sf_dir))


@query("""WITH o AS (SELECT c_custkey AS record, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'AB' END AS old FROM customer WHERE c_custkey % 4 <> 1), n AS (SELECT c_custkey AS record, CASE WHEN c_custkey % 5 = 0 THEN 'AC' ELSE 'AB' END AS new FROM customer WHERE c_custkey % 7 <> 1)
    SELECT record, old, new, old IS DISTINCT FROM new AS changed FROM o FULL JOIN n USING (record)""")
def changed_xrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 4 <> 1").select(k.alias("record"), F.when(k % 3 != 0, "AB").alias("xref"))
    new = c.where("c_custkey % 7 <> 1").select(k.alias("record"), F.when(k % 5 == 0, "AC").otherwise("AB").alias("xref"))
    return reports.changed_xrefs(old, new)


@query(f"""WITH l AS (SELECT o_orderkey AS level, o_totalprice AS energy, 'L ' || o_orderkey AS line, CASE WHEN o_orderkey % 3 = 0 THEN 'AB' END AS xref FROM orders),
    r AS (SELECT level, energy, 0 AS kind, 0.0::DOUBLE AS e, 0 AS record, line FROM l UNION ALL SELECT level, energy, 1, 0.0, 0, 'XREF=' || xref FROM l WHERE xref IS NOT NULL
      UNION ALL SELECT l.level, l.energy, 2, l_quantity, l_linenumber * 1000000 + l_partkey, {_GAMMA_LINE} FROM lineitem JOIN l ON l.level = l_orderkey)
    SELECT level, round(energy, 2) AS energy, string_agg(line, chr(10) ORDER BY kind, e, record, line) AS text FROM r GROUP BY level, energy""")
def adopted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    levels = table(spark, sf_dir, "orders").select(k.alias("level"), F.col("o_totalprice").alias("energy"), F.concat(F.lit("L "), k.cast("string")).alias("line"), F.when(k % 3 == 0, "AB").alias("xref"))
    found = reports.adopted_blocks(levels, reports.gamma_lines(_gamma_fields(spark, sf_dir)))
    return found.select("level", F.round("energy", 2).alias("energy"), "text")


@query("""WITH v AS (SELECT l_orderkey AS level, 'D' || l_suppkey % 10 AS dsid, l_linenumber * 100000 + l_partkey AS place, (printf('%.2f', l_extendedprice) || CAST(l_linenumber * 3 + 7 AS VARCHAR))::DOUBLE AS x, CASE WHEN l_partkey % 5 > 0 THEN (l_partkey % 97 * 137031 + l_linenumber * 111701 + 500317)::DOUBLE * 0.0001::DOUBLE END AS dx,
      l_suppkey % 4 = 0 AS tentative, l_partkey % 7 = 0 AS quoted, l_partkey % 3 = 0 AS questionable, l_linenumber = 1 AS is_adopted FROM lineitem),
    l AS (SELECT * FROM v WHERE NOT tentative AND NOT quoted AND dx IS NOT NULL AND level IN (SELECT level FROM v WHERE NOT tentative AND NOT quoted AND dx IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)),
    w AS (SELECT *, (1 / (dx * dx)) / sum(1 / (dx * dx)) OVER (PARTITION BY level) >= 0.02 AS used FROM l),
    a AS (SELECT level, count(*) AS n, sum(x / (dx * dx)) / sum(1 / (dx * dx)) AS wa, avg(x) AS u, stddev_samp(x) / sqrt(count(*)) AS eu, min(x) AS low, max(x) AS high, sum(1 / (dx * dx)) AS sw FROM w GROUP BY 1),
    b AS (SELECT level, count(*) AS n, sum(x / (dx * dx)) / sum(1 / (dx * dx)) AS wu FROM w WHERE used GROUP BY 1),
    c AS (SELECT w.level, coalesce(sum((x - wa) * (x - wa) / (dx * dx)) / nullif(max(a.n) - 1, 0), 0) AS chi_all, coalesce(sum(CASE WHEN used THEN (x - wu) * (x - wu) / (dx * dx) END) / nullif(max(b.n) - 1, 0), 0) AS chi, bool_or(round(x, 6) = round(wu, 6)) AS equals
      FROM w JOIN a USING (level) JOIN b USING (level) GROUP BY 1),
    k AS (SELECT *, CASE WHEN low = high OR equals THEN 'N' WHEN least(chi, chi_all) > 3.5 THEN 'U' WHEN round(wu, 6) = round(wa, 6) THEN 'A' WHEN chi_all < chi OR chi_all < 3.0 THEN 'A' ELSE 'W' END AS kind FROM a JOIN (SELECT level, wu FROM b) USING (level) JOIN c USING (level)),
    d AS (SELECT level, CASE kind WHEN 'U' THEN u WHEN 'A' THEN wa ELSE wu END AS adopted, greatest(1e-6, CASE kind WHEN 'U' THEN eu ELSE greatest(1, sqrt(chi_all)) / sqrt(sw) END) AS spread FROM k),
    t AS (SELECT *, greatest(0, least(6, floor(log10(35 / spread))))::INT AS dec FROM d),
    f AS (SELECT level, arg_min(struct_pack(x := x, dx := dx, dsid := dsid), struct_pack(a := dx IS NULL, b := questionable, c := coalesce(dx, 0), d := place, e := dsid)) FILTER (NOT tentative AND NOT quoted) AS firm,
      arg_min(struct_pack(x := x, dx := dx, dsid := dsid), struct_pack(a := NOT is_adopted, b := place, c := dsid)) FILTER (tentative AND NOT quoted) AS doubtful, arg_min(struct_pack(x := x, dx := dx, dsid := dsid), struct_pack(a := NOT is_adopted, b := place, c := dsid)) AS first FROM v GROUP BY 1)
    SELECT level, CASE WHEN t.level IS NOT NULL THEN 'average' WHEN firm IS NOT NULL THEN 'firm' WHEN doubtful IS NOT NULL THEN 'tentative' ELSE 'quoted' END AS choice,
      CASE WHEN t.level IS NOT NULL THEN round(adopted, dec) WHEN firm IS NOT NULL THEN firm.x WHEN doubtful IS NOT NULL THEN doubtful.x ELSE first.x END AS value,
      CASE WHEN t.level IS NOT NULL THEN round(spread * pow(10, dec)) WHEN firm IS NOT NULL THEN round(firm.dx * 10000) WHEN doubtful IS NOT NULL THEN round(doubtful.dx * 10000) ELSE round(first.dx * 10000) END AS uncertainty,
      CASE WHEN t.level IS NOT NULL THEN NULL WHEN firm IS NOT NULL THEN firm.dsid WHEN doubtful IS NOT NULL THEN doubtful.dsid END AS source
    FROM f LEFT JOIN t USING (level)""")
def best_values_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is adopted of each group's values, and why; uncertainties in units of the
    last digit."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("level"), F.lit("E").alias("field"), F.concat(F.lit("D"), (c("l_suppkey") % 10).cast("string")).alias("dsid"), (c("l_linenumber") * 100000 + c("l_partkey")).alias("place"), F.concat(c("l_extendedprice").cast("decimal(12,2)").cast("string"), (c("l_linenumber") * 3 + 7).cast("string")).alias("text"),
        F.when(c("l_partkey") % 5 > 0, (c("l_partkey") % 97 * 137031 + c("l_linenumber") * 111701 + 500317).cast("string")).alias("unc_text"), (c("l_suppkey") % 4 == 0).alias("tentative"), (c("l_partkey") % 7 == 0).alias("quoted"), (c("l_partkey") % 3 == 0).alias("questionable"), (c("l_linenumber") == 1).alias("is_adopted"),
    )
    found = best_values.best_values(rows, ["level"])
    return found.select("level", "choice", c("value").try_cast("double").alias("value"), F.nullif(c("uncertainty"), F.lit("")).try_cast("double").alias("uncertainty"), "source")


# --- all rules from levels, gammas and comments -------------------------------------

_J = ("2+", "3-", "2+,3+", "")
_JPI = "CASE {k} % 4 WHEN 0 THEN '2+' WHEN 1 THEN '3-' WHEN 2 THEN '2+,3+' ELSE '' END"
_T12 = "CASE {k} % 5 WHEN 0 THEN '5 NS' WHEN 1 THEN '5000 PS' WHEN 2 THEN '3 US' ELSE '' END"
_SECONDS = "CASE {t} WHEN '5 NS' THEN 5e-9::DOUBLE WHEN '5000 PS' THEN 5e-9::DOUBLE WHEN '3 US' THEN 3e-6::DOUBLE END"
_OVERLAP = "{a} = {b} OR {a} = '' OR {b} = '' OR '2+' IN ({a}, {b}) AND '2+,3+' IN ({a}, {b})"


@query(f"""WITH l AS (SELECT c_nationkey AS nuclide, CASE WHEN c_custkey % 7 = 0 THEN '34P B+ DECAY' ELSE c_mktsegment END AS dsid, c_custkey AS level, 10 * c_custkey AS line_no, printf('%.1f', abs(c_acctbal)) AS t, printf('%.1f', abs(c_acctbal))::DOUBLE AS e, {_JPI.format(k='c_custkey')} AS j, {_T12.format(k='c_custkey')} AS h FROM customer),
    a AS (SELECT s_nationkey AS nuclide, s_suppkey AS adopted, CAST(CAST(round(abs(s_acctbal)) AS BIGINT) AS DOUBLE) AS y, {_JPI.format(k='s_suppkey')} AS aj, {_T12.format(k='s_suppkey')} AS ah FROM supplier),
    w AS (SELECT l.nuclide, l.level, adopted, abs(e - y) AS d, row_number() OVER (PARTITION BY level ORDER BY abs(e - y), adopted) AS n FROM l JOIN a ON a.nuclide = l.nuclide AND abs(e - y) <= 50),
    m AS (SELECT l.*, w.adopted, d, y, aj, ah FROM l LEFT JOIN w ON w.level = l.level AND n = 1 LEFT JOIN a ON a.adopted = w.adopted),
    q AS (SELECT DISTINCT o_custkey AS level, CASE o_orderkey % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'J' ELSE 'T' END AS field FROM orders WHERE o_orderkey % 8 < 3),
    z AS (SELECT *, (level, 'E') IN (SELECT (level, field) FROM q) AS qe, (level, 'J') IN (SELECT (level, field) FROM q) AS qj FROM m),
    p AS (SELECT *, row_number() OVER (PARTITION BY nuclide, dsid ORDER BY e, level) - 1 AS place FROM l),
    g AS (SELECT l.nuclide, l.dsid, o_orderkey AS gamma, o_custkey AS level, 10 * o_custkey + 1 + o_orderkey % 7 AS line_no, CAST(CAST(o_totalprice AS BIGINT) % 900 AS DOUBLE) AS e, CASE o_orderkey % 5 WHEN 0 THEN 'M1+E2' WHEN 1 THEN '(E1)' WHEN 2 THEN '[E2]' ELSE '' END AS mult, o_orderkey % 9 = 0 AS said, o_orderkey % 10 = 0 AS said_e FROM orders JOIN l ON l.level = o_custkey),
    ends AS (SELECT g.gamma, arg_min(f.place, struct_pack(d := abs(s.e - g.e - f.e), p := f.place)) AS final FROM g JOIN p s ON s.level = g.level JOIN p f ON f.nuclide = g.nuclide AND f.dsid = g.dsid AND abs(s.e - g.e - f.e) <= 50 GROUP BY 1),
    ag AS (SELECT 1 + p_partkey % 50 AS adopted, 1000000000 + p_partkey AS ag, CAST(CAST(p_retailprice AS BIGINT) % 900 AS DOUBLE) AS ae, CASE p_partkey % 3 WHEN 0 THEN 'M1+E2' WHEN 1 THEN 'E1' ELSE '' END AS am FROM part WHERE 1 + p_partkey % 50 IN (SELECT s_suppkey FROM supplier)),
    near AS (SELECT g.dsid, g.gamma, ag, ae, am, abs(e - ae) AS d FROM g JOIN (SELECT level, adopted FROM m) USING (level) JOIN ag USING (adopted) WHERE abs(e - ae) <= 5),
    mut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dsid, gamma ORDER BY d, ag) AS r1, row_number() OVER (PARTITION BY dsid, ag ORDER BY d, gamma) AS r2 FROM near) WHERE r1 = 1 AND r2 = 1),
    x AS (SELECT g.*, s.place AS i, final, s.j AS ji, f.j AS jf, ag, ae, am, said AND ag IS NOT NULL AS mq FROM g JOIN p s ON s.level = g.level LEFT JOIN ends USING (gamma) LEFT JOIN p f ON f.nuclide = g.nuclide AND f.dsid = g.dsid AND f.place = final LEFT JOIN mut ON mut.gamma = g.gamma),
    told AS (
      SELECT nuclide, dsid, line_no, 'R10' AS rule, 'B+ DECAY should be EC DECAY or EC+B+ DECAY' AS message FROM z WHERE adopted IS NOT NULL AND dsid = '34P B+ DECAY'
      UNION ALL SELECT nuclide, dsid, line_no, 'R13', 'energy quoted from Adopted differs' FROM z WHERE qe AND e <> y
      UNION ALL SELECT nuclide, dsid, line_no, 'R14', 'spin-parity quoted from Adopted differs' FROM z WHERE qj AND j <> aj
      UNION ALL SELECT nuclide, dsid, line_no, 'R14', CASE WHEN dsid = '34P B+ DECAY' AND j <> aj THEN 'spin-parity differs from Adopted' ELSE 'spin-parity contradicts Adopted' END FROM z WHERE NOT qj AND adopted IS NOT NULL AND (dsid = '34P B+ DECAY' AND j <> aj OR NOT ({_OVERLAP.format(a='j', b='aj')}))
      UNION ALL SELECT nuclide, dsid, line_no, 'R15', CASE WHEN e = 0 AND h = '' THEN 'ground state has no half-life' WHEN coalesce({_SECONDS.format(t='h')} <> {_SECONDS.format(t='ah')}, h <> ah) THEN 'half-life differs from Adopted' ELSE 'half-life of an isomer without its flag' END FROM z
        WHERE adopted IS NOT NULL AND (e = 0 AND h = '' OR coalesce({_SECONDS.format(t='h')} <> {_SECONDS.format(t='ah')}, h <> ah) OR h = '3 US')
      UNION ALL SELECT nuclide, dsid, line_no, CASE WHEN adopted IS NULL THEN 'R23' ELSE 'R24' END, CASE WHEN adopted IS NULL THEN 'no adopted record' ELSE 'energy is discrepant from the adopted record' END FROM z WHERE nuclide IN (SELECT nuclide FROM a) AND (adopted IS NULL OR d > 10)
      UNION ALL SELECT nuclide, dsid, line_no, 'R17', CASE WHEN final IS NULL THEN 'gamma has no final level' ELSE 'final level is not below the initial one' END FROM x WHERE final IS NULL OR final >= i
      UNION ALL SELECT nuclide, dsid, line_no, 'R18', 'multipolarity does not fit the spins' FROM x WHERE ji IN ('2+', '3-') AND jf IN ('2+', '3-') AND CASE WHEN ji = jf THEN mult = '(E1)' ELSE mult IN ('M1+E2', '[E2]') END
      UNION ALL SELECT nuclide, dsid, line_no, 'R18', CASE WHEN mult = '' THEN 'multipolarity quoted from Adopted is not given' ELSE 'multipolarity quoted from Adopted differs' END FROM x WHERE mq AND mult <> '[E2]' AND mult <> am
      UNION ALL SELECT nuclide, dsid, line_no, 'R13', 'energy quoted from Adopted differs' FROM x WHERE said_e AND e <> ae
      UNION ALL SELECT nuclide, dsid, line_no, 'R18', 'multipolarity quoted from Adopted, which has no such gamma' FROM x WHERE said AND ag IS NULL AND mult NOT IN ('', '[E2]')
      UNION ALL SELECT nuclide, dsid, z.line_no, 'R14', 'value quoted in a comment differs from Adopted' FROM z JOIN orders ON o_custkey = level AND o_orderkey % 11 = 0 WHERE aj <> '2+'
      UNION ALL SELECT nuclide, dsid, line_no, 'R24', 'energy differs from the adopted gamma' FROM x WHERE abs(e - ae) >= greatest(2.0::DOUBLE, 1.5::DOUBLE * sqrt(50.0::DOUBLE)))
    SELECT nuclide, dsid, line_no, CASE WHEN rule IN ('R10', 'R13', 'R14', 'R17', 'R18') THEN 'E' ELSE 'W' END AS severity, rule, message FROM told""")
def checked_nuclides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as levels, suppliers as adopted ones, orders as gammas and comments."""
    c, k, s = F.col, F.col("c_custkey"), F.col("s_suppkey")
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    half = ("5 NS", "5000 PS", "3 US", "", "")
    # Halves of a last digit as C prints and casts them: by the number, to the even one.
    whole = lambda x: F.call_function("format_number", F.abs(x), F.lit("0.0"))
    # Names of adopted levels are apart from the others' and ascend with their keys.
    top = lambda key: key - 1_000_000_000_000
    own = table(spark, sf_dir, "customer").select(c("c_nationkey").alias("nuclide"), F.when(k % 7 == 0, "34P B+ DECAY").otherwise(c("c_mktsegment")).alias("dsid"), k.alias("level"), (10 * k).alias("line_no"), whole(c("c_acctbal")).alias("energy_text"), F.lit("5").alias("unc_text"), pick(_J, k).alias("jpi_text"), pick(half, k).alias("t12_text"))
    best = table(spark, sf_dir, "supplier").select(c("s_nationkey").alias("nuclide"), F.lit("ADOPTED").alias("dsid"), top(s).alias("level"), F.lit(-1).cast("long").alias("line_no"), F.round(F.abs("s_acctbal")).cast("long").cast("string").alias("energy_text"), F.lit("1").alias("unc_text"), pick(_J, s).alias("jpi_text"), pick(half, s).alias("t12_text"))
    o = c("o_orderkey")
    orders = table(spark, sf_dir, "orders").join(own.select("nuclide", "dsid", c("level").alias("o_custkey")), "o_custkey")
    lines = orders.select("nuclide", "dsid", o.alias("gamma"), c("o_custkey").alias("level"), (10 * c("o_custkey") + 1 + o % 7).alias("line_no"), (F.rint("o_totalprice").cast("long") % 900).cast("string").alias("energy_text"), F.lit("").alias("unc_text"), pick(("M1+E2", "(E1)", "[E2]", "", ""), o).alias("mult"))
    p = c("p_partkey")
    adopted_lines = table(spark, sf_dir, "part").select(top(1 + p % 50).alias("level"), (1_000_000_000 + p).alias("gamma"), (F.rint("p_retailprice").cast("long") % 900).cast("string").alias("energy_text"), pick(("M1+E2", "E1", ""), p).alias("mult"))
    adopted_lines = adopted_lines.join(best.select("level", "nuclide", "dsid"), "level").withColumns({"line_no": F.lit(-1).cast("long"), "unc_text": F.lit("")})
    notes = orders.select("nuclide", "dsid", F.lit("level").alias("record"), c("o_custkey").alias("key"), pick(("E", "J", "T"), o).alias("field"), F.when(o % 8 < 3, "From Adopted Levels").otherwise("measured here").alias("body"))
    notes = notes.unionByName(orders.where(o % 9 == 0).select("nuclide", "dsid", F.lit("gamma").alias("record"), o.alias("key"), F.lit("M").alias("field"), F.lit("from adopted gammas").alias("body")))
    notes = notes.unionByName(orders.where(o % 10 == 0).select("nuclide", "dsid", F.lit("gamma").alias("record"), o.alias("key"), F.lit("E").alias("field"), F.lit("From Adopted Gammas").alias("body")))
    notes = notes.unionByName(orders.where(o % 11 == 0).select("nuclide", "dsid", F.lit("level").alias("record"), c("o_custkey").alias("key"), F.lit("J").alias("field"), F.lit("2+ from Adopted Levels").alias("body")))
    return checks.check_nuclides(own.unionByName(best), lines.unionByName(adopted_lines), notes).select("nuclide", "dsid", "line_no", "severity", "rule", "message")


_CANDIDATES = """l AS (SELECT c_nationkey AS n, c_mktsegment AS ds, c_custkey AS level, abs(c_acctbal) AS x, CASE WHEN c_custkey % 2 = 0 THEN printf('%.2f', abs(c_acctbal)) ELSE CAST(CAST(round(abs(c_acctbal)) AS BIGINT) AS VARCHAR) END AS t, CASE WHEN c_custkey % 4 = 0 THEN 70.0::DOUBLE END AS dx, c_custkey % 6 = 0 AS doubt,
      CASE c_custkey % 4 WHEN 0 THEN '2+' WHEN 1 THEN '3-' WHEN 2 THEN '2+,3+' ELSE '' END AS j, c_custkey % 5 < 3 AS said FROM customer),
    a AS (SELECT s_nationkey AS n, abs(s_acctbal) AS y, CASE s_suppkey % 3 WHEN 0 THEN ['BUILDING', 'AUTOMOBILE'] WHEN 1 THEN ['MACHINERY', 'BUILDING'] ELSE ['FURNITURE'] END AS xref, CASE s_suppkey % 4 WHEN 0 THEN '2+' WHEN 1 THEN '3-' WHEN 2 THEN '2+,3+' ELSE '' END AS aj FROM supplier),
    k AS (SELECT level, count(*) AS m, count(*) FILTER (list_contains(xref, ds)) AS li, count(*) FILTER (list_contains(xref, ds) AND abs(x - y) > 20) AS bad, count(*) FILTER (NOT list_contains(xref, ds) AND abs(x - y) <= 20) AS mis, min(abs(x - y)) AS d, list(DISTINCT aj) AS js FROM l JOIN a ON a.n = l.n AND abs(x - y) <= 400 GROUP BY 1),
    c AS (SELECT l.*, coalesce(m, 0) AS m, coalesce(li, 0) AS li, coalesce(bad, 0) AS bad, coalesce(mis, 0) AS mis, d, js, greatest(60, coalesce(dx, 0)) AS small, greatest(100, coalesce(dx, 0)) AS large FROM l LEFT JOIN k USING (level))"""


def _level_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, s = F.col, F.col("c_custkey"), F.col("s_suppkey")
    names = lambda *some: F.array(*map(F.lit, some))
    text = F.when(k % 2 == 0, F.format_string("%.2f", F.abs("c_acctbal"))).otherwise(F.round(F.abs("c_acctbal")).cast("long").cast("string"))
    rows = table(spark, sf_dir, "customer").select(c("c_nationkey").alias("n"), c("c_mktsegment").alias("dsid"), k.alias("level"), F.abs("c_acctbal").alias("x"), text.alias("energy_text"), F.when(k % 4 == 0, 70.0).alias("dx"), (k % 6 == 0).alias("questionable"), _choice(_J, k).alias("jpi_text"), (k % 5 < 3).alias("is_quoted"))
    best = table(spark, sf_dir, "supplier").select(c("s_nationkey").alias("n"), s.alias("adopted"), F.abs("s_acctbal").alias("y"), F.when(s % 3 == 0, names("BUILDING", "AUTOMOBILE")).when(s % 3 == 1, names("MACHINERY", "BUILDING")).otherwise(names("FURNITURE")).alias("xref"), _choice(_J, s).alias("jpi_text"))
    return adopted.match_candidates(rows, best, ["n"], 400.0, 20.0)


@query(f"""WITH {_CANDIDATES},
    g AS (SELECT level, CASE WHEN m = 0 THEN 'W' WHEN li = 0 THEN CASE WHEN doubt THEN 'W' ELSE 'E' END ELSE 'W' END AS severity,
      CASE WHEN m = 0 THEN CASE WHEN doubt THEN 'questionable ' ELSE '' END || 'level not placed in Adopted' || CASE WHEN contains(t, '.') THEN ' or discrepant' ELSE '' END
        WHEN m = 1 AND li = 0 THEN 'tag of the dataset is missing in the cross-reference' WHEN m = 1 AND d > large THEN 'energy is largely discrepant from Adopted' WHEN m = 1 AND d > small THEN 'energy is discrepant from Adopted'
        WHEN m > 1 AND li = 0 THEN m || ' possible matches in Adopted, none with the tag of the dataset'
        WHEN m > 1 AND bad + mis > 0 THEN m || ' possible matches in Adopted, ' || CASE WHEN bad > 0 AND mis > 0 THEN 'missing and incorrect' WHEN bad > 0 THEN 'incorrect' ELSE 'missing' END || ' cross-reference' END AS message FROM c)
    SELECT level, severity, 'R23' AS rule, message FROM g WHERE message IS NOT NULL""")
def level_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers graded by the suppliers in reach and their cross-references."""
    return rules.level_grades(_level_candidates(spark, sf_dir), ["level"])


@query(f"""WITH {_CANDIDATES} SELECT level, 'R14' AS rule, 'spin-parity quoted from Adopted is that of none of its levels' AS message FROM c WHERE said AND len(js) > 1 AND NOT list_contains(js, j)""")
def spins_of_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted spins of customers with several suppliers in reach."""
    return rules.several_spins_rule(_level_candidates(spark, sf_dir), ["level"])


@query(r"""WITH t AS (SELECT DISTINCT l_orderkey AS k, CASE l_returnflag WHEN 'N' THEN '3' ELSE l_returnflag END || l_suppkey % 10 AS tag FROM lineitem),
    x AS (SELECT k, 'XREF=' || string_agg(tag, '' ORDER BY CASE WHEN tag < 'A' THEN '0' ELSE '1' END || tag, tag) AS x FROM t GROUP BY 1)
    SELECT o_orderkey AS level, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(x, 'none') ELSE 'XREF=OLD' END AS xref FROM orders LEFT JOIN x ON k = o_orderkey""")
def new_cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adopted datasets (50 files of levels) in which each third level gets new
    cross-references; all else stays."""
    c, key = F.col, F.col("o_orderkey")
    file = lambda k: F.concat(F.lit("log"), (k % 50).cast("string"))
    lines = table(spark, sf_dir, "orders").select(file(key).alias("file"), F.posexplode(F.array(F.concat(F.lit(" 34S   L "), key.cast("string")), F.lit(" 34S X L XREF=OLD"), F.lit(" 34S  cL J$stays"))).alias("at", "line"), (key * 3).alias("first"))
    records = lines.select("file", (c("first") + c("at")).alias("line_no"), F.rpad("line", 80, " ").alias("line"))
    tags = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("level"), F.concat(F.when(c("l_returnflag") == "N", "3").otherwise(c("l_returnflag")), (c("l_suppkey") % 10).cast("string")).alias("tag")).distinct()
    tags = tags.withColumns({"marker": F.lit(None).cast("string"), "energy": F.lit(1.0), "energy_text": F.lit("1"), "adopted_energy": F.lit(1.0)})
    new = best_values.cross_reference_lines(tags, ["level"])
    third = table(spark, sf_dir, "orders").where(key % 3 == 0).select(key.alias("level")).join(new, "level", "left").select(file(c("level")).alias("file"), (c("level") * 3).alias("owner"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    patched = comment_records.patch_xrefs(records, third)
    own = comment_records.owned_in_blocks(patched)
    found = own.groupBy("file", "owner").agg(F.max(F.when(c("line_no") == c("owner"), F.trim(F.substring("line", 10, 71)).try_cast("long"))).alias("level"), F.max(F.when(F.substring("line", 6, 1) == "X", F.trim(F.substring("line", 10, 71)))).alias("xref"))
    return found.select("level", F.coalesce("xref", F.lit("none")).alias("xref"))


# --- reference tables in versions ------------------------------------------------

_MASSES = """m AS (SELECT c_custkey % 97 AS nuclide, DATE '1992-01-01' + CAST(c_custkey * 7 % 2600 AS INTEGER) AS since, c_custkey AS version, c_acctbal AS excess, 2 * (c_custkey % 4) AS two_j, CASE c_custkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' END AS parity FROM customer),
    i AS (SELECT *, lead(since) OVER (PARTITION BY nuclide ORDER BY since, version) AS until FROM m)"""


def _masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    since = F.date_add(F.lit("1992-01-01").cast("date"), (k * 7 % 2600).cast("int"))
    return table(spark, sf_dir, "customer").select((k % 97).alias("nuclide"), since.alias("since"), k.alias("version"), F.col("c_acctbal").alias("excess"), (2 * (k % 4)).alias("two_j"), F.when(k % 3 == 0, "-").when(k % 3 == 1, "+").alias("parity"))


@query(f"""WITH {_MASSES}, p AS (SELECT o_orderkey, o_custkey % 97 AS parent, (o_custkey + 1) % 97 AS daughter, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice / 100 END AS q FROM orders),
    j AS (SELECT p.*, a.excess - b.excess AS adopted_q FROM p LEFT JOIN i a ON a.nuclide = parent AND a.since <= date AND (a.until IS NULL OR date < a.until) LEFT JOIN i b ON b.nuclide = daughter AND b.since <= date AND (b.until IS NULL OR date < b.until))
    SELECT o_orderkey, 'R11' AS rule, CASE WHEN adopted_q IS NULL THEN 'no masses of that time' ELSE 'parent Q-value differs from the masses' END AS message FROM j WHERE q IS NOT NULL AND (adopted_q IS NULL OR abs(q - adopted_q) > 500)""")
def decay_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-values against masses as of the date of the order."""
    c = F.col
    parents = table(spark, sf_dir, "orders").select("o_orderkey", (c("o_custkey") % 97).alias("parent"), ((c("o_custkey") + 1) % 97).alias("daughter"), c("o_orderdate").cast("date").alias("date"), F.when(c("o_orderkey") % 6 > 0, c("o_totalprice") / 100).alias("q"))
    return reference_tables.decay_energy_rule(reference_tables.with_decay_energy(parents, _masses(spark, sf_dir)), "o_orderkey", 500.0)


@query("""WITH t AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'E1' WHEN 1 THEN 'M1' ELSE 'E2' END AS mult, s_nationkey % 5 * 20 AS low, s_nationkey % 5 * 20 + 19 AS high, DATE '1992-01-01' + CAST(s_suppkey * 29 % 2500 AS INTEGER) AS since, s_suppkey AS version, 10 * abs(s_acctbal) AS lim FROM supplier),
    i AS (SELECT *, lead(since) OVER (PARTITION BY mult, low ORDER BY since, version) AS until FROM t),
    g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 5 WHEN 0 THEN 'E1' WHEN 1 THEN '(M1+E2)' WHEN 2 THEN '[E2]' WHEN 3 THEN '' ELSE 'D' END AS mult, l_partkey % 100 AS mass, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS strength FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'R20' AS rule, 'transition strength is above the recommended upper limit' AS message
    FROM g JOIN i ON i.mult = regexp_extract(g.mult, '[EM][0-9]') AND mass BETWEEN low AND high AND since <= date AND (until IS NULL OR date < until) WHERE strength > lim""")
def strengths_above_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths against limits of their multipolarity, mass and time."""
    c, k = F.col, F.col("s_suppkey")
    since = F.date_add(F.lit("1992-01-01").cast("date"), (k * 29 % 2500).cast("int"))
    low = F.col("s_nationkey") % 5 * 20
    limits = table(spark, sf_dir, "supplier").select(F.when(k % 3 == 0, "E1").when(k % 3 == 1, "M1").otherwise("E2").alias("mult"), low.alias("low"), (low + 19).alias("high"), since.alias("since"), k.alias("version"), (10 * F.abs("s_acctbal")).alias("limit"))
    names = F.element_at(F.array(*map(F.lit, ("E1", "(M1+E2)", "[E2]", "", "D"))), (c("l_partkey") % 5 + 1).cast("int"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    gammas = table(spark, sf_dir, "lineitem").select(*keys, names.alias("mult"), (c("l_partkey") % 100).alias("mass"), c("l_shipdate").cast("date").alias("date"), c("l_extendedprice").alias("strength"))
    return reference_tables.strength_rule(reference_tables.with_limits(gammas, limits), keys)


@query(f"""WITH {_MASSES}, r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 97 AS target, CAST(l_shipdate AS DATE) AS date, l_linenumber % 4 AS lt, 2 * (l_suppkey % 5) AS j, CASE WHEN l_suppkey % 2 = 0 THEN '+' ELSE '-' END AS p FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN j < abs(two_j - 2 * lt) OR j > two_j + 2 * lt OR (j - two_j) % 2 <> 0 THEN 'adopted spin is outside the range of the transfer' ELSE 'adopted parity does not fit the transfer' END AS message
    FROM r JOIN i ON nuclide = target AND since <= date AND (until IS NULL OR date < until)
    WHERE j < abs(two_j - 2 * lt) OR j > two_j + 2 * lt OR (j - two_j) % 2 <> 0 OR CASE WHEN lt % 2 = 1 THEN CASE parity WHEN '+' THEN '-' WHEN '-' THEN '+' END ELSE parity END <> p""")
def transfers_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers against the spin of the target as of the date."""
    c = F.col
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(*keys, (c("l_partkey") % 97).alias("target"), c("l_shipdate").cast("date").alias("date"), (c("l_linenumber") % 4).alias("lt"), (2 * (c("l_suppkey") % 5)).alias("j"), F.when(c("l_suppkey") % 2 == 0, "+").otherwise("-").alias("p"))
    found = reference_tables.with_targets(rows, _masses(spark, sf_dir))
    message = adopted.l_transfer_conflict(c("two_j_target"), c("target_parity"), 2 * c("lt"), c("lt"), c("j"), c("p"))
    return found.select(*keys, message.alias("message")).where("message IS NOT NULL")


@query("""SELECT s_suppkey, lpad(s_nationkey || 'XY', 5, ' ') || '  ' || CASE WHEN s_suppkey % 2 = 0 THEN 'L' ELSE 'G' END || ' ' || rpad(CAST(CAST(abs(round(s_acctbal)) AS BIGINT) AS VARCHAR), 10, ' ') || rpad(CAST(s_suppkey % 9 AS VARCHAR), 2, ' ') || ' ' || rpad('(1,2)+', 58, ' ') AS line FROM supplier""")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.col("s_nationkey").cast("string"), F.lit("XY")).alias("nucid"), F.when(k % 2 == 0, "L").otherwise("G").alias("record"), F.abs(F.round("s_acctbal")).cast("long").cast("string").alias("energy_text"), (k % 9).cast("string").alias("uncertainty_text"), F.lit("(1,2)+").alias("field"))
    return reports.record_lines(rows).select("s_suppkey", "line")


@query("""SELECT c_custkey AS id, CAST(CASE WHEN lead(c_acctbal) OVER w - c_acctbal < 150 THEN -30 ELSE 0 END + CASE WHEN c_acctbal - lag(c_acctbal) OVER w < 150 THEN 30 ELSE 0 END AS INT) AS "offset", CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INT) AS "column"
    FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey)""")
def plot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    return reports.plot_table(rows, ["nation"]).select("id", "offset", "column")


# --- rules ------------------------------------------------------------------------


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("level"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 3).alias("dsid"), F.col("c_acctbal").alias("x"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("adopted"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("y"), F.array(F.col("s_suppkey") % 3).alias("xref"))
    return adopted.match_adopted(levels, known, ["nation"], 200.0, 100.0)


_MATCHED = """n AS (SELECT c_custkey AS level, s_suppkey AS adopted, s_suppkey % 3 = c_custkey % 3 AS listed, abs(c_acctbal - s_acctbal) AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY s_suppkey % 3 = c_custkey % 3 DESC, abs(c_acctbal - s_acctbal), s_suppkey) AS place
      FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 200)"""


@query(f"""WITH {_MATCHED}, m AS (SELECT c_custkey AS level, n.adopted, n.listed, n.d FROM customer LEFT JOIN n ON n.level = c_custkey AND n.place = 1)
    SELECT level, CASE WHEN d > 100 THEN 'R24' ELSE 'R23' END AS rule, CASE WHEN adopted IS NULL THEN 'no adopted record' WHEN d > 100 THEN 'energy is discrepant from the adopted record' ELSE 'tag of the dataset is missing in the cross-reference' END AS message
    FROM m WHERE adopted IS NULL OR d > 100 OR NOT listed""")
def status_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.status_rule(_matches(spark, sf_dir), "level")


@query(f"WITH {_MATCHED} SELECT s_suppkey AS adopted, 'R23' AS rule, 'adopted record has no record of a dataset' AS message FROM supplier WHERE s_suppkey NOT IN (SELECT adopted FROM n WHERE place = 1)")
def extra_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("adopted"))
    return rules.extra_adopted(known, _matches(spark, sf_dir), "adopted")


@query("""WITH tags AS (SELECT p_partkey AS level, 'T' || p_size % 8 AS tag, CASE p_partkey % 7 WHEN 0 THEN '*' WHEN 1 THEN '?' WHEN 2 THEN 'S' WHEN 3 THEN CAST(p_size AS VARCHAR) WHEN 4 THEN 'x1' END AS marker FROM part),
    m AS (SELECT p_partkey AS level, 'T' || u.k AS tag, CAST(p_partkey * 31 % 200 + u.k AS DOUBLE) AS distance, CAST(p_size + p_partkey % 2 AS VARCHAR) AS energy_text FROM part, (SELECT unnest(range(0, 8, 2)) AS k) u),
    j AS (SELECT t.level, t.tag, coalesce(marker, '') AS marker, substr(t.tag, 2) < '6' AS known, m.distance, m.energy_text FROM tags t LEFT JOIN m USING (level, tag))
    SELECT level, tag, 'tag names no dataset' AS message, 'R7' AS rule FROM j WHERE NOT known UNION ALL SELECT level, tag, 'dataset has no such level', 'R7' FROM j WHERE known AND distance IS NULL AND marker <> 'S'
    UNION ALL SELECT level, tag, 'level is discrepant and has no note', 'R7' FROM j WHERE distance > 50 AND marker = '' UNION ALL SELECT level, tag, 'note does not give the level''s energy', 'R7' FROM j WHERE known AND marker NOT IN ('', '*', '?', 'S') AND marker IS DISTINCT FROM energy_text
    UNION ALL SELECT level, tag, 'dataset is missing in the cross-reference', 'R7' FROM m WHERE distance <= 50 AND tag IN ('T0', 'T2') AND NOT EXISTS (SELECT 1 FROM tags t WHERE t.level = m.level AND t.tag = m.tag)""")
def level_cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part")
    mark = F.when(k % 7 == 0, "*").when(k % 7 == 1, "?").when(k % 7 == 2, "S").when(k % 7 == 3, s.cast("string")).when(k % 7 == 4, "x1")
    tags = part.select(k.alias("level"), F.concat(F.lit("T"), (s % 8).cast("string")).alias("tag"), mark.alias("marker"))
    datasets = spark.createDataFrame([(f"T{n}", n == 4) for n in range(6)], "tag string, is_theory boolean")
    matches = part.select(k.alias("level"), F.explode(F.array(*map(F.lit, range(0, 8, 2)))).alias("n"), k, s).select("level", F.concat(F.lit("T"), F.col("n").cast("string")).alias("tag"), (k * 31 % 200 + F.col("n")).cast("double").alias("distance"), (s + k % 2).cast("string").alias("energy_text"))
    return rules.level_xref_rule(tags, datasets, matches, 50.0)


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 6 <> 0 THEN l_suppkey END AS i, l_returnflag = 'A' AS u FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, 'R25' AS rule, CASE WHEN u THEN 'unplaced gamma has an initial level' ELSE 'gamma stands before the first level' END AS message FROM g WHERE u AND i IS NOT NULL OR NOT u AND i IS NULL""")
def unplaced_gammas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(c("l_suppkey") % 6 != 0, c("l_suppkey")).alias("initial_level"), F.lit(None).alias("final_level"), (c("l_returnflag") == "A").alias("is_unplaced"))
    return rules.unplaced_rule(rows, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("""WITH m AS (SELECT l_orderkey AS band, l_extendedprice AS e, l_linenumber AS j, l_returnflag AS p FROM lineitem), o AS (SELECT *, row_number() OVER w AS n, coalesce(j < lag(j) OVER w, false) AS f FROM m WINDOW w AS (PARTITION BY band ORDER BY e, j)),
    b AS (SELECT band, bool_or(f) AS falls, max(p) FILTER (n = 1) AS low FROM o GROUP BY 1), h AS (SELECT b.*, CASE WHEN o_orderkey % 2 = 0 THEN 'R' ELSE 'N' END AS head FROM b JOIN orders ON o_orderkey = band)
    SELECT band, 'R19' AS rule, 'head of the band is not its lowest member' AS message FROM h WHERE head <> low UNION ALL SELECT band, 'R19', 'spins do not rise along the band' FROM h WHERE falls""")
def band_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("band"), F.col("l_extendedprice").alias("energy"), F.col("l_linenumber").alias("two_j"), F.col("l_returnflag").alias("jpi"))
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("band"), F.when(F.col("o_orderkey") % 2 == 0, "R").otherwise("N").alias("head_jpi"))
    return rules.band_head_rule(members, heads)


@query("""WITH g AS (SELECT o_orderkey AS gamma, o_custkey AS i, 1 + o_orderkey % 100 AS f FROM orders WHERE o_orderstatus = 'F'), m AS (SELECT c_custkey AS level, c_nationkey AS band FROM customer WHERE c_custkey % 3 <> 0)
    SELECT gamma, 'R19' AS rule, 'transition leaves the band' AS message FROM g LEFT JOIN m a ON a.level = i LEFT JOIN m b ON b.level = f WHERE a.band IS NULL OR b.band IS NULL OR a.band <> b.band""")
def in_band_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    gammas = table(spark, sf_dir, "orders").select(k.alias("gamma"), F.col("o_custkey").alias("initial"), (1 + k % 100).alias("final"), (F.col("o_orderstatus") == "F").alias("in_band"))
    members = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("level"), F.col("c_nationkey").alias("band"))
    return rules.in_band_rule(gammas, members)


_EVERY_LEVEL = _told_sql(_LEVEL_COLUMNS, "part", "p_partkey", _LEVEL_TOLD)
_EVERY_GAMMA = _told_sql(_GAMMA_COLUMNS, "lineitem", "l_orderkey, l_linenumber, l_partkey", _GAMMA_TOLD)


@query(f"SELECT 'level' AS kind, CAST(p_partkey AS VARCHAR) AS key, rule, message FROM ({_EVERY_LEVEL}) UNION ALL SELECT 'gamma', l_orderkey || '/' || l_linenumber || '/' || l_partkey, rule, message FROM ({_EVERY_GAMMA})")
def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over every level and gamma of all datasets."""
    levels = rule_levels(spark, sf_dir)
    gammas = table(spark, sf_dir, "lineitem").selectExpr(*_expressions(_GAMMA_COLUMNS.replace('"', "`")))
    even, odd = F.array(F.lit("E2"), F.lit("E4")), F.array(F.lit("E1"), F.lit("M2"))
    gammas = gammas.withColumn("expected_mult", F.when(F.col("level_index") % 2 == 0, even).otherwise(odd)).withColumn("gamma_key", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey"))
    return rules.check_datasets(levels, gammas, "p_partkey", "gamma_key")
