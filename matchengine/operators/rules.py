"""Consistency rules: each turns matched records into messages.

A rule is a name, the columns it needs and a Column that is a message where the
rule is broken.  ``check`` evaluates all that apply in one pass over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchengine.functions import nuclear, text
from matchengine.operators import pairs


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    message: Column


# Keys of current references.
Q_REFERENCES = ("2021WA16",)
MOMENT_REFERENCES = {"M1": ("2019STZV", "2020STZV"), "E2": ("2021STZZ",)}


def _holds(value: Column, keys: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for key in keys:
        found = found | F.upper(F.coalesce(value, F.lit(""))).contains(key)
    return found


def _stale_moment(moment: Column, reference: Column) -> Column:
    """Message for a moment (M1 or E2) whose references and comments hold no
    current key."""
    chain = F.lit(None).cast("string")
    for kind, keys in MOMENT_REFERENCES.items():
        chain = F.when((moment == kind) & ~_holds(reference, keys), F.lit(f"reference of the {kind} moment is not current")).otherwise(chain)
    return chain


def level_rules() -> list[Rule]:
    c = F.col
    differs = F.abs(c("energy") - c("adopted_energy")) > 0
    rounded = text.rounded_like(c("adopted_energy"), c("energy_text")) == c("energy_text")
    hindrance = ("hf", "hf_unc", "hf_limit", "odd_mass", "same_jpi", "natural_parity")
    log_ft = ("log_ft", "log_ft_unc", "log_ft_limit", "dj", "parity_change", "unique")
    return [
        Rule("R3", ("q_reference", "q_uncertainties"), F.when((F.trim("q_reference") != "") & ~_holds(c("q_reference"), Q_REFERENCES) & ~_holds(c("q_uncertainties"), ("CA",)), F.concat(F.lit("stale Q-value reference "), c("q_reference")))),
        Rule("R8", ("moment", "moment_reference", "moment_comment"), _stale_moment(c("moment"), F.concat_ws(" ", "moment_reference", "moment_comment"))),
        Rule("R9", ("decay_type", "nb", "br"), F.when(c("decay_type").isNotNull() & c("nb").isNull() & (c("br") < 1), F.lit("NB is empty although BR is below 1"))),
        Rule("R10", ("dsid",), F.when(c("dsid").rlike(r"\bB\+ DECAY"), F.lit("B+ DECAY should be EC DECAY or EC+B+ DECAY"))),
        Rule("R13", ("energy", "energy_text", "adopted_energy", "is_quoted"), F.when(c("is_quoted") & differs & ~rounded, F.lit("energy quoted from Adopted differs"))),
        Rule("R14", ("jpi_text", "adopted_jpi", "is_quoted"), F.when(c("is_quoted") & (c("jpi_text") != c("adopted_jpi")), F.lit("spin-parity quoted from Adopted differs"))),
        Rule("R14", ("jpi_text", "adopted_jpi", "is_quoted", "is_decay", "jpi_options", "adopted_options"), F.when(~c("is_quoted"), F.when(c("is_decay") & (c("jpi_text") != c("adopted_jpi")), F.lit("spin-parity differs from Adopted")).when((F.size("jpi_options") > 0) & (F.size("adopted_options") > 0) & ~F.arrays_overlap("jpi_options", "adopted_options"), F.lit("spin-parity contradicts Adopted")))),
        Rule("R15", ("t12_text", "adopted_t12", "energy", "is_isomer", "t12_seconds"), F.when((c("energy") == 0) & (c("t12_text") == ""), F.lit("ground state has no half-life")).when(nuclear.half_lives_differ(c("t12_text"), c("adopted_t12")), F.lit("half-life differs from Adopted")).when((c("t12_seconds") >= 1e-7) & ~c("is_isomer"), F.lit("half-life of an isomer without its flag"))),
        Rule("R21", hindrance, nuclear.hindrance_conflict(*map(c, hindrance))),
        Rule("R21", ("hf", "hf_unc", "alpha", "alpha_unc", "to_ground"), F.when(c("to_ground"), nuclear.hindrance_spread(c("hf"), c("hf_unc"), c("alpha"), c("alpha_unc")))),
        Rule("R22", ("dj", "parity_change"), nuclear.log_ft_unlikely(c("dj"), c("parity_change"))),
        Rule("R22", log_ft, nuclear.log_ft_conflict(*map(c, log_ft))),
        Rule("R22", log_ft, nuclear.unique_flag_missing(*map(c, log_ft))),
        Rule("R22", ("log_ft", "log_ft_unc", "zero_to_zero"), nuclear.zero_to_zero_conflict(c("log_ft"), c("log_ft_unc"), c("zero_to_zero"))),
    ]


def gamma_rules() -> list[Rule]:
    c = F.col
    zero = ("two_ji", "two_jf", "parity_change")
    icc = ("energy", "z", "dj", "parity_change", "questionable")
    return [
        Rule("R13", ("energy", "energy_text", "adopted_energy", "energy_quoted"), F.when(c("energy_quoted") & (c("energy") != c("adopted_energy")) & ~(text.rounded_like(c("adopted_energy"), c("energy_text")) == c("energy_text")), F.lit("energy quoted from Adopted differs"))),
        Rule("R17", ("final_level_index", "level_index"), F.when(c("final_level_index").isNull(), F.lit("gamma has no final level")).when(c("final_level_index") >= c("level_index"), F.lit("final level is not below the initial one"))),
        Rule("R18", ("mult", "expected_mult"), F.when(nuclear.mult_unexpected(c("mult"), c("expected_mult")), F.lit("multipolarity does not fit the spins"))),
        Rule("R18", ("mult", "adopted_mult", "mult_quoted"), F.when(c("mult_quoted") & nuclear.mult_differs(c("mult"), c("adopted_mult")), F.when(c("mult") == "", "multipolarity quoted from Adopted is not given").otherwise("multipolarity quoted from Adopted differs"))),
        Rule("R18", ("mult", "mult_said", "adopted_gamma"), F.when(c("mult_said") & c("adopted_gamma").isNull() & (c("mult") != "") & ~c("mult").startswith("["), F.lit("multipolarity quoted from Adopted, which has no such gamma"))),
        Rule("R18", ("mixing", "adopted_mixing", "mixing_quoted"), F.when(c("mixing_quoted") & (F.trim("mixing") != F.trim("adopted_mixing")), F.lit("mixing ratio quoted from Adopted differs"))),
        Rule("R18", ("mult", "computed_text"), F.when(c("mult").contains("E0") & c("computed_text").contains("BE0"), F.lit("B(E0) should be from experiment"))),
        Rule("R18", zero, nuclear.zero_to_zero_gamma(*map(c, zero))),
        Rule("R18", ("icc", "is_absolute", *icc), F.when(c("is_absolute") & c("icc").isNull(), nuclear.icc_missing(*map(c, icc)))),
        Rule("R20", ("strength", "limit"), F.when(c("strength") > c("limit"), F.lit("transition strength is above the recommended upper limit"))),
        Rule("R24", ("energy", "adopted_energy", "unc", "adopted_unc"), F.when(F.abs(c("energy") - c("adopted_energy")) >= F.greatest(F.lit(2.0), 1.5 * F.sqrt(c("unc") * c("unc") + c("adopted_unc") * c("adopted_unc"))), F.lit("energy differs from the adopted gamma"))),
    ]


def check(rows: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """(key, rule, message) for every broken rule whose columns are there."""
    fit = [r for r in rules if set(r.needs) <= set(rows.columns)]
    told = F.array(*[F.struct(F.lit(r.name).alias("rule"), r.message.alias("message")) for r in fit]) if fit else F.array().cast("array<struct<rule:string,message:string>>")
    return rows.select(*key, F.explode(F.filter(told, lambda m: m["message"].isNotNull())).alias("m")).select(*key, "m.rule", "m.message")


def intensity_rule(gammas: DataFrame, level: list[str]) -> DataFrame:
    """Levels whose intensities are not normalised to a strongest of 100, or
    whose strongest line is undivided or questionable (R5)."""
    top = F.max("ri")
    per = gammas.where("ri IS NOT NULL").groupBy(*level).agg(F.count("*").alias("n_ri"), top.alias("strongest"), F.bool_or((F.col("ri") == 100) & (F.col("flag") == "&")).alias("undivided"), F.bool_or((F.col("ri") == 100) & (F.col("flag") == "?")).alias("questionable"))
    message = F.when((F.col("n_ri") > 1) & (F.col("strongest") != 100), "strongest intensity is not 100").when(F.col("undivided"), "strongest line is undivided").when(F.col("questionable"), "strongest line is questionable")
    return per.withColumn("message", message).where("message IS NOT NULL").select(*level, F.lit("R5").alias("rule"), "message")


def order_rule(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows that are lower than the one before (R17, order)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).where(F.col(value) < F.col("previous"))


def placement_rule(gammas: DataFrame, adopted: DataFrame, by: list[str], key: str, reach: float = 5.0) -> DataFrame:
    """Gammas that Adopted does not have at their level (R17): it has similar ones
    at other levels, or none within ``reach``.  ``gammas``: key, by, energy,
    adopted_gamma (null if none), questionable; ``adopted``: by, energy.  A
    questionable gamma may be missing.  A null energy is like no gamma's."""
    lost = gammas.where("adopted_gamma IS NULL").select(key, *by, "energy", "questionable")
    near = pairs.range_join(lost.drop("questionable"), adopted.select(*by, F.col("energy").alias("adopted_energy")), F.col("energy"), F.col("adopted_energy"), reach, by)
    similar = near.groupBy(key).agg(F.count("*").alias("n_similar"))
    message = F.when(F.col("n_similar") > 0, "similar gammas are placed elsewhere in Adopted").when(~F.coalesce("questionable", F.lit(False)), "no such gamma in Adopted")
    told = lost.join(similar, key, "left").withColumn("n_similar", F.coalesce("n_similar", F.lit(0)))
    return told.select(key, F.lit("R17").alias("rule"), message.alias("message"), "n_similar").where("message IS NOT NULL")


def band_rule(members: DataFrame) -> DataFrame:
    """Bands whose steps in spin are not constant."""
    w = Window.partitionBy("band").orderBy("energy", "level_id")
    steps = members.withColumn("dj", F.col("two_j") - F.lag("two_j").over(w)).where("dj IS NOT NULL")
    return steps.groupBy("band").agg(F.count_distinct("dj").alias("n_steps")).where("n_steps > 1")


def cross_reference_rule(tags: DataFrame, datasets: DataFrame) -> DataFrame:
    """Tags that name no dataset, and datasets without a tag."""
    unknown = tags.join(datasets, "dsid", "left_anti").select("dsid", F.lit("cross-reference names no dataset").alias("message"))
    missing = datasets.join(tags, "dsid", "left_anti").select("dsid", F.lit("dataset has no cross-reference tag").alias("message"))
    return unknown.unionByName(missing)


def patch_with_adopted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values of quoted columns replaced by the adopted ones."""
    return rows.withColumns({c: F.when(F.col("is_quoted") & F.col(f"adopted_{c}").isNotNull(), F.col(f"adopted_{c}")).otherwise(F.col(c)) for c in columns})


def status_rule(matches: DataFrame, key: str) -> DataFrame:
    """Messages on records by how they were matched to adopted ones.
    ``matches``: key, status (none, single, chosen, discrepant), listed."""
    message = (
        F.when(F.col("status") == "none", "no adopted record")
        .when(F.col("status") == "discrepant", "energy is discrepant from the adopted record")
        .when(~F.coalesce("listed", F.lit(False)), "tag of the dataset is missing in the cross-reference")
    )
    return matches.select(key, F.when(F.col("status") == "discrepant", "R24").otherwise("R23").alias("rule"), message.alias("message")).where("message IS NOT NULL")


def level_grades(matches: DataFrame, key: list[str]) -> DataFrame:
    """Messages on levels by how they and the cross-references of Adopted fit (R23):
    key, severity (E or W), rule and message.

    ``matches``, from ``adopted.match_candidates``: key, energy_text, questionable,
    n_matched, n_listed (of these whose cross-reference has the dataset), n_bad (listed,
    but far), n_missed (near, but not listed), distance (to the only one), small and
    large (what is discrepant, and largely so).  A questionable level's missing tag is
    a warning.
    """
    c = F.col
    doubt = F.coalesce("questionable", F.lit(False))
    told = lambda severity, message: F.struct(severity.alias("severity"), message.alias("message"))
    warn, strict = F.lit("W"), F.when(doubt, "W").otherwise("E")
    missing = F.concat(F.when(doubt, "questionable ").otherwise(""), F.lit("level not placed in Adopted"), F.when(c("energy_text").contains("."), " or discrepant").otherwise(""))
    wrong = F.when((c("n_bad") > 0) & (c("n_missed") > 0), "missing and incorrect").when(c("n_bad") > 0, "incorrect").otherwise("missing")
    several = F.concat(c("n_matched").cast("string"), F.lit(" possible matches in Adopted, "))
    grade = (
        F.when(c("n_matched") == 0, told(warn, missing))
        .when((c("n_matched") == 1) & (c("n_listed") == 0), told(strict, F.lit("tag of the dataset is missing in the cross-reference")))
        .when((c("n_matched") == 1) & (c("distance") > c("large")), told(warn, F.lit("energy is largely discrepant from Adopted")))
        .when((c("n_matched") == 1) & (c("distance") > c("small")), told(warn, F.lit("energy is discrepant from Adopted")))
        .when((c("n_matched") > 1) & (c("n_listed") == 0), told(strict, F.concat(several, F.lit("none with the tag of the dataset"))))
        .when((c("n_matched") > 1) & (c("n_bad") + c("n_missed") > 0), told(warn, F.concat(several, wrong, F.lit(" cross-reference"))))
    )
    return matches.select(*key, grade.alias("__g")).where("__g IS NOT NULL").select(*key, "__g.severity", F.lit("R23").alias("rule"), "__g.message")


def several_spins_rule(matches: DataFrame, key: list[str]) -> DataFrame:
    """Levels with several adopted ones whose quoted spin-parity is that of none of
    them (R14).  ``matches``: key, jpi_text, is_quoted, adopted_jpis (array)."""
    none = F.col("is_quoted") & (F.size("adopted_jpis") > 1) & ~F.array_contains("adopted_jpis", F.col("jpi_text"))
    return matches.where(F.coalesce(none, F.lit(False))).select(*key, F.lit("R14").alias("rule"), F.lit("spin-parity quoted from Adopted is that of none of its levels").alias("message"))


def quoted_value_rule(quotes: DataFrame, key: list[str]) -> DataFrame:
    """Values that a comment gives as adopted ones and that differ.
    ``quotes``: key, field (E, J or M), value (empty if none), adopted_text."""
    name = F.when(F.col("field") == "J", "R14").when(F.col("field") == "M", "R18").otherwise("R13")
    # An energy is compared with its uncertainty left out.
    value = F.when(F.col("field") == "E", F.regexp_extract("value", r"^(\S*)", 1)).otherwise(F.col("value"))
    return quotes.where((F.col("value") != "") & F.col("adopted_text").isNotNull() & (value != F.trim("adopted_text"))).select(*key, name.alias("rule"), F.lit("value quoted in a comment differs from Adopted").alias("message"))


def extra_adopted(adopted: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Adopted records that no record of any dataset was matched to."""
    used = matches.where(F.col(key).isNotNull()).select(key).distinct()
    return adopted.join(used, key, "left_anti").select(key, F.lit("R23").alias("rule"), F.lit("adopted record has no record of a dataset").alias("message"))


def level_xref_rule(tags: DataFrame, datasets: DataFrame, matches: DataFrame, tolerance: float) -> DataFrame:
    """Cross-references of adopted levels against what the datasets hold.

    ``tags``: level, tag, marker (text in parentheses, empty if none); ``datasets``:
    tag, is_theory; ``matches``: level, tag, distance (of the nearest level of that
    dataset), energy_text.  Marks: ``*`` and ``?`` for several or doubtful levels,
    ``S`` for a pseudo level; else the note is the level's energy in the dataset.
    """
    # Both are dealt by level once, over as many tasks however small they look: a task
    # sorts its share of them, and neither is sent whole to all.
    parts = int(tags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tags, matches = (frame.repartition(parts, "level", "tag").hint("merge") for frame in (tags, matches))
    known = datasets.select("tag", F.lit(True).alias("known"), "is_theory")
    rows = tags.join(known, "tag", "left").join(matches, ["level", "tag"], "left")
    mark = F.coalesce("marker", F.lit(""))
    note = (mark != "") & ~mark.isin("*", "?", "S", "*?", "?*")
    # try_cast: a note that is no number is a bad one whatever it says.
    told = F.array(
        F.when(F.col("known").isNull(), F.lit("tag names no dataset")),
        F.when(F.col("known") & F.col("distance").isNull() & (mark != "S"), F.lit("dataset has no such level")),
        F.when((F.col("distance") > tolerance) & (mark == ""), F.lit("level is discrepant and has no note")),
        F.when(note & F.col("known") & (F.coalesce(F.abs(mark.try_cast("double") - F.col("energy_text").try_cast("double")), F.lit(1e9)) > 0), F.lit("note does not give the level's energy")),
    )
    found = rows.select("level", "tag", F.explode(F.filter(told, lambda m: m.isNotNull())).alias("message"))
    missing = matches.where(F.col("distance") <= tolerance).join(datasets.where("NOT is_theory").select("tag"), "tag", "left_semi").join(tags, ["level", "tag"], "left_anti").select("level", "tag", F.lit("dataset is missing in the cross-reference").alias("message"))
    return found.unionByName(missing).withColumn("rule", F.lit("R7"))


def unplaced_rule(gammas: DataFrame, key: list[str]) -> DataFrame:
    """Unplaced gammas that a level scheme could place, or that feed one.
    ``gammas``: key, initial_level, final_level, is_unplaced."""
    message = F.when(F.col("is_unplaced") & F.col("initial_level").isNotNull(), "unplaced gamma has an initial level").when(~F.col("is_unplaced") & F.col("initial_level").isNull(), "gamma stands before the first level")
    return gammas.select(*key, F.lit("R25").alias("rule"), message.alias("message")).where("message IS NOT NULL")


def band_head_rule(members: DataFrame, heads: DataFrame) -> DataFrame:
    """Bands whose lowest member is not the head that the comment names, or whose
    members' spins do not rise with energy (R19).  ``members``: band, energy,
    two_j, jpi; ``heads``: band, head_jpi."""
    order = Window.partitionBy("band").orderBy("energy", "two_j")
    placed = members.withColumn("place", F.row_number().over(order)).withColumn("falls", F.coalesce(F.col("two_j") < F.lag("two_j").over(order), F.lit(False)))
    falling = placed.groupBy("band").agg(F.bool_or("falls").alias("falls"), F.max(F.when(F.col("place") == 1, F.col("jpi"))).alias("lowest"))
    joined = falling.join(heads, "band", "left")
    told = F.array(F.when(F.col("head_jpi").isNotNull() & (F.col("head_jpi") != F.col("lowest")), F.lit("head of the band is not its lowest member")), F.when(F.col("falls"), F.lit("spins do not rise along the band")))
    return joined.select("band", F.lit("R19").alias("rule"), F.explode(F.filter(told, lambda m: m.isNotNull())).alias("message"))


def in_band_rule(gammas: DataFrame, members: DataFrame) -> DataFrame:
    """Gammas flagged as in-band whose final level is in another band.
    ``gammas``: gamma, initial, final, in_band; ``members``: level, band."""
    band = lambda c, n: members.select(F.col("level").alias(c), F.col("band").alias(n))
    joined = gammas.where("in_band").join(band("initial", "b1"), "initial", "left").join(band("final", "b2"), "final", "left")
    return joined.where("b1 IS NULL OR b2 IS NULL OR b1 <> b2").select("gamma", F.lit("R19").alias("rule"), F.lit("transition leaves the band").alias("message"))


def check_datasets(levels: DataFrame, gammas: DataFrame, level_key: str, gamma_key: str) -> DataFrame:
    """All level and gamma rules over all records of all datasets: kind, key, rule
    and message (R1, R2, R4, R12 are this for single, adopted and level records)."""
    one = check(levels, level_rules(), [level_key]).select(F.lit("level").alias("kind"), F.col(level_key).cast("string").alias("key"), "rule", "message")
    two = check(gammas, gamma_rules(), [gamma_key]).select(F.lit("gamma").alias("kind"), F.col(gamma_key).cast("string").alias("key"), "rule", "message")
    return one.unionByName(two)
