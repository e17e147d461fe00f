"""All rules over all datasets of all nuclides, from levels, gammas and comments.

One plan makes what the rules need: each level's adopted level and each gamma's
adopted gamma, the final levels, what comments say was quoted from Adopted, options of
spins, and the multipolarities that they allow.  Then every rule whose columns are
there is evaluated in one pass over the levels and one over the gammas, and the
messages come out by dataset and line, with a severity.

``levels``: nuclide, dsid, level, line_no, energy_text, unc_text, jpi_text, t12_text;
``gammas``: nuclide, dsid, gamma, level, line_no, energy_text, unc_text, mult;
``comments``: nuclide, dsid, record (``level`` or ``gamma``), key (of it), field and
body.  Keys are unique in a nuclide.  Records whose energy is no number are not
matched; a dataset without an adopted one in its nuclide has messages on itself only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchengine.durable import discard, keep
from matchengine.functions import comments as cm
from matchengine.functions import nuclear
from matchengine.functions import text as tx
from matchengine.operators import adopted, pairs, rules

# Reaches in keV of adopted levels and gammas and of final levels, and
# what counts as discrepant.
LEVEL_REACH, DISCREPANT, GAMMA_REACH, FINAL_REACH = 50.0, 10.0, 5.0, 50.0
#: Rules whose messages are errors; the others' are warnings.
ERRORS = ("R10", "R13", "R14", "R17", "R18")


def option_texts(jpi: Column) -> Column:
    """Options of a spin-parity text as texts such as 4+ (twice the spin)."""
    return F.transform(tx.parse_spin_parity(jpi), lambda o: F.concat(o["twoTimesSpin"].cast("string"), F.coalesce(o["parity"], F.lit(""))))


def single_spin(jpi: Column) -> Column:
    """(two_j, parity) of a text of one option; null for none or several."""
    options = tx.parse_spin_parity(jpi)
    return F.when(F.size(options) == 1, F.struct(F.get(options, 0)["twoTimesSpin"].alias("two_j"), F.get(options, 0)["parity"].alias("parity")))


def quoted_fields(comments: DataFrame) -> DataFrame:
    """nuclide, dsid, record, key and the fields that a comment says are quoted."""
    said = comments.where(cm.says_from_adopted(F.col("body"), F.col("field")))
    return said.groupBy("nuclide", "dsid", "record", "key").agg(F.collect_set("field").alias("quoted"))


def matched_levels(levels: DataFrame, name: str) -> DataFrame:
    """Levels of all but the adopted dataset with their adopted one: energy, adopted
    level and its texts, distance and status."""
    energy = tx.number_in(F.trim("energy_text"), "double")
    known = levels.withColumn("energy", energy).where("energy IS NOT NULL")
    seekers = known.where(F.col("dsid") != name).select("nuclide", "level", "dsid", F.col("energy").alias("x"))
    top = known.where(F.col("dsid") == name).select("nuclide", F.col("level").alias("adopted"), F.col("energy").alias("y"), F.array().cast("array<string>").alias("xref"))
    found = adopted.match_adopted(seekers, top, ["nuclide"], LEVEL_REACH, DISCREPANT).select("level", "adopted", "distance", "status")
    told = known.where(F.col("dsid") == name).select(F.col("level").alias("adopted"), F.col("energy").alias("adopted_energy"), F.col("energy_text").alias("adopted_text"), F.col("jpi_text").alias("adopted_jpi"), F.col("t12_text").alias("adopted_t12"))
    return known.where(F.col("dsid") != name).join(found, "level").join(told, "adopted", "left")


def final_levels(gammas: DataFrame, levels: DataFrame) -> DataFrame:
    """gamma, level_index, final_level_index (places of the levels by energy in their
    dataset), and the spins' texts of both."""
    order = Window.partitionBy("nuclide", "dsid").orderBy("energy", "level")
    placed = levels.withColumn("energy", tx.number_in(F.trim("energy_text"), "double")).where("energy IS NOT NULL").withColumn("place", F.row_number().over(order) - 1)
    start = placed.select("level", F.col("place").alias("level_index"), F.col("energy").alias("from"), F.col("jpi_text").alias("jpi_i"))
    lines = gammas.withColumn("energy", tx.number_in(F.trim("energy_text"), "double")).where("energy IS NOT NULL").join(start, "level").withColumn("left", F.col("from") - F.col("energy"))
    ends = placed.select("nuclide", "dsid", "place", F.col("energy").alias("to"))
    found = pairs.nearest(lines.select("nuclide", "dsid", "gamma", "left", "level_index", "jpi_i", "energy"), ends, F.col("left"), F.col("to"), ["gamma"], F.col("place"), FINAL_REACH, by=["nuclide", "dsid"])
    at = placed.select("nuclide", "dsid", F.col("place").alias("final_level_index"), F.col("jpi_text").alias("jpi_f"))
    return found.withColumn("final_level_index", F.col("nearest.tie")).join(at, ["nuclide", "dsid", "final_level_index"], "left").select("gamma", "level_index", "final_level_index", "jpi_i", "jpi_f")


def matched_gammas(gammas: DataFrame, at: DataFrame, name: str) -> DataFrame:
    """gamma and its adopted gamma: of the matched level, each the other's nearest.
    ``at``: level, adopted."""
    known = gammas.withColumn("energy", tx.number_in(F.trim("energy_text"), "double")).where("energy IS NOT NULL")
    one = known.where(F.col("dsid") != name).join(at, "level").select("dsid", "gamma", "adopted", "energy")
    two = known.where(F.col("dsid") == name).select(F.col("level").alias("adopted"), F.col("gamma").alias("adopted_gamma"), F.col("energy").alias("adopted_energy"), F.trim("unc_text").alias("adopted_unc_text"), F.col("energy_text").alias("adopted_text"), F.col("mult").alias("adopted_mult"))
    near = pairs.range_join(one, two, F.col("energy"), F.col("adopted_energy"), GAMMA_REACH, ["adopted"])
    # A level of one dataset may share its adopted level with another of it.
    mutual = pairs.mutual_nearest(near, "gamma", "adopted_gamma", F.abs(F.col("energy") - F.col("adopted_energy")), by=["dsid"])
    return mutual.select("gamma", "adopted_gamma", "adopted_energy", "adopted_text", "adopted_unc_text", "adopted_mult")


def expected(jpi_i: Column, jpi_f: Column) -> Column:
    """Multipolarities that single spins and parities allow; none where one is not."""
    i, f = single_spin(jpi_i), single_spin(jpi_f)
    known = i["parity"].isNotNull() & f["parity"].isNotNull()
    return F.when(F.coalesce(known, F.lit(False)), nuclear.multipolarities(i["two_j"], i["parity"], f["two_j"], f["parity"])).otherwise(F.array().cast("array<string>"))


def check_nuclides(levels: DataFrame, gammas: DataFrame, comments: DataFrame, name: str = "ADOPTED") -> DataFrame:
    """nuclide, dsid, line_no, severity (E or W), rule, message, of all datasets."""
    quoted = quoted_fields(comments)
    of = lambda record, key: quoted.where(F.col("record") == record).select("nuclide", "dsid", F.col("key").alias(key), "quoted")
    has = lambda field: F.coalesce(F.array_contains("quoted", field), F.lit(False))
    rows = matched_levels(levels, name).join(of("level", "level"), ["nuclide", "dsid", "level"], "left")
    rows = keep(
        rows.withColumns({
            "is_decay": F.col("dsid").contains("DECAY"), "jpi_options": option_texts(F.col("jpi_text")), "adopted_options": option_texts(F.col("adopted_jpi")), "t12_seconds": nuclear.half_life_seconds(F.col("t12_text")),
            "is_isomer": F.lit(False), "quoted_e": has("E"), "quoted_j": has("J"),
        }),
        "checked-levels",
    )
    key = ["nuclide", "dsid", "line_no"]
    both = rows.where("adopted IS NOT NULL")
    told = rules.level_rules()
    on = lambda flag, some: rules.check(both.withColumn("is_quoted", F.col(flag)), some, key)
    first = on("quoted_e", [r for r in told if r.name != "R14"]).unionByName(on("quoted_j", [r for r in told if r.name == "R14"]))
    has_adopted = levels.where(F.col("dsid") == name).select("nuclide").distinct()
    status = rules.status_rule(rows.join(has_adopted, "nuclide", "left_semi").select("level", "status", F.lit(True).alias("listed")), "level")
    second = rows.select(*key, "level").join(status, "level").select(*key, "rule", "message")

    lines = gammas.where(F.col("dsid") != name).withColumn("energy", tx.number_in(F.trim("energy_text"), "double"))
    spread = lines.join(final_levels(lines.drop("energy"), levels), "gamma").join(matched_gammas(gammas, both.select("level", "adopted"), name), "gamma", "left").join(of("gamma", "gamma"), ["nuclide", "dsid", "gamma"], "left")
    error = lambda value, unc: tx.energy_uncertainty(F.col(value), F.col(unc))["value"]
    spread = spread.withColumns({"mult": F.coalesce("mult", F.lit("")), "expected_mult": expected(F.col("jpi_i"), F.col("jpi_f")), "unc": error("energy_text", "unc_text"), "adopted_unc": error("adopted_text", "adopted_unc_text"), "mult_said": has("M"), "mult_quoted": has("M") & F.col("adopted_gamma").isNotNull(), "energy_quoted": has("E") & F.col("adopted_gamma").isNotNull()})
    third = rules.check(spread, rules.gamma_rules(), key)
    given = comments.withColumn("value", cm.adopted_value(F.col("body"), F.col("field"))).where("value <> ''").select("nuclide", "dsid", "record", "key", "field", "value")
    texts = both.select(*key, F.lit("level").alias("record"), F.col("level").alias("key"), F.inline(F.array(F.struct(F.lit("E").alias("field"), F.col("adopted_text").alias("adopted_text")), F.struct(F.lit("J").alias("field"), F.col("adopted_jpi").alias("adopted_text")))))
    texts = texts.unionByName(spread.select(*key, F.lit("gamma").alias("record"), F.col("gamma").alias("key"), F.inline(F.array(F.struct(F.lit("E").alias("field"), F.col("adopted_text")), F.struct(F.lit("M").alias("field"), F.col("adopted_mult").alias("adopted_text"))))))
    fourth = rules.quoted_value_rule(given.join(texts, ["nuclide", "dsid", "record", "key", "field"]), key)
    severity = F.when(F.col("rule").isin(*ERRORS), "E").otherwise("W")
    out = keep(first.unionByName(second).unionByName(third).unionByName(fourth).select(*key, severity.alias("severity"), "rule", "message"), "messages")
    discard(rows)
    return out
