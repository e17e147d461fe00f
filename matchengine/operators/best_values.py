"""The adopted dataset made from groups: a best value of each field, multipolarities,
bands, cross-references, and its records.

Every member of a group may bring a value of a field (E energy, T half-life, RI
intensity).  What is adopted follows from the best of four kinds there is:

1. ``average``: two or more firm values of one's own with uncertainties; the
   library's decision between averages, with the larger of its uncertainties;
2. ``firm``: the best firm value: one with an uncertainty, then one that is not
   questionable, then the more precise, then the first;
3. ``tentative``: values of members that are in several groups or doubtful (``*``,
   ``?``), of which the adopted record's counts, else the first;
4. ``quoted``: values that a dataset took from the adopted one; the adopted record's
   stays, and no source is named.

A multipolarity is the first firm one (E or M), else D, Q or O, else one in
parentheses; members that quote Adopted without an argument do not count.  Where no
member gives one, it is inferred from single spins of both levels, in brackets.

Null or empty texts are no values; a group without values of a field has no row for
it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchengine.durable import keep
from matchengine.functions import nuclear
from matchengine.functions import text as tx
from matchengine.operators import averages

#: Characters of a line after ``XREF=`` and columns of a record.
XREF_WIDTH, RECORD_WIDTH = 65, 80


def best_values(values: DataFrame, by: list[str]) -> DataFrame:
    """by, field, choice, value, uncertainty (texts) and source (a dataset, null for
    averages and quoted values).

    ``values``: by, field, dsid, place (order of the members), text, unc_text,
    tentative, quoted, questionable, is_adopted.  Texts that are no numbers may be
    chosen, not averaged.
    """
    key = [*by, "field"]
    known = values.where("trim(text) <> ''").withColumn("x", tx.number_in(F.trim("text"), "double"))
    error = tx.absolute_uncertainty(F.col("text"), F.col("unc_text"))
    # Written once: filters further on would read the texts again for each use of a number.
    known = keep(known.withColumn("dx", F.when(F.trim("unc_text").rlike("^[0-9]+$") & (error > 0), error)), "printed-values")
    own = known.where("NOT tentative AND NOT quoted")
    measured = own.where("x IS NOT NULL AND dx IS NOT NULL")
    decided = averages.average_decision(measured.select(*key, "x", "dx"), key, "x", "dx").where("n >= 2")
    spread = F.when(F.col("kind") == "Unweighted-Average", F.col("unweighted_error")).otherwise(F.greatest("internal", "external"))
    shown = tx.value_text(F.col("adopted"), F.greatest(spread, F.lit(1e-6)))
    averaged = decided.select(*key, F.regexp_extract(shown, r"^([^(]*)", 1).alias("a_value"), F.regexp_extract(shown, r"\(([0-9]+)\)$", 1).alias("a_uncertainty"))
    order = F.struct(F.col("dx").isNull().alias("a"), F.coalesce("questionable", F.lit(False)).alias("b"), F.coalesce("dx", F.lit(0.0)).alias("c"), F.col("place").alias("d"), F.col("dsid").alias("e"))
    chosen = F.struct(F.trim("text").alias("text"), F.coalesce(F.trim("unc_text"), F.lit("")).alias("unc_text"), "dsid")
    # The adopted record is first, else the order of the members.
    rest = F.struct((~F.col("is_adopted")).alias("a"), F.col("place").alias("b"), F.col("dsid").alias("c"))
    doubtful = F.col("tentative") & ~F.col("quoted")
    best = known.groupBy(*key).agg(
        F.min_by(F.when(~F.col("tentative") & ~F.col("quoted"), chosen), F.when(~F.col("tentative") & ~F.col("quoted"), order)).alias("firm"),
        F.min_by(chosen, F.when(doubtful, rest)).alias("doubtful"),
        F.min_by(chosen, rest).alias("first"),
    )
    joined = best.join(averaged, key, "left")
    choice = F.when(F.col("a_value").isNotNull(), "average").when(F.col("firm").isNotNull(), "firm").when(F.col("doubtful").isNotNull(), "tentative").otherwise("quoted")
    taken = F.when(F.col("choice") == "firm", F.col("firm")).when(F.col("choice") == "tentative", F.col("doubtful")).otherwise(F.col("first"))
    picked = joined.withColumn("choice", choice).withColumn("taken", taken)
    average = F.col("choice") == "average"
    return picked.select(
        *key,
        "choice",
        F.when(average, F.col("a_value")).otherwise(F.col("taken.text")).alias("value"),
        F.when(average, F.col("a_uncertainty")).otherwise(F.col("taken.unc_text")).alias("uncertainty"),
        F.when(F.col("choice").isin("firm", "tentative"), F.col("taken.dsid")).alias("source"),
    )


def inferred_multipolarity(two_ji: Column, parity_i: Column, two_jf: Column, parity_f: Column) -> Column:
    """Bracketed multipolarity of lowest order, with E2 beside M1; null where a spin
    or parity is unknown or none is allowed."""
    allowed = nuclear.multipolarities(two_ji, parity_i, two_jf, parity_f)
    first, second = F.get(allowed, 0), F.get(allowed, 1)
    both = (first == "M1") & F.coalesce(second == "E2", F.lit(False))
    return F.when(parity_i.isNotNull() & parity_f.isNotNull() & first.isNotNull(), F.concat(F.lit("["), F.when(both, F.lit("M1,E2")).otherwise(first), F.lit("]")))


def best_multipolarities(gammas: DataFrame, by: list[str]) -> DataFrame:
    """by, mult, mult_choice (firm, order, tentative, inferred or none) and source.

    ``gammas``: by, dsid, place, mult, quoted, argued (the multipolarity is argued for
    in a comment), two_ji, parity_i, two_jf, parity_f (of the level groups).
    """
    text = F.trim(F.coalesce("mult", F.lit("")))
    bare = F.regexp_replace(text, r"\([^()]*\)", "")
    rank = F.when((text == "") | text.startswith("[") | (F.col("quoted") & ~F.coalesce("argued", F.lit(False))), None).when(text.rlike(r"^\(.*\)$"), 3).when(bare.rlike("[EM]"), 1).otherwise(2)
    order = F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("place").alias("p"), F.col("dsid").alias("d")))
    inferred = inferred_multipolarity(F.col("two_ji"), F.col("parity_i"), F.col("two_jf"), F.col("parity_f"))
    found = gammas.groupBy(*by).agg(F.min(order).alias("o"), F.min_by(text, order).alias("given"), F.min_by("dsid", order).alias("source"), F.min(inferred).alias("inferred"))
    choice = F.when(F.col("o.r") == 1, "firm").when(F.col("o.r") == 2, "order").when(F.col("o.r") == 3, "tentative").when(F.col("inferred").isNotNull(), "inferred").otherwise("none")
    return found.select(*by, F.coalesce("given", "inferred", F.lit("")).alias("mult"), choice.alias("mult_choice"), "source")


def band_flags(members: DataFrame, by: list[str]) -> DataFrame:
    """by, flag: the band of a level group, A to Z and a to z in order of their lowest
    level, blank beyond.  ``members``: by, nuclide, band, energy; the band that most
    members name counts, of equal ones the first."""
    named = members.where("band IS NOT NULL").groupBy(*by, "nuclide", "band").agg(F.count("*").alias("n"), F.min("energy").alias("energy"))
    own = named.groupBy(*by, "nuclide").agg(F.min_by("band", F.struct((-F.col("n")).alias("n"), F.col("band").alias("b"))).alias("band"), F.min("energy").alias("energy"))
    heads = own.groupBy("nuclide", "band").agg(F.min("energy").alias("head"))
    ranked = heads.groupBy("nuclide").agg(F.array_sort(F.collect_list(F.struct("head", "band"))).alias("heads")).select("nuclide", F.posexplode("heads").alias("no", "h")).select("nuclide", F.col("h.band").alias("band"), "no")
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    return own.join(ranked, ["nuclide", "band"]).select(*by, F.rpad(F.substring(letters, F.col("no") + 1, F.lit(1)), 1, " ").alias("flag"))


def cross_reference_lines(tags: DataFrame, by: list[str]) -> DataFrame:
    """by, lines: ``XREF=`` and as many ``XREF+=`` as the tags of a level group need.
    ``tags``: by, tag, marker (*, ? or null), energy, energy_text, adopted_energy; the
    text of an energy stands in the mark where it is whole and far from the adopted
    one, or the tag has a mark."""
    far = F.abs(F.col("energy") - F.col("adopted_energy")) > F.greatest(F.lit(10.0), F.col("adopted_energy") / 500)
    whole = ~F.col("energy_text").contains(".")
    inside = F.concat(F.when(whole & (far | F.col("marker").isNotNull()), F.col("energy_text")).otherwise(""), F.coalesce("marker", F.lit("")))
    shown = F.concat(F.col("tag"), F.when(inside != "", F.concat(F.lit("("), inside, F.lit(")"))).otherwise(""))
    listed = tags.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(tx.tag_order(F.col("tag")).alias("o"), shown.alias("t")))).alias("tags"))
    folded = F.aggregate(
        "tags",
        F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (F.length(F.element_at(acc, -1)) + F.length(x["t"]) >= XREF_WIDTH), F.concat(acc, F.array(x["t"]))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), x["t"])))),
    )
    return listed.select(*by, F.transform(folded, lambda line, k: F.concat(F.when(k == 0, "XREF=").otherwise("XREF+="), line)).alias("lines"))


def _record(nucid: Column, kind: str, *fields: tuple[Column, int]) -> Column:
    """An 80-column record: nuclide, type, and fields from column 10 on."""
    body = F.concat(*[F.rpad(F.coalesce(c, F.lit("")), n, " ") for c, n in fields])
    return F.rpad(F.concat(F.lpad(nucid, 5, " "), F.lit(f"  {kind} "), body), RECORD_WIDTH, " ")


def _sources(chosen: DataFrame, by: list[str]) -> DataFrame:
    """by, notes: ``E,T$from X`` for the fields that each dataset gave."""
    each = chosen.where("source IS NOT NULL").groupBy(*by, "source").agg(F.array_sort(F.collect_list("field")).alias("fields"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.concat(F.array_join("fields", ","), F.lit("$from "), F.col("source")))).alias("notes"))


def adopted_scheme(levels: DataFrame, gammas: DataFrame) -> DataFrame:
    """nuclide, level, gamma (null for lines of the level), place and line of the
    adopted records.

    ``levels``, one row for each member: nuclide, level (the group), dsid, place, tag,
    marker, energy_text, energy_unc, t12_text, t12_unc, t12_unit, spin_text, quoted,
    questionable, is_adopted, n_gammas, band.  ``gammas``, likewise: nuclide, level,
    gamma (the group), dsid, place, marker, energy_text, energy_unc, ri_text, ri_unc,
    mult, quoted, argued, questionable, is_adopted, two_ji, parity_i, two_jf, parity_f.

    A level that has gammas keeps the energy of its adopted record, else of its first,
    as its energy follows from theirs; a ground state has no half-life of an average.
    """
    key = ["nuclide", "level"]
    energy = tx.number_in(F.trim("energy_text"), "double")
    tentative = F.coalesce(F.col("marker").isin("*", "?"), F.lit(False))
    order = F.struct((~F.col("is_adopted")).alias("a"), F.col("place").alias("b"), F.col("dsid").alias("c"))
    first = levels.groupBy(*key).agg(F.min_by(F.struct("energy_text", "energy_unc", "spin_text", energy.alias("energy")), order).alias("f"), F.max(F.col("n_gammas") > 0).alias("fed"), F.min_by("t12_unit", F.when(F.trim("t12_text") != "", order)).alias("unit"), F.count("*").alias("members"))
    field = lambda name, value, unc: F.struct(F.lit(name).alias("field"), F.col(value).alias("text"), F.col(unc).alias("unc_text"))

    def spread(rows: DataFrame, by: list[str], *fields: Column) -> DataFrame:
        """Values of all fields; the adopted one where no other dataset has any."""
        each = rows.withColumn("tentative", tentative).select("*", F.inline(F.array(*fields)))
        given = each.where("NOT is_adopted AND trim(text) <> ''").select(*by, "field").distinct()
        kept = each.where("is_adopted").join(given, [*by, "field"], "left_anti").withColumn("quoted", F.lit(True))
        return each.where("NOT is_adopted").unionByName(kept)

    told = spread(levels, key, field("E", "energy_text", "energy_unc"), field("T", "t12_text", "t12_unc"))
    level_values = best_values(told, key).join(first.select(*key, "fed", "f"), key).where("NOT (field = 'E' AND fed) AND NOT (field = 'T' AND choice = 'average' AND f.energy = 0)")
    # A ground state's energy needs no source.
    level_values = level_values.withColumn("source", F.when(~F.coalesce((F.col("field") == "E") & (F.col("f.energy") == 0), F.lit(False)), F.col("source"))).drop("fed", "f")
    wide = level_values.groupBy(*key).pivot("field", ["E", "T"]).agg(F.first(F.struct("value", "uncertainty")))
    base = first.join(wide, key, "left").join(band_flags(levels.withColumn("energy", energy), key), key, "left").join(_sources(level_values, key), key, "left")
    tags = levels.where("NOT is_adopted").join(first.select(*key, F.col("f.energy").alias("adopted_energy")), key).select(*key, "tag", "marker", energy.alias("energy"), "energy_text", "adopted_energy")
    base = base.join(cross_reference_lines(tags, key), key, "left")
    nucid = F.col("nuclide")
    line = _record(nucid, "L", (F.coalesce("E.value", "f.energy_text"), 10), (F.coalesce("E.uncertainty", F.when(F.col("E.value").isNull(), F.col("f.energy_unc"))), 3), (F.col("f.spin_text"), 17), (F.when(F.col("T.value").isNotNull(), F.concat_ws(" ", "T.value", "unit")), 10), (F.col("T.uncertainty"), 27), (F.col("flag"), 1))
    notes = lambda kind: F.when(F.col("members") > 1, F.transform("notes", lambda n: F.rpad(F.concat(F.lpad(nucid, 5, " "), F.lit(f" c{kind} "), n), RECORD_WIDTH, " ")))
    none = F.array().cast("array<string>")
    xrefs = F.transform(F.coalesce("lines", none), lambda x: F.rpad(F.concat(F.lpad(nucid, 5, " "), F.lit("X L "), x), RECORD_WIDTH, " "))
    level_lines = base.select(*key, F.lit(None).cast("long").alias("gamma"), F.posexplode(F.concat(F.array(line), xrefs, F.coalesce(notes("L"), none))).alias("at", "line"), F.lit(0.0).alias("energy"))

    own = [*key, "gamma"]
    g_first = gammas.groupBy(*own).agg(F.min_by(F.struct("energy_text", "energy_unc", energy.alias("energy")), order).alias("f"), F.count("*").alias("members"))
    single = gammas.groupBy(*key, "dsid").agg(F.count_distinct("gamma").alias("branches"))
    # The intensity of a dataset's only branch says nothing.
    branching = gammas.join(single, [*key, "dsid"]).withColumn("ri_text", F.when(F.col("branches") > 1, F.col("ri_text")))
    told = spread(branching, own, field("E", "energy_text", "energy_unc"), field("RI", "ri_text", "ri_unc"))
    g_values = best_values(told, own)
    g_wide = g_values.groupBy(*own).pivot("field", ["E", "RI"]).agg(F.first(F.struct("value", "uncertainty")))
    mults = best_multipolarities(gammas, own)
    g_sources = g_values.select(*own, "field", "source").unionByName(mults.select(*own, F.lit("M").alias("field"), "source"))
    g_base = g_first.join(g_wide, own, "left").join(mults.drop("source"), own).join(_sources(g_sources, own), own, "left")
    g_line = _record(nucid, "G", (F.coalesce("E.value", "f.energy_text"), 10), (F.coalesce("E.uncertainty", F.col("f.energy_unc")), 3), (F.col("RI.value"), 8), (F.col("RI.uncertainty"), 3), (F.col("mult"), 10))
    gamma_lines = g_base.select(*own, F.posexplode(F.concat(F.array(g_line), F.coalesce(notes("G"), none))).alias("at", "line"), F.coalesce("f.energy", F.lit(0.0)).alias("energy"))
    return level_lines.unionByName(gamma_lines).withColumn("place", F.struct(F.col("gamma").isNotNull().alias("a"), "energy", F.coalesce("gamma", F.lit(0)).alias("g"), "at")).select(*own, "place", "line")
