"""Text reports, and reading a cluster report back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchengine.functions import text as tx


def pair_report(pairs: DataFrame) -> DataFrame:
    """One line per pair in rank order, probabilities with one decimal."""
    line = F.format_string("%s <-> %s | probability %.1f%% | energy %.2f spin %.2f parity %.2f specificity %.2f gamma %.2f", "level_1_id", "level_2_id", F.col("probability") * 100, "energy", "spin", "parity", "specificity", "gamma")
    return pairs.select("pair_rank", line.alias("line")).orderBy("pair_rank")


def cluster_report(members: DataFrame) -> DataFrame:
    """One row per cluster: header, anchor and the other members by dataset."""
    entry = F.when(F.col("is_anchor"), F.format_string("  %s (anchor)", "level_id")).otherwise(F.format_string("  %s probability %.1f%%", "level_id", F.coalesce("match_probability", F.lit(0.0)) * 100))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("dataset_code", entry.alias("entry")))), lambda x: x["entry"])
    return members.groupBy("cluster_no").agg(F.concat(F.format_string("Cluster %d:\n", F.first("cluster_no")), F.concat_ws("\n", listed)).alias("text"))


def parse_cluster_report(lines: DataFrame) -> DataFrame:
    """(cluster_no, level_id, is_anchor, match_probability) of report lines."""
    header = F.col("line").rlike("^Cluster [0-9]+")
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    number = F.last(F.when(header, F.regexp_extract("line", "^Cluster ([0-9]+)", 1).cast("int")), ignorenulls=True).over(order)
    read = lines.withColumn("cluster_no", number).where(~header & F.col("line").rlike(r"^\s+\S"))
    percent: Column = tx.number_in(F.regexp_extract("line", r"probability ([0-9.]+)%", 1), "double")
    return read.select("cluster_no", F.regexp_extract("line", r"^\s+(\S+)", 1).alias("level_id"), F.col("line").contains("(anchor)").alias("is_anchor"), (percent / 100).alias("match_probability"))


def replace_blocks(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A report with the blocks of ``new`` in place of those of equal key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def level_lines(levels: DataFrame) -> DataFrame:
    """Fixed columns of a level table: energy, uncertainty, spin-parity."""
    line = F.concat(F.rpad("energy_text", 10, " "), F.rpad("uncertainty_text", 2, " "), F.lit(" "), F.rpad("spin_parity_text", 18, " "))
    return levels.select("*", F.rtrim(line).alias("line"))


def multi_member(members: DataFrame, key: str = "cluster_no") -> DataFrame:
    """Members of clusters that have two or more."""
    some = members.groupBy(key).agg(F.count("*").alias("__n")).where("__n >= 2").select(key)
    return members.join(some, key, "left_semi")


def gamma_lines(gammas: DataFrame) -> DataFrame:
    """Fixed columns of a gamma table: energy, uncertainty, intensity, its
    uncertainty, initial and final level."""
    field = lambda c, n: F.rpad(F.coalesce(F.col(c), F.lit("")), n, " ")
    line = F.concat(field("energy_text", 10), field("uncertainty_text", 3), field("intensity_text", 8), field("intensity_uncertainty_text", 3), field("initial_text", 10), F.lit("-> "), field("final_text", 10))
    return gammas.select("*", F.rtrim(line).alias("line"))


def gammas_by_level(gammas: DataFrame) -> DataFrame:
    """One text a level: its gamma lines from the highest energy down."""
    lines = gamma_lines(gammas)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("energy", "record", "line")), asc=False), lambda x: x["line"])
    return lines.groupBy("level").agg(F.concat_ws("\n", listed).alias("text"))


def average_lines(averages: DataFrame, key: str) -> DataFrame:
    """A line for each averaged group: number of values, weighted mean with its
    uncertainties, reduced chi-square, unweighted mean."""
    line = F.format_string("%s n=%d weighted=%.3f int=%.3f ext=%.3f chi2=%.2f unweighted=%.3f", F.col(key).cast("string"), "n", "weighted", "internal", "external", "chi2", "unweighted")
    return averages.select(key, line.alias("line"))


def decision_lines(decided: DataFrame, by: list[str]) -> DataFrame:
    """by and line of the report on averages of level groups, or gamma groups inside
    them: what is adopted and why, the averages of used and of all values with their
    chi-squares.  ``decided``: by and what ``averages.average_decision`` gives."""
    name = F.concat_ws(" / ", *[F.col(c).cast("string") for c in by])
    # The thousandfold double is rounded, not its shortest text: 1.0005 is below a half.
    shown = lambda c: F.round(F.col(c) * 1000) / 1000
    line = F.format_string("%s: %s %.3f, n=%d, used %.3f (chi2 %.2f), all %.3f (chi2 %.2f), unweighted %.3f", name, "kind", shown("adopted"), "n", shown("w_used"), "chi2_used", shown("weighted"), "chi2", shown("unweighted"))
    return decided.select(*by, line.alias("line"))


def average_comment(members: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Text of a comment on an average: the values it is made of with their
    sources in order, the first ``most`` of them, then dots."""
    entry = F.struct("place", F.concat(F.col("value_text"), F.lit(" from "), F.col("source")).alias("t"))
    listed = F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["t"])
    shown = F.when(F.size("__l") > most, F.concat(F.slice("__l", 1, most), F.array(F.lit("...")))).otherwise(F.col("__l"))
    return members.groupBy(key).agg(listed.alias("__l")).select(key, F.concat(F.lit("average of "), F.array_join(shown, ", ")).alias("comment"))


def feeding_lines(feeding: DataFrame, gammas: DataFrame, most: int = 3) -> DataFrame:
    """A line for each level group: the gammas that feed it, the first ``most`` by
    energy, then dots.  ``feeding``: level_group, gamma_group; ``gammas``:
    gamma_group, energy_text, energy."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("energy", "gamma_group", "energy_text"))), lambda x: x["energy_text"])
    joined = feeding.join(gammas, "gamma_group").groupBy("level_group").agg(listed.alias("l"))
    shown = F.when(F.size("l") > most, F.concat(F.slice("l", 1, most), F.array(F.lit("...")))).otherwise(F.col("l"))
    return joined.select("level_group", F.size("l").cast("long").alias("n"), F.concat(F.lit("fed by "), F.array_join(shown, ", ")).alias("line"))


def xref_lists(tags: DataFrame) -> DataFrame:
    """Cross-reference text of each record: tags in order (digits before letters)
    with their markers in parentheses.  ``tags``: record, tag, marker."""
    shown = F.concat(F.col("tag"), F.when(F.coalesce("marker", F.lit("")) != "", F.concat(F.lit("("), F.col("marker"), F.lit(")"))).otherwise(""))
    entry = F.struct(F.col("tag").rlike("^[^0-9]").alias("letter"), F.col("tag").alias("tag"), shown.alias("t"))
    return tags.groupBy("record").agg(F.array_join(F.transform(F.sort_array(F.collect_set(entry)), lambda x: x["t"]), "").alias("xref"))


def changed_xrefs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adopted records with their old and new cross-references and whether they
    differ (null is none).  Both: record, xref."""
    both = old.withColumnRenamed("xref", "old").join(new.withColumnRenamed("xref", "new"), "record", "full")
    return both.select("record", "old", "new", (~F.col("old").eqNullSafe(F.col("new"))).alias("changed"))


def adopted_blocks(levels: DataFrame, gammas: DataFrame) -> DataFrame:
    """Records of the adopted dataset in order: each level line with its new
    cross-reference, then its gamma lines.  ``levels``: level, energy, line, xref;
    ``gammas``: level, energy, record, line."""
    one = levels.select("level", F.col("energy").alias("of"), F.lit(0).alias("kind"), F.lit(0.0).alias("energy"), F.lit(0).cast("long").alias("record"), F.col("line"))
    two = levels.where("xref IS NOT NULL").select("level", F.col("energy").alias("of"), F.lit(1).alias("kind"), F.lit(0.0).alias("energy"), F.lit(0).cast("long").alias("record"), F.concat(F.lit("XREF="), "xref").alias("line"))
    three = gammas.join(levels.select("level", F.col("energy").alias("of")), "level").select("level", "of", F.lit(2).alias("kind"), "energy", F.col("record").cast("long").alias("record"), "line")
    rows = one.unionByName(two).unionByName(three)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("kind", "energy", "record", "line"))), lambda x: x["line"])
    return rows.groupBy("level", "of").agg(F.concat_ws("\n", listed).alias("text")).withColumnRenamed("of", "energy")


def merged_lines(lines: DataFrame, datasets: DataFrame) -> DataFrame:
    """The datasets of each nuclide as one text: nuclide, place (from 0) and line, each
    dataset's lines in their order and a blank one after it.  ``lines``: nuclide, dsid,
    line_no, line (of records of any type, continuations and comments included);
    ``datasets``: nuclide, dsid, rank (adopted first).  Lines of a dataset that is not
    named are left out."""
    ranked = lines.join(datasets.select("nuclide", "dsid", "rank"), ["nuclide", "dsid"])
    ends = ranked.select("nuclide", "dsid", "rank").distinct().select("nuclide", "dsid", "rank", F.lit(None).cast("long").alias("line_no"), F.lit("").alias("line"))
    both = ranked.select("nuclide", "dsid", "rank", F.col("line_no").cast("long").alias("line_no"), "line").unionByName(ends)
    order = Window.partitionBy("nuclide").orderBy("rank", "dsid", F.col("line_no").asc_nulls_last(), "line")
    return both.select("nuclide", (F.row_number().over(order) - 1).cast("long").alias("place"), "line")


def write_merged(merged: DataFrame, path: str) -> None:
    """A folder of text for each nuclide (``nuclide=<name>``), in one file of 80-column
    lines; rewritten nuclides replace theirs."""
    ready = merged.select("nuclide", F.when(F.length("line") < 80, F.rpad("line", 80, " ")).otherwise(F.col("line")).alias("line"), "place")
    ordered = ready.repartition("nuclide").sortWithinPartitions("nuclide", "place").select("nuclide", "line")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("nuclide").text(path)


def record_lines(records: DataFrame) -> DataFrame:
    """80-column records: nuclide, continuation, type, energy, uncertainty and the
    field from column 23 on.  ``records``: nucid, record (L or G), energy_text,
    uncertainty_text, field."""
    text = lambda c, n: F.rpad(F.coalesce(F.col(c), F.lit("")), n, " ")
    line = F.concat(F.lpad("nucid", 5, " "), F.lit("  "), F.col("record"), F.lit(" "), text("energy_text", 10), text("uncertainty_text", 2), F.lit(" "), text("field", 58))
    return records.select("*", line.alias("line"))


def write_reports(reports: dict[str, DataFrame], folder: str, name: str) -> None:
    """Each report (its extension: a frame with ``line``, in order of ``place``
    where it has one) as text files in a folder of its own."""
    for kind, frame in reports.items():
        ordered = frame.orderBy("place") if "place" in frame.columns else frame
        ordered.select("line").write.mode("overwrite").text(f"{folder}/{name}.{kind}")


def plot_table(levels: DataFrame, by: list[str], near: float = 150.0) -> DataFrame:
    """What a level scheme is drawn from: the column of each dataset, height, text
    and sideways offset of each level.  ``levels``: by, dataset, id, x, text."""
    from matchengine.operators.groups import bar_offsets

    column = F.dense_rank().over(Window.partitionBy(*by).orderBy("dataset"))
    return bar_offsets(levels, [*by, "dataset"], near).withColumn("column", column)
