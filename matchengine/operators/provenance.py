"""Which records are quoted from the adopted dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchengine.functions.comments import says_from_adopted


def quoted_records(records: DataFrame, comments: DataFrame, footnotes: DataFrame) -> DataFrame:
    """(record_id, field, quoted) of every record.

    A record's own comment on the field decides first; then a footnote whose flag
    the record carries; then a general footnote (flag blank), unless a footnote
    with another of its flags gives the source, or a comment of its own argues
    for the value.

    ``records``: record_id, dataset, field, flags (text of one-letter flags);
    ``comments``: record_id, field, body; ``footnotes``: dataset, field, flag, body.
    """
    own = comments.select("record_id", "field", says_from_adopted(F.col("body"), F.col("field")).alias("said"), F.upper(F.trim("body")).rlike(r"^(?!\S*ADOPTED)(?:FROM|DEDUCED|PROPOSED)").alias("argued"))
    own = own.groupBy("record_id", "field").agg(F.bool_or("said").alias("own_said"), F.bool_or("argued").alias("own_argued"))
    notes = footnotes.select("dataset", "field", F.coalesce("flag", F.lit(" ")).alias("flag"), says_from_adopted(F.col("body"), F.col("field")).alias("said"))
    general = notes.where("flag = ' ' AND said").select("dataset", "field", F.lit(True).alias("general")).distinct()
    flagged = records.select("record_id", "dataset", "field", F.explode(F.split("flags", "")).alias("flag")).where("flag <> ''")
    flagged = flagged.join(notes.where("flag <> ' '"), ["dataset", "field", "flag"]).groupBy("record_id", "field").agg(F.bool_or("said").alias("flag_said"), F.lit(True).alias("flag_any"))
    joined = records.select("record_id", "dataset", "field").join(own, ["record_id", "field"], "left").join(general, ["dataset", "field"], "left").join(flagged, ["record_id", "field"], "left")
    no = F.lit(False)
    by_general = F.coalesce("general", no) & ~F.coalesce("flag_any", no) & ~F.coalesce("own_argued", no)
    return joined.select("record_id", "field", (F.coalesce("own_said", no) | F.coalesce("flag_said", no) | by_general).alias("quoted"))
