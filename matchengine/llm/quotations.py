"""Quotation linking: threads of messages without their quotes.

A message's lines are parsed into its own text and quoted passages with their
nesting level.  Passages are normalised (quote marks and case removed, blanks
collapsed) and hashed, as a whole and line by line; the same is offered of
every message's own text: whole, by paragraph and by line.  A quote is linked
to the latest earlier message of the conversation that offers its hash.  The
outermost level, and a whole passage before single lines, decides the message
that is answered.  Links are followed by pointer jumping to the first message
of a thread, which also gives the path of turns from there to each message;
sorting by (conversation, reply_path) then gives every answer after what it
answers, one branch of a thread after the other.

Only hashes and turn numbers are shuffled to be linked, and offers only where
some message quotes them.  The as-of step is a window by (conversation, hash)
over those rows, so neither a long conversation nor a common message is
gathered in one place as such, and no pairs are formed.

Defined results: null text has no lines and gives null text; a message that
quotes nothing, or nothing found, starts a thread of its own at depth 0; quotes
without an original are removed as well unless ``keep_unlinked``; messages that
share a turn cannot answer each other; repeated rows are parsed and linked
alike; null conversation ids are one conversation; a null turn links to
nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchengine.durable import keep

MARKS = re.compile(r"(?:[ \t]*>)+")
#: "On ... wrote:" in the corpus' languages; removed right before a quote.
ATTRIBUTION = re.compile(r"(wrote|schrieb|écrit|escribió)[^:]{0,80}:\s*$", re.IGNORECASE)
PARSED = "own string, quotes array<struct<level:int,rank:int,h:string>>, offers array<string>, n_quoted long"


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def _name(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def parse_message(text: str) -> tuple[str, list[tuple[int, str, list[str]]]]:
    """Own text, and quoted passages as (level, text, lines), in order."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        marks = MARKS.match(line)
        level = marks.group().count(">") if marks else 0
        if not level:
            own.append(line)
        else:
            if last == 0:
                while own and not own[-1].strip():
                    own.pop()
                if own and ATTRIBUTION.search(own[-1]):
                    own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(normalise(line[marks.end() :]))
        last = level
    found = [(level, normalise(" ".join(lines)), [x for x in lines if x]) for level, lines in passages]
    return "\n".join(own).strip("\n") if passages else text, [p for p in found if p[1]]


def offered(own: str) -> set[str]:
    """Normalised texts by which a message can be quoted."""
    paragraphs = re.split(r"\n\s*\n", own)
    return {t for t in (normalise(x) for x in [own, *paragraphs, *own.split("\n")]) if t}


def _parse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            if text is None:
                rows.append((None, [], [], 0))
                continue
            own, passages = parse_message(text)
            quotes = {(level, 0, _name(whole)) for level, whole, _ in passages} | {(level, 1, _name(x)) for level, _, lines in passages for x in lines}
            rows.append((own, [{"level": a, "rank": b, "h": c} for a, b, c in sorted(quotes)], sorted(map(_name, offered(own))), text.count("\n") + 1 - (own.count("\n") + 1) if passages else 0))
        yield pd.DataFrame(rows, columns=["own", "quotes", "offers", "n_quoted"])


def link_quotations(messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", keep_unlinked: bool = False) -> DataFrame:
    """One row per message: conv_id, turn, role, parent_turn, thread_turn,
    depth, reply_path, n_quoted (lines removed) and text without quotes."""
    source = messages.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("raw"))
    parsed = keep(source.select("*", F.pandas_udf(_parse, PARSED)("raw").alias("p")).select("conv_id", "turn", "role", "raw", F.xxhash64("raw").alias("body"), "p.*"), "messages")

    quoted = parsed.where("turn IS NOT NULL").select("conv_id", "turn", "body", F.explode("quotes").alias("q")).select("conv_id", "turn", "body", "q.*").distinct()
    offers = parsed.where("turn IS NOT NULL").select("conv_id", "turn", F.explode("offers").alias("h")).distinct()
    wanted = quoted.select(F.col("conv_id").alias("c"), F.col("h").alias("g")).distinct()
    offers = offers.join(wanted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("g")), "left_semi")
    # At one turn the quotes stand before the offers: only earlier turns count.
    line = quoted.select("*", F.lit(None).cast("long").alias("offer")).unionByName(offers.select("*", F.col("turn").alias("offer")), allowMissingColumns=True)
    before = Window.partitionBy("conv_id", "h").orderBy("turn", F.col("offer").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = line.select("*", F.last("offer", ignorenulls=True).over(before).alias("origin")).where("offer IS NULL AND origin IS NOT NULL")
    best = found.groupBy("conv_id", "turn", "body").agg(F.min(F.struct("level", "rank", (-F.col("origin")).alias("minus"))).alias("best"))
    links = keep(best.select("conv_id", "turn", "body", (-F.col("best.minus")).alias("parent_turn")), "quote-links")

    threads = _threads(links.groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("up")))
    linked = links.withColumnsRenamed({"conv_id": "c", "turn": "t", "body": "b"})
    top = threads.withColumnsRenamed({"conv_id": "c2", "turn": "t2"})
    joined = parsed.join(linked, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")) & F.col("body").eqNullSafe(F.col("b")), "left")
    joined = joined.join(top, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("parent_turn") == F.col("t2")), "left")
    bare = F.when(F.col("parent_turn").isNull() & F.lit(keep_unlinked), F.col("raw")).otherwise(F.col("own"))
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "parent_turn",
        F.coalesce("up", "parent_turn", "turn").alias("thread_turn"),
        F.when(F.col("parent_turn").isNull(), 0).otherwise(1 + F.coalesce("depth", F.lit(0))).cast("long").alias("depth"),
        F.when(F.col("parent_turn").isNull(), F.array("turn")).otherwise(F.concat(F.coalesce(F.concat(F.array("up"), F.col("path")), F.array("parent_turn")), F.array("turn"))).alias("reply_path"),
        "n_quoted",
        bare.alias("text"),
    )


def format_chat(linked: DataFrame) -> DataFrame:
    """Linked messages in reply order, thread after thread, each with its turn as
    chat text; messages left without text are kept as empty turns."""
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return linked.select("*", chat.alias("chat")).orderBy("conv_id", "reply_path")


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, up) to each answer's first message, its depth and the path of
    turns below that message."""
    state = keep(links.select("conv_id", "turn", "up", F.lit(1).cast("long").alias("depth"), F.array("turn").alias("path")), "threads")
    while True:
        above = state.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
        jumped = state.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("t")), "left")
        moved = keep(jumped.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path2", "path")).alias("path"), F.col("up2").isNotNull().alias("moved")), "threads")
        state = moved.drop("moved")
        if moved.where("moved").limit(1).count() == 0:
            return state
