"""Average reports to comments and back, and patched records."""

from __future__ import annotations

import random

from matchengine.sources import comment_records as cr
from matchengine.sources import logs

LINES = "file string, line_no long, line string"


def frame(spark, lines, file="f"):
    return spark.createDataFrame([(file, n, x) for n, x in enumerate(lines)], LINES)


def test_report_and_back(spark):
    rng = random.Random(2)
    words = ["weighted", "average", "of", "12.5(3)", "(1999Ab01)", "and", "x" * 90, "$5", "from", "Others:"]
    comments = [(f"g{k} {k}", field, " ".join(rng.choices(words, k=rng.choice([1, 5, 60])))) for k in range(30) for field in rng.sample(["E", "T", "RI"], rng.randint(0, 3))]
    values = [(f"g{k} {k}", n, f"{n}.5", "A") for k in range(32) for n in range(3)]
    report = cr.average_report(spark.createDataFrame(values, "name string, place int, value_text string, source string"), spark.createDataFrame(comments, "name string, field string, body string"))
    lines = [r.line for r in report.orderBy("name", "place").collect()]
    assert sum(x.startswith("GROUP ") for x in lines) == 32 and sum(x.startswith("  VALUE ") for x in lines) == 96
    found = cr.parse_average_report(frame(spark, ["  COMMENT E$of no group", *lines, "  VALUE 1 from B", "  CONTINUED of nothing"])).collect()
    assert sorted((r.name, r.field, r.body) for r in found) == sorted(comments)


RECORDS = [
    " 34S  c  comment of the dataset", " 34S   L 0           0+", " 34S X L XREF=AB", " 34S  cL E$old energy that", " 34S 2cL goes on", " 34S  cL J$stays", " 34S   G 500.0",
    " 34S  cG E$old", " 34S   L 2127.5    2", " 34S  cL T$half-life",
]


def test_patched_records(spark):
    body = " ".join(f"word{k}" for k in range(300))
    comments = [("f", 1, "E", "new  energy"), ("f", 1, "T", "stable"), ("f", 8, "E", body), ("f", 99, "E", "no such record")]
    patched = cr.patch_comments(frame(spark, [x.ljust(80) for x in RECORDS]), spark.createDataFrame(comments, "file string, owner long, field string, body string"))
    rows = sorted((r.line_no, r.line) for r in patched.collect())
    assert [n for n, _ in rows] == list(range(len(rows))) and all(len(x) == 80 for _, x in rows)
    lines = [x.rstrip() for _, x in rows]
    assert lines[:9] == [RECORDS[0], RECORDS[1], RECORDS[2], " 34S  cL E$new energy", " 34S  cL T$stable", RECORDS[5], RECORDS[6], RECORDS[7], RECORDS[8]]
    marks = [x[5] for x in lines[9:-1]]
    assert marks == list(" 23456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")[: len(marks)] and len(marks) > 20 and lines[-1] == RECORDS[9]
    found = {(r.kind, r.field, r.body) for r in cr.parse_comments(patched).collect()}
    assert found == {("L", "E", "new energy"), ("L", "T", "stable"), ("L", "J", "stays"), ("G", "E", "old"), ("L", "E", body), ("L", "T", "half-life")}
    # The same comments once more change nothing.
    at = {r.line[9:16].strip(): r.line_no for r in patched.collect() if r.line[5:8] == "  L"}
    again = cr.patch_comments(patched, spark.createDataFrame([("f", at["2127.5"], "E", body)], "file string, owner long, field string, body string"))
    assert sorted((r.line_no, r.line) for r in again.collect()) == rows


def test_very_long_comments_and_empty_tables(spark):
    body = " ".join(["abc"] * 2000)
    comments = spark.createDataFrame([("f", 0, "E", body)], "file string, owner long, field string, body string")
    records = frame(spark, [" 34S   L 5".ljust(80)])
    patched = cr.patch_comments(records, comments)
    assert {r.line[5] for r in patched.where("line_no > 60").collect()} == {"Z"}
    assert [r.body for r in cr.parse_comments(patched).collect()] == [body]
    assert cr.patch_comments(records.where("false"), comments).count() == 0
    assert cr.patch_comments(records, comments.where("false")).count() == 1
    assert cr.parse_average_report(records.where("false")).count() == 0


def test_new_cross_references(spark):
    records = frame(spark, [x.ljust(80) for x in RECORDS])
    xrefs = spark.createDataFrame([("f", 1, ["XREF=CD", "XREF+=E"]), ("f", 8, ["XREF=F"]), ("f", 77, ["XREF=G"])], "file string, owner long, lines array<string>")
    lines = [r.line.rstrip() for r in cr.patch_xrefs(records, xrefs).orderBy("line_no").collect()]
    assert lines == [RECORDS[0], RECORDS[1], " 34S X L XREF=CD", " 34S X L XREF+=E", *RECORDS[3:9], " 34S X L XREF=F", RECORDS[9]]


def test_lines_of_a_file_in_blocks(spark, monkeypatch):
    """Owners, starts and new numbers go from block to block, also past empty ones."""
    monkeypatch.setattr(logs, "BLOCK", 3)
    records = spark.createDataFrame([(f, 7 * (n // 4) + n, x.ljust(80)) for f in ("f", "g") for n, x in enumerate(RECORDS)], LINES)
    at = [7 * (n // 4) + n for n in range(len(RECORDS))]
    own = sorted((r.line_no, r.owner, r.start) for r in cr.owned_in_blocks(records).where("file = 'g'").collect())
    assert own == [(at[n], *(None if k is None else at[k] for k in x)) for n, x in enumerate([(None, 0), (1, 1), (1, 1), (1, 3), (1, 3), (1, 5), (6, 6), (6, 7), (8, 8), (8, 9)])]
    xrefs = spark.createDataFrame([("f", at[1], ["XREF=CD", "XREF+=E"]), ("g", at[8], ["XREF=F"])], "file string, owner long, lines array<string>")
    patched = cr.patch_xrefs(records, xrefs).collect()
    lines = {f: [(r.line_no, r.line.rstrip()) for r in sorted(patched, key=lambda r: r.line_no) if r.file == f] for f in ("f", "g")}
    assert lines["f"] == list(enumerate([*RECORDS[:2], " 34S X L XREF=CD", " 34S X L XREF+=E", *RECORDS[3:]])) and lines["g"] == list(enumerate([*RECORDS[:9], " 34S X L XREF=F", RECORDS[9]]))
