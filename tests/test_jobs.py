"""The jobs: against SQL on whole tables, and by runs over growing copies."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import assert_same

from jobs import adopted_averages, line_index, queries
from jobs.common import load_config

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_job_matches_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


TEXTS = [
    (1, "Energy 12.5(3) keV,\n\n  and 7. \n x1 3a 4.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "\n \t\n", ""),
    (5, "0.0 -1.250 +3(12), 1e5 1.2.3 (5) 12.()", None),
    (5, "0.0 -1.250 +3(12), 1e5 1.2.3 (5) 12.()", None),
    (None, "a " * 50_000 + "9.99", "é/=x"),
]
SCHEMA = "doc_id long, text string, lang string, n_values int, batch string"


def add(spark, folder, rows, name):
    spark.createDataFrame([(*r, 1, "b") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def index(spark, output):
    return sorted(line_index.read_index(spark, output).drop("batch").collect(), key=repr)


def test_lines_and_values(spark, tmp_path):
    add(spark, tmp_path, TEXTS, "texts")
    done = line_index.run(spark, f"{tmp_path}/texts", f"{tmp_path}/out", f"{tmp_path}/state")
    assert done == {"batches": 1, "documents": 7, "lines": 6}
    rows = [tuple(r) for r in index(spark, f"{tmp_path}/out")]
    five = (5, None, 0, 38, 7, 3, "0.0 -1.250 +3(12)", 0.0, "none")
    assert sorted(rows, key=repr) == sorted([
        (1, "en", 0, 19, 3, 1, "12.5(3)", pytest.approx(0.3), "en"), (1, "en", 2, 9, 2, 1, "7", 5.0, "en"), (1, "en", 3, 9, 3, 1, "4", 5.0, "en"), five, five,
        (None, "é/=x", 0, 100_004, 50_001, 1, "9.99", 0.05, "é/=x"),
    ], key=repr)


def test_second_run_takes_only_what_is_new(spark, tmp_path):
    add(spark, tmp_path, TEXTS[:3], "texts")
    paths = (f"{tmp_path}/texts", f"{tmp_path}/out", f"{tmp_path}/state")
    one_file = line_index.Config(max_files=1)
    assert line_index.run(spark, *paths, one_file) == {"batches": 1, "documents": 3, "lines": 3}
    first = index(spark, paths[1])
    files = sorted(Path(paths[1]).rglob("*.parquet"))
    assert line_index.run(spark, *paths, one_file) == {"batches": 0, "documents": 0, "lines": 0}
    assert index(spark, paths[1]) == first and sorted(Path(paths[1]).rglob("*.parquet")) == files
    add(spark, tmp_path, TEXTS[3:5], "texts")
    add(spark, tmp_path, TEXTS[5:], "texts")
    assert line_index.run(spark, *paths, one_file) == {"batches": 2, "documents": 4, "lines": 3}
    grown = index(spark, paths[1])
    assert len(grown) == 6 and all(r in grown for r in first) and set(files) <= set(Path(paths[1]).rglob("*.parquet"))
    # A new checkpoint builds the whole index anew, in the same place.
    assert line_index.run(spark, paths[0], paths[1], f"{tmp_path}/state2")["documents"] == 7
    assert index(spark, paths[1]) == grown


def test_batch_that_broke_off_runs_again(spark, tmp_path, monkeypatch):
    add(spark, tmp_path, TEXTS[:1], "texts")
    paths = (f"{tmp_path}/texts", f"{tmp_path}/out", f"{tmp_path}/state")
    line_index.run(spark, *paths)
    add(spark, tmp_path, TEXTS[4:], "texts")

    def broken(*_):
        raise RuntimeError("lost")

    # The rows are written, then the batch fails before it is committed.
    with monkeypatch.context() as m:
        m.setattr(line_index.log, "info", broken)
        with pytest.raises(Exception, match="lost"):
            line_index.run(spark, *paths)
    assert line_index.run(spark, *paths)["documents"] == 3
    assert len(index(spark, paths[1])) == 6


def test_empty_folder_gives_an_empty_index(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    assert line_index.run(spark, f"{tmp_path}/texts", f"{tmp_path}/out", f"{tmp_path}/state")["batches"] == 0
    assert line_index.read_index(spark, f"{tmp_path}/out").count() == 0


MEASURED = adopted_averages.Config(quantity="q", dataset="'D'", value="x", uncertainty="dx", part="p")
ROWS = [(1, 10.0, 1.0, 7), (1, 12.0, 1.0, 7), (1, 30.0, 1.0, 7), (2, 5.0, 2.0, 7), (2, 6.0, 2.0, 8), (2, 7.0, 2.0, 8), (None, 1.0, 1.0, 8), (3, None, 1.0, 8), (3, 1.0, 0.0, 8), (3, 1.0, None, 8), (3, float("nan"), 1.0, 8), (4, 1.0, 1.0, None)]


def averages_of(spark, output):
    return {(r.part, r.quantity): r for r in adopted_averages.read_averages(spark, output).collect()}


def test_averages_and_rerun(spark, tmp_path):
    source, output = f"{tmp_path}/in", f"{tmp_path}/out"
    frame = spark.createDataFrame(ROWS, "q long, x double, dx double, p int")
    frame.write.parquet(source)
    done = adopted_averages.run(spark, source, output, MEASURED)
    assert done == {"measurements": 12, "used": 6, "averages": 3, "outliers": 3}
    first = averages_of(spark, output)
    assert set(first) == {(7, 1), (7, 2), (8, 2)}
    far = first[7, 1]
    assert (far.n, far.kind, far.n_outliers) == (3, "Unweighted-Average", 3) and far.adopted == pytest.approx(52 / 3)
    assert first[7, 2].kind == "Non-Average" and first[7, 2].uncertainty == pytest.approx(2.0)
    assert first[8, 2].adopted == pytest.approx(6.5) and first[8, 2].uncertainty == pytest.approx(2**0.5) and first[8, 2].n_outliers == 0
    listed = sorted((r.part, r.quantity, r.dataset, r.x, round(r.deviation, 6)) for r in adopted_averages.read_outliers(spark, output).collect())
    assert listed == [(7, 1, "D", 10.0, 7.333333), (7, 1, "D", 12.0, 5.333333), (7, 1, "D", 30.0, 12.666667)]
    assert adopted_averages.run(spark, source, output, MEASURED) == done and averages_of(spark, output) == first
    assert adopted_averages.read_outliers(spark, output).count() == 3
    # New rows of one part: a run over that part replaces it and leaves the rest.
    spark.createDataFrame([(2, 8.0, 2.0, 8)], "q long, x double, dx double, p int").write.mode("append").parquet(source)
    only = adopted_averages.Config(quantity="q", dataset="'D'", value="x", uncertainty="dx", part="p", only="part = 8")
    assert adopted_averages.run(spark, source, output, only)["averages"] == 1
    second = averages_of(spark, output)
    assert adopted_averages.read_outliers(spark, output).count() == 3
    # With a wider limit no outlier is left, and the old ones go.
    wide = adopted_averages.Config(quantity="q", dataset="'D'", value="x", uncertainty="dx", part="p", reach=100.0)
    assert adopted_averages.run(spark, source, f"{tmp_path}/out2", MEASURED)["outliers"] == 3 and adopted_averages.run(spark, source, f"{tmp_path}/out2", wide)["outliers"] == 0
    assert adopted_averages.read_outliers(spark, f"{tmp_path}/out2").count() == 0
    assert second[7, 1] == first[7, 1] and second[8, 2].n == 3 and second[8, 2].adopted == pytest.approx(7.0)


def test_averages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "q long, x double, dx double, p int").write.parquet(f"{tmp_path}/in")
    assert adopted_averages.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", MEASURED)["averages"] == 0
    assert adopted_averages.read_averages(spark, f"{tmp_path}/out").count() == 0


def test_config_files_and_settings(spark):
    assert load_config(line_index.CONFIG_FILE, line_index.Config) == line_index.Config()
    assert load_config(adopted_averages.CONFIG_FILE, adopted_averages.Config).part == "year(l_shipdate)"
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_command_line(spark, tmp_path):
    add(spark, tmp_path, TEXTS, "texts")
    (tmp_path / "c.json").write_text(json.dumps({"max_files": 2}))
    call = [sys.executable, str(ROOT / "jobs/line_index.py"), "--input", f"{tmp_path}/texts", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/state", "--config", f"{tmp_path}/c.json"]
    told = subprocess.run(call, cwd=tmp_path, capture_output=True, text=True, timeout=180, check=True).stderr
    assert "read 7 documents" in told and "wrote 6 lines" in told
    assert len(index(spark, f"{tmp_path}/out")) == 6
