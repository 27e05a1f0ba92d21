"""The command over several sources, the file sink, the package on the workers."""

import json
import os
import subprocess
import sys

import pytest

from shroud import cli
from shroud.config import LABEL2ID
from shroud.sources.sinks import write_redacted

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def settings(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a b.txt").write_text("Name: Anna Berg\nSeen in Paris on 2020-01-02T10:30.")
    (tmp_path / "notes" / "é+1%.txt").write_text("call (111) 222-3333")
    spark.createDataFrame([("p/1", 1, "Dr. JOHN SMITH"), ("p/1", 2, ""), ("p/1", 3, "a@b.com")], "doc_id string, page_no int, page_text string") \
        .write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("paris",)], "entry string").write.parquet(str(tmp_path / "places"))
    (tmp_path / "labels.json").write_text(json.dumps(LABEL2ID))
    return {"sources": [{"format": "txt", "path": str(tmp_path / "notes")}, {"format": "pages", "path": str(tmp_path / "pages")}],
            "output": str(tmp_path / "out"), "gazetteer": str(tmp_path / "places"), "labels": str(tmp_path / "labels.json"), "seed": 5}


def test_run_over_text_and_pages(spark, settings):
    cli.run(spark, settings)
    out = {n: open(os.path.join(settings["output"], n)).read() for n in os.listdir(settings["output"]) if not n.startswith((".", "_"))}
    assert set(out) == {"REDACTED_a b.txt", "REDACTED_é+1%25.txt", "REDACTED_p%2F1"}
    assert out["REDACTED_a b.txt"].startswith("Name: ") and not any(x in "".join(out.values()) for x in (
        "Anna", "Berg", "Paris", "2020-01-02", "222-3333", "JOHN", "SMITH", "a@b.com"))
    assert open(os.path.join(settings["output"], "_SUCCESS")).read() == "3"
    cli.run(spark, settings)  # run again: the same files
    assert {n: open(os.path.join(settings["output"], n)).read() for n in out} == out


def test_refused_settings(spark, settings, tmp_path):
    (tmp_path / "other.json").write_text(json.dumps({"O": 0, "B-CITY": 1}))
    for change in ({"labels": str(tmp_path / "other.json")}, {"colour": 1}, {"sources": [{"format": "pdf", "path": "x"}]}, {"mode": "x"}):
        with pytest.raises(ValueError):
            cli.run(spark, settings | change)


def test_files_of_shared_and_missing_keys(spark, tmp_path):
    rows = [("a", "one"), ("a", "two"), ("a", "two"), ("b", None), (None, "three"), (None, "four"), ("c%/", "x")]
    write_redacted(spark.createDataFrame(rows, "doc_id string, redacted_text string"), str(tmp_path / "o"), fmt="files")
    out = {n: (tmp_path / "o" / n).read_text() for n in os.listdir(tmp_path / "o") if n[0] not in "._"}
    assert sorted(out.values()) == sorted(["one", "two", "", "three", "four", "x"])
    assert out["REDACTED_b"] == "" and out["REDACTED_c%25%2F"] == "x" and sum(n.startswith("REDACTED_unnamed-") for n in out) == 2


def test_workers_import_the_package_from_any_folder(tmp_path):
    """A driver started elsewhere, with the package on its own path only."""
    code = (f"import sys; sys.path.insert(0, {REPO!r})\n"
            "from shroud.session import local_session\n"
            "from shroud.plans.queries import all_queries\n"
            "s = local_session(2, 2)\n"
            "print('rows', all_queries()['scored_windows'](s, '/root/testdata/sf0.001').count() > 0)\n"
            "from pyspark.sql import functions as F\n"
            "print('n', len(all_queries()['scored_windows'](s, '/root/testdata/sf0.001').collect()))\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows True" in run.stdout and "n 305" in run.stdout, run.stderr[-2000:]


def test_entry_without_an_optional_library(tmp_path):
    """Queries of the library stay registered where a library of the optional part is missing."""
    code = (f"import sys; sys.path.insert(0, {REPO!r}); sys.modules['tiktoken'] = None\n"
            "import __spark_entry__ as e\n"
            "q = e.queries(); print('found', 'redact_documents' in q, any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))\n")
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "found True False True" in run.stdout, run.stderr[-2000:]
