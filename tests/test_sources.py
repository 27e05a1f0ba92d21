import json
import os

import pytest

from shroud.sources.files import (pages_to_documents, read_json_object, read_label_vocabulary, read_single_csv,
                                  read_text_dir, union_formats)
from shroud.sources.sinks import paragraphs, write_redacted


def test_text_dir(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"line1\r\nline2\n")
    (tmp_path / "b.txt").write_text("second")
    (tmp_path / "UP.TXT").write_text("not matched")
    (tmp_path / ".hidden.txt").write_text("hidden")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "c.pdf").write_text("pdf")
    got = {r.doc_id: r.text for r in read_text_dir(spark, str(tmp_path)).collect()}
    assert got.get("a.txt") == "line1\nline2\n" and got.get("b.txt") == "second"
    assert "UP.TXT" not in got and ".hidden.txt" not in got and "c.pdf" not in got


def test_pages(spark):
    pages = spark.createDataFrame([("d1", 2, "two"), ("d1", 1, "one"), ("d1", 3, None), ("d2", 1, "")],
                                  "doc_id string, page_no int, page_text string")
    got = {r.doc_id: r.text for r in pages_to_documents(pages).collect()}
    assert got == {"d1": "one\ntwo\n", "d2": ""}


def test_single_csv(spark, tmp_path):
    d = tmp_path / "one"
    d.mkdir()
    (d / "x.csv").write_text("a,b\n1,x\n2,y\n")
    assert read_single_csv(spark, str(d)).count() == 2
    (d / "y.csv").write_text("a,b\n3,z\n")
    with pytest.raises(ValueError):
        read_single_csv(spark, str(d))
    e = tmp_path / "none"
    e.mkdir()
    (e / "x.txt").write_text("a")
    with pytest.raises(Exception):
        read_single_csv(spark, str(e))


def test_json_and_labels(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"O": 0, "B-DATE": 1}))
    (tmp_path / "a.json").write_text(json.dumps({"random_state": 200, "batch_size": 8}))
    first = read_json_object(spark, str(tmp_path)).first()
    assert first.random_state == 200 and first.batch_size == 8
    vocab = {r.label: r.id for r in read_label_vocabulary(spark, str(tmp_path / "b.json")).collect()}
    assert vocab == {"O": 0, "B-DATE": 1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f1.txt", "a\n\nb"), ("f2.txt", "c")], "doc_id string, redacted_text string")
    write_redacted(df, str(tmp_path / "pq"))
    back = {r.out_name: r.value for r in spark.read.parquet(str(tmp_path / "pq")).collect()}
    assert back == {"REDACTED_f1.txt": "a\n\nb", "REDACTED_f2.txt": "c"}
    write_redacted(df, str(tmp_path / "tx"), fmt="text")
    dirs = sorted(x for x in os.listdir(tmp_path / "tx") if x.startswith("out_name="))
    assert dirs == ["out_name=REDACTED_f1.txt", "out_name=REDACTED_f2.txt"]
    paras = [(r.doc_id, r.para_no, r.para) for r in paragraphs(df).orderBy("doc_id", "para_no").collect()]
    assert paras == [("f1.txt", 0, "a"), ("f1.txt", 1, ""), ("f1.txt", 2, "b"), ("f2.txt", 0, "c")]


def test_union_formats(spark):
    a = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    b = spark.createDataFrame([("p", "y")], "doc_id string, text string")
    got = sorted((r.format, r.doc_id) for r in union_formats(txt=a, pdf=b).collect())
    assert got == [("pdf", "p"), ("txt", "1")]
