"""Rows with null or repeated ids keep their own results; numbering, model scorer, streaming guard."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.config import RedactionConfig
from shroud.operators.classify import RuleTagger
from shroud.operators.models import load_linear, model_scorer, predict_linear
from shroud.operators.redact import redact
from shroud.operators.scorer import WindowedScorer, one_hot
from shroud.operators.spans import attach_documents, merge_windows
from shroud.operators.tokens import encode_tokens, prepare_samples, sample_batches

CFG = RedactionConfig(window_size=5)


def scorer():
    score = lambda padded, window: one_hot(F.transform(window, lambda t: F.when(t.token.isin("Maria", "Leon"), "B-PERSON")
                                                       .when(t.token.isin("Lopez", "Hale"), "I-PERSON").otherwise("O")), F.size(padded))
    return WindowedScorer(score, CFG, max_len=7)


def test_scorer_redacts_rows_without_or_with_shared_ids(spark):
    rows = [(None, "Dr. Maria Lopez lives in Paris since May 5, 2020."), (None, "Leon Hale too"), (7, "Maria Lopez and seven more words of text here"),
            (7, "no one"), (7, "Leon Hale"), (7, "Leon Hale"), (8, None)]
    got = Counter((r.doc_id, r.text, r.redacted_text) for r in redact(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), scorer(), cfg=CFG).collect())
    assert sum(got.values()) == len(rows)
    assert Counter((i, t) for i, t, _ in got.elements()) == Counter(rows)
    for (_, t, out) in got:
        assert out is None if t is None else not any(n in out for n in ("Maria", "Lopez", "Leon", "Hale"))
        assert t != "no one" or out == t


def test_encoded_samples_stay_apart(spark):
    vocab = spark.createDataFrame([(t, i + 2, 9 - i) for i, t in enumerate("abcdef")], "token string, id int, count long")
    rows = [(5, ["a", "b", "c"]), (5, ["d", "e", "f"]), (None, ["a", "zz"]), (None, ["[PAD]", "b"]), (5, ["a", "b", "c"]), (6, []), (7, ["[PAD]"])]
    want = [(5, [2, 3, 4]), (5, [5, 6, 7]), (None, [2, 1]), (None, [0, 3]), (5, [2, 3, 4]), (6, []), (7, [0])]
    df = spark.createDataFrame(rows, "k int, t array<string>").repartition(3)
    for head in (100, 2, 0):  # with a small head the rest of the vocabulary is joined
        got = encode_tokens(df, vocab, "t", ("k",), head_rows=head).collect()
        assert Counter((r.k, tuple(r.t), tuple(r.ids)) for r in got) == Counter((k, tuple(t), tuple(i)) for (k, t), (_, i) in zip(rows, want))
    samples = prepare_samples(df.withColumn("g", F.transform("t", lambda _: F.lit("O"))), max_len=4, tokens="t", tags="g", vocab=vocab, key_cols=("k",))
    got = Counter((r.k, tuple(r.ids), sum(r["mask"])) for r in samples.collect())
    assert got[5, (2, 3, 4, 0), 3] == 2 and got[5, (5, 6, 7, 0), 3] == 1 and sum(got.values()) == len(rows)


def test_encoding_runs_no_job_while_planned(spark):
    df = spark.createDataFrame([(1, ["a"])], "k int, t array<string>")
    vocab = spark.createDataFrame([("a", 2, 1)], "token string, id int, count long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    encode_tokens(df, vocab, "t", ("k",))
    assert len(tracker.getJobIdsForGroup("plan")) == 0
    spark.sparkContext.setJobGroup("rest", "rest")


def test_attach_and_merge_with_null_keys(spark):
    w = spark.createDataFrame([(None, 0, ["a"]), (None, 1, ["b"]), (1, 0, ["c"])], "doc_id int, window_no int, t array<string>")
    docs = spark.createDataFrame([(None, "x"), (1, "y"), (2, "z")], "doc_id int, text string")
    m = merge_windows(w, ["t"])
    assert {(r.doc_id, tuple(r.t or ())) for r in attach_documents(m, docs).collect()} == {(None, ("a", "b")), (1, ("c",)), (2, ())}
    assert {r.doc_id for r in attach_documents(m, docs, how="inner").collect()} == {None, 1}
    two = spark.createDataFrame([(1, "p", 0, ["a"]), (1, "q", 0, ["b"]), (1, None, 0, ["c"])], "doc_id int, v string, window_no int, t array<string>")
    merged = merge_windows(two, ["t"], key=["doc_id", "v"])
    back = attach_documents(merged, two.select("doc_id", "v"), key=["doc_id", "v"])
    assert {(r.v, tuple(r.t)) for r in back.collect()} == {("p", ("a",)), ("q", ("b",)), (None, ("c",))}


def test_sample_numbers_do_not_depend_on_the_plan(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 40).alias("doc_id"), F.floor(F.col("id") / 40).alias("window_no"))
    seen = []
    for parts, buckets in ((1, 1), (7, 13), (3, None)):
        got = sample_batches(df.repartition(parts), buckets=buckets).collect()
        assert sorted(r.sample_no for r in got) == list(range(1000))
        assert all(r.batch_no == r.sample_no // 8 and r.slot == r.sample_no % 8 for r in got)
        seen.append({(r.sample_no, r.doc_id, r.window_no) for r in got})
    assert seen[0] == seen[1] == seen[2]


def test_model_is_set_up_once_for_each_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid
        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return load_linear()

    score = model_scorer(spark, f"test {folder}", load, predict_linear, batch_size=3)
    rows = [(i, [f"Tok{i}", "x1", "9"] * (i % 4)) for i in range(50)] + [(None, None)]
    got = spark.createDataFrame(rows, "i int, t array<string>").repartition(24).select("i", "t", score(F.col("t")).alias("s")).collect()
    for r in got:
        assert r.s is None if r.t is None else np.allclose(np.array(r.s).reshape(-1, 11), predict_linear(load_linear(), [r.t])[0])
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert pids and len(set(pids)) == len(pids)


def test_stream_refuses_a_detector_that_gathers(spark, tmp_path):
    from shroud.streaming.redact import redact_stream
    spark.createDataFrame([(1, "x")], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="row by row"):
        redact_stream(stream, scorer())
    assert redact_stream(stream, RuleTagger()).isStreaming
