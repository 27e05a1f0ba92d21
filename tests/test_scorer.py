from pyspark.sql import functions as F

from shroud.operators.classify import argmax_labels, attach_predictions, batch_scorer
from shroud.operators.spans import bio_mentions, merge_windows
from shroud.operators.tokens import to_windows, with_tokens


def test_windowed_scorer_roundtrip(spark):
    def toy_model(batch):
        """Stand-in for a user's classifier: capitalised words after 'Dr' are a PERSON."""
        out = []
        for toks in batch:
            labels, prev = [], None
            for t in toks:
                if prev in ("Dr", "B-PERSON", "I-PERSON") and t[:1].isupper():
                    labels.append("B-PERSON" if prev == "Dr" else "I-PERSON")
                else:
                    labels.append("O")
                prev = labels[-1] if labels[-1] != "O" else t
            out.append(labels)
        return out

    docs = spark.createDataFrame([(1, "Dr Anna Berg met Dr Leon Hale. " * 3), (2, "")], "doc_id int, text string")
    w = to_windows(with_tokens(docs), size=4, overlap=0)
    score = batch_scorer(toy_model, batch_size=2)
    preds = w.select("doc_id", "window_no", score(F.transform("tokens", lambda t: t.token)).alias("labels"))
    scored = attach_predictions(w, preds)
    merged = merge_windows(scored, ["tokens", "labels"])
    m = merged.select(bio_mentions(F.col("tokens"), F.col("labels")).alias("m")).first().m
    assert len(merged.collect()) == 1   # the empty document has no window
    assert all(x.entity == "PERSON" for x in m) and len(m) >= 3


def test_argmax_labels(spark):
    df = spark.createDataFrame([([[0.1, 0.9] + [0.0] * 9, [0.5, 0.5] + [0.0] * 9],)], "s array<array<float>>")
    assert df.select(argmax_labels(F.col("s")).alias("l")).first().l == ["B-DATE", "O"]


def test_windowed_scorer_as_a_detector(spark):
    from shroud.config import RedactionConfig
    from shroud.operators.redact import redact
    from shroud.operators.scorer import WindowedScorer, one_hot
    docs = spark.createDataFrame([(1, "Dr Anna Berg met Dr Leon Hale in May. " * 3), (2, ""), (3, None), (4, "nothing here")], "doc_id int, text string")
    score = lambda padded, window: one_hot(F.transform(window, lambda t: F.when(t.token.isin("Anna", "Leon"), "B-PERSON")
                                                       .when(t.token.isin("Berg", "Hale"), "I-PERSON").otherwise("O")), F.size(padded))
    for overlap in (0, 2):
        cfg = RedactionConfig(window_size=5, overlap=overlap)
        out = {r.doc_id: r.redacted_text for r in redact(docs, WindowedScorer(score, cfg, max_len=7), cfg=cfg).collect()}
        assert set(out) == {1, 2, 3, 4} and out[2] == "" and out[3] is None and out[4] == "nothing here"
        assert not any(n in out[1] for n in ("Anna", "Berg", "Leon", "Hale")) and out[1].count(" met ") == 3
    cfg = RedactionConfig(window_size=5, join_how="inner")
    assert {r.doc_id for r in redact(docs, WindowedScorer(score, cfg, max_len=7), cfg=cfg).collect()} == {1, 4}


def test_scores_of_expressions_stay_in_their_rows(spark):
    from shroud.config import RedactionConfig
    from shroud.operators.scorer import WindowedScorer, one_hot
    rows = [(None, "Dr Anna Berg met Leon Hale today . " * 2), (None, "Leon"), (7, "Anna Berg"), (7, "Anna Berg"), (7, ""), (8, None), (9, "[PAD] Anna " * 4)]
    docs = with_tokens(spark.createDataFrame(rows, "doc_id int, text string").repartition(3))
    score = lambda padded, window: one_hot(F.transform(window, lambda t: F.when(t.token.isin("Anna", "Leon"), "B-PERSON")
                                                       .when(t.token.isin("Berg", "Hale"), "I-PERSON").otherwise("O")), F.size(padded))
    for how, trim, overlap in (("left", 0, 0), ("left", 1, 2), ("inner", 0, 2), ("inner", 1, 0)):
        cfg = RedactionConfig(window_size=5, overlap=overlap, edge_trim=trim, join_how=how)
        exploded, in_rows = (WindowedScorer(score, cfg, max_len=7, row_wise=r).tag(docs) for r in (False, True))
        got, want = (sorted(map(str, d.collect())) for d in (in_rows, exploded))
        assert in_rows.columns == exploded.columns and got == want and len(got) == (7 if how == "left" else 5)
    plan = in_rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1


def test_merged_windows_meet_their_documents_by_the_digest_itself(spark):
    from shroud.operators.scorer import WindowedScorer, one_hot
    docs = with_tokens(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string"))
    out = WindowedScorer(lambda padded, window: one_hot(F.transform(window, lambda _: F.lit("O")), F.size(padded))).tag(docs)
    join = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert "<=>" not in join
    assert {r.doc_id: r.labels for r in out.collect()} == {1: ["O", "O"], 2: []}


def test_scored_documents_shuffle_no_tokens(spark, tmp_path):
    from shroud.plans.queries import q_scored_documents
    d = str(tmp_path)
    spark.range(40).selectExpr("id AS o_orderkey", "id % 5 AS o_custkey", "timestamp'2020-01-02 00:00:00' AS o_orderdate").write.parquet(f"{d}/orders.parquet")
    spark.range(5).selectExpr("id AS c_custkey", "cast(id AS int) AS c_nationkey").write.parquet(f"{d}/customer.parquet")
    spark.range(25).selectExpr("cast(id AS int) AS n_nationkey", "concat('Land', chr(cast(97 + id AS int))) AS n_name").write.parquet(f"{d}/nation.parquet")
    out = q_scored_documents(spark, d)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan and "LeftOuter" not in plan
    assert out.count() == 40
