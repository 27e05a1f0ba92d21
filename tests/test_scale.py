"""Steps that must not fall to a few tasks, be done twice, or hold a whole batch of scores."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shroud.config import LABEL2ID
from shroud.functions.arrays import exploded, starts_inside
from shroud.functions.dates import parse_date
from shroud.functions.fakes import fake_email, fake_location, fake_phone
from shroud.functions.textspans import located
from shroud.operators.classify import RuleTagger
from shroud.operators.mapping import name_entries
from shroud.operators.models import load_linear, model_scorer, predict_linear
from shroud.operators.scorer import one_hot
from shroud.operators.spans import bio_mentions
from shroud.operators.tokens import prepare_samples, sample_batches, token_rows, with_tokens
from shroud.plans.casenotes import case_notes
from shroud.plans.queries import q_attach_documents, q_training_samples, q_vocab_encode, q_vocabulary
from shroud.sources.tables import SCAN_PARTITIONS, spread


def test_scan_of_one_row_group_is_dealt_out(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    kept = spark.conf.get(SCAN_PARTITIONS, None)
    spark.conf.unset(SCAN_PARTITIONS)
    try:
        dealt = spread(spark.read.parquet(str(tmp_path / "t")), "id")
        assert dealt.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    finally:
        if kept is not None:
            spark.conf.set(SCAN_PARTITIONS, kept)


def test_array_is_not_made_again_in_a_filter_before_the_generator(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "doc_id int, text string")
    tokens = token_rows(df.repartition(2, "doc_id"))
    plan = tokens._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in "".join(line for line in plan.splitlines() if "Filter" in line)
    assert [tuple(r) for r in tokens.orderBy("pos").collect()] == [(1, 0, "a", 0, 1), (1, 1, "b", 2, 3)]


def test_exploded_keeps_null_elements_and_drops_empty_rows(spark):
    df = spark.createDataFrame([(1, [5, None]), (2, []), (3, None)], "k int, v array<int>")
    assert sorted((r.k, r.p, r.x) for r in exploded(df, ["k"], F.col("v"), "x", "p").collect() if r.x) == [(1, 0, 5)]
    assert exploded(df, ["k"], F.col("v"), "x").count() == 2


def test_scores_are_returned_a_few_batches_at_a_time(spark):
    score = model_scorer(spark, "linear", load_linear, predict_linear)
    lists = pa.array([["Anna", "7"], None] * 150, pa.list_(pa.string()))
    sizes = [len(x) for x in score.func(iter([lists]))]
    assert sum(sizes) == 300 and max(sizes) <= 64
    got = spark.createDataFrame([(["Anna", "7"],), (None,)], "x array<string>").select(score("x").alias("s")).collect()
    assert len(got[0].s) == 2 and len(got[0].s[0]) == 11 and got[1].s is None


def test_tokens_with_sentinel_empty_and_null_texts(spark):
    texts = ["", None, "a\u0000b  c.", "ß\U0001f600 x", "   "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1)
    got = {r.doc_id: r.tokens for r in with_tokens(df).collect()}
    assert got[0] == [] and got[1] is None and got[4] == []
    assert [tuple(t) for t in got[2]] == [("a", 0, 1), ("\u0000", 1, 2), ("b", 2, 3), ("c", 5, 6), (".", 6, 7)]
    assert [tuple(t) for t in got[3]] == [("ß", 0, 1), ("\U0001f600", 1, 2), ("x", 3, 4)]


def test_located_group_with_and_without_sentinel(spark):
    df = spark.createDataFrame([("k: ab, k: c",), ("\u0000k: ab",), ("none",)], "t string").coalesce(1)
    got = [[tuple(x) for x in r.s] for r in df.select(located(F.col("t"), "k: ([a-z]+)", 1).alias("s")).collect()]
    assert got == [[(3, 5, "ab"), (10, 11, "c")], [(4, 6, "ab")], []]


def test_parse_date_tries_only_layouts_of_the_same_shape(spark):
    values = {"13/1/2020": "2020-01-13", "2020/1/3": "2020-01-03", "1/2/99": "1999-01-02", "MAY 3 2020": "2020-05-03", "3 september 2020": "2020-09-03",
              "2020-1-3t4:05": "2020-01-03", "Sep 2020": "2020-09-01", "January -5, 2020": None, "20200231": None, "x/y": None, "": None}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r.v: r.d and str(r.d) for r in df.select("v", parse_date(F.col("v")).alias("d")).collect()} == values


def test_sample_batches_makes_samples_once(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(0).alias("window_no"))
    got = sample_batches(df)
    assert sorted(r.sample_no for r in got.collect()) == list(range(50))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(_bucket" not in plan


@pytest.fixture()
def notes_dir(spark, tmp_path):
    """Tables of a few orders, customers and nations, and two documents."""
    d = str(tmp_path)
    spark.range(40).selectExpr("id AS o_orderkey", "id % 5 AS o_custkey", "timestamp'2020-01-02 00:00:00' AS o_orderdate").coalesce(1).write.parquet(f"{d}/orders.parquet")
    spark.range(5).selectExpr("id AS c_custkey", "cast(id AS int) AS c_nationkey").coalesce(1).write.parquet(f"{d}/customer.parquet")
    spark.range(25).selectExpr("cast(id AS int) AS n_nationkey", "concat('Land', chr(cast(97 + id AS int))) AS n_name").coalesce(1).write.parquet(f"{d}/nation.parquet")
    spark.createDataFrame([(1, "a b. a"), (2, None)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_notes_are_dealt_out_behind_their_joins(spark, notes_dir):
    kept = {k: spark.conf.get(k, None) for k in (SCAN_PARTITIONS, "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set(SCAN_PARTITIONS, "13")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        notes = case_notes(spark, notes_dir)
        assert notes.count() == 40 and notes.rdd.getNumPartitions() == 13
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_fakes_hash_a_key_once(spark):
    df = spark.createDataFrame([(1, "Paris")], "doc_id int, v string")
    for fake in (fake_location, fake_phone, fake_email):
        assert _plan(df.select(fake(F.col("v"), F.col("doc_id"), 200).alias("f"))).count("md5(") == 1
    mentions = "array<struct<entity:string,ord:int,value:string>>"
    df = spark.createDataFrame([(1, [("PERSON", 0, "Ann Lee")])], f"doc_id int, mentions {mentions}")
    assert _plan(df.select(name_entries(F.col("mentions"), F.col("doc_id"), 200).alias("e"))).count("md5(") == 2  # one for each pool


def test_starts_inside_few_and_many_spans(spark):
    spans = [(i * 10, i * 10 + 3) for i in range(40)]
    schema = "starts array<int>, spans array<struct<start:int,end:int>>"
    df = spark.createDataFrame([([0, 2, 3, 391, 393], spans), ([0, 2, 3], spans[:1]), ([1], [])], schema)
    got = [r.x for r in df.select(starts_inside(F.col("starts"), F.col("spans")).alias("x")).collect()]
    assert got == [[True, True, False, True, False], [True, True, False], [False]]


def test_one_hot_vectors_are_constants(spark):
    df = spark.createDataFrame([(["O", "nothing"],)], "labels array<string>").select(one_hot(F.col("labels"), F.lit(3)).alias("s"))
    assert "sequence(" not in _plan(df)
    first, unknown, filler = df.first().s
    assert first == [1.0] + [0.0] * 10 and unknown == [0.0] * 11 and sum(filler) == 1.0


def test_samples_are_encoded_before_padding_and_numbered_without_their_slots(spark, notes_dir):
    df = spark.createDataFrame([(1, 0, ["a", "[PAD]"], ["B-PERSON", "O"]), (2, 0, ["a", "b", "c", "d"], ["O", "O", "O", "wrong"])],
                               "doc_id int, window_no int, tokens array<string>, tags array<string>")
    got = {r.doc_id: r for r in prepare_samples(df, max_len=3, tags="tags").collect()}
    assert got[1].mask == [1, 0, 0] and got[1].targets == [LABEL2ID["B-PERSON"], 0, 0] and got[2].mask == [1, 1, 1] and got[2].targets == [0, 0, 0]
    plan = _plan(q_training_samples(spark, notes_dir))
    assert plan.index("Window [") < plan.index("array_join")


def test_vocabulary_needs_no_offsets_and_windows_only_their_own_size(spark, notes_dir):
    vocab = q_vocabulary(spark, notes_dir)
    assert "ArrowEvalPython" not in _plan(vocab)
    assert sorted((r.token, r.id, r["count"]) for r in vocab.collect()) == [(".", 3, 1), ("a", 2, 2), ("b", 4, 1)]
    encoded = q_vocab_encode(spark, notes_dir)
    assert "64 AS max_len" not in _plan(encoded)
    assert [r.ids_text.split()[:5] for r in encoded.collect() if r.ids_text] == [["2", "4", "3", "2", "0"]]


def test_tokens_and_spans_come_from_marked_texts(spark):
    texts = ["Name: Ann Lee saw Paris on May 5, 2020.", "Dr. May 5, 2020 \U0001f600 Paris", "a\u0000b Dr. Anna Berg in Paris", "xParis \U0001d49cParis", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2, "doc_id")
    tagger = RuleTagger(spark.createDataFrame([("paris",)], "entry string"))
    found = tagger.find(with_tokens(df))
    udfs = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in line]
    assert udfs and "split(" not in "".join(udfs) and "spans(" in "".join(udfs)  # no arrays go to Python, spans need no step for each
    got = {r.doc_id: r for r in found.collect()}
    words = lambda r: [(r.text[s.start:s.end], s["rank"]) for s in r._spans]
    assert words(got[0]) == [("Ann Lee", 0), ("Paris", 2), ("May 5, 2020", 1)]
    assert words(got[1]) == [("May 5, 2020", 1), ("Paris", 2)]  # the longest where spans meet
    assert words(got[2]) == [("Anna Berg", 0), ("Paris", 2)]
    assert [got[i]._spans for i in (3, 4, 5)] == [[], [], []] and got[5].tokens is None
    assert all([r.text[t.start:t.end] for t in r.tokens] == [t.token for t in r.tokens] for r in got.values() if r.text)


def test_mentions_step_over_labelled_tokens_only(spark):
    tokens = [(w, 2 * i, 2 * i + 1) for i, w in enumerate("abcdef")]
    labels = ["O", "B-PERSON", None, "O", "I-PERSON", "B-DATE"]
    df = spark.createDataFrame([(1, tokens, labels), (2, tokens[:1], ["O"]), (3, [], []), (4, tokens, None)],
                               "k int, tokens array<struct<token:string,start:int,end:int>>, labels array<string>").repartition(2, "k")
    m = df.select("k", bio_mentions(F.col("tokens"), F.col("labels")).alias("m"))
    got = {r.k: r.m and [(x.entity, x.value, x.first, x.last) for x in r.m] for r in m.collect()}
    assert got == {1: [("PERSON", "b", 1, 1), ("DATE", "f", 5, 5)], 2: [], 3: [], 4: None}


def test_attached_documents_are_dealt_out_once(spark, tmp_path):
    rows = [(1, "a b. " * 600), (1, "c"), (None, "d e"), (None, "f"), (2, ""), (3, "a\u0000b  ß\U0001f600 x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert with_tokens(docs, python=False).collect() == with_tokens(docs).collect()
    got = q_attach_documents(spark, str(tmp_path))
    left = [(1, 3000, 1801), (1, 1, 1801), (None, 3, 3), (None, 1, 3), (2, 0, None), (3, 9, 6)]
    want = [("left", *r) for r in left] + [("inner", *r) for r in left if r[0] != 2]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    nodes = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("ArrowEvalPython" in x for x in nodes)
    moved = [x.split("Exchange ")[1] for x in nodes if "Exchange hashpartitioning" in x]
    assert moved and not any(x.startswith("hashpartitioning(doc_id") and "ENSURE_REQUIREMENTS" in x for x in moved)
    assert all("n_chars" in x and "text#" not in x for x in _plan(got).splitlines() if x.lstrip(" :+-").startswith("Project [left AS how"))
