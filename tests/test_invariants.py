"""Literal rows for results that must not depend on sizes, switches or physical plans."""

import json
import time

from pyspark.sql import functions as F

from shroud.functions.patterns import EMAIL_PATTERN, find_all
from shroud.functions.rewrite import replace_with_map
from shroud.operators.broadcast import fits
from shroud.operators.classify import argmax_labels
from shroud.operators.spans import merge_windows, unpad
from shroud.operators.tokens import build_vocabulary, to_windows
from shroud.sources.files import read_json_object


def test_long_run_beside_an_at_is_linear(spark):
    df = spark.createDataFrame([("@ " + "a" * 200_000,), ("x@y.z " * 2,), ("a@b.c_d@e.f, .x@y..z-@q.r",)], "t string")
    find = lambda: [r.m for r in df.select(find_all("email", F.col("t")).alias("m")).collect()]
    find()
    t0 = time.perf_counter()
    got = find()
    assert time.perf_counter() - t0 < 5
    plain = [r.m for r in df.where("length(t) < 100").select(F.regexp_extract_all("t", F.lit(EMAIL_PATTERN), F.lit(0)).alias("m")).collect()]
    assert got == [[]] + plain


def test_last_key_wins_for_any_number_of_matches(spark):
    entries = F.array(*[F.struct(F.lit(k).alias("real"), F.lit(v).alias("fake")) for k, v in (
        ("APRIL 5, 2020", "zzz"), ("April 5, 2020", "aaa"), ("May 1, 2020", "mmm"))])
    df = spark.createDataFrame([("April 5, 2020; ",)], "t string")
    for n in (2, 400):
        out = df.select(replace_with_map(F.repeat("t", F.lit(n)), entries, ignore_case=True).alias("o")).first().o
        assert out == "aaa; " * n


def test_trim_and_overlap_lose_the_true_ends_alone(spark):
    df = spark.createDataFrame([(1, list(range(237)))], "doc_id int, x array<int>")
    for overlap, trim in ((20, 1), (20, 0), (2, 1), (20, 5)):
        w = to_windows(df, size=100, overlap=overlap, tokens="x")
        got = merge_windows(w, ["x"], edge_trim=trim, overlap=overlap).first().x
        assert got == list(range(trim, 237 - trim)), (overlap, trim)


def test_vocabulary_ids_without_reuse_or_coalescing(spark):
    words = [(w,) for i in range(300) for w in [f"token{i:04d}"] * (1 + i % 3)] + [("é",), ("",), ("a" * 50,)]
    df = spark.createDataFrame(words, "token string").repartition(7)
    keys = ("spark.sql.exchange.reuse", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for on in ("true", "false"):
            for k in keys:
                spark.conf.set(k, on)
            got = {r.token: r.id for r in build_vocabulary(df).collect()}
            count = {}
            for (w,) in words:
                count[w] = count.get(w, 0) + 1
            order = sorted(count, key=lambda w: (-count[w], w.encode()))
            assert got == {w: i + 2 for i, w in enumerate(order)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_masked_scores_and_unpad(spark):
    df = spark.createDataFrame([([[0.1, 0.9] + [0.0] * 9, [0.5, 0.5] + [0.0] * 9, [0.0] * 10 + [1.0]], [1, 0, 1])], "s array<array<float>>, m array<int>")
    labels = argmax_labels(F.col("s"), F.col("m"))
    assert df.select(labels.alias("l")).first().l == ["B-DATE", None, "I-PHONE_NUMBER"]
    assert df.select(unpad(labels, F.col("m")).alias("l")).first().l == ["B-DATE", "I-PHONE_NUMBER"]


def test_json_reads_one_file(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"O": 0}))
    (tmp_path / "a.json").write_text(json.dumps({"seed": 1}))
    got = read_json_object(spark, str(tmp_path))
    assert got.columns == ["seed"] and got.first().seed == 1


def test_fits_counts_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 10, "t string")
    assert fits(df, 10) and not fits(df, 9) and not fits(df, 10, max_bytes=5000)


def test_no_jobs_while_plans_are_built(spark):
    from shroud.plans.casenotes import case_notes
    from shroud.sources.tables import documents
    from conftest import SF_SMALL
    spark.sparkContext.setJobGroup("plans", "plans")
    try:
        for build in (case_notes, documents):
            build(spark, SF_SMALL)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 5  # footers of the five tables


def test_fake_names_differ_from_the_real_ones(spark):
    from shroud.functions.fakes import fake_location, fake_name_part
    from shroud.functions import pools as P
    names = [*P.flat(P.FIRST_NAMES), *P.flat(P.LAST_NAMES)]
    df = spark.createDataFrame([(n, r, i) for n in names for r in ("first", "middle", "last") for i in range(5)], "n string, r string, i int")
    assert df.where(F.lower(fake_name_part(F.col("n"), F.col("r"), F.col("i"), 1, F.lower("n"))) == F.lower("n")).count() == 0
    places = spark.createDataFrame([(n, i) for n in [*P.flat(P.CITIES), *P.COUNTRIES] for i in range(5)], "n string, i int")
    assert places.where(F.lower(fake_location(F.col("n"), F.col("i"), 1)) == F.lower("n")).count() == 0
