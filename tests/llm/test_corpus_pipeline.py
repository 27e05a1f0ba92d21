"""The pipeline's stages, one after the other, against brute-force versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from shroud.llm import bpe_tree, mix, quality
from test_operators import base_stats, brute_classes, brute_distances, brute_mix, pii_spans, prose, quality_vectors, shingle_sets


def documents():
    rng = np.random.default_rng(11)
    rows = [(None, None, None, None, None), (0, None, "en", "a", None), (1, "", "en", "a", 0), (2, "too short", "en", "a", 9), (3, "again and " * 40, "de", "b", 400)]
    for i in range(4, 60):
        t = " ".join(f"{w}{rng.integers(500)}" for w in prose(i, 40 + i).split())
        if i % 5 == 0:
            t += f" mail x{i}@mail.example.com, +49 30 1234 56{i} or 10.0.{i}.7, card 4111 1111 1111 1111 end"
        rows.append((i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], len(t)))
    near = rows[20][1].split()
    near[5] = "changed"
    rows += [(60, " ".join(near), "en", "c", 1), (61, rows[21][1], "en", "c", 1), rows[22], rows[22]]
    return rows


def redacted(t):
    out, done = [], 0
    for start, _, kind, end in sorted(pii_spans(t)):
        if start >= done:
            out += [t[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + t[done:]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(*r, "extra") for r in documents()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bin string").write.parquet(f"{d}/documents.parquet")
    return d


def test_stages_in_a_chain(spark, sf_dir):
    rows = documents()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test")
        seen.append((name, docs.columns, [tuple(r) for r in docs.collect()]))
        if name != "tokens":
            assert docs.columns == columns
    got = {name: out for name, _, out in seen}

    def passes(t):
        s = base_stats(t)
        return s[0] >= 10 and 100 * s[4] <= 20 * s[0]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    far = brute_distances(quality_vectors(frame))
    good = [tuple(r) for r, d in zip(frame.collect(), far) if passes(r.text) and d <= quality.CUTOFF]
    assert Counter(r[:5] for r in got["quality rules"]) == Counter(good)

    want, n_classes = brute_classes(good)
    stay = [r for r, (i, c) in {(r[0], r[1]): (r, w) for r, w in zip(good, want)}.values() if i == c and shingle_sets(r[1])]
    assert len(stay) == n_classes
    assert Counter(r[:5] for r in got["near duplicates"]) == Counter(stay)

    clean = [(r[0], redacted(r[1]), r[2], r[3], len(redacted(r[1]))) for r in stay]
    assert Counter(r[:5] for r in got["personal data"]) == Counter(clean)
    assert sum("[EMAIL]" in r[1] for r in clean) >= 8

    u = {r.doc_id: r.u for r in mix.plan(spark.createDataFrame([r[:4] for r in clean], "doc_id long, text string, lang string, source string")).collect()}
    _, _, copies = brute_mix(clean, [u[r[0]] for r in clean])
    mixed = Counter({r: n for r, n in zip(clean, copies) if n})
    assert Counter(r[:5] for r in got["source mix"]) == mixed

    plain = bpe_tree.codec(public_tokenizers.path(bpe_tree.VOCABULARY)).plain
    tokens = Counter()
    for r, n in mixed.items():
        ids = plain.encode_ordinary(r[1])
        raw = np.array(ids, "<u4").tobytes()
        tokens[r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest(), raw] += n
    assert Counter((*r[:4], bytes(r[4])) for r in got["tokens"]) == tokens


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.collect() == []


def test_the_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "source mix", "tokens"]
