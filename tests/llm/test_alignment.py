"""Token alignment against the libraries and plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shroud.llm import alignment

SCHEMA = "doc_id long, text string, n_a string, text_sha int, links string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def texts():
    rng = np.random.default_rng(5)
    words = "the of <|endoftext|> </s> Straße naïve 12345 don't日本 語😀 a.b.c\nnew\tline x2x -- ... ⁂   é é ﬁne 'll I'm".split(" ")
    out = [None, "", " ", "  ", "a", "the quick brown fox", "a  b", " lead", "trail ", "with ▁ inside", "\n\n\n", "<s> plain </s> <unk> <|endoftext|>",
           "word " * 3000 + "end", "x" * 2000, "\u0000 zero", "日本語" * 100, "tab\t \t mixed   spaces"]
    return out + [" ".join(rng.choice(words, n)) for n in (1, 2, 5, 20, 60, 200)]


def rows():
    t = texts()
    out = [(i, x, "n", 1, "l") for i, x in enumerate(t)]
    return out + [(5, t[5], None, None, None), (100, t[5], None, None, None), (None, t[5], None, None, None), (None, None, None, None, None), (101, t[18], "", 0, "")]


def byte_values():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return {(chr(b) if b in plain else chr(next(other))): b for b in range(256)}


def brute(libraries, table):
    a, b = libraries
    byte = byte_values()
    seen, links = {}, Counter()
    for t in {t for _, t, *_ in table if t}:
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        if b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            continue
        at, own_a = 0, []
        for i, r in zip(ids_a, raw_a):
            own_a.append((at, at + len(r), i))
            at += len(r)
        at, own_b = 0, []
        for i, r in zip(ids_b, raw_b):
            own_b.append((at, at + len(r), i))
            at += len(r)
        j, pairs = 0, []
        for s, e, i in own_a:
            while own_b[j][1] <= s:
                j += 1
            k = j
            while k < len(own_b) and own_b[k][0] < e:
                pairs.append((i, own_b[k][2]))
                k += 1
        both = sorted({e for _, e, _ in own_a} & {e for _, e, _ in own_b})
        groups, x, y = [], 0, 0
        for end in both:
            left, right = [], []
            while x < len(own_a) and own_a[x][1] <= end:
                left.append(str(own_a[x][2]))
                x += 1
            while y < len(own_b) and own_b[y][1] <= end:
                right.append(str(own_b[y][2]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        seen[t] = (len(own_a), len(own_b), len(both), pairs, ";".join(groups))
    for _, t, *_ in table:
        if t in seen:
            links.update(seen[t][3])
    top = defaultdict(int)
    for (_, j), n in links.items():
        top[j] = max(top[j], n)
    out = []
    for k, t, *_ in table:
        if t in seen:
            n_a, n_b, n_groups, pairs, groups = seen[t]
            out.append((k, n_a, n_b, n_groups, len(pairs), sum(links[p] == top[p[1]] for p in pairs), sum(links[p] for p in pairs),
                        hashlib.sha256(groups.encode()).hexdigest()))
        else:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
    return out


def same(got, want):
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_measures(spark, libraries, head):
    """With a small head most pairs are looked up by the join."""
    table = rows()
    got = alignment.measures(spark.createDataFrame(table, SCHEMA).repartition(3), head=head)
    same(got.collect(), brute(libraries, table))


def test_many_copies(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "HOT", 4)
    table = [(i, "one text of many copies" if i % 3 else f"text {i} of its own", "", 0, "") for i in range(60)] + [(i, None, "", 0, "") for i in range(30)]
    same(alignment.measures(spark.createDataFrame(table, SCHEMA)).collect(), brute(libraries, table))


def test_empty_table(spark):
    assert alignment.measures(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_keep_their_groups(spark):
    docs = spark.createDataFrame([(1, "unbelievable things"), (2, "unbelievable things"), (3, "a")], "doc_id long, text string")
    got = {r.text: r for r in alignment.aligned_texts(docs, with_groups=True).collect()}
    assert len(got) == 2 and got["unbelievable things"].copies == 2
    groups = got["unbelievable things"].groups
    assert hashlib.sha256(groups.encode()).hexdigest() == got["unbelievable things"].groups_sha256
    assert len(groups.split(";")) == got["unbelievable things"].n_groups


def test_encoders_agree_with_the_libraries(libraries):
    a, b = libraries
    pair = alignment.pair_of(alignment.FIRST, alignment.SECOND)
    rng = np.random.default_rng(9)
    letters = list("abcXYZ .,'\n\t 0123é日😀 ß-▁") + ["the ", " <|endoftext|>", "  "]
    many = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(3000)]
    assert [e.ids for e in a.encode_batch([" " + t for t in many], add_special_tokens=False)] == [pair.a.encode_ordinary(" " + t) for t in many]
    for text, ids, raw in zip(many, b.encode(many), pair.second(many)):
        pieces = [b.id_to_piece(i) for i in ids]
        exact = b"".join(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)) == (" " + text).encode()
        assert raw == (np.array(ids, "<u4").tobytes() if exact else None)


def test_slices():
    assert list(alignment.slices([])) == [] and list(alignment.slices(["a", "b"])) == [(0, 2)]
    big = "x" * alignment.SLICE
    assert list(alignment.slices([big, "a", big])) == [(0, 1), (1, 2), (2, 3)]


def test_query_on_the_table(spark, libraries):
    from shroud.llm.queries import all_queries
    table = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = all_queries()["op12_token_alignment"](spark, "/root/testdata/sf0.001").collect()
    same(got, brute(libraries, table))
