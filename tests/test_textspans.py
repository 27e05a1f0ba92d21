"""Spans on raw text: names, dates, the gazetteer trie, overlaps, labels; redaction by position."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from shroud.config import RedactionConfig
from shroud.functions.dates import parse_date
from shroud.functions.textspans import KINDS, SPANS_TYPE, bio_labels, left_to_right, longest_first, rewrite_spans
from shroud.operators.classify import RuleTagger, Trie
from shroud.operators.mapping import name_entries
from shroud.operators.redact import redact
from shroud.operators.spans import inside_spans
from shroud.operators.tokens import with_tokens
from test_mapping import MENTIONS


def found(spark, texts, kind, gaz=None, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    out = RuleTagger(gaz, **kw).mentions(df, (kind,)).select("doc_id", "mentions").collect()
    return [[m.value for m in r.mentions] for r in sorted(out, key=lambda r: r.doc_id)]


def test_names(spark):
    texts = ["Dr. JOHN SMITH went.", "Name: ANNA-MARIA O'NEILL\nBERLIN", "Mr. Dr. Berg came", "Dr Anna  Berg and Ms. J. R. Novak.", "mr. berg", "Adr. Berg",
             "name :Emily Cortez", "Prof.Hale", "Name:\nEmily", "Dr. Émile Zola-Élan, Paris", "Drs Berg", None, "", "Mrs. A", "Rename: Berg"]
    assert found(spark, texts, "PERSON") == [
        ["JOHN SMITH"], ["ANNA-MARIA O'NEILL"], ["Berg"], ["Anna Berg", "J. R. Novak"], [], [], ["Emily Cortez"], ["Hale"], [], ["Émile Zola-Élan"], [],
        [], [], ["A"], []]


@pytest.mark.parametrize("text,value,date", [
    ("on 04/14/2024 1015 here", "04/14/2024 1015", "2024-04-14"), ("at 2020-01-02T10:30.", "2020-01-02T10:30", "2020-01-02"),
    ("2020-01-02T10:30:59", "2020-01-02T10:30:59", "2020-01-02"), ("2024/01/02", "2024/01/02", "2024-01-02"), ("4-14-2024", "4-14-2024", "2024-04-14"),
    ("in April 2024", "April 2024", "2024-04-01"), ("Sep 2024", "Sep 2024", "2024-09-01"), ("4/14/2024 9:05", "4/14/2024 9:05", "2024-04-14"),
    ("4/14/2024 9:05:10 x", "4/14/2024 9:05:10", "2024-04-14"), ("20240414", "20240414", "2024-04-14"), ("1/2/03", "1/2/03", "2003-01-02"),
    ("March 5 1995", "March 5 1995", "1995-03-05"), ("5 Mar 1995", "5 Mar 1995", "1995-03-05"), ("March  5,\t1995", "March 5, 1995", "1995-03-05"),
    ("04/14/2024 2575", "04/14/2024", "2024-04-14"),
])
def test_date_layouts(spark, text, value, date):
    assert found(spark, [text], "DATE") == [[value]]
    assert str(spark.createDataFrame([(value,)], "v string").select(parse_date(F.col("v")).alias("d")).first().d) == date


def test_no_dates(spark):
    assert found(spark, ["123456789012", "1/2/3", "99999999", "x2020-01-02", "2020-01-021", "May I", "Mayor 2020", "12/31/20201", "3.14"], "DATE") == [[]] * 9


def brute_trie(entries, text):
    tokens = list(re.finditer(r"\w+|[^\w\s]", text))
    out, free = [], 0
    for i, t in enumerate(tokens):
        if not t.group()[0].isupper() or t.start() < free:
            continue
        for j in range(len(tokens), i, -1):
            s = "".join((" " if k > i and tokens[k].start() > tokens[k - 1].end() else "") + tokens[k].group().lower() for k in range(i, j))
            if s in entries:
                out.append(re.sub(r"\s+", " ", text[t.start():tokens[j - 1].end()]))
                free = tokens[j - 1].end()
                break
    return out


ENTRIES = ["paris", "new york", "new york city", "st. helens", "york", "isle of man", "isle of wight", "a b c d e f g", "rio", "new"]


def test_trie_matches_loop(spark):
    rnd = random.Random(4)
    words = ["New", "york", "York", "City", "city", "St", ".", "Helens", "Isle", "of", "Man", "Wight", "Paris", "new", "A", "b", "c", "d", "e", "f", "g", ",", "\n", "Rio"]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " ", " ", "  "]) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    gaz = spark.createDataFrame([(e,) for e in ENTRIES] + [(None,)], "entry string")
    want = [brute_trie(set(ENTRIES), t) for t in texts]
    assert found(spark, texts, "LOCATION", gaz) == want
    assert found(spark, texts, "LOCATION", gaz, inline_limit=1) == want


def test_trie_holds_prefixes_of_longer_entries():
    t = Trie(ENTRIES)
    assert t.first == {"new", "st", "isle", "a"} and "new york" in t.prefixes and "st." in t.prefixes and "york" not in t.prefixes and t.most == 7


def test_long_entry_in_a_large_gazetteer(spark):
    long = " ".join(f"w{i}" for i in range(30))
    gaz = spark.range(200_000).select(F.concat(F.lit("place"), F.col("id")).alias("entry")).unionByName(
        spark.createDataFrame([(long,), ("place7 bay",)], "entry string"))
    text = "Went to " + long.capitalize() + " and Place12, Place7 Bay. " + long
    assert found(spark, [text, "Place7 bayou"], "LOCATION", gaz) == [[long.capitalize(), "Place12", "Place7 Bay"], ["Place7"]]
    small = spark.createDataFrame([(long,), ("paris",)], "entry string")
    assert found(spark, [text + " Paris"], "LOCATION", small) == [[long.capitalize(), "Paris"]]


def brute_longest(spans):
    out = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])):
        if all(s[1] <= t[0] or t[1] <= s[0] for t in out):
            out.append(s)
    return sorted(out)


def brute_left(spans):
    out, free = [], 0
    for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1], s[2])):
        if s[0] >= free:
            out.append(s)
            free = s[1]
    return out


def test_overlaps_match_loops(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        starts = [rnd.randint(0, 60) for _ in range(rnd.randint(0, 14))]
        rows.append((i, [(s, s + rnd.randint(1, 12), rnd.randint(0, 5)) for s in starts]))
    df = spark.createDataFrame(rows, f"i int, s {SPANS_TYPE}")
    for r in df.select("i", longest_first(F.col("s")).alias("a"), left_to_right(F.col("s")).alias("b")).collect():
        assert [tuple(x) for x in r.a] == brute_longest(set(rows[r.i][1])) or len(set(rows[r.i][1])) < len(rows[r.i][1])
        assert [tuple(x) for x in r.b] == brute_left(rows[r.i][1])


def test_labels_and_rewrite(spark):
    df = with_tokens(spark.createDataFrame([("Ab cd, ef Gh.", [(0, 5, 0), (7, 12, 2)]), ("x y", []), ("q", [(0, 1, 1)])], f"text string, s {SPANS_TYPE}"))
    got = df.select(bio_labels(F.col("tokens"), F.col("s")).alias("l"), rewrite_spans(F.col("text"), F.transform("s", lambda s: F.struct(
        s.start.alias("start"), s.end.alias("end"), F.when(s.rank != 1, F.lit("<>")).alias("fake")))).alias("t")).collect()
    assert [r.l for r in got] == [["B-PERSON", "I-PERSON", "O", "B-LOCATION", "I-LOCATION", "O"], ["O", "O"], ["B-DATE"]]
    assert [r.t for r in got] == ["<>, <>.", "x y", "q"]
    assert KINDS[:3] == ("PERSON", "DATE", "LOCATION")


def test_redaction_by_position(spark):
    """Longest find of overlapping ones, whatever its kind; nothing else changes, and no step sees a fake."""
    gaz = spark.createDataFrame([("paris",), ("smith",)], "entry string")
    rows = [(1, "Dr. Anna Smith (paris) saw Paris and Anna. Mail anna.smith@paris.example.org, https://x.example.org/20200102/5551234567 on 2020-01-02."),
            (2, None), (3, ""), (None, "Dr. Leon Hale, Name: LEON"), (None, "Ms. Berg")]
    cfg = RedactionConfig(mode="spans")
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {(r.doc_id, r.text): r.redacted_text for r in redact(df, RuleTagger(gaz), cfg=cfg).collect()}
    one = got[rows[0]]
    assert one.startswith("Dr. ") and " (paris) saw " in one and " and Anna. Mail " in one  # only what was found changes
    assert not re.search(r"Smith|Paris|anna\.smith|x\.example|20200102|5551234567|2020-01-02", one)
    assert got[2, None] is None and got[3, ""] == "" and "Hale" not in got[rows[3]] and "LEON" not in got[rows[3]] and "Berg" not in got[rows[4]]
    with pytest.raises(ValueError):
        redact(df, RuleTagger(gaz), cfg=RedactionConfig(mode="other"))


def test_fakes_of_a_document_differ(spark):
    """Two name parts of a document never get one fake, also with more names than the pool holds."""
    for n in (12, 300):
        ments = [("PERSON", i, f"Firstname{chr(97 + i % 26)}{i} Lastname{i}", 0, 1, 0, 0) for i in range(n)]
        df = spark.createDataFrame([(d, ments) for d in range(5)], f"doc_id int, mentions {MENTIONS}")
        for r in df.select(name_entries(F.col("mentions"), F.col("doc_id"), 200).alias("e")).collect():
            firsts, lasts = ([e.fake for e in r.e if e.real.startswith(p)] for p in ("first", "last"))
            assert len(set(firsts)) == len(firsts) == n and len(set(lasts)) == len(lasts) == n
    from shroud.functions.fakes import NAME_POOLS
    own = [("PERSON", i, f"{f} {l}", 0, 1, 0, 0) for i, (f, l) in enumerate(zip(NAME_POOLS["first"], NAME_POOLS["last"]))]
    for r in spark.createDataFrame([(d, own) for d in range(8)], f"doc_id int, mentions {MENTIONS}").select(
            name_entries(F.col("mentions"), F.col("doc_id"), 200).alias("e")).collect():
        assert all(e.real != e.fake.lower() for e in r.e)


def test_document_of_many_names(spark):
    """Thousands of names in one document: found, mapped and rewritten without comparing each with each."""
    def note(n):
        return "".join(f"Dr. Ann{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} Bergo{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} came.\n"
                       for i in range(n))
    cfg = RedactionConfig(mode="spans")
    df = spark.createDataFrame([(1, note(5000))], "doc_id int, text string")
    start = time.time()
    out = redact(df, RuleTagger(), cfg=cfg).first().redacted_text
    assert time.time() - start < 90
    assert out.count("Dr. ") == 5000 and out.count(" came.\n") == 5000 and not re.search(r"Ann[a-z]{3}|Bergo[a-z]{3}", out)
    lines = re.findall(r"Dr\. (\S+) (\S+) came", out)
    assert len({a for a, _ in lines}) == len({b for _, b in lines}) == 5000


def test_range_join_equals_arrays(spark):
    rnd = random.Random(6)
    docs = []
    for d in [None, *range(60)]:
        spans = [(s, s + rnd.choice([0, 1, 5, 700])) for s in (rnd.randint(0, 2000) for _ in range(rnd.randint(0, 6)))]
        docs.append((d, spans, [rnd.randint(0, 2800) for _ in range(20)]))
    spans = spark.createDataFrame([(d, *s) for d, x, _ in docs for s in x], "doc_id int, start int, end int")
    matches = spark.createDataFrame([(d, p) for d, _, ps in docs for p in ps], "doc_id int, start int")
    want = sorted(((d is not None, d or 0), p) for d, x, ps in docs for p in ps if any(a <= p < b for a, b in x))
    for width in (256, 16):
        got = inside_spans(matches, spans, width=width).collect()
        assert sorted(((r.doc_id is not None, r.doc_id or 0), r.start) for r in got) == want
