from pyspark.sql import functions as F

from shroud.operators.classify import RuleTagger
from shroud.operators.tokens import with_tokens
from shroud.plans.casenotes import case_notes, gazetteer
from conftest import SF_SMALL

TEXTS = [(1, "Visited New York and Paris. Then new york again, and New Yorkshire."),
         (2, "Name: Anna Berg moved to Paris on 01/02/2003."), (3, ""), (4, "Paris")]


def _labels(spark, tagger):
    df = with_tokens(spark.createDataFrame(TEXTS, "doc_id int, text string"))
    return {r.doc_id: list(r.labels) for r in tagger.tag(df).collect()}


def test_join_path_equals_inline_path(spark):
    gaz = spark.createDataFrame([("new york",), ("paris",), ("york",)], "entry string")
    inline = _labels(spark, RuleTagger(gaz))
    joined = _labels(spark, RuleTagger(gaz, inline_limit=1))
    assert inline == joined
    assert inline[1][1:3] == ["B-LOCATION", "I-LOCATION"]      # longest entry wins
    assert inline[2][2:4] == ["B-PERSON", "I-PERSON"]


def test_join_path_on_case_notes(spark):
    notes = with_tokens(case_notes(spark, SF_SMALL))
    a = RuleTagger(gazetteer(spark, SF_SMALL)).tag(notes).select("doc_id", "labels")
    b = RuleTagger(gazetteer(spark, SF_SMALL), inline_limit=1).tag(notes).select("doc_id", F.col("labels").alias("l2"))
    assert a.join(b, "doc_id").where(F.col("labels") != F.col("l2")).count() == 0


def _tagged(spark, rows, gaz, **kw):
    df = with_tokens(spark.createDataFrame(rows, "doc_id int, text string"))
    out = RuleTagger(gaz, **kw).tag(df).select("doc_id", "text", F.transform(F.arrays_zip("tokens", "labels"), lambda z: F.struct(z.tokens.token, z.labels)).alias("z"))
    return sorted((r.doc_id or -1, r.text, [tuple(x) for x in r.z]) for r in out.collect())


def test_names_of_any_length_and_shape(spark):
    rows = [(1, "Dr. Maria Carmen Lopez Garcia Hernandez Ruiz went."), (2, "Mr. McDonald met Ms. Smith-Jones and Dr. J. O'Neill here."),
            (3, "Dr. " + " ".join(f"Ab{'c' * (i % 5)}" for i in range(100)) + " end")]
    got = {i: [w for w, lab in z if lab.endswith("PERSON")] for i, _, z in _tagged(spark, rows, None)}
    assert got[1] == "Maria Carmen Lopez Garcia Hernandez Ruiz".split()
    assert got[2] == ["McDonald", "Smith", "-", "Jones", "J", ".", "O", "'", "Neill"]
    assert len(got[3]) == 100


def test_matches_do_not_overlap(spark):
    gaz = spark.createDataFrame([("new york",), ("york city",), ("paris",)], "entry string")
    rows = [(1, "Seen in New York City today."), (2, "Dr. May 5, 2020"), (7, "We went to Paris"), (7, "Went home."), (None, "Back in Paris")]
    inline, joined = _tagged(spark, rows, gaz), _tagged(spark, rows, gaz, inline_limit=1)
    assert inline == joined
    labels = {(i, t): [(w, lab) for w, lab in z if lab != "O"] for i, t, z in inline}
    assert labels[1, "Seen in New York City today."] == [("New", "B-LOCATION"), ("York", "I-LOCATION")]
    assert [lab for _, lab in labels[2, "Dr. May 5, 2020"]] == ["B-DATE"] + ["I-DATE"] * 3
    assert labels[7, "Went home."] == [] and labels[-1, "Back in Paris"] == [("Paris", "B-LOCATION")]
