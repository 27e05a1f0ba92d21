from shroud.config import RedactionConfig
from shroud.operators.classify import RuleTagger
from shroud.operators.contacts import redact_contact_chain
from shroud.operators.redact import redact
from shroud.streaming.redact import start_redaction

ROWS = [(1, "Name: Anna Berg, a@b.com, (111) 222-3333, see https://x.org/p"), (2, "Dr. Leon Hale in Paris on 01/02/2003.")]


def test_stream_equals_batch(spark, tmp_path):
    src = spark.createDataFrame(ROWS, "doc_id long, text string")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    gaz = spark.createDataFrame([("paris",)], "entry string")
    q = start_redaction(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), detector=RuleTagger(gaz),
                        trigger_once=True, cfg=RedactionConfig(seed=7))
    q.awaitTermination(300)
    got = {r.doc_id: r.redacted_text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    exp = {r.doc_id: r.redacted_text for r in redact(src, RuleTagger(gaz), cfg=RedactionConfig(seed=7)).collect()}
    assert got == exp and "Anna" not in got[1] and "Paris" not in got[2]


def test_contacts_only_stream(spark, tmp_path):
    src = spark.createDataFrame(ROWS, "doc_id long, text string")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = start_redaction(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), trigger_once=True)
    q.awaitTermination(300)
    got = {r.doc_id: r.redacted_text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    exp = {r.doc_id: r.redacted_text for r in redact_contact_chain(src).collect()}
    assert got == exp and "a@b.com" not in got[1]
