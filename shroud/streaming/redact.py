"""Structured Streaming: the same row-local redaction on a streaming DataFrame.

Every step of the contact rewrite and of the rule-based pipeline is a per-row expression and
every fake is a pure function of (seed, document, value), so no state store, watermark or
shuffle is involved: a micro-batch is redacted exactly like a batch, and a replayed batch after
a failure produces the same output (exactly-once with an idempotent sink and the checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import RedactionConfig
from ..operators.contacts import redact_contact_chain
from ..operators.redact import redact


def redact_stream(stream: DataFrame, detector=None, text: str = "text", key: str = "doc_id",
                  cfg: RedactionConfig = RedactionConfig()) -> DataFrame:
    """Streaming ``(key, text) -> (key, text, redacted_text)``.

    With a ``detector`` the full span pipeline runs (its gazetteer is loaded once, up front);
    without one only emails, phones and URLs are rewritten.
    """
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame (spark.readStream...)")
    if detector is None:
        return redact_contact_chain(stream, text=text, key=key, seed=cfg.seed, order=cfg.order)
    if not hasattr(detector, "mentions"):
        raise ValueError("streaming needs a detector that works row by row, such as RuleTagger: one that gathers windows "
                         "joins the stream with itself; run it in batch or inside foreachBatch")
    load = getattr(detector, "_load", None)
    if load is not None:
        load()
        if getattr(detector, "gazetteer", None) is not None and not detector._inline:
            raise ValueError("streaming needs a gazetteer small enough to inline (the join path regroups "
                             "per document, which would need state); raise inline_limit or run in batch")
    return redact(stream, detector, text=text, key=key, cfg=cfg)


def start_redaction(stream: DataFrame, path: str, checkpoint: str, detector=None, fmt: str = "parquet",
                    trigger_once: bool = False, **kw) -> StreamingQuery:
    """Write the redacted stream to ``path``; ``checkpoint`` must be shared storage on a cluster."""
    out = redact_stream(stream, detector, **kw).writeStream.format(fmt).option("checkpointLocation", checkpoint) \
        .option("path", path).outputMode("append")
    if trigger_once:
        out = out.trigger(availableNow=True)
    return out.start()
