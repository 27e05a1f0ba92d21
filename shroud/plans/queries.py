"""Registered queries: one per operator group, each ``(spark, sf_dir) -> DataFrame`` over whole tables.

Every computed column carries the same alias as in the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_SEED
from ..operators.contacts import find_contacts, redact_contact_chain, redact_kind
from ..sources.tables import contact_corpus, documents, page_texts

SEED = DEFAULT_SEED
Query = Callable[[SparkSession, str], DataFrame]


def q_find_emails(spark, sf_dir):
    return find_contacts(documents(spark, sf_dir), "email", out="email")


def q_find_phones(spark, sf_dir):
    return find_contacts(documents(spark, sf_dir), "phone", out="phone")


def q_find_urls(spark, sf_dir):
    return find_contacts(page_texts(spark, sf_dir), "url", out="url")


def q_redact_emails(spark, sf_dir):
    return redact_kind(documents(spark, sf_dir), "email", seed=SEED).select("doc_id", "redacted_text")


def q_redact_phones(spark, sf_dir):
    return redact_kind(documents(spark, sf_dir), "phone", seed=SEED).select("doc_id", "redacted_text")


def q_redact_urls(spark, sf_dir):
    return redact_kind(page_texts(spark, sf_dir), "url", seed=SEED).select("doc_id", "redacted_text")


def q_redact_contacts(spark, sf_dir):
    """Flagship: emails -> phones -> URLs over documents and page texts in one pass."""
    return redact_contact_chain(contact_corpus(spark, sf_dir), seed=SEED).select("doc_id", "source",
                                                                                  "redacted_text")


def contact_queries() -> dict[str, Query]:
    return {
        "find_emails": q_find_emails,
        "find_phones": q_find_phones,
        "find_urls": q_find_urls,
        "redact_emails": q_redact_emails,
        "redact_phones": q_redact_phones,
        "redact_urls": q_redact_urls,
        "redact_contacts": q_redact_contacts,
    }


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(contact_queries())
    out.update(token_queries())
    out.update(casenote_queries())
    out.update(io_queries())
    return out


# ------------------------------------------------------------------ tokens, windows, samples

from ..config import LABEL2ID  # noqa: E402
from ..functions.arrays import add_special, exploded, strip_edges, windows  # noqa: E402
from ..operators.tokens import (build_vocabulary, prepare_samples, to_windows, token_rows,  # noqa: E402
                                with_tokens)
from ..operators.classify import argmax_ids, argmax_labels  # noqa: E402
from ..operators.spans import gather_windows, merge_windows, merged_column  # noqa: E402
from ..sources.tables import read_table  # noqa: E402

WINDOW_CONFIGS = ((510, 0, 512), (100, 20, 64))  # (window size, overlap, padded length)


def doc_tokens(spark, sf_dir):
    return with_tokens(documents(spark, sf_dir))


def q_tokenize_offsets(spark, sf_dir):
    return token_rows(documents(spark, sf_dir))


def q_special_tokens(spark, sf_dir):
    d = doc_tokens(spark, sf_dir).withColumn("s", add_special(F.col("tokens")))
    return d.select("doc_id", F.size("s").alias("n_with_special"),
                    F.col("s")[0].token.alias("first_token"), F.col("s")[1].token.alias("second_token"),
                    F.element_at("s", -1).token.alias("last_token"),
                    (strip_edges(F.col("s")) == F.col("tokens")).alias("roundtrip"))


def _window_rows(spark, sf_dir, sizes=None):
    """Windows of every configuration, or of those with the given sizes, in one pass over the tokens (one generator)."""
    d = doc_tokens(spark, sf_dir)

    def tagged(size, overlap, max_len):
        return F.transform(windows(F.col("tokens"), size, overlap), lambda w, i: F.struct(
            F.lit(size).alias("win_size"), F.lit(overlap).alias("win_overlap"), F.lit(max_len).alias("max_len"),
            i.alias("window_no"), w.alias("tokens")))
    allw = F.concat(*[tagged(*cfg) for cfg in WINDOW_CONFIGS if sizes is None or cfg[0] in sizes])
    return exploded(d, ["doc_id"], allw, "w").select(
        "w.win_size", "w.win_overlap", "w.max_len", "doc_id", "w.window_no", "w.tokens")


def q_token_windows(spark, sf_dir):
    w = _window_rows(spark, sf_dir)
    return w.select("win_size", "win_overlap", "doc_id", "window_no", F.size("tokens").alias("n_tokens"),
                    F.col("tokens")[0].token.alias("first_token"),
                    F.element_at("tokens", -1).token.alias("last_token"),
                    F.col("tokens")[0].start.alias("span_start"), F.element_at("tokens", -1).end.alias("span_end"))


def q_pad_truncate_mask(spark, sf_dir):
    """Windows of both settings, each padded to its own length, in one pass."""
    s = prepare_samples(_window_rows(spark, sf_dir), max_len=F.col("max_len"), key_cols=("win_size", "doc_id", "window_no"))
    return s.select("win_size", "doc_id", "window_no", F.size("padded").alias("padded_len"),
                    F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
                    F.array_join("padded", " ").alias("tokens_text"),
                    F.array_join(F.transform("mask", lambda x: x.cast("string")), "").alias("mask_text"))


def _vocabulary(spark, sf_dir):
    return build_vocabulary(token_rows(documents(spark, sf_dir), offsets=False))


def q_vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir)


def q_vocab_encode(spark, sf_dir):
    vocab = _vocabulary(spark, sf_dir)
    w = _window_rows(spark, sf_dir, (510,))
    s = prepare_samples(w, max_len=512, vocab=vocab)
    return s.select("doc_id", "window_no", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids_text"))


def q_logit_argmax(spark, sf_dir):
    """Each vector as score vectors of 11 values; the last one, if it is shorter, is masked."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    n = len(LABEL2ID)
    slots = F.sequence(F.lit(0), F.ceil(F.size("embedding") / F.lit(n)).cast("int") - 1)
    e = e.select("vec_id", F.transform(slots, lambda i: F.slice("embedding", i * n + 1, F.lit(n))).alias("scores"))
    e = e.withColumn("mask", F.transform("scores", lambda s: (F.size(s) == n).cast("int")))
    ids, names = argmax_ids(F.col("scores"), F.col("mask")), argmax_labels(F.col("scores"), F.col("mask"))
    z = e.select("vec_id", F.posexplode(F.arrays_zip(ids.alias("id"), names.alias("label"), F.col("mask").alias("mask"))).alias("slot", "z"))
    return z.where("z.mask = 1").select("vec_id", "slot", F.col("z.id").alias("label_id"), F.col("z.label").alias("label"))


def q_merge_windows(spark, sf_dir):
    """Windows gathered once, merged whole and with trimmed edges; a hash tells whether the merged tokens are the document's."""
    d = doc_tokens(spark, sf_dir).select("doc_id", "tokens", F.xxhash64("tokens").alias("own"))
    g = gather_windows(to_windows(d, 510, 0, keep=("own",)), ["tokens"], "doc_id", F.first("own").alias("own"))
    g = g.select("doc_id", "own", F.size("_w").alias("n_windows"), merged_column("tokens").alias("tokens"),
                 F.size(merged_column("tokens", edge_trim=1)).alias("n_tokens_trimmed"))
    return g.select("doc_id", "n_windows", F.size("tokens").alias("n_tokens"), F.col("tokens")[0].token.alias("first_token"),
                    F.element_at("tokens", -1).token.alias("last_token"), "n_tokens_trimmed", (F.xxhash64("tokens") == F.col("own")).alias("same_as_source"))


def q_attach_documents(spark, sf_dir):
    from ..operators.spans import attach_documents
    docs = documents(spark, sf_dir)
    merged = merge_windows(to_windows(with_tokens(docs, python=False), 510, 0), ["tokens"])
    # measured where they lie dealt out by doc_id, so the join moves neither texts nor tokens
    merged = merged.select("doc_id", F.size("tokens").alias("n_tokens"))
    docs = docs.select("doc_id", F.length("text").alias("n_chars"))
    parts = [attach_documents(merged, docs, how=how).select(F.lit(how).alias("how"), "doc_id", "n_chars", "n_tokens") for how in ("inner", "left")]
    return parts[0].unionByName(parts[1])


def token_queries() -> dict[str, Query]:
    return {
        "tokenize_offsets": q_tokenize_offsets,
        "special_tokens": q_special_tokens,
        "token_windows": q_token_windows,
        "pad_truncate_mask": q_pad_truncate_mask,
        "vocabulary": q_vocabulary,
        "vocab_encode": q_vocab_encode,
        "logit_argmax": q_logit_argmax,
        "merge_windows": q_merge_windows,
        "attach_documents": q_attach_documents,
    }


# ------------------------------------------------------------------ case notes: entities, maps, rewrite

from ..config import RedactionConfig  # noqa: E402
from ..functions.rewrite import replace_guarded, replace_sequential  # noqa: E402
from ..operators.classify import RuleTagger  # noqa: E402
from ..operators.redact import build_maps, detect, redact  # noqa: E402
from ..operators.mapping import date_entries, location_entries, name_entries  # noqa: E402
from ..operators.scorer import WindowedScorer, one_hot  # noqa: E402
from ..operators.spans import bio_mentions, entity_lists, inside_spans, mention_rows  # noqa: E402

ENTS = ("PERSON", "LOCATION", "DATE")
from ..functions.dates import fake_date, parse_date  # noqa: E402
from ..operators.tokens import assign_batches, encode_labels, sample_batches  # noqa: E402
from .casenotes import case_notes, dated_notes, gazetteer  # noqa: E402

CFG = RedactionConfig(seed=SEED)


def notes_labelled(spark, sf_dir):
    """Case notes with ``tokens`` and rule ``labels``."""
    return RuleTagger(gazetteer(spark, sf_dir)).tag(with_tokens(case_notes(spark, sf_dir)))


def notes_detected(spark, sf_dir):
    return detect(case_notes(spark, sf_dir), RuleTagger(gazetteer(spark, sf_dir)))


def notes_mapped(spark, sf_dir):
    return build_maps(notes_detected(spark, sf_dir), cfg=CFG)


def q_rule_tag(spark, sf_dir):
    d = notes_labelled(spark, sf_dir)
    z = exploded(d, ["doc_id"], F.arrays_zip("tokens", "labels"), "z", "pos")
    return z.where(F.col("z.labels") != "O").select("doc_id", "pos", F.col("z.tokens.token").alias("token"),
                                                     F.col("z.labels").alias("label"))


def q_bio_spans(spark, sf_dir):
    return mention_rows(notes_labelled(spark, sf_dir))


def q_entities_wide(spark, sf_dir):
    d = notes_labelled(spark, sf_dir).withColumn("mentions", bio_mentions(F.col("tokens"), F.col("labels"), ENTS))
    return d.select("doc_id", *[F.array_join(entity_lists(F.col("mentions"), e), "|").alias(n)
                                for e, n in (("PERSON", "names"), ("LOCATION", "locations"), ("DATE", "dates"))])


def _map_rows(spark, sf_dir, build, with_rank=False):
    """Long form of one per-document map."""
    d = notes_detected(spark, sf_dir)
    entries = build(F.col("mentions"))
    out = exploded(d, ["doc_id"], entries, "e", "rank") \
        .select("doc_id", "rank", F.col("e.real").alias("real"), F.col("e.fake").alias("fake"))
    return out if with_rank else out.drop("rank")


def q_name_map(spark, sf_dir):
    return _map_rows(spark, sf_dir, lambda m: name_entries(m, F.col("doc_id"), SEED))


def q_location_map(spark, sf_dir):
    return _map_rows(spark, sf_dir, lambda m: location_entries(m, F.col("doc_id"), SEED))


def q_date_map(spark, sf_dir):
    return _map_rows(spark, sf_dir, lambda m: date_entries(m, F.col("doc_id"), SEED, CFG.ref_date), with_rank=True)


def q_replace_literal(spark, sf_dir):
    d = notes_mapped(spark, sf_dir)
    return d.select("doc_id", replace_sequential(F.col("text"), F.col("location_map")).alias("text_out"))


def q_replace_guarded(spark, sf_dir):
    d = notes_mapped(spark, sf_dir)
    return d.select("doc_id", replace_guarded(F.col("text"), F.col("name_map"), F.col("person_spans"))
                    .alias("text_out"))


def q_redact_documents(spark, sf_dir):
    return redact(case_notes(spark, sf_dir), RuleTagger(gazetteer(spark, sf_dir)), cfg=CFG) \
        .select("doc_id", "redacted_text")


def q_scored_windows(spark, sf_dir):
    """Labels of every token by a model that each worker sets up once: windows, padding, scores, masked argmax, unpadding."""
    from ..functions.arrays import truncate_or_pad
    from ..operators.models import load_linear, model_scorer, predict_linear
    from ..operators.spans import unpad
    from ..operators.tokens import PAD
    score = model_scorer(spark, "linear", load_linear, predict_linear)
    w = to_windows(doc_tokens(spark, sf_dir), 510, 0)
    w = w.select("doc_id", "window_no", F.transform("tokens", lambda t: t.token).alias("words"))
    w = w.select("doc_id", "window_no", F.size("words").alias("n_tokens"), truncate_or_pad(F.col("words"), 512, PAD).alias("padded"))
    n = F.col("n_tokens")
    w = w.withColumn("scores", score(F.col("padded"))).withColumn("mask", F.transform("padded", lambda _, i: (i < n).cast("int")))
    ids = unpad(argmax_ids(F.col("scores"), F.col("mask")), F.col("mask"))
    return w.select("doc_id", "window_no", "n_tokens", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("label_ids"))


def q_match_in_span(spark, sf_dir):
    """Tokens of the case notes that lie in a PERSON span, both as long tables, by a range join."""
    notes = case_notes(spark, sf_dir)
    spans = exploded(notes_detected(spark, sf_dir), ["doc_id"], F.col("person_spans"), "s").select("doc_id", "s.start", "s.end")
    return inside_spans(token_rows(notes), spans).select("doc_id", "pos", "token")


def q_date_layouts(spark, sf_dir):
    """Dates in every layout found in a sentence, parsed and replaced."""
    d = RuleTagger().mentions(dated_notes(spark, sf_dir), ("DATE",))
    m = exploded(d, ["doc_id"], F.col("mentions"), "m").select("doc_id", "m.ord", "m.start", "m.value")
    return m.withColumns({"parsed": parse_date(F.col("value"), CFG.ref_date), "fake": fake_date(F.col("value"), F.col("doc_id"), SEED, CFG.ref_date)})


def q_sample_batches(spark, sf_dir):
    """Windows of the documents, numbered over the whole table and cut into batches."""
    w = _window_rows(spark, sf_dir, (100,))
    return sample_batches(w.select("doc_id", "window_no"))


def q_redact_spans(spark, sf_dir):
    """All finds on the original text, the longest of overlapping ones, one rewrite by position."""
    cfg = RedactionConfig(seed=SEED, mode="spans")
    return redact(case_notes(spark, sf_dir), RuleTagger(gazetteer(spark, sf_dir)), cfg=cfg).select("doc_id", "redacted_text")


class _Rescored:
    """The rule tagger's labels, given out again as scores over small windows."""

    CFG = RedactionConfig(seed=SEED, window_size=12, overlap=4)
    MAX_LEN = 16

    def __init__(self, tagger):
        self.tagger = tagger

    def tag(self, df, text="text", tokens="tokens", out="labels"):
        ruled = self.tagger.tag(df, text, tokens, "_rule")
        ruled = ruled.withColumn(tokens, F.zip_with(tokens, "_rule", lambda t, r: F.struct(
            t.token.alias("token"), t.start.alias("start"), t.end.alias("end"), r.alias("rule")))).drop("_rule")
        score = lambda padded, window: one_hot(F.transform(window, lambda t: t.rule), F.size(padded))
        return WindowedScorer(score, self.CFG, self.MAX_LEN, row_wise=True).tag(ruled, text, tokens, out)


def q_scored_documents(spark, sf_dir):
    """End to end through the windowed scorer: the same redaction as with the rule tagger itself."""
    return redact(case_notes(spark, sf_dir), _Rescored(RuleTagger(gazetteer(spark, sf_dir))), cfg=CFG).select("doc_id", "redacted_text")


def q_label_encode(spark, sf_dir):
    d = notes_labelled(spark, sf_dir)
    return d.select("doc_id", F.array_join(encode_labels(F.col("labels")).cast("array<string>"), " ").alias("targets_text"))


def q_training_samples(spark, sf_dir):
    d = notes_labelled(spark, sf_dir)
    both = F.zip_with("tokens", "labels", lambda t, x: F.struct(t.token.alias("token"), x.alias("tag")))
    w = to_windows(d.select("doc_id", both.alias("tokens")), 510, 0)  # a window carries its own tags alone
    w = w.withColumn("tags", F.transform("tokens", lambda t: t.tag))
    s = prepare_samples(w, max_len=512, tags="tags")
    # reduced before the numbering, which sorts the samples: 512 slots of each need not be moved
    s = s.select("doc_id", "window_no", F.array_size(F.array_remove("mask", 0)).alias("mask_sum"),
                 F.array_join(F.array_remove("targets", 0).cast("array<string>"), " ").alias("targets_text"))
    return assign_batches(s, shards=1024).select("doc_id", "window_no", "shard", "batch_no", "mask_sum", "targets_text")


def casenote_queries() -> dict[str, Query]:
    return {
        "rule_tag": q_rule_tag,
        "bio_spans": q_bio_spans,
        "entities_wide": q_entities_wide,
        "name_map": q_name_map,
        "location_map": q_location_map,
        "date_map": q_date_map,
        "replace_literal": q_replace_literal,
        "replace_guarded": q_replace_guarded,
        "redact_documents": q_redact_documents,
        "redact_spans": q_redact_spans,
        "scored_windows": q_scored_windows,
        "match_in_span": q_match_in_span,
        "date_layouts": q_date_layouts,
        "sample_batches": q_sample_batches,
        "scored_documents": q_scored_documents,
        "label_encode": q_label_encode,
        "training_samples": q_training_samples,
    }


# ------------------------------------------------------------------ sources and sinks

from ..sources.files import pages_to_documents, union_formats  # noqa: E402
from ..sources.sinks import paragraphs  # noqa: E402


def q_pages_to_documents(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    pages = conv.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"),
                        F.col("text").alias("page_text"))
    return pages_to_documents(pages)


def q_paragraphs(spark, sf_dir):
    red = redact_kind(documents(spark, sf_dir), "email", seed=SEED)
    return paragraphs(red)


def q_source_union(spark, sf_dir):
    return union_formats(documents=read_table(spark, sf_dir, "documents", "doc_id", "text"),
                         pages=page_texts(spark, sf_dir))


def io_queries() -> dict[str, Query]:
    return {
        "pages_to_documents": q_pages_to_documents,
        "paragraphs": q_paragraphs,
        "source_union": q_source_union,
    }
