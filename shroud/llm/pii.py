"""Personal data by weak supervision, in DataFrame operations only.

*Candidates* are the base matches (e-mail, IP address, card and phone numbers by strict patterns,
which always stay) and spans of wider patterns: base matches that fail their test, obfuscated
e-mails, national phone numbers, IBANs and social security numbers. Failed base matches are evidence
for training only: a wrong checksum is final.

*Labelers* (``LABELERS``) vote 1, 0 or -1 on each candidate: the strict pattern or checksum, a gazetteer
(top-level domains, card prefixes, calling and country codes), cue words before the span, the
characters around it, and its grouping.

*Expectation-maximisation* estimates for each kind how often a labeler votes so on true and on false
spans. It reads only the counts of vote patterns (at most 3 ** 5 for each kind), so a round costs the same
for any corpus. *The classifier* is a naive Bayes model over votes and shape features, trained on
the estimated probabilities, again from counts. Wider candidates that it finds likely (``MIN_ODDS``) and
that touch no base span of their kind are added.

Edge cases: a null or empty text has no spans; a corpus without candidates gives base-free
results and no model; repeated rows count as often as they occur; base spans of one kind do not overlap,
those of different kinds may; an empty table gives an empty result; other input columns are not
read by ``report`` and are kept by ``redacted``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, prefix_max
from .common import matches, span_text, stored, whole

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

# --- fixed vocabulary of the labelers -------------------------------------------------------
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "at", "ch", "eu", "us", "ca", "au")
IBAN_COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "NL", "NO", "PL", "PT", "SE")
CUES = {
    "email": r"(?i)(e-?mail|mail|contact|write|correo|courriel)[^.\n]{0,12}\z",
    "ip": r"(?i)(\bip\b|address|host|server|adresse|client)[^.\n]{0,12}\z",
    "card": r"(?i)(card|visa|amex|credit|payment|karte|carte|tarjeta)[^.\n]{0,12}\z",
    "phone": r"(?i)(phone|tel|call|mobile|cell|fax|anruf|telefon|tél)[^\n]{0,12}\z",
    "iban": r"(?i)(iban|account|konto|compte|cuenta|bank)[^.\n]{0,12}\z",
    "ssn": r"(?i)(ssn|social|security|insurance)[^.\n]{0,12}\z",
}
AGAINST = r"(?i)(isbn|issn|version|order|invoice|serial|page|fig|table|chapter|model|item|part|no)[ .:#]{0,3}\z"
# --- end of fixed vocabulary ------------------------------------------------------------------

# Strict forms. Possessive and anchored so that no text makes them quadratic; the matches are those
# of the plain forms in the module's contract.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"  # shorter chains are dropped either way
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Wider forms.
EMAIL_WIDE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63}){1,8}"
PHONE_WIDE = r"(?<![0-9A-Za-z+.,-])(?:\([0-9]{2,5}\)\x20?|[0-9]{3,5}[\x20./-])[0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9A-Za-z])"
IBAN_WIDE = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN_WIDE = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP_VALID = r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})\.){3}0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"

LABELERS = ("strict", "gazetteer", "cue", "border", "grouping")
SHAPES = ("length", "separators", "digit_share")
ROUNDS = 12
SMOOTH = 1.0
MIN_ODDS = math.log(4)
AROUND = 24
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,base:boolean,f:array<int>>>"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """The Luhn test of a string of digits."""
    def value(d, i):
        x = F.when(i % 2 == 1, 2 * d).otherwise(d)
        return F.when(x > 9, x - 9).otherwise(x)
    figures = F.transform(F.split(F.reverse(number), ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(F.filter(figures, lambda d: d.isNotNull()), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_VALID)
    if kind == "card":
        return let(digits(m), lambda d: (F.length(d) >= 13) & F.when(F.length(d) <= 19, luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, 1)
    return (v.when(no, -1) if no is not None else v).otherwise(0)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return _vote(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS), F.lit(True))
    if kind == "ip":
        return _vote(~m.rlike(r"^0*(0|127|255)\.|^0*[0-9]\.[0-9]\.[0-9]\.[0-9]$"), F.lit(True))
    if kind == "card":
        return _vote(m.rlike(r"^(4|5[1-5]|2[2-7]|3[47]|6)"), m.rlike(r"^0"))
    if kind == "phone":
        return _vote(m.rlike(r"^(\+[1-9]|\(?0[1-9])"), m.rlike(r"^\+?0+$|^(19|20)[0-9]{2}[ ./-]"))
    if kind == "iban":
        return _vote(F.substring(m, 1, 2).isin(*IBAN_COUNTRIES), F.lit(True))
    return _vote(~m.rlike("^(000|666|9)"), F.lit(True))


def _grouping(kind: str, m: Column) -> Column:
    if kind == "card":
        return _vote(m.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7})$"), m.rlike("[ -]"))
    if kind == "phone":
        return _vote(m.rlike(r"[() -]"), m.rlike(r"^\+?[0-9]+$"))
    if kind == "email":
        return _vote(~m.rlike(r"\.\.|^[.-]"), F.lit(True))
    if kind == "iban":
        return _vote(m.rlike(r"^[A-Z]{2}[0-9]{2}( [A-Z0-9]{4})+|^[A-Z]{2}[0-9]+$"), m.rlike("[A-Z]{8}"))
    return F.lit(0)


def _features(kind: str, text: Column, m: Column, start: Column, end: Column, strict: Column) -> Column:
    """ARRAY<INT>: the labelers' votes, then the shape features."""
    first = F.greatest(start - AROUND, F.lit(0))
    before, after = F.substring(text, first + 1, start - first), F.substring(text, end + 1, F.lit(1))

    def of(left):
        border = _vote(~left.rlike(r"[\p{L}\p{N}_/=-]\z") & ~after.rlike(r"^[\p{L}\p{N}_/=]"), F.lit(True))
        return F.array(strict, _gazetteer(kind, m), _vote(left.rlike(CUES[kind]), left.rlike(AGAINST)), border, _grouping(kind, m),
                       F.least(F.floor(F.length(m) / 4), F.lit(7)).cast("int"),
                       F.least(F.length(F.regexp_replace(m, r"[\p{L}\p{N}]+", "")), F.lit(5)),
                       F.floor(4 * F.length(digits(m)) / F.greatest(F.length(m), F.lit(1))).cast("int"))
    return let(before, of)


def _of_kind(kind: str, text: Column, pattern: str, gate: Column, strict_form: bool) -> Column:
    rank = KINDS.index(kind)
    found = matches(text, pattern, gate)

    def span(m, ok):
        strict = _vote(ok, F.lit(True)) if strict_form else F.lit(0)
        return F.struct(m.start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m.end.alias("end"),
                        (ok if strict_form else F.lit(False)).alias("base"),
                        _features(kind, text, m.match, m.start, m.end, strict).alias("f"))
    return F.transform(found, lambda m: let(_valid(kind, m.match) if strict_form else F.lit(False), lambda ok: span(m, ok))).cast(_SPAN)


def candidates(text: Column) -> Column:
    """ARRAY<STRUCT<start, rank, kind, end, base, f>> of a text: base spans, and wider ones that touch no base span of their kind."""
    def of(t):
        has = lambda s: F.contains(t, F.lit(s))
        strict = F.concat(_of_kind("email", t, EMAIL, has("@"), True), _of_kind("ip", t, IP, t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), True),
                          _of_kind("card", t, CARD, t.rlike(CARD), True), _of_kind("phone", t, PHONE, has("+"), True))
        wide = F.concat(_of_kind("email", t, EMAIL_WIDE, t.rlike(r"[\[(]at[\])]"), False), _of_kind("phone", t, PHONE_WIDE, t.rlike(PHONE_WIDE), False),
                        _of_kind("iban", t, IBAN_WIDE, t.rlike(IBAN_WIDE), False), _of_kind("ssn", t, SSN_WIDE, t.rlike(SSN_WIDE), False))

        def join(s, w):
            apart = F.filter(w, lambda x: ~F.exists(s, lambda b: b.base & (b.start < x.end) & (x.start < b.end)))
            return F.array_sort(F.concat(s, apart))
        return let(strict, lambda s: let(wide, lambda w: F.when(F.size(w) == 0, F.array_sort(s)).otherwise(join(s, w))))
    return let(whole(text), of)


# --- label model and classifier ---------------------------------------------------------
def _log(x: float) -> float:
    return math.log(max(x, 1e-12))


def _odds(tables: dict, prior: dict, names: list[str]) -> Column:
    """Log odds that a span is true: prior and log ratios looked up by (kind, feature, value)."""
    pairs = [x for (kind, name, value), ratio in sorted(tables.items()) for x in (F.lit(f"{kind}|{name}|{value}"), F.lit(float(ratio)))]
    ratios = F.create_map(*pairs)
    out = F.create_map(*[x for k, v in sorted(prior.items()) for x in (F.lit(k), F.lit(float(v)))])[F.col("kind")]
    for name in names:
        out = out + F.coalesce(ratios[F.concat_ws("|", "kind", F.lit(name), F.col(name).cast("string"))], F.lit(0.0))
    return out


def _counts(table: DataFrame, p: Column, names) -> list:
    """(kind, feature, value, weight of true, weight of all) and, with an empty feature, each kind's totals. At most 3 ** 5 x 8 values a kind."""
    pairs = F.explode(F.array(F.struct(F.lit("").alias("name"), F.lit(0).alias("value")), *[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]))
    rows = table.select("kind", "n", p.alias("p"), pairs.alias("x"))
    return rows.groupBy("kind", "x.name", "x.value").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum("n").alias("n")).collect()


def _ratios(rows: list) -> tuple[dict, dict]:
    """(log ratio of (kind, feature, value), log prior odds of a kind) by smoothed counts."""
    totals = {r.kind: (r.yes, r.n - r.yes) for r in rows if not r.name}
    values = {}
    for r in rows:
        if r.name:
            values.setdefault((r.kind, r.name), []).append(r)
    ratios = {}
    for (kind, name), group in values.items():
        yes, no = totals[kind]
        k = max(len(group), 2) * SMOOTH
        for r in group:
            ratios[kind, name, r.value] = _log((r.yes + SMOOTH) / (yes + k)) - _log((r.n - r.yes + SMOOTH) / (no + k))
    return ratios, {kind: _log(yes + SMOOTH) - _log(no + SMOOTH) for kind, (yes, no) in totals.items()}


def fit(spans: DataFrame) -> tuple[dict, dict] | None:
    """(log ratios, prior log odds) of the classifier, from a table with a ``spans`` column of ``candidates``; None without any."""
    each = spans.select(F.explode("spans").alias("s"))
    names = [*LABELERS, *SHAPES]
    table = each.select("s.kind", *[F.col("s.f")[i].alias(n) for i, n in enumerate(names)]).groupBy("kind", *names).count()
    table = stored(table.withColumnRenamed("count", "n"), "pii-patterns")
    total = F.col("strict")  # which counts twice
    for n in LABELERS:
        total = total + F.col(n)
    p = 1 / (1 + F.exp(-1.5 * total))  # to begin with, the majority is right
    for _ in range(ROUNDS):
        rows = _counts(table, p, LABELERS)
        if not rows:
            return None
        ratios, prior = _ratios(rows)
        p = 1 / (1 + F.exp(-_odds(ratios, prior, list(LABELERS))))
    return _ratios(_counts(table, p, names))


def accepted(spans: Column, model: tuple[dict, dict] | None) -> Column:
    """The base spans, and the wider ones whose odds are above ``MIN_ODDS``."""
    if model is None:
        return F.filter(spans, lambda s: s.base)
    tables, prior = model
    names = [*LABELERS, *SHAPES]
    pairs = [x for (kind, name, value), ratio in sorted(tables.items()) for x in (F.lit(f"{kind}|{name}|{value}"), F.lit(float(ratio)))]
    start = [x for k, v in sorted(prior.items()) for x in (F.lit(k), F.lit(float(v)))]

    def likely(s):
        odds = F.coalesce(F.create_map(*start)[s.kind], F.lit(-1.0))
        for i, name in enumerate(names):
            odds = odds + F.coalesce(F.create_map(*pairs)[F.concat_ws("|", s.kind, F.lit(name), s.f[i].cast("string"))], F.lit(0.0))
        return odds > MIN_ODDS
    return F.filter(spans, lambda s: s.base | ((s.f[0] == 0) & likely(s)))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans (accepted) of every row."""
    found = stored(docs.select(F.col(f"`{key}`").alias(key), candidates(F.col(f"`{text}`")).alias("spans")), "pii-spans")
    return found.select(key, accepted(F.col("spans"), fit(found)).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("long")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, number of base spans of each kind, digest of the base spans, and all spans as text (by kind as listed, then start)."""
    by_kind = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s.rank.alias("rank"), s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), s.base.alias("base"))))
    found = detect(docs, key, text).withColumn("spans", by_kind(F.col("spans")))
    base = F.filter("spans", lambda s: s.base)
    return found.select(key, *[_count(kind).alias(f"n_{kind}") for kind in BASE],
                        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; spans that overlap an earlier one go with it."""
    def of(s):
        def rebuild(reach):
            def piece(x, i):
                done = F.when(i > 0, reach[F.greatest(i - 1, F.lit(0))]).otherwise(0)
                return F.when(x.start >= done, F.concat(F.substring(text, done + 1, x.start - done), F.lit("["), F.upper(x.kind), F.lit("]"))).otherwise("")
            tail = F.substring(text, F.element_at(reach, -1) + 1, F.length(text))
            return F.concat(F.array_join(F.transform(s, piece), ""), tail)
        return let(prefix_max(F.transform(s, lambda x: x.end)), rebuild)
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, let(spans, of)).otherwise(text)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the accepted spans of ``text`` replaced. The texts are read twice, to train and to replace."""
    t = F.col(f"`{text}`")
    model = fit(stored(docs.select(candidates(t).alias("spans")).where(F.size("spans") > 0), "pii-spans"))
    new = F.when(t.isNotNull(), let(t, lambda own: let(accepted(candidates(own), model), lambda s: redact(own, s))))
    return docs.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
