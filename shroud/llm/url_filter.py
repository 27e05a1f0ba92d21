"""URL filter: host and path rules first, a logistic regression on hashed character n-grams for the rest.

``judge`` splits each URL into host and path with column expressions and applies the rules; URLs
that no rule decides are scored by a model whose features are the character n-grams (3 to 5
bytes) of ``^host$`` and of the path, hashed into ``2**bits`` weights. ``train`` fits the model on a
small labelled URL table (url, verdict), by default ``LABELLED``; of a larger one it takes a bounded sample
(``max_train`` distinct rows, those with the smallest hashes).

Edge cases: a null URL or one without ``://`` has an empty host and path (the model's bias decides);
repeated URLs get equal verdicts and count once in training; with no labelled URL, or labels of one
kind only, the model answers that kind (``allow`` when there is none); other input columns are not
touched or read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: (verdict, rule); a rule is a host, which also stands for its subdomains, and a path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
#: The labelled URL table: words of unwanted hosts and paths, and of ordinary ones, in invented URLs.
UNWANTED = ("casino", "poker", "slots", "bets", "wager", "jackpot", "lottery", "adult", "porn", "xxx", "sex", "hookup",
            "pills", "pharma", "viagra", "loans", "payday", "crypto-win", "free-win", "prize", "ads", "ad-server", "track",
            "tracker", "cheap", "popup", "banner", "affiliate", "torrent", "warez", "crack", "keygen", "spam", "phish")
ORDINARY = ("news", "journal", "library", "museum", "school", "university", "science", "research", "weather", "travel",
            "recipes", "garden", "music", "books", "history", "health", "sports", "local", "city", "forum", "wiki",
            "docs", "help", "support", "shop", "mail", "photos", "maps", "people", "culture", "nature", "theatre", "trains", "house")
#: Frames that both kinds share, so that only the words tell them apart.
FRAMES = (("", "com", "en"), ("www.", "net", "de"), ("m.", "org", "fr"), ("blog.", "com", "es"), ("", "org", "en"), ("www.", "org", "es"))


def _labelled():
    for i, (bad, good) in enumerate(zip(UNWANTED, ORDINARY)):
        for j, (front, top, lang) in enumerate(FRAMES):
            far, near = UNWANTED[(i + j + 1) % len(UNWANTED)], ORDINARY[(i + 5 * j + 1) % len(ORDINARY)]
            place = f"/{lang}/{37 * i + 101 * j}"
            yield f"http://{front}{bad}-{far}.example.{top}{place}", "block"
            yield f"http://{front}{good}-{near}.example.{top}{place}", "allow"
            yield f"http://{front}{good[:4]}{near[-4:]}.example.{top}{place}", "allow"
        yield f"https://{ORDINARY[i - 3]}.example.com/{bad}/{i}", "block"
        yield f"https://{ORDINARY[i - 3]}.example.com/{good}/{i}", "allow"


LABELLED = tuple(_labelled())
MAX_TRAIN = 20_000
BITS = 14
GRAMS = (3, 4, 5)
MIN_ODDS = -1.0  # a URL is blocked where its log odds of allow are lower
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def decide(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest ends up outermost
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def features(hosts, paths, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hashed n-gram) of all n-grams of a batch, and the number of n-grams of each row."""
    texts = [b"^" + h.encode("utf-8", "replace") + b"$" for h in hosts] + [p.encode("utf-8", "replace") + b"$" for p in paths]
    n = len(hosts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes to the end of the own text
    rows, slots = [], []
    for size in GRAMS:
        at = np.flatnonzero(left >= size)
        h = np.full(len(at), size, np.uint64) + (owner[at] >= n).astype(np.uint64) * np.uint64(977)
        for j in range(size):
            h = h * np.uint64(0x100000001B3) ^ data[at + j]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        rows.append(owner[at] % n if n else owner[at])
        slots.append((h >> np.uint64(64 - bits)).astype(np.int64))
    row, slot = np.concatenate(rows), np.concatenate(slots)
    return row, slot, np.bincount(row, minlength=n)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, hosts, paths) -> np.ndarray:
        """Log odds of ``allow``."""
        if not len(hosts):
            return np.zeros(0)
        row, slot, count = features(hosts, paths, self.bits)
        return self.bias + np.bincount(row, self.weights[slot], len(hosts)) / np.sqrt(np.maximum(count, 1))


def fit(hosts, paths, allowed, bits: int = BITS, rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> UrlModel:
    """Logistic regression by full-batch gradient steps with per-weight rates (deterministic)."""
    y = np.asarray(allowed, float)
    if not len(y) or y.min() == y.max():
        return UrlModel(np.zeros(1 << bits), 1.0 if not len(y) or y[0] else -1.0, bits)
    row, slot, count = features(hosts, paths, bits)
    scale = 1 / np.sqrt(np.maximum(count, 1))
    w, seen = np.zeros(1 << bits), np.full(1 << bits, 1e-8)
    bias, seen_b = 0.0, 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, w[slot], len(y)) * scale)))
        miss = (p - y) / len(y)
        g = np.bincount(slot, (miss * scale)[row], len(w)) + decay / len(y) * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        seen_b += miss.sum() ** 2
        bias -= rate * miss.sum() / np.sqrt(seen_b)
    return UrlModel(w, float(bias), bits)


def train(labelled: DataFrame, url: str = "url", verdict: str = "verdict", max_train: int = MAX_TRAIN, bits: int = BITS) -> UrlModel:
    """Fit on a table (url, verdict): at most ``max_train`` distinct rows, those of the smallest hashes."""
    own = F.col(f"`{url}`")
    rows = labelled.select(host_of(own).alias("host"), path_of(own).alias("path"), F.col(f"`{verdict}`").alias("verdict")).distinct()
    rows = rows.orderBy(F.xxhash64("host", "path", "verdict"), "host", "path", "verdict").limit(max_train).collect()
    return fit([r.host for r in rows], [r.path for r in rows], [r.verdict == "allow" for r in rows], bits)


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules=RULES, model: UrlModel | None = None) -> DataFrame:
    """key, host, path, rule, verdict, log_odds (null where a rule decides) of every row.

    Without a ``model``, one is trained on ``LABELLED``.
    """
    own = F.col(f"`{url}`")
    parts = pages.select(F.col(f"`{key}`").alias(key), host_of(own).alias("host"), path_of(own).alias("path"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "ruled": verdict})
    if model is None:
        model = train(pages.sparkSession.createDataFrame(LABELLED, "url string, verdict string"))

    ship(pages.sparkSession)

    @F.pandas_udf("double")
    def log_odds(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(model.score(host.to_numpy(), path.to_numpy()))

    scored = ruled.withColumn("odds", log_odds("host", "path"))
    return scored.select(key, "host", "path", "rule",
                         F.coalesce("ruled", F.when(F.col("odds") >= MIN_ODDS, "allow").otherwise("block")).alias("verdict"),
                         F.when(F.col("ruled").isNull(), F.col("odds")).alias("log_odds"))
