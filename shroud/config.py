"""Label vocabulary and the knobs of a redaction run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the token-classification label vocabulary (label -> id) ---
LABEL2ID = {
    "O": 0,
    "B-DATE": 1,
    "I-DATE": 2,
    "B-EMAIL": 3,
    "I-EMAIL": 4,
    "B-LOCATION": 5,
    "I-LOCATION": 6,
    "B-PERSON": 7,
    "I-PERSON": 8,
    "B-PHONE_NUMBER": 9,
    "I-PHONE_NUMBER": 10,
}
# --- end of fixed values ---

ID2LABEL = {v: k for k, v in LABEL2ID.items()}
ENTITY_TYPES = ("DATE", "EMAIL", "LOCATION", "PERSON", "PHONE_NUMBER")
# entities the span rewrite consumes; emails and phones come from patterns
SPAN_ENTITIES = ("PERSON", "LOCATION", "DATE")

# reference defaults: random_state 200, scoring batches of 8, 510-token windows padded to 512
DEFAULT_SEED = 200
DEFAULT_BATCH_SIZE = 8
WINDOW_SIZE = 510
WINDOW_OVERLAP = 0
MAX_LEN = 512


def labels_by_id() -> Column:
    """Array literal: element ``id + 1`` is the label with that id."""
    return F.array(*[F.lit(ID2LABEL[i]) for i in range(len(ID2LABEL))])


def label_map() -> Column:
    """MAP<STRING,INT> literal label -> id (11 entries, constant size)."""
    return F.create_map(*[x for k, v in LABEL2ID.items() for x in (F.lit(k), F.lit(v))])


@dataclass(frozen=True)
class RedactionConfig:
    """Keyword arguments of an end-to-end run (replaces the reference's object state)."""

    seed: int = DEFAULT_SEED
    window_size: int = WINDOW_SIZE
    overlap: int = WINDOW_OVERLAP
    edge_trim: int = 0           # 1 reproduces the reference's per-window edge loss (D1)
    join_how: str = "left"       # "inner" reproduces dropping empty documents (D5/D6)
    ref_date: str = "2024-01-01"  # fills missing date fields, keeps results reproducible
    order: tuple = ("email", "phone", "url")
    mode: str = "chain"          # "spans": all finds on the original text, overlaps longest first, one rewrite by position
    span_entities: tuple = field(default=SPAN_ENTITIES)
