"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs: its lines, cut further at sentence
ends so that a text of one line has several.  Each is hashed (BLAKE2b, 512 bit)
to a wide vector: 8 lanes added modulo 2**64, which tell equality, and 128
lanes of +1 or -1 added modulo 2**16, whose difference estimates how many
paragraphs two multisets don't share.  Sums make the fingerprint independent of
order, and paragraphs can be added or removed without the rest of the text.

Nulls and edge cases: a null text is empty, and the empty text has the all-zero
fingerprint (likeness 1 to another empty one).  Repeated ids are ordered by
text; null ids come first.  An empty table gives an empty result.  Only id and
text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortica.llm import common

WIDE, SIGNS = 8, 128
_CUT = re.compile(r"\n|(?<=[.!?]) +")
#: Paragraphs summed at once; bounds the memory of a task.
_AT_ONCE = 100_000


def paragraphs(text: str | None) -> list[str]:
    return [x for x in _CUT.split(text or "") if x]


def _vectors(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(hashlib.blake2b(u.encode("utf-8", "surrogatepass")).digest() for u in units)
    wide = np.frombuffer(raw, dtype="<u8").reshape(-1, WIDE)
    bits = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 64)[:, : SIGNS // 8]
    return wide, np.unpackbits(bits, axis=1).astype(np.int16) * 2 - 1


class Fingerprint:
    """Sum of paragraph vectors; ``add`` and ``remove`` are exact inverses."""

    def __init__(self, wide: np.ndarray | None = None, signs: np.ndarray | None = None):
        self.wide = np.zeros(WIDE, dtype=np.uint64) if wide is None else wide
        self.signs = np.zeros(SIGNS, dtype=np.int16) if signs is None else signs

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        return cls().add(paragraphs(text))

    def add(self, units: Iterable[str]) -> Fingerprint:
        if units := list(units):
            wide, signs = _vectors(units)
            self.wide = self.wide + wide.sum(axis=0, dtype=np.uint64)
            self.signs = self.signs + signs.sum(axis=0, dtype=np.int16)
        return self

    def remove(self, units: Iterable[str]) -> Fingerprint:
        if units := list(units):
            gone = Fingerprint().add(units)
            self.wide, self.signs = self.wide - gone.wide, self.signs - gone.signs
        return self

    def hex(self) -> str:
        return self.wide.astype("<u8").tobytes().hex() + self.signs.astype("<i2").tobytes().hex()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw[: WIDE * 8], dtype="<u8").copy(), np.frombuffer(raw[WIDE * 8 :], dtype="<i2").copy())


def likeness(a_wide, a_signs, b_wide, b_signs) -> np.ndarray:
    """Estimated Jaccard likeness of the multisets, row by row; 1 only for equal vectors."""
    same = (a_wide == b_wide).all(axis=1) & (a_signs == b_signs).all(axis=1)
    square = lambda x: (x.astype(np.float64) ** 2).mean(axis=1)
    apart = square((a_signs - b_signs).astype(np.int16))
    both = square(a_signs) + square(b_signs)
    near = np.where(both + apart > 0, (both - apart) / np.maximum(both + apart, 1e-12), 0.0)
    return np.where(same, 1.0, np.clip(near, 0.0, 0.999))


def _sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    wide, signs = np.zeros((len(texts), WIDE), np.uint64), np.zeros((len(texts), SIGNS), np.int16)
    at, units, owners = 0, [], []

    def flush():
        if units:
            w, s = _vectors(units)
            own = np.array(owners)
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            wide[own[first]] += np.add.reduceat(w, first, axis=0)
            signs[own[first]] += np.add.reduceat(s, first, axis=0, dtype=np.int16)
            units.clear()
            owners.clear()

    for at, text in enumerate(texts):
        for u in paragraphs(text):
            units.append(u)
            owners.append(at)
            if len(units) >= _AT_ONCE:
                flush()
    flush()
    return wide, signs


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by as many, or all, of the first of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _rows(ids: list, texts: list[str], follow: list[str]) -> pd.DataFrame:
    new = [edited(a, b) for a, b in zip(texts, follow, strict=True)]
    n = len(texts)
    wide, signs = _sums(texts + follow + new)
    w, s = [wide[i * n : (i + 1) * n] for i in range(3)], [signs[i * n : (i + 1) * n] for i in range(3)]
    print_ = lambda i: [a.tobytes().hex() + b.tobytes().hex() for a, b in zip(w[i], s[i], strict=True)]
    return pd.DataFrame({
        "doc_id": pd.array(ids, dtype="Int64"), "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
        "fingerprint": print_(0), "edited_fingerprint": print_(2),
        "near_edited": likeness(w[0], s[0], w[2], s[2]), "near_next": likeness(w[0], s[0], w[1], s[1]),
    })


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (part, guest, doc_id, text): the first guest of a part follows its last own row."""
    pending: tuple | None = None  # (part, id, text) that waits for what follows
    for batch in batches:
        ids, texts, follow = [], [], []
        size = 0
        own_id = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
        for part, guest, doc_id, text in zip(batch["part"], batch["guest"], own_id, batch["text"], strict=True):
            if pending is not None and pending[0] == part:
                ids.append(pending[1])
                texts.append(pending[2])
                follow.append(text)
                size += len(pending[2]) + len(text)
            pending = None if guest else (part, None if doc_id is None else int(doc_id), text)
            if size > 4_000_000:
                yield _rows(ids, texts, follow)
                ids, texts, follow, size = [], [], [], 0
        if ids:
            yield _rows(ids, texts, follow)
    if pending is not None:
        raise ValueError("a part has no row that follows its last one")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form (see :func:`edited`); the text after the last is the first.

    One shuffle deals the texts into ranges of the id; the first row of a range
    travels to the range before it as well, so no range needs another's rows.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    parts = parts or common.task_count(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted({int(c) for c in cuts})
    part = F.when(F.col("doc_id").isNull(), F.lit(0))
    part = part.otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id"))) + 1 if cuts else F.lit(1))
    firsts = ids.withColumn("part", part).groupBy("part").agg(F.min("doc_id").alias("low")).orderBy("part").collect()  # one row a part
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    table = spark.createDataFrame([(x.low, firsts[i - 1].part) for i, x in enumerate(firsts)], "low long, guest_part int")
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    also = F.when(F.col("guest_part").isNotNull(), F.struct(F.col("guest_part").alias("part"), F.lit(True).alias("guest")))
    dealt = (
        rows.withColumn("part", part.cast("int"))
        .join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("low")), "left")
        .select("doc_id", "text", F.explode(F.array_compact(F.array(own, also))).alias("place"))
        .select("doc_id", "text", "place.part", "place.guest")
        .repartitionById(len(cuts) + 2, "part")
    )
    return dealt.sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text").mapInPandas(_chain, SCHEMA)
