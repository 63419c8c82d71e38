"""Order MinHash fingerprints of documents, sensitive to edit distance."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Code points in a k-mer, slots of a fingerprint, k-mers selected for a slot.
K, SLOTS, SELECT = 8, 64, 2
_SLOT_BITS = 6
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_EMPTY = np.uint32(0)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def signature(text: str) -> np.ndarray:
    """SLOTS numbers of 32 bits; 0 marks a slot that no k-mer falls into.

    Each k-mer is numbered by its occurrence in the text, so repeats are
    different elements. A hash of k-mer and number deals it to a slot; the
    SELECT smallest of a slot, in text order, are hashed as a tuple. A text
    shorter than K is one k-mer; an empty text has only empty slots.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros(SLOTS, np.uint32)
    if not len(c):
        return out
    h = _mix(c + np.uint64(1))
    if len(c) >= K:
        for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xD6E8FEB86659FD93), (4, 0xA0761D6478BD642F)):
            h = h[:-step] * np.uint64(factor) + h[step:]
    else:
        whole = len(c)
        for x in h.tolist():
            whole = (whole * 31 + x) % (1 << 64)
        h = np.array([whole], np.uint64)
    h = _mix(h)
    n = len(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if not new.all():
        at = np.arange(n)
        number = at - np.maximum.accumulate(np.where(new, at, 0))
        h[order] = ranked + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    e = _mix(h)
    # the few smallest of each slot: candidates by a bound that all slots fill, else all
    slot_of = lambda x: (x >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
    low = e & np.uint64((1 << (64 - _SLOT_BITS)) - 1)
    at = np.arange(n)
    if n > 32 * SLOTS:
        part = np.flatnonzero(low < np.uint64((1 << (64 - _SLOT_BITS)) // (n // (16 * SLOTS))))
        if (np.bincount(slot_of(e[part]), minlength=SLOTS) >= SELECT).all():
            at = part
    o = np.argsort(e[at], kind="stable")
    at, slots = at[o], slot_of(e[at[o]])
    start = np.searchsorted(slots, np.arange(SLOTS))
    size = np.minimum(np.diff(np.r_[start, len(slots)]), SELECT)
    first = at[np.minimum(start, len(at) - 1)]
    second = at[np.minimum(start + 1, len(at) - 1)]
    a, b = np.minimum(first, second), np.maximum(first, second)
    pair = _mix(e[a] * np.uint64(3) + _mix(e[b] + np.uint64(7)))
    one = _mix(e[first] + np.uint64(11))
    value = np.where(size >= 2, pair, one)
    out = np.where(size > 0, (value >> np.uint64(32)).astype(np.uint32) | np.uint32(1), _EMPTY)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots among those that either text fills; 1 for two empty texts."""
    used = (a != _EMPTY) | (b != _EMPTY)
    return float((a[used] == b[used]).mean()) if used.any() else 1.0


def as_hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the start of ``following``."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


#: Rows of the sample of doc_ids for each range; it only decides where ranges end.
SAMPLED = 50


def _ranges(rows: DataFrame, buckets: int) -> Column:
    """The range of a row by doc_id; an id with more than a range's share of rows, null too, is cut by the hash of the text."""
    share = min(1.0, SAMPLED * buckets / max(1, rows.count()))
    seen = [r[0] for r in (rows.select("doc_id").sample(share, seed=7) if share < 1 else rows.select("doc_id")).collect()]
    step = -(-len(seen) // buckets) or 1
    ends = sorted(x for x in seen if x is not None)[step::step]
    nulls = max(1, (len(seen) - sum(x is not None for x in seen)) // step)
    pivots = sorted(set(ends))
    hot = {x: n for x, n in Counter(ends).items() if n > 1}
    kind = rows.schema["doc_id"].dataType
    fixed = lambda x: F.lit(x).cast(kind)
    below = F.size(F.filter(F.array(*map(fixed, pivots)), lambda x: x < F.col("doc_id"))) if pivots else F.lit(0)
    parts = F.when(F.col("doc_id").isNull(), nulls)
    for x, n in hot.items():  # fewer than ranges
        parts = parts.when(F.col("doc_id") == fixed(x), n)
    widest = max([nulls, *hot.values()])
    at = (F.col("h") / 2.0**64 + 0.5) * parts  # from 0 to parts, in the order of h
    part = F.least(F.floor(at), parts - 1)
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(2 * below + parts.isNotNull().cast("int"))
    return place.cast("long") * widest + F.coalesce(part, F.lit(0))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, h, text, bucket, guest: ranges of rows in order, each with the row that follows its last one.

    Order is by doc_id, the text's XXH64 and the text, descending, nulls last;
    the row after the last of all is the first. Only a sample of doc_ids, a set
    number for each range, reaches the driver, and the ends of ranges are one
    row each. ``guest`` rows close a range and are not results.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = rows.withColumn("bucket", _ranges(rows, buckets))
    ids = ranged.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("top"))
    order = Window.orderBy(F.desc("bucket"))
    ends = ids.select("bucket", "top", F.lag("bucket").over(order).alias("to"))
    last = F.max("bucket").over(Window.partitionBy())
    lowest = F.min("bucket").over(Window.partitionBy())
    ends = ends.select("top.*", F.coalesce("to", F.when(F.col("bucket") == last, lowest)).alias("to"))
    ends = cut(ends, "range-ends")
    first = ranged["doc_id"].eqNullSafe(ends["doc_id"]) & (ranged["h"] == ends["h"])
    top = ranged.join(F.broadcast(ends), first).groupBy("to", ranged["doc_id"], ranged["h"]).agg(F.max("text").alias("text"))
    guests = top.select("doc_id", "h", "text", F.col("to").alias("bucket"), F.lit(True).alias("guest"))
    return ranged.select("doc_id", "h", "text", "bucket", F.lit(False).alias("guest")).unionByName(guests)


def order_minhash(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, and their likenesses.

    ``docs``: doc_id, text; other columns are ignored. A null text is empty.
    The next document is the one with the next smaller doc_id, ties by the
    text's hash and text, null doc_ids last, and after the last the first; a
    lone document follows itself. Equal texts have equal fingerprints. An empty table gives no rows.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_next(docs, buckets)
    dealt = rows.repartitionByRange(buckets, "bucket").sortWithinPartitions(
        F.desc("bucket"), "guest", F.col("doc_id").desc_nulls_last(), F.desc("h"), F.desc("text")
    )
    dealt = dealt.select("doc_id", "text", "bucket", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # doc_id, text, signature, bucket
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text, bucket, guest in zip(*(b.column(c).to_pylist() for c in range(4))):
                sig = signature(text)
                if held and held[3] == bucket:
                    changed = edited(held[1], text)
                    sig2 = signature(changed)
                    row = (held[0], len(held[1]), hashlib.sha256(changed.encode()).hexdigest(), as_hex(held[2]), as_hex(sig2), likeness(held[2], sig2), likeness(held[2], sig))
                    for column, value in zip(out, row):
                        column.append(value)
                held = None if guest else (doc, text, sig, bucket)
            types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return dealt.mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
