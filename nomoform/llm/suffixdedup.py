"""Removal of repeated 100-byte strings over a collection's suffixes.

Each 100-byte window has a minimizer, the k-mer in it with the smallest hash;
equal windows have equal ones. Runs of windows with one minimizer make a
segment, and segments are dealt out by minimizer, so all occurrences of a
window meet in one task whatever documents they lie in. Equal segments, told
by a 128-bit digest of their bytes, collapse to their first occurrence before
they are shuffled.

A window reaches at least SIDE bytes to the left of its minimizer or more than
that to the right, so two segments can share one only if they agree on one of
these sides. Segments that do are cut there, each half is dealt out by
minimizer and side, and the halves that meet become a collection whose BWT and
common prefixes (bwt.py) show the windows that occur before.

A minimizer that a great many different segments have, as one within a phrase
found everywhere, would fill one task. Such minimizers are looked for in a
sample of the documents, which decides only how their windows are dealt: each
by a digest of its own bytes. The windows removed are the same either way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bwt import collection
from .common import cut, local_path

SPAN, K, SIDE = 100, 20, 40
#: Bytes of text that a map task holds at a time, and the longest piece of one document.
BLOCK = 6_000_000
#: Symbols of a collection; only segments of one minimizer and side may make it larger.
SYMBOLS = 300_000
#: Hot minimizers have at least HOT_ROWS segments and one in HOT_SHARE of all, so they are at most HOT_SHARE.
HOT_ROWS, HOT_SHARE, SAMPLE = 1000, 1_000_000, 64
NO_ID = -(1 << 63) + 1
#: Rows that share an id are numbered; the number stands above these bits of a place, and a text is shorter than 2^31 bytes.
PLACE = 32
_BYTES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def digests(raw: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the SHA-256 of each slice of ``raw``, as two columns."""
    sha = hashlib.sha256
    both = b"".join([sha(raw[a:b]).digest() for a, b in zip(start.tolist(), stop.tolist())])
    words = np.frombuffer(both, np.int64).reshape(-1, 4)
    return words[:, 0], words[:, 1]


def segments(raw: bytes, ends: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Segments of concatenated documents: key, c1, c2, left, right, start in ``raw``, windows, lefts.

    ``ends`` holds, for each byte, where its document ends in ``raw``. c1 and c2
    are the digest; left and right are hashes of the SIDE bytes beside the
    minimizer, and the first ``lefts`` windows hold the left one, the others the
    right one. Segments whose key is in ``hot`` (sorted) become single windows,
    with their digest as the key.
    """
    n = len(raw) - SPAN + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(8))
    h = _BYTES[np.frombuffer(raw, np.uint8)]
    h4 = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]
    h4 = h4[:-2] * np.uint64(0xA0761D6478BD642F) + h4[2:]
    h = h4[:-4] * np.uint64(0xE7037ED1A0B428DB) + h4[4:]
    h = h[:-8] * np.uint64(0x8EBC6AF09C88C6E3) + h[8:]
    h = h[:-4] * np.uint64(0x589965CC75374CC3) + h4[16:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    low = np.uint64((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    reach, width = 1, SPAN - K + 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    valid = np.arange(n) + SPAN <= ends[:n]
    new = valid & np.r_[True, (least[1:] != least[:-1]) | ~valid[:-1]]
    start = np.flatnonzero(new)
    number = np.cumsum(new)
    windows = np.bincount(number[valid], minlength=len(start) + 1)[1:]
    at = (least[start] & low).astype(np.int64)
    key = (h[at] >> np.uint64(1)).astype(np.int64)
    if hot is not None and len(hot):
        cut_up = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        many = np.where(cut_up, windows, 1)
        row = np.repeat(np.arange(len(start)), many)
        start = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        single = cut_up[row]
        key, windows, at = key[row], np.where(single, 1, windows[row]), at[row]
    c1, c2 = digests(raw, start, start + windows + SPAN - 1)
    lefts = np.clip(at - SIDE - start + 1, 0, windows)
    if hot is not None and len(hot):
        key = np.where(single, c1 & np.int64((1 << 63) - 1), key)
    last = len(h) - 1
    side = lambda a: (h[np.clip(a, 0, last)] * _MIX + h[np.clip(a + SIDE - K, 0, last)]).view(np.int64)
    return key, c1, c2, side(at - SIDE), side(at + K), start, windows, lefts


ROWS = "key long, doc long, start long, windows long, c1 long, c2 long, left long, right long, lefts long"
_NAMES = ["key", "doc", "start", "windows", "c1", "c2", "left", "right", "lefts"]


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    """Rows of ROWS; columns that are not given are null."""
    n = len(columns[0])
    arrays = [pa.array(np.asarray(c, np.int64)) for c in columns] + [pa.nulls(n, pa.int64())] * (len(_NAMES) - len(columns))
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _marks(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """Removed runs of windows, merged; they travel with key -1 and are spread by document."""
    o = np.lexsort((start, doc))
    doc, start, stop = doc[o], start[o], (start + windows)[o]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1] + SPAN - 1)] if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    far = np.maximum.reduceat(stop, first) if len(first) else stop
    return _batch(np.full(len(first), -1), doc[first], start[first], far - start[first])


def _first(cols: list[np.ndarray]) -> np.ndarray:
    """Sorted rows of ROWS: which are the first of their key and digest."""
    key, c1, c2 = cols[0], cols[4], cols[5]
    return np.r_[True, (key[1:] != key[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]


def _halves(cols: list[np.ndarray]) -> pa.RecordBatch:
    """Different segments of whole keys: their halves that share minimizer and side with another one's."""
    key, doc, start, windows, _, _, left, right, lefts = cols

    def shared(side: np.ndarray, has: np.ndarray, odd: int) -> tuple[np.ndarray, np.ndarray]:
        code = ((key[has].view(np.uint64) * _MIX) ^ side[has].view(np.uint64)) * _MIX + np.uint64(odd)
        _, back, count = np.unique(code, return_inverse=True, return_counts=True)
        some = count[back] > 1
        return (code[some] >> np.uint64(1)).astype(np.int64), np.flatnonzero(has)[some]

    lk, l = shared(left, lefts > 0, 0)
    rk, r = shared(right, lefts < windows, 1)
    return _batch(np.r_[lk, rk], np.r_[doc[l], doc[r]], np.r_[start[l], start[r] + lefts[r]], np.r_[lefts[l], windows[r] - lefts[r]])


def find_segments(docs: DataFrame, hot: np.ndarray | None = None) -> DataFrame:
    """Segments of every whole text, equal ones of a block of texts collapsed to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[int, int, bytes]] = []
        held = 0

        def block() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(p[2]) for p in parts])
            stops = np.cumsum(sizes)
            key, c1, c2, left, right, start, windows, lefts = segments(b"".join(p[2] for p in parts), np.repeat(stops, sizes), hot)
            if not len(key):
                return
            which = np.searchsorted(stops, start, "right")
            doc = np.array([p[0] for p in parts], np.int64)[which]
            start = start - (stops - sizes)[which] + np.array([p[1] for p in parts], np.int64)[which]
            o = np.lexsort((start, doc, c2, c1, key))
            cols = [c[o] for c in (key, doc, start, windows, c1, c2, left, right, lefts)]
            first = _first(cols)
            yield _batch(*(c[first] for c in cols))
            yield _marks(*(c[~first] for c in cols[1:4]))

        for b in batches:
            for d, number, text in zip(*(b.column(c).to_pylist() for c in range(3))):
                raw = text.encode()
                for at in range(0, max(1, len(raw) - SPAN + 1), BLOCK):
                    piece = raw[at : at + BLOCK + SPAN - 1]
                    if held + len(piece) > BLOCK and parts:
                        yield from block()
                        parts, held = [], 0
                    parts.append((d, (number << PLACE) + at, piece))
                    held += len(piece)
        if parts:
            yield from block()

    return docs.select("doc", "number", "text").mapInArrow(run, ROWS)


def hot_keys(docs: DataFrame) -> np.ndarray:
    """Minimizers that very many different segments share, at most HOT_SHARE, sorted; from one document in SAMPLE."""
    some = find_segments(docs.where(F.pmod(F.xxhash64("doc", "number", F.lit(9)), F.lit(SAMPLE)) == 0)).where("key <> -1")
    counts = cut(some.groupBy("key").agg(F.count("*").alias("n")), "minimizer-sample")
    least = max(HOT_ROWS, SAMPLE * (counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    return np.array(sorted(r["key"] for r in counts.where(F.col("n") * SAMPLE >= least).select("key").collect()), np.int64)


def collapse(rows: DataFrame) -> DataFrame:
    """Marks (key -1) for all but the first of equal segments, and the halves of segments that need comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def whole(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            mark = cols[0] == -1
            if mark.any():
                yield _batch(*(c[mark] for c in cols[:4]))
                cols = [c[~mark] for c in cols]
            if not len(cols[0]):
                return
            first = _first(cols)
            yield _marks(*(c[~first] for c in cols[1:4]))
            yield _halves([c[first] for c in cols])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(c.fill_null(0)) for c in b.columns]
            other = np.flatnonzero(cols[0] != cols[0][-1])
            if cols[0][-1] == -1:
                yield from whole(cols)
            elif len(other):
                end = other[-1] + 1
                yield from whole([np.concatenate(x) for x in zip(*held, [c[:end] for c in cols])])
                held = [[c[end:] for c in cols]]
            else:
                held.append(cols)
                if len(held) > 64:  # equal segments need no more than their first row
                    cols = [np.concatenate(x) for x in zip(*held)]
                    first = _first(cols)
                    yield _marks(*(c[~first] for c in cols[1:4]))
                    held = [[c[first] for c in cols]]
        if held:
            yield from whole([np.concatenate(x) for x in zip(*held)])

    spread = F.when(F.col("key") == -1, F.xxhash64("doc", _number())).otherwise(F.lit(0))
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = rows.repartition(int(n), "key", spread).sortWithinPartitions("key", "c1", "c2", "doc", "start")
    return dealt.mapInArrow(run, ROWS).select("key", "doc", "start", "windows")


def _number() -> Column:
    return F.shiftright("start", PLACE)


def _offset() -> Column:
    return F.col("start").bitwiseAND(F.lit((1 << PLACE) - 1))


def cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, doc, start and the bytes of the segments that need comparison."""
    by_row = wanted.groupBy("doc", _number().alias("number")).agg(F.collect_list(F.struct("key", _offset().alias("start"), "windows")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for d, number, text, segs in zip(*(b.column(c).to_pylist() for c in range(4))):
                raw = text.encode()
                out += [(s["key"], d, (number << PLACE) + s["start"], raw[s["start"] : s["start"] + s["windows"] + SPAN - 1]) for s in segs]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["key", "doc", "start", "bytes"]
            )

    texts = docs.select("doc", "number", "text").join(by_row, ["doc", "number"])
    return texts.select("doc", "number", "text", "s").mapInArrow(run, "key long, doc long, start long, bytes binary")


def repeats_in(doc: np.ndarray, start: np.ndarray, strings: list[bytes], folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """doc and start of every window of a collection that occurs before."""
    _, lcp, of, size = collection(strings, folder=folder)
    lengths = np.array([len(s) for s in strings])
    same = lcp >= SPAN  # as the row before
    joined = same | np.r_[same[1:], False]
    of, size, lead = of[joined], size[joined], ~same[joined]
    if not len(of):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d, at = doc[of], start[of] + lengths[of] - size
    group = np.cumsum(lead)
    o = np.lexsort((at, d, group))
    d, at, group = d[o], at[o], group[o]
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    reps = np.diff(np.r_[head, len(group)])
    later = (d != np.repeat(d[head], reps)) | (at != np.repeat(at[head], reps))
    return d[later], at[later]


def compare(cuts_: DataFrame) -> DataFrame:
    """Marks for windows that occur before, from collections of halves with whole minimizers and sides."""
    folder = local_path(cuts_.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, start, strings, n = None, [], [], [], 0

        def flush() -> pa.RecordBatch:
            d, at = repeats_in(np.array(doc, np.int64), np.array(start, np.int64), strings, folder)
            return _marks(d, at, np.ones(len(d), np.int64))

        for b in batches:
            for k, d, s, raw in zip(*(c.to_pylist() for c in b.columns)):
                if k != key and n >= SYMBOLS:
                    yield flush()
                    doc, start, strings, n = [], [], [], 0
                key = k
                doc.append(d)
                start.append(s)
                strings.append(raw)
                n += len(raw)
        if strings:
            yield flush()

    n = cuts_.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return cuts_.repartition(int(n), "key").sortWithinPartitions("key", "doc", "start").mapInArrow(run, ROWS).select("key", "doc", "start", "windows")


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc, text) with number, and these rows without repetitions.

    A row whose id no other text has gets number 0. Others are numbered from 1
    in order of id and two hashes of the text, over all of them; rows equal in id and
    text share a number. Numbers come from ranges of that order, each counted by
    its own task, and the counts of the ranges before.
    """
    keyed = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.hash("text")})
    shared = cut(keyed.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "shared-ids")
    if not shared.take(1):
        single = rows.withColumn("number", F.lit(0).cast("long"))
        return single, single
    texts = keyed.join(shared, "doc", "left_semi").select("doc", "t1", "t2").distinct()
    ranged = cut(texts.repartitionByRange("doc", "t1", "t2").withColumn("part", F.spark_partition_id()), "shared-texts")
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    before = before.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("doc", "t1", "t2"))
    numbers = cut(ranged.withColumn("_in", within).join(F.broadcast(before), "part").select("doc", "t1", "t2", (F.col("_in") + F.col("before")).alias("number")), "text-numbers")
    all_ = keyed.join(numbers, ["doc", "t1", "t2"], "left").select("doc", "text", F.coalesce("number", F.lit(0)).cast("long").alias("number"))
    some = all_.where("number > 0").groupBy("doc", "number").agg(F.first("text").alias("text")).select("doc", "text", "number")
    return all_, cut(all_.where("number = 0").unionByName(some), "numbered-texts")


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc, number, start, windows: runs of 100-byte windows that occur before, in ``docs`` (doc, number, text not null)."""
    both = cut(collapse(find_segments(docs, hot_keys(docs))), "repeat-segments")
    found = cut(compare(cut_out(docs, both.where("key <> -1"))), "repeat-windows")
    return both.where("key = -1").unionByName(found).select("doc", _number().alias("number"), _offset().alias("start"), "windows")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Every whole text as bytes, without those covered by a 100-byte string that starts earlier.

    ``docs``: doc_id (a whole number), text; other columns are ignored. Returns
    doc_id, n_bytes, spans (array of start and end of the removed runs) and
    kept (the remaining bytes). Earlier means a smaller doc_id, or the same one
    and a smaller start; a null doc_id is smaller than all. Different texts that
    share a doc_id, or have none, are documents of their own, in the order of
    their hashes; rows equal in id and text are one document and lose the same. A
    null text is empty. An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows, texts = numbered(rows)
    spans = removed_spans(texts).groupBy("doc", "number").agg(F.collect_list(F.struct("start", "windows")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, runs, kept = [], [], []
            for text, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, own = text.encode(), []
                for at, stop in sorted((x["start"], x["start"] + x["windows"] + SPAN - 1) for x in s or ()):
                    stop = min(stop, len(raw))
                    if own and at <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], stop)
                    elif at < stop:
                        own.append([at, stop])
                left = zip([0, *(x[1] for x in own)], [*(x[0] for x in own), len(raw)])
                sizes.append(len(raw))
                runs.append([{"start": x[0], "end": x[1]} for x in own])
                kept.append(b"".join(raw[i:j] for i, j in left))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            ids = [None if d == NO_ID else d for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(spans, ["doc", "number"], "left").select("doc", "text", "s")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


__all__ = ["compare", "collapse", "digest", "find_segments", "hot_keys", "removed_spans", "suffix_dedup"]
