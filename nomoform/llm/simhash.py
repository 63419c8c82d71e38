"""SimHash near-duplicates: pigeonhole blocks, a check of the Hamming distance, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fingerprints link at so many differing bits or fewer.
MAX_BITS = 3
SHINGLE = 3
#: Groups of up to so many fingerprints are compared as arrays over the whole batch.
SMALL_GROUP = 32
#: Groups beyond this are cut into blocks of the bits that their key does not hold.
LARGE_GROUP = 2048


def fingerprint(text: str | None) -> int:
    """64 bits: 1 where over half of the shingle hashes have a 1; zero for a text without words."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    if len(ws) < SHINGLE:
        shingles = [b" ".join(ws)]
    else:
        shingles = [b"%b %b %b" % x for x in zip(ws, ws[1:], ws[2:])]
    h = np.fromiter(map(xxh64, shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, range(1 << 16, len(h), 1 << 16)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def xxh64(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, 42)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(masks: list[int]) -> list[int]:
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_masks(n: int) -> list[int]:
    """Bit masks such that two fingerprints within MAX_BITS agree under at least one.

    With b blocks and three differing bits, b - 3 blocks agree; more blocks give
    longer keys, so few fingerprints share one by chance. b follows the count of
    distinct fingerprints; every choice finds the same links.
    """
    b = 5 if n < 1 << 22 else 6 if n < 1 << 29 else 7
    edges = [64 * i // b for i in range(b + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return _signed([sum(c) for c in combinations(blocks, b - MAX_BITS)])


def _inner_masks(mask: int) -> list[int]:
    """The same within a group whose key holds the bits of ``mask``: two of five blocks of the other bits."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    blocks = [sum(free[len(free) * i // 5 : len(free) * (i + 1) // 5]) for i in range(5)]
    return [sum(c) for c in combinations(blocks, 5 - MAX_BITS)]


def _forest(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links within one large group: at most one link per fingerprint."""
    left, right, rest = [], [], fps
    while len(rest):
        front, rest = [rest[:1]], rest[1:]
        while front and len(rest):
            x = front.pop()
            for one in x:
                near = np.bitwise_count(rest ^ one) <= MAX_BITS
                if near.any():
                    found, rest = rest[near], rest[~near]
                    left.append(np.full(len(found), one))
                    right.append(found)
                    front.append(found)
    return left, right


def _large(fps: np.ndarray, mask: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning forests of the groups that a large group's further blocks form; together they connect all its links."""
    left, right = [], []
    for inner in _inner_masks(mask):
        key = fps & np.uint64(inner)
        o = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, key[o][1:] != key[o][:-1]])
        for part in np.split(fps[o], new[1:]):
            if len(part) > 1:
                a, b = _forest(part)
                left += a
                right += b
    return left, right


def _links(batches: Iterator[pa.RecordBatch], masks: list[int]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal (mask, key); batches are sorted, a run may span several."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush(i: np.ndarray, k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (k[1:] != k[:-1])])
        sizes = np.diff(np.r_[new, len(fp)])
        run = np.repeat(np.arange(len(new)), sizes)
        left, right = [], []
        small = sizes <= SMALL_GROUP
        for s in range(1, int(sizes[small].max(initial=1))):
            ok = (run[s:] == run[:-s]) & small[run[s:]] & (np.bitwise_count(fp[s:] ^ fp[:-s]) <= MAX_BITS)
            left.append(fp[:-s][ok])
            right.append(fp[s:][ok])
        for at, size in zip(new[~small], sizes[~small]):
            group = fp[at : at + size]
            a, b = _forest(group) if size <= LARGE_GROUP else _large(group, masks[i[at]] % (1 << 64))
            left += a
            right += b
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        i, k, fp = (np.asarray(batch.column(c)) for c in range(3))
        held.append((i, k, fp.view(np.uint64)))
        last = np.flatnonzero((i != i[-1]) | (k != k[-1]))
        if len(last):  # all runs but the last are whole
            end = last[-1] + 1
            i, k, fp = (np.concatenate(x) for x in zip(*held[:-1], tuple(c[:end] for c in held[-1])))
            yield from flush(i, k, fp)
            held = [tuple(c[end:] for c in held[-1])]
    if held:
        yield from flush(*(np.concatenate(x) for x in zip(*held)))


def near_pairs(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all that lie within MAX_BITS.

    Small groups give all their links; a larger one, where links grow with the
    square of its size, gives a spanning forest, which leaves the components as
    they are; beyond LARGE_GROUP it is cut by further blocks first, so its time
    grows with the square of those.
    """
    masks = block_masks(fps.count())
    keyed = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("x")
    ).select("x.i", "x.k", "fp")
    dealt = keyed.repartition("i", "k").sortWithinPartitions("i", "k", "fp")
    return dealt.mapInArrow(lambda batches: _links(batches, masks), "a long, b long").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that is reachable, for every node with a link.

    Alternating large and small stars: each round hangs neighbours below the
    smallest one, and ends at stars in about log(n) rounds. Every round is
    written to the shared folder.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u > v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of near fingerprints.

    ``docs``: doc_id, text; other columns are ignored. A null text is empty and
    has fingerprint zero, which links like any other. Copies share a fingerprint
    and are collapsed before any comparison. Repeated rows each get their row;
    an empty table gives none. A component whose doc_ids are all null has a null
    component_id.
    """
    marked = cut(fingerprints(docs), "fingerprints")
    groups = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-groups")
    roots = cut(components(near_pairs(groups.select("fp"))), "fingerprint-roots")
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut(rooted.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Exactly one row of each component of near-duplicates, with all its columns.

    The one with the smallest doc_id stays; a null doc_id comes after all
    others, and rows that share one follow a hash of the whole row. Of equal
    rows one stays. The key of a row is that order itself, so rows are told
    apart whatever their doc_ids.
    """
    row = F.md5(F.to_json(F.struct(*docs.columns)))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), row.alias("row"))
    groups = near_duplicates(docs.select(key.alias("doc_id"), "text"))
    first = groups.select(F.col("component_id.row").alias("_row")).distinct()
    return docs.withColumn("_row", row).join(first, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
