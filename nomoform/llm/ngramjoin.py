"""Join of documents on the Jaccard similarity of their word n-grams, by signature trees.

Equal sets collapse to one. Sets are cut into ranges of the hash space, more
ranges than a linked pair can differ in, so a linked pair shares a whole range;
sets that share one, directly or over others, form a family, outside of which
nothing links. The sets of a family, in blocks of a bounded size, are the leaves
of a signature tree: a node holds the OR of the bitmaps below it, the range of
set sizes and the most elements that share bits. Two trees are walked together
from the root, and a pair of nodes goes no deeper if the largest overlap its
bitmaps and sizes allow is too small, or all below it is connected already.
Pairs of leaves that are left are compared element by element.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import Remembered
from .common import cut, hash_bitmap, may_hold
from .simhash import components

SHINGLE = 3
#: Documents link at this Jaccard similarity, in hundredths, or more.
SIMILARITY = 90
#: Size classes grow by half; MARGIN ranges more than needed, as a few may be empty.
MARGIN = 2
#: Shingles in a block of a family; a task holds two blocks at most.
BLOCK = 1 << 21
FAN = 8
#: Pairs of nodes whose bounds are computed at once.
STEP = 4096

_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return x ^ (x >> np.uint64(32))


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 13)


class Shingler:
    """The distinct shingles of texts as sorted 64-bit hashes."""

    def __init__(self, entries: int = 400_000) -> None:
        self.words = Remembered(_word_hash, entries)

    def __call__(self, text: str | None) -> np.ndarray:
        ws = (text or "").encode().lower().split()
        h = np.array([self.words[w] for w in ws], np.uint64)
        n = min(SHINGLE, len(h))
        if not n:
            return h
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mixed(out + h[i : len(h) - n + 1 + i] * _ODD[i])
        return np.unique(out)


def _classes() -> list[int]:
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 3 // 2 + 1)
    return bounds


_BOUNDS = np.array(_classes())


def range_keys(shingles: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """64-bit keys such that two different sets at ``similarity`` or more share one.

    If the smaller of a linked pair has a shingles, they differ in at most
    d = a * (100 - similarity) / similarity. A size class is cut into one range
    more than d for its largest set, and MARGIN more, so that MARGIN + 1 ranges
    are equal; an empty range is a key only in sets with more than MARGIN of
    them. A set takes part in the classes of all smaller sets that it may link to.
    """
    n, out = len(shingles), []
    sums = np.r_[np.uint64(0), np.cumsum(_mixed(shingles ^ _ODD[2]))]
    least = -(-similarity * n // 100)
    for j in range(np.searchsorted(_BOUNDS, max(least, 1), "right") - 1, np.searchsorted(_BOUNDS, n, "right")):
        differ = int(_BOUNDS[j + 1] - 1) * (100 - similarity) // similarity
        if not differ:  # only equal sets link
            continue
        k = differ + 1 + MARGIN
        edges = np.array([(i << 64) // k for i in range(1, k)], np.uint64)
        at = np.r_[0, np.searchsorted(shingles, edges), n]
        size = np.diff(at)
        key = _mixed((sums[at[1:]] - sums[at[:-1]]) + _mixed(np.arange(k, dtype=np.uint64) + (np.uint64(j) << np.uint64(40))) + size.astype(np.uint64) * _ODD[1])
        out.append(key if (size == 0).sum() > MARGIN else key[size > 0])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(len(sizes))


class SignatureTree:
    """Nodes of FAN children over sets: OR-combined bitmaps, size ranges, and the most elements without a bit of their own."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        size = np.array([len(s) for s in sets])
        bits = min(max(9, int(4 * size.max() - 1).bit_length()), 16)
        signatures = np.zeros((len(sets), 1 << bits - 6), np.uint64)
        step = max(1, (1 << 25) >> bits)
        for a in range(0, len(sets), step):
            flags = np.zeros((min(step, len(sets) - a), 1 << bits), bool)
            for i, s in enumerate(sets[a : a + step]):
                flags[i, (s * _ODD[1]) >> np.uint64(64 - bits)] = True
            signatures[a : a + step] = np.packbits(flags, axis=1).view(np.uint64)
        self.levels = [(signatures, size, size, size - np.bitwise_count(signatures).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > FAN:
            own, low, high, shared = self.levels[-1]
            at = np.arange(0, len(own), FAN)
            self.levels.append((np.bitwise_or.reduceat(own, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(shared, at)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, similarity: int) -> np.ndarray:
        """Whether any sets below the nodes i and j can overlap enough, by bitmaps and sizes."""
        own, low, high, shared = self.levels[level]
        ok = (100 * high[i] >= similarity * low[j]) & (100 * high[j] >= similarity * low[i])
        at = np.flatnonzero(ok)
        i, j = i[at], j[at]
        most = np.bitwise_count(own[i] & own[j]).sum(axis=1, dtype=np.int64) + np.minimum(shared[i], shared[j])
        most = np.minimum(most, np.minimum(high[i], high[j]))
        ok[at] = (100 + similarity) * most >= similarity * (low[i] + low[j])
        return ok

    def links(self, label: np.ndarray, wanted: np.ndarray | None, similarity: int = SIMILARITY) -> Iterator[tuple[int, int]]:
        """Links that connect all linked sets, at most one for each set; sets of one ``label`` count as connected.

        If ``wanted`` is given, pairs without a wanted set are left out.
        """
        label, count = label.copy(), len(self.sets)
        top = len(self.levels) - 1
        stack = [(top, *_pairs_within(self.levels[top][1]))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > STEP:
                stack += [(level, i[STEP:], j[STEP:]), (level, i[:STEP], j[:STEP])]
                continue
            at = np.arange(0, count, FAN**level)
            low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            ok = (low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j])
            if wanted is not None:
                any_ = np.logical_or.reduceat(wanted, at)
                ok &= any_[i] | any_[j]
            i, j = i[ok], j[ok]
            ok = self.may_link(level, i, j, similarity)
            i, j = i[ok], j[ok]
            if level:
                below = len(self.levels[level - 1][1])
                a = (FAN * i[:, None] + np.repeat(np.arange(FAN), FAN)).ravel()
                b = (FAN * j[:, None] + np.tile(np.arange(FAN), FAN)).ravel()
                ok = (a < below) & (b < below) & (a <= b)
                a, b = a[ok], b[ok]
                far = np.abs(a - b).argsort(kind="stable")  # neighbours are the likeliest links: they come first
                if len(a):
                    stack.append((level - 1, a[far], b[far]))
                continue
            for a, b in zip(i.tolist(), j.tolist()):
                if label[a] != label[b] and self.linked(a, b, similarity):
                    label[label == label[b]] = label[a]
                    yield a, b

    def linked(self, a: int, b: int, similarity: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        both = np.sort(np.concatenate((x, y)), kind="stable")
        return (100 + similarity) * int((both[1:] == both[:-1]).sum()) >= similarity * (len(x) + len(y))


def signatures(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, t (hash of the text), n, id (128-bit digest of the set, null if empty) and keys of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for b in batches:
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys = pa.array([range_keys(s, similarity).view(np.int64) for s in sets], pa.list_(pa.int64()))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(ids, pa.binary()), keys], ["doc_id", "t", "n", "id", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id {kind}, t long, n long, id binary, keys array<long>")


def stars(sets: DataFrame) -> DataFrame:
    """id, hub: for every key that several sets share, each of them with the smallest one."""
    keyed = sets.select("id", F.explode("keys").alias("h"))
    often = cut(keyed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "range-counts")
    some = cut(may_hold(keyed, cut(hash_bitmap(often), "range-bitmap")), "range-keys")
    hubs = some.groupBy("h").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").drop("last")
    return cut(some.join(hubs, "h").where("id > hub").select("id", "hub").distinct(), "range-stars")


def with_shingles(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` (id, first, ...) with their shingles, from the texts of the rows that ``first`` names."""
    texts = docs.select(F.col("doc_id"), F.xxhash64("text").alias("t"), "text")
    some = may_hold(texts, cut(hash_bitmap(sets.select(F.col("first.t").alias("t")), "t"), "text-bitmap"), "t").withColumnRenamed("t", "own_t")
    rest = [c for c in sets.columns if c != "first"]
    joined = some.join(sets, (F.col("own_t") == F.col("first.t")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select("text", *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for b in batches:
            found = pa.array([shingles(t).view(np.int64) for t in b.column(0).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], found], [*rest, "shingles"])

    kinds = ", ".join(f"{c} {sets.schema[c].dataType.simpleString()}" for c in rest)
    return joined.mapInArrow(run, f"{kinds}, shingles array<long>").dropDuplicates(["id"])


def _blocks(total: Column, block: int) -> Column:
    return F.ceil(total / F.lit(block)).cast("long")


def dealt(leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """``leaves`` (id, family, label) with task: where each goes so that every pair with different labels meets.

    The label with most shingles in a family is its home; home sets need not meet
    each other. Home sets and others are dealt over blocks, and each pair of
    blocks but two home ones is a task. A family of one block is one task, and ``whole``.
    """
    by_label = leaves.groupBy("family", "label").agg(F.sum("n").alias("n"), F.count("*").alias("sets"))
    home = by_label.groupBy("family").agg(F.max(F.struct("sets", "n", "label")).alias("home"), F.sum("n").alias("total"))
    sized = home.select("family", "total", F.when(F.col("home.sets") > 1, F.col("home.label")).alias("home"), F.when(F.col("home.sets") > 1, F.col("home.n")).otherwise(0).alias("home_n"))
    small = F.col("total") <= block
    sized = sized.select(
        "family",
        F.when(~small, F.col("home")).alias("home"),
        F.when(small, 0).otherwise(_blocks(F.col("home_n"), block)).alias("homes"),
        F.when(small, 1).otherwise(_blocks(F.col("total") - F.col("home_n"), block)).alias("others"),
    )
    at_home = F.coalesce(F.col("label") == F.col("home"), F.lit(False))
    rows = leaves.join(sized, "family").withColumn("at_home", at_home)
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.when(F.col("at_home"), F.col("homes")).otherwise(F.col("others"))))
    pair = lambda i, j, kind: i * F.lit(1 << 32) + j * 2 + kind
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    none = F.array().cast("array<bigint>")
    over = lambda n, f: F.when(n > 0, F.transform(upto(n), f)).otherwise(none)
    to_homes = over(F.col("homes"), lambda h: pair(F.col("b"), h, 1))
    to_others = over(F.col("others"), lambda o: pair(F.greatest(o, F.col("b")), F.least(o, F.col("b")), 0))
    tasks = F.when(F.col("at_home"), over(F.col("others"), lambda o: pair(o, F.col("b"), 1))).otherwise(F.concat(to_homes, to_others))
    whole = (F.col("homes") == 0) & (F.col("others") == 1)
    return rows.select("id", "family", "label", (~F.col("at_home")).alias("wanted"), whole.alias("whole"), F.explode(tasks).alias("task"))


def _least_of_component(links: list[tuple[int, int]], ids: list[bytes]) -> dict[int, int]:
    """For each end of a link, the end with the smallest id that links lead to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for x in links:
        a, b = sorted(map(find, x), key=ids.__getitem__)
        root[b] = a
    return {x: find(x) for x in list(root)}


def tree_links(leaves: DataFrame, sets: DataFrame, similarity: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """a, b, whole: links that connect all linked sets of each family; ``sets``: id, shingles.

    In a family that is one task, b is the smallest id that a is connected to.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, shingles = table.column("id").to_pylist(), table.column("shingles").chunk(0)
        at, flat = np.asarray(shingles.offsets), np.asarray(shingles.values).view(np.uint64)
        each = [flat[a:b] for a, b in zip(at, at[1:])]
        order = sorted(range(len(each)), key=lambda i: (each[i][0], each[i][-1], len(each[i])))
        _, code = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)
        wanted, whole = np.asarray(table.column("wanted"))[order], table.column("whole")[0].as_py()
        tree = SignatureTree([each[i] for i in order])
        found = [(order[a], order[b]) for a, b in tree.links(code[order], None if wanted.all() else wanted, similarity)]
        if whole:
            found = list(_least_of_component(found, ids).items())
        ends = [pa.array([ids[x[k]] for x in found], pa.binary()) for k in range(2)]
        return pa.table([*ends, pa.array([whole] * len(found), pa.bool_())], ["a", "b", "whole"])

    rows = dealt(leaves, block).join(sets.select("id", "shingles"), "id")
    columns = rows.select("family", "task", "id", "label", "wanted", "whole", "shingles")
    return columns.groupBy("family", "task").applyInArrow(run, "a binary, b binary, whole boolean")


def contracted(leaves: DataFrame, pairs: DataFrame, sets: DataFrame, similarity: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Labels of leaves in families of several blocks, after the links among ``pairs`` (id, hub), and these links.

    Such a family is a crowd of near copies, or sets that share a long passage.
    Each set is compared with its hubs, which is linear, and what that connects
    needs no pair of its own in the trees.
    """
    large = cut(leaves.groupBy("family").agg(F.sum("n").alias("n")).where(F.col("n") > block).select("family"), "large-families")
    if not large.take(1):
        return leaves, None
    own = pairs.join(leaves.select("id", "family"), "id").join(large, "family", "left_semi").select("id", "hub")
    a, b = sets.select("id", F.col("shingles").alias("x")), sets.select(F.col("id").alias("hub"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    linked = own.join(a, "id").join(b, "hub").where((100 + similarity) * both >= similarity * (F.size("x") + F.size("y")))
    links = cut(linked.select(F.col("id").alias("a"), F.col("hub").alias("b")), "star-links")
    joined = components(links)
    named = leaves.join(joined, leaves["id"] == joined["node"], "left").select("id", "family", F.coalesce("root", "label").alias("label"), "n")
    return cut(named, "large-labels"), links


def ngram_join(docs: DataFrame, similarity: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable over links of similar sets.

    ``docs``: doc_id, text; other columns are ignored. A-Z are lower-cased, a
    document's set holds its distinct 3-word shingles, or all its words if they
    are fewer. A null text or one without words has an empty set and links with
    nothing, so its component is its own doc_id. Rows with equal sets link, and
    repeated rows each get their row. Null doc_ids come after all others: a
    component is null only if all its doc_ids are. An empty table gives no rows.
    Shingles are told apart by 64-bit hashes, sets by 128-bit digests of these.
    """
    marked = cut(signatures(docs, similarity), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    sets = cut(marked.where("id is not null").groupBy("id").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")), "sets")
    pairs = stars(sets)
    families = components(pairs.select(F.col("id").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("id"), F.col("root").alias("family"))
    leaves = cut(sets.drop("keys").join(families, "id").withColumn("label", F.col("id")), "leaves")
    shingles = cut(with_shingles(docs, leaves.select("id", "first")), "leaf-shingles")
    named, links = contracted(leaves.select("id", "family", "label", "n"), pairs, shingles, similarity, block)
    found = cut(tree_links(named, shingles, similarity, block), "tree-links")
    roots = found.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if links:
        rest = components(found.where("NOT whole").select("a", "b").unionByName(links))
        roots = roots.unionByName(rest)
    rooted = sets.select("id", "first").join(roots, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    by_set = cut(rooted.join(least, "root").select("id", F.col("least.doc_id").alias("component_id")), "set-components")
    joined = marked.select("doc_id", F.col("n").alias("n_shingles"), "id").join(by_set, "id", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
