"""Collocations of two to five words by best-first branch-and-bound growth of prefixes.

Each language has a tree of phrases whose nodes are prefixes. A score is at most
1000 * n / l for any first part l, so the count of a node's first word bounds
all phrases below it. A round counts, in one pass over the corpus, the one-word
extensions of the best open nodes; with each count come the words around it, if
they are always the same, which tell whether a longer phrase covers it. Rounds
end for a language when no open node can reach its 2000th surviving score, and
every part of the phrases that reach it has been counted.

Words travel as 64-bit hashes, which are checked to be unique for all frequent
words. Tasks know nodes by a bitmap of hashes of a fixed size: a false hit costs
a count that is not needed, nothing else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Remembered
from .common import BITMAP, cut, hash_bitmap, may_hold

#: A phrase is a candidate from so many occurrences on.
LEAST = 100
LONGEST = 5
TOP = 2000
#: A round takes the best nodes whose occurrences make up to one in so many of a language's words.
SHARE = 2
#: Distinct words that a task counts before it hands them on.
HELD = 400_000

_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_MARK = b"\n"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + _MARK * 10 + b" ")


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text, lower-cased in A-Z, with a line feed where a piece ends."""
    return [w for w in (text or b"").translate(_FOLD).replace(_MARK, b" \n ").split(b" ") if w]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[2]
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return x ^ (x >> np.uint64(32))


def _word_hash(word: bytes, seed: int) -> int:
    return 0 if word == _MARK else xxhash.xxh64_intdigest(word, seed)


def _lang_hash(lang: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang.encode(), 5)], np.uint64)


def _first(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Hashes of one-word nodes of a language."""
    return _mixed(words + langs * _ODD[1])


def _longer(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(node * _ODD[1] + word)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, h (its hash), p (hash of its node) and f: all words of every language."""

    def rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            h = np.array([_word_hash(w, seed) for w in counts], np.uint64)
            p = _first(h, _lang_hash(lang))
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts)), words, pa.array(h.view(np.int64)), pa.array(p.view(np.int64)), pa.array(list(counts.values()), pa.int64())],
                ["lang", "word", "h", "p", "f"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, held.values())) > HELD:
                yield from rows(_without_marks(held))
                held = {}
        yield from rows(_without_marks(held))

    parts = docs.mapInArrow(run, "lang string, word string, h long, p long, f long")
    return parts.groupBy("lang", "word").agg(F.first("h").alias("h"), F.first("p").alias("p"), F.sum("f").alias("f"))


def _without_marks(held: dict[str, Counter]) -> dict[str, Counter]:
    for counts in held.values():
        counts.pop(_MARK, None)
    return {lang: counts for lang, counts in held.items() if counts}


def bitmap(nodes: DataFrame) -> np.ndarray:
    """The bits of the hashes ``p``, BITMAP of them whatever the number of nodes."""
    bit = F.pmod("p", F.lit(BITMAP)) + 1
    rows = nodes.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(BITMAP // 8, np.uint8)
    for at, bits in rows:
        out[4096 * (at - 1) : 4096 * at] = np.frombuffer(bits, np.uint8)
    return out


def _holds(bits: np.ndarray, p: np.ndarray) -> np.ndarray:
    at = p & np.uint64(BITMAP - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def frequent_tokens(docs: DataFrame, words: Broadcast, seed: int) -> DataFrame:
    """lang and h: the hashes of each text's frequent words in order, 0 where others lie or a piece or the text ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = Remembered(lambda w: _word_hash(w, seed), HELD), words.value
        for b in batches:
            out = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.array([known[w] for w in tokens(text)] + [0], np.uint64)
                h[~_holds(bits, _first(h, _lang_hash(lang)))] = 0
                out.append(h[np.r_[h[:1] != 0, (h[1:] != 0) | (h[:-1] != 0)]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["lang", "h"])

    return docs.mapInArrow(run, "lang string, h array<long>").where(F.size("h") > 1)


def _phrases(h: np.ndarray, at: np.ndarray, node: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """First places, counts, and the one word before and after (0: several, or an end) of the distinct phrases of m words at ``at``."""
    _, first, which, count = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
    same = np.ones(len(at), bool)
    for t in range(m):
        same &= h[at + t] == h[at[first][which] + t]
    if not same.all():  # different phrases with one hash
        _, first, which, count = np.unique(np.stack([h[at + t] for t in range(m)]), axis=1, return_index=True, return_inverse=True, return_counts=True)
    around = []
    for side in (-1, m):
        own = h[at + side]
        differ = np.bincount(which, own != own[first][which], len(first)) > 0
        around.append(np.where(differ, np.uint64(0), own[first]))
    return at[first], node[first], count, *around


def scan(texts: DataFrame, nodes: Broadcast | None, lengths: list[int], wanted: Broadcast | None, wanted_lengths: list[int]) -> DataFrame:
    """Counts of all one-word extensions of the nodes, which have ``lengths`` words, and of the wanted phrases.

    lang, g (hashes of the words), p, a, left and right: the hash of the word
    that is before, or after, every occurrence, else 0. A phrase is counted
    wherever it occurs or not at all, so its count is final.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max([*lengths, *[k - 1 for k in wanted_lengths]])
        for b in batches:
            col = b.column(1)
            offsets = np.asarray(col.offsets).astype(np.int64)
            flat = np.asarray(col.values).view(np.uint64)[offsets[0] : offsets[-1]]
            # a zero before the first text and, after the last, enough for the longest phrase and the word after it
            h = np.r_[np.uint64(0), flat, np.zeros(LONGEST + 1, np.uint64)]
            langs = b.column(0).dictionary_encode()
            names = langs.dictionary.to_pylist()
            of = np.r_[0, np.repeat(np.asarray(langs.indices), np.diff(offsets)), np.zeros(LONGEST + 1, np.int64)]
            at = np.flatnonzero(h)
            node = _first(h[at], np.concatenate([_lang_hash(x) for x in names])[of[at]])
            for k in range(1, most + 1):
                grown = _holds(nodes.value, node) if nodes is not None and k in lengths else np.zeros(len(at), bool)
                on = h[at + k] != 0
                at, node, grown = at[on], _longer(node[on], h[at[on] + k]), grown[on]
                if wanted is not None and k + 1 in wanted_lengths:
                    grown |= _holds(wanted.value, node)
                if not grown.any():
                    continue
                where, p, count, left, right = _phrases(h, at[grown], node[grown], k + 1)
                words = h[where[:, None] + np.arange(k + 1)].view(np.int64)
                g = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, k + 1, dtype=np.int32)), pa.array(words.ravel()))
                lang = langs.dictionary.take(pa.array(of[where]))
                longs = [pa.array(x.view(np.int64)) for x in (p, count.astype(np.int64), left, right)]
                yield pa.RecordBatch.from_arrays([lang, g, *longs], ["lang", "g", "p", "a", "left", "right"])

    parts = texts.mapInArrow(run, "lang string, g array<long>, p long, a long, left long, right long")
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(0).alias(c)
    counts = parts.groupBy("lang", "g").agg(F.first("p").alias("p"), F.sum("a").alias("a"), one("left"), one("right"))
    return counts.where(F.col("a") >= LEAST)


def _score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)), exact: 38 digits hold the products of counts up to 10^17."""
    whole = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    return F.expr(f"CAST(1000 AS DECIMAL(38, 0)) * {whole(a)} * {whole(n)} DIV ({whole(left)} * {whole(right)})")


def scored(counted: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The phrases that no longer one covers, with a, l, r, score and open, and the parts of theirs not counted yet.

    ``counted``: lang, g, a, left, right of words and phrases. ``score`` is the
    smallest over the cuts whose parts are counted, an upper bound while ``open``;
    null without any.
    """
    length = F.size("g")
    free = counted.where((length > 1) & ((length == LONGEST) | ((F.col("left") == 0) & (F.col("right") == 0))))
    cuts = free.join(sizes, "lang").select("lang", "g", "a", "n", F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    cuts = cuts.withColumns({"g1": F.slice("g", F.lit(1), F.col("k")), "g2": F.slice("g", F.col("k") + 1, F.size("g") - F.col("k"))})
    for part, name in (("g1", "l"), ("g2", "r")):
        cuts = cuts.join(counted.select("lang", F.col("g").alias(part), F.col("a").alias(name)), ["lang", part], "left")
    cuts = cut(cuts.withColumn("score", _score("a", "n", "l", "r")), "phrase-cuts")
    known = F.col("score").isNotNull()
    found = cuts.groupBy("lang", "g").agg(F.first("a").alias("a"), F.min(F.when(known, F.struct("score", "k", "l", "r"))).alias("low"), F.first("n").alias("n"), F.max(~known).alias("open"))
    found = found.select("lang", "g", "a", "low.l", "low.r", "n", "low.score", "open")
    missing = lambda part, name: cuts.where(F.col(name).isNull()).select("lang", "g", F.col(part).alias("part"))
    return found, missing("g1", "l").unionByName(missing("g2", "r"))


def best(phrases: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank; first within slices, so that no task sorts a language."""
    slices = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = phrases.withColumn("_slice", F.pmod(F.xxhash64("g"), F.lit(slices)))
    some = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("_slice", "_rank")


def frontier(counted: DataFrame, expanded: DataFrame | None, sizes: DataFrame, settled: DataFrame) -> DataFrame:
    """The nodes to expand now: open ones whose bound reaches the settled score, best first up to a share of the words.

    The bound of a node is floor(1000 * n / f), f the count of its first word;
    nodes are taken by classes of f, doubling, the smallest f and so the highest
    bounds first.
    """
    heads = counted.where(F.size("g") == 1).select("lang", F.get("g", F.lit(0)).alias("w"), F.col("a").alias("f"))
    nodes = counted.where(F.size("g") < LONGEST).withColumn("w", F.get("g", F.lit(0))).join(heads, ["lang", "w"])
    if expanded is not None:
        nodes = nodes.join(expanded, ["lang", "g"], "left_anti")
    nodes = nodes.join(sizes, "lang").join(settled, "lang", "left")
    nodes = nodes.where(F.expr("1000 * CAST(n AS DECIMAL(38, 0)) DIV f") >= F.coalesce("settled", F.lit(0))).withColumn("class", F.length(F.bin("f")))
    nodes = cut(nodes.select("lang", "g", "p", "a", "n", "class"), "open-nodes")
    classes = nodes.groupBy("lang", "class").agg(F.sum("a").alias("a"), F.first("n").alias("n"))
    w = Window.partitionBy("lang").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    chosen = classes.withColumn("before", F.coalesce(F.sum("a").over(w), F.lit(0))).where((F.col("before") == 0) | ((F.col("before") + F.col("a")) * SHARE <= F.col("n")))
    return cut(nodes.join(chosen.select("lang", "class"), ["lang", "class"]).select("lang", "g", "p"), "frontier")


def _lengths(nodes: DataFrame) -> list[int]:
    return sorted(r[0] for r in nodes.select(F.size("g")).distinct().collect())


def node_hashes(parts: DataFrame) -> DataFrame:
    """``parts`` (lang, g) with p, the hash of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = []
            for lang, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.array(g, np.int64).view(np.uint64)
                p = _first(h[:1], _lang_hash(lang))
                for w in h[1:]:
                    p = _longer(p, w)
                ps.append(int(p.view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ps, pa.int64())], ["lang", "g", "p"])

    return parts.select("lang", "g").mapInArrow(run, "lang string, g array<long>, p long")


def frequent_words(docs: DataFrame, seeds: int = 8) -> tuple[DataFrame, DataFrame, int]:
    """The words with LEAST occurrences in a language, all languages' numbers of words, and the seed of the hashes.

    No two words share a hash of which one is frequent; else the next seed is taken.
    """
    for seed in range(seeds):
        counts = cut(word_counts(docs, seed), "words")
        words = cut(counts.where(F.col("f") >= LEAST), "frequent-words")
        near = may_hold(counts.select("h", "word"), cut(hash_bitmap(words.select("h")), "word-bitmap"))
        clash = near.join(words.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a < b OR h = 0")
        if not clash.take(1):
            return words, cut(counts.groupBy("lang").agg(F.sum("f").alias("n")), "languages"), seed
    raise RuntimeError("no seed tells all frequent words apart")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` surviving phrases of every language.

    ``docs``: lang, text; other columns are ignored. A null text is empty, a null
    lang is ``und``; repeated rows count as often as they occur. Ties are ordered
    by a, descending, then by the bytes of the phrase. Languages without a
    phrase of LEAST occurrences, and an empty table, give no rows.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    words, sizes, seed = frequent_words(texts)
    coded = cut(frequent_tokens(texts, context.broadcast(bitmap(words)), seed), "frequent-tokens")
    zero = F.lit(0).cast("long")
    counted = words.select("lang", F.array("h").alias("g"), "p", F.col("f").alias("a"), zero.alias("left"), zero.alias("right"))
    settled = sizes.select("lang", zero.alias("settled"))
    expanded = wanted = found = None
    while True:
        nodes = frontier(counted, expanded, sizes, settled)
        lengths, wanted_lengths = _lengths(nodes), _lengths(wanted) if wanted is not None else []
        if not lengths and not wanted_lengths:
            break
        bits = context.broadcast(bitmap(nodes)) if lengths else None
        wanted_bits = context.broadcast(bitmap(wanted)) if wanted_lengths else None
        new = cut(scan(coded, bits, lengths, wanted_bits, wanted_lengths), "phrases")
        counted = counted.unionByName(new.join(counted, ["lang", "g"], "left_anti"))
        counted = cut(counted, "counted")
        done = nodes.select("lang", "g")
        expanded = cut(expanded.unionByName(done), "expanded") if expanded is not None else done
        found, missing = scored(counted, sizes)
        found = cut(found, "scored")
        low = best(found.where("NOT open"), [F.desc("score")], top).where(F.col("rank") == top).select("lang", F.col("score").alias("settled"))
        settled = cut(low, "settled")
        reach = found.join(settled, "lang", "left").where(F.col("open") & (F.col("score").isNull() | (F.col("score") >= F.coalesce("settled", zero))))
        wanted = cut(node_hashes(missing.join(reach.select("lang", "g"), ["lang", "g"], "left_semi").select("lang", F.col("part").alias("g")).distinct()), "wanted")
    out = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if found is None:
        return docs.sparkSession.createDataFrame([], out)
    reached = found.where("NOT open").join(settled, "lang", "left").where(F.col("score") >= F.coalesce("settled", zero)).drop("settled")
    spelt = reached.select("lang", "g", F.posexplode("g").alias("i", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    spelt = spelt.groupBy("lang", "g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = best(reached.join(spelt, ["lang", "g"]), [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
