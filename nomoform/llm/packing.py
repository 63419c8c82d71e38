"""Packing into fixed-length sequences: first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import WordCache

LENGTH = 1024
#: What is left of a document after its full sequences is cut to pieces of so many tokens at most.
REST = 256
#: Documents in a group, on average.
GROUP = 8192
SEED = 11


def cuts(n: int) -> list[int]:
    """Lengths of a document's pieces: full sequences, then its rest in pieces of at most REST."""
    full, rest = divmod(n, LENGTH)
    return [LENGTH] * full + [REST] * (rest // REST) + [rest % REST] * (rest % REST > 0)


class Tournament:
    """First fit over bins: a tree whose inner nodes hold the largest free capacity below."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size`` and what it had free."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        free = tree[node]
        tree[node] = free - size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
        return bin_, free


def first_fit_decreasing(sizes: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; items of one size keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = Tournament(len(sizes), capacity)
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        bins[i], free = tree.place(size)
        offsets[i] = capacity - free
    return bins, offsets


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, added: bool = False) -> DataFrame:
    """doc_id, n and ids of every whole text, ``end_id`` appended; ids are little-endian 32-bit.

    With ``added``, added tokens of the vocabulary that a text spells out get
    their own ids, as the tokenizer gives them by default; otherwise they are
    words like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _whole_encoder(tokenizer) if added else _cache(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids = [encode(t or "") + end for t in b.column(1).to_pylist()]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, ids binary")


_CACHES: dict[str, WordCache] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next above 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def _cache(tokenizer: str) -> WordCache:
    """One cache for each worker and vocabulary, filled by the tokenizer's model word by word."""
    if tokenizer not in _CACHES:
        from tokenizers import Tokenizer

        model, letters = Tokenizer.from_file(tokenizer).model, byte_letters()

        def encode_word(word: str) -> bytes:
            return array("I", [t.id for t in model.tokenize("".join([letters[b] for b in word.encode()]))]).tobytes()

        _CACHES[tokenizer] = WordCache(encode_word, PATTERN)
    return _CACHES[tokenizer]


def _whole_encoder(tokenizer: str) -> Callable[[str], bytes]:
    """Ids by word; a text that holds an added token goes through the tokenizer itself."""
    from tokenizers import Tokenizer

    whole, by_word = Tokenizer.from_file(tokenizer), _cache(tokenizer).encode
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
        return by_word(text)

    return encode


def pieces(tokens: DataFrame) -> DataFrame:
    """doc_id, n and, for each piece of the document in order, the CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for n, ids in zip(b.column(1).to_pylist(), b.column(2)):
                raw, at, own = ids.as_buffer(), 0, []
                raw = memoryview(raw)
                for size in cuts(n):
                    own.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    at += size
                crcs.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "n", "crcs"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "n", "ids").mapInArrow(run, f"doc_id {kind}, n long, crcs array<long>")


def pack(docs: DataFrame, n_docs: int) -> DataFrame:
    """Place the pieces of documents in sequences of LENGTH.

    ``docs``: doc_id, n (tokens, at least 1) and crcs (one per piece). Documents
    fall into groups of about GROUP by a seeded hash of doc_id, first CRC and the
    row's place in the table, so equal rows are spread as well and a group is
    bounded whatever the keys; each group is packed by itself. Returns a row
    per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    groups = max(1, -(-n_docs // GROUP))
    dealt = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", F.get("crcs", F.lit(0)), F.monotonically_increasing_id(), F.lit(SEED)), F.lit(groups)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("n", "ascending")]))
        n = np.asarray(table.column("n"))
        each = [cuts(int(x)) for x in n]
        count = np.array([len(x) for x in each])
        length = np.array([s for x in each for s in x], np.int64)
        first = np.repeat(np.cumsum(count) - count, count)
        before = np.cumsum(length) - length
        full = length == LENGTH
        seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        bins, offset[~full] = first_fit_decreasing(length[~full])
        seq[~full] = bins
        seq[full] = (bins.max() + 1 if len(bins) else 0) + np.arange(full.sum())
        rows = np.repeat(np.arange(len(n)), count)
        columns = {
            "doc_id": table.column("doc_id").take(pa.array(rows)),  # never as numbers of numpy, which have no null
            "start": before - before[first],
            "length": length,
            "ids_crc32": np.array(pc.list_flatten(table.column("crcs"))),
            "doc_tokens": n[rows],
            "sequence_id": (table.column("g")[0].as_py() << 32) + seq,
            "offset": offset,
        }
        return pa.table(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("g").applyInArrow(run, out)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, added: bool = False) -> DataFrame:
    """Tokenize every whole text, ``added`` as in :func:`tokenize`, and pack it.

    A null text is empty and has the end id alone. Null, repeated and extra
    columns: a null or repeated doc_id is a document like any other; other
    columns are ignored. An empty table gives no rows.
    """
    return pack(pieces(tokenize(docs, tokenizer, end_id, added)), docs.count())


def sequences(tokens: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id and its ids, in order: the packed training data themselves.

    ``tokens`` as from :func:`tokenize` and ``placed`` as from :func:`pack`,
    with unique doc_ids.
    """
    cut_ids = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    parts = placed.join(tokens.select("doc_id", "ids"), "doc_id").select("sequence_id", "offset", cut_ids.alias("part"))
    return parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("p")).select(
        "sequence_id", F.array_join(F.transform("p", lambda x: F.hex(x["part"])), "").alias("ids_hex")
    )


__all__ = ["pack", "pack_documents", "pieces", "sequences", "tokenize"]
