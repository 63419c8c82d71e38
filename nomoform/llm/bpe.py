"""Byte-level BPE over a global shuffle of distinct words, and decoding by a token-byte table.

Pre-tokens are exploded with their positions block by block: a block of
documents keeps, per document, the numbers of its words in the block's list of
distinct words, and sends each distinct word once. Words of all blocks meet by
hash, each distinct one is encoded once, and its ids go back to the blocks that
asked, where documents are reassembled by position.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chunks import Remembered, text_chunks

#: A block ends at so many characters or documents.
BLOCK_CHARS, BLOCK_DOCS = 12_000_000, 4096
#: Chunks of text whose pre-tokens a worker remembers.
REMEMBERED = 200_000
#: Distinct words whose ids a task holds; a part with more encodes some of them again.
KNOWN = 2_000_000


def _pack(items: list[bytes]) -> bytes:
    sizes = np.array([len(x) for x in items], "<u4")
    return zstandard.compress(np.array([len(items)], "<u4").tobytes() + sizes.tobytes() + b"".join(items), 1)


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)).tolist()
    starts = [4 + 4 * n, *ends[:-1]]
    return [raw[a:b] for a, b in zip(starts, ends)]


def explode_words(docs: DataFrame, pattern: str, parts: int) -> DataFrame:
    """Rows of two kinds, by ``part``.

    part -1: a document; ``data`` holds, for each position, the number of its
    word. part 0 and up: the distinct words of a block that hash to this part;
    ``data`` holds the words, ``codes`` their numbers. ``place`` is where a row
    meets others: documents of a block, or the words of a part.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        chunk_words: dict[str, tuple[str, ...]] = {}
        numbers: dict[str, int] = {}
        ids: list = []
        codes: list[np.ndarray] = []
        chars, digest, made = 0, hashlib.md5(), 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal numbers, ids, codes, chars, digest
            nonlocal made
            name = f"{TaskContext.get().partitionId()}-{made}-{digest.hexdigest()}"  # a rerun of the task gives the same names
            made += 1
            counts = np.bincount(np.concatenate(codes), minlength=len(numbers)) if numbers else np.zeros(0, np.int64)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            rows = [(name, name, i, -1, zstandard.compress(rank[c].tobytes(), 1), b"") for i, c in zip(ids, codes)]
            words = [w.encode() for w in numbers]
            to = np.array([zlib.crc32(w) % parts for w in words], np.int64)
            for p in np.unique(to):
                own = np.flatnonzero(to == p)
                rows.append((f"part-{p}", name, None, int(p), _pack([words[j] for j in own]), zstandard.compress(rank[own].tobytes(), 1)))
            numbers, ids, codes, chars, digest = {}, [], [], 0, hashlib.md5()
            for at in range(0, len(rows), 256):
                cols = list(zip(*rows[at : at + 256]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], id_type), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.binary())],
                    ["place", "block", "doc_id", "part", "data", "codes"],
                )

        for b in batches:
            id_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                found: list[str] = []
                for c in text_chunks(text):
                    if (ws := chunk_words.get(c)) is None:
                        ws = tuple(find(c))
                        if len(chunk_words) >= REMEMBERED:
                            chunk_words.clear()
                        chunk_words[c] = ws
                    found += ws
                codes.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), "<u4", len(found)))
                ids.append(doc)
                digest.update(f"{doc}:".encode() + hashlib.md5(text.encode()).digest())
                chars += len(text)
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield from block()
        if ids:
            yield from block()

    return docs.select("doc_id", "text").mapInArrow(run, f"place string, block string, doc_id {kind}, part int, data binary, codes binary")


_RANKS: dict[str, dict[bytes, int]] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table: a fixed vocabulary file, so its size is bounded."""
    if path not in _RANKS:
        with open(path, "rb") as f:
            _RANKS[path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _RANKS[path]


def encode_words(words: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """block, the words' codes and ids; every distinct word of a part is encoded once, up to KNOWN of them.

    ``words``: rows of explode_words, all of one part in one partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        ids_of = lambda w: np.array(enc.encode_ordinary(w.decode()), "<u4").tobytes()
        known = Remembered(ids_of, KNOWN)
        part = None
        for pdf in batches:
            out = []
            for p, data in zip(pdf["part"], pdf["data"]):
                if p != part:
                    known.clear()
                    part = p
                out.append(_pack([known[w] for w in _unpack(data)]))
            yield pd.DataFrame({"block": pdf["block"], "ids": out, "codes": pdf["codes"]})

    return words.sortWithinPartitions("part", "block").mapInPandas(run, "block string, ids binary, codes binary")


def reassemble(docs: DataFrame, encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit, by position) and decoded bytes of every document.

    ``docs`` and ``encoded`` meet by block, whose size is bounded.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(own: pa.Table, words: pa.Table) -> pa.Table:
        ranks = load_ranks(ranks_path)
        ids_of: dict[int, bytes] = {}
        for data, codes in zip(words.column("ids").to_pylist(), words.column("codes").to_pylist()):
            ids_of.update(zip(np.frombuffer(zstandard.decompress(codes), "<u4").tolist(), _unpack(data)))
        table = _token_bytes(ranks_path, ranks)
        bytes_of = {k: b"".join(table[np.frombuffer(x, "<u4")]) for k, x in ids_of.items()}
        ids_out, text_out = [], []
        for data in own.column("data").to_pylist():
            numbers = np.frombuffer(zstandard.decompress(data), "<u4").tolist()
            ids_out.append(b"".join(map(ids_of.__getitem__, numbers)))
            text_out.append(b"".join(map(bytes_of.__getitem__, numbers)))
        return pa.table([own.column("doc_id").combine_chunks(), pa.array(ids_out, pa.binary()), pa.array(text_out, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.groupBy("place").cogroup(encoded.groupBy("block")).applyInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


_TABLES: dict[str, np.ndarray] = {}


def _token_bytes(path: str, ranks: dict[bytes, int]) -> np.ndarray:
    if path not in _TABLES:
        table = np.empty(max(ranks.values()) + 1, object)
        for b, i in ranks.items():
            table[i] = b
        _TABLES[path] = table
    return _TABLES[path]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, parts: int | None = None) -> DataFrame:
    """doc_id, ids and decoded bytes of every whole text.

    ``docs``: doc_id, text; other columns are ignored. A null text is empty and
    has no ids. Null and repeated doc_ids are documents like any other; equal
    rows give equal rows. An empty table gives no rows. ``parts`` is the number
    of word partitions, by default three times that of shuffles.

    Documents and words leave in one shuffle, which both sides then read: the
    filters after it ask for the partition, so that they stay behind the shuffle
    and Spark uses it again instead of making two.
    """
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = explode_words(docs, pattern, parts or 3 * shuffles).repartition(shuffles, "place")
    encoded = encode_words(dealt.where("part >= 0 or spark_partition_id() < 0"), ranks_path, pattern)
    return reassemble(dealt.where("part < 0 or spark_partition_id() < 0"), encoded, ranks_path)


def digest(found: DataFrame, ranks_path: str) -> DataFrame:
    """Counts and digests of ids, as decimals joined by a space, and of the decoded bytes."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimals = np.array([str(i) for i in range(max(load_ranks(ranks_path).values()) + 1)], object)
        for b in batches:
            ids = [np.frombuffer(x, "<u4") for x in b.column(1).to_pylist()]
            sha = [hashlib.sha256(" ".join(decimals[x]).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha, pa.string()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in b.column(2).to_pylist()], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return found.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
