"""Null, repeated and very large ids: rows keep them, and each row keeps its own text's result."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nomoform.llm import packing, quality, suffixdedup

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_keeps_ids_beside_null_ones(spark):
    big = 2**53
    rows = [(None, "first of none"), (big + 1, "one two"), (big + 3, "three"), (None, "second of none " * 900), (big + 3, "another three"), (5, None), (None, None), (-(big + 1), "")]
    t = Tokenizer.from_file(VOCAB)
    want = Counter((d, tuple(t.encode(x or "", add_special_tokens=False).ids) + (0,)) for d, x in rows)
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), VOCAB).collect()
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(d for d, _ in rows)
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) for r in got)
    cut = Counter()
    for (d, ids), times in want.items():
        at = 0
        for n in packing.cuts(len(ids)):
            cut[d, at, n, len(ids), zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += times
            at += n
    assert pieces == cut
    for seq in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == seq), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_suffix_dedup_of_shared_and_missing_ids(spark):
    """Texts that share an id, or have none, are documents of their own, by hash; equal rows are one."""
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdef ", k=260)) for _ in range(6)]
    rows = [(rng.choice([None, 1, 2, 7]), base[rng.randrange(6)][rng.randrange(60) :] + rng.choice(["", "tail", base[rng.randrange(6)][: rng.randrange(200)]])) for _ in range(60)]
    rows += [(None, base[0]), (None, base[0]), (7, base[1]), (7, base[1]), (3, base[2]), (None, None), (9, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2")).collect()
    order = sorted({(suffixdedup.NO_ID if r["doc_id"] is None else r["doc_id"], r["t1"], r["t2"], r["text"]) for r in hashes})
    seen, want = set(), {}
    for d, _, _, text in order:
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        want[None if d == suffixdedup.NO_ID else d, text] = bytes(b for b, g in zip(raw, gone) if not g)
    got = Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in suffixdedup.suffix_dedup(df).collect())
    assert got == Counter((d, len((t or "").encode()), want[d, t or ""]) for d, t in rows)


def test_suffix_slices_are_linear_in_rows_without_id(spark):
    """Each text without an id is cut by its own segments only."""
    rng = random.Random(9)
    common = "".join(rng.choices("abcdefgh", k=150))
    counts = []
    for n in (40, 80):
        rows = spark.createDataFrame([(None, f"{i} " + "".join(rng.choices("abcdefgh", k=60)) + common + "".join(rng.choices("abcdefgh", k=60))) for i in range(n)], "doc_id long, text string")
        _, texts = suffixdedup.numbered(rows.select(F.lit(suffixdedup.NO_ID).alias("doc"), "text"))
        both = suffixdedup.collapse(suffixdedup.find_segments(texts))
        counts.append(suffixdedup.cut_out(texts, both.where("key <> -1")).count())
    assert counts[1] <= 3 * counts[0]


def test_quality_fences_follow_their_group(spark):
    """Two groups with other habits get other fences, and a text that is usual in one is dropped in the other."""
    plain = "one two three four five six seven eight nine ten eleven twelve"
    marked = plain + " # $ %"
    tail = lambda i: "y" * (1 + i % 9) + f" z{i}"
    rows = [(i, f"{plain} {tail(i)}", "en", "plain") for i in range(100)]
    rows += [(200 + i, f"{marked if i % 2 else plain} {tail(i)}", "en", "code") for i in range(100)]
    rows += [(400, f"{marked} {tail(5)}", "en", "plain"), (401, f"{marked} {tail(5)}", "en", "code"), (402, "Donaudampfschifffahrtsgesellschaften " * 3 + " ".join(f"Rindfleischetikettierung{i}" for i in range(9)), "en", "plain")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in [*range(100), *range(200, 300), 401]) and not got[400] and not got[402]
    fences = {(r["lang"], r["source"]): r for r in quality.thresholds(quality.sketches(_judged(spark, rows))).collect()}
    assert fences["=en", "=plain"]["symbols_pm_hi"] < 100 < fences["=en", "=code"]["symbols_pm_hi"]


def _judged(spark, rows):
    counts = quality.base_metrics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).withColumn("base_failed", F.lit(False))
    return counts.withColumns({"symbols_pm": quality._per("n_symbols", "n_words", 1000), "dup_lines_pm": F.lit(0).cast("long"), "repeats_pm": F.lit(0).cast("long"), "word_len_c": quality._per("word_chars", "n_words", 100)})
