"""Whitening, collocations and the n-gram join against brute force and edge cases."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nomoform.llm import collocations, ngramjoin, queries, sql, whitening

SF = "/root/testdata/sf0.001"


# -- embedding whitening


def check_whitened(vectors, rows, axes=8):
    """Rows of the digest against exact integers and numpy; ``vectors``: usable (key, list)."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(col) for col in zip(*x)]
    dev = Counter((k, sum((n * a - b) ** 2 for a, b in zip(row, s))) for (k, _), row in zip(vectors, x))
    k = min(axes, d)
    assert Counter((r["vec_id"], r["deviation"]) for r in rows if r["component"] == 1) == dev
    assert len(rows) == k * n and all(r["n"] == n for r in rows)
    cov = [[float(sum(Fraction((n * r[i] - s[i]) * (n * r[j] - s[j])) for r in x) / n**3) for j in range(d)] for i in range(d)] if n * d * d < 300_000 else np.cov(np.array(x, float).T, bias=True)
    e = np.linalg.eigvalsh(np.array(cov))[::-1]
    for c in range(1, k + 1):
        own = [r for r in rows if r["component"] == c]
        assert all(abs(r["explained"] - e[c - 1] / e.sum()) <= 1e-4 * abs(r["explained"]) for r in own)
        assert abs(sum(r["whitened"] ** 2 for r in own) / n - 1) < 1e-6 and abs(sum(r["whitened"] for r in own)) < 1e-6 * n
    assert all(0 <= r["identity_error"] <= 1e-4 for r in rows)


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitened([(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()], queries.op11_embedding_whitening(spark, SF).collect())


def test_squares_of_pairs_are_exact():
    rng = random.Random(2)
    for most in (50, 1 << 19, 1 << 24, 1 << 61):
        z = np.array([[rng.randrange(-most, most) for _ in range(4)] for _ in range(50)])
        for i, own in enumerate(whitening.pair_squares(z)):
            for j, v in zip(range(i, 4), own):
                assert int(v) == sum((int(a) + int(b) * (i != j)) ** 2 for a, b in zip(z[:, i], z[:, j]))
    big = np.array([(1 << 126) + 5, 0, 1 << 40], object)
    assert [sum(limb[i] << (40 * k) for k, limb in enumerate(whitening._limbs(big))) for i in range(3)] == list(big)


def test_whitening_of_odd_vectors(spark):
    rng = random.Random(4)
    good = [(i if i % 7 else None, [rng.gauss(0, 1), rng.gauss(5, 2), rng.gauss(0, 9000)]) for i in range(60)] + [(3, [1.0, 2.0, 3.0])] * 5
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (None, None)]
    rows = spark.createDataFrame([(k, v, "x", 1, 2) for k, v in good + odd], "vec_id long, embedding array<double>, l0 string, n int, component int").repartition(5)
    got = whitening.digest(whitening.whiten(rows)).collect()
    check_whitened(good, got, 3)


def test_whitening_without_variance_or_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.digest(whitening.whiten(make([]))).collect() == [] and whitening.whiten(make([(1, None)])).count() == 0
    assert whitening.digest(whitening.whiten(make([]))).columns == whitening.digest(whitening.whiten(make([(1, [1.0])]))).columns
    same = whitening.digest(whitening.whiten(make([(1, [0.5, 0.25]), (2, [0.5, 0.25])]))).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in same)
    line = whitening.digest(whitening.whiten(make([(i, [i / 8, i / 4]) for i in range(9)]))).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and max(r["identity_error"] for r in line) < 1e-9


def test_whitening_of_huge_entries(spark):
    rows = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(rows).collect()
    assert len(got) == 6 and all(r["deviation"] > 2**120 for r in got if r["vec_id"] < 3)
    assert all(r["deviation"] is None for r in whitening.digest(whitening.whiten(rows)).collect() if r["vec_id"] < 3)


# -- collocations


def brute_collocations(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang, t = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\n\x0b\x0c\r":
            t = t.replace(mark, "\n")
        for piece in t.split("\n"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        ok = {p: a for p, a in counts.items() if a >= least}
        gone = {p[i : i + k] for p, a in ok.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * counts[p[i : i + k]]}
        own = []
        for p, a in ok.items():
            if len(p) > 1 and p not in gone:
                score, k = min((1000 * a * n[lang] // (ok[p[:k]] * ok[p[k:]]), k) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), ok[p[:k]], ok[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l_, r, n[lang], -s) for i, (s, a, p, l_, r) in enumerate(sorted(own)[:top])]
    return sorted(out)


def zipf_rows(seed, docs, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = [chr(97 + i % 26) + "é" * (i % 3) + str(i) for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    idioms = [" ".join(rng.choices(words, k=rng.randrange(2, 8))) for _ in range(12)]
    rows = []
    for _ in range(docs):
        parts = [rng.choice(idioms) if rng.random() < 0.4 else rng.choices(words, weights)[0] + rng.choice(["", "", ",", ".", "!\n", "\t", "  "]) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(langs), " ".join(parts).upper() if rng.random() < 0.2 else " ".join(parts)))
    return rows


@pytest.mark.parametrize("least,top,share", [(3, 25, 2), (5, 3, 50)])
def test_collocations_against_brute_force(spark, monkeypatch, least, top, share):
    monkeypatch.setattr(collocations, "LEAST", least)
    monkeypatch.setattr(collocations, "SHARE", share)
    rows = zipf_rows(least + top, 150)
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, text string, p int").repartition(4)
    got = sorted(map(tuple, collocations.collocations(docs, top).collect()))
    assert got == brute_collocations(rows, least, top) and got


def test_collocations_prune(spark, monkeypatch):
    """With few wanted phrases, a word whose bound is too low is never expanded, and the result is the same."""
    monkeypatch.setattr(collocations, "LEAST", 4)
    rows = [("en", "the " * 30 + f"rare{i % 5} pair{i % 5}" if i % 2 else f"rare{i % 5} pair{i % 5} " + "the " * 30) for i in range(40)]
    words = []
    frontier = collocations.frontier

    def watched(*a):
        nodes = frontier(*a)
        words.append(nodes.where(F.size("g") == 1).count())
        return nodes

    monkeypatch.setattr(collocations, "frontier", watched)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, 3).collect())) == brute_collocations(rows, 4, 3)
    assert sum(words) == 10


def test_collocations_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST", 3)
    rows = [("en", None), (None, None), ("en", ""), ("de", "..\n"), (None, "a b " * 4000), ("en", "x\x00y z w " * 5), ("en", "Ab cD, ab CD"), ("en", "ab cd")] + [("fr", "le la les")] * 9
    docs = spark.createDataFrame([(*r, "q", None) for r in rows], "lang string, text string, g string, word int")
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == brute_collocations(rows, 3, 2000)
    empty = collocations.collocations(docs.limit(0))
    assert empty.collect() == [] and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_reseed_when_hashes_clash(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST", 2)
    real = collocations._word_hash
    clash = {b"a": 7, b"b": 7}
    docs = spark.createDataFrame([("en", "a c b c a c b c")] * 3, "lang string, text string")
    texts = docs.select("lang", F.col("text").cast("binary").alias("text"))
    # the tasks import the module afresh, so the clash is made in their counts
    counts = collocations.word_counts
    monkeypatch.setattr(collocations, "word_counts", lambda t, seed: counts(t, seed).withColumn("h", F.when((F.lit(seed) == 0) & F.col("word").isin("a", "b"), F.lit(clash[b"a"]).cast("long")).otherwise(F.col("h"))))
    assert collocations.frequent_words(texts)[2] == 1 and real(b"a", 0) != real(b"b", 0)


def test_collocations_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got = sorted(map(tuple, queries.op12_phrase_collocations(spark, SF).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == sorted(con.execute(sql.COLLOCATIONS).fetchall())


# -- n-gram Jaccard join


def brute_join(rows, similarity=90):
    """Sorted (doc_id, n_shingles, component_id) of rows; equal ids are different rows."""
    sets = []
    for _, t in rows:
        ws = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        sets.append(frozenset(zip(ws, ws[1:], ws[2:])) if len(ws) > 2 else frozenset([tuple(ws)] if ws else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x]).items():
            if 100 * n >= similarity * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            where[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def joined(df, **kw):
    return sorted(map(tuple, ngramjoin.ngram_join(df, **kw).collect()), key=str)


def test_join_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, queries.op13_ngram_jaccard_join(spark, SF).collect()), key=str)
    assert got == brute_join([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])


def edited_rows(seed, bases, copies, words, most):
    rng = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, words))]
        for _ in range(copies):
            t = base[:]
            for _ in range(rng.randrange(most)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = [f"x{rng.randrange(30)}"] * rng.randrange(2)
            rows.append((len(rows) * 3, " ".join(t)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1 << 21, 4000, 900])
def test_join_of_edited_copies(spark, block):
    rows = edited_rows(block, 12, 30, 150, 14)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert joined(df, block=block) == brute_join(rows)


def test_join_at_other_similarities(spark):
    rows = edited_rows(3, 10, 12, 60, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for similarity in (80, 97, 100):
        assert joined(df, similarity=similarity) == brute_join(rows, similarity)


def test_linked_sets_share_a_key():
    """At the very edge of the similarity, for sets of all sizes, across classes and with shingles that fall together."""
    rng = np.random.default_rng(1)
    for similarity in (75, 90, 95):
        for a in [*range(1, 60), 99, 100, 138, 139, 140, 500, 1000, 3333]:
            for spread in (64, 50):
                base = rng.integers(0, 1 << spread, 2 * a + 10, dtype=np.uint64)
                for _ in range(4):
                    gone = rng.integers(0, a * (100 - similarity) // similarity + 1)
                    more = 0
                    while 100 * (a - gone) >= similarity * (a + more + 1):
                        more += 1
                    x, y = np.unique(base[:a]), np.unique(np.r_[base[gone:a], base[a : a + more]])
                    both = len(np.intersect1d(x, y))
                    if 100 * both >= similarity * (len(x) + len(y) - both) and not np.array_equal(x, y):
                        assert len(np.intersect1d(ngramjoin.range_keys(x, similarity), ngramjoin.range_keys(y, similarity)))


def test_tree_bounds_admit_all_links():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        for _ in range(15):
            sets.append(np.unique(np.where(rng.random(300) < rng.choice([0.01, 0.04, 0.1]), rng.integers(0, 1 << 63, 300, dtype=np.uint64), base)))
    order = rng.permutation(len(sets))
    sets = [sets[i] for i in order]
    tree = ngramjoin.SignatureTree(sets)
    want = [(i, j) for i in range(len(sets)) for j in range(i) if tree.linked(i, j, 90)]
    i, j = (np.array(x) for x in zip(*want))
    for level in range(len(tree.levels)):
        assert tree.may_link(level, i // 8**level, j // 8**level, 90).all()
    root = list(range(len(sets)))
    for a, b in want:
        ra, rb = root[a], root[b]
        root = [ra if r == rb else r for r in root]
    got = list(range(len(sets)))
    for a, b in tree.links(np.arange(len(sets)), None):
        ra, rb = got[a], got[b]
        got = [ra if r == rb else r for r in got]
    same = lambda r: {tuple(i for i in range(len(r)) if r[i] == x) for x in set(r)}
    assert same(root) == same(got)


def test_join_of_odd_rows(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [None, "", " \n", "x", "X", "ab cd", "cd ab", "É è ü 漢字 end", line, line.upper() + "\n", "word " * 60_000, "word word word", "a" * 5000, "same words here " * 40]
    rows = list(enumerate(texts)) + [(8, line), (None, line), (None, "nobody knows this"), (None, None), (2**53 + 1, "nobody knows that"), (-4, "X")]
    schema = "doc_id long, text string, t int, id string, n string, keys int, h string, family int, label string, task string, shingles int, first int, node int, root string"
    df = spark.createDataFrame([(*r, *[None] * 12) for r in rows], schema).repartition(3)
    assert joined(df) == brute_join(rows)
    assert joined(df.limit(0)) == []
