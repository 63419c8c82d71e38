"""The pipeline's stages, each against a brute-force version of its decision."""

import random

import public_tokenizers
import pytest

import corpus_pipeline
from nomoform.llm import langid

from .test_operators import brute_components, check_packing, texts_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs = [spark.read.parquet(f"{SF}/documents.parquet").repartition(3)]
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name)) + "/out"
        f(spark, docs[-1], SF).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def test_columns(staged):
    assert all(d.columns == corpus_pipeline.COLUMNS for d in staged[1:-1])


def test_rejected_languages_go(spark, staged):
    model = langid.train(staged[0])
    want = [d for d, t in texts_of(staged[0]) if (p := model.predict(t))[0] != "und" and p[1] >= model.reject_below]
    assert sorted(d for d, _ in texts_of(staged[1])) == sorted(want) and len(want) > 0.95 * staged[0].count()


def test_line_dedup_only_removes_lines(staged):
    before, after = dict(texts_of(staged[1])), dict(texts_of(staged[2]))
    assert set(after) <= set(before)
    for d, t in after.items():
        lines = iter(before[d].split("\n"))
        assert t == "" or all(x in lines for x in t.split("\n"))


def test_one_of_each_group_stays(staged):
    groups = brute_components(texts_of(staged[2]))
    assert sorted(d for d, _ in texts_of(staged[3])) == sorted(d for d, (_, c) in groups.items() if d == c)


def test_secrets_are_gone(staged):
    import re

    for _, t in texts_of(staged[4]):
        assert not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", t)
    assert staged[4].count() == staged[3].count()


def test_packing(staged):
    assert check_packing(texts_of(staged[4]), staged[5].collect()) > 0.98
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_one_of_each_group_stays_whatever_the_ids(spark):
    texts = [" ".join(f"w{(7 * k + i) % 97 + 100 * k}" for i in range(60)) for k in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[3].upper()), (None, texts[2]), (1, texts[4]), (1, texts[5])]
    rows = [(d, t, lang, "s", len(t)) for d, t in rows for lang in ("en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (1, texts[4]), (1, texts[5])], key=repr)


def brute_passages(rows):
    """doc_id -> text without the runs of two or more worded lines seen before; rows with unique ids."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        lines = (t or "").split("\n")
        worded, gone = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")], set()
        for a, b in zip(worded, worded[1:]):
            if (body := tuple(lines[a : b + 1])) in seen:
                gone.update(range(a, b + 1))
            seen.add(body)
        out[d] = (t, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return {d: kept if n else t for d, (t, kept, n) in out.items() if not n or kept.strip(" \t\n\v\f\r")}


def test_all_repeated_passages_go(staged):
    want = brute_passages(texts_of(staged[1]))
    assert dict(texts_of(staged[2])) == want and want != dict(texts_of(staged[1]))


def test_passages_of_any_place_and_id_go(spark):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(25)] + ["", " \t"]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for d in range(150)] + [(900, None), (901, "a\na\na\na")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    run = lambda rs: texts_of(corpus_pipeline.line_dedup(spark, spark.createDataFrame([(*r, None, None, 0) for r in rs], schema).repartition(3), SF))
    got = run(rows)
    assert dict(got) == brute_passages(rows) and len(got) == len(dict(got))
    body = "one a\ntwo b\nthree c"
    got = sorted(t for _, t in run([(None, body + "\nend x"), (None, body + "\nend y"), (None, "own p\nown q\nown r")]))
    own = "own p\nown q\nown r"
    assert got in (sorted([body + "\nend x", "end y", own]), sorted(["end x", body + "\nend y", own]))


def test_chunks_find_most_passages_and_windows_the_rest(spark, monkeypatch):
    """The pipeline's line dedup goes through content-defined chunks; the windows pass sees no window of a chunk that goes."""
    from nomoform.llm import linededup

    seen = []
    inner = linededup.repeated

    def spied(units, at, known=None):
        out = inner(units, at, known).persist()
        seen.append((known is not None, out.count()))
        return out

    monkeypatch.setattr(linededup, "repeated", spied)
    body = "\n".join(f"line {i} of one text" for i in range(40))
    rows = [(d, f"own line {d}\n{body}\nlast {d}", None, None, 0) for d in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(texts_of(corpus_pipeline.line_dedup(spark, docs, SF)))
    assert got == brute_passages([r[:2] for r in rows])
    (first, by_chunk), (second, by_window) = seen
    assert not first and second and by_chunk > 5 * by_window
