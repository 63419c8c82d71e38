"""Language ID: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

Training runs in numpy on the driver, on a bounded sample of labelled rows.
Averaging and the linear layer commute, so prediction needs only one score per
subword bucket and language: a table of BUCKETS x languages, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
DIM = 16
#: Bounds of the training sample: labelled rows per language, and in all.
PER_LANG, MAX_ROWS = 300, 3000
#: Bytes of a text that one pass turns into subwords; a text has as many passes as it needs.
BLOCK = 1 << 20
UNKNOWN = "und"
_SPACE = np.uint8(32)
_FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def subwords(text: str, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Buckets of the byte n-grams inside words, a space at each end included.

    Long texts go block by block; a block's n-grams start in it and may end in
    the next, so the blocks make no difference to the result.
    """
    raw = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)
    for at in range(0, len(raw), block):
        c = _FOLD[raw[at : at + block + max(SIZES) - 1]]
        space = c == _SPACE
        h = c.astype(np.uint32)
        out = []
        for n in range(2, max(SIZES) + 1):
            if len(c) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            inside = np.zeros(len(h), bool)
            for k in range(1, n - 1):
                inside |= space[k : k + len(h)]
            if n == 2:
                inside |= space[:-1] & space[1:]
            good = h[:block][~inside[:block]] if n in SIZES else h[:0]
            out.append(((good * np.uint32(0x9E3779B1)) ^ np.uint32(n)) >> np.uint32(16))
        yield np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """Scores per bucket, a temperature, and the probability below which a text is rejected."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for idx in subwords(text):
            total += np.bincount(idx, minlength=BUCKETS).astype(np.float32) @ self.table if len(idx) > BUCKETS else self.table[idx].sum(axis=0)
            n += len(idx)
        return (total / max(n, 1) + self.bias) / self.temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        """A learnt language and its probability; UNKNOWN and 0 for a text without letters."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text))
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 12, rate: float = 8.0, seed: int = 5, batch: int = 32) -> LanguageModel:
    """Stochastic gradient descent on most rows; temperature and rejection from the fifth held back."""
    langs = sorted(set(labels))
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    y = np.array([langs.index(x) for x in labels])
    bags = []
    for t in texts:
        idx = np.concatenate([np.zeros(0, np.uint32), *subwords(t)])
        keys, counts = np.unique(idx, return_counts=True)
        bags.append((keys.astype(np.int64), (counts / max(len(idx), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, learn = order[: len(y) // 5], order[len(y) // 5 :]
    weight = (len(y) / (len(langs) * np.bincount(y, minlength=len(langs)))).astype(np.float32)
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    lin, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    mean = lambda i: bags[i][1] @ emb[bags[i][0]]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        learn = rng.permutation(learn)
        for at in range(0, len(learn), batch):
            rows = learn[at : at + batch]
            x = np.array([mean(i) for i in rows])
            g = softmax(x @ lin + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= weight[y[rows]][:, None] / len(rows)
            back = g @ lin.T
            lin -= step * (x.T @ g).astype(np.float32)
            bias -= 0.1 * step * g.sum(axis=0)
            for i, d in zip(rows, back):  # keys of one row are distinct
                emb[bags[i][0]] -= step * 20 * bags[i][1][:, None] * d.astype(np.float32)
    table = (emb @ lin).astype(np.float32)
    check = held if len(held) else order
    z = np.array([bags[i][1] @ table[bags[i][0]] + bias for i in check])
    nll = lambda t: -np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean()
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=nll)
    p = softmax(z / temperature)
    sure = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    reject = min(0.5, float(np.quantile(sure, 0.005))) if len(sure) else 0.0
    return LanguageModel(langs, table, bias, temperature, reject)


def training_sample(docs: DataFrame, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS) -> tuple[list[str], list[str]]:
    """At most ``max_rows`` labelled texts, about ``per_lang`` of each language, chosen by a hash of doc_id.

    Only documents whose crc32 of the doc_id is not divisible by five take part.
    """
    labelled = docs.where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max(1, max_rows // 2)).collect()
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_lang / r["count"])])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / 1_000_000
    rows = labelled.where(draw < F.element_at(share, F.col("lang"))).select("text", "lang", F.xxhash64("doc_id", F.lit(4)).alias("o"), "doc_id")
    got = rows.orderBy("o", "doc_id").limit(max_rows).collect()
    got.sort(key=lambda r: (r["o"], r["doc_id"], r["text"]))
    return [r["text"] for r in got], [r["lang"] for r in got]


def train(docs: DataFrame) -> LanguageModel:
    return fit(*training_sample(docs))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every whole text.

    ``docs``: doc_id, text; other columns are ignored, and neither lang nor
    source nor doc_id has a part in a prediction. A text that is null or has no
    letter is ``und`` with score 0 and rejected. Repeated rows each get their
    row; an empty table gives none. Without labelled rows all texts are ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column(1).to_pylist()]
            lang, score = pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())
            out = pa.array([x[0] == UNKNOWN or x[1] < m.reject_below for x in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), lang, score, out], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without the rows whose text is rejected; columns, of whatever names, as they are.

    A null text or one without letters is rejected; repeated rows are judged
    alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([x[0] != UNKNOWN and x[1] >= m.reject_below for x in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
