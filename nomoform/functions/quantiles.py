"""Exact percentiles of columns of any size, without all values of a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values around a wanted rank that the driver takes, and the relative error of the sketches that find them.
KEEP, ERROR = 100_000, 0.001
#: Up to so many values a bracket is the whole column, as a sketch's slack is less than a few ranks.
SHORT = 5_000


def _interval(df: DataFrame, col: str, q: float, n: int) -> tuple[float, float]:
    """Values between which the ranks around ``q`` lie for certain."""
    slack = 2 * ERROR + 2 / max(n, 1)
    return tuple(df.approxQuantile(col, [max(0.0, q - slack), min(1.0, q + slack)], ERROR))


def exact_percentiles(df: DataFrame, cols: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """The percentiles ``qs`` of every column, interpolated linearly; null for a column without values.

    One pass of mergeable sketches brackets each rank, a second counts what is
    below the brackets, a third counts each distinct value inside them. A bracket
    with more than KEEP rows is narrowed by a sketch of its own rows first.
    Nulls and NaN do not count.
    """
    x = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    names, tries = x.columns, sorted({0.0, 1.0, *(min(1.0, max(0.0, q + d * ERROR)) for q in qs for d in (-2, 2))})
    sketch = x.approxQuantile(names, tries, ERROR)
    at = {t: k for k, t in enumerate(tries)}
    box = {
        (c, q): (sketch[k][at[max(0.0, q - 2 * ERROR)]], sketch[k][at[min(1.0, q + 2 * ERROR)]])
        for k, c in enumerate(names) if sketch[k] for q in qs
    }
    if not box:
        return {c: [None] * len(qs) for c in cols}

    def count() -> dict:
        ask = [F.count_if(F.col(c).isNotNull() & ~F.isnan(c)).alias(f"{c}:n") for c in {c for c, _ in box}]
        for k, ((c, _), (a, b)) in enumerate(box.items()):
            ask += [F.count_if(F.col(c) < a).alias(f"below{k}"), F.count_if(F.col(c).between(a, b)).alias(f"in{k}")]
        return x.agg(*ask).first().asDict()

    counts = count()
    short = {key: (sketch[names.index(key[0])][0], sketch[names.index(key[0])][-1]) for key in box if counts[f"{key[0]}:n"] <= SHORT}
    if short:
        box |= short
        counts = count()
    for _ in range(8):
        wide = [(key, ends) for k, (key, ends) in enumerate(box.items()) if counts[f"in{k}"] > KEEP and ends[0] < ends[1]]
        moved = False
        for (c, q), (a, b) in wide:
            k = list(box).index((c, q))
            inside = (q * (counts[f"{c}:n"] - 1) - counts[f"below{k}"]) / max(1, counts[f"in{k}"] - 1)
            new = _interval(x.where(F.col(c).between(a, b)), c, min(1.0, max(0.0, inside)), counts[f"in{k}"])
            moved = moved or new != (a, b)
            box[c, q] = new
        if not moved:
            break
        counts = count()
    rows = x.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col(c).between(a, b), F.col(c)).alias("v")) for k, ((c, _), (a, b)) in enumerate(box.items())])))
    found: dict[int, list] = {}
    for r in rows.where("v is not null").groupBy("k", "v").count().collect():
        found.setdefault(r["k"], []).append((r["v"], r["count"]))

    def value(k: int, rank: int) -> float:
        at = counts[f"below{k}"]
        for v, n in sorted(found[k]):
            at += n
            if rank < at:
                return v
        raise ArithmeticError("a rank lies outside its bracket")

    out: dict[str, list[float | None]] = {}
    for c, name in zip(cols, names):
        out[c] = []
        for q in qs:
            if (name, q) not in box:
                out[c].append(None)
                continue
            k, pos = list(box).index((name, q)), q * (counts[f"{name}:n"] - 1)
            lo, hi = value(k, math.floor(pos)), value(k, math.ceil(pos))
            out[c].append(lo + (hi - lo) * (pos - math.floor(pos)))
    return out
