"""Preparation of a table for a classifier: fitted on the training part, applied to every part alike."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clean, encode, profile


@dataclass(frozen=True)
class Preparation:
    """What was learnt from the training part, small enough to be written as one JSON text.

    Columns filled at random name a table of donor values; ``id_`` draws from it.
    """

    numeric: dict[str, float | None]
    modes: dict[str, str | None]
    ordinal: dict[str, list[str]]
    groups: dict[str, list[str]]
    references: dict[str, str]
    methods: dict[str, str]
    donors: dict[str, clean.Donors] = field(default_factory=dict)
    id_: str | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Nulls filled, ordered categories as codes, others as dummies without their reference."""
        out = df
        for c, d in self.donors.items():
            out = d.transform(out, c, self.id_)
        out = clean.Imputer(self.modes).transform(out)
        out = out.withColumns({c: encode.ordinal(F.col(c), order) for c, order in self.ordinal.items()})
        for c, levels in self.groups.items():
            out = encode.one_hot(out, c, [v for v in levels if v != self.references[c]])
        return clean.Imputer(self.numeric).transform(out)

    def categories(self) -> list[tuple[str, int, str, bool]]:
        """feature, code, level, is_reference: code 0 is the reference, members follow in order."""
        rows = []
        for c, levels in self.groups.items():
            members = [v for v in levels if v != self.references[c]]
            rows += [(c, 0, self.references[c], True)] + [(c, i, v, False) for i, v in enumerate(members, 1)]
        return rows

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def from_json(text: str) -> Preparation:
    """A preparation from its JSON, which may also lie under ``preprocessing`` or ``metadata``."""
    d = json.loads(text)
    for key in ("preprocessing", "metadata"):
        d = d.get(key, d)
    return Preparation(**{**d, "donors": {c: clean.Donors(**x) for c, x in d.get("donors", {}).items()}})


def _fills(df: DataFrame, numeric: list[str], categories: list[str], method: str, category_method: str, id_: str | None) -> dict[str, dict]:
    """The values that fill nulls, learnt from ``df``: the fields numeric, modes, donors and methods of a preparation."""
    if "random" in (method, category_method) and id_ is None:
        raise ValueError("random imputation draws by an id: name its column")
    at_random = [*(numeric if method == "random" else []), *(categories if category_method == "random" else [])]
    values = {} if method == "random" else clean.fit_median(df, numeric).values if method == "median" else clean.fit_zeros(numeric).values
    if bare := [c for c, v in values.items() if v is None]:
        values |= clean.fit_mode(df, bare).values
    modes = {} if category_method == "random" else clean.fit_mode(df, categories).values
    methods = {c: method for c in numeric} | {c: category_method for c in categories}
    return {"numeric": values, "modes": modes, "donors": {c: clean.fit_random(df, c) for c in at_random}, "methods": methods}


def fit(
    train: DataFrame, numeric: list[str], ordinal: dict[str, list[str]], nominal: list[str], method: str = "median", reference: str = "alphabetical",
    chosen: dict[str, str] | None = None, category_method: str = "mode", id_: str | None = None,
) -> Preparation:
    """Fill values, orders, levels and references, all from ``train``.

    ``method`` fills numbers: median, zero or random; ``category_method``
    categories: mode or random. A random fill takes a value of the training part
    drawn by ``id_``. Levels that an order does not list follow it, sorted.
    ``chosen`` names references by hand; a column with one level has none of its
    own choice.
    """
    orders = {c: encode.with_unlisted(o, encode.levels(train, c)) for c, o in ordinal.items()}
    levels = {c: encode.levels(train, c) for c in nominal}
    table = encode.reference_level(train, nominal, reference, chosen).where("is_reference").collect() if nominal else []
    fills = _fills(train, numeric, [*ordinal, *nominal], method, category_method, id_)
    return Preparation(ordinal=orders, groups=levels, references={r["feature"]: r["level"] for r in table}, id_=id_, **fills)


def own_values(fitted: Preparation, df: DataFrame) -> Preparation:
    """``fitted`` with the fill values of ``df``, by the same methods; orders, levels and references stay."""
    categories = [*fitted.ordinal, *fitted.groups]
    numeric = [c for c in fitted.methods if c not in categories]
    one = lambda cols, default: next((fitted.methods[c] for c in cols), default)
    return replace(fitted, **_fills(df, numeric, categories, one(numeric, "median"), one(categories, "mode"), fitted.id_))


def prepare_by_own(splits: dict[str, DataFrame], fitted: Preparation) -> dict[str, DataFrame]:
    """Like :func:`prepare`, but nulls of each part are filled by values of that part."""
    out = {s: own_values(fitted, d).transform(d) for s, d in splits.items()}
    check_parity(out)
    return out


def prepare(splits: dict[str, DataFrame], fitted: Preparation) -> dict[str, DataFrame]:
    """Every part transformed; parts whose columns differ are an error that lists the differences."""
    out = {s: fitted.transform(d) for s, d in splits.items()}
    check_parity(out)
    return out


def check_parity(splits: dict[str, DataFrame]) -> None:
    (first, head), *rest = splits.items()
    for name, d in rest:
        if differ := set(head.columns) ^ set(d.columns):
            raise ValueError(f"columns of {first} and {name} differ: {sorted(differ)}")


def stats(before: DataFrame, after: DataFrame, numeric: list[str]) -> DataFrame:
    """Statistics of the numeric columns before and after imputation."""
    return profile.numeric_stats(before, numeric, "before").unionByName(profile.numeric_stats(after, numeric, "after"))
