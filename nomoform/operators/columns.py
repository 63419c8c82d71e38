"""Roles of columns and checks of dummy groups."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect(df: DataFrame, candidates: list[str], any_case: bool = False) -> str | None:
    """The first candidate that is a column, or null."""
    have = {c.lower(): c for c in df.columns} if any_case else {c: c for c in df.columns}
    return next((have[k] for c in candidates if (k := c.lower() if any_case else c) in have), None)


def detect_target(df: DataFrame, candidates: list[str], any_case: bool = False) -> str | None:
    """The first candidate, else the first numeric column whose non-null values are exactly 0 and 1; one aggregate."""
    found = detect(df, candidates, any_case)
    numbers = [c for c, k in df.dtypes if k not in ("string", "binary", "boolean", "date", "timestamp") and "<" not in k]
    if found or not numbers:
        return found
    row = df.agg(*[(F.bool_and(F.col(c).isin(0, 1)) & (F.min(c) == 0) & (F.max(c) == 1)).alias(c) for c in numbers]).first()
    return next((c for c in numbers if row[c]), None)


def select_features(df: DataFrame, features: list[str], target: str, ids: list[str]) -> DataFrame:
    """The features in the given order, the target, and the id candidates that exist; missing features are warned of."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        warnings.warn(f"missing features {missing}", stacklevel=2)
    wanted = [f for f in features if f in df.columns] + [target] + [i for i in ids if i in df.columns]
    return df.select(*dict.fromkeys(wanted))


def drop_roles(df: DataFrame, *roles: str | list[str] | None) -> DataFrame:
    """``df`` without the columns of the given roles; what is null or missing is ignored."""
    names = [c for r in roles if r for c in ([r] if isinstance(r, str) else r)]
    return df.drop(*names)


def scaled_dummies(df: DataFrame, cols: list[str], tol: float = 0.1) -> DataFrame:
    """feature and whether any value lies farther than ``tol`` from both 0 and 1."""
    far = lambda c: (F.abs(F.col(c)) > tol) & (F.abs(F.col(c) - 1) > tol)
    rows = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.bool_or(far(c)), F.lit(False)).alias("is_scaled")) for c in cols]
    return df.agg(F.array(*rows).alias("s")).select(F.inline("s"))


def check_groups(df: DataFrame, groups: dict[str, list[str]], tol: float = 0.1) -> DataFrame:
    """group, more_than_one, all_zero and n of each dummy group.

    Groups with fewer than two members, with unknown members or with members of
    another group are refused, and so are members that are not 0 or 1.
    """
    seen: set[str] = set()
    for g, members in groups.items():
        if len(members) < 2:
            raise ValueError(f"group {g} has fewer than two members")
        if bad := [m for m in members if m not in df.columns]:
            raise ValueError(f"group {g} has unknown members {bad}")
        if both := seen & set(members):
            raise ValueError(f"members {sorted(both)} are in two groups")
        seen |= set(members)
    row = df.agg(*[F.coalesce(F.bool_and(F.least(F.abs(F.col(m)), F.abs(F.col(m) - 1)) <= tol), F.lit(True)).alias(m) for m in sorted(seen)]).first()
    if bad := [m for m in sorted(seen) if not row[m]]:
        raise ValueError(f"members {bad} are not 0 or 1")
    total = {g: sum((F.col(m) for m in ms[1:]), F.col(ms[0])) for g, ms in groups.items()}
    rows = [
        F.struct(F.lit(g).alias("group"), F.count_if(t > 1 + tol).alias("more_than_one"), F.count_if(F.abs(t) <= tol).alias("all_zero"), F.count("*").alias("n"))
        for g, t in total.items()
    ]
    return df.agg(F.array(*rows).alias("s")).select(F.inline("s"))
