"""The scoring contract: whatever adds p, the probability of 1, to a frame that holds the features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encode import expand


@dataclass(frozen=True)
class FrameScorer:
    """``add`` gives a frame back with p; it keeps all other columns."""

    add: Callable[[DataFrame], DataFrame]


def with_probability(model, df: DataFrame) -> DataFrame:
    """``df`` with p from a fitted pipeline whose last stage is a binary classifier."""
    out = model.transform(df).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
    return out.select(*df.columns, "p")


def with_callable(df: DataFrame, features: list[str], predict) -> DataFrame:
    """p from any ``predict(frame) -> array``, in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(np.asarray(predict(x), float))

    return df.withColumn("p", run(F.struct(*features)))


def model_scorer(model) -> FrameScorer:
    """A fitted MLlib pipeline."""
    return FrameScorer(lambda df: with_probability(model, df))


def function_scorer(features: list[str], predict) -> FrameScorer:
    """A Python function of a frame of the features."""
    return FrameScorer(lambda df: with_callable(df, features, predict))


def column_scorer(features: list[str], score: Callable[[dict[str, Column]], Column]) -> FrameScorer:
    """A closed-form Column."""
    return FrameScorer(lambda df: df.withColumn("p", score({f: F.col(f) for f in features})))


def with_dummies(scorer: FrameScorer, groups: dict[str, list[str]]) -> FrameScorer:
    """A scorer of dummies as one of codes: code k sets the k-th dummy of a group, code 0 none."""

    def add(df: DataFrame) -> DataFrame:
        names = {n: c for g, members in groups.items() for n, c in expand(F.col(g), members).items()}
        return scorer.add(df.withColumns(names)).select(*df.columns, "p")

    return FrameScorer(add)


def labels(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``df`` with label: 1 from the threshold on, as a classifier's prediction."""
    return df.withColumn("label", (F.col("p") >= threshold).cast("int"))
