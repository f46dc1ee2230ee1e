"""Sentence splitters by name: text -> array of sentences."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from grainfold.functions import text as T
from grainfold.operators.registry import register
from grainfold.session import ship_package


@register("splitter", "regex")
def by_pattern() -> Callable[[Column], Column]:
    return T.sentences


def trained_split(text: str) -> list[str]:
    from nltk.tokenize import sent_tokenize

    return sent_tokenize(text)


@register("splitter", "nltk")
def by_model(split: Callable[[str], list[str]] = trained_split) -> Callable[[Column], Column]:
    """A trained splitter in the worker; blank sentences are dropped."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[s.strip() for s in split(t or "") if s.strip()] for t in texts], dtype=object)

    def sentences(text: Column) -> Column:
        ship_package(SparkSession.active())
        return F.pandas_udf(run, "array<string>")(text)

    return sentences
