"""Embedders: texts to vectors, in Arrow batches, with the model loaded once in each Python worker."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from grainfold.operators.registry import register
from grainfold.session import ship_package

#: Model names behind short names.
MINILM, GTE_LARGE = "sentence-transformers/all-MiniLM-L6-v2", "thenlper/gte-large"

#: How many texts' vectors a worker holds at a time where only their products are asked for.
SLICE = 2048

Encode = Callable[[list[str]], np.ndarray]


class Embedder:
    """load() runs in the worker, once, and returns a function from texts to a matrix."""

    def __init__(self, load: Callable[[], Encode], dim: int | None = None):
        self.load, self.dim = load, dim

    def one(self, text: Column) -> Column:
        """A vector for each text; null counts as empty."""
        load = self.load

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for texts in parts:
                yield pd.Series(list(encode(texts.fillna("").tolist())), dtype=object)

        ship_package(SparkSession.active())
        return F.pandas_udf(run, "array<double>")(text)

    def many(self, texts: Column) -> Column:
        """The vectors of an array of texts."""
        load = self.load

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for rows in parts:
                lists = [[t or "" for t in r] if r is not None else [] for r in rows]
                flat = encode([t for r in lists for t in r])
                ends = np.cumsum([len(r) for r in lists])
                yield pd.Series([[v.tolist() for v in flat[e - len(r) : e]] for r, e in zip(lists, ends, strict=True)], dtype=object)

        ship_package(SparkSession.active())
        return F.pandas_udf(run, "array<array<double>>")(texts)


    def neighbours(self, texts: Column) -> Column:
        """The inner product of each text's vector with the next one's, of an array of texts. No vector leaves the worker."""
        load = self.load

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for rows in parts:
                yield pd.Series([d[:-1] for d in dots(encode, [texts_of(r) for r in rows])], dtype=object)

        ship_package(SparkSession.active())
        return F.pandas_udf(run, "array<double>")(texts)

    def nearness(self, query: Column, texts: Column) -> Column:
        """The inner product of the query's vector with that of each of an array of texts. No vector leaves the worker."""
        load = self.load

        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            encode = load()
            for queries, rows in parts:
                yield pd.Series(dots(encode, [texts_of(r) for r in rows], queries.fillna("").tolist()), dtype=object)

        ship_package(SparkSession.active())
        return F.pandas_udf(run, "array<double>")(query, texts)


def texts_of(row) -> list[str]:
    return [t or "" for t in row] if row is not None else []


def dots(encode: Encode, rows: list[list[str]], queries: list[str] | None = None, size: int = SLICE) -> list[np.ndarray]:
    """Of each row's texts the inner products with the row's query, or with the text behind (the last one's is worth nothing).
    Vectors of `size` texts are held at a time, however long a row is."""
    flat, lengths = [t for r in rows for t in r], [len(r) for r in rows]
    out, owner = np.zeros(len(flat)), np.repeat(np.arange(len(rows)), lengths)
    for at in range(0, len(flat), size):
        if queries is None:
            v = np.asarray(encode(flat[at : at + size + 1]), float)
            out[at : at + len(v) - 1] = np.einsum("ij,ij->i", v[:-1], v[1:])
        else:
            whose, which = np.unique(owner[at : at + size], return_inverse=True)
            v, q = (np.asarray(encode(x), float) for x in (flat[at : at + size], [queries[i] for i in whose]))
            out[at : at + len(v)] = np.einsum("ij,ij->i", v, q[which])
    return np.split(out, np.cumsum(lengths)[:-1]) if rows else []


TOKEN = re.compile("[a-z0-9]+")


@lru_cache(200_000)
def cell(token: str, dim: int) -> tuple[int, float]:
    h = int(hashlib.md5(token.encode()).hexdigest()[:7], 16)
    return h % dim, 1.0 - 2 * (h // dim % 2)


def hashing_encode(texts: list[str], dim: int) -> np.ndarray:
    """Signed counts of tokens in dim cells, at unit length. MD5, which SQL engines have, so that the vectors can be made anywhere."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts, strict=True):
        for token in TOKEN.findall(text.lower()):
            at, sign = cell(token, dim)
            row[at] += sign
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


@register("embedder", "hashing")
def hashing(dim: int = 64) -> Embedder:
    """An embedding without a model, the same everywhere."""
    return Embedder(partial(partial, hashing_encode, dim=dim), dim)


@lru_cache(2)
def transformer_encode(model: str, batch_size: int, normalize: bool) -> Encode:
    from sentence_transformers import SentenceTransformer

    return partial(SentenceTransformer(model).encode, batch_size=batch_size, normalize_embeddings=normalize, convert_to_numpy=True, show_progress_bar=False)


@register("embedder", "sentence_transformer", "minilm")
def sentence_transformer(model: str = MINILM, batch_size: int = 32, normalize: bool = True) -> Embedder:
    return Embedder(partial(transformer_encode, model, batch_size, normalize))


@register("embedder", "gte_large")
def gte_large(model: str = GTE_LARGE, batch_size: int = 16, normalize: bool = True) -> Embedder:
    return sentence_transformer(model, batch_size, normalize)


def named(model: str | None) -> Embedder:
    """The embedder of a model's name; without one, that which needs no model."""
    return sentence_transformer(model) if model else hashing()
