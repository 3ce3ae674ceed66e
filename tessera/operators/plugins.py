"""Plug-in models (X1): embedders, text scorers, pair scorers and generators.

A plug-in is a factory: called without arguments inside a Python worker, it loads
a model and returns a function over a batch (a list of texts). It is loaded once
per worker and name, not per row or batch, and gets Arrow batches. Each protocol
comes as a column function (an iterator UDF, usable in any projection, as the
scorer of ``rerank`` or as a guard's scanner column); a precomputed table joined
by id does instead of a model wherever a column is asked for.

A null text is passed to no model and gives null."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: texts -> one vector, score or text each; (queries, documents) -> one score each
Embedder = Callable[[], Callable[[list[str]], np.ndarray]]
TextScorer = Callable[[], Callable[[list[str]], Sequence[float]]]
PairScorer = Callable[[], Callable[[list[str], list[str]], Sequence[float]]]
Generator = Callable[[], Callable[[list[str]], Sequence[str]]]

_loaded: dict = {}


def _model(name: str, factory):
    """The plug-in's model, loaded once in this Python worker."""
    if name not in _loaded:
        _loaded[name] = factory()
    return _loaded[name]


def _applied(name: str, factory, kind: T.DataType, pack):
    """A function of text columns that applies the model to the rows without nulls."""
    def run(batches: Iterator) -> Iterator[pd.Series]:
        model = _model(name, factory)
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            there = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
            out = pd.Series([None] * len(columns[0]), dtype=object)
            if there.any():
                got = model(*[c[there].tolist() for c in columns])
                if len(got) != there.sum():
                    raise ValueError(f"plug-in {name!r} returned {len(got)} results for {there.sum()} rows")
                out[there] = pd.Series(list(map(pack, got)), index=out.index[there], dtype=object)
            yield out
    return run


def embedder(name: str, factory: Embedder) -> Callable[[Column], Column]:
    """texts -> array<double>"""
    run = _applied(name, factory, T.ArrayType(T.DoubleType()), lambda v: [float(x) for x in v])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)
    return embed


def text_scorer(name: str, factory: TextScorer) -> Callable[[Column], Column]:
    """texts -> double"""
    run = _applied(name, factory, T.DoubleType(), float)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for out in run(batches):
            yield out.astype("float64")
    return score


def pair_scorer(name: str, factory: PairScorer) -> Callable[[Column, Column], Column]:
    """(queries, documents) -> double; fits ``rerank(scorer=...)``"""
    run = _applied(name, factory, T.DoubleType(), float)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for out in run(batches):
            yield out.astype("float64")
    return score


def generator(name: str, factory: Generator) -> Callable[[Column], Column]:
    """prompts -> string"""
    run = _applied(name, factory, T.StringType(), str)

    @F.pandas_udf(T.StringType())
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)
    return generate
