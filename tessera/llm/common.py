"""Helpers shared by the training-data operators: the shared work folder,
lineage cuts, bounded word caches for tasks and flat id-array assembly."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts are processed inside a task in slices of at most this many characters
# (one longer text forms a slice of its own), which bounds Python memory.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-process local session may do without the setting (tests); any
    other master without it is an error, because a machine-local folder would
    lose data there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"/tmp/tessera-{uuid.uuid4().hex[:12]}"
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back (column pruning
    and statistics for later joins, unlike a checkpoint)."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (base + "_" * i for i in range(1, len(taken) + 2)) if n.lower() not in taken)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, stop) ranges of ``texts`` of at most ``limit`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


class _Codes(dict):
    """word -> code; a new word gets the next code and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


class WordCodes:
    """A bounded cache word -> row of values, for work that repeats per word.

    ``compute`` turns a list of new words into (values, lengths): one flat
    array and the number of values of each word. A full cache starts again
    empty, so memory stays bounded whatever the vocabulary."""

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
                 limit: int = 400_000, dtype=np.int64):
        self.compute, self.limit = compute, limit
        self.codes = _Codes()
        self.values = np.zeros(0, dtype)
        self.starts = np.zeros(1, np.int64)

    def lookup(self, words: list[str]) -> np.ndarray:
        """Code of each word; codes index ``starts`` until the next call."""
        if len(self.codes) > self.limit:
            self.codes = _Codes()
            self.values, self.starts = self.values[:0], self.starts[:1]
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if self.codes.new:
            new, self.codes.new = self.codes.new, []
            values, lengths = self.compute(new)
            self.values = np.concatenate([self.values, values.astype(self.values.dtype, copy=False)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths, dtype=np.int64)])
        return codes

    def flat(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of a code sequence in order, and each code's number of values."""
        lengths = self.starts[codes + 1] - self.starts[codes]
        total = int(lengths.sum())
        if not total:
            return self.values[:0], lengths
        ends = np.cumsum(lengths)
        at = np.arange(total) + np.repeat(self.starts[codes] - (ends - lengths), lengths)
        return self.values[at], lengths


_held: list = []


def one_per_worker(name: str, owner, make: Callable):
    """``make()``, kept in this Python worker for later tasks of the same operator and
    owner (a model, or the bytes of one). A worker keeps one such object: the next
    operator's replaces it, so caches of a job's stages don't add up."""
    if _held and _held[0] == name and (_held[1] is owner or (isinstance(owner, bytes) and _held[1] == owner)):
        return _held[2]
    _held.clear()
    _held.extend([name, owner, make()])
    return _held[2]


def by_document(lengths: np.ndarray, words_per_doc: np.ndarray) -> np.ndarray:
    """Sum of ``lengths`` over each document's run of words."""
    ends = np.cumsum(words_per_doc)
    total = np.concatenate([[0], np.cumsum(lengths)])
    return total[ends] - total[ends - words_per_doc]


def file_bytes(path: str) -> bytes:
    with open(os.fspath(path), "rb") as f:
        return f.read()
