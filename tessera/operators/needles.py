"""Needle and rule tables (J7, V1, F2): any number of needles, one pass per text and block of needles.

A table of needles is dealt into blocks of about ``BLOCK`` needles by their hash;
each block is compiled into an Aho-Corasick automaton once per Python worker and
finds all of its needles in one linear pass over a text, instead of one search
per needle. Only a block (whose size is bounded) is on the driver or broadcast
at a time; more needles mean more blocks, and so more passes over the texts.

In ``word`` mode a needle of word characters only is found exactly where it is a
whole run of them. More than ``BLOCK`` such needles are joined with the runs of
the texts instead: one pass, however many there are, and nothing on the driver.

Texts and needles are compared in lower case. ``word`` mode takes a needle only
where neither neighbour is a letter, a digit or an underscore. Empty and null
needles hit nothing; a null text has no hits."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.filters import PART_FIELDS
from tessera.session import materialize

#: Needles of an automaton, and characters of a needle block at most (about).
BLOCK, MODES = 200_000, ("substring", "word")
#: Characters of texts whose runs are gathered at a time (about).
RUN_CHARS = 20_000_000

_RUN = re.compile(r"\w+")  # the characters of ``_word``

_held: dict = {}


def _automaton(shipped):
    """The automaton of a broadcast block, kept in this Python worker for its later tasks (one at a time)."""
    if _held.get("of") is not shipped.value:
        a = ahocorasick.Automaton()
        for i, needle in enumerate(shipped.value):
            a.add_word(needle, (i, len(needle)))
        if len(a):
            a.make_automaton()
        _held.update(of=shipped.value, automaton=a)
    return _held["automaton"]


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def found_in(automaton, text: str, mode: str) -> list[int]:
    """The distinct needles of an automaton in a text, in order."""
    if not len(automaton) or not text:
        return []
    if mode == "substring":
        return sorted({i for _, (i, _) in automaton.iter(text)})
    n, out = len(text), set()
    for end, (i, size) in automaton.iter(text):
        start = end - size + 1
        if i not in out and not (start and _word(text[start - 1])) and not (end + 1 < n and _word(text[end + 1])):
            out.add(i)
    return sorted(out)


def lowered(needles: DataFrame, needle_col: str = "needle") -> DataFrame:
    """needle, run: the distinct lower-case needles, and whether one is a single run of word characters."""
    low = needles.select(F.lower(F.col(needle_col)).alias("needle")).where("needle <> ''").distinct()

    def mark(batches):
        for batch in batches:
            run = [_RUN.fullmatch(n) is not None for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(run, pa.bool_())], ["needle", "run"])

    return materialize(low.mapInArrow(mark, "needle string, run boolean"), "needles")


def blocks(low: DataFrame):
    """Lists of the needles of ``lowered``, each of about ``BLOCK``."""
    count = max(1, -(-low.count() // BLOCK))
    for b in range(count):
        some = low if count == 1 else low.where(F.pmod(F.xxhash64("needle"), F.lit(count)) == b)
        yield sorted(r["needle"] for r in some.select("needle").collect())


def _run_hits(rows: DataFrame, low: DataFrame, out: T.StructType) -> DataFrame:
    """(_id, needle) for needles that are runs: each run of some texts is one row with their ids, joined by the run."""
    sizes = low.agg(F.min(F.length("needle")).alias("least"), F.max(F.length("needle")).alias("most")).first()
    least, most = sizes["least"] or 1, sizes["most"] or 0

    def runs(batches):
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                found, ids, size = [], [], 0
                while at < len(texts) and (not found or size < RUN_CHARS):
                    own = [r for r in set(_RUN.findall(texts[at])) if least <= len(r) <= most]
                    found += own
                    ids.append(np.full(len(own), at))
                    size, at = size + len(texts[at]), at + 1
                names = pa.array(found, pa.string()).dictionary_encode()
                run, ids = names.indices.to_numpy(), np.concatenate(ids)
                order = np.argsort(run, kind="stable")
                offsets = np.append(0, np.cumsum(np.bincount(run, minlength=len(names.dictionary)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), batch.column(0).take(pa.array(ids[order].astype(np.int64))))
                yield pa.RecordBatch.from_arrays([names.dictionary, lists], ["needle", "_ids"])

    packed = rows.mapInArrow(runs, T.StructType([out["needle"], T.StructField("_ids", T.ArrayType(out["_id"].dataType))]))
    return packed.join(low.select("needle"), "needle").select(F.explode("_ids").alias("_id"), "needle")


def hits(texts: DataFrame, needles: DataFrame, id_col: str, text_col: str = "text", needle_col: str = "needle", mode: str = "substring") -> DataFrame:
    """(id, needle): the distinct needles of every text, in lower case, one row each."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = texts.sparkSession
    rows = texts.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_t")).where("_t is not null")
    out = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("needle", T.StringType())])
    low, every = lowered(needles, needle_col), None
    if mode == "word" and low.where("run").count() > BLOCK:
        every, low = _run_hits(rows, low.where("run"), out), low.where("not run")
    for block in blocks(low):
        if every is not None and not block:
            continue
        shipped = spark.sparkContext.broadcast(block)  # BLOCK needles

        def scan(batches, shipped=shipped):
            a = _automaton(shipped)
            for batch in batches:
                found = [found_in(a, t, mode) for t in batch.column(1).to_pylist()]
                at = [i for i, f in enumerate(found) for _ in f]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())),
                                                  pa.array([shipped.value[n] for f in found for n in f], pa.string())], ["_id", "needle"])

        one = rows.mapInArrow(scan, out)
        every = one if every is None else every.unionByName(one)
    return every.withColumnRenamed("_id", id_col)


def ban_needles(texts: DataFrame, needles: DataFrame, id_col: str, text_col: str = "text", mode: str = "substring") -> DataFrame:
    """V1 with a table of needles (needle, position): (id, hits) of the texts that hold one, their
    needles joined in the order of ``position``."""
    found = hits(texts, needles, id_col, text_col, "needle", mode)
    order = needles.select(F.lower("needle").alias("needle"), "position").groupBy("needle").agg(F.min("position").alias("position"))
    named = found.join(order, "needle").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("position", "needle"))).alias("h"))
    return named.select(id_col, F.array_join(F.transform("h", lambda x: x["needle"]), ", ").alias("hits"))


def query_parts(queries: DataFrame, rules: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """F2 with a table of rules (field, priority, needle, value): id and, for each field, the value of the
    matching rule of least priority number (then the smallest value); null where none matches."""
    found = hits(queries, rules, id_col, text_col).join(rules.select(F.lower("needle").alias("needle"), "field", "priority", "value"), "needle")
    best = [F.min(F.when(F.col("field") == f, F.struct("priority", "value"))).alias(f) for f in PART_FIELDS]
    parts = found.groupBy(id_col).agg(*best).select(id_col, *[F.col(f"{f}.value").alias(f) for f in PART_FIELDS])
    return queries.select(id_col).join(parts, id_col, "left")
