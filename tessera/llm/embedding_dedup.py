"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Equal vectors form one class, and only classes are compared. Rotations of the
principal directions are learned on a bounded sample so that the signs of the
rotated coordinates are balanced binary codes (iterative quantisation); short
vectors get several rotations, so that tables have bits of their own. Codes
are looked up in Hamming tables, each indexed by some of the bits: classes
that agree in a table's key meet there. Candidates are reranked with the
original vectors: a pair is a link if its cosine, in double precision, is at
least the threshold. A pair that meets in several tables is counted in the
first.

How many tables and how long a key is chosen per vector length: of the layouts
in ``LAYOUTS``, the one of least work on the sample whose measured recall is at
least ``RECALL``. Recall is measured on the sample's own pairs above the
threshold, by brute force, and on pairs made to lie exactly at the threshold,
in random directions and in the directions in which the sample varies. The
choice is the same at every size. If no layout reaches it (vectors that share so
much of a direction that most are near the threshold), the key has no bits and
all pairs are compared; the column ``layout`` names what was used for a row.

A key's classes are worked on in cells of two blocks of at most ``BLOCK``
classes, so a hot key is many bounded groups; small cells are compared many at
once. A cell puts out per class the number of linked rows and one edge to its
local component's first member, never the pairs.

Defined results: vectors that are null, zero or hold null or non-finite
components link with nothing and are their own components; only vectors of
the same length are compared; repeated rows are copies that link with each
other; a null id is larger than any other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .vectors import matrices

#: Vectors of the training sample (chosen by digest) and rounds of learning the rotation.
SAMPLE, ROUNDS = 8_192, 30
#: Bits of a rotation's code at most, Hamming tables, and bits of a table's key, where nothing else is chosen.
CODE_BITS, TABLES, KEY_BITS = 64, 16, 16
#: Least recall measured on the sample's pairs and on pairs at the threshold, and pairs of each kind at most.
RECALL, PAIRS = 0.97, 4_096
#: (tables, bits of a key) to choose from, and rotations that give tables bits of their own.
LAYOUTS, ROTATIONS = [(t, k) for k in (16, 14, 12, 10, 8, 6, 4, 3, 2) for t in (16, 24, 32, 48, 64)], 4
#: Work of a class in a table, counted in comparisons of two classes.
SPOT_WORK = 300
#: Classes in a block of a key; a cell compares two blocks.
BLOCK = 1_024


def classes_of(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, digest, dim, packed of every row; digest is null for vectors that can't link."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            digest, dim, packed = [None] * n, [0] * n, [None] * n
            for rows, m in matrices(batch.column("vec")):
                m = m + 0.0  # one zero
                good = (m != 0).any(axis=1)
                for i, v in zip(rows[good].tolist(), m[good], strict=True):
                    raw = v.tobytes()
                    digest[i], dim[i], packed[i] = xxhash.xxh3_128_digest(raw), len(v), raw
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digest, pa.binary()), pa.array(dim, pa.int32()),
                                              pa.array(packed, pa.binary())], ["vec_id", "digest", "dim", "packed"])

    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("vec"))
    return rows.mapInArrow(run, "vec_id bigint, digest binary, dim int, packed binary")


def learn_rotation(sample: np.ndarray, bits: int = CODE_BITS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) whose signs are balanced codes: principal directions, rotated
    until the projected points lie near the corners of the cube."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, directions = np.linalg.eigh(centred.T @ centred)
    pca = directions[:, ::-1][:, :min(bits, sample.shape[1])]
    v = centred @ pca
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        corners = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(corners.T @ v)
        r = (u @ w).T
    return mean, pca @ r


def table_bits(bits: int, seed: int = 5, tables: int = TABLES, key_bits: int = KEY_BITS) -> np.ndarray:
    """The bits that index each table: the code cut into disjoint keys, then permuted and cut again."""
    rng, rows, size = np.random.default_rng(seed), [], min(key_bits, bits)
    order = np.arange(bits)
    while len(rows) < tables:
        rows += [order[i:i + size] for i in range(0, bits - size + 1, size)]
        order = rng.permutation(bits)
    return np.array(rows[:tables])


def rotations(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of several learned rotations side by side."""
    count = max(ROTATIONS, -(-CODE_BITS // max(sample.shape[1], 1)))
    learned = [learn_rotation(sample, seed=11 + i) for i in range(count)]
    return learned[0][0], np.concatenate([p for _, p in learned], axis=1)


def trial_pairs(sample: np.ndarray, threshold: float, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit rows that must be found: the sample's own, and made ones exactly at the threshold."""
    rng, out = np.random.default_rng(seed), []
    left, right, at = [], [], 0
    while at < len(sample) and sum(map(len, left)) < PAIRS:
        i, j = np.nonzero(sample[at:at + 512] @ sample.T >= threshold)
        later = at + i < j
        left.append(at + i[later])
        right.append(j[later])
        at += 512
    i, j = (np.concatenate(x)[:PAIRS] for x in (left, right))
    out.append((sample[i], sample[j]))
    one = sample[rng.integers(0, len(sample), PAIRS)]
    varied = sample[rng.integers(0, len(sample), PAIRS)] - sample[rng.integers(0, len(sample), PAIRS)]
    for way in (rng.standard_normal(one.shape), varied):
        way = way - (way * one).sum(axis=1, keepdims=True) * one
        size = np.sqrt((way * way).sum(axis=1))
        good = size > 1e-9
        out.append((one[good], threshold * one[good] + np.sqrt(max(0.0, 1 - threshold**2)) * way[good] / size[good, None]))
    return [p for p in out if len(p[0])]


def choose_tables(sample: np.ndarray, threshold: float, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, projection, tables' bits) of the layout of least work that finds ``RECALL`` of each kind of pair;
    without one, one table whose key has no bits."""
    mean, projection = rotations(sample)
    best, least = (mean, projection, np.zeros((1, 0), np.int64)), np.inf
    pairs = trial_pairs(sample, threshold)
    for tables, key_bits in LAYOUTS:
        if key_bits >= projection.shape[1] or SPOT_WORK * classes * tables >= least:
            continue
        model = (mean, projection, table_bits(projection.shape[1], tables=tables, key_bits=key_bits))
        keys = table_keys(sample, {0: model}, 0)
        meetings = sum(float((np.unique(k, return_counts=True)[1].astype(float) ** 2).sum() - len(k)) for k in keys.T)
        work = SPOT_WORK * classes * tables + meetings / 2 * (classes / len(sample)) ** 2
        if work < least and all((table_keys(a, {0: model}, 0) == table_keys(b, {0: model}, 0)).any(axis=1).mean() >= RECALL for a, b in pairs):
            best, least = model, work
    return best


def layout_of(model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> str:
    """The layout's name in the output."""
    tables, bits = model[2].shape
    return f"{tables} tables of {bits} bits" if bits else "all pairs"


def table_keys(unit: np.ndarray, models: dict, dim: int) -> np.ndarray:
    """The key of every vector (unit rows) in every table."""
    mean, projection, chosen = models[dim]
    code = (unit - mean) @ projection >= 0
    return code[:, chosen].astype(np.int64) @ (1 << np.arange(chosen.shape[1]))


def _unit(packed: list[bytes], dim: int) -> np.ndarray:
    m = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dim)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow in the norm
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it reaches over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


CELL = ["dim", "number", "key", "left", "right"]
#: Cells of at most so many rows are compared pair by pair, many cells at once.
SMALL = 48


def _whole_cells(batches):
    """Tables of whole cells from batches sorted by cell; only a batch's last cell waits for more."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        names = np.stack([table.column(c).to_numpy() for c in CELL])
        last = int(np.flatnonzero((names == names[:, -1:]).all(axis=0) == False)[-1]) + 1 if (names != names[:, -1:]).any() else 0  # noqa: E712
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def _pairs_above(cells: pa.Table, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one cell each whose cosine reaches the threshold. A cell of one block
    compares all its rows, one of two blocks the rows of the one with the other's."""
    names = np.stack([cells.column(c).to_numpy() for c in CELL])
    block, two = cells.column("block").to_numpy(), names[3] != names[4]
    starts = np.flatnonzero(np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(axis=0)]))
    sizes = np.diff(starts, append=len(block))
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    ends = np.repeat(starts + sizes, sizes)
    for at in range(0, len(small), 2_000):  # rows of small cells with those after them
        rows = small[at:at + 2_000]
        after = ends[rows] - rows - 1
        i = np.repeat(rows, after)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
        good = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        good &= ~two[i] | (block[i] != block[j])
        found_i.append(i[good])
        found_j.append(j[good])
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        rows = np.arange(start, start + size)
        cols = rows
        if two[start]:
            rows, cols = rows[block[rows] == names[3, start]], rows[block[rows] == names[4, start]]
        for at in range(0, len(rows), 256):
            i, j = np.nonzero(unit[rows[at:at + 256]] @ unit[cols].T >= threshold)
            i, j = rows[at + i], cols[j]
            keep = slice(None) if two[start] else i < j
            found_i.append(i[keep])
            found_j.append(j[keep])
    return np.concatenate(found_i), np.concatenate(found_j)


def _cell_links(cells: pa.Table, threshold: float, models: dict) -> pa.RecordBatch:
    """Linked rows and local component of the classes of whole cells of one vector length."""
    digest, size = cells.column("digest").to_pylist(), cells.column("copies").to_numpy()
    dim, number = cells.column("dim")[0].as_py(), cells.column("number").to_numpy()
    unit = _unit(cells.column("packed").to_pylist(), dim)
    i, j = _pairs_above(cells, unit, threshold)
    involved = np.unique(np.concatenate([i, j]))
    keys = np.zeros((len(digest), models[dim][2].shape[0]), np.int64)
    keys[involved] = table_keys(unit[involved], models, dim)
    # counted in the first table in which the two meet
    earlier = (keys[i] == keys[j]) & (np.arange(keys.shape[1]) < number[i][:, None])
    first = ~earlier.any(axis=1)
    i, j = i[first], j[first]
    linked = np.bincount(i, size[j], len(digest)) + np.bincount(j, size[i], len(digest))
    label = _smallest_reachable(len(digest), i, j)
    out = np.flatnonzero(linked > 0)
    return pa.RecordBatch.from_arrays(
        [pa.array([digest[k] for k in out], pa.binary()), pa.array(linked[out].astype(np.int64)),
         pa.array([digest[label[k]] for k in out], pa.binary())], ["digest", "linked", "root"])


def _rotations(classes: DataFrame, threshold: float) -> dict:
    """Per vector length the rotations learned on a bounded sample, and the tables' bits."""
    models = {}
    for row in classes.groupBy("dim").count().collect():  # one row per length of vector
        dim = row["dim"]
        picked = classes.where(F.col("dim") == dim).orderBy("digest").limit(SAMPLE).select("packed").collect()
        models[dim] = choose_tables(_unit([bytes(r["packed"]) for r in picked], dim), threshold, row["count"])
    return models


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id",
                    vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, layout (how its partners were looked for; null if it can't link) of every row."""
    spark = vectors.sparkSession
    rows = stored(classes_of(vectors, id_column, vector_column), "emb-rows")
    known = rows.where("digest is not null")
    classes = stored(known.groupBy("digest", "dim", "packed").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")), "emb-classes")
    models = _rotations(classes, threshold)
    shipped = spark.sparkContext.broadcast(models)  # per vector length: a few times CODE_BITS x length numbers, at least CODE_BITS bits

    def index(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                keys = table_keys(_unit(some.column("packed").to_pylist(), dim), shipped.value, dim)
                yield pa.RecordBatch.from_arrays([some.column("digest"), some.column("dim"), pa.array(list(keys), pa.list_(pa.int64()))],
                                                 ["digest", "dim", "keys"])

    spots = classes.select("digest", "dim", "packed").mapInArrow(index, "digest binary, dim int, keys array<bigint>")
    spots = stored(spots.select("digest", "dim", F.posexplode("keys").alias("number", "key")), "emb-spots")
    # keys with more than one class; how many blocks each is cut into
    shared = spots.groupBy("number", "dim", "key").agg(F.count("*").alias("n")).where("n > 1").select(
        "number", "dim", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = spots.join(shared, ["number", "dim", "key"])
    met = met.withColumn("block", F.pmod(F.xxhash64("digest", "number"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select("digest", "number", "dim", "key", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    cells = cells.join(classes.select("digest", "packed", "copies"), "digest")

    def work(batches):
        for whole in _whole_cells(batches):
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                yield _cell_links(whole.filter(pa.array(dims == dim)), threshold, shipped.value)

    # cells stay whole in a partition; a task reads them one after the other
    dealt = cells.repartition(*CELL).sortWithinPartitions(*CELL)
    found = stored(dealt.select(*CELL, "block", "digest", "packed", "copies").mapInArrow(
        work, "digest binary, linked bigint, root binary"), "emb-found")
    counts = found.groupBy("digest").agg(F.sum("linked").alias("linked"))
    groups = components(found.where("digest <> root").select(F.col("digest").alias("a"), F.col("root").alias("b")))
    # the smallest id of each component
    labelled = classes.select("digest", "copies", "least").join(groups.withColumnRenamed("node", "digest"), "digest", "left")
    labelled = stored(labelled.withColumn("label", F.coalesce("label", "digest")).join(counts, "digest", "left"), "emb-labelled")
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    result = labelled.join(smallest, "label").select(
        "digest", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # stored, so that a hot class's side of the join is a plain shuffle, which Spark can split
    result = stored(result, "emb-result")
    named = F.lit(None).cast("string")
    if models:
        layouts = F.create_map(*[F.lit(x) for dim, model in sorted(models.items()) for x in (dim, layout_of(model))])
        named = F.when(F.col("digest").isNotNull(), F.try_element_at(layouts, "dim"))
    out = rows.select("vec_id", "digest", named.alias("layout")).join(result, "digest", "left").select(
        "vec_id", "layout", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "layout")
