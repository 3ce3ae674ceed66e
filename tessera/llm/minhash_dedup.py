"""Near-duplicate documents by Order MinHash and banded alignment.

A document's k-mers are runs of ``WORDS`` words (its letters and digits in
lower case), labelled with their occurrence number. Each of ``SKETCHES``
sketches takes the ``TAKEN`` k-mers with the smallest hashes and keeps them in
text order, so that equal sketches speak for a small edit distance rather than
for a common bag of k-mers. Documents that share a sketch are candidates; a
candidate pair is a link if the edit similarity of the word sequences,
1 - distance / longer length, is at least ``threshold``, found by an alignment
confined to the band of diagonals that this similarity allows.

Copies (equal word sequences) form one class, and only classes are compared.
Pairs of a sketch are not listed: each member is first aligned with one centre
of its sketch and linked ones are joined to components. Only where a sketch
still spans several components its members are compared across them, inside the
tasks, in cells of two bounded blocks: a pair is aligned in the first sketch it
shares, behind an exact filter (word histograms differ by at most twice the
distance), unless links found there have joined the two already. So every
candidate pair is aligned, excluded by the filter, or in one component, and no
task puts out more than a few rows per class.

A pair with 5-word similarity (Jaccard) J shares a sketch with probability
about 1 - (1 - J**3)**32: above 0.9999 from 0.7, 0.99 at 0.53.

Defined results: null texts are empty; texts without any word are copies of
each other; texts shorter than a k-mer have one, of all their words; repeated
rows are copies; a component's document is that of its smallest id (null
last), then text hash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCodes, free_name, one_per_worker, slices, stored, whole_text
from .components import components, extended

#: Words of a k-mer, k-mers of a sketch, sketches of a document.
WORDS, TAKEN, SKETCHES = 5, 3, 32
#: Bits of the word histogram's bins, and classes in a block of a sketch's members.
BIN_BITS, BLOCK = 10, 1_024
#: Document ids that may be broadcast to fetch texts; beyond, the texts are shuffled.
BROADCAST_IDS = 500_000

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(2019).integers(0, 1 << 63, SKETCHES, dtype=np.uint64)[:, None]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower()) or text.split()


# --- sketches ---------------------------------------------------------------------


def task_hashes() -> WordCodes:
    """word -> 64-bit hash; one bounded cache for all tasks of a Python worker."""

    def hashes(words):
        return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64), np.ones(len(words), np.int64)

    return one_per_worker("word-hashes", None, lambda: WordCodes(hashes, dtype=np.uint64))


def word_hashes(texts: list[str]):
    """The word hashes of each text, in order."""
    cache = task_hashes()
    for a, b in slices(texts):
        docs = [words_of(t) for t in texts[a:b]]
        codes = cache.lookup([w for d in docs for w in d])
        h = cache.values[codes]  # the cache's arrays are those after the lookup
        at = 0
        for d in docs:
            yield h[at:at + len(d)]
            at += len(d)


def kmers(h: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers of a word-hash sequence, labelled by occurrence."""
    n = max(1, len(h) - WORDS + 1)
    k = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(h))):
        k = (k ^ h[i:i + n]) * _MIX
        k ^= k >> np.uint64(31)
    order = np.argsort(k, kind="stable")
    same = np.concatenate([[False], k[order][1:] == k[order][:-1]])
    if same.any():
        run = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        label = np.zeros(n, np.uint64)
        label[order] = run
        k = (k + label) * np.where(label > 0, _MIX, np.uint64(1))
    return k


def sketches(h: np.ndarray) -> np.ndarray:
    """The document's sketches as 64-bit keys."""
    k = kmers(h)
    x = (k[None, :] ^ _SEEDS) * _MIX
    x ^= x >> np.uint64(32)
    rank = ((x * _MIX) >> np.uint64(32)).astype(np.uint32)
    if len(k) > TAKEN:
        at = np.sort(np.argpartition(rank, TAKEN - 1, axis=1)[:, :TAKEN], axis=1)  # text order
        taken = k[at]
    else:
        taken = np.repeat(k[None, :], SKETCHES, axis=0)
    key = _SEEDS[:, 0].copy()
    for j in range(taken.shape[1]):
        key = (key ^ taken[:, j]) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def histogram(words: np.ndarray) -> np.ndarray:
    """Words (upper 32 bits of their hashes) per bin; an edit moves two counts by one at most."""
    return np.bincount(words >> np.uint32(32 - BIN_BITS), minlength=1 << BIN_BITS).astype(np.int32)


def short(h: np.ndarray) -> np.ndarray:
    """The upper 32 bits of word hashes."""
    return (h >> np.uint64(32)).astype(np.uint32)


# --- alignment --------------------------------------------------------------------


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else more than ``most``.

    Columns of the alignment matrix are bit vectors of the 2 * most + 1 cells
    around the diagonal; the value on the band's lowest diagonal is carried
    along until it meets the last row, and then along that row."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    start, end = 0, len(b)
    while start < end and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < end - start and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b = a[start:len(a) - tail], b[start:len(b) - tail]
    if not b or most == 0:
        return len(a)
    most = min(most, len(a))
    width = 2 * most + 1
    full = (1 << width) - 1
    places: dict[int, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    masks = {w: sum(1 << i for i in p) for w, p in places.items()} if len(a) <= 4_096 else None
    vp, vn = full & ~((1 << (width - most - 1)) - 1), 0
    low, distance, top = most + 1 - width, most, 1 << (width - 1)
    row = 1 << (width - 2)
    for j, w in enumerate(b):
        at = low + j  # the row of the window's lowest bit
        if masks is not None:
            m = masks.get(w, 0)
            match = (m >> at if at >= 0 else m << -at) & full
        else:
            match, p = 0, places.get(w, ())
            for i in p[bisect_left(p, max(at, 0)):bisect_left(p, at + width)] if p else ():
                match |= 1 << (i - at)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if j < len(a) - most:
            distance += 0 if d0 & top else 1
        else:
            if hp & row:
                distance += 1
            elif hn & row:
                distance -= 1
            row >>= 1
        x = d0 >> 1
        vp = hn | (full & ~(x | hp))
        vn = x & hp
    return distance


def allowed(n: int, m: int, threshold: float) -> int:
    """The largest distance that still gives the similarity."""
    return int((1.0 - threshold) * max(n, m) + 1e-9)


def possible(na, nb, ha, hb, threshold):
    """The exact filter, for lengths and histograms (of one pair, or of rows of them)."""
    most = ((1.0 - threshold) * np.maximum(na, nb) + 1e-9).astype(np.int64)
    return (np.abs(na - nb) <= most) & (np.abs(ha - hb).sum(axis=-1) <= 2 * most)


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    most = allowed(len(a), len(b), threshold)
    return abs(len(a) - len(b)) <= most and banded_distance(a.tolist(), b.tolist(), most) <= most


# --- Spark ------------------------------------------------------------------------


def signatures(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text_hash, digest (of the word sequence) and sketch keys of every row."""
    kind = dict(documents.dtypes)[id_column]

    def run(batches):
        for batch in batches:
            digest, keys = [], []
            for h in word_hashes(batch.column("text").to_pylist()):
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                keys.append(sketches(h) if len(h) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "digest", "keys"])

    rows = documents.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        run, f"doc_id {kind}, text_hash bigint, digest binary, keys array<bigint>")


def _sequences(documents: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """digest, words (packed hashes) of the classes in ``wanted`` (digest, doc_id, text_hash: one row of each)."""
    rows = documents.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    w = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    rows = rows.join(w, rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["text_hash"] == wanted["text_hash"])).select("digest", "text")

    def run(batches):
        for batch in batches:
            words = [h.tobytes() for h in word_hashes(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(words, pa.binary())], ["digest", "words"])

    # repeated rows bring a class more than once
    return rows.mapInArrow(run, "digest binary, words binary").dropDuplicates(["digest"])


def _aligned(pairs: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose edit similarity reaches the threshold."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("wa"), batch.column("wb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                near = possible(np.int64(len(x)), np.int64(len(y)), histogram(short(x)), histogram(short(y)), threshold)
                good.append(bool(near) and similar(x, y, threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    sides = [sequences.select(F.col("digest").alias(s), F.col("words").alias("w" + s)) for s in "ab"]
    # the side that may be hot (a centre) comes last, right before the alignment, where Spark can split it
    return pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary")


def _across(threshold: float):
    """Links of one cell that join classes of different components."""

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        left, right = key[1].as_py(), key[2].as_py()
        digest, label = (np.array(cell.column(c).to_pylist(), object) for c in ("digest", "label"))
        block, band = cell.column("block").to_numpy(), cell.column("band")[0].as_py()
        words = [np.frombuffer(w, np.uint32) for w in cell.column("words").to_pylist()]
        keys = np.stack(cell.column("keys").to_pylist())
        n, bins = np.array([len(w) for w in words]), np.stack([histogram(w) for w in words]).astype(np.int16)
        _, label = np.unique(label, return_inverse=True)
        rows = np.flatnonzero(block == left)
        cols = rows if left == right else np.flatnonzero(block == right)
        out = []
        for i in rows.tolist():
            other = cols[(label[cols] != label[i]) & ((cols > i) if left == right else True)]
            other = other[~(keys[other, :band] == keys[i, :band]).any(axis=1)]  # the first sketch they share
            other = other[possible(n[i], n[other], bins[i], bins[other], threshold)]
            # those that share most sketches first
            for j in other[np.argsort(-(keys[other] == keys[i]).sum(axis=1), kind="stable")].tolist():
                if label[i] != label[j] and similar(words[i], words[j], threshold):
                    label[label == label[j]] = label[i]
                    out.append((digest[i], digest[j]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    return run


def link_classes(nodes: DataFrame, sequences_of, threshold: float) -> DataFrame | None:
    """node, label of all classes that are linked; ``nodes`` has digest and keys, and
    ``sequences_of`` gives the word sequences of a table of digests."""
    spots = nodes.select("digest", F.posexplode("keys").alias("band", "key"))
    shared = stored(spots.groupBy("key").agg(F.count("*").alias("n_members"), F.min("digest").alias("centre")).where("n_members > 1"), "omh-shared")
    members = stored(spots.join(shared, "key"), "omh-members")
    if members.isEmpty():
        return None
    sequences = stored(sequences_of(members.select("digest").distinct()), "omh-sequences")

    # every member with the centre of its sketch
    star = members.where("digest <> centre").select(F.col("centre").alias("a"), F.col("digest").alias("b")).distinct()
    links = stored(_aligned(stored(star, "omh-star"), sequences, threshold), "omh-links")
    labels = components(links)

    # sketches that still span several components
    marked = members.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    marked = stored(marked.select("key", "band", "digest", "label", "n_members"), "omh-marked")
    spanning = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    left_over = marked.join(stored(spanning, "omh-spanning"), "key").withColumn("blocks", F.ceil(F.col("n_members") / BLOCK).cast("int"))
    left_over = left_over.withColumn("block", F.pmod(F.xxhash64("digest", "key"), F.col("blocks")).cast("int"))
    left_over = left_over.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = left_over.select("key", "band", "digest", "label", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))

    def shorten(batches):
        for batch in batches:
            words = [short(np.frombuffer(w, np.uint64)).tobytes() for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(words, pa.binary())], ["digest", "words"])

    def work(key, cell):
        return _across(threshold)(key, cell)

    rows = sequences.mapInArrow(shorten, "digest binary, words binary").join(nodes.select("digest", "keys"), "digest")
    rows = stored(rows, "omh-cell-rows")
    found = stored(cells.join(rows, "digest").groupBy("key", "left", "right").applyInArrow(work, "a binary, b binary").distinct(), "omh-found")
    more = stored(_aligned(found, sequences, threshold), "omh-more")  # again with whole hashes
    return labels if more.isEmpty() else extended(labels, more)


def classify(documents: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash, class_id (smallest doc_id of the component) and kept of every row.

    Kept rows of a component have its smallest (doc_id, text_hash); only rows that
    repeat both are kept together."""
    rows = stored(signatures(documents, id_column, text_column), "omh-rows")
    # nulls last: (is null, id, text hash)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    classes = stored(rows.groupBy("digest").agg(first), "omh-classes")
    nodes = stored(rows.where("size(keys) > 0").select("digest", "keys").dropDuplicates(["digest"]), "omh-nodes")

    def sequences_of(digests: DataFrame) -> DataFrame:
        wanted = classes.join(digests, "digest", "left_semi").select("digest", "first.doc_id", "first.text_hash")
        return _sequences(documents, stored(wanted, "omh-wanted"), id_column, text_column)

    labels = link_classes(nodes, sequences_of, threshold)
    if labels is None:
        groups = classes.select("digest", F.col("digest").alias("label"), "first")
    else:
        groups = classes.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select(
            "digest", F.coalesce("label", "digest").alias("label"), "first")
    groups = stored(groups, "omh-groups")
    chosen = stored(groups.groupBy("label").agg(F.min("first").alias("chosen")), "omh-chosen")
    result = stored(groups.join(chosen, "label").select("digest", "chosen"), "omh-result")
    kept = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("text_hash") == F.col("chosen.text_hash"))
    return rows.select("doc_id", "text_hash", "digest").join(result, "digest").select(
        "doc_id", "text_hash", F.col("chosen.doc_id").alias("class_id"), kept.alias("kept"))


def keep_one(documents: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``documents`` with one row of each component."""
    kept = classify(documents, threshold, id_column, text_column).where("kept").select("doc_id", "text_hash").distinct()
    kept = stored(kept, "omh-kept")
    mark, place = free_name(documents, "text_hash"), free_name(documents, "place")
    rows = documents.withColumn(mark, F.xxhash64(whole_text(text_column)))
    rows = rows.join(kept, rows[id_column].eqNullSafe(kept["doc_id"]) & (rows[mark] == kept["text_hash"]), "left_semi")
    first = F.row_number().over(Window.partitionBy(id_column, mark).orderBy(id_column))
    return rows.withColumn(place, first).where(F.col(place) == 1).select(*documents.columns)
