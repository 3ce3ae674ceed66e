"""Phrase collocations by an FM-index per shard over word ids.

Every task cuts its texts into pieces and words and packs them, by language,
into shards of about ``SHARD_TOKENS`` words. A shard is an FM-index: the
Burrows-Wheeler transform of its word ids in the order of suffixes compared to
``DEPTH`` words (all that phrases of up to ``DEPTH`` words need), and the start
of each word's interval. Intervals grow in both directions: LF steps carry the
interval of a phrase to those of its left extensions, and within the interval
of a phrase the owners of the rest delimit those of its right extensions; an
extension is followed only where the phrases on both sides of it are frequent.

Counts are summed across shards level by level, so nothing but frequent phrases
is ever extended:

1. words: interval sizes summed by (language, word);
2. pairs of frequent words, summed by the pair of word numbers;
3. triples whose pairs are frequent, summed by the numbers of their pairs;
4. phrases of 4 and 5 words whose triples are frequent, summed by the numbers of
   their first and last triple.

A number is the smallest place where its phrase was counted, so keys are exact
and need no dictionary in one place. Shards of a language are dealt into groups
of about ``GROUP_TOKENS`` words; a group is visited once a level with its own
frequent phrases (cogroup) and adds up its shards before it sends rows, so a
phrase brings one row a group to a sum. The frequent phrases (at most words /
``least`` a level) are then spelled and joined to their parts.

Defined results: null texts are empty, a null language is ``und``; rows are
counted as often as they occur; ids play no part; phrases never cross pieces or
documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Longest phrase in words; words of a shard (a longer text makes a larger one) and of a group of shards.
DEPTH, SHARD_TOKENS, GROUP_TOKENS = 5, 1_500_000, 4_000_000
#: Bytes of a text that are cut into words at a time.
SLICE_BYTES = 1_000_000
#: Rows of a batch of counts.
BATCH_ROWS = 100_000
#: A place is shard (or a group's first shard) << PLACE_BITS | row; a shard is task << SHARD_BITS | its number there.
PLACE_BITS, SHARD_BITS, TASK_BITS = 31, 12, 20

# A-Z lower-cased, tabs to blanks, the characters that end a piece to newlines; all else stays.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))


class _Words(dict):
    """word -> number from 1; 0 ends a piece, -1 is no word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def _slices(text: bytes) -> Iterator[bytes]:
    """``text`` in runs of about ``SLICE_BYTES``, cut at blanks (which it loses)."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        stop = text.find(b" ", at + SLICE_BYTES)
        if stop < 0:
            break
        yield text[at:stop]
        at = stop + 1
    yield text[at:]


class Builder:
    """The words of a shard to be."""

    def __init__(self):
        self.words, self.parts, self.size = _Words(), [np.zeros(1, np.int32)], 0

    def add(self, text: bytes) -> None:
        for part in _slices(text.translate(_BYTES)):
            split = part.replace(b"\n", b" \n ").split(b" ")
            numbers = np.fromiter(map(self.words.__getitem__, split), np.int32, len(split))
            numbers = numbers[numbers >= 0]
            self.parts.append(numbers)
            self.size += len(numbers)
        self.parts.append(np.zeros(1, np.int32))

    def index(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words, starts and sizes of their intervals, and the transform."""
        a = np.concatenate(self.parts).astype(np.int64)
        a = np.append(a[(a > 0) | (np.roll(a, 1) > 0)], 0)  # one end between pieces
        order = suffix_order(a)
        transform = a[order - 1].astype(np.int32)  # before the first stands an end
        sizes = np.bincount(a, minlength=len(self.words) - 1)
        starts = np.cumsum(sizes) - sizes
        return [w.decode() for w in list(self.words)[2:]], starts[1:], sizes[1:], transform


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])


def suffix_order(a: np.ndarray) -> np.ndarray:
    """Positions of ``a`` sorted by the ``DEPTH`` numbers from there on, by doubling."""
    rank, width, order = a, 1, None
    while width < DEPTH:
        step = min(width, DEPTH - width)
        key = rank * (int(rank.max()) + 1)
        key += _ahead(rank, step)  # windows may overlap: together they span width + step
        del rank, order
        order = np.argsort(key, kind="stable")
        width += step
        key = key[order]
        new = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        del key
        rank = np.empty(len(a), np.int64)
        rank[order] = new
        del new
    return order


def shards(documents: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """shard, lang, n (words), words, starts, sizes and the packed transform."""

    def run(batches):
        task, made, open_ = TaskContext.get().partitionId(), 0, {}
        if task >> TASK_BITS:
            raise ValueError(f"more than {1 << TASK_BITS} input partitions")
        pack = zstandard.ZstdCompressor(level=1)

        def row(lang: str) -> pa.RecordBatch:
            nonlocal made
            if made >> SHARD_BITS:
                raise ValueError(f"more than {1 << SHARD_BITS} shards in a partition")
            words, starts, sizes, transform = open_.pop(lang).index()
            made += 1
            return pa.RecordBatch.from_arrays([
                pa.array([task << SHARD_BITS | made - 1]), pa.array([lang]), pa.array([int(sizes.sum())]), pa.array([words], pa.list_(pa.string())),
                pa.array([starts.astype(np.int32)]), pa.array([sizes.astype(np.int32)]), pa.array([pack.compress(transform.tobytes())])],
                ["shard", "lang", "n", "words", "starts", "sizes", "transform"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held = open_.setdefault(lang, Builder())
                held.add(text)
                if held.size >= SHARD_TOKENS:
                    yield row(lang)
                while sum(b.size for b in open_.values()) >= 2 * SHARD_TOKENS:  # many languages
                    yield row(max(open_, key=lambda x: open_[x].size))
        for lang in list(open_):
            yield row(lang)

    return documents.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
                            F.col(text_column).cast("string").alias("text")).where("text is not null").mapInArrow(
        run, "shard bigint, lang string, n bigint, words array<string>, starts array<int>, sizes array<int>, transform binary")


class Index:
    """A shard's transform with its LF steps."""

    def __init__(self, packed: bytes):
        transform = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int32)
        self.n = len(transform)
        self.lf = np.empty(self.n, np.int32)
        self.lf[np.argsort(transform, kind="stable")] = np.arange(self.n, dtype=np.int32)

    def owners(self, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Of each row, the number of the interval that holds it, or -1."""
        out = np.full(self.n, -1, np.int32)
        for start, size, number in zip(starts.tolist(), sizes.tolist(), numbers.tolist(), strict=True):
            out[start:start + size] = number
        return out

    def left(self, owners: np.ndarray) -> np.ndarray:
        """Of each row, the owner of the rest after its first word: a left extension of all intervals at once."""
        out = np.empty(self.n, np.int32)
        out[self.lf] = owners
        return out


def extended(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the intervals whose rows have equal owners in all ``parts``, none missing."""
    there = np.logical_and.reduce([p >= 0 for p in parts])
    new = np.zeros(len(there), bool)
    new[:1] = True
    for p in parts:
        new[1:] |= p[1:] != p[:-1]
    new[1:] |= there[1:] != there[:-1]
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, len(there)))
    own = there[begins]
    return begins[own], sizes[own]


def added(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes in order, sums) of several (codes, counts)."""
    codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    del order
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(n, first) if len(first) else n


class Level:
    """The frequent phrases of one length in a group; inside a group they go by their rank."""

    def __init__(self, numbers: np.ndarray, codes: np.ndarray | None = None):
        order = np.argsort(numbers if codes is None else codes, kind="stable")
        self.numbers, self.codes = numbers[order], None if codes is None else codes[order]
        self._by_number = np.argsort(self.numbers, kind="stable")

    def ranks(self, numbers: np.ndarray) -> np.ndarray:
        return self._by_number[np.searchsorted(self.numbers, numbers, sorter=self._by_number)]

    def code(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """One integer for two phrases of this length."""
        return first.astype(np.int64) * len(self.numbers) + last

    def found(self, codes: np.ndarray) -> np.ndarray:
        """Ranks of the phrases with these codes, or -1."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1).astype(np.int32)


def _extend(level: int):
    """For a cogroup of a group's shards with its frequent phrases of fewer than
    ``level`` words: counts of its phrases of ``level`` words (and of 5, if 4)."""
    names, kinds = ["size", "k1", "k2", "place", "n"], [pa.int32(), *[pa.int64()] * 4]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], t) for t in kinds], names)
        known = {c: right.column(c).to_numpy() for c in ("size", "shard", "start", "n", "k1", "k2", "number")}
        if not left.num_rows or any(not (known["size"] == size).any() for size in range(1, level)):
            return none
        of = [known["size"] == size for size in range(1, level)]
        levels = [Level(np.unique(known["number"][of[0]]))]
        for own in of[1:]:
            k1, k2 = (levels[-1].ranks(known[c][own]) for c in ("k1", "k2"))
            levels.append(Level(known["number"][own], levels[-1].code(k1, k2)))
        counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for shard, packed in zip(left.column("shard").to_pylist(), left.column("transform"), strict=True):
            pa.default_memory_pool().release_unused()
            index, own = Index(packed.as_py()), of[0] & (known["shard"] == shard)
            at = index.owners(known["start"][own], known["n"][own], levels[0].ranks(known["number"][own]))
            for before, here in zip(levels, levels[1:], strict=False):
                rest = index.left(at)
                both = np.flatnonzero((at >= 0) & (rest >= 0))
                found = here.found(before.code(at[both], rest[both]))
                at = np.full(index.n, -1, np.int32)
                at[both] = found
            parts = [at, index.left(at)] + ([index.left(index.left(at))] if level == 4 else [])
            for size, grams in ((level, parts[:2]), (5, parts[:3])):
                if len(grams) == size - level + 2:
                    starts, sizes = extended(*grams)
                    new = (levels[-1].code(grams[0][starts], grams[-1][starts]), sizes)
                    counts[size] = added(counts[size], new) if size in counts else added(new)
            del index, at, parts, grams  # a shard at a time: its sums stay, sorted, its rows don't
        out, rows, first = [], 0, min(left.column("shard").to_pylist())
        for size, (codes, n) in counts.items():
            for a in range(0, len(codes), BATCH_ROWS):  # a batch's rows are what the other side holds at a time
                k1, k2 = (levels[-1].numbers[x] for x in np.divmod(codes[a:a + BATCH_ROWS], len(levels[-1].numbers)))
                place = (first << PLACE_BITS) + rows + np.arange(len(k1))
                out.append(pa.table([np.full(len(k1), size, np.int32), k1, k2, place, n[a:a + BATCH_ROWS]], names))
                rows += len(k1)
        return pa.concat_tables(out) if out else none

    return run


def _summed(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``rows`` (one a group and phrase) of frequent phrases with f, their count over all
    groups, and their number; ``one`` marks one row of each."""
    same = Window.partitionBy(*keys)
    return rows.withColumn("f", F.sum("n").over(same)).withColumn("number", F.min("place").over(same)).withColumn(
        "one", F.col("number") == F.col("place")).where(F.col("f") >= least)


def frequent(documents: DataFrame, least: int = 100, text_column: str = "text", lang_column: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, words, f of every phrase of 1 to 5 words that occurs ``least`` times in
    its language, its words in order; lang, n of every language)."""
    index = stored(shards(documents, text_column, lang_column), "fm-shards")
    totals = index.groupBy("lang").agg(F.sum("n").alias("n"))
    # one small row a shard: groups are runs of a language's shards, named by their first
    so_far = F.sum("n").over(Window.partitionBy("lang").orderBy("shard")) - F.col("n")
    groups = index.select("shard", "lang", F.floor(so_far / GROUP_TOKENS).alias("run"))
    groups = stored(groups.select("shard", F.min("shard").over(Window.partitionBy("lang", "run")).alias("home")), "fm-groups")
    entry = F.arrays_zip("words", "starts", "sizes")
    words = index.join(groups, "shard").select("shard", "home", "lang", F.explode(entry).alias("e")).select(
        "shard", "home", "lang", F.col("e.words").alias("word"), F.col("e.starts").cast("bigint").alias("start"), F.col("e.sizes").cast("bigint").alias("n"))
    words = words.withColumn("place", F.shiftleft("shard", PLACE_BITS) + F.col("start"))
    words = stored(_summed(words, ["lang", "word"], least), "fm-words")
    held = index.select("shard", "transform").join(groups, "shard").select(F.col("home").alias("group"), "shard", "transform")
    nothing = F.lit(-1).cast("bigint")
    known = words.select("shard", F.lit(1).alias("size"), "start", "n", nothing.alias("k1"), nothing.alias("k2"), "number", "home")

    def meet(level: int) -> DataFrame:
        return held.groupBy("group").cogroup(known.groupBy("home")).applyInArrow(
            _extend(level), "size int, k1 bigint, k2 bigint, place bigint, n bigint")

    one = words.where("one").select("number", "lang", "word", "f")
    spelled = [one.select("number", "lang", F.array("word").alias("words"), "f")]

    def spell(rows: DataFrame, shared: int) -> DataFrame:
        """Phrases of ``rows`` from those of the level before, whose two parts share so many words."""
        first, last = (spelled[-1].select(F.col("number").alias(k), F.col("words").alias(w)) for k, w in (("k1", "w1"), ("k2", "w2")))
        first = first.join(spelled[-1].select(F.col("number").alias("k1"), "lang"), "k1")
        return rows.join(first, "k1").join(last, "k2").select(
            "number", "lang", F.concat("w1", F.slice("w2", shared + 1, DEPTH)).alias("words"), "f")

    for level in (2, 3):
        rows = stored(_summed(meet(level), ["size", "k1", "k2"], least), "fm-phrases")
        spelled.append(stored(spell(rows.where("one"), level - 2), "fm-spelled"))
        home = F.shiftright("place", PLACE_BITS)
        known = known.unionByName(rows.select(nothing.alias("shard"), "size", nothing.alias("start"), "n", "k1", "k2", "number", home.alias("home")))
    longest = meet(4).groupBy("size", "k1", "k2").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("number", nothing)
    longest = stored(longest, "fm-phrases")
    parts = [spell(longest.where(F.col("size") == size), shared) for size, shared in ((4, 2), (5, 1))]
    every = [p.select("lang", "words", "f") for p in (*spelled, *parts)]
    out = every[0]
    for p in every[1:]:
        out = out.unionByName(p)
    return stored(out, "fm-frequent"), totals


def collocations(documents: DataFrame, least: int = 100, most: int = 2_000, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases."""
    every, totals = frequent(documents, least, text_column, lang_column)
    size = F.size("words")
    longer = every.where(size > 2).withColumn("inner", F.explode(F.array(F.slice("words", 1, size - 1), F.slice("words", F.lit(2), size - 1))))
    whole = longer.select("lang", F.col("inner").alias("words"), "f").distinct()  # phrases that never occur without a neighbour
    kept = every.where(size > 1).join(whole, ["lang", "words", "f"], "left_anti")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("head", F.slice("words", F.lit(1), F.col("k"))).withColumn("tail", F.slice("words", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.join(every.select("lang", F.col("words").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        every.select("lang", F.col("words").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(F.broadcast(totals), "lang")

    def product(a: str, b: str) -> str:
        return f"cast({a} as decimal(18, 0)) * cast({b} as decimal(18, 0))"

    score = F.expr(f"({product('1000 * f', 'n')}) div ({product('l', 'r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "words").agg(F.min(F.struct("score", "k", "l", "r", "f", "n")).alias("c"))
    scored = scored.select("lang", F.array_join("words", " ").alias("phrase"), F.col("c.f").alias("a"), "c.l", "c.r", "c.n", "c.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = 100, most: int = 2_000) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, '{upper}', '{lower}') AS text FROM documents WHERE text IS NOT NULL)),
grams AS (SELECT lang, size, unnest([words[i:i + size - 1] for i in range(1, len(words) - size + 2)]) AS words
  FROM pieces, (SELECT unnest(range(1, {DEPTH + 1})) AS size)),
counts AS MATERIALIZED (SELECT lang, size, words, array_to_string(words, ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE size > 1 AND f >= {least}),
kept AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.size > c.size AND d.f = c.f
  AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, f, k, words[1:k] AS head, words[k + 1:size] AS tail FROM kept, (SELECT unnest(range(1, {DEPTH})) AS k) WHERE k < size),
scored AS (SELECT c.lang, c.phrase, c.f AS a, k, h.f AS l, t.f AS r, n, ((1000::HUGEINT * c.f * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.words = c.head JOIN counts t ON t.lang = c.lang AND t.words = c.tail JOIN totals o ON o.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE cut = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {most}"""
