"""Language identification by a linear-chain conditional random field.

Every word of a text gets a label distribution from affix, n-gram and lexicon
features (hashed, weights learned) and learned transitions between labels, by
forward-backward; so code-switched passages get their own labels. A document's
language is the label with the largest mean posterior over its words, and that
mean is its score.

Training uses a bounded, hash-chosen sample of labelled documents that are not
held out (``crc32(id as text) mod 3`` is not 1). Training sequences are joined
from pieces of documents of different languages, so transitions are learned
from switches. Text is all a prediction sees.

Long chains are cut into runs of ``RUN`` words; each is read with ``CONTEXT``
more words on either side, beyond which a neighbour's influence has faded, so
memory is bounded and every word of a text is labelled.

Defined results: null texts and texts without a letter are ``und`` with score
0; an id that is null is not held out and never trains; repeated rows get
equal results; without any labelled row everything is ``und``; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordCodes, one_per_worker, slices, whole_text

UNDETERMINED = "und"
#: Training documents per label (about; chosen by the hash of their id) and characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
#: Training sequences, their words, passes over them, and sequences in a step.
SEQUENCES, LENGTH, PASSES, STEP = 6_000, 48, 6, 250
#: Hash buckets of the features; words seen so often in the sample form the lexicon.
BUCKET_BITS, LEXICON_LEAST = 18, 3
#: Words of a run and of its context on either side.
RUN, CONTEXT = 64, 8

_WORD = re.compile(r"[^\W\d_]+")
#: Longest word in letters: a longer run (as in scripts without blanks) is cut into words of that length.
_WIDTH = 20


def words_of(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    if max(map(len, words), default=0) > _WIDTH:
        words = [w[a:a + _WIDTH] for w in words for a in range(0, len(w), _WIDTH)]
    return words


def has_letter(words: list[str]) -> bool:
    return any(w[0].isalpha() or any(map(str.isalpha, w)) for w in words)


def held_out(id_column: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word: (bucket ids, word numbers), grouped by word.

    Prefixes and suffixes of 1 to 3 characters, all bigrams and trigrams with
    the word's edges, and the word itself if it is in the lexicon."""
    marked = ["\x02" + w + "\x03" for w in words]
    m = np.array(marked, dtype=f"<U{_WIDTH + 2}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    n = np.array([len(w) for w in marked])
    row = np.arange(len(words))
    mul = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - BUCKET_BITS)

    def bucket(kind: int, *chars: np.ndarray) -> np.ndarray:
        h = np.full(chars[0].shape, kind, np.uint64)
        for c in chars:
            h = (h ^ c) * mul
            h ^= h >> np.uint64(29)
        return ((h * mul) >> shift).astype(np.int64)

    ids, at = [], []
    for size in (2, 3):  # n-grams; those with the edge marks are prefixes and suffixes of 1 and 2
        for i in range(m.shape[1] - size + 1):
            rows = row[n >= i + size]
            if not len(rows):
                break
            ids.append(bucket(size, *(m[rows, i + j] for j in range(size))))
            at.append(rows)
    long = row[n >= 5]  # prefix and suffix of 3
    ids.append(bucket(4, m[long, 1], m[long, 2], m[long, 3]))
    at.append(long)
    ids.append(bucket(5, m[long, n[long] - 4], m[long, n[long] - 3], m[long, n[long] - 2]))
    at.append(long)
    known = np.array([i for i, w in enumerate(words) if w in lexicon], np.int64)
    if len(known):
        h = np.zeros(len(known), np.uint64)
        for j in range(m.shape[1]):
            h = np.where(j < n[known], (h ^ m[known, j]) * mul, h)
        ids.append(bucket(6, h))
        at.append(known)
    ids, at = np.concatenate(ids), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return ids[order], at[order]


@dataclass
class Model:
    """Feature weights (buckets x labels), transition weights (from x to), labels, lexicon."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: frozenset[str]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of every label for every word."""
        ids, at = features(words, self.lexicon)
        starts = np.searchsorted(at, np.arange(len(words)))
        return np.add.reduceat(self.weights[ids], starts, axis=0)


def forward_backward(e: np.ndarray, real: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posteriors (rows x positions x labels) of emission scores ``e``; positions
    that aren't ``real`` (padding at either end of a row) are passed over."""
    rows, length, labels = e.shape
    local = np.exp(e - e.max(axis=2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    ahead = np.empty_like(local)
    state, begun = np.full((rows, labels), 1.0 / labels, e.dtype), np.zeros(rows, bool)
    for t in range(length):
        now = np.where(begun[:, None], state @ step, 1.0) * local[:, t]
        now /= now.sum(axis=1, keepdims=True)
        state = np.where(real[:, t, None], now, state)
        begun |= real[:, t]
        ahead[:, t] = state
    back = np.full((rows, labels), 1.0 / labels, e.dtype)
    for t in range(length - 1, -1, -1):
        p = ahead[:, t] * back
        ahead[:, t] = p / p.sum(axis=1, keepdims=True)
        b = (local[:, t] * back) @ step.T
        back = np.where(real[:, t, None], b / b.sum(axis=1, keepdims=True), back)
    return ahead


def train(texts: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Fit on (text, label) pairs by AdaGrad on the conditional log-likelihood."""
    by_label: dict[str, list[list[str]]] = {}
    for text, label in texts:
        words = words_of(text)
        if has_letter(words):
            by_label.setdefault(label, []).append(words)
    if not by_label:
        return None
    labels, rng = sorted(by_label), np.random.default_rng(seed)
    seen = Counter(w for docs in by_label.values() for d in docs for w in d)
    lexicon = frozenset(w for w, n in seen.items() if n >= LEXICON_LEAST)
    model = Model(labels, np.zeros((1 << BUCKET_BITS, len(labels)), np.float32), np.zeros((len(labels),) * 2, np.float32), lexicon)
    if len(labels) == 1:
        return model
    sequences, gold = [], []
    for _ in range(SEQUENCES):
        words, tags = [], []
        while len(words) < LENGTH:
            k = int(rng.integers(len(labels)))
            docs = by_label[labels[k]]
            doc = docs[int(rng.integers(len(docs)))]
            size = int(rng.integers(4, LENGTH + 1))
            start = int(rng.integers(max(1, len(doc) - size + 1)))
            piece = doc[start:start + size]
            words += piece
            tags += [k] * len(piece)
        sequences.append(words[:LENGTH])
        gold.append(tags[:LENGTH])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
    ids, at = features(list(vocabulary), lexicon)
    starts = np.searchsorted(at, np.arange(len(vocabulary) + 1))
    x = np.array([[vocabulary[w] for w in s] for s in sequences])
    y, n = np.array(gold), len(labels)
    g2, t2 = np.full_like(model.weights, 1e-4), np.full_like(model.transitions, 1e-4)
    real, eye = np.ones((STEP, LENGTH), bool), np.eye(n, dtype=np.float32)
    for _ in range(PASSES):
        for some in np.split(rng.permutation(SEQUENCES), SEQUENCES // STEP):
            words, where = np.unique(x[some], return_inverse=True)
            f = np.concatenate([ids[starts[w]:starts[w + 1]] for w in words])
            owner = np.repeat(np.arange(len(words)), starts[words + 1] - starts[words])
            first = np.searchsorted(owner, np.arange(len(words)))
            e = np.add.reduceat(model.weights[f], first, axis=0)[where.reshape(x[some].shape)]
            post = forward_backward(e, real, model.transitions)
            wrong = (post - eye[y[some]]).reshape(-1, n)
            per_word = np.stack([np.bincount(where.ravel(), wrong[:, k], len(words)) for k in range(n)], axis=1)
            used, slot = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(slot, per_word[owner, k], len(used)) for k in range(n)], axis=1).astype(np.float32) / STEP
            g2[used] += grad**2
            model.weights[used] -= 0.1 * grad / np.sqrt(g2[used])
            # expected less observed transitions
            local = np.exp(e - e.max(axis=2, keepdims=True))
            pair = post[:, :-1, :, None] * (np.exp(model.transitions)[None, None] * (local * 1.0)[:, 1:, None, :])
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            seen_pairs = np.bincount((y[some][:, :-1] * n + y[some][:, 1:]).ravel(), minlength=n * n).reshape(n, n)
            dt = ((pair.sum(axis=(0, 1)) - seen_pairs) / STEP).astype(np.float32)
            t2 += dt**2
            model.transitions -= 0.1 * dt / np.sqrt(t2)
    return model


def training_sample(documents: DataFrame, id_column: str, text_column: str, label_column: str) -> list[tuple[str, str]]:
    """A bounded sample of labelled texts, the same number from each label if there are enough."""
    docs = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"),
                            F.col(label_column).cast("string").alias("label"))
    docs = docs.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    counts = docs.groupBy("label").count().collect()  # one row per label
    if not counts:
        return []
    # ids whose hash lies below the label's rate: about SAMPLE_DOCS of each label, whatever its size
    rates = [(r["label"], int(-(1 << 63) + min(1.0, SAMPLE_DOCS / r["count"]) * (1 << 64)) - 1) for r in counts]
    below = F.broadcast(documents.sparkSession.createDataFrame([(k, min(x, (1 << 63) - 1)) for k, x in rates], "label string, below bigint"))
    texts = docs.join(below, "label").where(F.xxhash64("id") <= F.col("below")).select(
        "id", "label", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    # a repeated id may bring more rows: the smallest text counts
    rows = texts.groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    return sorted((r["text"], r["label"]) for r in rows)


def fit(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model | None:
    return train(training_sample(documents, id_column, text_column, label_column))


class Labeller:
    """Applies a model to texts inside a task; emissions are computed once per distinct word."""

    def __init__(self, model: Model):
        self.model, self.n = model, len(model.labels)
        self.cache = WordCodes(self._emit, dtype=np.float32)

    def _emit(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.model.emissions(words[a:a + 50_000]) for a in range(0, len(words), 50_000)]
        return np.concatenate(got).ravel(), np.full(len(words), self.n)

    def posteriors(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(posteriors of all words, document number of each word)."""
        counts = np.array([len(d) for d in docs], np.int64)
        codes = self.cache.lookup([w for d in docs for w in d])
        emissions = self.cache.values.reshape(-1, self.n)
        doc = np.repeat(np.arange(len(docs)), counts)
        ends = np.cumsum(counts)
        out = np.empty((len(codes), self.n), np.float32)
        runs = -(-counts // RUN)
        first = np.repeat(ends - counts, runs) + (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
        low, high = np.repeat(ends - counts, runs), np.repeat(ends, runs)
        order = np.argsort(np.minimum(high - first, RUN), kind="stable")  # rows of like length together
        for a in range(0, len(order), 4_096):
            rows = order[a:a + 4_096]
            size = int(min(RUN, (high[rows] - first[rows]).max()))
            at = first[rows, None] + np.arange(-CONTEXT, size + CONTEXT)
            real = (at >= low[rows, None]) & (at < high[rows, None])
            e = emissions[codes[np.where(real, at, 0)]]
            p = forward_backward(e, real, self.model.transitions)[:, CONTEXT:CONTEXT + size]
            own = real[:, CONTEXT:CONTEXT + size]
            out[at[:, CONTEXT:CONTEXT + size][own]] = p[own]
        return out, doc

    def label(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """Label, score, and certainty (the mean over words of the largest posterior) of each text."""
        found: list[tuple[str, float, float]] = []
        for a, b in slices(texts):
            docs = [words_of(t) for t in texts[a:b]]
            docs = [d if has_letter(d) else [] for d in docs]
            post, doc = self.posteriors(docs)
            mass = np.stack([np.bincount(doc, post[:, k], len(docs)) for k in range(self.n)], axis=1)
            total = mass.sum(axis=1)
            top = mass.argmax(axis=1)
            sure = np.bincount(doc, post.max(axis=1), len(docs))
            found += [(self.model.labels[k], float(min(1.0, m[k] / s)), float(min(1.0, c / s))) if d else (UNDETERMINED, 0.0, 0.0)
                      for d, k, m, s, c in zip(docs, top, mass, total, sure, strict=True)]
        return found


def task_labeller(model: Model) -> Labeller:
    """One labeller, and so one bounded cache, for all tasks of a Python worker
    (which keeps a broadcast value between tasks)."""
    return one_per_worker("labeller", model, lambda: Labeller(model))


def _labelled(batches, model, text_at):
    """Batches with label, score and certainty of their rows; without a model every text is undetermined."""
    labeller = task_labeller(model) if model else None
    for batch in batches:
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        got = labeller.label(texts) if labeller else [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        yield batch, *(pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64())))


def identify(documents: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels weights, whatever the data
    kind = dict(documents.dtypes)[id_column]

    def run(batches):
        for batch, lang, score, _ in _labelled(batches, shipped.value, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, score], ["doc_id", "lang_pred", "score"])

    return (documents.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, lang_pred string, score double"))


def keep_identified(documents: DataFrame, model: Model | None, least_certainty: float = 0.4, text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` whose text has a letter and whose words are labelled with at
    least this certainty on average, whatever number of languages they are in. Without a
    model (no labelled row to learn from) the letter alone decides."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_column)

    def run(batches):
        if shipped.value is None:
            for batch in batches:
                yield batch.filter(pa.array([has_letter(words_of(t or "")) for t in batch.column(at).to_pylist()], pa.bool_()))
            return
        for batch, lang, _, certainty in _labelled(batches, shipped.value, at):
            good = [x != UNDETERMINED and c >= least_certainty for x, c in zip(lang.to_pylist(), certainty.to_pylist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
