"""Personal data by base patterns and a skip-chain conditional random field.

Base spans of every whole text: ``email``, ``ip`` (parts at most 255), ``card``
(14 to 19 digits that pass Luhn) and ``phone`` (10 to 15 digits), leftmost and
non-overlapping per kind, failing matches dropped. All scans are linear.

The field adds what the patterns miss (a number repeated without its prefix or
with other separators, a mailbox name without its host). Its nodes are the
tokens that may belong to an entity: runs of mail and number characters with a
digit or an ``@``, and dotted names equal to a mailbox of the text. All other
words are surely outside, so chains split there and inference is exact to do
without them. Potentials:

* shape, length, check-digit and neighbouring-word features of a token;
* transitions between adjacent tokens and to the outside;
* skip edges between successive tokens of a document that are the same, have
  the same last digits, or share a mailbox: equal labels are rewarded, so what
  one occurrence shows is passed on to all of its repeats.

Loopy sum-product passes messages over chains and skip edges for ``ROUNDS``
rounds; tokens of base spans are held at their label. A free token whose
posterior for a label reaches ``SURE`` becomes (with its neighbours of the same
label) a span ``crf_email``, ``crf_ip``, ``crf_card`` or ``crf_phone``, unless
it touches a base span.

Training needs no labels but the base spans: in a bounded sample (about
``SAMPLE_DOCS`` documents with tokens, those of at most ``SAMPLE_TOKENS``) half
of the tokens are freed, some of them without their features, and the weights
follow the gradient of their log-likelihood given the rest.

Defined results: a null text is empty and has no spans; rows are mapped one to
one, so repeated rows and extra columns need no rule; where no sampled token
lies in a base span there is no field and only base spans are found; an empty
table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["crf_" + k for k in KINDS]
#: Outside, then the kinds.
LABELS = len(KINDS) + 1
SAMPLE_DOCS, SAMPLE_TOKENS = 2_000, 200
#: Buckets of hashed features, message rounds, passes of the training, posterior of an added span.
BUCKETS, ROUNDS, PASSES, SURE = 1 << 14, 12, 60, 0.95
#: What agreement along a skip edge is worth before training (kinds of edges that the sample lacks keep it).
AGREE = 2.0
#: Tokens of documents that are inferred together.
NODES = 40_000
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

# --- base spans -------------------------------------------------------------------

_MAILBOX, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
_EMAIL_HERE = re.compile(rf"{_MAILBOX}++@{_HOST}++(?:\.{_HOST}++)++")
_EMAIL = re.compile(rf"(?<!{_MAILBOX}){_EMAIL_HERE.pattern}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OTHER = re.compile(r"[^0-9]+")
_ANY = re.compile(r"[0-9@]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _EMAIL_HERE.match(text, at) or _EMAIL.search(text, at):
        at = m.end()
        yield m.span()


def _octets(text: str) -> bool:
    return all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in text.split("."))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in order."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if _octets(m[0]):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _OTHER.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_OTHER.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- the graph of a text ------------------------------------------------------------

_IN = r"A-Za-z0-9@._%+\-"
_TOKEN = re.compile(rf"(?<![{_IN}])[A-Za-z._%+\-]*+[0-9@][{_IN}]*+")
_NAME = re.compile(rf"(?<![{_IN}])[A-Za-z]++(?:[._-][A-Za-z]++)++(?![{_IN}])")
_BEFORE, _AFTER = re.compile(r"(\w+)\W{0,4}\Z"), re.compile(r"\W{0,4}(\w+)")
_ENDS = "._%+-"
#: Most characters between adjacent tokens of an entity, and of a token's outside that features see.
GAP, VIEW = 3, 24
#: Kinds of skip edges: the same token, the same last digits, a shared mailbox.
SAME, DIGITS, MAILBOX = range(3)
#: Last digits that make two tokens alike.
TAIL = 7


@dataclass
class Graph:
    """Tokens of a text (or of several): offsets, feature buckets grouped by token, the
    base label or -1, whether the outside is next to them, and edges (from, to, kind);
    kind -1 is the chain."""

    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    owner: np.ndarray
    base: np.ndarray
    outside: np.ndarray
    edges: np.ndarray


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def _features(text: str, a: int, b: int) -> list[int]:
    token = text[a:min(b, a + 64)]
    digits = _OTHER.sub("", text[a:b])
    n = len(digits)
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "0", token))[:16]
    names = ["bias", f"n{n if n < 20 else 20}", f"dots{min(token.count('.'), 4)}", f"shape{shape}", f"at{'@' in token}",
             f"letters{any(c.isalpha() for c in token)}", f"first{text[a - 1:a] if a else ''}", f"next{text[b:b + 1]}"]
    if 13 <= n <= 19:
        names.append(f"luhn{luhn(digits)}")
    if token.count(".") == 3 and n <= 12 and n + 3 == b - a:
        names.append(f"octets{_octets(token) if all(token.split('.')) else None}")
    if m := _BEFORE.search(text, max(0, a - VIEW), a):
        names.append(f"before {m[1].lower()}")
    if m := _AFTER.match(text, b, b + VIEW):
        names.append(f"after {m[1].lower()}")
    return [_bucket(x) for x in names]


def read(text: str, base: list[tuple[int, int, int]]) -> Graph | None:
    """The graph of a text; None if it has no token."""
    tokens = []
    mailboxes = set()
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in _ENDS:
            b -= 1
        while a < b and text[a] in "._%-":
            a += 1
        tokens.append((a, b))
        box = text[a:b].partition("@")[0].lower()
        if len(box) < b - a and len(box) >= 6 and any(c in box[1:-1] for c in "._-"):
            mailboxes.add(box)
    if any(box.replace(".", "a").replace("_", "a").replace("-", "a").isalpha() for box in mailboxes):
        tokens += [m.span() for m in _NAME.finditer(text) if m[0].lower() in mailboxes]
        tokens.sort()
    if not tokens:
        return None
    start, end = np.array(tokens, np.int64).T
    label = np.full(len(tokens), -1, np.int64)
    for a, kind, b in reversed(base):  # of overlapping spans the first kind of the earliest counts
        label[np.searchsorted(end, a, "right"):np.searchsorted(start, b, "left")] = kind + 1
    near = start[1:] - end[:-1] <= GAP
    # a line end or a word between them parts two tokens
    near &= np.array([not re.search(r"[\w\n]", text[x:y]) if close else False for x, y, close in zip(end[:-1], start[1:], near, strict=True)], bool)
    edges = [(int(i), int(i) + 1, -1) for i in np.flatnonzero(near)]
    last: dict[tuple, int] = {}
    for i, (a, b) in enumerate(tokens):
        token = text[a:b].lower()
        digits = _OTHER.sub("", token)
        keys = [(SAME, token)] if b - a >= 5 else []
        if len(digits) >= TAIL:
            keys.append((DIGITS, digits[-TAIL:]))
        if (box := token.partition("@")[0]) in mailboxes:
            keys.append((MAILBOX, box))
        linked = set()
        for key in keys:
            j = last.get(key)
            if j is not None and j not in linked:
                linked.add(j)
                edges.append((j, i, key[0]))
            last[key] = i
    feats = [_features(text, a, b) for a, b in tokens]
    outside = np.stack([~np.append(False, near), ~np.append(near, False)], axis=1)
    return Graph(start, end, np.array([f for x in feats for f in x]), np.repeat(np.arange(len(feats)), [len(x) for x in feats]),
                 label, outside, np.array(edges, np.int64).reshape(-1, 3))


def joined(graphs: list[Graph]) -> Graph:
    """One graph of several that share no edge."""
    first = np.cumsum([0] + [len(g.start) for g in graphs])[:-1]
    shift = [np.array([n, n, 0]) for n in first]
    return Graph(*(np.concatenate([getattr(g, x) for g in graphs]) for x in ("start", "end", "features")),
                 np.concatenate([g.owner + n for g, n in zip(graphs, first, strict=True)]),
                 *(np.concatenate([getattr(g, x) for g in graphs]) for x in ("base", "outside")),
                 np.concatenate([g.edges + s for g, s in zip(graphs, shift, strict=True)]))


# --- the field ------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of features, of transitions, of the outside on either side, and of skip
    edges by kind (for two tokens outside, and for two of the same entity)."""

    weights: np.ndarray
    chain: np.ndarray
    outside: np.ndarray
    skip: np.ndarray

    @classmethod
    def blank(cls) -> Field:
        return cls(np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((2, LABELS)), np.full((3, 2), AGREE))

    def local(self, g: Graph, bare: np.ndarray | None = None) -> np.ndarray:
        """Scores of labels; ``bare`` tokens are seen without their features."""
        w = self.weights[g.features]
        if bare is not None:
            w = np.where(bare[g.owner][:, None], 0.0, w)
        return np.stack([np.bincount(g.owner, w[:, k], len(g.start)) for k in range(LABELS)], axis=1) + g.outside @ self.outside

    def pair(self, kinds: np.ndarray) -> np.ndarray:
        """Scores (edges x labels x labels)."""
        skips = np.zeros((3, LABELS, LABELS))
        for k in range(3):
            np.fill_diagonal(skips[k], self.skip[k, 1])
            skips[k, 0, 0] = self.skip[k, 0]
        return np.concatenate([skips, self.chain[None]])[kinds]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def infer(local: np.ndarray, held: np.ndarray, edges: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of tokens (by label) and of edges (by both labels) by loopy
    sum-product; ``held`` is a token's known label, or -1."""
    local = local.copy()
    known = np.flatnonzero(held >= 0)
    local[known] = -50.0
    local[known, held[known]] = 0.0
    a, b, e = edges[:, 0], edges[:, 1], len(edges)
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    scores = np.concatenate([pair, pair.transpose(0, 2, 1)])
    message = np.zeros((2 * e, LABELS))
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])

    def belief() -> np.ndarray:
        return local + np.stack([np.bincount(target, message[:, k], len(local)) for k in range(LABELS)], axis=1) if e else local

    for _ in range(ROUNDS if e else 0):
        out = _log_sum((belief()[source] - message[back])[:, :, None] + scores, 1)
        out -= _log_sum(out, 1)[:, None]
        message = 0.3 * message + 0.7 * out
    total = belief()
    nodes = np.exp(total - _log_sum(total, 1)[:, None])
    both = (total[a] - message[e:])[:, :, None] + (total[b] - message[:e])[:, None, :] + pair
    both = both - both.max(axis=(1, 2), keepdims=True) if e else both
    both = np.exp(both)
    return nodes, both / both.sum(axis=(1, 2), keepdims=True) if e else both


def train(graphs: list[Graph], seed: int = 3) -> Field | None:
    """Weights by AdaGrad on the freed tokens' likelihood; None without a token in a base span."""
    if not graphs:
        return None
    g = joined(graphs)
    gold = np.maximum(g.base, 0)
    if not gold.any():
        return None
    rng, field = np.random.default_rng(seed), Field.blank()
    parts = [field.weights, field.chain, field.outside, field.skip]
    sums = [np.full_like(p, 1e-3) for p in parts]
    target, kinds = np.eye(LABELS)[gold], g.edges[:, 2]
    ea, eb = gold[g.edges[:, 0]], gold[g.edges[:, 1]]
    both_gold = np.zeros((len(g.edges), LABELS, LABELS))
    both_gold[np.arange(len(g.edges)), ea, eb] = 1
    for _ in range(PASSES):
        free = (rng.random(len(gold)) < 0.5) | (gold == 0) & (rng.random(len(gold)) < 0.5)
        bare = free & (rng.random(len(gold)) < 0.3)
        nodes, both = infer(field.local(g, bare), np.where(free, -1, gold), g.edges, field.pair(kinds))
        wrong = np.where(free[:, None], nodes - target, 0.0)
        shown = np.where(bare[g.owner][:, None], 0.0, wrong[g.owner])
        pairs = both - both_gold
        chain = kinds < 0
        agree = np.stack([pairs[:, 0, 0], pairs[:, range(1, LABELS), range(1, LABELS)].sum(axis=1)], axis=1)
        grads = [np.stack([np.bincount(g.features, shown[:, k], BUCKETS) for k in range(LABELS)], axis=1), pairs[chain].sum(axis=0),
                 g.outside.T.astype(float) @ wrong, np.stack([agree[kinds == k].sum(axis=0) for k in range(3)])]
        for p, s, grad, usual in zip(parts, sums, grads, (0.0, 0.0, 0.0, AGREE), strict=True):
            grad = grad + 0.02 * (p - usual)
            s += grad**2
            p -= 0.5 * grad / np.sqrt(s)
    return field


def added_spans(graphs: list[Graph], field: Field) -> list[list[tuple[int, int, int, float]]]:
    """(start, number of the kind, end, posterior) of each graph's spans beyond the base ones."""
    g = joined(graphs)
    nodes, _ = infer(field.local(g), g.base, g.edges, field.pair(g.edges[:, 2]))
    label = nodes[:, 1:].argmax(axis=1)
    score = nodes[np.arange(len(label)), label + 1]
    new = (g.base < 0) & (score >= SURE)
    out, at = [], 0
    for one in graphs:
        n, spans, before = len(one.start), [], -2
        for i in np.flatnonzero(new[at:at + n]):
            a, k, b, s = int(one.start[i]), int(label[at + i]), int(one.end[i]), float(score[at + i])
            if before == i - 1 and not one.outside[i, 0] and spans[-1][1] == k:
                spans[-1] = (spans[-1][0], k, b, min(s, spans[-1][3]))
            else:
                spans.append((a, k, b, s))
            before = i
        out.append(spans)
        at += n
    return out


class Finder:
    """All spans of texts, by a field or (None) by base patterns alone."""

    def __init__(self, field: Field | None):
        self.field = field

    def find(self, texts: list[str]) -> list[list[dict]]:
        found, waiting, nodes = [], [], 0
        for i, text in enumerate(texts):
            base = base_spans(text) if _ANY.search(text) else []
            found.append([{"kind": KINDS[k], "start": a, "end": b, "score": 1.0} for a, k, b in base])
            g = read(text, base) if self.field is not None and _ANY.search(text) else None
            if g is not None and (g.base < 0).any():
                waiting.append((i, g))
                nodes += len(g.start)
            if nodes >= NODES:
                self._add(found, waiting)
                waiting, nodes = [], 0
        if waiting:
            self._add(found, waiting)
        return found

    def _add(self, found: list[list[dict]], waiting: list[tuple[int, Graph]]) -> None:
        order = KINDS + ADDED
        for (i, _), spans in zip(waiting, added_spans([g for _, g in waiting], self.field), strict=True):
            if spans:
                base = [(s["start"], s["end"]) for s in found[i]]
                starts, ends = np.array([x[0] for x in base]), np.array([x[1] for x in base])
                # base spans of several kinds may overlap each other: compare with all of them
                free = [s for s in spans if not base or not ((starts < s[2]) & (ends > s[0])).any()]
                found[i] = sorted(found[i] + [{"kind": ADDED[k], "start": a, "end": b, "score": score} for a, k, b, score in free],
                                  key=lambda s: (s["start"], order.index(s["kind"]), s["end"]))


# --- tables -----------------------------------------------------------------------------


def fit(documents: DataFrame, text_column: str = "text") -> Field | None:
    """A field trained on a sample chosen by the hash of the text (repeats count once)."""
    texts = documents.select(F.col(text_column).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    count = texts.count()
    if not count:
        return None
    below = int(-(1 << 63) + min(1.0, SAMPLE_DOCS / count) * (1 << 64)) - 1

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                g = read(text, base_spans(text))
                if g is not None and len(g.start) <= SAMPLE_TOKENS:
                    rows.append((zlib.crc32(text.encode()), pickle.dumps(g)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["h", "g"])

    sample = texts.where(F.xxhash64("text") <= min(below, (1 << 63) - 1)).mapInArrow(run, "h bigint, g binary").distinct().orderBy("h", "g").limit(2 * SAMPLE_DOCS)
    return train([pickle.loads(r["g"]) for r in sample.collect()])


_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def scan(documents: DataFrame, field: Field | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and spans (sorted array of structs) of every row."""
    shipped = documents.sparkSession.sparkContext.broadcast(field)  # BUCKETS x LABELS weights, whatever the data
    kind = dict(documents.dtypes)[id_column]

    def run(batches):
        finder = Finder(shipped.value)
        for batch in batches:
            found = finder.find(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _ARROW)], ["doc_id", "spans"])

    return (documents.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, spans {SPANS}"))
