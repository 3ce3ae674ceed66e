"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file:

* the normaliser (blanks to the meta symbol, dummy prefix, and collapsed blanks
  if the model asks for them);
* the pieces, a trie whose final states put out a piece id;
* byte fallback, an arc for a character that no piece covers, which puts out
  the ids of its UTF-8 bytes.

Composed with an input they give a lattice whose states are text positions;
the encoding is its shortest path in the tropical semiring. A unigram model's
weights are the pieces' negative scores. A byte-pair model is a bigram-weighted
machine: an arc costs 0 after a piece with which it is merge-consistent and
infinity otherwise. Two neighbours are consistent if merging the characters of
both by rank never merges across their joint; a sequence is what the merges
produce exactly if all its neighbours are consistent, so one path stays finite.

Inputs are cut where no piece can span (before a blank, around line ends), each
distinct unit is composed once per slice, and ids are strung together, so long
texts cost no more memory than their ids.

Defined results: null texts are empty and give no ids; characters outside the
model go to bytes, or to the unknown id without byte fallback; decoding drops
the dummy prefix, and control ids give nothing; rows are mapped one to one, so
repeated rows and extra columns need no rule; empty tables give empty results.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCodes, by_document, file_bytes, one_per_worker, slices, whole_text

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Characters between which a cut is tried: letters and digits on one side, marks on the other.
LETTERS = [chr(c) for c in range(0x30, 0x250) if chr(c).isalnum()]
MARKS = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
#: Merge consistency of so many pairs is remembered in a task.
PAIRS = 1_500_000


def _fields(data: bytes):
    """(number, value) of a protobuf message's fields; nested messages stay bytes."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at:at + size]
            at += size


class Fst:
    """The compiled machines of one model."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normaliser = {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.type = trainer.get(3, UNIGRAM)
        if self.type not in (UNIGRAM, BPE) or trainer.get(24, 0):
            raise ValueError("only unigram and byte-pair models with blanks as prefixes are compiled")
        if normaliser.get(2) or USER in self.kinds:
            raise ValueError("character maps and user-defined symbols are not compiled")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.collapse = bool(normaliser.get(4, 1))
        self.meta = BLANK if normaliser.get(5, 1) else " "
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.trie: dict = {}
        if self.type == BPE:
            self._compile_merges()
        for piece, i in self.ids.items():
            if self.type == BPE and i not in self.right_edge:
                continue  # a piece that its own merges never produce
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self._compile_units()
        self._compile_surface()

    # --- compiling ---------------------------------------------------------------

    def _compile_units(self):
        """Where inputs may be cut: joints that no piece spans. Before a blank that
        follows something else, around characters of no piece, and between letters
        and marks, each only as far as the pieces bear it out."""
        joints = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        chars = {c for p in self.ids for c in p}
        meta, stop = re.escape(self.meta), self.meta + "".join(c for c in "\n\t\r" if c not in chars)
        if any(j[1] == self.meta and j[0] != self.meta for j in joints):
            self.unit = re.compile(r"(?s).+")
            return
        letters = [c for c in LETTERS if c in chars]
        marks = [c for c in MARKS if not any(c + x in joints or x + c in joints for x in letters)]
        inner, end = f"[^{re.escape(stop)}]", rf"(?=[{re.escape(stop)}]|\Z)"
        parts = []
        if letters and marks:
            some, others = f"[{''.join(map(re.escape, letters))}]", f"[{''.join(map(re.escape, marks))}]"
            parts = [rf"{meta}*{some}+(?:(?={others})|{end})", rf"{meta}*{others}+(?:(?={some})|{end})"]
        parts += [rf"{meta}*{inner}+", rf"{meta}+"] + ([f"[{re.escape(stop[1:])}]"] if stop[1:] else [])
        self.unit = re.compile("|".join(parts))

    def _compile_surface(self):
        """What each id decodes to, in bytes."""
        self.surface = []
        for piece, kind in zip(self.pieces, self.kinds, strict=True):
            if kind == BYTE:
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                self.surface.append(b"")
            elif kind == UNKNOWN:
                self.surface.append(" ⁇ ".encode())
            else:
                self.surface.append(piece.replace(BLANK, " ").encode())

    def _merge_last(self, piece: str) -> tuple[str, str] | None:
        """The two parts that a piece's own merges join last; None if they don't end in it."""
        parts = list(piece)
        while len(parts) > 2:
            best = None
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.scores[j] > best[0]):
                    best = (self.scores[j], i)
            if best is None:
                return None
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _compile_merges(self):
        """For every piece its edges: what stands at its left and right end while it is
        being merged, with the times at which each appears and is consumed."""
        split = {p: self._merge_last(p) for p in self.ids if len(p) > 1}
        self.reachable = {p for p in self.ids if len(p) == 1 or split[p] is not None}
        born: dict[str, float] = {}

        def time(p: str) -> float:
            if p not in born:
                parts = split.get(p)
                born[p] = -1.0 if not parts else max(-self.scores[self.ids[p]], time(parts[0]), time(parts[1]))
            return born[p]

        def edge(p: str, side: int) -> list[tuple[str, float, float]]:
            out, dies = [], float("inf")
            while True:
                out.append((p, time(p), dies))
                parts = split.get(p)
                if not parts:
                    return out
                p, dies = parts[side], time(p)

        for p in sorted(self.reachable, key=len):
            time(p)
        self.left_edge = {self.ids[p]: edge(p, 0) for p in self.reachable}
        self.right_edge = {self.ids[p]: edge(p, 1) for p in self.reachable}
        self.pairs: dict[int, bool] = {}

    # --- the lattice ---------------------------------------------------------------

    def consistent(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b never merges across their joint."""
        for x, x_born, x_dies in self.right_edge[a]:
            for y, y_born, y_dies in self.left_edge[b]:
                merged = self.ids.get(x + y)
                if merged is not None:
                    at = max(-self.scores[merged], x_born, y_born)
                    if at < x_dies and at <= y_dies:  # of equal ranks the left one comes first
                        return False
        return True

    def _fallback(self, char: str) -> list[int]:
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in char.encode("utf-8")]

    def _path_bpe(self, unit: str) -> list[int]:
        """The finite path, composed lazily: all finite arcs cost 0, so the first path
        found is a shortest one. Longer pieces are tried first; the finite path to a
        position is unique, so a position from which nothing led on stays closed."""
        n, root, pairs, base = len(unit), self.trie, self.pairs, len(self.pieces)
        if len(pairs) > PAIRS:
            pairs.clear()
        trail: list[tuple[int, int | None, list]] = []  # position, piece before it, arcs not yet tried
        closed: set[int] = set()
        out: list[int | None] = []
        s, last, arcs = 0, None, None
        while s < n:
            if arcs is None:
                arcs, node, e = [], root.get(unit[s]), s + 1
                if node is None or "" not in node:  # no piece for this character alone
                    arcs.append((e, None))
                while node is not None:
                    i = node.get("")
                    if i is not None:
                        arcs.append((e, i))
                    if e == n:
                        break
                    node = node.get(unit[e])
                    e += 1
            while arcs:
                e, i = arcs.pop()
                if e in closed:
                    continue
                if last is not None and i is not None:
                    key = last * base + i
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = self.consistent(last, i)
                    if not ok:
                        continue
                trail.append((s, last, arcs))
                out.append(i)
                s, last, arcs = e, i, None
                break
            else:
                if not trail:
                    raise ValueError(f"no finite path through {unit[:40]!r}")
                closed.add(s)
                s, last, arcs = trail.pop()
                out.pop()
        if None not in out:
            return out
        ids: list[int] = []
        for (start, _, _), i in zip(trail, out, strict=True):
            ids += [i] if i is not None else self._fallback(unit[start])
        return ids

    def _path_unigram(self, unit: str) -> list[int]:
        n, far = len(unit), float("inf")
        cost, piece_at, start_at = [0.0] + [far] * n, [None] * (n + 1), [-1] * (n + 1)
        unknown = 10.0 - min((s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL), default=0.0)
        for s in range(n):
            node, e = self.trie.get(unit[s]), s + 1
            if (node is None or "" not in node) and cost[s] + unknown < cost[e]:
                cost[e], piece_at[e], start_at[e] = cost[s] + unknown, None, s
            while node is not None:
                i = node.get("")
                if i is not None and cost[s] - self.scores[i] < cost[e]:
                    cost[e], piece_at[e], start_at[e] = cost[s] - self.scores[i], i, s
                if e == n:
                    break
                node = node.get(unit[e])
                e += 1
        return self._back(unit, piece_at, start_at)

    def _back(self, unit: str, piece_at: list, start_at: list[int]) -> list[int]:
        if unit and start_at[len(unit)] < 0:
            raise ValueError(f"no finite path through {unit[:40]!r}")
        out, e = [], len(unit)
        while e:
            s = start_at[e]
            out.append([piece_at[e]] if piece_at[e] is not None else self._fallback(unit[s:e]))
            e = s
        return [i for part in reversed(out) for i in part]

    def path(self, unit: str) -> list[int]:
        """Ids on the shortest path of a normalised unit; a run of unknown characters is one unknown id."""
        ids = self._path_bpe(unit) if self.type == BPE else self._path_unigram(unit)
        if not self.byte_ids and self.unknown in ids:
            ids = [i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != self.unknown]
        return ids

    # --- whole texts ------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        if self.collapse:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", self.meta)

    def units(self, text: str) -> list[str]:
        return self.unit.findall(self.normalise(text))

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, as the library gives it: a replacement character for each byte that isn't
        part of a character, and no leading blank in the first piece that has a text."""
        if not ids:
            return ""
        first = ids[0]
        try:  # most often all bytes are whole characters and the first piece is an ordinary one
            if self.kinds[first] in (NORMAL, USER) and (self.surface[first] != b" " or not self.collapse):
                text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8")
                return text[1:] if (self.dummy_prefix or self.collapse) and text.startswith(" ") else text
        except UnicodeDecodeError:
            pass
        parts: list[str] = []
        run, begins, stripped = bytearray(), True, False
        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.surface[i]
                continue
            if run:
                parts.append(run.decode("utf-8", "one-for-each-byte"))
                run.clear()
            if begins:
                begins = not stripped and not any(parts)
            piece = self.surface[i].decode()
            stripped = False
            if begins and self.kinds[i] in (NORMAL, USER) and (self.dummy_prefix or self.collapse) and piece.startswith(" "):
                piece, stripped = piece[1:], not self.collapse
            parts.append(piece)
        out = "".join(parts)
        return out + run.decode("utf-8", "one-for-each-byte") if run else out


codecs.register_error("one-for-each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Encoder:
    """Encodes texts inside a task; each distinct unit of a slice is composed once."""

    def __init__(self, fst: Fst):
        self.fst = fst
        self.cache = WordCodes(self._paths, dtype=np.int32)

    def _paths(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.fst.path(u) for u in units]
        return np.fromiter((i for g in got for i in g), np.int64), np.array([len(g) for g in got], np.int64)

    def encode(self, texts: list[str]):
        for a, b in slices(texts):
            docs = [self.fst.units(t) for t in texts[a:b]]
            ids, lengths = self.cache.flat(self.cache.lookup([u for d in docs for u in d]))
            n = by_document(lengths, np.array([len(d) for d in docs], np.int64))
            ends = np.cumsum(n)
            for start, end in zip(ends - n, ends, strict=True):
                yield ids[start:end].astype(np.int32)


def task_encoder(fst: Fst) -> Encoder:
    """One encoder, and so one bounded cache, for all tasks of a Python worker
    (which keeps a broadcast value between tasks)."""
    return one_per_worker("piece-encoder", fst, lambda: Encoder(fst))


def compile_model(path: str) -> Fst:
    return Fst(file_bytes(path))


def encode(documents: DataFrame, fst: Fst, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)
    and round_trip (whether the ids decode to the text) of every row; ``with_ids=False``
    leaves the ids in the tasks."""
    shipped = documents.sparkSession.sparkContext.broadcast(fst)  # bounded by the vocabulary
    kind = dict(documents.dtypes)[id_column]

    def run(batches):
        encoder = task_encoder(shipped.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = list(encoder.encode(texts[a:b]))
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                same = [shipped.value.decode(x.tolist()) == t for x, t in zip(ids, texts[a:b], strict=True)]
                columns = [batch.column(0).slice(a, b - a)] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []) + [
                    pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id"] + ["ids"] * with_ids + ["n_tokens", "ids_crc32", "round_trip"]
    schema = f"doc_id {kind}, " + "ids array<int>, " * with_ids + "n_tokens bigint, ids_crc32 bigint, round_trip boolean"
    return documents.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, fst: Fst, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id and text of every row; null ids decode to an empty text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(fst)
    kind = dict(encoded.dtypes)[id_column]

    def run(batches):
        for batch in batches:
            texts = [shipped.value.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_column).alias("doc_id"), F.col(ids_column).alias("ids")).mapInArrow(
        run, f"doc_id {kind}, text string")
