"""Phrase mining against a brute-force miner."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import CLASH

from tessera.llm import phrases as P


def brute(rows, least, most):
    counts, totals = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = counts.setdefault(lang, Counter())
        text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(words)
            for size in range(1, 6):
                c.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, c in counts.items():
        found = {p: f for p, f in c.items() if len(p) > 1 and f >= least}
        hidden = {p[i:i + size] for p, f in found.items() for size in range(2, len(p)) for i in range(len(p) - size + 1) if found.get(p[i:i + size]) == f}
        ranked = []
        for p, a in found.items():
            if p not in hidden:
                score, _, left, right = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, x[2].decode(), -x[1], x[3], x[4], totals[lang], -x[0]) for r, x in enumerate(sorted(ranked)[:most], 1)]
    return sorted(out)


def found(spark, rows, least, most=2_000, parts=3):
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    for c in [*CLASH, "words", "shard", "f", "k1"]:
        df = df.selectExpr("*", f"'x' as {c}")
    got = P.collocations(df.repartition(parts), least, most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "house", "été", "ÉTÉ", "日本", "new", "york", " x", "a|b"] + [f"w{i}" for i in range(20)]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, [6] * 3 + [2] * 8 + [1] * 20, k=rng.randint(0, 40))
        if rng.random() < 0.4:
            words[3:3] = "new york stock exchange opens".split()
        rows.append((rng.choice(["en", "en", "de", None]), "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r"]) for w in words)))
    return rows


def test_equals_brute_force(spark):
    rows = corpus(200, 1)
    rows += [("en", None), ("en", ""), (None, "..."), ("de", "so so so so so so so so so"), ("en", "big " * 9_000), ("en", "z" * 30_000)] + [rows[5]] * 12
    for least in (4, 9):
        assert found(spark, rows, least) == brute(rows, least, 2_000)
    assert found(spark, rows, 4, 7) == brute(rows, 4, 7)


def test_small_shards_many_languages_and_slices(spark, monkeypatch):
    rows = corpus(80, 2) + [(f"l{i % 5}", "one two three four five six") for i in range(40)]
    with_default = found(spark, rows, 5)
    assert with_default == brute(rows, 5, 2_000)

    def cut():
        df = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string").coalesce(1)
        return df

    builder = P.Builder()
    text = "Alpha beta. " * 50 + "q" * 40 + " end"
    monkeypatch.setattr(P, "SLICE_BYTES", 16)
    builder.add(text.encode())
    sliced = builder.index()
    monkeypatch.undo()
    monkeypatch.setattr(P, "GROUP_TOKENS", 300)  # a group for every few shards
    assert found(spark, rows, 5, parts=12) == with_default
    whole = P.Builder()
    whole.add(text.encode())
    for a, b in zip(sliced, whole.index(), strict=True):
        assert list(a) == list(b)
    assert P.shards(cut()).count() == len({lang for lang, _ in rows})


def test_empty(spark):
    assert found(spark, [], 2) == [] and found(spark, [("en", None), (None, "")], 2) == []


@pytest.mark.parametrize("seed", range(5))
def test_intervals_of_a_shard(seed):
    """Interval sizes of all pairs and longer phrases of a shard equal plain counts."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 60))) + rng.choice([".", ""]) for _ in range(30)]
    builder = P.Builder()
    for t in texts:
        builder.add(t.encode())
    words, starts, sizes, transform = builder.index()
    index = P.Index(P.zstandard.ZstdCompressor().compress(transform.tobytes()))
    first = index.owners(starts, sizes, np.arange(len(words)))
    plain = Counter()
    for t in texts:
        w = t.replace(".", "").split()
        plain.update(tuple(w[i:i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    at = [first]
    for size in range(2, 6):
        at.append(index.left(at[-1]))
        begins, n = P.extended(*at)
        got = {tuple(words[x[b]] for x in at): int(c) for b, c in zip(begins, n, strict=True)}
        assert got == {p: c for p, c in plain.items() if len(p) == size}


def test_shards_are_added_one_at_a_time_and_sent_in_batches(monkeypatch):
    """A group's counts are the sums of its shards, in batches of bounded rows, and a shard's rows are small numbers."""
    monkeypatch.setattr(P, "BATCH_ROWS", 3)
    left, right, want = [], [], {}
    texts = [b"a b c a b d", b"b a b c d c", b"d d a b c"]
    for shard, text in enumerate(texts):
        held = P.Builder()
        held.add(text)
        words, starts, sizes, transform = held.index()
        packed = P.zstandard.ZstdCompressor().compress(transform.tobytes())
        assert P.Index(packed).left(P.Index(packed).owners(starts, sizes, np.arange(len(words)))).dtype == np.int32
        left.append({"shard": shard, "transform": packed})
        right += [{"size": 1, "shard": shard, "start": s, "n": n, "k1": -1, "k2": -1, "number": ord(w)}
                  for w, s, n in zip(words, starts.tolist(), sizes.tolist(), strict=True)]
        split = text.decode().split(" ")
        for pair in zip(split, split[1:], strict=False):
            want[pair] = want.get(pair, 0) + 1
    got = P._extend(2)(pa.Table.from_pylist(left), pa.Table.from_pylist(right))
    assert {(chr(r["k1"]), chr(r["k2"])): r["n"] for r in got.to_pylist()} == want
    assert len(set(got.column("place").to_pylist())) == got.num_rows and max(b.num_rows for b in got.to_batches()) <= 3
