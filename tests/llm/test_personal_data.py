"""Base spans against the plain patterns, messages against enumeration, and the whole operator."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from conftest import prose

from tessera.llm import skip_chain as S

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 14 <= len(digits) <= 19 and brute_luhn(digits)
                    or kind == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a", "bob", ".", ".", "@", "@", "mail", "-", "%", "+", " ", "(", ")", "0", "7", "255", "256", "0012", "4111111111111111", "12", "x", "é", "\n", "_"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert S.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 150_000, "a.b@c" * 60_000, "1-" * 150_000, ("x" * 50 + "@ ") * 6_000,
                                  "+" * 300_000, "٣" * 100_000 + "1.2.3." + "9" * 5_000])
def test_scans_are_linear(text):
    began = time.process_time()
    S.read(text, S.base_spans(text))
    assert time.process_time() - began < 15


@pytest.mark.parametrize("seed", range(8))
def test_messages_equal_enumeration_on_trees(seed):
    rng = np.random.default_rng(seed)
    n = 5
    local = rng.normal(size=(n, S.LABELS))
    edges = np.array([(rng.integers(0, i), i, 0) for i in range(1, n)])
    pair = rng.normal(size=(n - 1, S.LABELS, S.LABELS))
    held = np.where(rng.random(n) < 0.3, rng.integers(0, S.LABELS, n), -1)
    nodes, both = np.zeros((n, S.LABELS)), np.zeros_like(pair)
    for labels in itertools.product(range(S.LABELS), repeat=n):
        if all(h in (-1, y) for h, y in zip(held, labels, strict=True)):
            p = np.exp(sum(local[i, y] for i, y in enumerate(labels) if held[i] < 0) + sum(w[labels[a], labels[b]] for (a, b, _), w in zip(edges, pair, strict=True)))
            for i, y in enumerate(labels):
                nodes[i, y] += p
            for e, (a, b, _) in enumerate(edges):
                both[e, labels[a], labels[b]] += p
    got = S.infer(local, held, edges, pair)
    assert got[0] == pytest.approx(nodes / nodes[0].sum(), abs=2e-4)
    assert got[1] == pytest.approx(both / nodes[0].sum(), abs=2e-4)


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(300):
        words = prose("en", 30, i).split()
        items = [f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", f"user{i}.x@mail{i % 9}.example.com", f"{rng.randint(1, 255)}.{i % 256}.3.{rng.randint(0, 255)}"]
        for x in rng.sample(items, rng.randint(0, 3)):
            words[rng.randint(0, len(words)):0] = [x]
        if i % 3 == 0:  # a repeated value
            words += [x for x in words if x.startswith(("+", "user"))][:1] + ["again"]
        words[5:5] = [str(rng.randint(1900, 2100)), f"v{i}.{i % 7}"]
        rows.append((i, " ".join(words)))
    return rows


def test_repeats_share_their_label(spark):
    field = S.fit(spark.createDataFrame(corpus(), "doc_id bigint, text string"))
    finder = S.Finder(field)
    text = "Call +1 (974) 555-3436 today. Nothing in 1999 or v3.4 matters. Ask again under (974) 555-3436 there."
    got = finder.find([text])[0]
    assert [(s["kind"], text[s["start"]:s["end"]]) for s in got] == [("phone", "+1 (974) 555-3436"), ("crf_phone", "974) 555-3436")]
    clean = ["In 1999 there were v3.4 and 12 houses.", "release 2.0.1 costs 300", prose("de", 400, 2)]
    assert finder.find(clean) == [[], [], []]
    # a skip edge carries the label: without its repeat the same token is less sure
    g = S.read(text, S.base_spans(text))
    alone = S.joined([g])
    alone.edges = alone.edges[alone.edges[:, 2] < 0]
    with_skip = S.infer(field.local(g), g.base, g.edges, field.pair(g.edges[:, 2]))[0]
    without = S.infer(field.local(g), g.base, alone.edges, field.pair(alone.edges[:, 2]))[0]
    free = np.flatnonzero((g.base < 0) & (with_skip[:, 4] > 0.9))
    assert len(free) and (with_skip[free, 4] > without[free, 4]).all()


def test_edges():
    text = "bob.smith@a.example.com met bob.smith and 555-1234567, then 5551234567 and 555-1234567."
    g = S.read(text, S.base_spans(text))
    words = [text[a:b] for a, b in zip(g.start, g.end, strict=True)]
    assert {(words[a], words[b], k) for a, b, k in g.edges if k >= 0} == {("bob.smith@a.example.com", "bob.smith", S.MAILBOX),
                                                                       ("555-1234567", "5551234567", S.DIGITS), ("555-1234567", "555-1234567", S.SAME), ("5551234567", "555-1234567", S.DIGITS)}


def test_scan(spark, make_docs, rows):
    rows = rows + [(i + 1_000, t, "en", "s") for i, t in corpus()] + [(2_000, "call +1 (974) 555-3436 or 974-555-3436 " * 400, "en", None), (None, "10.0.0.1", None, None)]
    docs = make_docs(rows)
    got = S.scan(docs, S.fit(docs)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for i, t, *_ in rows:
        by_text.setdefault(i, []).append([(a, S.KINDS[k], b) for a, k, b in brute(t or "")])
    for r in got:
        base = [(s["start"], s["kind"], s["end"]) for s in r.spans if s["kind"] in S.KINDS]
        assert base in by_text[r.doc_id]
        assert [(s["start"], (S.KINDS + S.ADDED).index(s["kind"])) for s in r.spans] == sorted((s["start"], (S.KINDS + S.ADDED).index(s["kind"])) for s in r.spans)
        for s in r.spans:
            assert s["kind"] in S.KINDS or not any(a < s["end"] and s["start"] < b for a, _, b in base)
    again = S.scan(docs.repartition(5), S.fit(docs.repartition(5))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert S.fit(make_docs([])) is None and S.scan(make_docs([]), None).count() == 0
    assert S.fit(make_docs([(1, "only 1999 here", "en", "s")])) is None


def test_query_columns(spark, make_docs, tmp_path):
    from tessera.llm.queries import op13_personal_data

    rows = [(1, "mail bob@example.com, 10.1.2.3 x", "en", "s"), (2, None, None, None)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.asDict() for r in op13_personal_data(spark, str(tmp_path)).collect()}
    spans = "email:5:20,ip:22:30"
    assert got[1] == {"doc_id": 1, "n_email": 1, "n_ip": 1, "n_card": 0, "n_phone": 0, "base_sha256": hashlib.sha256(spans.encode()).hexdigest(), "spans": spans}
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
