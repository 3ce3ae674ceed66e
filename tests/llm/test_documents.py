"""Mixing, secrets, language ID and near-duplicates on small tables."""

import random
import re
import time

import pytest
from conftest import prose

from tessera.llm import language_id as L
from tessera.llm import minhash_dedup as M
from tessera.llm import mixing as X
from tessera.llm import secrets as S


# --- mixing ---------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    w = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    left, open_, out = float(sum(sizes.values())), set(keys), {}
    while open_:
        share = left / sum(w[k] for k in open_)
        full = {k for k in open_ if share * w[k] > most * sizes[k]}
        if not full:
            return out | {k: share * w[k] for k in open_}
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        open_ -= full
    return out


def test_mix(make_docs):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice(["a", "a", "a", "a", "b", "c", "ü", None])) for i in range(400)]
    rows += [(1_000, None, "en", "a"), (1_001, "\t \n", "en", "empty"), rows[5], (None, "one two", None, "b")]
    docs = make_docs(rows)
    got = X.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)  # a document's words (twice: the repeated row)
    assert sorted(map(repr, X.mix(docs.repartition(7)).collect())) == sorted(map(repr, got))
    mixed = X.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())
    assert X.mix(make_docs([])).count() == 0 and X.mixed_documents(make_docs([])).count() == 0


# --- secrets --------------------------------------------------------------------------

BASE = {"assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16)}


def brute_base(text):
    out = [(m.start(), k, m.end()) for k, (p, g, least) in BASE.items() for m in p.finditer(text) if len(m[g]) >= least]
    return sorted(out, key=lambda x: (x[0], S.KINDS.index(x[1])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", '"', "'", " ", "=", ":", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP",
             "deadbeef", "zz", "é", "_", "-", "0123456789abcdefff", "\n", "x" * 12]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(s["start"], s["kind"], s["end"]) for s in sorted(S.base_spans(text), key=lambda s: (s["start"], S.KINDS.index(s["kind"])))] == brute_base(text)


@pytest.mark.parametrize(("text", "value"), [
    ('db_pwd = "kD93jfLs02mXq"', "kD93jfLs02mXq"),
    ("export AUTH_BEARER=kD93jfLs02mXq", "kD93jfLs02mXq"),
    ('{"client_credentials": "kD93jfLs02mXq7"}', "kD93jfLs02mXq7"),
    ("<private_key>kD93jfLs02mXq7</private_key>", "kD93jfLs02mXq7"),
    ('k = "kD93jfLs02mXq7"\nuse(k)\nsigning_key = k', "kD93jfLs02mXq7"),
    ('pass_phrase = "kD93jf" + "Ls02mXq7zz"', "Ls02mXq7zz"),
    ('db_pwd = "kD93jf"+"Ls02mXq7zz"', "Ls02mXq7zz"),
    ('db_pwd = "kD93jfLs02" +\n    "mXq7zz99"', "mXq7zz99"),
    ('db_pwd = ("kD93jfLs02"\n  + "mXq7zz99")', "mXq7zz99"),
    ("$db_pwd = 'kD93jfLs02'.'mXq7zz99'", "mXq7zz99"),
    ('signing_key = """\nkD93jfLs02mXq7\n"""', "kD93jfLs02mXq7"),
    ("service:\n  private_key: |\n    kD93jfLs02mXq7\n    Zz81kk2QpL\n  port: 80\n", "Zz81kk2QpL"),
    ('client.setAuthPassphrase("kD93jfLs02mXq7")', "kD93jfLs02mXq7"),
    ('env.put("DB_PASSWD", "kD93jfLs02mXq7")', "kD93jfLs02mXq7"),
    ('# old: db_pwd = "kD93jfLs02mXq7"', "kD93jfLs02mXq7"),
    ('db_pwd: Optional[str] = "kD93jfLs02mXq7"', "kD93jfLs02mXq7"),
    ("run --db-pwd=kD93jfLs02mXq7", "kD93jfLs02mXq7"),
])
def test_assignments_add_literals(text, value):
    found = [s for s in S.find_secrets(text) if s["kind"] == "literal"]
    assert any(value in text[s["value_start"]:s["value_end"]] for s in found)
    assert value not in S.redact(text, found)


@pytest.mark.parametrize("text", ['title = "a long enough value 1"', "max_tokens: 4096000000", 'pwd = "changeme1234"', "password_hint: kD93jfLs02mXq",
                                  "He said: something12345 was there", 'auth_url = "kD93jfLs02mXq7"', "pwd = ${DB_PASSWORD_123}"])
def test_clean_assignments_stay(text):
    assert [s for s in S.find_secrets(text) if s["kind"] == "literal"] == []


def test_every_part_of_a_constant_counts():
    """70 literals joined under a sensitive name, directly and through other names."""
    parts = [f"Qz{i:02d}kT{i * 7919 % 1000:03d}w" for i in range(70)]
    direct = "db_pwd = " + " + ".join(f'"{p}"' for p in parts)
    chained = 'k = ""\n' + "\n".join(f'k = k + "{p}"' for p in parts) + "\nsigning_key = k"
    spread = "\n".join(f'c{i} = "{p}"' for i, p in enumerate(parts)) + "\nsigning_key = " + " + ".join(f"c{i}" for i in range(70))
    for text in (direct, chained, spread):
        clean = S.redact(text, S.find_secrets(text))
        assert not [p for p in parts if p in clean]


def test_lexer_time_is_bounded():
    """Long runs, unclosed quotes, and constants that are built up and used again and again."""
    chain = 'k = "aZ3"\n' + 'k = k + "xQ9zzzT"\npassword_key = k\n' * 3_000
    double = "a0 = 'Zx81kk2QpL'\n" + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(300)) + "signing_key = a300"
    for text in ("x" * 200_000 + "=", "a." * 100_000 + "=", '="' * 50_000, "='\n" * 50_000, '"""' * 20_001 + ":=", "key: |\n" * 20_000,
                 "key: |\n  " + "a b\n  " * 30_000, chain, double, "(" * 50_000 + '"a", ' * 20_000):
        began = time.process_time()
        S.find_secrets(text)
        assert time.process_time() - began < 20, text[:20]


def test_scan_and_redact_tables(make_docs, rows):
    docs = make_docs(rows)
    got = {r.doc_id: r.spans for r in S.scan(docs).collect()}
    for i, t, _, _ in rows:
        assert [(s.start, s.kind, s.end) for s in got[i] if s.kind != "literal"] == brute_base(t or "")
    clean = S.redact_documents(docs, length_column="n_chars")
    assert clean.columns == docs.columns
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[100].text is None and texts[3].text == rows[3][1]
    assert "hunter2" not in texts[110].text and "AKIA" not in texts[110].text and texts[110].n_chars == len(texts[110].text)
    assert S.scan(make_docs([])).count() == 0


# --- language ID ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def speech():
    rng = random.Random(1)
    return [(i, prose(lang, rng.randint(3, 200), i), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 60)]


def test_language_id(make_docs, speech, rows):
    docs = make_docs(speech)
    model = L.fit(docs)
    held = {r.doc_id: r.held for r in docs.select("doc_id", L.held_out("doc_id").alias("held")).collect()}
    import zlib

    assert held == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _, _ in speech}
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    tested = [x for x in speech if held[x[0]]]
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in got.values())
    other = L.identify(make_docs(rows), model).collect()
    assert len(other) == len(rows)
    by = {r.doc_id: r for r in other}
    assert all(by[i].lang_pred == L.UNDETERMINED and by[i].score == 0 for i in (100, 101, 105, 106))
    kept = L.keep_identified(make_docs(rows), model)
    assert {100, 101, 105, 106}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.columns == make_docs(rows).columns
    # no label to learn from, and no rows
    assert {r.lang_pred for r in L.identify(docs, L.fit(make_docs([(1, "text", None, "s")]))).collect()} == {L.UNDETERMINED}
    assert L.fit(make_docs([])) is None and L.identify(make_docs([]), model).count() == 0


def test_words_of_a_switched_text_get_their_own_labels(speech):
    model = L.train([(t, lang) for _, t, lang, _ in speech])
    en, de = L.words_of(prose("en", 60, "a")), L.words_of(prose("de", 60, "b"))
    post, _ = L.Labeller(model).posteriors([en + de])
    label = [model.labels[k] for k in post.argmax(axis=1)]
    assert label[:len(en)].count("en") >= 0.95 * len(en) and label[len(en):].count("de") >= 0.95 * len(de)
    assert abs(post.sum(axis=1) - 1).max() < 1e-4


def test_long_runs_are_read_whole(speech):
    """The inside of an unspaced run counts, and a text in three languages is certain though no language has half of it."""
    import numpy as np

    model = L.train([(t, lang) for _, t, lang, _ in speech])
    inside = "".join(L.words_of(prose("de", 120, "x")))
    ends = "".join(L.words_of(prose("en", 2, "y")))[:10]
    assert all(len(w) <= 20 for w in L.words_of(ends + inside + ends)) and "".join(L.words_of(ends + inside + ends)) == ends + inside + ends
    (label, _, _), (plain, _, _) = L.Labeller(model).label([ends + inside + ends, inside])
    assert label == plain
    mixed = " ".join(prose(lang, 60, "m") for lang in ("en", "de", "fr"))
    _, score, certainty = L.Labeller(model).label([mixed])[0]
    assert score < 0.5 and certainty > 0.9
    # runs with context against the whole chain
    words = L.words_of(" ".join(prose(random.Random(i).choice(["en", "de", "fr"]), 25, f"r{i}") for i in range(30)))
    post, _ = L.Labeller(model).posteriors([words])
    e = model.emissions(words)[None]
    whole = L.forward_backward(e, np.ones((1, len(words)), bool), model.transitions)[0]
    assert abs(post - whole).max() < 0.01 and (post.argmax(axis=1) == whole.argmax(axis=1)).all()


def test_language_stage_without_labels_keeps_texts(make_docs, rows):
    kept = sorted((r.doc_id or -1 for r in L.keep_identified(make_docs(rows), None).collect()))
    assert kept == sorted(i or -1 for i, t, *_ in rows if any(map(str.isalpha, t or "")))


def test_forward_backward_equals_enumeration():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    real = np.array([[False, True, True, True]])
    total, want = 0.0, np.zeros((4, 3))
    for path in product(range(3), repeat=3):
        p = np.exp(sum(e[0, i + 1, k] for i, k in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += p
        for i, k in enumerate(path):
            want[i + 1, k] += p
    got = L.forward_backward(e, real, t)[0]
    assert np.allclose(got[1:], want[1:] / total)


# --- near-duplicates ---------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(5)
    for _ in range(800):
        k = rng.choice([2, 4, 40])
        a = [rng.randrange(k) for _ in range(rng.randint(0, 25))]
        b = list(a) if rng.random() < 0.8 else [rng.randrange(k) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 7)):
            i = rng.randrange(len(b) + 1)
            b[i:i + rng.randint(0, 1)] = [rng.randrange(k)] * rng.randint(0, 1)
        d = distance(a, b)
        for most in (0, 1, 3, 8, 30):
            got = M.banded_distance(a, b, most)
            assert got == d if d <= most else got > most


def test_histogram_filter_never_drops_a_link():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 1 << 63, rng.integers(5, 80), dtype=np.uint64)
        b = a.copy()
        b[rng.integers(0, len(b), len(b) // 7)] = rng.integers(0, 1 << 63, dtype=np.uint64)
        if M.similar(a, b, 0.8):
            assert M.possible(np.int64(len(a)), np.int64(len(b)), M.histogram(M.short(a)), M.histogram(M.short(b)), 0.8)


def edited(words, share, rng):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_near_duplicates(make_docs, rows):
    rng = random.Random(8)
    fresh = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(60, 160))] for _ in range(40)]
    docs, n = [], 0
    for g, words in enumerate(fresh):
        for c in range(1 + (g % 4) * (5 if g == 3 else 1)):
            docs.append((n, " ".join(words if c == 0 else edited(words, 0.03, rng)), "en", "s"))
            n += 1
    shared = [f"p{i}" for i in range(50)]  # a passage that many documents share
    for _ in range(20):
        docs.append((n, " ".join([f"u{rng.randrange(10**6)}" for _ in range(40)] + shared + [f"u{rng.randrange(10**6)}" for _ in range(40)]), "en", "s"))
        n += 1
    rng.shuffle(docs)
    table = make_docs(docs + [(n + 1 + k, t, "en", "s") for k, (_, t, _, _) in enumerate(docs[:10])] + docs[:3])
    texts = {r.doc_id: M.words_of(r.text) for r in table.collect()}
    label = {i: i for i in texts}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and 1 - distance_bounded(texts[a], texts[b]) / max(len(texts[a]), len(texts[b])) >= 0.8:
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    got = M.classify(table).collect()
    assert {r.doc_id: r.class_id for r in got} == label and len(got) == table.count()
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    one = M.keep_one(table)
    assert one.columns == table.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(label.values()))
    odd = M.classify(make_docs(rows)).collect()
    by = {r.doc_id: r.class_id for r in odd}
    assert len(odd) == len(rows) and by[103] == by[104] == 0 and by[100] == by[101] == by[105] == 100 and by[None] is None
    assert M.classify(make_docs([])).count() == 0 and M.keep_one(make_docs([])).count() == 0


def distance_bounded(a, b):
    most = M.allowed(len(a), len(b), 0.8)
    if abs(len(a) - len(b)) > most or len(set(a) & set(b)) < 0.3 * len(set(a)):
        return max(len(a), len(b))
    return distance(a, b)
