"""The registered queries and the pipeline over the smallest tables."""

import random
import re

import corpus_pipeline
import public_tokenizers as P
import pytest
import sentencepiece
from conftest import WORDS, prose

import __spark_entry__ as entry
from tessera.llm import minhash_dedup, mixing, secrets
from tessera.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    q = entry.queries()
    assert [sum(k.startswith(f"op{n}_") for k in q) for n in range(1, 14)] == [1] * 13 and "pipeline" in q
    assert {"op3_mixing", "op4_topk_search", "op11_ranked_search", "op12_phrase_mining"} <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op3_mixing", "op4_topk_search", "op11_ranked_search", "op12_phrase_mining"])
def test_sql(spark, name):
    import duckdb

    from tools.check_oracle import digest

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(rel.columns, rel.fetchall())[0]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sp = docs.columns, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), "test-stage")
        before, after = docs.collect(), out.collect()
        if name != "sentencepiece":
            assert out.columns == columns
        if name == "language_id":  # clean documents stay
            assert {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")} == {r.doc_id for r in after}
        elif name == "minhash_near_dedup":
            classes = {r.doc_id: r.class_id for r in minhash_dedup.classify(docs).collect()}
            assert sorted(r.doc_id for r in after) == sorted(set(classes.values()))
        elif name == "secret_scans":
            text = {r.doc_id: r.text for r in before}
            assert all(r.text == secrets.redact(text[r.doc_id], secrets.find_secrets(text[r.doc_id])) and r.n_chars == len(r.text) for r in after)
        elif name == "mixing":
            times = {r.doc_id: r.taken // r.size if r.size else None for r in mixing.mix(docs).collect()}
            count = {}
            for r in after:
                count[r.doc_id] = count.get(r.doc_id, 0) + 1
            assert all(t is None or count.get(i, 0) == t for i, t in times.items())
        else:
            assert all(r.round_trip for r in after)
            text = {r.doc_id: r.text for r in before}
            assert all(r.ids == sp.encode(text[r.doc_id]) for r in after) and len(after) == len(before)
        docs = out


def brute_classes(docs):
    """doc_id -> smallest id of its class, at word edit similarity 0.8, by comparing all pairs."""
    words = {r.doc_id: minhash_dedup.words_of(r.text) for r in docs if r.doc_id is not None}
    label = {i: i for i in words}
    for a in words:
        for b in words:
            if a < b and label[a] != label[b]:
                longer = max(len(words[a]), len(words[b]))
                if words[a] == words[b] or longer and abs(len(words[a]) - len(words[b])) <= 0.2 * longer and 1 - distance(words[a], words[b]) / longer >= 0.8:
                    x, y = sorted((label[a], label[b]))
                    label = {k: x if v == y else v for k, v in label.items()}
    return label


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


BASE = [(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16)]


def base_values(text):
    return [m[g] for p, g, least in BASE for m in re.finditer(p, text or "") if len(m[g]) >= least]


def brute_targets(sizes):
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: 1 + i % 3 for i, k in enumerate(keys)}
    left, free, out = float(sum(sizes.values())), set(keys), {}
    while free:
        share = left / sum(weight[k] for k in free)
        full = {k for k in free if share * weight[k] > 3 * sizes[k]}
        if not full:
            return out | {k: share * weight[k] for k in free}
        for k in full:
            out[k] = 3.0 * sizes[k]
            left -= out[k]
        free -= full
    return out


def words_in(text):
    return len(re.findall("[^\x20\x09-\x0D]+", text or ""))


def test_stages_against_plain_versions(spark, make_docs, rows):
    """Nulls, empty and long texts, repeated rows, copies and clashing columns through every stage."""
    rng = random.Random(4)
    rows = [r for r in rows if len(r[1] or "") < 9_000] + [(200 + i, prose("de", 50, 900 + i), "de", "s1") for i in range(8)]
    near = rows[4][1].split()
    near[10] = "changed"
    rows += [(300, " ".join(near), "de", "s2"), (301, f"note token={rng.getrandbits(80):020x} end of this line here", "en", None),
             (302, " ".join(prose(x, 40, 77) for x in ("en", "de", "fr")), None, "s0")]
    docs = stored(make_docs(rows), "pipeline-test")
    columns, sp = docs.columns, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), "pipeline-test")
        before, after = docs.collect(), out.collect()
        assert name == "sentencepiece" or out.columns == columns
        if name == "language_id":
            kept = {r.doc_id for r in after}
            assert kept.isdisjoint({100, 101, 105, 106}) and {i for i, t, lang, _ in rows if lang in WORDS and len(t or "") > 60} <= kept and 302 in kept
        elif name == "minhash_near_dedup":
            label = brute_classes(before)
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(set(label.values()))
        elif name == "secret_scans":
            old = {(r.doc_id, r.source): r for r in before}
            assert len(after) == len(before)
            for r in after:
                was = old[r.doc_id, r.source].text
                assert not base_values(r.text) and not any(v in r.text for v in base_values(was)) and r.n_chars == len(r.text)
                assert base_values(was) or r.text == was
            assert any(base_values(r.text) for r in before)
        elif name == "mixing":
            sizes, taken = {}, {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + words_in(r.text)
            for r in after:
                taken[r.source] = taken.get(r.source, 0) + words_in(r.text)
            target = brute_targets(sizes)
            largest = {k: max(words_in(r.text) for r in before if r.source == k) for k in sizes}
            assert all(abs(taken.get(k, 0) - t) <= largest[k] for k, t in target.items())
            known = {(r.doc_id, r.text, r.source) for r in before}
            assert {(r.doc_id, r.text, r.source) for r in after} <= known
        else:
            assert sorted((r.doc_id or -1, r.ids) for r in after) == sorted((r.doc_id or -1, sp.encode(r.text or "")) for r in before)
        docs = out


def test_stages_on_an_empty_table(spark, make_docs):
    docs = make_docs([])
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), "pipeline-empty")
        assert out.count() == 0
        docs = out
