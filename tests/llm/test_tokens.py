"""Encoding, counting and token files against the libraries."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import sentencepiece_fst as S
from tessera.llm import token_counts as C
from tessera.llm import token_output as O
from tessera.llm.common import fresh_path

MODEL, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "  two  blanks  ", "a\n\nb \n c\t", "it's 3.14, \"isn't\" it?...", "<s> </s> <0x41> <|endoftext|>x", "日本語のテキスト。Привет",
       "é̂ ▁▁ \x00\x1c\x85", "😀" * 5, "=" * 70, "word" * 300, "def f(x):\n        return {x: 1}\r\n", " \xa0 x"]


@pytest.fixture(scope="module")
def fst():
    return S.compile_model(MODEL)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(BYTES)


def shuffled(rows):
    import random

    rng = random.Random(4)
    words = [w for r in rows for w in (r[1] or "").split()] + ODD
    return ODD + ["".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n", ",", ". "]) for _ in range(rng.randint(1, 12)))
                  for _ in range(1_500)]


def test_transducer_equals_library(fst, sp, rows):
    texts = shuffled(rows)
    got = [x.tolist() for x in S.Encoder(fst).encode(texts)]
    assert got == sp.encode(texts)
    assert [fst.decode(x) for x in got] == sp.decode(got)


def test_decoding_any_ids_equals_library(fst, sp):
    import random

    rng = random.Random(11)
    of_bytes = [fst.byte_ids[b] for b in (0xE2, 0x82, 0xAC, 0x41, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xC0, 0xFF, 0x20)]
    special = [0, 1, 2, sp.piece_to_id("▁"), sp.piece_to_id("▁the"), sp.piece_to_id("the")]
    for _ in range(4_000):
        ids = [rng.choice(rng.choice([of_bytes, special, range(sp.get_piece_size())])) for _ in range(rng.randint(0, 8))]
        assert fst.decode(ids) == sp.decode(ids), ids


def test_runs_of_unknown_characters_equal_library():
    """A small unigram model without byte fallback."""
    import sentencepiece

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def field(number, value):
        return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)

    import struct

    body = field(1, field(1, b"<unk>") + field(3, 2)) + field(1, field(1, b"<s>") + field(3, 3)) + field(1, field(1, b"</s>") + field(3, 3))
    for p, s in {"▁": -2.0, "a": -3.0, "l": -3.0, "p": -3.0, "h": -3.0, "b": -3.0, "e": -3.0, "t": -3.0, "▁alpha": -4.0, "beta": -4.0}.items():
        body += field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s))
    model = body + field(2, field(3, 1)) + field(3, field(1, b"identity"))
    fst, sp = S.Fst(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in ("alpha 日本語 beta", "日本", "a日b本本 語", "alpha  beta ", "語語alpha"):
        ids = [i for u in fst.units(text) for i in fst.path(u)]
        assert ids == sp.encode(text), text
        assert fst.decode(ids) == sp.decode(ids)


def test_unigram_shortest_path_is_optimal():
    """A small unigram machine against trying every cut."""
    from itertools import combinations

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def field(number, value):
        return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)

    import struct

    pieces = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -4.2, "ba": -5.0, "aba": -7.5}
    body = field(1, field(1, b"<unk>") + field(3, 2))
    for p, s in pieces.items():
        body += field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s))
    fst = S.Fst(body + field(2, field(3, 1)) + field(3, field(4, 0)))
    for text in ("abab", "baab a", "aab", "bbaba ab"):
        unit = fst.normalise(text)
        best = max(sum(pieces.get(p, -99.0) for p in parts) for k in range(len(unit)) for cut in combinations(range(1, len(unit)), k)
                   for parts in [[unit[i:j] for i, j in zip((0, *cut), (*cut, len(unit)), strict=True)]])
        got = sum(pieces[fst.pieces[i]] for u in fst.units(text) for i in fst.path(u))
        assert got == pytest.approx(best)


def test_encode_and_decode_tables(spark, make_docs, rows, fst, sp):
    enc = S.encode(make_docs(rows), fst).collect()
    want = sorted(((i is None, i), sp.encode(t or "")) for i, t, _, _ in rows)
    assert sorted(((r.doc_id is None, r.doc_id), r.ids) for r in enc) == want
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in enc)
    assert [r.doc_id for r in enc if not r.round_trip] == [107]  # holds the meta symbol itself
    back = S.decode(S.encode(make_docs(rows), fst), fst).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, sp.decode(sp.encode(t or ""))) for i, t, _, _ in rows)
    assert S.encode(make_docs([]), fst).count() == 0


def test_id_encoder_equals_library(tok, rows):
    texts = shuffled(rows)
    got = O.IdEncoder(O.load_tokenizer(BYTES)).encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_go_whole(name):
    texts = ODD[:8] + ["Some Words here"]
    t = Tokenizer.from_file(P.path(name))
    got = O.IdEncoder(O.load_tokenizer(P.path(name))).encode(texts)
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_files(spark, make_docs, rows, tok):
    path = fresh_path(spark, "test-ids")
    O.write_tokens(make_docs(rows), path, O.load_tokenizer(BYTES))
    order = sorted(((i is not None, i or 0), t or "") for i, t, _, _ in rows)
    want, start = [], 0
    for (known, i), t in order:
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        want.append((i if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in O.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    some = {r.doc_id: r.ids for r in O.read_tokens(spark, path, [3, 110]).collect()}
    assert some == {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t, _, _ in rows if i in (3, 110)}
    assert O.read_tokens(spark, path, []).count() == 0


def test_token_files_without_rows(spark, make_docs):
    path = fresh_path(spark, "test-none")
    O.write_tokens(make_docs([]), path, O.load_tokenizer(BYTES))
    assert O.read_digests(spark, path).count() == 0


def test_count_cache(spark, make_docs, rows, sp):
    cache, t = fresh_path(spark, "test-cache"), C.Tokenizer(MODEL)
    got = C.count_tokens(make_docs(rows[:10]), t, cache).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == sorted((i, len(x.encode()), len(sp.encode(x))) for i, x, _, _ in rows[:10])
    first = spark.read.parquet(cache).count()
    again = C.count_tokens(make_docs(rows), t, cache).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in again) == sorted((i or -1, len(sp.encode(x or ""))) for i, x, _, _ in rows)
    distinct = len({x or "" for _, x, _, _ in rows})
    assert first == 10 and spark.read.parquet(cache).count() == distinct  # only misses were encoded
    C.count_tokens(make_docs(rows), t, cache).collect()
    assert spark.read.parquet(cache).count() == distinct
    assert C.count_tokens(make_docs([]), t, fresh_path(spark, "c")).count() == 0
    assert C.Tokenizer(BYTES).digest != t.digest
