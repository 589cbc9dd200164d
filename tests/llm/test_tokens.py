from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import sha
from tokenizers import Tokenizer

from pulsegrid.llm import bpe, packing
from pulsegrid.llm.tokens import u32

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [" ", "  ", "\n", "\t", "a", "the", "é", "É", "<|endoftext|>", "<|startoftext|>", "\x1c", "　", " ", "中文", "ǆ", "1", "٣", "ⅷ", "'s", "'", "!?", "́", "\x85", " x", "ſ", "​", "Σ", "ΑΣ ", "İ", "K", "𝐀"]


def packed(df):
    path = public_tokenizers.path
    return packing.pack(df, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def whole(text, tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def check_pieces(rows, texts):
    """Every id in exactly one piece, sequences gapless from 0 and full or a power of two."""
    tokenizer, pieces, sequences = Tokenizer.from_file(BYTE), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids, at = whole(texts[d], tokenizer), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0


def test_packing_edges(spark, edge_docs, edge_rows, no_docs):
    check_pieces(packed(edge_docs).collect(), dict(edge_rows))
    assert packed(no_docs).count() == 0


def test_packing_query(spark):
    from pulsegrid.llm.queries import queries

    small = "/root/testdata/sf0.001"
    check_pieces(queries()["op2_packing"](spark, small).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()})


def test_level_is_the_least_sum_of_squares():
    packer, rnd = packing.Packer(64, most_open=1 << 30), random.Random(4)
    for k in range(3000):
        size = rnd.randint(1, 63)
        count = packer.count.copy()

        def cost(level, size=size, count=count):
            c = count.copy()
            c[level] -= level > 0
            c[level + size] += level + size < 64
            return int((c[1:64] ** 2).sum())

        open_levels = [0, *(h for h in range(1, 64 - size + 1) if count[h])]
        assert cost(packer.level_for(size)) == min(map(cost, open_levels))
        packer.add(k, b"\0" * 4 * size)
    packer.finish()
    fill = [sum(len(p[2]) // 4 for p in w) for w in packer.closed]
    assert sum(f != 64 for f in fill) <= 6 and all(f & (f - 1) == 0 for f in fill)


@pytest.mark.parametrize("sizes", [[600] * 3000, [1, 1023] * 700, list(range(1, 3000, 7)), [5]])
def test_open_windows_are_bounded(sizes):
    packer = packing.Packer(1024, most_open=16)
    for k, n in enumerate(sizes):
        packer.add(k, u32(range(n)))
        assert packer.open == packer.count[1:1024].sum() <= 16
    online = len(packer.closed)
    packer.finish()
    fill = [sum(len(p[2]) // 4 for p in w) for w in packer.closed]
    assert sum(f != 1024 for f in fill) <= 10 and all(f & (f - 1) == 0 for f in fill)
    assert len(packer.closed) - online <= 16 + 10
    held = sorted((k, start, ids) for w in packer.closed for k, start, ids in w)
    for k, n in enumerate(sizes):
        assert b"".join(ids for own, _, ids in held if own == k) == u32(range(n)) if k < 40 else True


@pytest.fixture(scope="module")
def word():
    return bpe.Bpe(WORD), Tokenizer.from_file(WORD)


def test_bpe_on_odd_texts(word):
    own, library = word
    block = bpe.compile_lexicon({w: own.merge(w) for w in ("the", "then", "a", "éa", "word")})
    encode, rnd = bpe.Encoder(own, block), random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choices(ODD, k=rnd.randint(0, 12)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encode(text) == (u32(ids), library.decode(ids, skip_special_tokens=False)), text
    long = "".join(rnd.choices("theandoring", k=4000))
    assert encode(long)[0] == u32(library.encode(long, add_special_tokens=False).ids)


def test_lexicon(word):
    own, _ = word
    rnd = random.Random(7)
    words = {"".join(rnd.choices("abcdé", k=rnd.randint(1, 7))): [rnd.randrange(49_000) for _ in range(rnd.randint(1, 4))] for _ in range(3000)}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert lexicon.get_all([w.encode() for w in words]) == [u32(ids) for ids in words.values()]
    assert lexicon.get_all([b"", b"zzz", b"abcdabcdabcd"]) == [None] * 3 and lexicon.get_all([]) == []
    shared = bpe.compile_lexicon({a + b: [1] for a in ("un", "re", "in") for b in ("doing", "making", "taking")})
    apart = bpe.compile_lexicon({a + b: [1] for a in ("un", "re", "in") for b in (f"{a}oing", f"{a}aking", f"{a}icking")})
    assert len(shared) < len(apart)  # suffixes are shared
    assert bpe.Lexicon(bpe.compile_lexicon({})).get_all([b"a"]) == [None] and own.merge("the")


def test_words_merged_together_are_those_merged_alone(word):
    own, _ = word
    rnd = random.Random(9)
    words = ["".join(rnd.choices("theandoringé'0中", k=rnd.randint(1, n))) for n in (1, 4, 9, 17, 33, 70, 300) for _ in range(200)]
    assert own.merge_all(words) == [u32(own.merge(w)) for w in words] and own.merge_all([]) == []


def test_bpe_edges(spark, edge_docs, edge_rows, no_docs, word):
    rows = {repr(r.doc_id): r for r in bpe.token_digest(edge_docs, WORD).collect()}
    for d, t in edge_rows:
        ids = word[1].encode(t or "", add_special_tokens=False).ids
        r = rows[repr(d)]
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), sha(word[1].decode(ids, skip_special_tokens=False)))
    assert bpe.token_digest(no_docs, WORD).count() == 0


def test_bpe_query(spark, word):
    import hashlib

    from pulsegrid.llm.queries import queries

    small = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries()["op8_bpe"](spark, small).collect():
        ids = word[1].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(u32(ids)).hexdigest())
