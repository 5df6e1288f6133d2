import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

tokens = pytest.importorskip("public_tokenizers")

from docloom.llm.packing import MAX_TOKENS, capacities, op5_packing, pack, pack_documents, tokens_of

PATH = tokens.path("word_bpe_49k.json")


@functools.lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def library_ids(text):
    return library().encode(text, add_special_tokens=False).ids


def test_word_by_word_equals_whole_texts():
    rng = random.Random(3)
    words = ["Hello", "don't", "ΣΑΣ", "é", "́x", "日本", "a\x1cb", "\x85", " ", "\xa0", "<|endoftext|>x", "123", "it's", "--", "İ", "​", "ﬁ"]
    for text in ["", " ", "\n", *("".join(rng.choice(words) + rng.choice(["", " ", "\n\t", "\xa0", "\x1d"]) for _ in range(12)) for _ in range(200))]:
        assert np.frombuffer(tokens_of(PATH).ids(text), dtype="<u4").tolist() == library_ids(text), repr(text)


def test_letters_before_punctuation_equal_the_library():
    """Every alphabetic character below U+30000, before each mark that may be split off it."""
    from docloom.llm.packing import _TAIL

    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha()]
    mine = tokens_of(PATH)
    for tail in _TAIL:
        for at in range(0, len(letters), 20_000):
            text = " ".join(x + tail for x in letters[at : at + 20_000])
            assert np.frombuffer(mine.ids(text), dtype="<u4").tolist() == library_ids(text), tail
    text = "İstanbul'da Aİ. Sİ, dedi"
    assert np.frombuffer(mine.ids(text), dtype="<u4").tolist() == library_ids(text)


def test_pack_keeps_every_token_once():
    rng = np.random.default_rng(0)
    for lengths in (np.array([1]), np.array([5000]), np.array([2048, 2048]), rng.integers(1, 3000, 500), np.ones(3000, dtype=np.int64)):
        got, seqs = defaultdict(list), defaultdict(list)
        for d, s, n, q, o in pack(lengths):
            got[d].append((s, n))
            seqs[q].append((o, n))
        for d, n in enumerate(lengths):
            at = 0
            for s, k in sorted(got[d]):
                assert s == at
                at += k
            assert at == n
        sizes = []
        for q in seqs.values():
            at = 0
            for o, n in sorted(q):
                assert o == at
                at += n
            sizes.append(at)
        assert sorted(sizes) == sorted(capacities(int(lengths.sum())))


def test_descending_to_lowest_cost():
    out = pack(np.array([1024, 1024, 512, 512, 512, 512]))
    assert sorted(q for _, _, _, q, _ in out[:2]) == [0, 1]


@pytest.mark.parametrize("chunk", [100, 1 << 21])
def test_query(spark, tables, chunk):
    rows = [(1, None), (2, ""), (3, "Hello world " * 2000), (4, "x"), (5, "don't  stop"), (5, "again"), (None, "null id")]
    d = tables(documents=("doc_id long, text string, length int, `offset` string", [(a, b, 1, "x") for a, b in rows]))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = pack_documents(docs, PATH, keep_ids=True, chunk_tokens=chunk).collect()
    whole = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        if r.doc_id != 5:
            whole[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for i, text in rows:
        if i != 5:
            ids = [x for _, part, _ in sorted(whole[i]) for x in part]
            assert ids == [*library_ids(text or ""), 1] and whole[i][0][2] == len(ids)
    seqs = defaultdict(list)
    for r in op5_packing(spark, d).collect():
        seqs[r.sequence_id].append((r.offset, r.length))
    for q in seqs.values():
        at = 0
        for o, n in sorted(q):
            assert o == at
            at += n
        assert at <= MAX_TOKENS and (at == MAX_TOKENS or at & (at - 1) == 0)
    assert op5_packing(spark, tables(documents=("doc_id long, text string", []))).count() == 0
