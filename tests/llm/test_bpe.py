"""Against the public library, and round trips."""

import random

import pytest

tokens = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from docloom.llm.bpe import StreamDecoder, encoder, load_ranks, op1_byte_bpe

PATH = tokens.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(1)
    yield from ["", " ", "\n\n  x", "<|endoftext|>", "a" * 3000, "é😀" * 50, "don't we'll", "\u0000\x7f", "ÿþ", "日本語テキスト 123456"]
    alphabets = ["abcdefghij", "etaoin shrdlu", "aeß😀日é \n\t'", "".join(map(chr, range(32, 400))), "01 .,;-_=+"]
    for _ in range(600):
        yield "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 80)))
    letters = "".join(map(chr, range(97, 123)))
    for _ in range(300):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(5, 120)))


def test_equals_the_library(library):
    enc = encoder(PATH, tokens.PATTERN)
    for text in texts():
        ids = enc.encode(text)
        assert list(ids) == library.encode_ordinary(text), repr(text)
        assert [t for p in enc.pieces(text) for t in enc.machine.encode(p.encode())] == list(ids), repr(text)


def test_streaming_decode_holds_back_only_unfinished_characters():
    enc = encoder(PATH, tokens.PATTERN)
    for text in texts():
        ids, whole = enc.encode(text), b""
        decoder = StreamDecoder(enc.machine.bytes_of)
        for i in ids:
            part = decoder.feed([i])
            part.decode("utf-8")
            assert len(decoder.held) <= 3
            whole += part
        assert whole + decoder.finish() == text.encode()


def test_few_states_are_kept_and_results_stay(monkeypatch, library):
    from docloom.llm import bpe

    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    machine = bpe.Transducer(load_ranks(PATH))
    for text in list(texts())[-100:]:
        assert machine.encode(text.encode()) == library.encode_ordinary(text)


def test_states_are_bounded_within_one_piece(monkeypatch, library):
    from docloom.llm import bpe

    monkeypatch.setattr(bpe, "MAX_STATES", 500)
    machine, rng = bpe.Transducer(load_ranks(PATH)), random.Random(8)
    piece, most = "".join(rng.choice("etaoinshrdlucmfw") for _ in range(20_000)), 0
    move = machine._move

    def watched(state, byte):
        nonlocal most
        most = max(most, len(machine.configs))
        return move(state, byte)

    machine._move = watched
    assert machine.encode(piece.encode()) == library.encode_ordinary(piece) and most <= 502


def test_query(spark, tables, library):
    import hashlib
    import struct

    rows = [(1, None), (2, ""), (3, "Hello wörld"), (4, "x" * 50_000), (4, "same id"), (None, "null id")]
    d = tables(documents=("doc_id long, text string, ids int, n_tokens string", [(a, b, 1, "x") for a, b in rows]))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op1_byte_bpe(spark, d).collect()}
    want = set()
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    assert op1_byte_bpe(spark, tables(documents=("doc_id long, text string", []))).count() == 0
