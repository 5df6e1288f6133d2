"""Operator 5, sequence packing balanced by cost.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (feed-forward and attention within the piece).
Within a chunk of about ``CHUNK_TOKENS`` tokens of one input partition, documents longer than a sequence first
fill sequences of their own; the remainders, longest first, go to the sequence of lowest cost that has room, and
are cut where none has. A chunk's sequences are planned to hold exactly its tokens: full ones, then lengths that
are powers of two, which need no padding. No shuffle and no task sees more than one chunk's ids; an id depends on
the partition and chunk alone, so a lost executor's work is redone alike.

Defined results: null counts as the empty text, which is the end id alone; equal rows are packed separately.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docloom.llm.common import small_batches, spread, table

MAX_TOKENS, END_ID = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 512
CHUNK_TOKENS, MAX_MEMO = 1 << 21, 500_000
_TAIL = ".,;:!?*#%&$)"
_ODD, _PLAIN = "\x1c\x1d\x1e\x1f", re.compile(r"[ \t\n\r]+")


class Tokens:
    """Ids of whole texts. The tokenizer never joins over white space, so words are encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        model, letters, normal = library.model, re.compile("[a-z]+").fullmatch, library.normalizer.normalize_str

        def ends_in_letter(core: str) -> bool:
            """Also as the tokenizer sees it: some letters become a letter and a mark, which joins what follows."""
            return core[-1].isalpha() and (core.isascii() or normal(core)[-1:].isalpha())

        class Memo(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= MAX_MEMO:
                    self.clear()
                core = word.rstrip(_TAIL)
                if len(word) > 64 or not core or core == word or not ends_in_letter(core):
                    small = word.lower() if word.isascii() and "<" not in word else word
                    if small != word:
                        ids = self[small]
                    else:  # plain letters are one piece, which the other steps leave alone
                        found = [t.id for t in model.tokenize(word)] if letters(word) else library.encode(word, add_special_tokens=False).ids
                        ids = array("I", found).tobytes()
                else:  # letters and the punctuation after them are encoded apart
                    ids = self[core] + self[word[len(core) :]]
                if len(word) <= 64:
                    self[word] = ids
                return ids

        self.memo = Memo()

    def ids(self, text: str) -> bytes:
        words = _PLAIN.split(text) if any(c in text for c in _ODD) else text.split()
        return b"".join(map(self.memo.__getitem__, words))


_LOADED: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def capacities(total: int, max_tokens: int = MAX_TOKENS) -> np.ndarray:
    """Sequence lengths that hold ``total`` tokens: as many full ones as fit, then falling powers of two."""
    rest = total % max_tokens
    return np.array([max_tokens] * (total // max_tokens) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1], dtype=np.int64)


def pack(lengths: np.ndarray, max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences numbered from 0."""
    cost_of = lambda n: LINEAR * n + QUADRATIC * n * n
    room = capacities(int(lengths.sum()), max_tokens)
    size, cost = room.copy(), np.zeros(len(room))
    out, taken = [], 0
    rest, start = lengths.copy(), np.zeros(len(lengths), dtype=np.int64)
    full = int((room == max_tokens).sum())
    for d in np.flatnonzero(lengths >= max_tokens):
        while rest[d] >= max_tokens and taken < full:
            out.append((int(d), int(start[d]), max_tokens, taken, 0))
            room[taken], cost[taken] = 0, cost_of(max_tokens)
            taken, start[d], rest[d] = taken + 1, start[d] + max_tokens, rest[d] - max_tokens
    open_room, open_cost = room[taken:].copy(), np.zeros(len(room) - taken)
    for d in np.argsort(-rest, kind="stable"):
        while rest[d] > 0:
            n = int(rest[d])
            fits = open_room >= n
            if fits.any():
                at = int(np.where(fits, open_cost, np.inf).argmin())
            else:  # cut: the roomiest sequence takes what it can, the cheapest of equals
                most = open_room.max()
                at = int(np.where(open_room == most, open_cost, np.inf).argmin())
                n = int(most)
            out.append((int(d), int(start[d]), n, taken + at, int(size[taken + at] - open_room[at])))
            open_room[at] -= n
            open_cost[at] += cost_of(n)
            start[d] += n
            rest[d] -= n
    return out


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, keep_ids: bool = False, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, if asked for)."""
    small_batches(docs.sparkSession)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = tokens_of(path), np.array([END_ID], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        owners, held, n_held = [], [], 0

        def flush():
            nonlocal first, owners, held, n_held
            lengths = np.array([len(x) // 4 for x in held], dtype=np.int64)
            pieces = pack(lengths, max_tokens)
            for at in range(0, len(pieces), 8192):
                part = pieces[at : at + 8192]
                cut = [held[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in part]
                columns = [
                    pa.array([owners[p[0]] for p in part], kind), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()),
                    pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array([int(lengths[p[0]]) for p in part], pa.int64()),
                    pa.array([first + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(c, dtype="<u4").astype(np.int32) for c in cut], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)
            first += max((p[3] for p in pieces), default=-1) + 1
            owners, held, n_held = [], [], 0

        for batch in batches:
            kind = batch.column(0).type
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.ids(text.as_py() or "") + end
                owners.append(owner)
                held.append(ids)
                n_held += len(ids) // 4
                if n_held >= chunk_tokens:
                    yield from flush()
        if held:
            yield from flush()

    kind_sql = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind_sql}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op5_packing(spark, sf_dir):
    import public_tokenizers as tokens

    return pack_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokens.path("word_bpe_49k.json"))
