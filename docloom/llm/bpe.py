"""Operator 1, byte-level BPE: a lazily determinised finite-state transducer, and a streaming decoder.

Encoding. A nondeterministic transducer guesses, at any byte, that a token ends; a guess survives only if the
token and the one before it keep apart when merged by rank (``_apart``). Every string has exactly one encoding
whose neighbours all keep apart, so the guesses that end together agree. The determinised state is the set of
(pending tokens, trie node) with the tokens common to all guesses already emitted: a token leaves as soon as no
continuation can change it, after a lookahead that the longest token bounds. States and moves are made when first
met and kept up to ``MAX_STATES``; beyond that they are made anew. Pieces seen before come from a bounded memo.

Decoding. Tokens are cut anywhere in a character; an incremental UTF-8 state machine over whole tokens' effects
tells where complete characters end, and holds back at most three bytes.

Defined results: null counts as the empty text; empty text gives no ids; special tokens' strings are ordinary.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex

from docloom.llm.common import small_batches, spread, table

MAX_STATES, MAX_MEMO = 200_000, 1_000_000
#: Ids that one step of the streaming decoder takes.
DECODE_STEP = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        # Trie over the tokens: node -> {byte: node}; an id at nodes where a token ends.
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.configs: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.start = self._state((((), -1, 0),))

    def _state(self, configs: tuple) -> int:
        at = self.states.get(configs)
        if at is None:
            at = self.states[configs] = len(self.configs)
            self.configs.append(configs)
            self.moves.append({})
        return at

    def merged(self, piece: bytes, below: int = sys.maxsize) -> list[bytes]:
        """Merges by rank (only ranks below a limit), the lowest first, the leftmost of equals: what is compiled."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens that merge into this one; of a single byte, itself twice."""
        known = self.halves.get(token)
        if known is None:
            parts = [self.ranks[p] for p in self.merged(self.bytes_of[token], token)]
            known = self.halves[token] = (parts[0], parts[-1])
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether two neighbours stay as they are. Undo their merges, the later one first: they would have joined
        if, at some moment, the parts that meet at the border merge by a rank that comes before either's next merge."""
        key = (left, right)
        known = self.apart.get(key)
        if known is not None:
            return known
        if len(self.apart) > 4 * MAX_STATES:
            self.apart.clear()
        ranks, bytes_of, limit, known = self.ranks, self.bytes_of, sys.maxsize, True
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], sys.maxsize) < limit:
                known = False
                break
            # A tie of ranks is one of equal tokens, of which the left merges first.
            inner, outer = self._halves(left)[1], self._halves(right)[0]
            if inner == left and outer == right:
                break
            if outer == right or inner != left and left > right:
                limit, left = left, inner
            else:
                limit, right = right + 1, outer
        self.apart[key] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one step: (next state, ids that are now certain). Guesses stand in the order of their starts."""
        after, ended, children, ends, sure = [], None, self.children, self.ends, 0
        for pending, last, node in self.configs[state]:
            node = children[node].get(byte)
            if node is not None:
                if children[node]:  # else no longer token begins like this
                    after.append((pending, last, node))
                token = ends[node]
                # At most one encoding ends here.
                if token >= 0 and ended is None and (last < 0 or self._apart(last, token)):
                    ended = (pending + (token,), token, 0)
        if ended is not None:
            after.append(ended)
        first = after[0][0]
        if len(after) == 1:
            sure = len(first)
        elif first:
            least = min(len(p) for p, _, _ in after)
            while sure < least and all(p[sure] == first[sure] for p, _, _ in after):
                sure += 1
        if sure:
            after = [(p[sure:], last, node) for p, last, node in after]
        out = self._state(tuple(after)), first[:sure]
        self.moves[state][byte] = out
        return out

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state, moves = self.start, self.moves
        for b in piece:
            step = moves[state].get(b)
            if step is None:
                if len(self.configs) > MAX_STATES:  # within a piece too: only the state we are in is carried over
                    here = self.configs[state]
                    self._reset()
                    state, moves = self._state(here), self.moves
                step = self._move(state, b)
            state = step[0]
            if step[1]:
                out += step[1]
        for pending, _, node in self.configs[state]:
            if node == 0:
                out += pending
        return out


class Encoder:
    """Whole texts: pieces by the pattern, each through the transducer or the memo of earlier pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = regex.compile(pattern).findall
        machine = Transducer(ranks)

        class Memo(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= MAX_MEMO:
                    self.clear()
                raw = piece.encode("utf-8", "surrogatepass")
                ids = array("I", [ranks[raw]] if raw in ranks else machine.encode(raw)).tobytes()
                if len(raw) <= 64:
                    self[piece] = ids
                return ids

        self.memo, self.machine = Memo(), machine

    def encode(self, text: str) -> array:
        return array("I", b"".join(map(self.memo.__getitem__, self.pieces(text))))


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int]:
    """State: (continuation bytes due, lowest and highest value of the next one). A byte that cannot follow starts anew."""
    due, low, high = state
    if due and low <= byte <= high:
        return (due - 1, 0x80, 0xBF)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return (0, 0x80, 0xBF)


class StreamDecoder:
    """Ids in, bytes of complete characters out; ``finish`` gives what an unfinished character leaves."""

    DONE = (0, 0x80, 0xBF)

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.held, self.state = b"", self.DONE

    def feed(self, ids: Iterable[int]) -> bytes:
        raw = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        # A character has four bytes at most: the machine's state at the end depends on the last three alone.
        start = max(0, len(raw) - 3)
        while start > 0 and start > len(raw) - 4 and raw[start] & 0xC0 == 0x80:
            start -= 1
        state, cut = self.DONE, len(raw)
        for i in range(start, len(raw)):
            before, state = state, utf8_step(state, raw[i])
            if state[0] and not (before[0] and state[0] == before[0] - 1):
                cut = i
        self.state = state
        if not state[0]:
            cut = len(raw)
        self.held = raw[cut:]
        return raw[:cut]

    def finish(self) -> bytes:
        rest, self.held, self.state = self.held, b"", self.DONE
        return rest


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker and vocabulary."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = Encoder(load_ranks(path), pattern)
    return _LOADED[key]


def encode_texts(docs, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True):
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves.

    No shuffle: each Arrow batch is encoded where it is read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            counts, shas, back, kept = [], [], [], []
            for value in batch.column(1):
                ids = enc.encode(value.as_py() or "")
                if sys.byteorder != "little":
                    ids.byteswap()
                counts.append(len(ids))
                shas.append(hashlib.sha256(ids).hexdigest())
                decoder, seen = StreamDecoder(enc.machine.bytes_of), hashlib.sha256()
                for i in range(0, len(ids), DECODE_STEP):
                    seen.update(decoder.feed(ids[i : i + DECODE_STEP]))
                seen.update(decoder.finish())
                back.append(seen.hexdigest())
                if keep_ids:
                    kept.append(ids.tolist())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers as tokens

    return encode_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN, keep_ids=False)
