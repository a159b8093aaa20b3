"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes.

A sequence of tokens is what the merges make of its bytes exactly if each
neighbouring pair is what they make of the pair's own bytes: no merge crosses a
border between tokens, so merges on one side never see the other side. That turns
the merges into a nondeterministic transducer: read a token's bytes along the tree
of tokens, and at its end emit it if it agrees with the token before. For every
prefix exactly one run stands at a token's end.

The transducer is determinised while it runs. A state is the set of live runs: the
place in the tree, the token before, and the tokens that this run has over what
all live runs share. Tokens that all runs share are emitted at once; a run reads
one token's bytes at most before it ends, so the lookahead is bounded by the
longest token. States and moves are made when a text first needs them and kept; a
machine that reaches ``most_moves`` starts anew.

A text is first cut in matches of the split pattern, by character classes and
their borders over whole batches; the classes are those of the library whose ids
are matched, read from it once. Equal matches of a batch are encoded once, and a
worker remembers some of them.

Decoding joins the bytes of ids. The stream decoder keeps the state of an unfinished
character between calls and gives out whole characters only; invalid bytes become
U+FFFD, one for each maximal part, as with ``errors="replace"``.

Defined cases: null text is empty text and has no ids; null ids decode to null; the
encoding of any text decodes to its bytes; repeated rows give equal results; an empty
table gives no rows; extra columns take no part; ids outside the vocabulary are an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from .common import chunks, span_hashes

ship(__name__)

#: Classes of characters.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Endings that the split pattern keeps with their apostrophe. Fixed values of the pattern.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


# ------------------------------------------------------------------ vocabulary

def load_tokens(path: str) -> list[bytes]:
    """Tokens by rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    tokens = [ranks[i] for i in range(len(ranks))]
    if missing := {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError(f"{len(missing)} single bytes have no token")
    return tokens


def character_classes() -> np.ndarray:
    """The class of each code point, as the library sees it: what its own patterns match among all characters."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = bytes(tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    return out


# ------------------------------------------------------------------ splitting

def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and code point of each character of UTF-8 bytes; continuation bytes out of place count as characters of their own."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    size = np.diff(np.append(at, len(data)))
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
    code = lead.copy()
    for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        own = np.flatnonzero(size == n)
        value = lead[own] & mask
        for k in range(1, n):
            value = value << 6 | padded[at[own] + k]
        code[own] = value
    return at, np.clip(code, 0, 0x10FFFF)


def split_spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start of each match of the split pattern (and the end of the data), and the first match of each text (and the end)."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    at, code = code_points(data)
    n = len(at)
    kind = classes[code]
    first = np.zeros(n + 1, bool)  # of a text
    first[np.searchsorted(at, offsets)] = True
    first[n] = True
    start = first[:n].copy()  # of a run of one class
    start[1:] |= kind[1:] != kind[:-1]
    space, blank = kind == SPACE, code == 32
    # The last white space before other characters stands alone, or goes with them if it is a blank.
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    begin = start | before
    joined = np.zeros(n, bool)
    joined[1:] = (before & blank)[:-1]
    begin &= ~joined
    # An apostrophe with one of the endings, where a match begins.
    mark = np.flatnonzero((code == 39) & begin)
    for ending in ENDINGS:
        own = mark[mark + len(ending) < n]
        for k, letter in enumerate(ending, 1):
            own = own[mark_ok(code, first, own + k, ord(letter))]
        begin[own + 1] = False
        after = own + 1 + len(ending)
        begin[after[after < n]] = True
    # A blank that an ending was followed by keeps its own rule; letters after an ending begin anew.
    begin &= ~joined
    starts = at[begin]
    return np.append(starts, len(data)), np.searchsorted(starts, offsets)


def mark_ok(code: np.ndarray, first: np.ndarray, at: np.ndarray, letter: int) -> np.ndarray:
    """Whether ``letter`` stands at each place, in the same text as the character before."""
    return (code[at] == letter) & ~first[at]


# ------------------------------------------------------------------ transducer

class Transducer:
    """The merges as a transducer, determinised on demand."""

    def __init__(self, tokens: list[bytes], most_moves: int = 250_000, most_matches: int = 150_000):
        self.tokens, self.most_moves, self.most_matches = tokens, most_moves, most_matches
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.made: dict[bytes, list[int]] = {}
        self.older: dict[bytes, list[int]] = {}
        self.left, self.right = [-1] * len(tokens), [-1] * len(tokens)
        self.ordered = True  # no token is made of one of a later rank
        self.step: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        #: Tokens that the merges never make of their own bytes; they stand for a whole match only.
        self.whole: dict[bytes, int] = {}
        inner = {0}
        for t, i in self.ranks.items():
            if len(t) > 1:
                parts = self.merged(t, 2)
                if len(parts) != 2:
                    self.whole[t] = i
                    continue
                self.left[i], self.right[i] = parts
                self.ordered &= max(len(self.tokens[p]) > 1 and p for p in parts) < i
            node = 0
            for b in t:
                inner.add(node)
                key = node << 8 | b
                node = self.step.get(key, 0)
                if not node:
                    node = self.step[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.inner = inner
        self.longest = max(map(len, tokens))
        self.restart()

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """Tokens of a short byte string by the rule itself: the pair of least rank first, the leftmost of equals; stops at ``until`` parts."""
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > until:
            best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def agree(self, a: int, b: int) -> bool:
        """Whether ``b`` may follow ``a``: no two parts that face each other at the border, while both stand, merge before they grow.

        Goes back in time from the whole tokens: the part that was made last is taken apart first.
        """
        if not self.ordered:
            return self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        tokens, get, none = self.tokens, self.ranks.get, 1 << 60
        grown_a = grown_b = none  # when the part becomes part of a larger one
        while True:
            rank = get(tokens[a] + tokens[b])
            if rank is not None and rank < grown_a and rank <= grown_b:
                return False
            made_a = a if self.left[a] >= 0 else -1
            made_b = b if self.left[b] >= 0 else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                a, grown_a = self.right[a], made_a
            else:
                b, grown_b = self.left[b], made_b

    def restart(self) -> None:
        """Forget all states but the first."""
        first = ((0, -1, ()),)
        self.states: dict[tuple, int] = {first: 0}
        self.runs: list[tuple] = [first]
        self.rest: list[tuple[int, ...]] = [()]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after a byte, and the tokens that are certain by then."""
        live: list[tuple[int, int, tuple[int, ...]]] = []
        step, inner, token_at = self.step, self.inner, self.token_at
        shared: tuple[int, ...] = ()
        last = -1
        for node, before, own in self.runs[state]:
            node = step.get(node << 8 | byte, 0)
            if not node:
                continue
            if node in inner:
                live.append((node, before, own))
            token = token_at[node]
            if token >= 0 and (before < 0 or self.agree(before, token)):
                shared, last = (*own, token), token
        n = len(shared)
        for _, _, own in live:
            n = min(n, len(own))
            while own[:n] != shared[:n]:
                n -= 1
        if n:
            live = [(node, before, own[n:]) for node, before, own in live]
        live.append((0, last, shared[n:]))
        out = self.moves[state << 8 | byte] = self.state(tuple(live)), shared[:n]
        return out

    def state(self, runs: tuple) -> int:
        """The number of a set of runs, oldest first; the last one stands at a token's end."""
        known = self.states.get(runs)
        if known is None:
            known = self.states[runs] = len(self.runs)
            self.runs.append(runs)
            self.rest.append(runs[-1][2])
        return known

    def encode(self, match: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        return self.encode_sorted([match], [0])[0]

    def encode_sorted(self, matches: list[bytes], same: list[int]) -> list[list[int]]:
        """Ids of sorted matches, each of which shares ``same`` first bytes with the one before: these are not read again."""
        if len(self.moves) > self.most_moves:
            self.restart()
        path, counts, tokens, moves, out = [0], [0], [], self.moves, []  # states and numbers of certain tokens after 0, 1, ... bytes
        for match, k in zip(matches, same, strict=True):
            if match in self.whole:
                out.append([self.whole[match]])
                del path[1:], counts[1:], tokens[:]
                continue
            k = min(k, len(path) - 1)
            del path[k + 1:], counts[k + 1:], tokens[counts[k]:]
            state, begun = path[k], moves
            for byte in match[k:]:
                made = moves.get(state << 8 | byte)
                if made is None:
                    if len(moves) > 2 * self.most_moves:
                        runs = self.runs[state]
                        self.restart()
                        moves, state = self.moves, self.state(runs)
                    made = self.move(state, byte)
                state, certain = made
                if certain:
                    tokens += certain
                if len(path) <= self.longest:
                    path.append(state)
                    counts.append(len(tokens))
            out.append([*tokens, *self.rest[state]])
            if moves is not begun:  # the states of this path are forgotten
                del path[1:], counts[1:], tokens[:]
        return out

    def encode_distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """Ids of distinct byte spans; spans that were met before are looked up."""
        if len(self.made) > self.most_matches:
            self.made, self.older = {}, self.made
        raw, made, older = data.tobytes(), self.made, self.older
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        out = [made.get(w) for w in words]
        new = []
        for i, ids in enumerate(out):
            if ids is None:
                ids = older.get(words[i])
                if ids is None:
                    new.append(i)
                else:
                    out[i] = made[words[i]] = ids
        if not new:
            return out
        new.sort(key=words.__getitem__)
        at, size = starts[new], (ends - starts)[new]
        head = data[np.minimum(at[:, None] + np.arange(16), len(data) - 1)]
        equal = (head[1:] == head[:-1]) & (np.arange(16) < np.minimum(size[1:], size[:-1])[:, None])
        same = [0, *np.cumprod(equal, axis=1).sum(axis=1).tolist()]
        for i, ids in zip(new, self.encode_sorted([words[i] for i in new], same), strict=True):
            out[i] = ids
            if len(words[i]) <= self.longest:
                made[words[i]] = ids
        return out


def encode_chunk(machine: Transducer, classes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts in a row, and the first id of each text (and the end)."""
    spans, first = split_spans(data, offsets, classes)
    starts, ends = spans[:-1], spans[1:]
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    _, sample, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    made = machine.encode_distinct(data, starts[sample], ends[sample])
    size = np.fromiter(map(len, made), np.int64, len(made))
    flat = np.fromiter((i for ids in made for i in ids), np.int32, int(size.sum()))
    own, at = size[which], (np.cumsum(size) - size)[which]
    end = np.cumsum(own)
    ids = flat[np.repeat(at - (end - own), own) + np.arange(int(end[-1]))]
    return ids, np.concatenate([[0], end])[first]


# ------------------------------------------------------------------ decoding

#: States of a UTF-8 reader: whole, bytes still needed, the four leads that narrow the next byte, invalid.
WHOLE, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, INVALID = range(9)


def utf8_moves() -> np.ndarray:
    """The next state for each state and byte."""
    m = np.full((9, 256), INVALID, np.uint8)
    m[WHOLE, :0x80] = WHOLE
    for low, high, state in ((0xC2, 0xDF, ONE), (0xE1, 0xEF, TWO), (0xF1, 0xF3, THREE), (0xE0, 0xE0, AFTER_E0), (0xED, 0xED, AFTER_ED),
                             (0xF0, 0xF0, AFTER_F0), (0xF4, 0xF4, AFTER_F4)):
        m[WHOLE, low:high + 1] = state
    for state, low, high, then in ((ONE, 0x80, 0xBF, WHOLE), (TWO, 0x80, 0xBF, ONE), (THREE, 0x80, 0xBF, TWO), (AFTER_E0, 0xA0, 0xBF, ONE),
                                   (AFTER_ED, 0x80, 0x9F, ONE), (AFTER_F0, 0x90, 0xBF, TWO), (AFTER_F4, 0x80, 0x8F, TWO)):
        m[state, low:high + 1] = then
    return m


class Decoder:
    """Bytes and text of ids, with the UTF-8 reader's moves over whole tokens."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.moves = utf8_moves()
        self.over = np.repeat(np.arange(9, dtype=np.uint8)[:, None], len(tokens), axis=1)
        for k in range(int(self.size.max())):
            own = np.flatnonzero(self.size > k)
            byte = self.flat[self.at[own] + k]
            for state in range(9):
                self.over[state, own] = self.moves[self.over[state, own], byte]

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of ids, and where each id's bytes end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("id outside the vocabulary")
        size = self.size[ids]
        end = np.cumsum(size)
        if not len(ids):
            return np.zeros(0, np.uint8), end
        return self.flat[np.repeat(self.at[ids] - (end - size), size) + np.arange(int(end[-1]))], end

    def state_after(self, ids: np.ndarray, state: int = WHOLE) -> int:
        """The reader's state after ids: tokens of whole characters are passed over where the state is whole."""
        busy = np.flatnonzero(self.over[WHOLE, ids])
        at, k = 0, 0
        while state != INVALID and at < len(ids):
            if state == WHOLE:
                k += int(np.searchsorted(busy[k:], at))
                if k == len(busy):
                    break
                at = int(busy[k])
            state = int(self.over[state, ids[at]])
            at += 1
        return state

    def stream(self) -> StreamDecoder:
        return StreamDecoder(self)


class StreamDecoder:
    """Takes ids in any pieces and gives their text as soon as its characters are whole."""

    def __init__(self, decoder: Decoder):
        self.decoder, self.state, self.held = decoder, WHOLE, b""

    def feed(self, ids: Iterable[int]) -> str:
        ids = np.asarray(list(ids) if not isinstance(ids, np.ndarray) else ids, np.int64)
        data = self.held + self.decoder.bytes_of(ids)[0].tobytes()
        state = self.decoder.state_after(ids, self.state)
        if state == INVALID:
            return self._repaired(data)
        self.state = state
        whole = len(data)
        if state != WHOLE:  # the lead of the unfinished character is among the last three bytes
            whole = max(i for i in range(max(0, len(data) - 3), len(data)) if data[i] >= 0xC0)
        self.held = data[whole:]
        return data[:whole].decode()

    def _repaired(self, data: bytes) -> str:
        """Byte by byte, with a mark for each maximal part that can't be read."""
        out: list[str] = []
        moves, state, begin, good = self.decoder.moves, WHOLE, 0, 0
        for i, byte in enumerate(data):
            then = int(moves[state, byte])
            if then == INVALID:
                out += [data[good:begin].decode(), "�"]
                good = begin = i if state != WHOLE else i + 1
                then = int(moves[WHOLE, byte]) if state != WHOLE else WHOLE
                if then == INVALID:
                    out.append("�")
                    good = begin = i + 1
                    then = WHOLE
            if then == WHOLE:
                begin = i + 1
            state = then
        out.append(data[good:begin].decode())
        self.state, self.held = state, data[begin:]
        return "".join(out)

    def finish(self) -> str:
        """The mark of a character that never became whole."""
        out = "�" if self.held else ""
        self.state, self.held = WHOLE, b""
        return out


# ------------------------------------------------------------------ tables

def _shared(df: DataFrame, tokens: list[bytes], encode: bool):
    """A broadcast of plain values, bounded by the vocabulary. A worker keeps the machine it has built from them beside them."""
    classes = character_classes() if encode else np.zeros(0, np.uint8)
    return df.sparkSession.sparkContext.broadcast({"tokens": tokens, "classes": classes.tobytes()})


def _machine(shared: dict) -> tuple[Transducer, np.ndarray]:
    if "machine" not in shared:
        shared["machine"] = Transducer(shared["tokens"]), np.frombuffer(shared["classes"], np.uint8)
    return shared["machine"]


def _decoder(shared: dict) -> Decoder:
    if "decoder" not in shared:
        shared["decoder"] = Decoder(shared["tokens"])
    return shared["decoder"]


def encode_documents(docs: DataFrame, tokens: list[bytes]) -> DataFrame:
    """(doc_id, ids) of each document."""
    shared = _shared(docs, tokens, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, classes = _machine(shared.value)
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(1)):
                ids, first = encode_chunk(machine, classes, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    shared = _shared(encoded, tokens, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                stream = decoder.stream()
                texts.append(stream.feed(ids.values.to_numpy(zero_copy_only=False).astype(np.int64)) + stream.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def token_report(docs: DataFrame, tokens: list[bytes]) -> DataFrame:
    """Digests of each document's ids and of the bytes they decode to."""
    encoded = encode_documents(docs, tokens)
    shared = _shared(docs, tokens, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        for batch in batches:
            column = batch.column(1)
            first = column.offsets.to_numpy()
            ids = column.values.to_numpy(zero_copy_only=False)
            a, b = [], []
            for at, to in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = ids[at:to]
                a.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                stream = decoder.stream()
                digest = hashlib.sha256()
                for k in range(0, max(1, len(own)), 65_536):
                    digest.update(stream.feed(own[k:k + 65_536]).encode())
                digest.update(stream.finish().encode())
                b.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(a, pa.string()),
                                              pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
