"""Piece encoding with the N best segmentations, and decoding.

A text is a lattice of pieces; a path's score is the sum of its pieces' scores.
Forward Viterbi scores give the best path up to each place. They are exact
heuristics for A-star search backward from the end: a partial path ending at a
place can be completed with just that score, so complete paths leave the queue in
order of their scores, and N of them are the N best.

No piece spans a word border (white space after other characters) or a line feed,
so the lattice of a text is a chain of small lattices, one a word. Words are
scored many at a time; that pass also tells how much a word's second best path
loses. At most N - 1 words of a text can differ from their best path in the N best
of the text: those with the smallest losses. Only these are searched by A-star,
and their lists are merged by score.

Pieces, scores and byte pieces come from a model file; nothing is trained. Scores
of the model are whole numbers and are summed exactly. A character without a
piece scores ten below the worst piece and is written as its UTF-8 bytes.

Equal scores: the path whose last piece is longest is best; among other equal
paths the order is fixed but has no meaning.

Defined cases: null or empty text gives no pieces, one empty path of score 0; fewer
than N paths give all of them; a text that holds the space mark itself does not
survive the round trip, as in the model's own library; repeated rows give equal
results; an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

ship(__name__)

MARK = "▁"
#: Longest word, in characters, that is scored in a table of words; longer ones are scored alone.
LONGEST = 40
#: Words that a task remembers at most; then it starts anew.
REMEMBERED = 250_000
#: Characters of text handled at a time.
SLICE_CHARS = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 21
_UNKNOWN = -1


@dataclass
class Pieces:
    """Piece strings with id and score, ids of the 256 byte pieces, and the score of an unknown character."""

    ids: dict[str, tuple[int, int]]
    bytes_of: list[bytes]
    byte_ids: list[int]
    unknown: int
    longest: int


def load_pieces(path: str) -> Pieces:
    """Read a model file on the driver; its table is bounded by the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, byte_ids, bytes_of = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            bytes_of.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            bytes_of.append(b"")
        else:
            ids[piece] = (i, int(model.get_score(i)))
            bytes_of.append(piece.replace(MARK, " ").encode())
    return Pieces(ids, bytes_of, byte_ids, min(s for _, s in ids.values()) - 10, max(map(len, ids)))


def words_of(text: str) -> list[str]:
    """The parts of a text between which no piece reaches; spaces become marks, with one more in front."""
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


_WORDS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


# ------------------------------------------------------------------ one lattice

def forward(word: str, pieces: Pieces) -> tuple[list[int], list[list[tuple[int, int, int]]]]:
    """Best score up to each place, and the arcs (from, id, score) that end there, longest first."""
    best, arcs = [0], [[]]
    for j in range(1, len(word) + 1):
        into = []
        for i in range(max(0, j - pieces.longest), j):
            found = pieces.ids.get(word[i:j])
            if found:
                into.append((i, *found))
        if not into or into[-1][0] != j - 1:
            into.append((j - 1, _UNKNOWN, pieces.unknown))
        arcs.append(into)
        best.append(max(best[i] + s for i, _, s in into))
    return best, arcs


def n_best_paths(word: str, pieces: Pieces, n: int) -> list[tuple[int, list[int]]]:
    """Up to ``n`` paths (score, ids) by falling score: backward A-star with forward scores as heuristics."""
    best, arcs = forward(word, pieces)
    queue: list[tuple[int, int, int, int, tuple]] = [(-best[-1], 0, len(word), 0, ())]
    out, turn = [], 0
    while queue and len(out) < n:
        _, _, at, behind, path = heapq.heappop(queue)
        if at == 0:
            ids: list[int] = []
            while path:
                (place, i), path = path
                ids += [pieces.byte_ids[b] for b in word[place].encode("utf-8", "surrogatepass")] if i == _UNKNOWN else [i]
            out.append((behind, ids))
            continue
        for i, piece, score in arcs[at]:
            turn += 1
            heapq.heappush(queue, (-(best[i] + score + behind), turn, i, behind + score, ((i, piece), path)))
    return out


# ------------------------------------------------------------------ many words

def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class WordTable:
    """Best paths of words, filled as words are met; plain arrays, so that texts are put together by gathers."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        powers = [1]
        for _ in range(LONGEST + 1):
            powers.append(powers[-1] * int(_P) % (1 << 64))
        self.power = np.array(powers, np.uint64)
        inverse = pow(int(_P), -1, 1 << 64)
        self.inverse = np.array([pow(inverse, k, 1 << 64) for k in range(LONGEST + 2)], np.uint64)
        self.by_hash: dict[int, tuple[int, int]] = {}
        texts = list(pieces.ids)
        hashes = np.zeros(len(texts), np.uint64)
        lengths = np.array([len(t) for t in texts])
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            code = np.array([texts[i] for i in own], f"<U{length}").view(np.uint32).reshape(len(own), length)
            hashes[own] = self._prefix(code)[:, -1]
        hashes = _mixed(hashes)
        ids = np.array([pieces.ids[t][0] for t in texts], np.int64)
        scores = np.array([pieces.ids[t][1] for t in texts], np.int64)
        slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self.key, self.id, self.score = np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, np.int32), np.zeros(1 << _SLOTS, np.int32)
        self.crowded = np.zeros(1 << _SLOTS, bool)
        _, first = np.unique(slot, return_index=True)
        self.key[slot[first]], self.id[slot[first]], self.score[slot[first]] = hashes[first], ids[first], scores[first]
        rest = np.setdiff1d(np.arange(len(texts)), first)
        self.crowded[slot[rest]] = True
        rest = rest[np.argsort(hashes[rest])]
        self.more, self.more_id, self.more_score = hashes[rest], ids[rest], scores[rest]
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.best, self.loss = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.searched: dict[str, list[tuple[int, list[int]]]] = {}

    def _prefix(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros((len(code), code.shape[1] + 1), np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * self.power[None, :code.shape[1]], axis=1, out=out[:, 1:])
        return out

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mixed(hashes)
        slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        ok = self.key[slot] == h
        ids, scores = self.id[slot], self.score[slot]
        odd = np.flatnonzero(self.crowded[slot] & ~ok)
        if len(odd) and len(self.more):
            at = np.minimum(np.searchsorted(self.more, h[odd]), len(self.more) - 1)
            hit = self.more[at] == h[odd]
            ok[odd[hit]], ids[odd[hit]], scores[odd[hit]] = True, self.more_id[at[hit]], self.more_score[at[hit]]
        return ok, ids, scores

    def add(self, words: list[str]) -> None:
        """Score new words and keep their best path and the loss of their second best (-1: there is none)."""
        lengths = np.array([len(w) for w in words])
        paths: list[np.ndarray | None] = [None] * len(words)
        best, loss = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            if length > LONGEST:
                for i in own.tolist():
                    best[i], loss[i], ids = self._alone(words[i])
                    paths[i] = np.array(ids, np.int32)
            else:
                for at in range(0, len(own), 8192):
                    part = own[at:at + 8192]
                    best[part], loss[part], found = self._together([words[i] for i in part.tolist()], int(length))
                    for i, ids in zip(part.tolist(), found, strict=True):
                        paths[i] = ids
        sizes = np.array([len(p) for p in paths], np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.length = np.concatenate([self.length, sizes])
        self.flat = np.concatenate([self.flat, *paths]).astype(np.int32)
        self.best, self.loss = np.concatenate([self.best, best]), np.concatenate([self.loss, loss])

    def _alone(self, word: str) -> tuple[int, int, list[int]]:
        best, arcs = forward(word, self.pieces)
        at, least, ids = len(word), -1, []
        while at:
            ranked = sorted(((best[at] - best[i] - s, i, p) for i, p, s in arcs[at]), key=lambda x: (x[0], x[1]))
            if len(ranked) > 1 and (least < 0 or ranked[1][0] < least):
                least = ranked[1][0]
            _, i, p = ranked[0]
            ids[:0] = [self.pieces.byte_ids[b] for b in word[i].encode("utf-8", "surrogatepass")] if p == _UNKNOWN else [p]
            at = i
        return best[-1], least, ids

    def _together(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        n, none = len(words), -(1 << 60)
        code = np.array(words, f"<U{length}").view(np.uint32).reshape(n, length)
        prefix = self._prefix(code)
        best = np.zeros((n, length + 1), np.int64)
        second = np.full((n, length + 1), none, np.int64)
        step, piece = np.zeros((n, length + 1), np.int64), np.zeros((n, length + 1), np.int32)
        for j in range(1, length + 1):
            top, next_, width, own = np.full(n, none), np.full(n, none), np.zeros(n, np.int64), np.zeros(n, np.int32)
            for i in range(max(0, j - self.pieces.longest), j):  # longest first: it wins when equal
                ok, ids, scores = self._find((prefix[:, j] - prefix[:, i]) * self.inverse[i])
                value = np.where(ok, best[:, i] + scores, none)
                if i == j - 1:
                    value = np.where(ok, value, best[:, i] + self.pieces.unknown)
                    ids = np.where(ok, ids, _UNKNOWN)
                better = value > top
                next_ = np.where(better, top, np.maximum(next_, value))
                top, width, own = np.where(better, value, top), np.where(better, j - i, width), np.where(better, ids, own)
            best[:, j], second[:, j], step[:, j], piece[:, j] = top, next_, width, own
        on = np.zeros((n, length + 1), bool)
        on[:, length] = True
        row = np.arange(n)
        for j in range(length, 0, -1):
            at = on[:, j]
            on[row[at], j - step[at, j]] = True
        slack = np.where(on & (second > none // 2), best - second, 1 << 60)
        slack[:, 0] = 1 << 60
        least = slack.min(axis=1)
        on[:, 0] = False
        r, c = np.nonzero(on)
        ids, bounds = piece[r, c], np.searchsorted(r, np.arange(n + 1))
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.unique(r[ids == _UNKNOWN]).tolist():
            spelled: list[int] = []
            for k in range(bounds[i], bounds[i + 1]):
                spelled += ([self.pieces.byte_ids[b] for b in words[i][c[k] - 1].encode("utf-8", "surrogatepass")]
                            if ids[k] == _UNKNOWN else [int(ids[k])])
            out[i] = np.array(spelled, np.int32)
        return best[:, length], np.where(least >= 1 << 59, -1, least), out

    def known(self, words: list[str]) -> np.ndarray:
        """Places of words in the table; new ones are added."""
        index = self.index
        fresh = [w for w in dict.fromkeys(words) if w not in index]
        if fresh:
            if len(index) + len(fresh) > REMEMBERED and index:
                self.reset()
                index, fresh = self.index, list(dict.fromkeys(words))
            for w in fresh:
                index[w] = len(index)
            self.add(fresh)
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def alternatives(self, word: str, n: int) -> list[tuple[int, list[int]]]:
        found = self.searched.get(word)
        if found is None:
            found = self.searched[word] = n_best_paths(word, self.pieces, n)
        return found


def merged(lists: list[list[int]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The ``n`` smallest sums that take one loss of each list, with the places taken."""
    sums: list[tuple[int, tuple[int, ...]]] = [(0, ())]
    for losses in lists:
        sums = heapq.nsmallest(n, ((a + b, (*places, k)) for a, places in sums for k, b in enumerate(losses)))
    return sums


def text_paths(table: WordTable, words: list[str], at: np.ndarray, n: int) -> tuple[list[int], list[list[dict]]]:
    """Scores of the ``n`` best paths of a text and, for all but the first, what each changes in the best path."""
    total = int(table.best[at].sum())
    loss = table.loss[at]
    can = np.flatnonzero(loss >= 0)
    if n < 2 or not len(can):
        return [total], []
    if len(can) > n - 1:
        edge = np.partition(loss[can], n - 2)[n - 2]
        less, same = can[loss[can] < edge], can[loss[can] == edge]
        can = np.sort(np.concatenate([less, same[:n - 1 - len(less)]]))
    lists = [table.alternatives(words[i], n) for i in can.tolist()]
    sums = merged([[paths[0][0] - s for s, _ in paths] for paths in lists], n)
    before = np.concatenate([[0], np.cumsum(table.length[at])])
    changes = []
    for _, places in sums[1:]:
        changes.append([{"at": int(before[i]), "drop": int(before[i + 1] - before[i]), "ids": lists[k][p][1]}
                        for k, (i, p) in enumerate(zip(can.tolist(), places, strict=True)) if p])
    return [total - s for s, _ in sums], changes


def path_ids(best: list[int], changes: list[dict]) -> list[int]:
    """The ids of another path, from the best one and its changes."""
    out = list(best)
    for c in sorted(changes, key=lambda c: -c["at"]):
        out[c["at"]:c["at"] + c["drop"]] = c["ids"]
    return out


def decode_ids(ids: list[int], bytes_of: list[bytes]) -> str:
    """The text of ids: byte pieces joined, the space in front taken away."""
    text = b"".join(map(bytes_of.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


# ------------------------------------------------------------------ tables

_CHANGE = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def encode_documents(docs: DataFrame, pieces: Pieces, n: int = 3) -> DataFrame:
    """Per document: the best path's ids, scores of the ``n`` best, changes of the others, and whether decoding gives the text back."""
    # Bounded by the vocabulary; plain values, so that executors need no copy of the package.
    shared = docs.sparkSession.sparkContext.broadcast({f.name: getattr(pieces, f.name) for f in fields(pieces)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(**shared.value)
        table = WordTable(own)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= SLICE_CHARS):
                    chars += len(texts[to])
                    to += 1
                cut = [words_of(t) for t in texts[at:to]]
                places = table.known([w for ws in cut for w in ws])
                sizes = table.length[places]
                ends = np.cumsum(sizes)
                flat = table.flat[np.repeat(table.start[places] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
                word_at = np.concatenate([[0], np.cumsum([len(ws) for ws in cut])])
                piece_at = np.concatenate([[0], ends])[word_at].astype(np.int32)
                scores, changes, back = [], [], []
                for k, ws in enumerate(cut):
                    s, c = text_paths(table, ws, places[word_at[k]:word_at[k + 1]], n)
                    scores.append(s)
                    changes.append(c)
                    back.append(decode_ids(flat[piece_at[k]:piece_at[k + 1]].tolist(), own.bytes_of) == texts[at + k])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array(np.diff(piece_at).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(piece_at), pa.array(flat)), pa.array(scores, pa.list_(pa.int64())),
                     pa.array(changes, _CHANGE), pa.array(back, pa.bool_())],
                    ["doc_id", "n_pieces", "ids", "scores", "changes", "round_trip"])
                at = to
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_pieces long, ids array<int>, scores array<long>, "
             "changes array<array<struct<at:int,drop:int,ids:array<int>>>>, round_trip boolean")


def decode_documents(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces.bytes_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(x, shared.value) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
