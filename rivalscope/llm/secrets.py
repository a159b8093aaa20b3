"""Secrets found by fixed patterns and by a linear-chain conditional random field.

Words of a text are tokens, tagged O (outside), B (a secret begins) or I (inside).
A token's score depends on its own shape (length, kinds of characters, separators,
key words), the shapes of two words before and one after, and on features of the
whole text; neighbouring tags score too, and I may follow B or I alone. Spans are
the tags of the Viterbi path.

Training is weakly supervised: the base patterns first mark every document that has
a match. In half of the texts, by a hash, key words are hidden: their tokens look like
any word and only the value is tagged; in half of those, the words of a match before its value are
left out as well. So the value's own shape and its neighbours carry weight, and values under
other names, or under none, are found as well. At most ``sample`` documents are fitted, by smallest seeded hashes of the
id: up to half of them from those with a match, the others from those without. Of the
windows around matches and at one seeded place of each text, at most four times
``sample`` (those without a secret, at most one a text, then smallest seeded hashes) are fitted by
gradient ascent on the likelihood. The sample's bound is a parameter; all documents are decoded, whole.

A Viterbi path is O wherever B and I score below O by more than any neighbour can
give back. Only the tokens between such places are decoded, many stretches at a
time; the path is the same as that of the whole chain.

Defined cases: null text is empty and has no spans; no match in any document means
no model and no spans, which a warning tells; a text is one chain however long it is; repeated
rows get equal spans; an empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import hashlib
import re
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import chunks, lowered, span_hashes, stash, word_spans

ship(__name__)

# The base patterns.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")
LEAST_HEX, LEAST_ACCESS, LEAST_VALUE = 24, 20, 6

N_SHAPES = 4 * 6 * 4 * 2
N_FILE = 8
#: The bit of a shape that tells a key word.
KEY = 1
#: Places whose shape a token sees, relative to it.
PLACES = (-2, -1, 0, 1)
O, B, I = 0, 1, 2  # noqa: E741
NEVER = -1e9

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_KIND = np.zeros((256, 5), np.int32)  # digit, lower case or beyond ASCII, upper case, = or :, @ or / as in addresses
_KIND[list(b"0123456789"), 0] = 1
_KIND[list(range(97, 123)) + list(range(128, 256)), 1] = 1
_KIND[list(range(65, 91)), 2] = 1
_KIND[list(b"=:"), 3] = 1
_KIND[list(b"@/"), 4] = 1


def _runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true bytes; a run ends where a text ends."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    begin, last = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1] | edge[1:-1]
    last[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text of a chunk: (start, kind, end) in bytes of the text, in order."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if not len(data):
        return found
    starts, ends = _runs(_HEX[data], offsets)
    long = ends - starts >= LEAST_HEX
    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        i = int(np.searchsorted(offsets, s, "right")) - 1
        found[i].append((s - int(offsets[i]), 2, e - int(offsets[i])))
    low = lowered(data).tobytes()
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if any(low.find(k, a, b) >= 0 for k in (b"passw", b"secret", b"token", b"api")):
            found[i] += [(m.start() - a, 0, m.end() - a) for m in ASSIGN.finditer(raw, a, b) if m.end(2) - m.start(2) >= LEAST_VALUE]
        if raw.find(b"AKIA", a, b) >= 0:
            found[i] += [(m.start() - a, 1, m.end() - a) for m in ACCESS.finditer(raw, a, b) if m.end() - m.start() >= LEAST_ACCESS]
        found[i].sort()
    return found


_KEYWORD_HASHES = None


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape of each token as a small number."""
    global _KEYWORD_HASHES
    if not len(starts):
        return np.zeros(0, np.int32)
    if _KEYWORD_HASHES is None:
        joined = np.frombuffer(b"".join(KEYWORDS), np.uint8)
        at = np.cumsum([0, *map(len, KEYWORDS)])
        _KEYWORD_HASHES = np.sort(span_hashes(joined, at[:-1], at[1:]))
    length = ends - starts
    total = [np.concatenate([[0], np.cumsum(_KIND[data, k])]) for k in range(5)]
    digit, lower, upper, sep, address = ((t[ends] - t[starts]) for t in total)
    letters = lower + upper
    mixed = np.where(letters == 0, np.where(digit > 0, 2, 4), np.where(digit > 0, 3, np.where((upper > 1) & (lower > 0), 1, 0)))
    mixed = np.where((address > 0) & (letters > 0), 5, mixed)
    size = np.searchsorted([6, 12, 24], length, "right")
    ends_sep = _KIND[data[ends - 1], 3] > 0
    marks = np.where(sep == 0, 0, np.where(sep == length, 1, np.where(ends_sep, 2, 3)))
    # quotes, commas and the like around a key word don't hide it
    a, b = starts.copy(), ends.copy()
    plain = (_KIND[:, :3].sum(axis=1) > 0)[data]
    a = np.where((length > 1) & ~plain[a], a + 1, a)
    b = np.where((b - a > 1) & ~plain[b - 1], b - 1, b)
    key = np.isin(span_hashes(lowered(data), a, b), _KEYWORD_HASHES)
    return (((size * 6 + mixed) * 4 + marks) * 2 + key).astype(np.int32)


def file_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A small number for each text: shares of digits, separators and upper case, each low or high."""
    total = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(_KIND[data], axis=0)]) if len(data) else np.zeros((1, 5), np.int64)
    n = np.maximum(np.diff(offsets), 1)[:, None]
    share = (total[offsets[1:]] - total[offsets[:-1]]) / n
    return ((share[:, 0] > 0.02) * 4 + (share[:, 3] > 0.01) * 2 + (share[:, 2] > 0.1)).astype(np.int32)


@dataclass
class Field:
    """Weights: by place, shape and tag; by file feature and tag; from tag to tag."""

    shape: np.ndarray
    file: np.ndarray
    move: np.ndarray


def node_scores(model: Field, shape: np.ndarray, file: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Scores by token and tag; ``first`` and ``last`` bound each token's text, so that neighbours come from the same text."""
    at = np.arange(len(shape))
    out = model.file[file].copy()
    for k, place in enumerate(PLACES):
        there = at + place
        inside = (there >= first) & (there < last)
        out[inside] += model.shape[k][shape[there[inside]]]
    return out


def viterbi_tags(model: Field, nodes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Tags of the best path of each text, which begins and ends in O."""
    tags = np.zeros(len(nodes), np.int8)
    if not len(nodes):
        return tags
    move = model.move
    gain = nodes[:, 1:] - nodes[:, :1]
    # What a path can win back around one token: the moves into it, to its follower and, as the
    # follower changes from I to B, on from there; and that change itself.
    finite = move[move > NEVER / 2]
    back = 3 * (finite.max() - finite.min()) + max(0.0, float((nodes[:, I] - nodes[:, B]).max())) + 1e-6
    active = gain.max(axis=1) > -back
    at = np.flatnonzero(active)
    if not len(at):
        return tags
    cut = np.flatnonzero((np.diff(at) > 1) | (first[at[1:]] != first[at[:-1]])) + 1
    begins, lengths = at[np.concatenate([[0], cut])], np.diff(np.concatenate([[0], cut, [len(at)]]))
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    best = move[O][None, :] + nodes[begins]
    points: list[np.ndarray] = []
    final = best.copy()
    for t in range(1, int(lengths[0])):
        n = int(np.searchsorted(-lengths, -t, "left"))  # stretches longer than t
        step = best[:n, :, None] + move[None]
        points.append(step.argmax(axis=1).astype(np.int8))
        best = step.max(axis=1) + nodes[begins[:n] + t]
        final[:n] = best
    state = (final + move[:, O][None, :]).argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = int(np.searchsorted(-lengths, -t, "left"))
        tags[begins[:n] + t] = state[:n]
        if t:
            state[:n] = points[t - 1][np.arange(n), state[:n]]
    return tags


def _text_bounds(first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: its text, and the first token and the one after the last of that text."""
    counts = np.diff(first_word)
    doc = np.repeat(np.arange(len(counts)), counts)
    return doc, first_word[:-1][doc], first_word[1:][doc]


# ------------------------------------------------------------------ training

def matched(docs: DataFrame) -> DataFrame:
    """(doc_id, found): whether a base pattern matches, for every row."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([bool(x) for x in base_spans(data, offsets)])],
                                                 ["doc_id", "found"])
    return docs.select("doc_id", "text").mapInArrow(mark, "doc_id long, found boolean")


def training_windows(docs: DataFrame, sample: int, seed: int, around: int = 6) -> list[dict]:
    """Shapes, file feature and tags of windows in the sampled documents."""
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    marked = stash(matched(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("found").alias("found")), "matched")
    having = marked.where("found").orderBy(*order).limit(max(1, sample // 2)).select("doc_id")
    n = having.count()
    if not n:
        if marked.take(1):
            warnings.warn("no document matches a base pattern: no conditional random field is fitted, no spans are found", stacklevel=2)
        return []
    ids = stash(having.union(marked.where("not found").orderBy(*order).limit(sample - n).select("doc_id")), "fitted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, data, offsets in chunks(batch.column(1)):
                starts, ends, first_word = word_spans(data, offsets)
                shape, file, base = shapes(data, starts, ends), file_features(data, offsets), base_spans(data, offsets)
                for i, spans in enumerate(base):
                    lo, hi = int(first_word[i]), int(first_word[i + 1])
                    tags = np.zeros(hi - lo, np.int8)
                    s, e = starts[lo:hi] - offsets[i], ends[lo:hi] - offsets[i]
                    draw = zlib.crc32(b"%d %d" % (seed, hi - lo) + data[offsets[i]:offsets[i + 1]].tobytes())
                    places = [draw % (hi - lo)] if hi > lo else []
                    hidden, bare = bool(draw >> 31), draw >> 30 == 3
                    own = shape[lo:hi] & ~KEY if hidden else shape[lo:hi]
                    there = np.ones(hi - lo, bool)
                    for a, kind, b in spans:
                        x, y = int(np.searchsorted(e, a, "right")), int(np.searchsorted(s, b, "left"))
                        if hidden and kind == 0:  # a value has no blanks: it is the last token
                            there[x:y - 1] = not bare
                            x = y - 1
                        if not tags[x:y].any():
                            tags[x:y] = I
                            tags[x] = B
                        places.append(x)
                    done = -1
                    for p in sorted(places):
                        x, y = max(p - around, done + 1, 0), min(p + around + 4, hi - lo)
                        while y < hi - lo and tags[y] == I:
                            y += 1
                        while x > done + 1 and tags[x] == I:
                            x -= 1
                        if there[x:y].any():
                            rows.append({"shape": own[x:y][there[x:y]].tolist(), "file": int(file[i]), "tags": tags[x:y][there[x:y]].tolist(),
                                         "any": bool(tags[x:y].any())})
                            done = y - 1
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shape", pa.list_(pa.int32())), ("file", pa.int32()),
                                                              ("tags", pa.list_(pa.int32())), ("any", pa.bool_())]))
    found = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
             .mapInArrow(cut, "shape array<int>, file int, tags array<int>, any boolean"))
    order = F.xxhash64(F.lit(seed), "shape", "file", "tags")
    return [r.asDict() for r in found.orderBy("any", order, "shape", "file", "tags").limit(4 * sample).collect()]


class Windows:
    """Training windows side by side, longest first, with what their likelihood needs."""

    def __init__(self, windows: list[dict]) -> None:
        windows = sorted(windows, key=lambda w: (-len(w["shape"]), w["shape"], w["tags"]))
        self.n, self.length = len(windows), len(windows[0]["shape"])
        shape = np.full((self.n, self.length), -1, np.int64)
        self.tags = np.zeros((self.n, self.length), np.int64)
        self.file = np.array([w["file"] for w in windows])
        self.size = np.array([len(w["shape"]) for w in windows])
        for i, w in enumerate(windows):
            shape[i, :self.size[i]], self.tags[i, :self.size[i]] = w["shape"], w["tags"]
        self.live = np.arange(self.length)[None, :] < self.size[:, None]
        self.seen = []
        for place in PLACES:
            there = np.full_like(shape, -1)
            if place < 0:
                there[:, -place:] = shape[:, :place]
            elif place:
                there[:, :-place] = shape[:, place:]
            else:
                there = shape
            # By place, then window; one shape more, of no weight, beyond the ends.
            self.seen.append(np.ascontiguousarray(np.where(self.live & (there >= 0), there, N_SHAPES).T))
        #: Windows longer than each place; those come first.
        self.counts = [int((self.size > t).sum()) for t in range(self.length)]
        #: How often each tag follows another, from and to the O around a window.
        self.moves = np.zeros((3, 3))
        np.add.at(self.moves[O], self.tags[:, 0], 1.0)
        np.add.at(self.moves[:, O], self.tags[np.arange(self.n), self.size - 1], 1.0)
        for t in range(1, self.length):
            np.add.at(self.moves, (self.tags[:self.counts[t], t - 1], self.tags[:self.counts[t], t]), 1.0)
        self.live = np.ascontiguousarray(self.live.T)
        self.hot = np.eye(3)[self.tags.T] * self.live[:, :, None]


def barred() -> np.ndarray:
    bar = np.zeros((3, 3))
    bar[O, I] = NEVER
    return bar


def likelihood(w: Windows, theta: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Log-likelihood of the windows' tags, summed, and its slope by forward and backward sums, scaled place by place."""
    n, length, counts = w.n, w.length, w.counts
    move = theta["move"] + barred()
    m_ = np.exp(move)
    node = np.repeat(theta["file"][w.file][None], length, axis=0)
    for k, s in enumerate(w.seen):
        node += np.concatenate([theta["shape"][k], np.zeros((1, 3))])[s]
    top = node.max(axis=2)
    e = np.exp(node - top[:, :, None])
    alpha, beta, scale = np.zeros((length, n, 3)), np.zeros((length, n, 3)), np.ones((length, n))
    for t in range(length):
        m = counts[t]
        step = (m_[O] if t == 0 else alpha[t - 1, :m] @ m_) * e[t, :m]
        scale[t, :m] = step.sum(axis=1)
        alpha[t, :m] = step / scale[t, :m, None]
    last = w.size - 1
    closing = alpha[last, np.arange(n)] @ m_[:, O]
    beta[last, np.arange(n)] = m_[:, O][None] / closing[:, None]
    grad = {k: np.zeros_like(v) for k, v in theta.items()}
    for t in range(length - 1, 0, -1):
        m = counts[t]
        ahead = e[t, :m] * beta[t, :m] / scale[t, :m, None]
        beta[t - 1, :m] = ahead @ m_.T
        grad["move"] -= m_ * (alpha[t - 1, :m].T @ ahead)
    chance = alpha * beta
    grad["move"][O] -= chance[0].sum(axis=0)
    grad["move"][:, O] -= chance[last, np.arange(n)].sum(axis=0)
    grad["move"] += w.moves
    slope = w.hot - chance
    by_tag = np.ascontiguousarray(slope.reshape(-1, 3).T)
    for k, s in enumerate(w.seen):
        for tag in range(3):
            grad["shape"][k][:, tag] = np.bincount(s.ravel(), by_tag[tag], N_SHAPES + 1)[:N_SHAPES]
    np.add.at(grad["file"], w.file, slope.sum(axis=0))
    total = (node * w.hot).sum() + (w.moves * move).sum() - np.log(scale).sum() - (top * w.live).sum() - np.log(closing).sum()
    return float(total), grad


def fit_field(windows: list[dict], rounds: int = 120, rate: float = 0.3, decay: float = 1e-3) -> Field | None:
    """Maximum likelihood by Adam steps; None where no window holds a secret."""
    if not any(w["any"] for w in windows):
        return None
    batch = Windows(windows)
    theta = {"shape": np.zeros((len(PLACES), N_SHAPES, 3)), "file": np.zeros((N_FILE, 3)), "move": np.zeros((3, 3))}
    slow = {k: np.zeros_like(v) for k, v in theta.items()}
    fast = {k: np.zeros_like(v) for k, v in theta.items()}
    for step in range(1, rounds + 1):
        _, grad = likelihood(batch, theta)
        for k in theta:
            g = grad[k] / batch.n - decay / 100 * theta[k]
            slow[k] = 0.9 * slow[k] + 0.1 * g
            fast[k] = 0.99 * fast[k] + 0.01 * g * g
            theta[k] += rate * (slow[k] / (1 - 0.9 ** step)) / (np.sqrt(fast[k] / (1 - 0.99 ** step)) + 1e-8)
    return Field(theta["shape"], theta["file"], theta["move"] + barred())


# ------------------------------------------------------------------ decoding

def find_secrets(docs: DataFrame, sample: int = 20_000, seed: int = 5) -> DataFrame:
    """(doc_id, spans) of all documents; spans are (kind, start, end) in code points, by start and kind."""
    model = fit_field(training_windows(docs, sample, seed))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column(1)):
                found = base_spans(data, offsets)
                if model is not None and len(data):
                    starts, ends, first_word = word_spans(data, offsets)
                    doc, first, last = _text_bounds(first_word)
                    nodes = node_scores(model, shapes(data, starts, ends), file_features(data, offsets)[doc], first, last)
                    tags = viterbi_tags(model, nodes, first, last)
                    for t in np.flatnonzero(tags == B).tolist():
                        y = t + 1
                        while y < last[t] and tags[y] == I:
                            y += 1
                        i = int(doc[t])
                        a, b = int(starts[t] - offsets[i]), int(ends[y - 1] - offsets[i])
                        if not any(s < b and a < e for s, kind, e in found[i] if kind < 3):
                            found[i].append((a, 3, b))
                spans = []
                for i, own in enumerate(found):
                    if own:
                        points = np.concatenate([[0], np.cumsum((data[offsets[i]:offsets[i + 1]] & 0xC0) != 0x80)])
                        own = sorted((int(points[a]), kind, int(points[b])) for a, kind, b in own)
                    spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in own])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(spans, pa.list_(pa.struct(
                        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])
    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def secret_report(docs: DataFrame, sample: int = 20_000, seed: int = 5) -> DataFrame:
    """Counts of base spans by kind, the digest of base spans, and all spans as text."""
    found = find_secrets(docs, sample, seed)
    text = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
