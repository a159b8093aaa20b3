"""Byte merges against the library they match; hard negatives and lexical search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

pytest.importorskip("rivalscope.llm")

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rivalscope.llm import byte_bpe, hard_negatives, lexical_search  # noqa: E402
from rivalscope.llm.queries import BYTE_RANKS  # noqa: E402

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    for name in ("ids", "n", "terms", "score", "place", "n_tokens", "item_id"):
        df = df.withColumn(name, F.lit("x"))
    return df


# ------------------------------------------------------------------ byte merges

@pytest.fixture(scope="module")
def tokens():
    return byte_bpe.load_tokens(BYTE_RANKS)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def odd_texts(n):
    rng = random.Random(5)
    parts = ["'", "s", "t", "re", "ll", "d", " ", "  ", "\n", "\t", " ", "　", "a", "B", "é", "1", "٣", "-", "!", "''", "東", "😀", "́",
             "\x1c", "the", "\r\n", "ve", "x", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [*texts, None, "", "'s", " ", "a" * 3000, "ab" * 20_000, "straße " * 5000, "x\n\n\n y"]


def test_byte_merges_match_the_library(spark, tokens, library):
    texts = odd_texts(800) * 2
    rows = list(enumerate(texts)) + [(None, "null id"), (3, "same id"), (3, "same id")]
    df = documents(spark, rows).repartition(3)
    got = Counter(tuple(r) for r in byte_bpe.token_report(df, tokens).collect())
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    encoded = byte_bpe.encode_documents(df, tokens)
    back = Counter(tuple(r) for r in byte_bpe.decode_documents(encoded, tokens).collect())
    assert back == Counter((i, t or "") for i, t in rows)
    none = byte_bpe.token_report(documents(spark, []), tokens)
    assert none.collect() == [] and none.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_every_character_is_split_alike(tokens, library):
    machine, classes = byte_bpe.Transducer(tokens), byte_bpe.character_classes()
    for low in range(0, 0x110000, 4096):
        text = "".join(f"{chr(c)}a{chr(c)} " for c in range(low, low + 4096, 7) if not 0xD800 <= c < 0xE000)
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = byte_bpe.encode_chunk(machine, classes, data, np.array([0, len(data)]))
        assert ids.tolist() == library.encode_ordinary(text)


def test_transducer_starts_anew(tokens, library):
    """A machine with room for few states gives the same ids, also inside one long match."""
    machine = byte_bpe.Transducer(tokens, most_moves=50, most_matches=5)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeñö") for _ in range(rng.randrange(1, 30))) for _ in range(300)] + ["thequickbrownfox" * 50]
    for w in words:
        assert machine.encode(w.encode()) == library.encode_ordinary(w)
        assert len(machine.moves) < 200


def test_tokens_that_no_merge_makes():
    """A token that the merges never reach stands for a whole match only, as in the library."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abcd", b"xy", b"xyz"]
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    machine = byte_bpe.Transducer(tokens)
    for w in ["abcd", "abcde", "xabcd", "bcd", "abc", "xyz", "xyzxyz", "aab", "abab", "abcdabcd"]:
        assert machine.encode(w.encode()) == library.encode_ordinary(w), w


def test_pairs_agree_by_parts_as_by_merging(tokens):
    machine, rng = byte_bpe.Transducer(tokens), random.Random(4)
    for _ in range(4000):
        a, b = rng.randrange(len(tokens)), rng.randrange(len(tokens))
        whole = tokens[a] + tokens[b]
        k = rng.randrange(1, len(whole))
        if whole[:k] in machine.ranks and whole[k:] in machine.ranks:
            a, b = machine.ranks[whole[:k]], machine.ranks[whole[k:]]
        assert machine.agree(a, b) == (machine.merged(tokens[a] + tokens[b]) == [a, b])


def test_stream_decoding(tokens):
    decoder, rng = byte_bpe.Decoder(tokens), random.Random(6)
    single = {t: i for i, t in enumerate(tokens)}
    for _ in range(2000):
        ids = [rng.randrange(len(tokens)) if rng.random() < 0.4 else single[bytes([rng.randrange(0x80, 0x100)])] for _ in range(rng.randrange(9))]
        want = b"".join(tokens[i] for i in ids).decode("utf-8", "replace")
        stream, parts = decoder.stream(), ""
        at = 0
        while at < len(ids):
            to = at + rng.randrange(1, 4)
            parts += stream.feed(ids[at:to])
            at = to
        assert parts + stream.finish() == want
    stream = decoder.stream()
    face = [single[bytes([b])] for b in "😀".encode()]
    assert [stream.feed([i]) for i in face] == ["", "", "", "😀"]
    with pytest.raises(ValueError):
        stream.feed([len(tokens)])


# ------------------------------------------------------------------ hard negatives

def mined(rows, anchors, positives=5, negatives=5):
    whole = {(i, lab, tuple(math.floor(float(x) * 256) for x in v)) for i, lab, v in rows
             if None not in (i, lab, v) and all(x is not None and math.isfinite(x) and abs(x) < 2 ** 31 for x in v)}
    whole = [r for r in whole if sum(x * x for x in r[2]) < 2 ** 62]
    out = Counter()
    for a in whole:
        if not anchors(a[0]):
            continue
        near = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in whole if b != a and len(a[2]) == len(b[2])))
        for p, pid, _ in [x for x in near if x[2] == a[1]][:positives]:
            fit = [x for x in near if x[2] != a[1] and 80 * -p <= 100 * -x[0] <= 100 * -p][:negatives]
            for k, (n, nid, _) in enumerate(fit, 1):
                out[a[0], pid, k, nid, -p, -n] += 1
    return out


def vectors(seed, n, width=12, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = [(int(i), int(rng.integers(3)), [float(np.float32(x)) for x in centres[i % 6] + spread * rng.normal(size=width)]) for i in range(n)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("spread", "block"), [(0.1, 20_000), (1.0, 40)])
def test_hard_negatives(spark, spread, block):
    rows = vectors(3, 300, spread=spread)
    rows += [(1000 + i, lab, v) for i, lab, v in rows[:40]]  # ties
    rows += rows[:30]  # repeated rows
    rows += [(None, 1, rows[0][2]), (2000, None, rows[0][2]), (2100, 1, None), (2200, 1, [None] * 12), (2300, 1, [float("nan")] * 12),
             (2400, 1, [float("inf")] * 12), (2500, 1, [0.0] * 12), (2600, 1, [1.0, 2.0]), (2605, 2, [1.0, 1.9]), (2610, 1, [0.5, 1.0]), (2700, 2, []),
             (2705, 2, []), (2706, 1, []), (2800, 0, [3e30] * 12)]
    df = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], VECTORS)
    for name in ("row", "score", "place", "width", "v"):
        df = df.withColumn(name, F.lit("x"))
    got = Counter(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, block=block).collect())
    assert got == mined(rows, lambda i: i % 20 == 0)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_hold_and_prune():
    """Every level bounds the true product from both sides, more closely than the one before, and few rows reach exact scoring."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 64))
    x = np.floor(256 * (centres[rng.integers(40, size=3000)] + 0.2 * rng.normal(size=(3000, 64)))).astype(np.int64)
    means, deviations = hard_negatives.summaries(x)
    import pandas as pd

    side = hard_negatives.Side(pd.DataFrame({"row": range(3000), "vec_id": range(3000), "label": 0, "width": 64, "v": list(x), "means": list(means),
                                             "deviations": list(deviations)}))
    true = (x[:50] @ x.T).astype(float)
    gap = np.inf
    for m, d in side.levels:
        middle, reach = m[:50] @ m.T, d[:50] @ d.T
        assert (np.abs(true - middle) <= reach + 1e-6 * np.abs(true).max()).all()
        assert reach.mean() < gap
        gap = reach.mean()
    kth = np.sort(true, axis=1)[:, -20].astype(np.int64)
    a, b = np.arange(50), np.arange(3000)
    scored = 0
    for i in a:
        own, scores, ok = hard_negatives.needed_scores(side, a[i:i + 1], side, b, kth[i:i + 1], np.array([1 << 62]))
        scored += len(own)
        assert (np.sort(scores[0])[-20:] == np.sort(true[i])[-20:]).all()
    assert scored < 0.2 * 50 * 3000


def test_large_components_are_exact():
    a, b = np.array([[1 << 30, -(1 << 29) + 1]]), np.array([[(1 << 30) - 1, 3]])
    assert hard_negatives.exact_scores(a, b, 2.0 ** 61)[0, 0] == (1 << 30) * ((1 << 30) - 1) + 3 * (1 - (1 << 29))


# ------------------------------------------------------------------ lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def searched(docs, items, k):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    total, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = Counter()
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for i, c in counts:
            n = sum(c.values())
            m = 100 - 25 + (25 * n * total) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                    for t in terms_of(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, i, -s] += 1
    return out


@pytest.mark.parametrize(("cell", "block", "share"), [(2048, 32, 32), (50, 4, 2)])
def test_lexical_search(spark, monkeypatch, cell, block, share):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(150)] + ["Straße", "naïve", "東京", "7", "Über"]
    pick = lambda: vocab[min(len(vocab) - 1, int(rng.expovariate(0.03)))]
    docs = [(k, " ".join(pick() for _ in range(rng.randrange(1, 60)))) for k in range(400)]
    docs += [(1000 + k, docs[7][1]) for k in range(60)]  # copies: ties by id
    docs += [docs[3], docs[3], (None, docs[9][1]), (None, docs[9][1]), (2000, None), (2001, ""), (2002, " -- \n"), (2003, "w1 " * 30_000), (2004, "W1,w2;W3")]
    items = [(k, " ".join(pick() for _ in range(rng.randrange(1, 25)))) for k in range(30)]
    items += [(100, None), (101, ""), (102, "nowhere found"), (103, "w1 w1 w1 W2"), (104, docs[7][1]), items[0], items[0], (105, docs[3][1])]
    monkeypatch.setattr(lexical_search, "CELL", cell)
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "SEED_SHARE", share)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x"))
    got = Counter(tuple(r) for r in lexical_search.ranked_documents(documents(spark, docs), asked).collect())
    assert got == searched(docs, items, 20)


def test_lexical_search_in_passes_and_empty(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "TERMS_AT_ONCE", 5)
    docs = [(k, f"a{k % 3} b{k % 5} c") for k in range(40)]
    items = [(k, f"a{k} b{k + 1} zz") for k in range(6)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in lexical_search.ranked_documents(documents(spark, docs), asked, k=7).collect())
    assert got == searched(docs, items, 7)
    assert lexical_search.ranked_documents(documents(spark, []), asked).collect() == []
    none = lexical_search.ranked_documents(documents(spark, docs), asked.limit(0))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_skip_documents_that_cannot_win():
    """Summaries bound every document of their block, and far fewer documents are scored than hold a term of the item."""
    rng = np.random.default_rng(3)
    rows = [np.unique(np.concatenate([rng.integers(0, 300, 30), 300 + rng.integers(0, 20, 12)])) for _ in range(1000)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    cell = lexical_search.Cell(first, np.concatenate(rows), rng.integers(1, 900, first[-1]))
    weight = np.zeros(320, np.int64)
    terms = np.array([5, 40, 301, 310, 319])
    gains = np.array([900, 800, 20, 10, 5])
    for k in np.searchsorted(cell.listed, terms[:3]).tolist():
        docs, start, at, term, greatest = cell.blocks(k)
        weight[terms] = gains
        bound = np.add.reduceat(np.where(term >= cell.listed[k], weight[term] * greatest, 0), at)
        weight[terms[terms < cell.listed[k]]] = 0
        true = cell.scores(docs, weight)
        assert (np.repeat(bound, np.diff(start)) >= true).all() and sorted(docs) == sorted({*docs})
        weight[:] = 0
    best = [lexical_search.Best(5, 1)]
    scored = lexical_search.search_cell(cell, np.arange(1000), np.ones(1000, bool), [(terms, gains)], best, weight)
    holding = sum(bool({*r} & {*terms}) for r in rows)
    weight[terms] = gains
    assert best[0].score.tolist() == sorted(cell.scores(np.arange(1000), weight).tolist())[::-1][:5]
    assert scored < holding / 2


# ------------------------------------------------------------------ executors without the package

_ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from rivalscope.llm import byte_bpe, hard_negatives, lexical_search, pieces, queries
from rivalscope.session import build_session
spark = build_session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2"}})
def bare(_):
    try:
        import rivalscope
        return [1]
    except ImportError:
        return [0]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(bare).collect() == [0], "workers have the package"
docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
model = pieces.load_pieces(queries.PIECE_MODEL)
encoded = pieces.encode_documents(docs, model)
assert [r.text for r in pieces.decode_documents(encoded, model).orderBy("doc_id").collect()] == ["one two three", ""]
assert byte_bpe.token_report(docs, byte_bpe.load_tokens(queries.BYTE_RANKS)).count() == 2
items = spark.createDataFrame([(7, "two three")], "item_id long, text string")
assert [tuple(r)[:3] for r in lexical_search.ranked_documents(docs, items).collect()] == [(7, 1, 1)]
v = spark.createDataFrame([(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.9], 2)], "vec_id long, embedding array<double>, label int")
assert hard_negatives.hard_negatives(v, F.col("vec_id") == 0).count() == 1
print("done")
"""


def test_operators_without_the_package_on_executors(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", _ELSEWHERE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("done"), run.stderr[-3000:]
