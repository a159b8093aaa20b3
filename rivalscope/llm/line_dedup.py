"""Lines repeated across documents, found by one ordered stream over range-partitioned hashes.

1. Each document is cut at line feeds in an Arrow task. A line whose key (white
   space stripped, A-Z lowered) is long enough gives (hash, document, position).
2. Rows are range-partitioned by (hash, document descending, position) and sorted
   so. As the document is part of the range, a line that a third of all documents
   share is spread over many tasks.
3. Every task streams its rows. The first document of a hash, the largest id,
   keeps its lines. Later ones wait until the hash has met ``least_docs``
   documents; from there on each is dropped at once. A run that crosses task
   borders is settled by the border summary: one row a task, read by the driver.
4. Dropped positions become one compressed keep bitmap a document. Texts are not
   shuffled in this step; ``apply_bitmaps`` joins them when the text is wanted.

The sorted rows are cut by ``checkpoint()``, which keeps the tasks' borders, so a
lost executor cannot move them between the two passes.

Defined cases: null or empty text is one empty line; a line's own document counts
once however often it holds the line; rows that share a document id (repeated
rows) are one document; a null id counts as the smallest; keys of equal length
and bytes are equal, compared by 128-bit hashes; an empty table gives no rows;
extra columns stay in ``apply_bitmaps`` and take no part elsewhere.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..shipping import ship
from .common import SPACES, unused

ship(__name__)

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LINES = "hash binary, doc_id long, pos int"
#: Stands for a null id: smaller than any id, and ids are sorted descending.
NO_ID = -(1 << 63)


def line_key(line: str) -> str:
    return line.strip(SPACES)


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(hash, doc_id, pos) of each line whose key has at least ``least_chars`` code points."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                h, d, p = [], [], []
                for doc, text in zip(ids[at:at + 256], batch.column(1).slice(at, 256).to_pylist(), strict=True):
                    if not text or len(text) < least_chars:
                        continue
                    for i, line in enumerate(text.split("\n")):
                        if len(line) >= least_chars and len(key := line.strip(SPACES)) >= least_chars:
                            h.append(hashlib.blake2b(key.encode().translate(_UPPER), digest_size=16).digest())
                            d.append(NO_ID if doc is None else doc)
                            p.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(d, pa.int64()), pa.array(p, pa.int32())],
                                                 ["hash", "doc_id", "pos"])
    return docs.select("doc_id", "text").mapInArrow(cut, LINES)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: its first and last hash; of each, the documents met and the first and last of them."""
    part, first, last, same = TaskContext.get().partitionId(), None, None, True
    for batch in batches:
        hashes, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for h, d in zip(hashes, docs, strict=True):
            if last is None or h != last[0]:
                if last is not None:
                    first, same = first or last, False
                last = [h, 1, d, d]
            elif d != last[3]:
                last[1], last[3] = last[1] + 1, d
    if last is not None:
        first = first or last
        yield pa.RecordBatch.from_pylist([{
            "part": part, "head": first[0], "head_docs": first[1], "head_first": first[2], "head_last": first[3],
            "tail": last[0], "tail_docs": last[1], "tail_first": last[2], "tail_last": last[3], "single": same}],
            schema=pa.schema([("part", pa.int32()), ("head", pa.binary()), ("head_docs", pa.int64()), ("head_first", pa.int64()),
                              ("head_last", pa.int64()), ("tail", pa.binary()), ("tail_docs", pa.int64()), ("tail_first", pa.int64()),
                              ("tail_last", pa.int64()), ("single", pa.bool_())]))


def carried(borders: list[dict]) -> dict[int, dict]:
    """For each task: the run that reaches it from before, and what follows its last run in later tasks.

    ``before``: documents met already, the keeper (first of them) and the last;
    ``after``: documents that follow the task's last run and are not in it.
    """
    out: dict[int, dict] = {}
    run: dict | None = None
    for b in borders:
        here = {"hash": None, "docs": 0, "keeper": 0, "last": 0, "after": 0}
        if run is not None and run["hash"] == b["head"]:
            here |= {k: run[k] for k in ("hash", "docs", "keeper", "last")}
        out[b["part"]] = here
        if b["single"] and here["hash"] is not None:
            run = {**run, "docs": run["docs"] + b["head_docs"] - (run["last"] == b["head_first"]), "last": b["head_last"]}
        else:
            run = {"hash": b["tail"], "docs": b["tail_docs"], "keeper": b["tail_first"], "last": b["tail_last"]}
    following: tuple[bytes, int, int] | None = None  # hash, documents, first of them
    for b in reversed(borders):
        if following and following[0] == b["tail"]:
            more = following[1] - (following[2] == b["tail_last"])
            out[b["part"]]["after"] = more
        else:
            more = 0
        following = ((b["head"], b["head_docs"] + more, b["head_first"]) if b["single"]
                     else (b["head"], b["head_docs"], b["head_first"]))
    return out


def _streamer(carry: dict[int, dict], ends: dict[int, bytes], least_docs: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        c = carry.get(part)
        if c is None:
            return
        run, docs, keeper, last = c["hash"], c["docs"], c["keeper"], c["last"]
        waiting: list[tuple[int, int]] = []
        for batch in batches:
            out_doc, out_pos = [], []
            for h, d, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if h != run:
                    run, docs, keeper, last, waiting = h, 1, d, d, []
                elif d != last:
                    docs, last = docs + 1, d
                if d == keeper:
                    continue
                # ``after`` documents of the last run are certain to come
                if docs + (c["after"] if h == ends[part] else 0) >= least_docs:
                    for doc, pos in waiting:
                        out_doc.append(doc)
                        out_pos.append(pos)
                    waiting = []
                    out_doc.append(d)
                    out_pos.append(p)
                else:
                    waiting.append((d, p))
            yield pa.RecordBatch.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out_pos, pa.int32())], ["doc_id", "pos"])
    return stream


def dropped_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, partitions: int | None = None) -> DataFrame:
    """(doc_id, pos) of each line to drop; a null id is given as the smallest long."""
    spark = docs.sparkSession
    lines = long_lines(docs, least_chars)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("hash"), F.col("doc_id").desc(), F.col("pos")]
    ordered = cut_lineage(lines.repartitionByRange(n, *order).sortWithinPartitions(*order))
    borders = [r.asDict() for r in ordered.mapInArrow(
        _borders, "part int, head binary, head_docs long, head_first long, head_last long, tail binary, tail_docs long, "
                  "tail_first long, tail_last long, single boolean").collect()]
    borders.sort(key=lambda b: b["part"])
    for b in borders:
        b["head"], b["tail"] = bytes(b["head"]), bytes(b["tail"])
    return ordered.mapInArrow(_streamer(carried(borders), {b["part"]: b["tail"] for b in borders}, least_docs), "doc_id long, pos int")


def pack(positions: np.ndarray) -> bytes:
    """A keep bitmap, compressed: bit i is 0 if line i goes. Lines past its end stay."""
    bits = np.ones((int(positions.max()) // 8 + 1) * 8, bool)
    bits[positions] = False
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def unpack(bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """(doc_id, keep) of each document that loses lines; a null id is given as the smallest long."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [pack(np.asarray(p, np.int64)) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["doc_id", "keep"])
    positions = dropped_lines(docs, least_chars, least_docs).groupBy("doc_id").agg(F.collect_list("pos").alias("pos"))
    return positions.mapInArrow(packed, "doc_id long, keep binary")


def _kept_lines(text: str | None, bitmap: bytes | None) -> tuple[list[str], int]:
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines, 0
    keep = unpack(bitmap)[:len(lines)]
    rest = lines[len(keep):]
    return [x for x, k in zip(lines, keep, strict=False) if k] + rest, int((~keep).sum())


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with one more column, the last: the bitmap, null where a document loses nothing."""
    own, keep = unused(docs, "_id"), unused(docs, "_keep")
    named = bitmaps.select(F.col("doc_id").alias(own), F.col("keep").alias(keep))
    return docs.withColumn(own, F.coalesce(F.col("doc_id"), F.lit(NO_ID))).join(named, own, "left").select(*docs.columns, keep)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; a text that loses no line is left as it is."""
    fields = docs.schema
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.column(batch.num_columns - 1).to_pylist()
            texts = [t if k is None else "\n".join(_kept_lines(t, k)[0])
                     for t, k in zip(batch.column(at).to_pylist(), keep, strict=True)]
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])
    return with_bitmaps(docs, bitmaps).mapInArrow(cut, fields)


def line_report(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Per document: lines before, lines dropped, SHA-256 of the text that stays."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped, sha = [], [], []
            for text, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, lost = _kept_lines(text, keep)
                n.append(len(kept) + lost)
                dropped.append(lost)
                sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)],
                                             ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
    joined = with_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, least_chars, least_docs))
    return joined.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
