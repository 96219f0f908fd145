"""Token ids in files of range-ANS segments (operator 2).

A segment holds whole documents.  Its ids share one static frequency table
(16-bit scale) and are cut into blocks; each block is coded on its own by LANES
interleaved 32-bit states that renormalise by 16-bit words into one stream.
The block directory is the list of checkpoints - word offset, final states and
CRC-32 of the block's ids - so any block decodes without the others.

Segment layout (little-endian):
  magic "RSG1", u32 flags (1: ids are coded as two 16-bit halves), u64 ids,
  u32 documents, u32 blocks, u32 steps, u32 lanes, u32 symbols
  documents x (i64 doc_id, u8 doc_id present, u64 ids of the document)
  symbols x (u32 symbol, u32 frequency)
  blocks x (u64 first word, u32 crc32, lanes x u32 state)
  u16 words

Defined cases: a null text is empty (one id: the end id); a null doc_id sorts
first and comes back null; equal doc_ids keep separate rows, in file order; an
empty table gives no files.  A segment is closed once it
holds SEGMENT_IDS ids, so a longer text is a segment of its own, held whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record, release, staged, texts, tune
from .wordcache import TextEncoder

SCALE_BITS = 16
LANES = 64
BLOCK_IDS = 8192
SEGMENT_IDS = 2_000_000  # a segment is closed by the document that reaches this many ids

_HEAD = struct.Struct("<4sIQIIIII")
_LOW16, _SHIFT = np.uint32(0xFFFF), np.uint32(16)


class CorruptSegment(ValueError):
    """A segment or block that does not match its checksum or layout."""


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**16, close to counts in proportion."""
    total, spare = int(counts.sum()), (1 << SCALE_BITS) - len(counts)
    freq = 1 + (counts.astype(np.float64) * spare // total).astype(np.int64)
    freq[int(np.argmax(counts))] += (1 << SCALE_BITS) - int(freq.sum())
    return freq.astype(np.uint32)


def encode_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, lanes: int = LANES, block_ids: int = BLOCK_IDS) -> bytes:
    """The segment of the given documents, whose ids (unsigned 32-bit) are laid end to end."""
    lengths = np.asarray(lengths, "<u8")
    ids = np.ascontiguousarray(ids, "<u4")
    halves = int(ids.max(initial=0)) > 0xFFFF
    coded = ids.view("<u2").astype(np.uint32) if halves else ids
    count = np.bincount(coded, minlength=1)
    symbols = np.flatnonzero(count).astype("<u4")
    freq = normalised(count[symbols]) if len(symbols) else np.zeros(0, np.uint32)
    steps = max(1, min(block_ids, len(coded)) + lanes - 1) // lanes if len(coded) else 0
    blocks = -(-len(coded) // (steps * lanes)) if steps else 0
    out = [_HEAD.pack(b"RSG1", int(halves), len(ids), len(doc_ids), blocks, steps, lanes, len(symbols))]
    index = np.zeros(len(doc_ids), np.dtype([("id", "<i8"), ("ok", "u1"), ("n", "<u8")]))
    index["id"], index["ok"], index["n"] = [x or 0 for x in doc_ids], [x is not None for x in doc_ids], lengths
    out += [index.tobytes(), np.stack([symbols, freq.astype("<u4")], 1).tobytes()]
    if blocks:
        where = np.zeros(int(symbols[-1]) + 1, np.uint32)
        where[symbols] = np.arange(len(symbols), dtype=np.uint32)
        rank = np.full(blocks * steps * lanes, np.argmax(freq), np.uint32)  # the tail is padded by the commonest symbol
        rank[: len(coded)] = where[coded]
        rank = rank.reshape(blocks, steps, lanes)
        cum = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint32)
        state = np.full((blocks, lanes), 1 << 16, np.uint32)  # stays below 2**32 throughout
        words = np.empty((steps, blocks, lanes), np.uint16)
        sent = np.empty((steps, blocks, lanes), bool)
        for t in range(steps - 1, -1, -1):
            s = rank[:, t]
            f = freq[s]
            high = state >> _SHIFT
            spill = high >= f
            words[t], sent[t] = (state & _LOW16).astype(np.uint16), spill
            state = np.where(spill, high, state)
            q = state // f
            state = (q << _SHIFT) + (state - q * f) + cum[s]
        by_block = sent.transpose(1, 0, 2)
        stream = words.transpose(1, 0, 2)[by_block]
        first = np.concatenate([[0], np.cumsum(by_block.reshape(blocks, -1).sum(1))])[:-1]
        per = steps * lanes
        for b in range(blocks):
            out.append(struct.pack("<QI", int(first[b]), zlib.crc32(coded[b * per : (b + 1) * per].astype("<u4").tobytes())))
            out.append(state[b].astype("<u4").tobytes())
        out.append(stream.astype("<u2").tobytes())
    return b"".join(out)


def read_segment(data: bytes, only: range | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, its presence, ids per document, all ids); only: the blocks to decode, others are left out."""
    try:
        magic, halves, n, docs, blocks, steps, lanes, n_symbols = _HEAD.unpack_from(data)
        if magic != b"RSG1":
            raise CorruptSegment("not a segment")
        at = _HEAD.size
        index = np.frombuffer(data, np.dtype([("id", "<i8"), ("ok", "u1"), ("n", "<u8")]), docs, at)
        at += index.nbytes
        pairs = np.frombuffer(data, "<u4", 2 * n_symbols, at).reshape(-1, 2)
        at += pairs.nbytes
        table = np.frombuffer(data, np.dtype([("word", "<u8"), ("crc", "<u4"), ("state", "<u4", (lanes,))]), blocks, at)
        at += table.nbytes
        stream = np.frombuffer(data, "<u2", (len(data) - at) // 2, at)
    except (struct.error, ValueError) as e:
        raise CorruptSegment(str(e)) from e
    total, per = n * (2 if halves else 1), steps * lanes
    chosen = np.arange(blocks)[only.start : only.stop] if only is not None else np.arange(blocks)
    ids = np.zeros(0, "<u4")
    if len(chosen):
        freq = pairs[:, 1].astype(np.uint32)
        if int(freq.sum()) != 1 << SCALE_BITS:
            raise CorruptSegment("frequency table")
        owner = np.repeat(np.arange(n_symbols, dtype=np.uint32), pairs[:, 1].astype(np.int64))
        cum = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint32)
        bias = np.arange(1 << SCALE_BITS, dtype=np.uint32) - cum[owner]
        share = freq[owner]
        state = table["state"][chosen].astype(np.uint32)
        at_word = table["word"][chosen].astype(np.int64)
        padded = np.concatenate([stream, np.zeros(lanes + 1, "<u2")]).astype(np.uint32)
        rank = np.empty((len(chosen), steps, lanes), np.uint32)
        for t in range(steps):
            slot = state & _LOW16
            rank[:, t] = owner[slot]
            state = share[slot] * (state >> _SHIFT) + bias[slot]
            need = state <= _LOW16
            offset = np.cumsum(need, 1, dtype=np.int32)
            word = padded[np.minimum(at_word[:, None] + offset - 1, len(padded) - 1)]
            state = np.where(need, (state << _SHIFT) | word, state)
            at_word += offset[:, -1]
        coded = pairs[:, 0][rank.reshape(len(chosen), per)].astype("<u4")
        for row, b in zip(coded, chosen, strict=True):
            if zlib.crc32(row[: min(per, total - b * per)].tobytes()) != table["crc"][b]:
                raise CorruptSegment(f"block {b}")
        if (state != np.uint32(1 << 16)).any():
            raise CorruptSegment("final states")
        ids = coded.reshape(-1)[: total - int(chosen[0]) * per]
        if halves:
            ids = ids.astype("<u2").view("<u4")
    return index["id"], index["ok"].astype(bool), index["n"].astype(np.int64), ids


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Tokenize (doc_id, text) and write segments in ascending doc_id order; returns the stored table.

    Rows: part, segment, n_docs, n_ids, data.  Parts are ranges of doc_id, so
    (part, segment) is the order of the files.
    """
    tune(docs.sparkSession)
    encoder = TextEncoder(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0
        end = np.array([end_id], "<u4")

        def close() -> pa.RecordBatch:
            data = encode_segment(names, np.array([len(x) for x in held]), np.concatenate(held))
            return record(part=([part], pa.int64()), segment=([segment], pa.int64()), n_docs=([len(names)], pa.int64()), n_ids=([size], pa.int64()), data=([data], pa.binary()))

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.concatenate([encoder.ids(text), end])
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= segment_ids:
                    yield close()
                    names, held, size, segment = [], [], 0, segment + 1
        if names:
            yield close()
        release()

    # rows without an id are ranged by their place, so they need not be one task's; no text is read for that
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("_place")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("*", place)
    ordered = docs.repartitionByRange("doc_id", "_place").sortWithinPartitions("doc_id", "_place").drop("_place")
    return staged(ordered.mapInArrow(run, "part long, segment long, n_docs long, n_ids long, data binary"), "token_files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(part, segment, doc_id, at, n_tokens, ids): documents of the stored segments; at counts within the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                names, there, n, ids = read_segment(data)
                ends = np.cumsum(n)
                for lo in range(0, len(n), 2000):
                    hi = min(lo + 2000, len(n))
                    first = int(ends[lo - 1]) if lo else 0
                    cuts = np.concatenate([[first], ends[lo:hi]]) - first
                    values = pa.array(ids[first : ends[hi - 1]].astype(np.int64))
                    yield record(
                        part=([part] * (hi - lo), pa.int64()), segment=([segment] * (hi - lo), pa.int64()),
                        doc_id=(pa.array(names[lo:hi], mask=~there[lo:hi]), pa.int64()), at=(ends[lo:hi] - n[lo:hi], pa.int64()),
                        n_tokens=(n[lo:hi], pa.int64()), ids=(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values), pa.list_(pa.int64())),
                    )

    return files.select("part", "segment", "data").mapInArrow(run, "part long, segment long, doc_id long, at long, n_tokens long, ids array<long>")


def token_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, segment) of every document, read back from the stored segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                names, there, n, ids = read_segment(data)
                ends = np.cumsum(n)
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield record(
                    part=([part] * len(n), pa.int64()), segment=([segment] * len(n), pa.int64()), doc_id=(pa.array(names, mask=~there), pa.int64()),
                    at=(ends - n, pa.int64()), n_tokens=(n, pa.int64()), ids_crc32=(crc, pa.int64()),
                )

    rows = files.select("part", "segment", "data").mapInArrow(run, "part long, segment long, doc_id long, at long, n_tokens long, ids_crc32 long")
    # offsets of parts over their sums (a row for each part), then of segments within their part
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    places = files.select("part", "segment", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("inside")).join(parts, "part")
    return rows.join(places, ["part", "segment"]).select("doc_id", (F.col("before") + F.col("inside") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "segment")
