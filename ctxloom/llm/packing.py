"""Sequence packing by shortest-pack-first over the length histogram (operator 7).

Documents become ids with an end id, cut into pieces of at most the sequence
length (all but a document's last piece are full).  The histogram of piece
lengths - bounded by the sequence length - is packed on the driver: lengths are
placed longest first, each into the packs with most room left, and packs are
kept as patterns with counts, never one by one.  Every slot of a pattern then
owns a range of ranks of its length; pieces find their sequence by the rank
they have among the pieces of equal length.

Ranks are counted within scan partitions and shifted by the partitions before,
so equal lengths, however common, never meet in one task.

Defined cases: a null text is empty and packs its end id alone; a null doc_id
stays null; repeated rows are packed once each; an empty table has no pieces.  The
ids of one text are held at once, about 5 bytes for each of its characters.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record, release, staged, texts, tune
from .wordcache import TextEncoder


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) patterns that together hold every length as often as the histogram says."""
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # room left -> pattern -> count
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        while left and open_packs and (room := max(open_packs)) >= length:
            patterns = open_packs[room]
            pattern = next(iter(patterns))
            used = min(left, patterns[pattern])
            patterns[pattern] -= used
            if not patterns[pattern]:
                del patterns[pattern]
            if not patterns:
                del open_packs[room]
            grown = open_packs[room - length]  # offered again while it is the one with most room
            key = (*pattern, length)
            grown[key] = grown.get(key, 0) + used
            left -= used
        while left:
            fit = capacity // length
            repeat = min(fit, left)
            used = left // repeat
            key = (length,) * repeat
            grown = open_packs[capacity - length * repeat]
            grown[key] = grown.get(key, 0) + used
            left -= used * repeat
    return [(count, pattern) for room in sorted(open_packs) for pattern, count in open_packs[room].items()]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """A row for each run of equal slots, sorted by (length, first rank): its ranks fill `times` slots of each sequence."""
    next_rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        k = 0
        while k < len(pattern):
            length, times = pattern[k], 1
            while k + times < len(pattern) and pattern[k + times] == length:
                times += 1
            rows.append((length, next_rank[length], sequence, offset, times))
            next_rank[length] += count * times
            offset += length * times
            k += times
        sequence += count
    rows.sort()
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("length", "rank", "sequence", "offset", "times"))}


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """The stored table of pieces: doc_id, start, length, ids_crc32, doc_tokens, part, place (rank of its length in the part)."""
    tune(docs.sparkSession)
    encoder = TextEncoder(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.concatenate([encoder.ids(text), end])
                packed = memoryview(ids.tobytes())
                for start in range(0, len(ids), capacity):
                    length = min(capacity, len(ids) - start)
                    rows.append((name, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)]), len(ids), part, seen[length]))
                    seen[length] += 1
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place")
            yield record(**{n: (c, pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)})
        release()

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, place long")
    return staged(pieces, "pieces")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Pieces of every document with the sequence and offset they are packed at."""
    pieces = cut_pieces(docs, tokenizer_path, end_id, capacity)
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = slots(shortest_pack_first(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    shifts = counts.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("shift"))
    ranked = pieces.join(shifts, ["part", "length"]).withColumn("rank", F.col("shift") + F.col("place"))
    # one sorted key for (length, rank): ranks stay below 2**50
    keys = (where["length"] << 50) | where["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            slot = np.searchsorted(keys, (length << 50) | rank, "right") - 1
            turn = rank - where["rank"][slot]
            sequence = where["sequence"][slot] + turn // where["times"][slot]
            offset = where["offset"][slot] + turn % where["times"][slot] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    packed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return packed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
