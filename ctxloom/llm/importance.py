"""Quality selection by importance resampling (operator 3).

Two generative models over hashed n-grams are counted: the target model on a
bounded, documented sample of labelled good rows (LABELS rows, smallest hash of
doc_id first), the raw model on all documents.  N-grams are byte trigrams and
pairs of word shapes (case, length class, last byte, whether the word repeats
the one before, told by length and two sums of its bytes).  A document's log weight is that of a passage of PASSAGE bytes
of it: the mean of log(target / raw) over its n-grams, times PASSAGE, each ratio
shrunk towards 1 where the target sample would hardly have seen the n-gram.  So
weights do not grow with the length of a text, and the noise below matters for
documents between the two models, whatever their length.

Resampling without replacement is Gumbel top-k: key = log weight + Gumbel noise
(a fixed function of seed and doc_id), the k largest keys are kept.  k is the
number of target-like documents that the weights themselves imply, the sum of
their logistic values.  The k-th key is found exactly by rounds of
counting in ever narrower ranges of keys, so nothing is sorted or collected.

Defined cases: null text is empty, has weight 0 and competes by noise alone; the
noise of a null doc_id is a function of its text; repeated rows get equal keys,
and rows tied at the k-th key are all kept (none if k is 0); without good labels
nothing is rejected; an empty table gives an empty table.  Texts are read in
parts of PART characters, cut at white space where there is some (n-grams across
such a cut are not counted), so memory does not grow with a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_map, record, staged, texts, tune

LABELS = 20_000  # labelled good rows the target model is fitted on
TRIGRAMS, SHAPES = 1 << 14, 1 << 12  # hash buckets
SHRINK = 5.0  # pseudo-counts added to both sides of every ratio
OVERLAP = 4.0  # n-grams that each character takes part in: the sum is divided by it
PASSAGE = 500  # bytes of text whose weight decides
PART = 1 << 20  # characters whose n-grams are held at once
SEED = 17

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[128:] = 1  # bytes of letters beyond ASCII, mostly lower case
_LENGTH = np.array([0, 0, 1, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 4, 4, 4] + [5] * 17)


def hashed_ngrams(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram buckets, first of each document, shape buckets, first of each document); each document has at least one of both."""
    raw = [b"\n\n" + t.encode("utf-8", "surrogatepass") + b"\n" for t in docs]
    data = np.frombuffer(b"".join(raw) + b"\n\n", np.uint8)
    starts = np.cumsum([0, *map(len, raw)])
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - 14)
    code = code[: starts[-1]].astype(np.int64)
    # words
    space = _SPACE[data[: starts[-1]]]
    edge = np.diff(space.view(np.int8))
    first, last = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1)
    document = np.searchsorted(starts, first, "right") - 1
    if not len(first):
        return code, starts[:-1], TRIGRAMS + np.zeros(len(docs), np.int64), np.arange(len(docs))
    length = last - first + 1
    kinds = _KIND[data]
    upper = np.concatenate([[0], np.cumsum(kinds == 2)])
    ups = upper[last + 1] - upper[first]
    case = np.where(ups == 0, 0, np.where(ups == 1, 1, 2)) + 3 * (kinds[first] == 2)
    # equal words in a row: length, sum of bytes and sum of bytes by place
    sums = np.concatenate([[0], np.cumsum(wide[: starts[-1]].astype(np.uint64) * (np.arange(starts[-1], dtype=np.uint64) + np.uint64(7)), dtype=np.uint64)])
    plain = np.concatenate([[0], np.cumsum(wide[: starts[-1]], dtype=np.uint64)])
    total = (plain[last + 1] - plain[first]).astype(np.uint64)
    moment = sums[last + 1] - sums[first] - total * first.astype(np.uint64)
    same = np.concatenate([[False], (total[1:] == total[:-1]) & (moment[1:] == moment[:-1]) & (length[1:] == length[:-1]) & (document[1:] == document[:-1])])
    shape = ((case * 6 + _LENGTH[np.minimum(length, 32)]) * 256 + data[last]) * 2 + same
    before = np.concatenate([[0], np.where(document[1:] == document[:-1], shape[:-1] + 1, 0)])
    pair = ((before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + shape.astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - 12)
    # one more, empty shape for each document keeps every range non-empty
    counts = np.bincount(document, minlength=len(docs))
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    shapes = np.full(at[-1], TRIGRAMS, np.int64)
    shapes[np.arange(len(first)) + document + 1] = TRIGRAMS + pair.astype(np.int64)
    return code, starts[:-1], shapes, at[:-1]


def in_parts(docs: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in groups of at most PART characters: (place of the document, text), long texts cut at white space."""
    places: list[int] = []
    held: list[str] = []
    size = 0
    for place, text in enumerate(docs):
        at = 0
        while True:
            end = min(len(text), at + PART)
            if end < len(text):
                end = next((c for w in " \n\t" if (c := text.rfind(w, at + PART // 2, end)) > 0), end)
            if held and size + end - at > PART:
                yield places, held
                places, held, size = [], [], 0
            places.append(place)
            held.append(text[at:end])
            size += end - at
            at = end
            if at >= len(text):
                break
    if held:
        yield places, held


def ngram_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(target, raw) counts by bucket over docs (text, target): each task sends a row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, TRIGRAMS + SHAPES), np.int64)
        for batch in batches:
            target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for places, parts in in_parts(texts(batch.column(0))):
                code, at, shape, shape_at = hashed_ngrams(parts)
                good = target[places]
                for own, first in ((code, at), (shape, shape_at)):
                    total[1] += np.bincount(own, minlength=TRIGRAMS + SHAPES)
                    if good.any():
                        total[0] += np.bincount(own[np.repeat(good, np.diff(np.append(first, len(own))))], minlength=TRIGRAMS + SHAPES)
        there = np.flatnonzero(total[1])
        yield record(bucket=(there, pa.int64()), target=(total[0][there], pa.int64()), raw=(total[1][there], pa.int64()))

    rows = docs.select("text", "target").mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect()
    out = np.zeros((2, TRIGRAMS + SHAPES), np.int64)
    for bucket, target, raw in rows:  # at most TRIGRAMS + SHAPES
        out[0, bucket], out[1, bucket] = target, raw
    return out[0], out[1]


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) by bucket; both models are normalised within trigrams and shapes."""
    out = np.zeros(len(raw))
    for part in (slice(0, TRIGRAMS), slice(TRIGRAMS, TRIGRAMS + SHAPES)):
        if target[part].sum():
            expected = raw[part] * (target[part].sum() / raw[part].sum())
            out[part] = np.log((target[part] + SHRINK) / (expected + SHRINK))
    out[TRIGRAMS] = 0.0
    return out / OVERLAP


def gumbel(seed: int):
    """Standard Gumbel noise as a fixed function of seed and doc_id, or of the text where there is no doc_id, in SQL."""
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed + 1), "text")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    uniform = (F.pmod(spread, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest (k at least 1) value of a double column, exactly, by counting in ever narrower ranges.

    Each round splits the range that holds it into 4096 slots and keeps one of
    them, so only slot counts reach the driver.
    """
    if k < 1:
        raise ValueError("k starts at 1")
    low, high = keys.agg(F.min(column), F.max(column)).first()
    while low < high:
        step = (high - low) / 4096
        slot = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)), F.lit(4095)) if step > 0 and low + step > low else (F.col(column) > F.lit(low)).cast("long")
        ranges = keys.where(F.col(column).between(low, high)).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)), F.min(column), F.max(column)).collect()
        for _, n, lo, hi in sorted(ranges, reverse=True):  # at most 4096
            if n >= k:
                low, high = lo, hi
                break
            k -= n
    return high


def importance_weights(docs: DataFrame, labels: DataFrame, label_rows: int = LABELS) -> DataFrame:
    """docs with log_weight: the log ratio of target to raw model, from all n-grams of the text, for PASSAGE bytes of it."""
    tune(docs.sparkSession)
    good = labels.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_rows)
    good = F.broadcast(good.select(F.col("doc_id").alias("good_id")))  # label_rows rows at most
    marked = docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().alias("target"))
    ratio = log_ratios(*ngram_counts(marked))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        weight, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for places, parts in in_parts(texts(batch.column(batch.schema.get_field_index("text")))):
            code, at, shape, shape_at = hashed_ngrams(parts)
            np.add.at(weight, places, np.add.reduceat(ratio[code], at) + np.add.reduceat(ratio[shape], shape_at))
            np.add.at(size, places, np.diff(np.append(at, len(code))))
        weight *= PASSAGE / size
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(weight, 9))], schema=batch.schema.append(pa.field("log_weight", pa.float64())))

    return arrow_map(docs, run, StructType([*docs.schema.fields, StructField("log_weight", DoubleType())]))


def select_by_importance(docs: DataFrame, labels: DataFrame, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, log_weight, key, kept) for every document, and the columns to carry."""
    weights = importance_weights(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry), labels)
    keyed = staged(weights.select("doc_id", *carry, "log_weight", F.round(F.col("log_weight") + gumbel(seed), 9).alias("key")), "keys")
    n, share = keyed.agg(F.count(F.lit(1)), F.sum(1 / (1 + F.exp(-F.greatest(F.least(F.col("log_weight"), F.lit(500.0)), F.lit(-500.0)))))).first()
    fitted = labels.where("quality = 1").limit(1).count() > 0
    k = round(share or 0) if fitted else n
    kept = F.col("key") >= F.lit(kth_largest(keyed, "key", k)) if 0 < k < n else F.lit(k >= n)
    return keyed.withColumn("kept", kept)
