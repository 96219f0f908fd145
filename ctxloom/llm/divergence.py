"""Quality rules with distribution divergence (operator 6).

Base counts and rules per document, then two histograms - character classes and
the common words of the known languages - are compared with the reference of
the document's language by the Jensen-Shannon distance (base 2, 0 to 1).
References are the summed histograms of all documents of a language, in a table
of one row per language; documents without one have the reference of all
documents.  The references of the LANGS most frequent languages go to the tasks
as they are, the others by a join, in which no language is a large share of rows.
A histogram is only judged above a minimum length.

A text without common words is nearer to its reference than a clean text in two
languages, so the word distance alone cannot tell it.  The common-word histogram
is therefore judged a second time as two classes, common and other words: a text
with a smaller share of common words than its reference is rejected beyond
COMMON_PART of the distance that a text without any has to that reference.
References with a share below MIN_COMMON_SHARE are of no known language, and
judge no text this way.

Words are runs of characters other than space and U+0009-U+000D.

Defined cases: null text has no words; it fails the base rules.  A null doc_id
stays null, repeated rows are judged alike (and counted in the references each
time); a reference that is its own document alone has distance 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from .common import arrow_map, mix64, staged, texts, tune
from .minhash import _words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50  # base rules
MIN_CHARS, MIN_COMMON_WORDS = 200, 100  # below these a histogram is not judged
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.42
COMMON_PART, MIN_COMMON_SHARE = 0.36, 0.1  # of labelled documents of 100+ words, good ones reach 0.29, junk starts at 0.41
LANGS = 64

# Frequent function words of the known languages, most frequent first.
COMMON_WORDS = {
    "en": "the of and to a in is that it for on with as was be by this are from at or an",
    "fr": "de la le les et des en un du une que est pour qui dans par sur au pas avec",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y a los se del las un por con no una su para es al lo",
}
# Classes of ASCII characters; letters beyond ASCII are a class of their own.
CLASSES = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": " \t",
    "line": "\n\r\x0b\x0c",
    "stop": ".,;:?",
    "quote": "'\"()-",
    "shout": "!",
    "symbol": "#*$%&|<>",
}
SYMBOLS = CLASSES["symbol"]
_CLASS_NAMES = [*CLASSES, "other ASCII", "beyond ASCII"]
_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _chars in enumerate(CLASSES.values()):
    _CLASS_OF[list(_chars.encode())] = _k
_CLASS_OF[128:192], _CLASS_OF[192:] = len(_CLASS_NAMES), len(CLASSES) + 1  # continuation bytes are dropped

_VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def _variants() -> tuple[np.ndarray, np.ndarray]:
    pairs = {}
    for k, w in enumerate(_VOCABULARY):
        for form in (w, w.capitalize()):
            for end in ("", ",", "."):
                pairs[_words[(form + end).encode()]] = k
    keys = np.array(sorted(pairs), np.uint64)
    return keys, np.array([pairs[int(k)] for k in keys], np.int64)


_FORMS, _FORM_OF = _variants()
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def document_counts(text: str) -> tuple[int, int, int, int, int, np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class histogram, common-word histogram (last: other words)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = np.bincount(_CLASS_OF, bytes_of, len(_CLASS_NAMES) + 1)[: len(_CLASS_NAMES)].astype(np.int64)
    word_chars = len(text) - int(bytes_of[32] + bytes_of[9:14].sum())
    n_symbols = int(bytes_of[list(SYMBOLS.encode())].sum())
    n_dup = 0
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        n_dup = len(lines) - len(set(lines))
    common = np.zeros(len(_VOCABULARY) + 1, np.int64)
    n_repeat = 0
    if n:
        w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
        at = np.minimum(np.searchsorted(_FORMS, w), len(_FORMS) - 1)
        common = np.bincount(np.where(_FORMS[at] == w, _FORM_OF[at], len(_VOCABULARY)), minlength=len(_VOCABULARY) + 1)
        if n > 3:
            windows = mix64(w[:-2] * _STEP[0] + w[1:-1] * _STEP[1] + w[2:] * _STEP[2])
            order = np.argsort(windows, kind="stable")
            same = windows[order[1:]] == windows[order[:-1]]
            found = np.zeros(n, bool)
            twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            for k in range(3):
                found[twice + k] = True
            n_repeat = int(found.sum())
    return n, word_chars, n_symbols, n_dup, n_repeat, classes, common


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of two count tables; 0 where a row is empty."""
    p, q = (x / np.maximum(x.sum(1, keepdims=True), 1) for x in (np.asarray(p, float), np.asarray(q, float)))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / m), 0).sum(1) for x in (p, q)]
    empty = (p.sum(1) == 0) | (q.sum(1) == 0)
    return np.where(empty, 0, np.sqrt(np.maximum((parts[0] + parts[1]) / 2, 0)))


def lacks_common(common: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Whether the rows of a common-word table have too few common words for those of the reference table."""
    p, q = (np.stack([x[:, :-1].sum(1), x[:, -1]], 1) for x in (common, reference))
    share, usual = (x[:, 0] / np.maximum(x.sum(1), 1) for x in (p, q))
    none = np.tile([0, 1], (len(p), 1))
    return (usual >= MIN_COMMON_SHARE) & (share < usual) & (js_distance(p, q) > COMMON_PART * js_distance(none, q))


_COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_counts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, the base counts, and both histograms of every document, and the columns to carry."""
    tune(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", *carry)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [document_counts(t) for t in texts(batch.column(2))]
        numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        lists = [pa.array([r[k].tolist() for r in rows], pa.list_(pa.int64())) for k in (5, 6)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *numbers, *lists, *batch.columns[3:]], names=["doc_id", "lang", *_COUNTED, "classes", "common", *carry])

    types = [StructField(c, LongType()) for c in _COUNTED] + [StructField(c, ArrayType(LongType())) for c in ("classes", "common")]
    return arrow_map(named, run, StructType([*named.schema.fields[:2], *types, *named.schema.fields[3:]]))


def references(counts: DataFrame) -> DataFrame:
    """lang, n, usual_classes, usual_common: the documents of a language and their summed histograms, null for those without one."""
    width = (len(_CLASS_NAMES), len(_VOCABULARY) + 1)
    sums = [F.array(*[F.sum(F.col(c)[k]) for k in range(n)]).alias(f"usual_{c}") for c, n in zip(("classes", "common"), width, strict=True)]
    return counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums)


def whole(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(class counts, common-word counts) of all documents."""
    width = (len(_CLASS_NAMES), len(_VOCABULARY) + 1)
    found = known.agg(*[F.array(*[F.coalesce(F.sum(F.col(f"usual_{c}")[k]), F.lit(0)) for k in range(n)]).alias(c) for c, n in zip(("classes", "common"), width, strict=True)]).first()
    return np.array(found.classes), np.array(found.common)


def judge_quality(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base counts, base_failed, char_distance, word_distance, kept for every document (doc_id, text, lang), and the columns to carry."""
    counts = staged(quality_counts(docs, carry), "counts")
    table = staged(references(counts), "references")
    named = table.where("lang IS NOT NULL")
    frequent = named.orderBy(F.desc("n"), "lang").limit(LANGS + 1).collect()
    known = {r.lang: (np.array(r.usual_classes), np.array(r.usual_common)) for r in frequent[:LANGS]} | {None: whole(table)}
    if len(frequent) > LANGS:
        here = F.coalesce(F.col("lang").isin([x for x in known if x is not None]), F.lit(True))
        joined = counts.where(~here).join(named.where(~here).drop("n"), "lang")
        counts = joined.select(*counts.columns, "usual_classes", "usual_common").unionByName(counts.where(here), allowMissingColumns=True)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.names.index
        own = [[None] * batch.num_rows] * 2 if "usual_common" not in batch.schema.names else [batch.column(at(c)).to_pylist() for c in ("usual_classes", "usual_common")]
        usual_classes, usual = map(np.array, zip(*((a, b) if a else known[x] for a, b, x in zip(*own, batch.column(1).to_pylist(), strict=True)), strict=True))
        n_words, repeat = (batch.column(at(c)).to_numpy(zero_copy_only=False) for c in ("n_words", "n_repeat_words"))
        classes, common = (np.array(batch.column(at(c)).to_pylist()) for c in ("classes", "common"))
        chars, words = js_distance(classes, usual_classes), js_distance(common, usual)
        failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
        odd = (classes.sum(1) >= MIN_CHARS) & (chars > MAX_CHAR_DISTANCE) | (n_words >= MIN_COMMON_WORDS) & (words > MAX_WORD_DISTANCE) | (n_words >= MIN_WORDS) & lacks_common(common, usual)
        judged = [pa.array(failed), pa.array(np.round(chars, 6)), pa.array(np.round(words, 6)), pa.array(~(failed | odd))]
        return pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(at(c)) for c in (*_COUNTED, *carry)), *judged], names=out.fieldNames())

    fields = {f.name: f for f in counts.schema.fields}
    verdicts = [StructField("base_failed", BooleanType()), StructField("char_distance", DoubleType()), StructField("word_distance", DoubleType()), StructField("kept", BooleanType())]
    out = StructType([*(fields[c] for c in ("doc_id", *_COUNTED, *carry)), *verdicts])
    return arrow_map(counts, run, out)
