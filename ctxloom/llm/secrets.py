"""Secret scans with a token-efficiency test (operator 8).

Base kinds are patterns.  The method adds kind `random`: a run of key-like
characters that costs many tokens for its length under a byte-pair vocabulary
is no language, so it is taken for a secret.  Only then a digest of known
length, a UUID, a number, and an identifier are left out; an identifier is one
whose own parts are cheap: at least half of its letters stand in words that take
a token for three letters or more, or between separators that are SHORT apart.
Alphabets and gene sequences cost as much as keys and count as random.

Spans count code points, ends are exclusive; a span is the whole match.
Added spans never overlap base spans.

Defined cases: null text is empty and has no spans; repeated rows give repeated
results; a null doc_id stays null; an empty table gives an empty table.  A text of
any length is read whole by patterns that hold nothing but their matches.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts, tune

KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24  # characters
MIN_RANDOM, MAX_CHARS_PER_TOKEN = 20, 2.0
MIN_WORD, MIN_WORD_CHARS_PER_TOKEN, SHORT = 4, 3, 3  # of the parts of an identifier

# The base patterns; keywords in either case, ASCII letters only.
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_KEYWORDS = ("passw", "secret", "token", "api")

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)
# Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
_DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
_ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Vocabulary:
    """A tiktoken ranks file; loads in the worker on first use."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks_path, self.pattern, self._encoding = ranks_path, pattern, None

    def __getstate__(self):
        return self.ranks_path, self.pattern

    def __setstate__(self, state):
        self.__init__(*state)

    def tokens(self, text: str) -> int:
        key = (self.ranks_path, self.pattern)
        if key not in _loaded:
            import tiktoken

            with open(self.ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _loaded[key] = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return len(_loaded[key].encode_ordinary(text))


_loaded: dict = {}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def known_shape(run: str, vocabulary: Vocabulary) -> bool:
    """A digest, UUID, number, or identifier rather than a random string."""
    if _UUID.fullmatch(run) or len(run) in _DIGESTS and _ALL_HEX.fullmatch(run):
        return True
    letters = plain = 0
    for piece in re.split(r"[+/_=-]+", run):
        for part in filter(str.isalpha, _PART.findall(piece)):
            letters += len(part)
            if len(piece) <= SHORT or len(part) >= MIN_WORD and is_word(part, vocabulary):
                plain += len(part)
    return 2 * plain >= letters


def is_word(part: str, vocabulary: Vocabulary) -> bool:
    """Whether letters are cheap in tokens as they are, in lower case, or after a space."""
    low = part.lower()
    return any(MIN_WORD_CHARS_PER_TOKEN * vocabulary.tokens(x) <= len(part) for x in (part, low, f" {low}"))


def random_spans(text: str, taken: list[tuple[str, int, int]], vocabulary: Vocabulary) -> list[tuple[str, int, int]]:
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        if any(a < m.end() and m.start() < b for _, a, b in taken):
            continue
        if len(run) < MAX_CHARS_PER_TOKEN * vocabulary.tokens(run) and not known_shape(run, vocabulary):
            out.append(("random", m.start(), m.end()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def all_spans(text: str, vocabulary: Vocabulary) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each in order."""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, vocabulary), key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, spans array of structs kind, start, end, base) of every document."""
    tune(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[{"kind": k, "start": a, "end": b, "base": k != "random"} for k, a, b in all_spans(t, vocabulary)[1]] for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")


def secret_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of the spans found."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact_secrets(docs: DataFrame, vocabulary: Vocabulary, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by a mark; n_chars, where there is one, follows the text."""
    tune(docs.sparkSession)
    schema = docs.schema
    at = schema.fieldNames().index("text")
    counted = schema.fieldNames().index("n_chars") if "n_chars" in schema.fieldNames() else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, last = [], 0
        for _, a, b in all_spans(text, vocabulary)[1]:
            if a >= last:
                out += [text[last:a], mark]
            last = max(last, b)
        return "".join([*out, text[last:]]) if last else text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        before = columns[at].to_pylist()
        after = [clean(t) for t in before]
        columns[at] = pa.array(after, batch.schema.field(at).type)
        if counted is not None:
            old = columns[counted].to_pylist()
            columns[counted] = pa.array([n if a == b else len(b) for n, a, b in zip(old, before, after, strict=True)], batch.schema.field(counted).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return arrow_map(docs, run, schema)


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
