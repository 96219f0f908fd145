"""SentencePiece encoding and decoding by streaming Viterbi (operator 1).

Segmentations are paths over character boundaries.  For every boundary the
reader keeps one backpointer - the last piece of the best path to it - in a
window.  A path survives while the text behind its boundary may begin a piece.
Once all surviving paths run through one boundary, the ids up to it are
committed and the window moves there, so the window is bounded by the longest
piece.  Committed ids leave before the rest of the text is seen; the query
counts them (early_ids).

Which path is best depends on the model.  Unigram models add up piece scores;
among equal sums the path with the longest last piece is taken.  Byte-pair
models merge by score; their result for a prefix ends in the one piece t for
which merging (last piece before it, t) on their own gives those two back, so
"compatible with the piece before" replaces the score, and the result is that of
the merges.  Pairs are merged once and remembered.

No piece holds a space mark after other characters (checked when the model
loads), nor characters outside of the vocabulary, so all paths meet there whatever
the text before; the stretch between two such commits gives the same ids
wherever it stands, and workers remember them.  Anything else goes through the
window character by character.

Defined cases: null text is empty and has no ids; characters outside of the
vocabulary become byte pieces, or one unknown id per run where the model has no
byte pieces; a null doc_id stays null; repeated rows give repeated results; an
empty table gives an empty table.  Texts of any length are fed in STRETCH
characters; beside the ids only the window is held.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts, tune

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
CACHE_ENTRIES = 500_000
COMMIT_EVERY = 16  # characters between looks for a common boundary
STRETCH = 1 << 16  # characters of a text that are fed at once


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class PieceModel:
    """Pieces, scores and flags of a SentencePiece model file with identity normalisation."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        self.pieces, self.kind, self.dummy_prefix = pieces, kind, dummy_prefix
        self.ids = {p: k for k, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.score = [s for _, s, _ in pieces]
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        #: beginnings of pieces, without the pieces themselves: a path is alive while the text behind it is one of them
        self.begun = frozenset(p[:n] for p in self.ids for n in range(1, len(p)))
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: ends of pieces -> id, or -1 where the end itself is no piece
        self.ends: dict[str, int] = {}
        for p, k in self.ids.items():
            for n in range(1, len(p)):
                self.ends.setdefault(p[n:], -1)
            self.ends[p] = k
        #: marks that no piece holds right after a letter: a border is certain before them
        self.marks = frozenset(".,;:!?") - {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        self.characters = frozenset("".join(self.ids))
        self.fallback = [b"" if t in (UNKNOWN, 3) else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        self.fallback[self.unknown] = " ⁇ ".encode()
        self._compatible: dict[tuple[int, int], bool] = {}
        self.low = min(self.score, default=0.0) - 10

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            data = f.read()
        pieces, kind, prefix = [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                prefix = bool(own.get(3, 1))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only models with identity normalisation that keep white space are read")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are read")
        return cls(pieces, kind, prefix)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short string: highest score first, leftmost among equals."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(parts):
                both = parts[left] + parts[right]
                if (k := self.ids.get(both)) is not None:
                    heapq.heappush(heap, (-self.score[k], left, right, both))

        for k in range(len(parts) - 1):
            offer(k)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            if parts[left] is None or parts[right] is None or after[left] != right or parts[left] + parts[right] != both:
                continue
            parts[left], parts[right] = both, None
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [p for p in parts if p is not None]

    def compatible(self, last: int, piece: int) -> bool:
        key = (last, piece)
        known = self._compatible.get(key)
        if known is None:
            a, b = self.pieces[last][0], self.pieces[piece][0]
            known = self.merged(a + b) == [a, b]
            if len(self._compatible) < 2_000_000:
                self._compatible[key] = known
        return known

    def _whole(self, piece: int) -> bool:
        key = (-1, piece)
        known = self._compatible.get(key)
        if known is None:
            text = self.pieces[piece][0]
            known = self._compatible[key] = self.merged(text) == [text]
        return known


class Window:
    """The open part of a text: backpointers from the committed boundary on."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.widest = 0  # longest window so far
        self.reset()

    def reset(self) -> None:
        self.text = ""  # from the committed boundary on
        self.back = [0]  # start of the last piece of the best path to each boundary
        self.last = [-1]  # that piece; -1 before any, -2 for a character outside of the vocabulary
        self.total = [0.0]

    def extend(self, text: str) -> list[int]:
        """Read text; the ids that became final."""
        out: list[int] = []
        for start in range(0, len(text), COMMIT_EVERY):
            self.text += text[start : start + COMMIT_EVERY]
            self._paths()
            self.widest = max(self.widest, len(self.text))
            out += self.commit()
        return out

    def close(self) -> list[int]:
        """The ids of the rest, as no text follows."""
        out = self._ids(0, len(self.text))
        self.reset()
        return out

    def _paths(self) -> None:
        model, text, back, last, total = self.model, self.text, self.back, self.last, self.total
        ends, known, merges, longest, ids = model.ends, model._compatible, model.kind == BPE, model.longest, model.ids
        for i in range(len(back), len(text) + 1):
            best, best_id, best_score = i - 1, -2, total[i - 1] + model.low if text[i - 1] not in ids else float("-inf")
            for j in range(i - 1, max(-1, i - longest - 1), -1):
                k = ends.get(text[j:i])
                if k is None:
                    break
                if k < 0:
                    continue
                if merges:
                    before = last[j]
                    fits = known.get((before, k)) if before >= 0 else None
                    if fits is None:
                        fits = model.compatible(before, k) if before >= 0 else model._whole(k)
                    if fits:
                        best, best_id = j, k
                        break
                elif total[j] + model.score[k] >= best_score:
                    best, best_id, best_score = j, k, total[j] + model.score[k]
            back.append(best)
            last.append(best_id)
            total.append(best_score)

    def _ids(self, low: int, high: int) -> list[int]:
        """Ids of the best path between two boundaries on it."""
        pieces = []
        while high > low:
            start = self.back[high]
            pieces.append((self.last[high], start, high))
            high = start
        out: list[int] = []
        for k, a, b in reversed(pieces):
            if k >= 0:
                out.append(k)
            elif self.model.bytes:
                out += [self.model.bytes[x] for x in self.text[a:b].encode("utf-8", "surrogatepass")]
            else:
                out.append(self.model.unknown)
        return out

    def commit(self) -> list[int]:
        """Ids up to the last boundary that all surviving paths share; the window moves there."""
        n = len(self.text)
        live = {n} | {j for j in range(max(0, n - self.model.longest + 1), n) if self.text[j:] in self.model.begun}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(self.back[top])
        (at,) = live
        if not at:
            return []
        out = self._ids(0, at)
        self.text = self.text[at:]
        self.back = [max(0, b - at) for b in self.back[at:]]
        self.last, self.total = self.last[at:], self.total[at:]
        return out


class Stretches(dict):
    """stretch between two certain commits -> its packed ids."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model, self.window = model, Window(model)
        self.code = "H" if len(model.pieces) <= 1 << 16 else "I"

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def __missing__(self, stretch: str) -> bytes:
        if stretch[-1:] in self.model.marks and stretch[-2:-1].isalpha():
            packed = self[stretch[:-1]] + self[stretch[-1]]
        else:
            packed = self.pack(self.window.extend(stretch) + self.window.close())
        if len(self) < CACHE_ENTRIES and len(stretch) < 64:
            self[stretch] = packed
        return packed


class StreamingViterbi:
    """Feed text (with space marks) in parts of any size; packed ids come out as soon as they are final."""

    def __init__(self, model: PieceModel, known: Stretches | None = None):
        self.model, self.known = model, known if known is not None else Stretches(model)
        self.window = Window(model)  # the stretch that is still open, once it has grown long
        self.open = ""  # that stretch while it is short
        self.unknown = False  # whether the last id out was the unknown one
        self.widest = 0  # longest stretch that was held back

    def feed(self, text: str) -> bytes:
        cuts = self._stretches(text)
        out = []
        if len(cuts) > 1:
            out.append(self._end(cuts[0]))
            out += map(self.known.__getitem__, cuts[1:-1])
            self.open = cuts[-1]
        else:
            self.open += cuts[0]
        if len(self.open) >= COMMIT_EVERY:
            out.append(self.known.pack(self.window.extend(self.open)))
            self.open = ""
        self.widest = max(self.widest, len(self.open) + self.window.widest)
        return self._joined(out)

    def finish(self) -> bytes:
        out = self._joined([self._end("")])
        self.unknown = False
        return out

    def _stretches(self, text: str) -> list[str]:
        """text cut where all paths meet whatever comes before; the first part continues the open stretch, the last one stays open."""
        if self.model.crossing:
            return [text]
        cut = text.replace(SPACE, "\0" + SPACE) if "\0" not in text else None
        if cut is None or SPACE + SPACE in text or text.startswith(SPACE) and (self.open + self.window.text).endswith(SPACE):
            first = "" if text.startswith(SPACE) and not (self.open + self.window.text).endswith(SPACE) else _FIRST.match(text)[0]
            return [first, *_CHUNKS.findall(text, len(first))]
        if "\n" not in self.model.characters:
            cut = cut.replace("\n", "\0\n\0")
        return cut.split("\0")

    def _end(self, text: str) -> bytes:
        """The ids of the open stretch, which text ends."""
        if self.window.text or len(self.window.last) == 1 and self.window.last[0] >= 0:
            ids = self.window.extend(self.open + text) + self.window.close()
            packed = self.known.pack(ids)
        else:
            whole = self.open + text
            packed = self.known[whole] if whole else b""
        self.open = ""
        return packed

    def _joined(self, parts: list[bytes]) -> bytes:
        out = b"".join(parts)
        if self.model.bytes or not out:
            return out
        ids = np.frombuffer(out, "<u2" if self.known.code == "H" else "<u4")
        is_unknown = ids == self.model.unknown
        keep = ~(is_unknown & np.concatenate([[self.unknown], is_unknown[:-1]]))  # one id per run
        self.unknown = bool(is_unknown[-1])
        return ids[keep].tobytes()


class Encoder:
    """Texts to packed ids; pickles as the model's path."""

    def __init__(self, path: str):
        self.path, self.model = path, None

    def __reduce__(self):
        return Encoder, (self.path,)

    def ready(self) -> Encoder:
        if self.path not in _loaded:
            self.model = PieceModel.load(self.path)
            self.known = Stretches(self.model)
            self.code = self.known.code
            self.viterbi = StreamingViterbi(self.model, self.known)
            _loaded[self.path] = self
        return _loaded[self.path]

    def packed(self, text: str) -> tuple[bytes, int]:
        """Ids of a whole text, little-endian, and the length in bytes of those committed before its end was seen."""
        if not text:
            return b"", 0
        marked = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        viterbi = self.viterbi
        early = viterbi.feed(marked) if len(marked) <= STRETCH else b"".join(viterbi.feed(marked[at : at + STRETCH]) for at in range(0, len(marked), STRETCH))
        return early + viterbi.finish(), len(early)


_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
_FIRST = re.compile(f"{SPACE}*[^{SPACE}]*", re.S)
_loaded: dict[str, Encoder] = {}


def decoded(model: PieceModel, ids: Iterable[int]) -> str:
    text = b"".join(map(model.fallback.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, early_ids, ids) of every text; ids are packed little-endian unsigned 16-bit integers (32-bit for larger models)."""
    tune(docs.sparkSession)
    encoder = Encoder(model_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder.ready()
        packed = list(map(own.packed, texts(batch.column(1))))
        width = array(own.code).itemsize
        sizes = [pa.array([x // width for x in column], pa.int64()) for column in ([len(p) for p, _ in packed], [n for _, n in packed])]
        return pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array([p for p, _ in packed], pa.binary())], names=["doc_id", "n_ids", "early_ids", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_ids long, early_ids long, ids binary")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of packed ids; null ids give null."""
    encoder = Encoder(model_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder.ready()
        out = [None if p is None else decoded(own.model, array(own.code, p)) for p in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def piece_digests(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, early_ids (committed before the end of the text was seen), ids_crc32 (of little-endian unsigned 32-bit ids), decoded_chars and decoded_sha256 of the ids decoded again."""
    encoder = Encoder(model_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder.ready()
        crc, chars, digest = [], [], []
        for p in batch.column(3).to_pylist():
            ids = array(own.code, p)
            text = decoded(own.model, ids)
            crc.append(zlib.crc32(np.array(ids, "<u4").tobytes()))
            chars.append(len(text))
            digest.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64()), pa.array(chars, pa.int64()), pa.array(digest)], names=["doc_id", "n_ids", "early_ids", "ids_crc32", "decoded_chars", "decoded_sha256"])

    return arrow_map(encoded.select("doc_id", "n_ids", "early_ids", "ids"), run, "doc_id long, n_ids long, early_ids long, ids_crc32 long, decoded_chars long, decoded_sha256 string")
