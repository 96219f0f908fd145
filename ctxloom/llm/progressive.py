"""Progressive JPEG columns: payloads in coefficients, decoded to RGB tensors (operator 9).

The format's unit is the quantised DCT coefficient: a payload byte b becomes
coefficient b-129 (below 128) or b-126, so none is zero and every magnitude has
two bits to spare.  64 bytes fill one 8x8 block in zigzag order; the blocks fill
a 4:2:0 image (all Y blocks in raster order, then Cb, then Cr).  The writer
sends eleven scans: DC with one bit held back, AC 1-5 and 6-63 of each component
likewise, then the refinement of AC and DC.  Its Huffman lengths are chosen so
that length plus magnitude bits is constant, which lets whole scans be packed
and unpacked by numpy; the file is still plain progressive JPEG.

The reader takes any 8-bit Huffman progressive JPEG: scans are accumulated into
coefficient arrays (spectral selection, successive approximation, end-of-band
runs, restarts), in bulk where a scan has constant width and else symbol by
symbol; then inverse-transformed, chroma upsampled, and turned into RGB.

Files are stored as a Parquet column, compressed as a whole, and read back from
there; decode_media gives the RGB tensors to be stored the same way.

Defined cases: null text is empty, whose payload is 64 zero bytes; a null doc_id
stays null; repeated rows give repeated results; an unreadable file raises
BadImage; an empty table gives an empty table.  A text is one image, held whole:
some 60 bytes of arrays for each of its bytes while it is coded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, staged, texts, tune

BLOCK = 64
WIDEST = 4095  # MCUs in a row; 16 times that stays under the format's 65,535 pixels
NOTE = b"payload "


class BadImage(ValueError):
    """Not a progressive JPEG, or a damaged one."""


def _zigzag() -> np.ndarray:
    """Natural position of each zigzag index."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
VALUE = np.concatenate([np.arange(-129, -1), np.arange(2, 130)]).astype(np.int16)  # of each payload byte

# ---------------------------------------------------------------- Huffman tables


def canonical(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of the (length, symbol) list, by the format's rule."""
    codes, code, last = {}, 0, 0
    for length, symbol in sorted(lengths, key=lambda x: x[0]):
        code <<= length - last if last else 0
        codes[symbol] = (code, length)
        code, last = code + 1, length
    return codes


_AC_WIDTH, _DC_WIDTH = 9, 10
_AC = [(_AC_WIDTH - size, size) for size in range(1, 8)]
_DC = [(_DC_WIDTH - size, size) for size in range(9)]
_EOB = [(4, run << 4) for run in range(15)]


def _bits(value: int, width: int) -> list[int]:
    return [value >> k & 1 for k in range(width - 1, -1, -1)]


def _coded(v: int, codes: dict[int, tuple[int, int]]) -> list[int]:
    size = abs(v).bit_length()
    code, length = codes[size]
    return _bits(code, length) + _bits(v if v > 0 else v + (1 << size) - 1, size)


_AC_BITS = np.array([_coded(int(abs(v)) // 2 * (1 if v > 0 else -1), canonical(_AC)) for v in VALUE], np.uint8)
_AC_LOW = (np.abs(VALUE) & 1).astype(np.uint8)
_DC_BITS = np.array([_coded(d, canonical(_DC)) for d in range(-160, 161)], np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman_body(kind: int, lengths: list[tuple[int, int]]) -> bytes:
    rows = sorted(lengths, key=lambda x: x[0])
    return bytes([kind, *(sum(r[0] == n for r in rows) for n in range(1, 17)), *(r[1] for r in rows)])


_TABLES = _segment(0xDB, b"\x00" + b"\x01" * 64)
_HUFFMAN = _segment(0xC4, _huffman_body(0x00, _DC) + _huffman_body(0x10, _AC) + _huffman_body(0x11, _EOB))


def _scan(components: list[tuple[int, int, int]], first: int, last: int, high: int, low: int, bits: np.ndarray) -> bytes:
    """A scan header and its entropy-coded bits, padded by ones and byte-stuffed."""
    head = bytes([len(components), *(x for c, dc, ac in components for x in (c, dc << 4 | ac)), first, last, high << 4 | low])
    data = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _mcu_order(wide: int, high: int) -> np.ndarray:
    """(MCUs, 6): the rows of Y raster, Cb, Cr blocks in each MCU."""
    n = wide * high
    y = np.arange(4 * n).reshape(high, 2, wide, 2).transpose(0, 2, 1, 3).reshape(n, 4)
    chroma = np.arange(n)[:, None]
    return np.concatenate([y, 4 * n + chroma, 5 * n + chroma], 1)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK) if data else bytes(BLOCK)


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG that holds a payload of a positive multiple of 64 bytes."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("payload must be a positive multiple of 64 bytes")
    n = len(payload) // BLOCK
    mcus = -(-n // 6)
    wide = min(mcus, WIDEST)
    high = -(-mcus // wide)
    total = 6 * wide * high
    data = np.frombuffer(payload + bytes((total - n) * BLOCK), np.uint8).reshape(total, BLOCK)
    luma = 4 * wide * high
    parts = [(1, slice(0, luma)), (2, slice(luma, luma + luma // 4)), (3, slice(luma + luma // 4, total))]
    order = _mcu_order(wide, high)
    dc = VALUE[data[:, 0]]
    coarse = (dc >> 1)[order].astype(np.int32)
    diff = np.empty_like(coarse)
    y = coarse[:, :4].reshape(-1)
    diff[:, :4] = np.diff(y, prepend=0).reshape(-1, 4)
    diff[:, 4], diff[:, 5] = np.diff(coarse[:, 4], prepend=0), np.diff(coarse[:, 5], prepend=0)
    every = [(c, 0, 0) for c, _ in parts]
    out = [b"\xff\xd8", _segment(0xFE, NOTE + struct.pack(">Q", len(payload))), _TABLES]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_HUFFMAN, _scan(every, 0, 0, 0, 1, _DC_BITS[diff.reshape(-1) + 160].reshape(-1))]
    for first, last in ((1, 5), (6, 63)):
        out += [_scan([(c, 0, 0)], first, last, 0, 1, _AC_BITS[data[rows, first : last + 1]].reshape(-1)) for c, rows in parts]
    eob = canonical(_EOB)
    for c, rows in parts:
        block_bits = _AC_LOW[data[rows, 1:]]
        pieces = []
        for at in range(0, len(block_bits), 32767):
            run = block_bits[at : at + 32767]
            k = len(run).bit_length() - 1
            code, length = eob[k << 4]
            pieces += [np.array(_bits(code, length) + _bits(len(run) - (1 << k), k), np.uint8), run.reshape(-1)]
        out.append(_scan([(c, 0, 1)], 1, 63, 1, 0, np.concatenate(pieces)))
    out += [_scan(every, 0, 0, 1, 0, (dc & 1)[order].reshape(-1).astype(np.uint8)), b"\xff\xd9"]
    return b"".join(out)


# ---------------------------------------------------------------- reader


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks that hold samples
    high: int = 0
    across: int = 0  # blocks stored, full MCUs
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quantisers: dict[int, np.ndarray]
    notes: list[bytes]


class _Decoder:
    """Huffman table: symbol and length by the next 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        rows = [(n + 1, s) for n, s in zip((n for n in range(16) for _ in range(counts[n])), symbols, strict=True)]
        self.symbol, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        for s, (code, length) in canonical(rows).items():
            self.symbol[code << 16 - length : code + 1 << 16 - length] = s
            self.length[code << 16 - length : code + 1 << 16 - length] = length
        sizes = {length + (s & 15) for length, s in rows if s >> 4 == 0}
        #: bits of any code and its magnitude, if that is constant
        self.width = sizes.pop() if len(sizes) == 1 and all(s >> 4 == 0 for _, s in rows) else 0
        if 0 < self.width <= 16:
            head = np.arange(1 << self.width, dtype=np.int64) << 16 - self.width
            size = self.symbol[head].astype(np.int64)
            self.known = self.length[head] > 0
            raw = np.arange(1 << self.width) & (1 << size) - 1
            self.amount = np.where(size == 0, 0, np.where(raw >> np.maximum(size - 1, 0) & 1, raw, raw - (1 << size) + 1)).astype(np.int32)
            self.size = size


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > len(self.bits):
            raise BadImage("scan ends early")
        value = int("".join(map(str, self.bits[self.at : self.at + n].tolist())), 2)
        self.at += n
        return value

    def symbol(self, table: _Decoder) -> int:
        ahead = self.bits[self.at : self.at + 16].tolist()
        index = int("".join(map(str, ahead + [1] * (16 - len(ahead)))), 2)
        length = int(table.length[index])
        if not length or self.at + length > len(self.bits):
            raise BadImage("bad code")
        self.at += length
        return int(table.symbol[index])

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> size - 1 else value - (1 << size) + 1

    def fixed(self, count: int, width: int) -> np.ndarray:
        """count integers of equal width, without moving on."""
        part = self.bits[self.at : self.at + count * width]
        if len(part) < count * width:
            raise BadImage("scan ends early")
        part = part.reshape(count, width)
        value = np.zeros(count, np.int32)
        for k in range(width):
            value = (value << 1) | part[:, k]
        return value


def _split_restarts(data: bytes) -> list[bytes]:
    out, last = [], 0
    for k in range(len(data) - 1):
        if data[k] == 0xFF and 0xD0 <= data[k + 1] <= 0xD7:
            out.append(data[last:k])
            last = k + 2
    return [*out, data[last:]]


def _scan_end(data: bytes, at: int) -> int:
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
            at += 2
        else:
            return at


def read_coefficients(data: bytes, bulk: bool = True) -> Image:
    """Accumulate all scans; bulk=False reads symbol by symbol throughout."""
    if data[:2] != b"\xff\xd8":
        raise BadImage("no JPEG")
    at, tables, image, restart = 2, {}, None, 0
    quantisers: dict[int, np.ndarray] = {}
    notes: list[bytes] = []
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise BadImage("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            notes.append(body)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quantisers[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int32)
                k += 65 + 64 * wide
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = _Decoder(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not height or not width:
                raise BadImage("frame header")
            parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            hm, vm = max(c.h for c in parts), max(c.v for c in parts)
            for c in parts:
                c.wide, c.high = -(-(-(-width * c.h // hm)) // 8), -(-(-(-height * c.v // vm)) // 8)
                c.across = -(-width // (8 * hm)) * c.h
                c.coefficients = np.zeros((c.across * -(-height // (8 * vm)) * c.v, 64), np.int32)
            image = Image(width, height, parts, quantisers, notes)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise BadImage("not a progressive Huffman file")
        elif marker == 0xDA:
            if image is None:
                raise BadImage("scan before frame")
            end = _scan_end(data, at)
            _read_scan(image, body, data[at:end], tables, restart, bulk)
            at = end
    if image is None:
        raise BadImage("no frame")
    return image


def _read_scan(image: Image, head: bytes, data: bytes, tables: dict[int, _Decoder], restart: int, bulk: bool) -> None:
    n = head[0]
    chosen = [next(c for c in image.components if c.name == head[1 + 2 * k]) for k in range(n)]
    selectors = [head[2 + 2 * k] for k in range(n)]
    first, last, approx = head[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    if n > 1:
        hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
        wide, tall = -(-image.width // (8 * hm)), -(-image.height // (8 * vm))
        columns = []
        for k, c in enumerate(chosen):
            grid = np.arange(len(c.coefficients)).reshape(tall, c.v, wide, c.h).transpose(0, 2, 1, 3).reshape(wide * tall, c.v * c.h)
            columns.append((k, grid))
    else:
        c = chosen[0]
        columns = [(0, (np.arange(c.high)[:, None] * c.across + np.arange(c.wide)).reshape(-1, 1))]
    units = len(columns[0][1])
    pieces = _split_restarts(data) if restart else [data]
    for number, piece in enumerate(pieces):
        lo, hi = (number * restart, min((number + 1) * restart, units)) if restart else (0, units)
        bits = _Bits(piece)
        own = [(k, grid[lo:hi]) for k, grid in columns]
        if first == 0:
            _read_dc(chosen, own, [tables.get(s >> 4) for s in selectors], bits, high, low, bulk)
        else:
            table = tables.get(0x10 | selectors[0] & 15)
            if table is None:
                raise BadImage("missing table")
            rows = own[0][1].reshape(-1)
            if high == 0:
                _read_ac_first(chosen[0].coefficients, rows, first, last, low, table, bits, bulk)
            else:
                _read_ac_refine(chosen[0].coefficients, rows, first, last, low, table, bits, bulk)


def _read_dc(chosen, own, tables, bits: _Bits, high: int, low: int, bulk: bool) -> None:
    widths = [grid.shape[1] for _, grid in own]
    units = len(own[0][1])
    if high:
        flags = bits.fixed(units * sum(widths), 1).reshape(units, -1)
        at = 0
        for (k, grid), w in zip(own, widths, strict=True):
            chosen[k].coefficients[grid.reshape(-1), 0] |= flags[:, at : at + w].reshape(-1) << low
            at += w
        return
    if any(t is None for t in tables):
        raise BadImage("missing table")
    width = tables[0].width
    if bulk and 0 < width <= 16 and all(t is tables[0] for t in tables) and len(bits.bits) >= units * sum(widths) * width:
        chunk = bits.fixed(units * sum(widths), width)
        if tables[0].known[chunk].all():
            diff = tables[0].amount[chunk].reshape(units, -1)
            at = 0
            for (k, grid), w in zip(own, widths, strict=True):
                chosen[k].coefficients[grid.reshape(-1), 0] = np.cumsum(diff[:, at : at + w].reshape(-1)) << low
                at += w
            return
    before = [0] * len(own)
    for u in range(units):
        for k, grid in own:
            for row in grid[u]:
                before[k] += bits.signed(bits.symbol(tables[k]))
                chosen[k].coefficients[row, 0] = before[k] << low


def _read_ac_first(coefficients, rows, first, last, low, table: _Decoder, bits: _Bits, bulk: bool) -> None:
    band = last - first + 1
    if bulk and 0 < table.width <= 16 and len(bits.bits) >= len(rows) * band * table.width:
        chunk = bits.fixed(len(rows) * band, table.width)
        if (table.known[chunk] & (table.size[chunk] > 0)).all():
            coefficients[rows, first : last + 1] = (table.amount[chunk] << low).reshape(len(rows), band)
            return
    run = 0
    for row in rows:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = bits.symbol(table)
            skip, size = symbol >> 4, symbol & 15
            if size:
                k += skip
                if k > last:
                    raise BadImage("band overrun")
                coefficients[row, k] = bits.signed(size) * (1 << low)
                k += 1
            elif skip == 15:
                k += 16
            else:
                run = (1 << skip) + bits.take(skip) - 1
                break


def _read_ac_refine(coefficients, rows, first, last, low, table: _Decoder, bits: _Bits, bulk: bool) -> None:
    one, run, at = 1 << low, 0, 0

    def correct(row: int, k: int) -> None:
        if bits.take(1) and not abs(int(coefficients[row, k])) & one:
            coefficients[row, k] += one if coefficients[row, k] > 0 else -one

    while at < len(rows):
        row, k = rows[at], first
        if not run:
            while k <= last:
                symbol = bits.symbol(table)
                skip, size = symbol >> 4, symbol & 15
                fresh = 0
                if size:
                    fresh = one if bits.take(1) else -one
                elif skip < 15:
                    run = (1 << skip) + bits.take(skip)
                    break
                while k <= last:
                    if coefficients[row, k]:
                        correct(row, k)
                    elif not skip:
                        break
                    else:
                        skip -= 1
                    k += 1
                if fresh and k <= last:
                    coefficients[row, k] = fresh
                k += 1
        if run:
            whole = rows[at : at + run]
            if bulk and k == first and (old := coefficients[whole, first : last + 1]).all():
                flags = bits.fixed(old.size, 1).reshape(old.shape)
                bits.at += old.size
                coefficients[whole, first : last + 1] = old + np.sign(old) * (flags & ~(np.abs(old) >> low)) * one
                at, run = at + len(whole), 0
                continue
            for k in range(k, last + 1):
                if coefficients[row, k]:
                    correct(row, k)
            run -= 1
        at += 1


def _cosines() -> np.ndarray:
    """(64, 64): zigzag coefficients to samples of an 8x8 block."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    return np.einsum("xu,yv->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


_COSINES = _cosines()


def rgb_tensor(image: Image) -> np.ndarray:
    """(height, width, 3) unsigned bytes at full resolution."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        scaled = (c.coefficients * image.quantisers[c.table]).astype(np.float32)
        samples = (scaled @ _COSINES).reshape(-1, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * c.across)
        samples = np.clip(samples + np.float32(128), 0, 255)
        if c.v < vm or c.h < hm:
            samples = np.repeat(np.repeat(samples, vm // c.v, 0), hm // c.h, 1)
        planes.append(samples[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(np.rint(planes[0]).astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
    out = np.empty((*y.shape, 3), np.uint8)
    for k, plane in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[:, :, k] = np.clip(np.rint(plane), 0, 255)
    return out


def payload_of(image: Image) -> bytes:
    """The payload that encode_payload stored."""
    note = next((n for n in image.notes if n.startswith(NOTE)), None)
    if note is None:
        raise BadImage("no payload note")
    (size,) = struct.unpack(">Q", note[len(NOTE) :])
    values = np.concatenate([c.coefficients for c in image.components])[: size // BLOCK]
    back = np.where(values < 0, values + 129, values + 126)
    if (back < 0).any() or (back > 255).any() or (np.abs(values) < 2).any():
        raise BadImage("coefficients hold no payload")
    return back.astype(np.uint8).tobytes()


def features(tensor: np.ndarray) -> str:
    """Size, mean colour, and contrast of the tensor, from whole-number sums."""
    height, width = tensor.shape[:2]
    n = height * width
    sums = tensor.reshape(-1, 3).sum(0, dtype=np.int64)
    squares = np.bincount(tensor.reshape(-1), minlength=256) @ (np.arange(256, dtype=np.int64) ** 2)
    mean = [f"{int(s) / n:.4f}" for s in sums]
    spread = (int(squares) / (3 * n) - (int(sums.sum()) / (3 * n)) ** 2) ** 0.5
    return f"{width}x{height};rgb={','.join(mean)};sd={spread:.4f}"


# ---------------------------------------------------------------- operator


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes stored as a progressive JPEG."""
    tune(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array([encode_payload(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, media binary")


def stored_media(docs: DataFrame) -> DataFrame:
    """encode_media as a stored table."""
    return staged(encode_media(docs), "media", compression="zstd", **{"parquet.compression.codec.zstd.level": "5"})


def decode_media(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, tensor): RGB tensors, rows of pixels, three bytes each; null media gives nulls."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shown = [None if m is None else rgb_tensor(read_coefficients(m)) for m in batch.column(1).to_pylist()]
        size = [[None if t is None else t.shape[k] for t in shown] for k in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size[0], pa.int32()), pa.array(size[1], pa.int32()), pa.array([None if t is None else t.tobytes() for t in shown], pa.binary())], names=["doc_id", "height", "width", "tensor"])

    return arrow_map(media.select("doc_id", "media"), run, "doc_id long, height int, width int, tensor binary")


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored bytes give when read back: payload and tail digests, the file's own, tensor features."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for name, n, m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            image = read_coefficients(m)
            payload = payload_of(image)
            rows.append((name, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), features(rgb_tensor(image))))
        kinds = dict(doc_id=pa.int64(), n_bytes=pa.int64(), payload_bytes=pa.int64(), payload_sha256=pa.string(), tail_crc32=pa.int64(), media_bytes=pa.int64(), media_sha256=pa.string(), feature=pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return arrow_map(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
