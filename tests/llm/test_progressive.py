import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxloom.llm import progressive as p
from ctxloom.llm.queries import op9_progressive_jpeg


@given(st.binary(max_size=3000))
@settings(max_examples=40, deadline=None)
def test_round_trip(data):
    payload = p.padded(data)
    assert p.payload_of(p.read_coefficients(p.encode_payload(payload))) == payload


def test_bulk_and_symbol_readers_agree():
    media = p.encode_payload(p.padded(np.random.default_rng(3).integers(0, 256, 1500, dtype=np.uint8).tobytes()))
    for a, b in zip(p.read_coefficients(media).components, p.read_coefficients(media, bulk=False).components):
        assert (a.coefficients == b.coefficients).all()


class Writer:
    """A plain progressive writer, one symbol at a time: zeros, long zero runs, end-of-band runs, fresh refinements."""

    AC = [(8, s) for s in [0x00, 0x10, 0x20, 0xF0, *(r << 4 | s for r in range(15) for s in range(1, 6)), *(0xF0 | s for s in range(1, 6))]]
    DC = [(4, s) for s in range(12)]

    def __init__(self):
        self.bits = []
        self.ac, self.dc = p.canonical(self.AC), p.canonical(self.DC)

    def put(self, value, n):
        self.bits += p._bits(value, n)

    def code(self, table, symbol):
        self.put(*table[symbol])

    def amount(self, v):
        s = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << s) - 1, s)

    def done(self):
        bits, self.bits = np.array(self.bits, np.uint8), []
        return bits


def test_any_progressive_file():
    """Grey 24x16 image with sparse coefficients in scans with every feature of the format."""
    r = np.random.default_rng(8)
    blocks = np.zeros((6, 64), int)
    blocks[:, 0] = r.integers(-60, 60, 6)
    for b in (0, 1, 4):
        for k in r.choice(np.arange(1, 64), 9, replace=False):
            blocks[b, k] = r.integers(-15, 16)
    blocks[4, 1:] = 0
    blocks[4, 60] = 5
    w = Writer()
    before = 0
    for v in blocks[:, 0] >> 1:
        w.code(w.dc, abs(int(v - before)).bit_length())
        w.amount(int(v - before))
        before = v
    scans = [p._scan([(1, 0, 0)], 0, 0, 0, 1, w.done())]
    coarse = np.sign(blocks) * (np.abs(blocks) >> 1)
    run = 0

    def flush():
        nonlocal run
        while run:
            k = min(2, run.bit_length() - 1)
            n = min(run, (2 << k) - 1)
            w.code(w.ac, k << 4)
            w.put(n - (1 << k), k)
            run -= n

    for b in coarse:
        zeros = 0
        for k in range(1, 64):
            if not b[k]:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                w.code(w.ac, 0xF0)
                zeros -= 16
            w.code(w.ac, zeros << 4 | abs(int(b[k])).bit_length())
            w.amount(int(b[k]))
            zeros = 0
        run += zeros > 0
    flush()
    scans.append(p._scan([(1, 0, 0)], 1, 63, 0, 1, w.done()))
    for old, new in zip(coarse, blocks):
        fresh = [k for k in range(1, 64) if new[k] and not old[k]]
        zeros, held = 0, []
        for k in range(1, 64):
            if old[k]:
                held.append(abs(int(new[k])) & 1)
                continue
            if k not in fresh:
                zeros += 1
                if zeros == 16 and any(x > k for x in fresh):
                    w.code(w.ac, 0xF0)
                    w.bits += held
                    zeros, held = 0, []
                continue
            w.code(w.ac, zeros << 4 | 1)
            w.put(int(new[k] > 0), 1)
            w.bits += held
            zeros, held = 0, []
        if zeros or held:
            w.code(w.ac, 0x00)
            w.bits += held
    scans.append(p._scan([(1, 0, 0)], 1, 63, 1, 0, w.done()))
    w.bits = [int(v) & 1 for v in blocks[:, 0]]
    scans.append(p._scan([(1, 0, 0)], 0, 0, 1, 0, w.done()))
    frame = p._segment(0xC2, bytes([8, 0, 16, 0, 24, 1, 1, 0x11, 0]))
    tables = p._segment(0xC4, p._huffman_body(0x00, w.DC) + p._huffman_body(0x10, w.AC))
    quant = p._segment(0xDB, b"\x00" + bytes([3] * 64))
    image = p.read_coefficients(b"".join([b"\xff\xd8", quant, frame, tables, *scans, b"\xff\xd9"]))
    assert (image.components[0].coefficients == blocks).all()
    tensor = p.rgb_tensor(image)
    assert tensor.shape == (16, 24, 3)
    # brute-force inverse transform of one block
    natural = np.zeros((8, 8))
    natural.reshape(-1)[p.ZIGZAG] = blocks[1] * 3
    for x in range(8):
        for y in range(8):
            s = sum((np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) / 4 * natural[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
            assert abs(min(max(s + 128, 0), 255) - int(tensor[x, 8 + y, 0])) <= 0.51


def test_damage_is_found():
    media = p.encode_payload(p.padded(b"abc" * 100))
    with pytest.raises(p.BadImage):
        p.read_coefficients(media[: len(media) // 2] + b"\xff\xd9")
    with pytest.raises(p.BadImage):
        p.read_coefficients(b"GIF89a")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op9_progressive_jpeg(spark, sf).collect()}
    for name, text in (tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()):
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64)
        r = rows.pop(name)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes > 0
        media = p.encode_payload(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        if len(payload) < 4000:
            image = p.read_coefficients(media)
            tensor = p.rgb_tensor(image).astype(int)
            height, width, n = *tensor.shape[:2], tensor.size // 3
            mean = [sum(tensor[:, :, c].ravel().tolist()) / n for c in range(3)]
            flat = tensor.ravel().tolist()
            spread = (sum(x * x for x in flat) / len(flat) - (sum(flat) / len(flat)) ** 2) ** 0.5
            size, colours, sd = r.feature.split(";")
            assert size == f"{width}x{height}" and np.allclose([float(x) for x in colours[4:].split(",")], mean, atol=1e-4) and abs(float(sd[3:]) - spread) < 1e-4
    assert not rows


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, b"x"), (2, "", b""), (None, "é" * 40_000, None)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in p.media_digests(p.encode_media(df)).collect()}
    assert got[1].payload_bytes == got[2].payload_bytes == 64 and got[1].feature == got[2].feature and got[1].n_bytes == 0
    assert got[None].n_bytes == 80_000
    shown = p.decode_media(p.encode_media(df)).where("doc_id = 1").first()
    assert len(shown.tensor) == 3 * shown.height * shown.width
    assert p.media_digests(p.encode_media(df.limit(0))).count() == 0
