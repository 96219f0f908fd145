import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxloom.llm.queries import BYTE_BPE, op2_rans_token_files, vocabulary
from ctxloom.llm.rans import CorruptSegment, encode_segment, read_segment, read_token_files, token_digests, write_token_files


@given(st.lists(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 2**32 - 1)), max_size=60), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_round_trip(docs):
    ids = np.array([x for d in docs for x in d], "<u4")
    data = encode_segment([None if k == 1 else k for k in range(len(docs))], [len(d) for d in docs], ids, lanes=4, block_ids=16)
    names, there, n, back = read_segment(data)
    assert back.tolist() == ids.tolist() and n.tolist() == [len(d) for d in docs]
    assert [k for k, ok in zip(names, there) if ok] == [k for k in range(len(docs)) if k != 1]


def test_blocks_decode_alone_and_compress():
    ids = np.random.default_rng(1).zipf(1.3, 50_000).clip(max=40_000).astype("<u4")
    data = encode_segment([7], [len(ids)], ids)
    assert read_segment(data, range(2, 4))[3].tolist() == ids[2 * 8192 : 4 * 8192].tolist()
    assert len(data) < 2 * len(ids)


def test_corruption_is_found():
    data = bytearray(encode_segment([7], [3000], np.arange(3000, dtype="<u4") % 97))
    data[-100] ^= 4
    with pytest.raises(CorruptSegment):
        read_segment(bytes(data))


def brute(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(BYTE_BPE))
    at, out = 0, []
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((name, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_edge_rows(spark):
    rows = [(5, "b  c\n\n d"), (None, "x"), (3, None), (9, ""), (1, "the and. " * 4000), (4, "é\tü <|endoftext|>"), (6, "a <|endoftext|> b<|EndOfText|>"), (7, "Long text. " * 900_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    files = write_token_files(df, vocabulary(BYTE_BPE), 2, segment_ids=50)
    got = [tuple(r)[:4] for r in token_digests(files).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert {r.doc_id: len(r.ids) for r in read_token_files(files).collect()}[1] == next(n for d, _, n, _ in got if d == 1)
    assert token_digests(write_token_files(df.limit(0), vocabulary(BYTE_BPE), 2)).count() == 0


def test_special_strings():
    from ctxloom.llm.wordcache import TextEncoder

    text = "a <|endoftext|> b"
    assert 50256 in TextEncoder(vocabulary(BYTE_BPE)).ids(text) and 50256 not in TextEncoder(vocabulary(BYTE_BPE), plain_specials=True).ids(text)


def test_rows_without_an_id_are_many_tasks(spark):
    df = spark.createDataFrame([(None, f"text {k} " * 40) for k in range(400)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = write_token_files(df, vocabulary(BYTE_BPE), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.select("part").distinct().count() > 1
    rows = sorted((r.start, r.n_tokens) for r in token_digests(files).collect())
    assert len(rows) == 400 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:], strict=False))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r)[:4] for r in op2_rans_token_files(spark, sf).collect()) == brute(rows)
