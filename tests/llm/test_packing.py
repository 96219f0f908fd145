import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxloom.llm.packing import pack_documents, shortest_pack_first
from ctxloom.llm.queries import WORD_BPE, op7_shortest_pack_first, vocabulary


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 1000), max_size=20))
@settings(max_examples=100, deadline=None)
def test_patterns_hold_the_histogram(histogram):
    held = Counter()
    for count, pattern in shortest_pack_first(histogram, 64):
        assert sum(pattern) <= 64
        for length in pattern:
            held[length] += count
    assert held == Counter(histogram)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
@settings(max_examples=200, deadline=None)
def test_same_packs_as_one_by_one(histogram):
    """Longest first, each piece into the pack with most room, a new pack only where none has enough."""
    rooms = []
    for length in sorted(Counter(histogram).elements(), reverse=True):
        best = max(rooms, default=-1)
        if best >= length:
            rooms.remove(best)
            rooms.append(best - length)
        else:
            rooms.append(64 - length)
    packed = [64 - sum(pattern) for count, pattern in shortest_pack_first(histogram, 64) for _ in range(count)]
    assert sorted(packed) == sorted(rooms)


def test_a_grown_pack_is_offered_again():
    assert shortest_pack_first({1048: 1, 300: 3}, 2048) == [(1, (1048, 300, 300, 300))]


def verify(rows, packed, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(WORD_BPE))
    ids = {name: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4") for name, text in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in packed:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == ids.keys()
    for name, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[name])
            assert p.ids_crc32 == zlib.crc32(ids[name][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[name])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return sum(map(len, ids.values())) / (capacity * len(by_sequence))


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "the thou " * 700), (4, "a b c"), (5, "a b c"), (6, "mail <|endoftext|> and <|STARTOFTEXT|>"), (7, "Long text. " * 900_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rank int")
    verify(rows, pack_documents(df, vocabulary(WORD_BPE), 1, 256).collect(), 256)
    assert pack_documents(df.limit(0), vocabulary(WORD_BPE), 1, 256).count() == 0


def test_query_wastes_little(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert verify(rows, op7_shortest_pack_first(spark, sf).collect(), 2048) > 0.97
