import hashlib
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxloom.llm import pieces as pc
from ctxloom.llm.queries import PIECE_BPE, op1_sentencepiece_viterbi, vocabulary


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))


ALPHABET = st.text(alphabet=st.sampled_from("aethino rsld  \n\t.,éçß中▁🙂<>0x41"), max_size=60)


@given(ALPHABET)
@settings(max_examples=300, deadline=None)
def test_matches_the_library(library, text):
    own = pc.Encoder(vocabulary(PIECE_BPE)).ready()
    ids = list(pc.array(own.code, own.packed(text)[0]))
    assert ids == library.encode(text)
    assert pc.decoded(own.model, ids) == library.decode(ids)
    window, marked = pc.Window(own.model), "▁" * own.model.dummy_prefix * bool(text) + text.replace(" ", "▁")
    assert [k for x in marked for k in window.extend(x)] + window.close() == ids  # no stretch known, a look for a commit at every character
    viterbi = pc.StreamingViterbi(own.model, own.known)
    for step in (1, 3, 7):
        assert list(pc.array(own.code, b"".join(viterbi.feed(marked[at : at + step]) for at in range(0, len(marked), step)) + viterbi.finish())) == ids


def test_paths_meet_where_stretches_are_cut(library):
    """Backpointers alone commit before every space mark, whatever the text before."""
    model = pc.PieceModel.load(vocabulary(PIECE_BPE))
    window, done = pc.Window(model), 0
    text = "▁The▁committee's▁internationalisation▁of,▁naïve▁中▁words.▁And▁so▁on"
    for n, x in enumerate(text, 1):
        window.extend(x)
        if x == "▁" and n > 1:
            assert window.text in ("", "▁")
            done += 1
    assert done == text.count("▁") - 1


def test_streaming_in_parts_keeps_a_short_window(library):
    model = pc.PieceModel.load(vocabulary(PIECE_BPE))
    r = random.Random(2)
    text = "".join(r.choice(["th", "er", "ion", "an", "e", "s", "q", "中", "é"]) for _ in range(20_000))
    for step in (1, 7, 5000):
        v = pc.StreamingViterbi(model)
        packed = b"".join(v.feed(text[at : at + step]) for at in range(0, len(text), step))
        early = len(packed) // 2
        ids = list(pc.array("H", packed + v.finish()))
        assert ids == library.encode(text)[1:] or ids == [model.ids[p] for p in model.merged(text)]
        assert early > 0.99 * len(ids)
    v.feed(text)
    assert v.widest < 2 * (pc.COMMIT_EVERY + model.longest)


def test_one_unknown_id_for_each_run():
    model = pc.PieceModel([("<unk>", 0.0, pc.UNKNOWN), ("▁", -2.0, 1), ("a", -3.0, 1), ("▁a", -3.5, 1)], pc.UNIGRAM)
    for text, want in (("☃\n☃", [0]), ("☃" * 200, [0]), ("▁☃☃▁☃a☃\n", [1, 0, 1, 0, 2, 0]), ("☃" * 90 + "▁a" + "☃" * 90, [0, 3, 0])):
        for step in (1, 5, 500):
            v = pc.StreamingViterbi(model)
            assert list(pc.array("H", b"".join(v.feed(text[at : at + step]) for at in range(0, len(text), step)) + v.finish())) == want


def test_equal_sums_take_the_longest_last_piece():
    model = pc.PieceModel([("<unk>", 0.0, pc.UNKNOWN), ("a", -1.0, 1), ("aa", -2.0, 1), ("aaa", -3.0, 1)], pc.UNIGRAM)
    window = pc.Window(model)
    assert window.extend("aaaa") + window.close() == [1, 3]


@given(st.text(alphabet="abc", max_size=12))
@settings(max_examples=200, deadline=None)
def test_unigram_takes_the_best_sum(text):
    rows = [("<unk>", 0.0, pc.UNKNOWN), ("a", -3.0, 1), ("b", -2.5, 1), ("ab", -4.1, 1), ("ba", -3.3, 1), ("aab", -5.2, 1), ("bb", -4.9, 1), ("abba", -6.1, 1)]
    model = pc.PieceModel(rows, pc.UNIGRAM)
    v = pc.StreamingViterbi(model)
    ids = list(pc.array("H", v.feed(text) + v.finish()))
    low = min(s for _, s, _ in rows) - 10

    def best(cuts):
        parts = [text[a:b] for a, b in itertools.pairwise((0, *cuts, len(text)))]
        if any(p not in model.ids and len(p) > 1 for p in parts):
            return None
        return sum(model.score[model.ids[p]] if p in model.ids else low for p in parts)

    if text:
        scores = [s for n in range(len(text)) for c in itertools.combinations(range(1, len(text)), n) if (s := best(c)) is not None]
        window = pc.Window(model)
        single = window.extend(text) + window.close()
        assert [k for k, g in itertools.groupby(single) for _ in range(1 if not k else len(list(g)))] == ids
        own = sum(model.score[k] for k in single if k) + low * text.count("c")
        assert abs(own - max(scores)) < 1e-9


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_sentencepiece_viterbi(spark, sf).collect()
    assert sum(r.early_ids for r in rows) > 0.98 * sum(r.n_ids for r in rows)  # committed on the query's own path
    for r in rows:
        assert r.early_ids > 0 or len(docs[r.doc_id].split()) < 2
    for r in op1_sentencepiece_viterbi(spark, sf).collect():
        text = docs.pop(r.doc_id)
        ids = library.encode(text)
        assert r.n_ids == len(ids) and r.ids_crc32 == pc.zlib.crc32(pc.np.array(ids, "<u4").tobytes())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.decoded_chars == len(text)
    assert not docs


def test_edge_rows(spark, library):
    rows = [(1, None), (2, ""), (None, " two  spaces\n"), (3, "the " * 60_000), (3, "longwordwithoutspaces" * 5_000), (4, "the \n  end of it " * 600_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    encoded = pc.encode_pieces(df, vocabulary(PIECE_BPE))
    assert sorted(r.n_ids for r in encoded.collect()) == sorted(len(library.encode(t or "")) for _, t in rows)
    assert sorted(r.text for r in pc.decode_pieces(encoded, vocabulary(PIECE_BPE)).collect()) == sorted(t or "" for _, t in rows)
    assert pc.encode_pieces(df.limit(0), vocabulary(PIECE_BPE)).count() == 0
