import math

import numpy as np

from ctxloom.llm import importance as im
from ctxloom.llm.queries import op3_importance_resampling


def test_kth_largest(spark):
    r = np.random.default_rng(4)
    values = np.concatenate([r.normal(0, 1, 300), r.normal(0, 1e6, 300), np.repeat(2.5, 50), [-0.0, 1e-300]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for k in (1, 2, 57, 300, 331, len(values)):
        assert im.kth_largest(df, "v", k) == np.sort(values)[-k]


def test_ngrams_are_those_of_each_document():
    docs = ["Und und und und!", "", "a", "  x\n", "Große Häuser, 12"]
    code, at, shape, shape_at = im.hashed_ngrams(docs)
    for k, d in enumerate(docs):
        one = im.hashed_ngrams([d])
        assert code[at[k] : [*at, len(code)][k + 1]].tolist() == one[0].tolist()
        assert shape[shape_at[k] : [*shape_at, len(shape)][k + 1]].tolist() == one[2].tolist()


def grams_of(text):
    """The n-grams of a text, one after another in plain Python, by the definitions of the operator's docstring."""
    data = ("\n\n" + text + "\n").encode()
    out = [("t", (int.from_bytes(data[k : k + 3]) * 2654435761 % 2**32) >> 18) for k in range(len(data) - 2)]
    out += [("t", (int.from_bytes((data[k:] + b"\n\n")[:3]) * 2654435761 % 2**32) >> 18) for k in (len(data) - 2, len(data) - 1)]
    before, last = 0, None
    for word in text.encode().split():
        kinds = [1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 0 for b in word]
        ups = kinds.count(2)
        case = min(ups, 2) + 3 * (kinds[0] == 2)
        n = len(word)
        sums = n, sum(word), sum(k * b for k, b in enumerate(word))
        length = 0 if n < 2 else 1 if n < 3 else 2 if n < 5 else 3 if n < 9 else 4 if n < 16 else 5
        shape = ((case * 6 + length) * 256 + word[-1]) * 2 + (sums == last)
        out.append(("s", ((before * 0x9E3779B97F4A7C15 + shape) * 0xD1B54A32D192ED03 % 2**64) >> 52))
        before, last = shape + 1, sums
    return out, len(data)


def brute(rows, good):
    """Weights from dictionaries, one document at a time."""
    from collections import Counter

    raw, target, found = Counter(), Counter(), []
    for name, text in rows:
        grams, n = grams_of(text or "")
        found.append((grams, n))
        raw.update(grams)
        if name in good:
            target.update(grams)
    sums = {side: {k: sum(c for (kind, _), c in side_counts.items() if kind == k) for k in "ts"} for side, side_counts in (("raw", raw), ("target", target))}
    # every document has one empty shape besides its pairs; it counts in the totals, and its ratio is 1
    sums["raw"]["s"] += len(rows)
    sums["target"]["s"] += sum(name in good for name, _ in rows)

    def ratio(gram):
        kind, bucket = gram
        if gram == ("s", 0) or not sums["target"][kind]:
            return 0.0
        return math.log((target[gram] + im.SHRINK) / (raw[gram] * sums["target"][kind] / sums["raw"][kind] + im.SHRINK)) / im.OVERLAP

    known = {gram: ratio(gram) for gram in raw}
    return [round(im.PASSAGE * math.fsum(map(known.__getitem__, grams)) / n, 9) for grams, n in found]


def test_query_weights_and_selection(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    got = {r.doc_id: r for r in op3_importance_resampling(spark, sf).collect()}
    assert np.allclose([got[name].log_weight for name, _ in rows], brute(rows, good), atol=1e-6)
    w = np.array([r.log_weight for r in got.values()])
    k = round(float((1 / (1 + np.exp(-np.clip(w, -500, 500)))).sum()))
    order = sorted(got.values(), key=lambda r: -r.key)
    assert {r.doc_id for r in order[:k]} == {r.doc_id for r in order if r.kept}


def test_noise_decides_between_the_models_only(spark):
    """Some decisions differ from a plain threshold at the same k, and all of them near it."""
    rows = op3_importance_resampling(spark, "/root/testdata/sf0.1").collect()
    k = sum(r.kept for r in rows)
    least = sorted((r.log_weight for r in rows), reverse=True)[k - 1]
    turned = [r.log_weight for r in rows if r.kept != (r.log_weight >= least)]
    assert 0.003 * len(rows) < len(turned) < 0.03 * len(rows) and max(abs(w - least) for w in turned) < 15
    noise = np.array([r.key - r.log_weight for r in rows])
    assert abs(noise.mean() - 0.5772) < 0.05 and abs(noise.std() - np.pi / 6**0.5) < 0.05


def test_long_texts_in_parts():
    text = "the end of it, and so on. " * 100_000
    parts = list(im.in_parts(["a", text, "", "b" * 3_000_000]))
    assert "".join(t for places, held in parts for p, t in zip(places, held) if p == 1) == text
    assert sorted({p for places, _ in parts for p in places}) == [0, 1, 2, 3] and max(sum(map(len, held)) for _, held in parts) <= im.PART


def test_held_out_accuracy(spark):
    """Fitted on three labels of four, judged on the fourth."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, held = labels.where("pmod(xxhash64(doc_id), 4) <> 0"), labels.where("pmod(xxhash64(doc_id), 4) = 0")
    rows = im.select_by_importance(docs, fit).join(held, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.97
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.97


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "the end of it"), (3, "the end of it"), (3, "the end of it"), (4, "x" * 100_000)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    assert im.select_by_importance(df, labels).count() == 6
    assert all(r.kept for r in im.select_by_importance(df, labels.limit(0)).collect())
    assert im.select_by_importance(df.limit(0), labels).count() == 0
    # ids of null and -1 do not share noise, nor do different texts without an id; a k of 0 keeps nothing
    keys = {(r.doc_id, r.text): r.noise for r in spark.createDataFrame([(None, "a"), (None, "b"), (-1, "a"), (None, None)], "doc_id long, text string").withColumn("noise", im.gumbel(3)).collect()}
    assert len(set(keys.values())) == 4
    bad = spark.createDataFrame([(k, "%$# 0x " * 400) for k in range(5)] + [(9, "good words " * 5)], "doc_id long, text string")
    got = im.select_by_importance(bad.where("doc_id < 9"), spark.createDataFrame([(77, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 5
