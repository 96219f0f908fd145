import corpus_pipeline as cp
from ctxloom.llm import secrets as sc
from ctxloom.llm.queries import secret_vocabulary

from .test_importance import brute as brute_weights
from .test_minhash import brute as brute_groups
from .test_packing import verify


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    steps = {}
    for name, stage in cp.STAGES:
        steps[name] = (rows(docs), docs := cp.staged(stage(spark, docs, sf), name))
        if name != "packing":
            assert sorted(docs.columns) == sorted(columns)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = steps["quality_classifier"][0], rows(steps["quality_classifier"][1])
    weights = brute_weights(before, {d for d, q in labels.items() if q == 1})
    sure = {d for (d, _), w in zip(before, weights) if w > 8}, {d for (d, _), w in zip(before, weights) if w < -10}
    kept = {d for d, _ in after}
    assert sure[0] <= kept and not sure[1] & kept and set(after) <= set(before)
    before, after = steps["quality_rules"][0], rows(steps["quality_rules"][1])
    assert set(after) <= set(before) and all(len(t.split()) >= 50 for _, t in after)
    before, after = steps["near_dedup"][0], rows(steps["near_dedup"][1])
    assert {d for d, _ in after} == {d for d, _, _, k in brute_groups(before) if k}
    before, after = steps["secret_scan"][0], rows(steps["secret_scan"][1])
    v = secret_vocabulary()
    assert len(before) == len(after) and not any(sc.all_spans(t, v)[0] for _, t in after)
    assert sum(a == b for a, b in zip(before, after)) == sum(not sc.all_spans(t, v)[1] for _, t in before)
    assert verify(after, steps["packing"][1].collect(), 2048) > 0.9


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_edge_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, shared ids, extra columns, a text of 10 MB and an empty table pass all stages."""
    prose = " ".join(f"w{k} the" for k in range(60))
    other = " ".join(f"v{k} the" for k in range(60))
    long = " ".join(f"x{k} and" for k in range(900_000))
    rows = [
        (1, prose, "en", 5, "a"), (1, prose, "en", 5, "b"), (None, prose + " end", "en", None, "near 1"), (None, other, "en", 5, "c"), (None, other, "en", 5, "d"), (None, other + " end", "en", 5, "e"),
        (2, None, None, 0, "null"), (3, "", "en", 0, "empty"), (4, "x " * 400, "qq", 800, "bad"), (None, "x " * 400, "qq", 800, "bad"), (5, long, "zz", len(long), "long"), (5, "y " * 400, "qq", 800, "bad"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, kept string")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for source in (docs, docs.limit(0)):
        step = source
        for name, stage in cp.STAGES[:-1]:
            step = cp.staged(stage(spark, step, str(tmp_path)), name)
            assert step.columns == docs.columns
        assert cp.packing(spark, step, str(tmp_path)).count() >= step.count()
    rules = cp.quality_rules(spark, docs, str(tmp_path))
    assert sorted(r.kept for r in rules.collect()) == ["a", "b", "c", "d", "e", "long", "near 1"]
    left = [(r.doc_id, r.kept) for r in cp.near_dedup(spark, rules, str(tmp_path)).collect()]
    assert len(left) == 3 and {(None, "c"), (None, "d"), (None, "e")} & set(left) and (5, "long") in left and sum(i == 1 for i, _ in left) == 1
