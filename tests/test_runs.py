import pytest

from ctxloom.config import ContextSpec, HierarchySpec
from ctxloom.sources.registry import Registry
from ctxloom.functions.scores import LexiconScorer, score_cached
from ctxloom.operators import models, runner
from ctxloom.operators.forecast import partial_enrichment
from ctxloom.operators.context import ContextEstimator
from ctxloom.sources.registry import Registry


def rows(spark, n=900):
    return spark.range(n).selectExpr("id", "concat('g', pmod(id, 12)) AS g", "double(pmod(id * 37, 29)) AS x", "double(pmod(id, 12)) * 10 + double(pmod(id * 37, 29)) + 5 + double(pmod(id * 13, 7)) AS y")


def test_experiment_improves_on_groups(spark, tmp_path):
    e = runner.Experiment("toy", "y", ("g",), ("x",), ("id",), variant="mean_count", model="ridge", n_folds=3, sample=600)
    r = runner.run_all({"toy": rows(spark)}, [e], str(tmp_path))[0]
    assert r.improvement > 20 and (tmp_path / "toy.md").exists() and (tmp_path / "runs.jsonl").exists() and r.metadata["gate"]["promoted"] is False
    with pytest.raises(ValueError):
        runner.Experiment("t", "y", ("g",), (), ("id",), time_col="id")
    assert runner.run_all({}, [e], str(tmp_path)) == [] and (tmp_path / "failures.jsonl").exists()


def test_experiment_keeps_all_rows_unless_asked(spark):
    df, e = rows(spark, 60_000), runner.Experiment("toy", "y", ("g",), ("x",), ("id",), variant="mean_count", model="ridge", n_folds=3)
    train, test = runner.split_rows(df, e)
    assert e.sample is None and train.count() + test.count() == 60_000
    assert runner.run_experiment(df, e).context["n"] == test.count() > 11_000


def test_search_and_pruning(spark):
    df = rows(spark, 400).selectExpr("x", "double(substr(g, 2)) AS c_mean", "double(pmod(id, 3)) AS c_count", "y")
    train, val, test = df.randomSplit([0.6, 0.2, 0.2], 1)
    found = models.FeatureSearch(["x"], ["c_mean", "c_count"], "y", "ridge").run(train, val, test, 1, ablation=True, significance=True)
    assert "c_mean" in found.best.features and found.best.validation_rmse < found.baseline.validation_rmse and found.test.n == test.count()
    steps = models.iterative_pruning(train, val, ["x", "c_mean", "c_count"], "y", "random_forest", params={"numTrees": 5})
    assert [len(s.features) for s in steps] == [3, 2] and "c_mean" in steps[-1].features
    with pytest.raises(ValueError):
        models.model_kind("prophet")
    assert models.model_kind("XGBoost") == "gradient_boosting" and len(models.grid({"a": [1, 2], "b": [3]})) == 2


def test_cached_scoring_scores_misses_once(spark):
    articles = spark.createDataFrame([(1, "good growth"), (2, "bad loss"), (3, "good growth"), (4, None)], "id int, text string")
    empty = spark.createDataFrame([], "article_key string, model_name string, model_revision string, pos double, neg double, neu double, score double")
    scored, fresh = score_cached(articles, empty, LexiconScorer())
    got = {r.id: r.score for r in scored.collect()}
    assert got[1] == got[3] > 0 > got[2] and got[4] == 0 and fresh.count() == 3
    assert score_cached(articles, fresh, LexiconScorer())[1].count() == 0


def test_enrichment_of_later_blocks(spark):
    df = rows(spark, 300)
    estimator = ContextEstimator(ContextSpec("y", ("g",), ("mean",), 1, n_folds=3), ("id",))
    sides = partial_enrichment(estimator, "id")({"train": df.where("id < 200"), "val": df.where("id BETWEEN 200 AND 249"), "test": df.where("id >= 250")})
    assert all("g_y_mean" in d.columns for d in sides.values()) and sides["test"].where("g_y_mean IS NULL").count() == 0
    assert HierarchySpec().context().strategy == "rolling"


def test_experiments_from_files(spark, tmp_path):
    rows(spark).write.parquet(str(tmp_path / "toy.parquet"))
    (tmp_path / "toy.toml").write_text('[data]\npath = "toy.parquet"\ntarget = "y"\n[experiment]\nkeys = ["g"]\nnumeric = ["x"]\nrow_key = ["id"]\nvariant = "mean_count"\nmodel = "ridge"\nn_folds = 3\n')
    (tmp_path / "plain.toml").write_text('[data]\npath = "nowhere.parquet"\n')
    registry = Registry(str(tmp_path))
    assert runner.experiment_of(registry.info("toy")).keys == ("g",)
    with pytest.raises(ValueError, match="missing settings"):
        runner.experiment_of(registry.info("plain"))
    found = runner.run_registered(spark, registry, folder=str(tmp_path / "out"))
    assert [r.name for r in found] == ["toy"] and spark.read.json(str(tmp_path / "out" / "runs.jsonl")).first()["name"] == "toy"
    (tmp_path / "odd.toml").write_text('[data]\npath = "x"\n[experiment]\nkey = 1\n')
    with pytest.raises(ValueError, match="unknown settings"):
        runner.experiment_of(registry.info("odd"))


def test_search_by_moments_gives_what_training_gives(spark, monkeypatch):
    """One pass over each side serves all sets of gapless features; it agrees with a fit for every set, also with a flat feature."""
    df = rows(spark, 600).selectExpr("x", "1e6 + double(substr(g, 2)) AS c_mean", "double(pmod(id, 3)) AS c_count", "2.5 AS flat_mean", "y")
    train, val, test = df.randomSplit([0.6, 0.2, 0.2], 1)
    search = models.FeatureSearch(["x"], ["c_mean", "c_count", "flat_mean"], "y", "ridge")
    want = [models.train_model("ridge", train, f, "y", val) for _, f in search.combinations(1)]
    last = models.train_model("ridge", train.unionByName(val), ["x", "c_mean", "c_count", "flat_mean"], "y", test)
    leg = [models.train_model("ridge", train, f, "y", test).test for f in (["x"], ["x", "c_mean"])]
    monkeypatch.setattr(models, "train_model", None)
    found = search.run(train, val, test, 1)
    for got, w in zip(found.results, want, strict=True):
        assert got.validation_rmse == pytest.approx(w.test.rmse, rel=1e-9) and got.importances == pytest.approx(w.importances, abs=1e-9)
    assert len(found.best.features) < 4 or found.test.rmse == pytest.approx(last.test.rmse, rel=1e-9)
    both = models.two_legs("ridge", train, test, ["x"], ["c_mean"], "y")
    for got, w in zip((both.base, both.context), leg, strict=True):
        assert (got.rmse, got.mae, got.r2, got.n) == (pytest.approx(w.rmse, rel=1e-9), pytest.approx(w.mae, rel=1e-9), pytest.approx(w.r2, rel=1e-9), w.n)


def test_search_with_gaps_imputes(spark):
    """A gap in training, validation or test rows is filled by the median as before."""
    df = rows(spark, 400).selectExpr("CASE WHEN id % 7 > 0 THEN x END AS x", "double(substr(g, 2)) AS c_mean", "double(pmod(id, 3)) AS c_count", "y")
    train, test = df.randomSplit([0.7, 0.3], 1)
    for side in (train, train.where("x IS NOT NULL")):
        want = models.train_model("ridge", side, ["x"], "y", test).test
        leg = models.two_legs("ridge", side, test, ["x"], ["c_mean"], "y")
        assert leg.base.rmse == pytest.approx(want.rmse, rel=1e-9) and leg.base.n == test.count()
        found = models.FeatureSearch(["x"], ["c_mean"], "y").run(side, test, test, 0)
        assert found.baseline.validation_rmse == pytest.approx(want.rmse, rel=1e-9)


def test_moments_add_up(spark):
    from ctxloom.operators.linalg import moments

    df = spark.createDataFrame([(float(k), k * k / 7 + 1e6) for k in range(50)], "a double, b double")
    part = [moments(df.where(c), ["a", "b"]) for c in ("a < 13", "a >= 13", "a < 0")]
    whole, added = moments(df, ["a", "b"]), part[0] + part[1] + part[2]
    assert added.n == whole.n == 50 and added.means == pytest.approx(whole.means) and added.products.ravel() == pytest.approx(whole.products.ravel(), rel=1e-9)


def _ran(df, node):
    """Lines of the plan that df ran with, of one kind of node."""
    df.collect()
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if f" {node}" in x]


def test_moments_of_seven_columns_are_compiled(spark):
    """With more than 100 numbers a group Spark interprets an aggregation, which takes five times as long; six columns had 103."""
    from ctxloom.operators import linalg

    names, limit = list("abcdefg"), spark.conf.get("spark.sql.codegen.maxFields")
    df = spark.range(50).selectExpr(*[f"double(id % {k + 2}) AS {c}" for k, c in enumerate(names)])
    with linalg._compiled(spark, 2 * 7 * 10):
        found = _ran(df.agg(*linalg.moment_columns(names)), "HashAggregate")
    assert len(found) == 2 and all("*(" in x for x in found)
    m = linalg.moments(df, names)
    assert spark.conf.get("spark.sql.codegen.maxFields") == limit
    assert m.products[0, 0] == pytest.approx(12.5) and m.products[0, 1] == m.products[1, 0] == pytest.approx(sum((i % 2 - 0.5) * (i % 3) for i in range(50)))


def test_positions_sort_by_their_order_alone(spark):
    """A range number before the order tells no two rows of a range apart, but was what the sort compared first; also keys that repeat or are null get a place each."""
    from pyspark.sql import functions as F

    from ctxloom.operators.folds import positions

    df = spark.range(2000).selectExpr("IF(id % 7 = 0, NULL, id % 50) AS k", "id")
    want = [r.id for r in sorted(df.collect(), key=lambda r: (r.k is not None, r.k or 0, r.id))]
    for order, hashed in ((["k", "id"], False), (["h", "id"], True)):
        placed = positions(df.withColumn("h", F.xxhash64("k")), order, hashed=hashed)
        sorts = _ran(placed, "Sort")
        assert not [x for x in sorts if "Sort [__part" in x and order[0] in x] and [x for x in sorts if f"Sort [{order[0]}#" in x]
        rows = sorted(placed.collect(), key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(2000))
        assert [r.id for r in rows] == ([r.id for r in sorted(rows, key=lambda r: (r.h, r.id))] if hashed else want)
    assert positions(df.where("id < 0"), ["k", "id"]).count() == 0


def test_hash_place_is_the_rank_of_the_hash(spark):
    """Folds and splits that share a place are those made alone."""
    from pyspark.sql import functions as F

    from ctxloom.operators import folds

    df = spark.range(3000).withColumn("h", F.xxhash64(F.lit(42), "id"))
    placed = folds.hash_place(df, ["id"])
    got = {r.id: r.place for r in placed.collect()}
    assert got == {r.id: k for k, r in enumerate(sorted(df.collect(), key=lambda r: (r.h, r.id)))}
    pairs = lambda d, c: {r.id: r[c] for r in d.collect()}
    assert pairs(folds.balanced_fold(placed, ["id"], 3, place="place"), "fold") == pairs(folds.balanced_fold(df, ["id"], 3), "fold") == {k: v % 3 for k, v in got.items()}
    assert pairs(folds.selection_split(placed, ["id"], 0.2, False, place="place"), "split") == pairs(folds.selection_split(df, ["id"], 0.2, False), "split")


def test_unneeded_combinations_are_left_out(spark):
    from ctxloom.config import ContextSpec
    from ctxloom.operators.context import ContextEstimator, serving

    spec = ContextSpec("y", ("a", "b", "c"), ("mean", "count"), min_group_size=2, n_folds=3, depth=3)
    assert serving(spec, ["a_y_mean"]).allowed_interactions == ()
    assert serving(spec, ["a__b_y_mean"]).allowed_interactions == (("a", "b"),)
    df = spark.range(200).selectExpr("id", "id % 5 AS a", "id % 3 AS b", "id % 40 AS c", "double(id) AS y")
    for columns in (["a_y_mean", "c_y_count"], ["a__b_y_mean"], ["a__b__c_y_mean"]):
        take = lambda s, c=columns: sorted(map(tuple, ContextEstimator(s, ("id",)).fit_transform(df)[0].select("id", *c).collect()))
        assert take(serving(spec, columns)) == take(spec)


def _jobs(spark, name):
    """Spark jobs of a query on the smallest tables, and its rows."""
    from ctxloom.catalog import queries

    spark.sparkContext.setJobGroup(f"jobs of {name}", name)
    try:
        found = queries()[name](spark, "/root/testdata/sf0.001").collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"jobs of {name}")), found
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_permuted_target_makes_its_orders_once(spark):
    """Values of before, in few jobs."""
    n, found = _jobs(spark, "permuted_target")
    assert n < 110 and [r.advantage for r in found] == [pytest.approx(-0.0204392010, abs=1e-9), pytest.approx(-0.1813886618, abs=1e-9)]


def test_shuffled_groups_makes_its_orders_once(spark):
    n, found = _jobs(spark, "shuffled_groups")
    assert n < 110 and found[0].real == pytest.approx(-0.0606530581, abs=1e-9) and found[0].passed == (found[0].real - found[0].shuffled > 0.5 * found[0].real)


def test_shuffled_groups_serves_both_legs_by_one_pass(spark, monkeypatch):
    """Values of before."""
    from ctxloom.catalog import queries

    calls, moments = [], models.moments
    monkeypatch.setattr(models, "moments", lambda *a: calls.append(a) or moments(*a))
    row = queries()["shuffled_groups"](spark, "/root/testdata/sf0.001").first()
    assert len(calls) == 1 and row.real == pytest.approx(-0.0606530581, abs=1e-9) and row.shuffled == pytest.approx(-0.0386840768, abs=1e-9)


def test_legs_of_several_contexts_are_those_made_alone(spark):
    """Also where a gap needs an imputer."""
    df = rows(spark, 400).selectExpr("x", "double(substr(g, 2)) AS c_mean", "CASE WHEN id % 7 > 0 THEN double(pmod(id, 3)) END AS c_gap", "double(pmod(id, 5)) AS c_count", "y")
    train, test = df.randomSplit([0.7, 0.3], 1)
    for sets in ([["c_mean"], ["c_mean", "c_count"]], [["c_gap"], ["c_mean"]]):
        for got, context in zip(models.legs("ridge", train, test, ["x"], sets, "y"), sets, strict=True):
            want = models.two_legs("ridge", train, test, ["x"], context, "y")
            assert (got.base.rmse, got.context.rmse, got.improvement) == (pytest.approx(want.base.rmse, rel=1e-9), pytest.approx(want.context.rmse, rel=1e-9), pytest.approx(want.improvement, rel=1e-9))


def test_unread_statistics_are_left_out(spark):
    from ctxloom.config import ContextSpec
    from ctxloom.operators.context import ContextEstimator, serving

    spec = ContextSpec("y", ("a", "b"), ("mean", "std", "count"), min_group_size=2, n_folds=3)
    assert (serving(spec, ["a_y_mean"]).stats, serving(spec, ["a_y_mean"]).fold_features) == (("mean", "count"), ())
    assert serving(ContextSpec("y", ("a",), ("mean", "std"), relative=True), ["a_y_mean"]).stats == ("mean", "std")
    df = spark.range(200).selectExpr("id", "IF(id % 9 = 0, NULL, id % 50) AS a", "id % 3 AS b", "IF(id % 4 = 0, NULL, double(id)) AS y")
    for columns in (["a_y_mean"], ["a_y_std", "b_y_mean_fold_std"], ["a__b_y_mean_fold_upper", "b_y_count"]):
        sides = []
        for s in (spec, serving(spec, columns)):
            out, model = ContextEstimator(s, ("id",)).fit_transform(df)
            sides.append([sorted(map(tuple, d.select("id", *columns).collect()), key=lambda r: r[0]) for d in (out, model.transform(df))])
        assert sides[0] == sides[1]


def test_whole_search_by_moments_gives_what_training_gives(spark, monkeypatch):
    """All sets of the search with ablations and significance, by moments as by a fit for every set; also with gaps and a feature without values."""
    gap = lambda c, k: f"CASE WHEN id % {k} > 0 THEN {c} END"
    g, n, x = "double(substr(g, 2))", "double(pmod(id, 3))", "double(pmod(id * 53, 31))"
    exprs = {"whole": [f"{g} AS c_mean", f"{n} AS c_count", f"{x} AS d_mean"], "gaps": [f"{gap(g, 5)} AS c_mean", f"{n} AS c_count", "double(NULL) AS d_mean"]}
    for columns in exprs.values():
        sides = rows(spark, 500).selectExpr("x", *columns, "y").randomSplit([0.6, 0.2, 0.2], 1)
        search = models.FeatureSearch(["x"], ["c_mean", "c_count", "d_mean"], "y", "ridge")
        quick = search.run(*sides, 3, ablation=True, significance=True)
        with monkeypatch.context() as m:
            m.setattr(models, "closed_form", lambda *a: False)
            slow = search.run(*sides, 3, ablation=True, significance=True)
        names = [r.strategy for r in quick.results]
        assert {"context", "without:d_mean", "without_best:1", "without_worst:3", "best:3", "context_half", "base_context_half"} <= set(names) and [x for x in names if x.startswith("p<")]
        assert [(r.strategy, r.features) for r in slow.results] == [(r.strategy, r.features) for r in quick.results]
        for got, want in zip(quick.results, slow.results, strict=True):
            assert got.validation_rmse == pytest.approx(want.validation_rmse, rel=1e-9) and got.importances == pytest.approx(want.importances, abs=1e-9)
        assert quick.best.validation_rmse == pytest.approx(slow.best.validation_rmse, rel=1e-9) and quick.test.rmse == pytest.approx(slow.test.rmse, rel=1e-6)


def test_random_sets_are_as_many_as_the_features_ask_for():
    search = lambda n: models.FeatureSearch(["x"], [f"c{k}_mean" for k in range(n)], "y")
    assert [search(n).draws() for n in (1, 2, 6, 9, 11, 20)] == [2, 4, 50, 50, 102, 500]
    names = [n for n, _ in search(9).combinations()]
    assert len([n for n in names if n.startswith("random:")]) > 40 and len([n for n in names if n.startswith("context_random:")]) > 5
    assert len({tuple(f) for n, f in search(9).combinations() if "random" in n}) == len([n for n in names if "random" in n])


def test_feature_search_is_the_whole_search(spark):
    """It was one random set of two context features, without ablations and significance."""
    n, found = _jobs(spark, "feature_search")
    names = [r.strategy for r in found]
    assert n < 110 and len(names) == len(set(names)) > 80 and max(r.n_features for r in found) == 12 and sum(r.best for r in found) == 1
    kinds = {x.split(":")[0] for x in names}
    assert {"baseline", "all", "context", "stat", "random", "context_random", "without", "without_best", "without_worst", "best", "context_half"} <= kinds and [x for x in names if "p<" in x]
    assert min(found, key=lambda r: (r.validation_rmse, r.n_features)).best
    assert found[0].validation_rmse == pytest.approx(30437.7091091569, rel=1e-9)


def test_search_reads_both_sides_together(spark, monkeypatch):
    """The same results as of sides read one by one, also with gaps and without validation rows."""
    df = rows(spark, 400).selectExpr("x", "double(substr(g, 2)) AS c_mean", "double(pmod(id, 3)) AS c_count", "y", "CASE WHEN id % 5 = 0 THEN 'val' WHEN id % 7 > 0 THEN 'train' END AS split")
    search = models.FeatureSearch(["x"], ["c_mean", "c_count"], "y")
    for d in (df, df.selectExpr("IF(x % 4 = 0, NULL, x) AS x", "c_mean", "c_count", "y", "split"), df.where("split = 'train'")):
        want = search.run(d.where("split = 'train'"), d.where("split = 'val'"), df, 2, ablation=True)
        with monkeypatch.context() as m:
            m.setattr(models, "train_model", None)
            got = search.run_split(d, df, 2, ablation=True)
        assert [(r.strategy, r.features) for r in got.results] == [(r.strategy, r.features) for r in want.results]
        assert [r.validation_rmse for r in got.results] == pytest.approx([r.validation_rmse for r in want.results], rel=1e-9) and got.test.rmse == pytest.approx(want.test.rmse, rel=1e-9)
