import datetime as dt

import pytest

from ctxloom.sources import files, schemas
from ctxloom.sources.registry import MARKER, Registry, Store, content_hash, manifest_of


def test_commented_csv_and_universe(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,listed_at,delisted_at,name\n# a remark\nA,2001-02-03,,Alpha\nB,,not a date,Beta\nC,,2020-01-01,Gamma\n")
    got = {r.ticker: (r.listed_at, r.delisted_at) for r in files.universe(spark, str(tmp_path / "u.csv")).collect()}
    assert got == {"A": (dt.date(2001, 2, 3), None), "B": (None, None), "C": (None, dt.date(2020, 1, 1))}
    (tmp_path / "a.csv").write_text("ticker,published_at,text,source\nA,2024-01-01T10:00:00Z,hello,x\nB,bad,t,y\n")
    assert [r.ticker for r in files.seed_articles(spark, str(tmp_path / "a.csv")).collect()] == ["A"]
    assert [(r.ticker, r.published_at) for r in files.unreadable_articles(spark, str(tmp_path / "a.csv")).collect()] == [("B", "bad")]


def test_partitioned_store(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.datetime(2024, m, 5), float(m)) for m in range(1, 7)], "ticker string, ts timestamp, v double")
    store = Store(str(tmp_path), "prices")
    meta = store.write(df, "ts", ("2024-01-01", "2024-06-30"))
    assert meta == store.write(df, "ts", ("2024-01-01", "2024-06-30")) and meta["sha256"] == content_hash(df)
    assert meta["rows"] == 6 and store.covers("2024-02-01", "2024-03-01") and store.covers("2024-01-01T00:00:00Z", "2024-06-30T00:00:00+00:00") and not store.covers("2023-12-31", "2024-03-01")
    part = files.read_partitioned(spark, store.path, ["ticker", "ts", "v"], "ts", dt.datetime(2024, 2, 1), dt.datetime(2024, 4, 1))
    assert sorted(r.v for r in part.collect()) == [2.0, 3.0] and part.columns == ["ticker", "ts", "v"]
    assert "PartitionFilters: [" in part._jdf.queryExecution().explainString(part.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert content_hash(df) == content_hash(df.orderBy("v", ascending=False).repartition(3)) != content_hash(df.limit(5))
    (tmp_path / "prices" / MARKER).unlink()
    with pytest.raises(PermissionError):
        store.clear()
    with pytest.raises(ValueError):
        Store(str(tmp_path), "../elsewhere")


def test_small_files(spark, tmp_path):
    """Also by a path with a scheme that local calls cannot open."""
    path = f"file://{tmp_path}/deep/x.json"
    files.write_json({"a": 1}, path)
    files.write_json({"a": "\u00e4"}, path)
    assert (tmp_path / "deep" / "x.json").read_text() == '{\n "a": "\\u00e4"\n}'
    for k in range(3):
        files.append_json({"k": k}, f"file://{tmp_path}/log", spark)
    assert sorted(r.k for r in spark.read.json(f"{tmp_path}/log").collect()) == [0, 1, 2]


def test_registry(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d.parquet"))
    (tmp_path / "d.toml").write_text('[data]\npath = "d.parquet"\ntarget = "id"\n')
    reg = Registry(str(tmp_path))
    assert reg.names() == ["d"] and reg.info("d").target == "id" and reg.load(spark, "d").count() == 3 and reg.register_views(spark) == ["d"]
    with pytest.raises(KeyError):
        reg.info("nope")
    (tmp_path / "x.bin").write_bytes(b"abc")
    wanted = manifest_of(str(tmp_path), "*.bin")
    files.write_json(wanted, str(tmp_path / "manifest.json"))
    assert reg.verify() == {"x.bin": True}
    (tmp_path / "x.bin").write_bytes(b"abd")
    assert reg.verify() == {"x.bin": False}


def test_append_missing(spark, tmp_path):
    path = str(tmp_path / "cache")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    files.append_missing(a, path, ["k"])
    files.append_missing(a.union(spark.createDataFrame([(3, "z")], a.schema)), path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_schema_validation(spark):
    rows = [("A", dt.datetime(2024, 1, 1), "t", "s"), ("A", dt.datetime(2024, 1, 1), "u", "s")]
    v = schemas.validate(spark.createDataFrame(rows, schemas.ARTICLES), "articles")
    assert not v.passed and v.repeated.count() == 1
    assert schemas.validate(spark.createDataFrame(rows[:1], schemas.ARTICLES), "articles").passed
    assert "missing text" in schemas.validate(spark.createDataFrame(rows[:1], schemas.ARTICLES).drop("text"), "articles").problems
    assert schemas.validate(spark.createDataFrame([(1,)], "extra int"), "prices").problems[-1] == "unexpected extra"
