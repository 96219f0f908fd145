import duckdb

from ctxloom.llm import urls as u
from ctxloom.llm.queries import op4_blocked_bloom_urls


def brute(url, rules, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = None
    for action, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (fit is None or len(rule) > len(fit[1])):
            fit = action, rule
    return host, path, fit and fit[1], fit[0] if fit else ("block" if url in listed else "allow")


URLS = [None, "", "no scheme", "http://Example.COM/en/7?x", "https://a.example.com/en/8", "https://badexample.com/en/7", "ftp://x.NET/de/8", "s://example.net/de/81", "http://net/de/", "http://h", "http://h?q://z/en/", "http://ÄB.org/es/#f", "://com/en/", "http://com/en", "http://org/ES/", "x://y://com/en/1"]


def test_rules_both_ways(spark, monkeypatch):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([*URLS, *URLS[:6]])], "page_id long, url string")
    want = sorted((k, *brute(v, u.RULES, ())) for k, v in enumerate([*URLS, *URLS[:6]]))
    empty = spark.createDataFrame([], "canonical string")
    for inline in (200, 0):
        monkeypatch.setattr(u, "INLINE_RULES", inline)
        assert sorted(tuple(r)[:5] for r in u.filter_urls(df, empty).collect()) == want
    assert u.filter_urls(df.limit(0), empty).count() == 0


def test_filter_passes_all_and_join_removes_the_rest(spark, monkeypatch):
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://www.h', id % 3000, '.test/p/?utm_source=x&b=', id % 2, '&ref=q#t') AS url", "'c' AS canonical", "1 AS block")
    listed = u.with_parts(pages.where("page_id % 7 = 0").select("url")).select("canonical")
    keys = {r.canonical for r in listed.collect()}
    assert "h0.test/p?b=0" in keys
    hits = u.possible_hits
    for piece in (1 << 16, 7):
        monkeypatch.setattr(u, "PIECE_ROWS", piece)
        monkeypatch.setattr(u, "possible_hits", lambda *a, n=piece: hits(*a, n))
        rows = u.filter_urls(pages, listed, ()).collect()
        assert len(rows) == 6000 and {r.page_id for r in rows if r.verdict == "block"} == {k for k in range(6000) if f"h{k % 3000}.test/p?b={k % 2}" in keys}
    blocks = len(keys) // 4
    passed = hits(u.with_parts(pages.select("page_id", "url")), u.bloom_rows(listed.distinct(), blocks), blocks).where("maybe_listed").count()
    assert passed < 6000 * 0.5


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = op4_blocked_bloom_urls(spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(u.ORACLE).fetchall(), key=str)
    assert got.where("listed").count() > 0
