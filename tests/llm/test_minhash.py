import random
import re

from ctxloom.llm import common, components, minhash
from ctxloom.llm.minhash import near_duplicates
from ctxloom.llm.queries import op5_minhash_near_dedup


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Components by comparing every pair of different sets that share a shingle."""
    sets = {}
    for name, text in rows:
        sets.setdefault(shingles(text), []).append(name)
    reps = [s for s in sets if s]
    parent = list(range(len(reps)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    where = {}
    for k, s in enumerate(reps):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in enumerate(reps):
        for j in {j for x in s for j in where[x] if j < k}:
            inter = len(s & reps[j])
            if 100 * inter >= 75 * (len(s) + len(reps[j]) - inter):
                parent[root(k)] = root(j)
    least = {}
    for k, s in enumerate(reps):
        least[root(k)] = min([least.get(root(k), 1 << 62), *sets[s]])
    of = {s: least[root(k)] for k, s in enumerate(reps)}
    return sorted((name, len(s := shingles(text)), c := of[s] if s else name, c == name) for name, text in rows)


def test_query_matches_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        sf = f"/root/testdata/{sf}"
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        assert sorted(map(tuple, op5_minhash_near_dedup(spark, sf).collect())) == brute(rows)


def test_large_groups(spark, monkeypatch):
    """Copies with up to eight edited words, and a passage many documents share, in buckets over the limit."""
    monkeypatch.setattr(minhash, "BUCKET", 6)
    r = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(220):
        words = list(base)
        for _ in range(r.randrange(9)):
            words[r.randrange(150)] = f"e{r.randrange(40)}"
        if k % 9 == 0:
            words = words[: r.randrange(90, 150)]
        rows.append((1000 - k, " ".join(words)))
    for k in range(120):
        rows.append((2000 + k, " ".join([f"u{r.randrange(10**6)}" for _ in range(60)] + base[:60])))
    rows += [(5000 + k, rows[3][1].upper()) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute(rows)


def test_edge_rows(spark):
    rows = [(4, "a b"), (2, "A\tB"), (9, None), (8, ""), (7, " \n"), (6, "a b c d e f"), (3, "x " * 5000)]
    df = spark.createDataFrame([(*r, "k", 1.0) for r in rows], "doc_id long, text string, keys string, n double")
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "q w"), (1, "q w"), (None, "lone words")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(odd).collect()), key=str) == [(1, 1, 1, True), (None, 1, 1, False), (None, 1, None, True)]
    # near copies without an id belong to the id they copy; of a group without any id one row stays
    words = [f"w{k}" for k in range(80)]
    copies = [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in (3, 3, 40)]
    rows = [(7, " ".join(words)), *((None, c) for c in copies), *((None, c.upper().replace("W", "v")) for c in copies)]
    got = near_duplicates(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, tag int"), carry=("tag",)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.tag < 4} == {(7, 7, True), (None, 7, False)}
    assert [r.component_id for r in got if r.tag > 3] == [None] * 3 and sum(r.kept for r in got if r.tag > 3) == 1


def test_heavy_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 50)
    monkeypatch.setattr(components, "HEAVY", 50)
    many = spark.range(1000).selectExpr("CASE WHEN id < 700 THEN 1 ELSE id END AS u", "id AS v")
    one = spark.range(900).selectExpr("id AS u", "id * 2 AS w")
    got = common.hot_join(many, one, "u", "v")
    assert got.columns == many.join(one, "u").columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(one, "u").collect()))
    star = spark.range(1, 400).selectExpr("0 AS a", "id AS b").union(spark.range(1000, 1300).selectExpr("id AS a", "id + 1 AS b"))
    found = dict(map(tuple, components.connected_components(star).collect()))
    assert all(found[k] == 0 for k in range(400)) and all(found[k] == 1000 for k in range(1000, 1301))
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[: k % 50] + [f"x{k}"] + words[k % 50 + 1 :])) for k in range(300)] + [(400 + k, " ".join(words)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute(rows)
