import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxloom.llm import divergence as dv
from ctxloom.llm.queries import op6_divergence_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@given(st.text(alphabet="ab \n\t#|é\xa0.", max_size=80))
@settings(max_examples=300, deadline=None)
def test_counts(text):
    assert dv.document_counts(text)[:5] == brute(text)


def test_distance():
    p, q = np.array([[1, 1, 0], [4, 0, 0], [0, 0, 0], [2, 2, 2]]), np.array([[1, 1, 0], [0, 1, 1], [1, 0, 0], [1, 2, 3]])
    d = dv.js_distance(p, q)
    assert d[0] == 0 and d[1] == 1 and d[2] == 0
    m = (np.array([1, 1, 1]) / 3 + np.array([1, 2, 3]) / 6) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m))
    assert abs(d[3] - np.sqrt((kl(np.array([1, 1, 1]) / 3) + kl(np.array([1, 2, 3]) / 6)) / 2)) < 1e-12


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op6_divergence_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    good = []
    for r in rows:
        n = brute(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)
        if labels.get(r.doc_id) == 1 and not r.base_failed:
            good.append(r.kept)
    assert sum(good) / len(good) > 0.99
    # references and distances, one document at a time
    known = {}
    for d in docs.values():
        c, w = dv.document_counts(d.text)[5:]
        a, b = known.get(d.lang, (0, 0))
        known[d.lang] = (a + c, b + w)
    for r in rows[:200]:
        c, w = dv.document_counts(docs[r.doc_id].text)[5:]
        a, b = known[docs[r.doc_id].lang]
        assert abs(r.char_distance - dv.js_distance(c[None], a[None])[0]) < 1e-5 and abs(r.word_distance - dv.js_distance(w[None], b[None])[0]) < 1e-5


def histograms(text):
    """Character classes and common words of a text, counted one at a time."""
    classes, common = Counter(), Counter()
    for c in text:
        classes["beyond" if ord(c) > 127 else next((k for k, chars in dv.CLASSES.items() if c in chars), "other")] += 1
    known = {w for words in dv.COMMON_WORDS.values() for w in words.split()}
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        bare = word[:-1] if word[-1] in ",." else word
        common[next((w for w in (bare, bare.lower()) if w in known and bare in (w, w.capitalize())), None)] += 1
    return classes, common


def distance(p, q):
    p, q = ({k: v / max(1, sum(c.values())) for k, v in c.items()} for c in (p, q))
    if not any(p.values()) or not any(q.values()):
        return 0.0
    mid = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    return (sum(v * math.log2(v / mid[k]) for c in (p, q) for k, v in c.items() if v) / 2) ** 0.5


def two_parts(common):
    return Counter({"common": sum(v for k, v in common.items() if k is not None), "other": common[None]})


def test_verdicts_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {k: histograms(d.text) for k, d in docs.items()}
    usual = {}
    for k, d in docs.items():
        for own, more in zip(usual.setdefault(d.lang, (Counter(), Counter())), found[k]):
            own.update(more)
    rejected = 0
    for r in op6_divergence_rules(spark, sf).collect():
        (classes, common), (all_classes, all_common) = found[r.doc_id], usual[docs[r.doc_id].lang]
        n = sum(common.values())
        own, whole = two_parts(common), two_parts(all_common)
        share, usual_share = own["common"] / max(1, n), whole["common"] / sum(whole.values())
        odd = sum(classes.values()) >= 200 and distance(classes, all_classes) > 0.3
        odd |= n >= 100 and distance(common, all_common) > 0.42
        odd |= n >= 50 and usual_share >= 0.1 and share < usual_share and distance(own, whole) > 0.36 * distance(Counter(other=1), whole)
        assert r.kept == (not r.base_failed and not odd), r.doc_id
        rejected += odd and not r.base_failed
    assert rejected > 20


def test_a_text_of_ten_megabytes(spark):
    long = " ".join(f"w{k} the" for k in range(900_000))
    df = spark.createDataFrame([(1, long, "en", "a"), (2, prose("en", 300, "w"), "en", "b")], "doc_id long, text string, lang string, tag string")
    got = {r.tag: r for r in dv.judge_quality(df, carry=("tag",)).collect()}
    assert got["a"].n_words == 1_800_000 and got["a"].n_repeat_words == 0 and got["b"].doc_id == 2


def test_edge_rows(spark):
    prose = "the end of it and that is for on with as was be by this are from at or an other word here " * 1
    rows = [(1, None, None), (2, "", "en"), (None, prose * 9, "xx"), (3, "@@ ~~ `` ^^ {} " * 500, "en"), (4, " ".join(f"w{k} the" for k in range(400)), "en"), (4, " ".join(f"w{k} the" for k in range(400)), "en")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, n_words int, kept boolean")
    got = dv.judge_quality(df).collect()
    assert len(got) == 6 and [r.kept for r in got if r.doc_id in (1, 2, 3)] == [False] * 3
    assert dv.judge_quality(df.limit(0)).count() == 0


def prose(lang, n, other, every=4):
    """n words, every fourth one a common word of the language."""
    common = dv.COMMON_WORDS[lang].split()
    return " ".join(common[(k * 7 // every) % len(common)] if k % every == 0 else f"{other}{k}" for k in range(n))


def test_texts_without_common_words(spark):
    rows = [(lang, 1, prose(lang, 300, f"w{k}x")) for lang in dv.COMMON_WORDS for k in range(20)]
    rows += [(lang, 0, " ".join(f"v{k}x" for k in range(n))) for lang in dv.COMMON_WORDS for n in (60, 100, 1000)]
    rows += [("en", 1, prose("en", 150, "w") + " " + prose("de", 150, "x")), (None, 1, prose("en", 300, "w")), (None, 0, " ".join(f"u{k}y" for k in range(300)))]
    rows += [("xx", 1, " ".join(f"z{j}q{k}" for k in range(300))) for j in range(3)]  # a language without these words
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, good int, text string")
    kept = {r.doc_id: r.kept for r in dv.judge_quality(df).collect()}
    assert [(k, r[1]) for k, r in enumerate(rows) if kept[k] != bool(r[1])] == []


def test_labelled_junk_is_rejected(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op6_divergence_rules(spark, sf).collect() if r.n_words >= 100 and not r.base_failed]
    assert [r.doc_id for r in rows if r.doc_id in labels and r.kept != (labels[r.doc_id] == 1)] == []


def test_every_language_has_its_own_reference(spark):
    """Rare languages are judged as they would be alone, however many languages there are."""
    rare = [(f"r{k:03}", " ".join(f"слово{j}к{k}" for j in range(120))) for k in range(30)]
    many = [(f"m{k:03}", prose("en", 120, f"w{j}")) for k in range(dv.LANGS + 6) for j in range(2)]
    rows = [*enumerate([*rare, *many, ("en", prose("en", 300, "w")), (None, prose("en", 300, "w"))])]
    df = spark.createDataFrame([(k, *r) for k, r in rows], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in dv.judge_quality(df).collect()}
    assert len(got) == len(rows) and [(k, x) for k, (x, _) in rows if x and not got[k].kept] == []
    count = [dv.document_counts(t)[5:] for _, (_, t) in rows]
    for k, (lang, _) in rows:
        classes, common = (sum(c[i] for c, (_, (x, _)) in zip(count, rows) if lang is None or x == lang) for i in (0, 1))
        assert abs(got[k].char_distance - dv.js_distance(count[k][0][None], classes[None])[0]) < 1e-5
        assert abs(got[k].word_distance - dv.js_distance(count[k][1][None], common[None])[0]) < 1e-5
