import hashlib
import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from ctxloom.llm import secrets as sc
from ctxloom.llm.queries import op8_token_efficiency_secrets, secret_vocabulary


def brute(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found.append((0, "assign", m.start(), m.end(), len(m[2]) >= 6))
    found += [(1, "access", m.start(), m.end(), len(m[0]) >= 20) for m in re.finditer("AKIA[A-Z0-9]+", text)]
    found += [(2, "hex", m.start(), m.end(), len(m[0]) >= 24) for m in re.finditer("[0-9a-f]+", text)]
    return [(k, a, b) for n, k, a, b, ok in sorted(found, key=lambda x: (x[2], x[0])) if ok]


@given(st.lists(st.sampled_from(["Token", "secret", "api_key", "APIKEY", ":", "=", " ", '"', "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef0123456789", "é", "\n", "x", "paſsword"]), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert sc.base_spans(text) == brute(text)


def test_random_strings_and_known_shapes():
    v = secret_vocabulary()
    find = lambda t: [t[a:b] for k, a, b in sc.all_spans(t, v)[1] if k == "random"]
    assert find("use xK9fQ2mZp7LwT4vBn8RcYd3H now") == ["xK9fQ2mZp7LwT4vBn8RcYd3H"]
    for text in ("id 123e4567-e89b-12d3-a456-426614174000", "sum " + hashlib.sha1(b"x").hexdigest().upper(), "max_retry_count_before_failure_2024", "customerOrderHistoryTable2024", "4111111111111111" * 2, "internationalisation" * 2):
        assert find(text) == [], text
    base, every = sc.all_spans("token=" + "xK9fQ2mZp7LwT4vBn8RcYd3H", v)
    assert base == every and len(base) == 1


def test_random_keys_of_any_alphabet():
    v, rng = secret_vocabulary(), random.Random(5)
    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    for alphabet in (low + up, low, up, up + "234567", low + digits, up + digits, low + up + digits, low + up + digits + "+/", low + up + digits + "-_"):
        for n in (20, 32, 47):
            keys = ["".join(rng.choices(alphabet, k=n)) for _ in range(200)]
            exposed = [k for k in keys if n < sc.MAX_CHARS_PER_TOKEN * v.tokens(k)]
            found = [k for k in exposed if sc.random_spans(f"see {k} here", [], v) == [("random", 4, 4 + n)]]
            assert len(exposed) > 170 and len(found) > 0.99 * len(exposed), alphabet
    for text in ("report_2024_11_26_13_45_07", "SQL_ATTR_ODBC_CURSORS_V2", "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384", "/2024/11/26/how-to-do-it-in-10-steps", "a_b_c_d_e_f_g_h_i_j_k_l", "+49-30-1234567-89-12", "en_US-UTF-8_de_DE-UTF-8", hashlib.sha256(b"x").hexdigest().upper()):
        assert len(text) < sc.MAX_CHARS_PER_TOKEN * v.tokens(text) and sc.random_spans(text, [], v) == [], text


def brute_random(text, base, encode):
    """Runs of key characters, by walking over the text, that cost a token for less than two characters and are of no known shape."""
    allowed = set(string.ascii_letters + string.digits + "+/_=-")
    runs, start = [], None
    for k, c in enumerate(text + " "):
        if c in allowed:
            start = k if start is None else start
        elif start is not None:
            runs.append((start, k))
            start = None
    cheap = lambda w: any(len(w) >= 3 * len(encode(x)) for x in (w, w.lower(), " " + w.lower()))
    out = []
    for a, b in runs:
        run = text[a:b]
        if b - a < 20 or any(x < b and a < y for _, x, y in base) or b - a >= 2 * len(encode(run)):
            continue
        digits = run.replace("-", "")
        if len(run) == 36 and [len(x) for x in run.split("-")] == [8, 4, 4, 4, 12] and set(digits.lower()) <= set("0123456789abcdef"):
            continue
        if len(run) in (32, 40, 56, 64, 96, 128) and (set(run) <= set("0123456789abcdef") or set(run) <= set("0123456789ABCDEF")):
            continue
        letters = plain = 0
        for piece in re.split("[^A-Za-z0-9]+", run):
            for word in re.findall("[A-Z]?[a-z]+|[A-Z]+(?![a-z])", piece):
                letters += len(word)
                plain += len(word) * (len(piece) <= 3 or len(word) >= 4 and cheap(word))
        if 2 * plain < letters:
            out.append(("random", a, b))
    return out


def test_planted_keys_and_added_spans_against_brute_force(spark):
    """Keys planted in whole documents: recall, false hits, and the same spans as the walk over the text."""
    v, rng = secret_vocabulary(), random.Random(8)
    encode = lambda t: range(v.tokens(t))
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    planted = hits = other = 0
    for k, text in enumerate(docs[:400]):
        words = text.split(" ")
        key = "".join(rng.choices((string.ascii_letters + string.digits, string.ascii_lowercase, string.ascii_uppercase + "234567")[k % 3], k=rng.randrange(24, 64)))
        at = rng.randrange(len(words) + 1)
        text = " ".join([*words[:at], key, *words[at:]])
        base, every = sc.all_spans(text, v)
        added = [s for s in every if s not in base]
        assert added == brute_random(text, base, encode)
        planted += 1
        hits += any(text[a:b] == key for _, a, b in added)
        other += sum(text[a:b] != key for _, a, b in added)
    assert hits >= 0.9 * planted and other <= 0.01 * planted


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8_token_efficiency_secrets(spark, sf).collect():
        base = brute(docs.pop(r.doc_id))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in sc.KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest() == sc.sha256_of(base)
        assert set(sc.joined(base).split(",")) <= set(r.spans.split(",")) | {""}
    assert not docs


def test_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 0), (None, "é token: abcdefg.", 17), (3, "k " * 50_000 + "password=hunter2222", 9), (3, "a", 1)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, n_chars long, spans string")
    got = sc.secret_digests(sc.find_secrets(df, secret_vocabulary())).collect()
    assert len(got) == 5 and next(r for r in got if r.doc_id is None).spans == "assign:2:17"
    clean = {(r.doc_id, r.text, r.n_chars, r.spans) for r in sc.redact_secrets(df, secret_vocabulary()).collect()}
    assert (None, "é [secret]", 10, "s") in clean and (1, None, 5, "s") in clean and (3, "a", 1, "s") in clean
    assert sc.secret_digests(sc.find_secrets(df.limit(0), secret_vocabulary())).count() == 0
