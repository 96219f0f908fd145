"""Near-duplicate grouping by MinHash with tensored banding (operator 5).

A document's set is its distinct 5-word shingles; documents with Jaccard
similarity of at least 75 % are linked, and a group keeps its smallest doc_id.

1. Equal sets - equal size and equal 128-bit BLAKE2 digests of the whole sorted
   set - collapse into one representative (the smallest doc_id).
2. Two collections of SIDE keys are computed, each key joining four minhashes;
   the SIDE*SIDE tables of the search are the pairs (left key, right key), so
   576 tables of eight minhashes each cost 192 minhashes instead of 4608.  A pair
   at exactly 75 % is missed only if a whole side fails: 2*(1-0.75**4)**24, two
   in 10,000; at 80 % one in 100,000, at 85 % one in 10**7.  Keys that no other representative of
   like size has are dropped before the pairs of keys are formed.
3. Buckets of up to BUCKET members compare their members with each other.
   Larger ones (groups of copies, shared passages) compare every member only
   with the bucket's most central member, its leader.
4. The exact way for the rest of a large bucket (its family).  Shingles outside
   of the leader l are common if more than BUCKET members have them, else rare.
   Linked x and y share at least 3/7(|x|+|y|) shingles, of which at most
   min(|x&l|, |y&l|) lie in l and min(common of x, common of y) are common.
   Pairs are found by joining on (family, rare shingle) and counting, and, for
   members that reach the bound without rare shingles, by joining on (family,
   size).  Before that up to ROUNDS more leaders gather members: pairs that have
   a leader in common need no comparison, as their group is one already.
5. Candidates are confirmed on their full sets; components follow from links.

Defined cases: null or blank text has the empty set and links with nothing;
repeated rows and rows that share an id are one document of each of their texts.
A row without an id takes part like any other, named by a hash of its text: its
component is the smallest doc_id reachable, and it is not kept; where a whole
group has no id, its component is null and one row of it is kept.  An empty table
gives an empty table.  A text's set is held whole, 8 bytes for each shingle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import arrow_map, hot_join, mix64, staged, texts, tune, unstaged
from .components import connected_components
from .urls import bloom_rows, possible_hits

WORDS = 5
SIDE = 24  # keys in each of the two collections
EACH = 4  # minhashes in a key
BUCKET = 32  # members that a bucket may compare with each other
WORD_CACHE = 200_000  # word hashes that a worker remembers
FILTER_WORDS = 1 << 18  # 64-bit words of the filter of candidates' doc_ids
ROUNDS = 3  # leaders that a large bucket gets besides its first

_rng = np.random.default_rng(20240229)
_PLACES = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64)
_HASHES = _rng.integers(1, 1 << 63, 2 * SIDE * EACH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEYED = _rng.integers(1, 1 << 63, 2 * SIDE, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


_words = _Words()


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's 5-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < WORDS:
        return mix64((w * _PLACES[:n]).sum(keepdims=True) + _SHORT[n])
    h = w[: n - WORDS + 1] * _PLACES[0]
    for k in range(1, WORDS):
        h += w[k : n - WORDS + 1 + k] * _PLACES[k]
    return np.unique(mix64(h))


def collection_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2*SIDE) keys: columns below SIDE are the left collection, the others the right one."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    least = np.empty((len(_HASHES), len(sets)), np.uint64)
    scratch = np.empty_like(flat)
    for k, a in enumerate(_HASHES):
        np.multiply(flat, a, out=scratch)
        least[k] = np.minimum.reduceat(scratch, starts)
    keys = np.zeros((2 * SIDE, len(sets)), np.uint64) + _KEYED[:, None]
    for e in range(EACH):
        keys = mix64(keys ^ least[e::EACH])
    return keys.T


def _signatures(batch: pa.RecordBatch) -> pa.RecordBatch:
    """key, text and any other columns -> the others, n, one, two, keys."""
    sets = [shingle_set(t) for t in texts(batch.column(1))]
    sizes = np.array(list(map(len, sets)))
    full = [s for s in sets if len(s)]
    keys = collection_keys(full) if full else np.zeros((0, 2 * SIDE), np.uint64)
    digests = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
    cuts = np.where(sizes > 0, 2 * SIDE, 0)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cuts)]), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
    names = [x for x in batch.schema.names if x != "text"]
    return pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(sizes, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists], names=[*names, "n", "one", "two", "keys"])


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingle_set(t) for t in texts(batch.column(1))]
    cuts = np.cumsum([0, *map(len, sets)])
    values = pa.array(np.concatenate(sets).view(np.int64))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)], names=["rep", "shingles"])


def _pairs_within(members: DataFrame, key: list[str], member: Column) -> DataFrame:
    """Pairs (p, q) of members (structs that start with the id) of each key; groups must be small."""
    lists = members.groupBy(*key).agg(F.array_sort(F.collect_list(member)).alias("m"))
    first = lists.select(*key, F.posexplode("m").alias("i", "p"), "m")
    return first.select(*key, "p", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("q"))


def _pairs_with(members: DataFrame, key: list[str], member: Column) -> DataFrame:
    """Pairs (p, q) of each key with p a member that is `able` (its struct starts with that) and q any other; groups must be small."""
    lists = members.groupBy(*key).agg(F.collect_list(member).alias("m")).where("exists(m, y -> y.able)")
    first = lists.select(*key, F.explode(F.filter("m", lambda y: y["able"])).alias("p"), "m")
    return first.select(*key, "p", F.explode(F.expr("filter(m, y -> y.x <> p.x)")).alias("q"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with both sets: columns n_a, n_b, inter."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select(*pairs.columns, F.size("sa").alias("n_a"), F.size("sb").alias("n_b"), F.size(F.array_intersect("sa", "sb")).alias("inter"))


#: 100 * inter >= 75 * union, in whole numbers
_LINKED = "100 * inter >= 75 * (n_a + n_b - inter)"


#: a member that can be linked without rare shingles
_INSIDE = "7 * (inter + common) >= 3 * (n_a + least_n)"


def _star(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (x, n_a, leader, more) with inter, the shingles each shares with its leader, and whether they are linked."""
    right = sets.select(F.col("rep").alias("leader"), F.col("shingles").alias("sl"))
    left = sets.select(F.col("rep").alias("x"), F.col("shingles").alias("sx"))
    both = hot_join(members, right, "leader", "x").join(left, "x")
    out = both.select(*members.columns, F.size("sl").alias("n_b"), F.size(F.array_intersect("sx", "sl")).alias("inter"))
    return out.withColumn("linked", F.expr(_LINKED))


def _family_links(families: DataFrame, sets: DataFrame) -> DataFrame:
    """families (family, x, n_a) -> links (a, b): steps 3 and 4 for large buckets, a family being named by its leader."""
    n = families.count()
    stars = staged(_star(families.where("x <> family").withColumn("leader", F.col("family")), sets), "stars", n, 2_000)
    links = stars.where("linked").select(F.col("x").alias("a"), F.col("leader").alias("b"))
    troubled = stars.groupBy("family").agg(F.max(~F.col("linked")).alias("some"), F.min("n_a").alias("least_n")).where("some").select("family", "least_n")
    members = hot_join(stars, troubled, "family", "x").select("family", "x", "n_a", "inter", "linked", "least_n")
    left = sets.select(F.col("rep").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("rep").alias("family"), F.col("shingles").alias("sl"))
    # shingles outside of the leader, in order; whoever can be linked shares at least `must` of them with someone,
    # hence one of the first size - must + 1 of both
    must = F.greatest(F.lit(1), F.ceil(3 * (F.col("n_a") + F.greatest("least_n", F.ceil(0.75 * F.col("n_a")))) / 7 - 1e-9) - F.col("inter"))
    outside = hot_join(members, right, "family", "x").join(left, "x").select("family", "x", must.alias("must"), F.array_sort(F.array_except("sx", "sl")).alias("rest"))
    outside = staged(outside, "outside", n, 2_000)
    first = outside.where("size(rest) >= must").select("family", "x", F.explode(F.expr("slice(rest, 1, cast(size(rest) - must + 1 AS int))")).alias("shingle"))
    met = first.groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("family", "shingle")
    hopeful = first.join(met, ["family", "shingle"]).select("family", "x").distinct()
    rest = outside.join(hopeful, ["family", "x"]).select("family", "x", F.explode("rest").alias("shingle"))
    # those that more than BUCKET members have count as the leader's from here on
    rest = staged(rest, "rest", 50 * n)
    groups = rest.groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = staged(rest.join(groups, ["family", "shingle"]), "shared_rest", 50 * n)
    tallies = shared.groupBy("family", "x").agg(F.count_if(F.col("size") > BUCKET).alias("common"), F.count_if(F.col("size") <= BUCKET).alias("rare"))
    members = members.join(tallies, ["family", "x"], "left").na.fill(0, ["common", "rare"])
    least = F.greatest("least_n", F.ceil(0.75 * F.col("n_a"))).alias("least_n")
    members = staged(members.select("family", "x", "n_a", "inter", "common", "rare", least, F.when(F.col("linked"), F.col("family")).alias("label")), "members", n)
    for k in range(ROUNDS):
        # the next head: at first whoever is nearest to what the family has in common, then whoever is left and lies inside of it
        choice = members if k == 0 else members.where(_INSIDE).where("label IS NULL")
        heads = choice.groupBy("family").agg(F.max(F.struct(F.col("inter") + F.col("common"), "x")).alias("best")).select("family", F.col("best.x").alias("leader"))
        tried = staged(_star((members if k == 0 else members.where(_INSIDE)).where("label IS NULL").join(heads, "family").where("x <> leader").select("family", "x", "n_a", "leader"), sets), "stars", n, 2_000)
        links = links.union(tried.where("linked").select(F.col("x").alias("a"), F.col("leader").alias("b")))
        named = heads.join(members.select("family", F.col("x").alias("leader"), "label"), ["family", "leader"]).select("family", "leader", F.coalesce("label", "leader").alias("new"))
        won = tried.where("linked").join(named, ["family", "leader"]).select("family", "x", "new").union(named.select("family", "leader", "new"))
        members = staged(members.join(won, ["family", "x"], "left").withColumn("label", F.coalesce("label", "new")).drop("new"), "members", n)
        if members.where(_INSIDE).where("label IS NULL").isEmpty():
            break
    # members of the first leader's group have all the links they need, unless one from outside finds them
    able = members.where("7 * (inter + common + rare) >= 3 * (n_a + least_n) AND NOT label <=> family")
    small = shared.where(f"size <= {BUCKET}").join(members.select("family", "x", "n_a", "inter", "common", "label"), ["family", "x"])
    small = small.join(able.select("family", "x", F.lit(True).alias("able")), ["family", "x"], "left").withColumn("able", F.coalesce("able", F.lit(False)))
    rested = _pairs_with(small, ["family", "shingle"], F.struct("able", "x", "n_a", "inter", "common", "label")).where("NOT coalesce(p.label = q.label, false)")
    rested = rested.groupBy("family", "p", "q").agg(F.count(F.lit(1)).alias("shared"))
    rested = rested.where("7 * (shared + least(p.inter, q.inter) + least(p.common, q.common)) >= 3 * (p.n_a + q.n_a)").select(F.col("p.x").alias("a"), F.col("q.x").alias("b"))
    sizes = F.explode(F.expr("sequence(cast(least_n AS int), cast(floor(7 * (inter + common) / 3) - n_a AS int))")).alias("n_a")
    lone = able.where(_INSIDE).select("family", F.col("x").alias("a"), F.col("n_a").alias("n_x"), F.col("inter").alias("inter_x"), F.col("common").alias("common_x"), F.col("label").alias("label_x"), sizes)
    short = lone.join(members.select("family", "n_a", F.col("x").alias("b"), "inter", "common", "label"), ["family", "n_a"])
    short = short.where("a <> b AND NOT coalesce(label_x = label, false) AND 7 * (least(inter, inter_x) + least(common, common_x)) >= 3 * (n_x + n_a)").select("a", "b")
    pairs = rested.union(short).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links.union(_compared(staged(pairs, "rest_pairs", 10 * n), sets).where(_LINKED).select("a", "b"))


def near_duplicate_links(docs: DataFrame, signatures: DataFrame, exact: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Confirmed links (a, b) between representatives of different sets; adds the staged tables it reads to made."""
    reps = signatures.join(exact.select(F.col("rep").alias("key"), "one", "two", "n"), ["key", "one", "two", "n"]).dropDuplicates(["key", "one", "two"])
    sided = reps.select(F.col("key").alias("rep"), F.col("n").alias("n_rep"), F.posexplode("keys").alias("side", "key"))
    counts = sided.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # sizes of linked sets differ by a third at most: each representative stands in two size classes, linked ones share one
    size_class = F.floor(F.log(F.col("n_rep").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9)
    shared = sided.join(counts, "key").select("rep", "n_rep", "side", F.explode(F.array(size_class, size_class + 1)).alias("class"), "key", "n")
    classed = shared.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n_class")).where("n_class > 1")
    shared = shared.join(classed, ["key", "class"])
    left, right = F.collect_list(F.when(F.col("side") < SIDE, F.col("key"))), F.collect_list(F.when(F.col("side") >= SIDE, F.col("key")))
    sides = shared.groupBy("rep", "n_rep", "class").agg(left.alias("l"), right.alias("r"), F.round(F.sum(F.log2("n")), 6).alias("central"))
    tables = sides.select("rep", "n_rep", "class", "central", F.explode("l").alias("kl"), "r").select("rep", "n_rep", "class", "central", "kl", F.explode("r").alias("kr")).select("rep", "n_rep", "central", F.xxhash64("class", "kl", "kr").alias("k"))
    tables = staged(tables, "tables")
    buckets = tables.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("central", F.col("rep").alias("head"))).alias("best")).where("size > 1")
    placed = staged(tables.join(buckets.select("k", "size", F.col("best.head").alias("family")), "k").select("k", "size", "family", "rep", "n_rep"), "buckets")
    unstaged(tables)
    pairs = _pairs_within(placed.where(f"size <= {BUCKET}"), ["k"], F.struct("rep", "n_rep")).where("4 * least(p.n_rep, q.n_rep) >= 3 * greatest(p.n_rep, q.n_rep)")
    pairs = staged(pairs.select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b")).where("a <> b").distinct(), "pairs")
    families = staged(placed.where(f"size > {BUCKET}").select("family", F.col("rep").alias("x"), F.col("n_rep").alias("n_a")).distinct(), "families")
    unstaged(placed)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).union(families.select("x")).distinct()
    # a Bloom filter of fixed size keeps the texts of other documents out of the shuffle; the join decides
    near = possible_hits(docs.select("key", "text", F.col("key").alias("canonical")), bloom_rows(wanted.select(F.col("key").alias("canonical")), FILTER_WORDS), FILTER_WORDS)
    near = near.where("maybe_listed").select("key", "text").join(wanted, "key")
    sets = staged(arrow_map(near.select("key", "text"), _sets, "rep long, shingles array<long>"), "sets")
    made += [pairs, families, sets]
    links = _compared(pairs, sets).where(_LINKED).select("a", "b")
    if families.isEmpty():
        return links
    members = families.select(F.col("x").alias("rep")).distinct()
    made.append(staged(sets.join(members, "rep", "left_semi"), "family_sets"))
    return links.union(_family_links(families, made[-1]))


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text), and the columns to carry."""
    tune(docs.sparkSession)
    name = F.col("doc_id").cast("long")
    docs = docs.select(F.coalesce(name, F.xxhash64(F.lit(5), "text")).alias("key"), "text", name.alias("doc_id"), *carry)
    kept_fields = [f for f in docs.schema.fields if f.name != "text"]
    found = StructType([*kept_fields, *(StructField(x, LongType()) for x in ("n", "one", "two")), StructField("keys", ArrayType(LongType()))])
    signatures = staged(arrow_map(docs, _signatures, found).withColumn("row", F.monotonically_increasing_id()), "signatures")
    exact = signatures.where("n > 0").groupBy("one", "two", "n").agg(F.min("key").alias("rep"), F.min("doc_id").alias("least"), F.min("row").alias("first"))
    exact = staged(exact, "exact")
    made: list[DataFrame] = []
    component = connected_components(near_duplicate_links(docs, signatures, exact, made))
    unstaged(*made)
    classes = exact.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("one", "two", "n", "least", "first", F.coalesce("component", "rep").alias("class"))
    if exact.where("rep <> least OR least IS NULL").isEmpty():  # every name is an id
        classes = classes.select("one", "two", "n", F.col("class").alias("component_id"), F.lit(None).cast("long").alias("first"))
    else:
        tops = classes.groupBy("class").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
        classes = classes.drop("least", "first").join(tops, "class").drop("class")
    classes = staged(classes, "classes")
    rows = signatures.select("doc_id", *carry, "n", "one", "two", "row")
    linked = hot_join(rows.where("n > 0"), classes, ["one", "two", "n"], "row")
    out = linked.select("doc_id", *carry, F.col("n").alias("n_shingles"), "component_id", F.when(F.col("component_id").isNull(), F.col("row") == F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
    return out.unionByName(rows.where("n = 0").select("doc_id", *carry, F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
