import random

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from compare import DATA, connect, same
from helmsight.llm import near_dedup
from helmsight.llm.components import components
from helmsight.llm.exact_dedup import exact_dedup
from helmsight.llm.near_dedup import near_duplicates
from helmsight.llm.queries import oracle_sql, queries

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    same(queries()[name](spark, SF), connect(SF), oracle_sql()[name])


AWKWARD = [
    (5, None, "x"), (4, "", "x"), (3, "a  b\tc", "y"), (2, "a b c", None), (1, "A b c", "y"), (9, " a b c", None), (8, "a\x0b\x0c\r\n b c", "z"), (7, "word " * 50_000, "w"), (6, "word " * 50_000, "w"),
    (10, "é ü", None), (11, "é\u00a0ü", None),
]


def table(spark, rows):
    # extra columns with the names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, _text string").withColumn("id", F.lit("?")).withColumn("set", F.lit(0)).withColumn("_keep", F.lit(1)).withColumn("mark", F.lit(2))


@pytest.mark.parametrize("digest", [lambda t: F.sha2(t, 256), lambda t: F.substring(F.sha2(t, 256), 1, 1), lambda t: F.lit("same")])
def test_exact(spark, digest):
    """Also with digests that collide: texts that share one stay apart."""
    want = brute.exact([r[:2] for r in AWKWARD])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(table(spark, AWKWARD), digest=digest).collect()}
    assert got == want
    assert all(r.kept == (want[r.doc_id][0] == r.doc_id) for r in exact_dedup(table(spark, AWKWARD)).collect())


def test_exact_edges(spark):
    assert exact_dedup(table(spark, [])).count() == 0
    repeated = exact_dedup(table(spark, [(1, "a", ""), (1, "a", ""), (2, "a", ""), (None, "a", ""), (None, "b", "")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in repeated if r.keep_id) == [(0, 1, 4, False), (1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False)]
    assert [r.kept for r in repeated if r.keep_id is None] == [True]


def test_exact_is_native(spark):
    plan = exact_dedup(table(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def copies(seed, n_groups=12, size=8):
    """Groups of texts at various distances from one another, some below the threshold."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(n_groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0, 0.02, 0.05, 0.1, 0.2]))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append(" ".join(w))
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed, n, rows, shingles", [(1, 2, 2048, 10**9), (2, 5, 2048, 10**9), (3, 2, 3, 10**9), (4, 1, 1, 10**9), (5, 2, 2048, 300), (6, 5, 2, 1)])
def test_near(spark, seed, n, rows, shingles, monkeypatch):
    """Low limits make all buckets large, by rows or by shingles."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    docs = copies(seed) + [(1000 + i, t) for i, (_, t, _) in enumerate(AWKWARD)]
    want = brute.near(docs, n, 0.8)
    rows = near_duplicates(table(spark, [(*d, "") for d in docs]), shingle=n, similarity=0.8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_ranks_that_may_reach():
    """The bound by ranks against all pairs of rows of a key: no row that fits with another one is lost, the others go."""
    r = random.Random(3)
    rows = sorted({(r.randrange(6), n := r.randrange(1, 40), r.randrange(1, n + 1)) for _ in range(400)})
    for per_mille in (8000, 5000):
        fits = lambda a, b: (10_000 + per_mille) * min(a[1] - a[2] + 1, b[1] - b[2] + 1) >= per_mille * (a[1] + b[1])
        want = {a for a in rows if any(a[0] == b[0] and fits(a, b) for b in rows)}
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["key", "n", "nth"])
        for most in (1, 50, 10_000):
            got = [tuple(x.values()) for b in near_dedup.may_reach(iter([batch.slice(0, 90), batch.slice(90)]), per_mille, most) for x in b.to_pylist()]
            assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("template, own", [(75, 25), (81, 19), (84, 16), (88, 12), (85, 20)])
def test_template_family(spark, monkeypatch, template, own):
    """Pages of one template stay apart, at similarities from 0.60 to 0.79; those few that are at the threshold are found in the large bucket."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 64)
    r = random.Random(7)
    core = [f"core{i}" for i in range(template)]
    docs = [(i, " ".join(core + [f"own{i}x{j}" for j in range(own + i % 2 if template == 85 else own)])) for i in range(600)]
    for i in range(600, 620):
        near = docs[r.randrange(600)][1].split()
        docs.append((i, " ".join(near[:-3] + [f"other{i}x{j}" for j in range(3)])))
    want = brute.near(docs, 1, 0.8)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(table(spark, [(*d, "") for d in docs]), shingle=1).collect()}
    assert got == want and sum(c != i for i, (_, c) in got.items()) >= 20


def test_near_edges(spark):
    assert near_duplicates(table(spark, [])).count() == 0
    assert near_duplicates(table(spark, [(1, None, ""), (2, "", ""), (3, "  ", "")])).filter("kept").count() == 3
    rows = near_duplicates(table(spark, [(1, "a b c d e f", ""), (1, "a b c d e f", ""), (2, "a b c d e f", ""), (None, "a b c d e f", ""), (3, "q r s t u v", ""), (2, "q r s t u v", "")])).collect()
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows)
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False)]


@pytest.mark.parametrize("union", [200_000, 1_000_000])
def test_near_long_texts(spark, union):
    """Long texts of distinct words at, just above and just below the threshold, and more common shingles than 32-bit products hold."""
    share = union * 4 // 5
    word = lambda k, at, n: " ".join(f"{k}{i}" for i in range(at, at + n))
    docs = []
    for k, common in enumerate((share, share + 1, share - 1)):
        own = union - common
        # with single-word shingles the sets are the words
        docs += [(2 * k, word(f"c{k}x", 0, common) + " " + word(f"a{k}x", 0, own // 2)), (2 * k + 1, word(f"c{k}x", 0, common) + " " + word(f"b{k}x", 0, own - own // 2))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, shingle=1).collect()}
    assert {i: c for i, (_, c) in got.items()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}
    assert got[0][0] == share + (union - share) // 2


def test_near_more_common_shingles_than_fit_an_int(spark):
    words = [f"w{i}" for i in range(320_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-9], "z"]))], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(df, shingle=2).collect()} == {1}


def test_sketch_keeps_what_it_must():
    """Pairs at the threshold pass the sketch, random pairs do not."""
    import numpy as np

    far, rng, lost, passed = near_dedup.most_different(0.8, 200), np.random.default_rng(0), 0, 0
    sets = []
    for _ in range(200):
        union = rng.integers(0, 2**64, 450, dtype=np.uint64)
        sets += [np.unique(union[:405]), np.unique(union[45:])]  # similarity 360 / 450
    o = near_dedup.odd_sketches(near_dedup.min_hashes(sets, 200))
    apart = lambda a, b: int(np.bitwise_count((o[a] ^ o[b]).view(np.uint64)).sum())
    for i in range(0, 400, 2):
        lost += apart(i, i + 1) > far
        passed += apart(i, (i + 2) % 400) <= far
    assert lost == 0 and passed == 0


def test_crossings_keep_sets_whose_upper_halves_collide():
    """A pair exactly at the threshold leaves the task however many hashes agree in their upper halves."""
    import numpy as np
    import pyarrow as pa

    def crossing(a, b):
        sets = [np.array(sorted(s), np.uint64) for s in (a, b)]
        group = pa.table({
            "id": [1, 2], "root": [1, 2], "own": [0, 0], "first": [0, 0], "second": [0, 0], "band": [0, 0], "n": [len(s) for s in sets],
            "sketch": pa.array([[0] * (near_dedup.SKETCH_BITS // 64)] * 2, pa.list_(pa.int64())), "keys": pa.array([[5], [5]], pa.list_(pa.int64())),
            "small": [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets],
        })
        return near_dedup.crossing_pairs(group, 0, 8000)

    hashes = lambda at, n, same: {(i // same << 32) + i % same for i in range(at, at + n)}
    for same in (1, 2, 10):  # so many hashes have one upper half
        shared = hashes(0, 160, same)
        a, b = shared | hashes(1000, 20, 1), shared | hashes(2000, 20, 1)  # 160 of 200
        assert crossing(a, b) == ([0], [1])
    far = hashes(0, 100, 1) | hashes(1000, 50, 1), hashes(0, 100, 1) | hashes(2000, 50, 1)
    assert crossing(*far) == ([], [])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, links):
    root = {x: x for ab in links for x in ab}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_long_chain(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"))
    assert {r.root for r in got.collect()} == {0} and got.count() == 60


def test_writes_leave_the_session_as_it_was(spark):
    """Also when they overlap, whichever ends first."""
    from helmsight.llm import common

    own = spark.conf.get(common._CLEAN_UP, None)
    first, second = common._cleaning_up(spark), common._cleaning_up(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(common._CLEAN_UP) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(common._CLEAN_UP, None) == own
