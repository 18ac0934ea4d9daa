"""The prefix trie, spelling variants and near vectors against brute force, with edge tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import DATA, connect, same
from helmsight.llm import embedding_dedup, queries as llm, spelling
from helmsight.llm.embedding_dedup import Plan, near_vectors
from helmsight.llm.prefix_trie import Louds, numbered, prefix_trie
from helmsight.llm.spelling import contract_noise, misspelt, near_pairs, pieces, spelling_variants, word_counts

SF = f"{DATA}/sf0.001"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_spelling", "op13_embedding_dedup"])
def test_against_sql(spark, name):
    same(llm.queries()[name](spark, SF), connect(SF), llm.oracle_sql()[name])


# ---------------------------------------------------------------------------------- trie


def brute_trie(convs):
    """convs: {id: [(role, text)]}. Rows as `prefix_trie` gives them."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(kids[q] == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def spark_trie(spark, convs, **settings):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    turns = numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), slices=settings.get("slices"))
    lengths = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv long, length long")
    return sorted(tuple(r) for r in prefix_trie(turns, lengths, **settings).select(TRIE).collect())


def hot_conversations():
    """A first turn that most share, equal conversations, a long one, ends inside others, turnless ones."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abé"), 2))
    convs = {c: [("user", "hot"), *(("user" if i % 2 else "assistant", word()) for i in range(rng.integers(0, 6)))] for c in range(60)}
    convs |= {c: [("user", "other"), ("user", "x" * (c % 3))] for c in range(60, 80)} | {c: [] for c in (80, 81, 1000)}
    long = [("user", str(i % 7)) for i in range(150)]
    return convs | {90: long, 91: long, 92: [*long[:140], ("user", "end")]}


@pytest.mark.parametrize("shard_rows, slices", [(1_000_000, 1), (40, 1), (0, 5), (300, 9)])
def test_trie(spark, shard_rows, slices):
    """All in shards, all merged apart, and both; long conversations in slices."""
    convs = hot_conversations()
    assert spark_trie(spark, convs, shard_rows=shard_rows, slices=slices) == brute_trie(convs)


def test_small_tries(spark):
    assert spark_trie(spark, {}) == []
    for convs in ({5: []}, {5: [("user", "a")]}, {5: [], 6: []}, {5: [("", "")], 6: [("", ""), ("", "")]}, {7: [("u", "a\0b")], 8: [("u", "a"), ("", "b")]}):
        assert spark_trie(spark, convs, shard_rows=0) == spark_trie(spark, convs) == brute_trie(convs)


def test_turns_are_ordered_nulls_first_and_rebuilt(spark, tmp_path):
    """Null turns, roles and texts, ties, repeated rows, null ids, extra columns, a base that is absent."""
    rows = [(10, 2, "user", "c", 0), (10, None, None, None, 0), (10, 1, "user", "b", 0), (10, 1, "user", "b", 0), (None, 1, "user", "x", 0), (None, None, None, None, 0)]
    rows += [(12, t, "user", f"own {t}", 0) for t in range(12)] + [(18, t, "user", f"own {t}", 0) for t in range(12)] + [(19, 0, "a", "z", 0), (11, 0, "a", "z", 0)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    said = defaultdict(list)
    for c, t, r, x, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, hashlib.md5((r[2] or "").encode()).hexdigest(), hashlib.md5((r[3] or "").encode()).hexdigest())):
        said[c].append((r or "", x or ""))
    convs = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = said.get(c - c % 5, [])[:h] + own[h:]
    assert any(not t for t in convs.values()) or len(convs) == 5
    got = llm.op11_prefix_trie(spark, str(tmp_path)).select(TRIE).collect()
    assert sorted(map(tuple, got)) == brute_trie(convs)


@given(st.lists(st.integers(0, 30), max_size=40))
@settings(max_examples=60, deadline=None)
def test_louds(parents):
    """Any forest: parents, children and sums are those of the tree that was laid out."""
    up = [p if p < i else -1 for i, p in enumerate(parents)]
    key = np.array([f"{i}".encode() for i in range(len(up))], object)
    parent = np.array([f"{p}".encode() if p >= 0 else b"outside" for p in up], object)
    t = Louds(np.zeros(len(up)), key, parent)
    place = {int(row): i for i, row in enumerate(t.order)}
    assert sorted(place) == list(range(len(up))) and t.bits.sum() == len(up) and (~t.bits).sum() == len(up) + 1
    assert [t.parents()[place[i]] for i in range(len(up))] == [place[p] if p >= 0 else -1 for p in up]
    for i in range(len(up)):
        assert sorted(int(t.order[k]) for k in t.children(place[i] + 1)) == [j for j, p in enumerate(up) if p == i]
    want = [1] * len(up)
    for i in reversed(range(len(up))):
        if up[i] >= 0:
            want[up[i]] += want[i]
    assert t.rolled_up(np.ones(len(up), np.int64)).tolist() == want


# ---------------------------------------------------------------------------------- words


def near(a, b):
    """Whether one code point makes the difference."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    close = {w: [v for v in words if v != w and near(w, v)] for w in words}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n, len(close[w]), words.get(form[w])) for w, n in words.items())


def collected(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants(spark):
    """Words over few letters, which have many near ones, repeated bigrams and ties; chains of forms; one hot ending."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(500)} | {"aaaaaa", "aaaaaaa", "ababababab", "abababababa", "babababab"}
    words |= {f"{''.join(rng.choice(list('abcdefgh'), 5))}ingly" for _ in range(300)}
    counts = {w: int(rng.choice([3, 5, 6, 25, 30, 150, 800])) for w in words} | {"colour": 900, "color": 5000, "colouur": 90, "coluur": 9, "tie one": 50}
    got = collected(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)))
    assert got == brute_variants(counts)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_near_pairs_lose_none_to_the_prefix(spark):
    """All words at distance one of some words, whatever is edited."""
    bases = ["abcabcab", "zzzzzz", "aabbaabb", "théâtre"]
    words = set(bases)
    for w in bases:
        words |= {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for c in "azé" for i in range(len(w) + 1)} | {w[:i] + c + w[i + 1 :] for c in "azé" for i in range(len(w))}
    words = {w for w in words if len(w) >= 4}
    got = {(r.a, r.b) for r in near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and near(a, b)}


def test_word_counts(spark, monkeypatch):
    """Null, empty and very long texts, repeated rows, null ids, extra columns; noise once a distinct run."""
    long = " ".join(["lettersWITHOUTend", "Éa×b÷c", "a1b"] * 200)
    rows = [(1, long, "x"), (1, long, "x"), (None, "Some words, some Words", "x"), (2, None, "x"), (3, "", "x"), *((i, "paragraph paragraph other", "x") for i in range(4, 700))]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    plain, noisy = Counter(), Counter()
    for key, text, _ in rows:
        for run in spelling.RUN.findall((text or "").translate({i: i + 32 for i in range(65, 91)})):
            plain[run] += 1
            noisy[misspelt(key, run)] += 1
    assert {r.word: r.n for r in word_counts(df).collect()} == plain
    assert {r.word: r.n for r in word_counts(df, noise=contract_noise()).collect() if r.word} == {w: n for w, n in noisy.items() if w}
    assert noisy != plain
    assert "".join(pieces(long, 7)) == long and Counter(w for p in pieces(long, 7) for w in spelling.RUN.findall(p)) == Counter(spelling.RUN.findall(long))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert collected(spelling_variants(word_counts(empty))) == []


# ---------------------------------------------------------------------------------- vectors


def brute_vectors(rows, threshold=0.93):
    """rows: (id, vector, label). (n_links, component) by id, for ids that occur once."""
    ok = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    by_label = defaultdict(list)
    for i, v, label in ok:
        by_label[label, len(v)].append((i, v / np.linalg.norm(v)))
    for group in by_label.values():
        ids, units = [i for i, _ in group], np.array([u for _, u in group])
        for a, b in zip(*np.nonzero(units @ units.T >= threshold), strict=True):
            if ids[a] != ids[b]:
                links[ids[a]].add(ids[b])
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen) if i is not None else None)
    return out


def at_cosine(rng, base, cosine):
    """A vector of another length at this cosine to base."""
    base = base / np.linalg.norm(base)
    side = rng.standard_normal(len(base))
    side -= side @ base * base
    return (cosine * base + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)) * rng.uniform(0.5, 2)


def planted(n=1500, dim=64):
    rng = np.random.default_rng(3)
    rows = [(int(rng.standard_normal(dim) is None) + i, rng.standard_normal(dim), i % 3) for i in range(n)]
    made = n
    for i in range(0, 400):  # pairs around the threshold, just above it and far above
        for cosine in (0.9301, 0.94, 0.96, 0.9299):
            rows.append((made, at_cosine(rng, rows[i][1], cosine), rows[i][2] if cosine != 0.96 or i % 2 else 99))
            made += 1
    hub = rng.standard_normal(dim)
    for i in range(900):  # a hot group: copies, close ones, and some that only some of the others are linked with
        rows.append((made, hub if i % 9 == 0 else at_cosine(rng, hub, 0.999 if i % 3 else 0.97), 1))
        made += 1
    return [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(6)


@pytest.mark.parametrize("cell_rows, block_rows", [(4096, 4096), (60, 150)])
def test_recall_and_precision(spark, cell_rows, block_rows):
    """One cell for all, and deep cells whose hot ones go in pairs of blocks: links as by brute force, none twice."""
    rows = planted()
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(vectors(spark, rows), cell_rows=cell_rows, block_rows=block_rows).collect()}
    want = brute_vectors(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.998 * sum(n for n, _ in want.values())
    singles = [i for i in want if want[i][0] and want[i][1] < 400 and i < 3100]
    assert sum(got[i] == want[i] for i in singles) >= 0.99 * len(singles)
    assert all(got[i][1] == want[i][1] for i in range(3100, 4000))


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (9, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (6, [1.0, 0.0], None), (7, None, 1), (8, [], 1), (10, [0.0, -0.0], 1), (11, [1.0, None], 1),
        (12, [nan, 1.0], 1), (13, [inf, 1.0], 1), (None, [1.0, 0.0], 1), (14, [1.0, 0.0, 0.0], 1), (15, [1e-30, 0.0], 1), (16, [1e300, 1e299], 1), (17, [-0.0, 1.0], 3), (18, [0.0, 1.0], 3),
    ]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(vectors(spark, rows, "double").withColumnsRenamed({})).collect()}
    linked = {3: (4, 3, True), 5: (4, 3, False), 9: (4, 3, False), 15: (4, 3, False), 16: (4, 3, False), 17: (1, 17, True), 18: (1, 17, False)}
    assert got == {i: linked.get(i, (0, i, True)) for i, _, _ in rows}
    assert near_vectors(vectors(spark, [])).count() == 0


def test_repeated_rows_and_ids(spark):
    """A repeated row is one vector; an id with two vectors ties what they are linked with."""
    rows = [(1, [1.0, 0.0], 1)] * 3 + [(2, [1.0, 0.1], 1), (2, [0.0, 1.0], 1), (7, [0.0, 1.0], 1)]
    df = vectors(spark, rows).selectExpr("*", "'x' AS mark", "0 AS root", "1 AS key")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    assert got == [(1, 1, 1)] * 3 + [(2, 1, 1), (2, 1, 1), (7, 1, 1)]


def test_plans_meet_what_they_promise():
    """Of pairs at the threshold, the share that meets and passes the count, for cells of several depths."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal((4000, 64))
    b = np.array([at_cosine(rng, x, 0.93) for x in a])
    for vectors_ in (100, 100_000, 5_000_000):
        plan = Plan(0.93, vectors_)
        at, bt = (plan.projections(np.rint(embedding_dedup.unit_rows(x) * (1 << 14)).astype(np.int16)) for x in (a, b))
        zeros = np.zeros(len(a), np.uint64)
        lines = [plan.sorted_line(g) for g in range(plan.groups)]
        met = ((plan.cells(at, zeros) == plan.cells(bt, zeros)) & (np.abs(at[:, lines].astype(int) - bt[:, lines]) <= plan.sorted_window)).any(axis=1)
        counted = (np.abs(at[:, : embedding_dedup.COUNTED].astype(int) - bt[:, : embedding_dedup.COUNTED]) <= plan.window).sum(axis=1) >= plan.least
        assert met.mean() > 0.995 and counted.mean() > 0.995
        far = (np.abs(at[:-1, : embedding_dedup.COUNTED].astype(int) - bt[1:, : embedding_dedup.COUNTED]) <= plan.window).sum(axis=1) >= plan.least
        assert far.mean() < 0.01


def test_embeddings_of_the_check_tables_have_planted_links():
    """The tables that SQL is compared on hold no links, which is why the planted ones above decide."""
    t = pq.read_table(f"{SF}/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), t["label"].to_pylist(), strict=True))
    assert all(n == 0 for n, _ in brute_vectors(rows).values())
