"""The pipeline against a brute-force version of each stage on its own input."""

import zlib

import brute
import corpus_pipeline as cp
import pytest
from compare import DATA
from helmsight.llm.queries import table, tokenizer_path

SF = f"{DATA}/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    import sentencepiece

    docs = table(spark, SF, "documents")
    columns, rest = docs.columns, docs
    want = []
    for name, stage in cp.STAGES:
        got = stage(spark, rest, SF)
        before = pairs(rest)
        if name == "toxicity":
            toxic = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
            m = brute.noisy_or_fit([(t, toxic[i]) for i, t in before if i in toxic])
            want = [i for i, t in before if brute.noisy_or_score(m, t)[0] < 0.3]
        elif name == "exact dedup":
            want = [i for i, (keep, _) in brute.exact(before).items() if keep == i]
        elif name == "MinHash near-dedup":
            want = [i for i, (_, c) in brute.near(before, 5, 0.8).items() if c == i]
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            want = [i for i, (_, hits, _) in brute.contaminated(before, items).items() if not hits]
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
            assert {r.doc_id: r.ids for r in got.collect()} == {i: sp.encode(t or "") for i, t in before}
            break
        assert got.columns == columns
        assert sorted(r.doc_id for r in got.collect()) == sorted(want)
        assert len(want) < len(before)
        rest = cp.written(got, "test")
    assert sorted(r.doc_id for r in cp.run(spark, SF).collect()) == sorted(want)


def test_odd_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", None, None, 11)], table(spark, SF, "documents").schema)
    for start in (docs, docs.limit(0)):
        rest = start
        for _, stage in cp.STAGES:
            rest = cp.written(stage(spark, rest, SF), "test")
        assert sorted(str(r.doc_id) for r in rest.collect()) == (["1", "None", "None"] if start is docs else [])


def test_rows_that_share_ids(spark):
    """Clean rows stay whatever other rows share their id; of copies one stays, repeated and nameless ones too."""
    schema = table(spark, SF, "documents").schema
    word = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    a, b, c, d = (word(x) for x in "abcd")
    near = a + " end"
    leak = next(r.text for r in table(spark, SF, "benchmark").collect() if len((r.text or "").split()) > 12)
    docs = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    after = lambda stage, rows: sorted(pairs(cp.written(stage(spark, docs(rows), SF), "test")), key=str)

    exact = [(3, a), (7, a), (7, b), (8, c), (8, c), (8, c.replace(" ", "  ")), (None, d), (None, d), (None, a), (9, d + " x"), (None, None), (None, "")]
    got = after(cp.drop_exact_copies, exact)
    want = [(3, a), (7, b), (9, d + " x"), (None, None), (None, ""), (None, d)]
    assert sorted(((i, t) for i, t in got if i != 8), key=str) == sorted(want, key=str)
    assert [(i, t and t.replace("  ", " ")) for i, t in got if i == 8] == [(8, c)]

    assert after(cp.drop_near_copies, [(3, a), (7, near), (7, b), (None, b + " end"), (None, c)]) == sorted([(3, a), (7, b), (None, c)], key=str)
    assert after(cp.drop_contaminated, [(7, leak), (7, b), (None, leak), (None, c)]) == sorted([(7, b), (None, c)], key=str)


@pytest.mark.parametrize("copies", [3, 400])
def test_texts_stay_where_little_is_dropped(spark, copies):
    """What is dropped is joined by its own size: little of it moves no text, much of it is not broadcast."""
    words = lambda i, n: " ".join(f"{i}w{k}" for k in range(n))
    leak = next(r.text for r in table(spark, SF, "benchmark").collect() if len((r.text or "").split()) > 12)
    base = [(i, words(i, 60), "en", "s", 0) for i in range(500)]
    changed = {
        cp.drop_exact_copies: lambda i: words(i, 60).replace(" ", "  "),
        cp.drop_near_copies: lambda i: words(i, 61),
        cp.drop_contaminated: lambda i: f"{words(i, 20)} {leak}",
    }
    for stage, text in changed.items():
        rows = base + [(1000 + i, text(i), "en", "s", 0) for i in range(copies)]
        docs = cp.written(spark.createDataFrame(rows, table(spark, SF, "documents").schema).repartition(2), "test")
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "9500b" if copies == 3 else "2500b")
        try:
            got = stage(spark, docs, SF)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("Exchange hashpartitioning" in plan) == (copies != 3), plan
            assert ("BroadcastHashJoin" in plan) == (copies == 3), plan
            assert sorted(pairs(got)) == sorted((i, t) for i, t, *_ in base)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
