"""Toxicity, decontamination, language model, token counts, SentencePiece."""

import hashlib
import json
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from compare import DATA
from helmsight.llm import decontaminate, lm_score, queries, sentencepiece_np, token_count, toxicity
from helmsight.llm.queries import table, tokenizer_path

SF = f"{DATA}/sf0.001"
ODD = ["", " ", None, "one", "A b\tC\x0b d", "é ü 日本 ½", "x" * 20_000, "w " * 30_000, "<|endoftext|> </s> <unk> ▁", "a\x00b\x1c c\u00a0d\u3000e", "tail  \n\n  "]


def odd_docs(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "one")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("?")).withColumn("score", F.lit(1)).withColumn("key", F.lit(2))


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ------------------------------------------------------------------------------ toxicity


def test_noisy_or_learns_sentences():
    r = random.Random(3)
    clean, bad = [f"w{i}" for i in range(300)], ["vile", "awful", "scummy"]
    texts, labels = [], []
    for i in range(600):
        s = [" ".join(r.choice(clean) for _ in range(8)) for _ in range(10)]
        labels.append(i % 5 == 0)
        if labels[-1]:
            k = r.randrange(10)
            s[k] += " " + r.choice(bad)
        texts.append(". ".join(s))
    bags = [toxicity.bag(t) for t in texts]
    m = toxicity.fit(pa.array([list(b) for b in bags]), np.array([n for b in bags for n in b.values()]), np.array(labels))
    assert set(sorted(m.hazard, key=m.hazard.get)[-3:]) == set(bad)
    score, found = m.score("Fine words here. You AWFUL thing! Fine again")
    (start, end, p), = [f for f in found if f[2] >= 0.3]
    assert "AWFUL" in "Fine words here. You AWFUL thing! Fine again"[start:end] and score >= p >= 0.3
    assert math.isclose(score, 1 - (1 - m.leak) * math.prod(1 - f[2] for f in found))


def test_toxicity_as_by_hand(spark):
    """Hazards, leak, scores and sentences of the query against a plain version."""
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    toxic = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    by_hand = brute.noisy_or_fit([(t, toxic[i]) for i, t in docs if i in toxic])
    m = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    assert sum(toxic.values()) > 3 and math.isclose(m.leak, by_hand[1], rel_tol=1e-6, abs_tol=1e-12)
    assert all(math.isclose(m.hazard.get(w, 0.0), h, rel_tol=1e-6, abs_tol=1e-12) for w, h in by_hand[0].items())
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, SF).collect()}
    where = {r.doc_id: r.sentences for r in toxicity.toxicity(table(spark, SF, "documents"), m).collect()}
    for i, t in docs:
        score, each = brute.noisy_or_score(by_hand, t)
        assert math.isclose(got[i].score, score, rel_tol=1e-9, abs_tol=1e-9) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].n_offending == len(where[i]) == sum(p >= 0.3 for p in each)


def test_a_word_counts_once_a_sentence():
    m = toxicity.Model({"bad": 0.2}, 0.0)
    once = 1 - math.exp(-0.2)
    assert math.isclose(m.score("bad bad BAD")[0], once) and math.isclose(m.sentence(["bad"] * 3), once)
    assert math.isclose(m.score("bad. bad")[0], 1 - math.exp(-0.4))


def test_training_bounds(spark):
    """Bounds by documents and by bytes; what does not fit is passed over."""
    docs = spark.createDataFrame([(i, "awful thing" if i % 2 else "fine thing") for i in range(40)] + [(99, "awful " * 1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, 1)], "doc_id long, toxic int")
    train = lambda **k: toxicity.train(docs, labels, F.lit(True), **k).hazard
    assert set(train()) == set(train(most_bytes=500)) == {"awful", "thing"} and train(most_bytes=5) == {} and train(most=1) == {}


def test_toxicity_edges(spark):
    m = toxicity.Model({"one": 1.0}, 0.01)
    rows = toxicity.toxicity(odd_docs(spark), m).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        if r.doc_id in (0, 1, 2):
            assert math.isclose(r.score, 0.01) and r.predicted == 0 and r.sentences == []
        if r.doc_id == 3:
            assert r.predicted == 1 and (r.sentences[0].start, r.sentences[0].end) == (0, 3)
    assert toxicity.toxicity(empty_docs(spark), m).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(odd_docs(spark), labels, F.lit(True)).hazard == {}
    assert toxicity.fit(pa.array([], pa.list_(pa.string())), np.array([]), np.array([])).leak == 0.0
    assert toxicity.reject_toxic(empty_docs(spark), m).count() == 0
    kept = toxicity.reject_toxic(odd_docs(spark), m)
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(ODD)


def test_held_out_accuracy(spark):
    """Measured at sf0.1 on rows that were not learned from."""
    d = f"{DATA}/sf0.1"
    r = queries.op1_toxicity(spark, d).join(table(spark, d, "labels"), "doc_id").filter("held_out").toPandas()
    true, said = r.toxic == 1, r.predicted == 1
    assert (true & said).sum() / said.sum() > 0.9 and (true & said).sum() / true.sum() > 0.8


# ----------------------------------------------------------------------- decontamination


def test_contamination(spark):
    r = random.Random(5)
    v = [f"W{i}" for i in range(30)]
    docs = [(i, " ".join(r.choice(v) for _ in range(r.randint(0, 80)))) for i in range(60)]
    items = [(i, " ".join(docs[r.randrange(60)][1].split()[3:20])) for i in range(15)] + [(50, "w1, W2!"), (51, ""), (52, None), (53, "w1 w2"), (53, "absent word"), (54, docs[0][1]), (None, "w3 w4")]
    docs += [(100 + i, t) for i, t in enumerate(ODD)]
    want = brute.contaminated(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("segment", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string")
    for chunk in (8_000_000, 60):  # one block of the benchmark, and many
        got = {x.doc_id: (x.n_words, x.hits, x["items"]) for x in decontaminate.contamination(d, b, chunk_bytes=chunk).collect()}
        assert got == want
    assert decontaminate.contamination(empty_docs(spark), b).count() == 0
    assert decontaminate.contamination(d, b.limit(0)).filter(F.size("hits") > 0).count() == 0
    assert decontaminate.contamination(odd_docs(spark), b).count() == len(ODD) + 2


def test_postings_in_parts(spark):
    """Phrases of frequent words, with postings taken a few at a time."""
    text = "a b " * 300 + "a a b b " * 100
    index = decontaminate.build_index(spark.createDataFrame([(1, text), (2, "b a"), (3, None)], "doc_id long, text string").coalesce(1))
    s = decontaminate.Segment(pa.RecordBatch.from_pylist(index.toArrow().to_pylist()), 0)
    w = text.split()
    terms = s.find(pa.array(["a", "b"]))[np.array([[0, 0, 1], [1, 0, 0], [0, 1, 0]])]
    got = [(int(r), int(p)) for most in (1, 7, 10**6) for own, at in s.phrases(terms, most) for r, p in zip(own, at, strict=True)]
    want = [(r, i) for r, q in enumerate(["aab", "baa", "aba"]) for i in range(len(w) - 2) if "".join(w[i : i + 3]) == q]
    assert sorted(got) == sorted(want * 3)
    nothing = decontaminate.search(index.limit(0), [(1, "a b")])
    assert nothing.count() == 0 and decontaminate.search(index, []).count() == 0
    assert decontaminate.proximity(index.limit(0), {"q": ["a"]}, index.schema["ids"].dataType.elementType, 3).count() == 0


@pytest.mark.parametrize("partitions", [1, 30])
def test_blocks_of_the_benchmark_are_cut_in_tasks(spark, monkeypatch, partitions):
    """One partition of many items, and many of few: blocks are bounded, hold each item once, and give the same hits."""
    items = [(i if i else None, f"word{i} " * (1 + i % 40)) for i in range(300)] + [(300, "large " * 500), (301, None), (302, ""), (7, "word7 again")]
    b = spark.createDataFrame(items, "item_id long, text string").repartition(partitions)
    phrases = decontaminate.phrase_blocks(b, "item_id", "text", 1000)
    rows = phrases.collect()
    assert sorted((x.name, x.text) for r in rows for x in r["items"]) == sorted(("null" if i is None else str(i), t or "") for i, t in items)
    assert all(r.bytes <= 1000 or len(r["items"]) == 1 for r in rows)
    lots = list(decontaminate._chunks(phrases, 1000))
    assert sum(map(len, lots)) == len(items) and all(sum(len(t) for _, t in lot) <= 1000 or len({t for _, t in lot if len(t) > 1000}) == 1 for lot in lots)
    assert len(lots) <= 2 * sum(r.bytes for r in rows) / 1000 + 1  # small blocks of many partitions go together: two that follow each other fill one
    docs = spark.createDataFrame([(i, f"x {t or ''} y") for i, t in items[:50]], "doc_id long, text string")
    got = {(r.doc_id, r.n_words, len(r.hits), tuple(r["items"])) for r in decontaminate.contamination(docs, b, chunk_bytes=1000).collect()}
    assert got == {(r.doc_id, r.n_words, len(r.hits), tuple(r["items"])) for r in decontaminate.contamination(docs, b).collect()}


def test_proximity(spark):
    r = random.Random(6)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(40))) for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = decontaminate.build_index(d, segment_chars=200)
    assert index.count() > 4
    asked = {"abc": ["a", "b", "c"], "hh": ["h", "H"], "none": ["a", "zz"]}
    got = {(x.doc, x.query): x.ends for x in decontaminate.proximity(index, asked, d.schema["doc_id"].dataType, 4).collect()}
    want = {}
    for i, t in docs:
        w = t.split()
        for name, ws in asked.items():
            ws = {x.lower() for x in ws}
            if ends := [e for e in range(len(w)) if w[e] in ws and ws <= set(w[max(0, e - 3) : e + 1])]:
                want[i, name] = ends
    assert got == want


# ------------------------------------------------------------------------ language model


def deleted(i):
    """A fifth by a hash of the id and a word, as Spark's xxhash64 chains them."""
    h = xxhash.xxh64(b"deleted", seed=xxhash.xxh64(str(i).encode(), seed=42).intdigest()).intdigest()
    return (h - (h >> 63 << 64)) % 5 == 0


@pytest.mark.parametrize("parts, fan_in, chars", [(128, 256, 5_000_000), (128, 256, 30_000), (3, 4, 60_000)])
def test_language_model(spark, parts, fan_in, chars):
    """Counts, tally, weights and scores against a plain version; one block, many, and a tree of several levels."""
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    learn = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    got = lm_score.lm_scores(df, learn=F.crc32(F.col("doc_id").cast("string")) % 5 != 1, block_chars=chars, parts=parts, fan_in=fan_in).collect()
    want = brute.lm_scores(docs, learn, deleted)
    assert len(got) == len(want)
    for r in got:
        n, known, train, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, not learn(r.doc_id))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    others = brute.lm_scores_by_others(docs, learn, deleted)
    assert all(math.isclose(r.others_score, others[r.doc_id], rel_tol=1e-9) for r in got)
    assert all(r.others_score == r.score for r in held)


def test_em_finds_the_weights():
    """Cells drawn from a known mixture give it back."""
    rng = np.random.default_rng(1)
    q2, q1 = rng.integers(0, 20, 400), rng.integers(10, 60, 400)
    p = np.stack([lm_score._value(q2), lm_score._value(q1), np.full(400, 1 / 1001)], axis=1)
    for true in ([0.6, 0.3, 0.1], [0.1, 0.8, 0.1]):
        mass = (p @ np.array(true)) * 1e4
        cells = {}
        for a, b, m in zip(q2, q1, mass, strict=True):
            cells[5, int(a), int(b)] = cells.get((5, int(a), int(b)), 0) + m
        w = lm_score.learn_weights(cells, 1000, rounds=400)[5]
        likelihood = lambda x: sum(n * math.log(x[0] * lm_score._value(np.array(a)) + x[1] * lm_score._value(np.array(b)) + x[2] / 1001) for (_, a, b), n in cells.items())
        assert likelihood(w) >= likelihood(true) - 1e-6 * abs(likelihood(true))


def test_language_model_edges(spark):
    never = lm_score.lm_scores(odd_docs(spark), learn=F.lit(None).cast("boolean")).collect()
    assert len(never) == len(ODD) + 2 and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 for r in never)
    assert len(lm_score.lm_scores(odd_docs(spark), learn=F.lit(True)).collect()) == len(ODD) + 2
    assert lm_score.lm_scores(empty_docs(spark), learn=F.lit(True)).count() == 0


def test_language_model_by_others(spark):
    """A text that is learned from twice stands out, one that is learned from once does not; alone, nothing is left of it."""
    docs = [(1, "zig zag zug"), (2, "zig zag zug"), (3, "mip map mop")] + [(10 + i, f"w{i} x{i % 7} y{i % 5}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.lm_scores(df, learn=F.lit(True)).collect()}
    want = brute.lm_scores_by_others(docs, lambda i: True, deleted)
    assert all(math.isclose(got[i].others_score, want[i], rel_tol=1e-9) for i in got)
    assert got[1].others_score - got[3].others_score > got[1].score - got[3].score > 0
    one = lm_score.lm_scores(df.filter("doc_id = 3"), learn=F.lit(True)).first()
    assert math.isfinite(one.others_score) and one.others_score < one.score and one.train_tokens == 4
    never = lm_score.lm_scores(df, learn=F.lit(False)).collect()
    assert all(r.others_score == r.score for r in never)


# ------------------------------------------------------------------------------- tokens


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()] + [(1000 + i, x) for i, x in enumerate([*ODD, "It's 'S he'll\t\tx  y<|endoftext|><|endoftext|> z"])]
    got = token_count.token_counts(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    # many blocks, and a tree of several levels
    small = token_count.token_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), path, block_chars=60_000, parts=3, fan_in=4).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in small} == want
    assert token_count.token_counts(odd_docs(spark), path).count() == len(ODD) + 2
    assert token_count.token_counts(empty_docs(spark), path).count() == 0


def test_counter_refuses_other_files():
    with pytest.raises(ValueError):
        token_count.PieceCounter(open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read())
    said = json.loads(open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read())
    said["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        token_count.PieceCounter(json.dumps(said))


# -------------------------------------------------------------------------- SentencePiece


def test_ids_are_the_library_s(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()] + [(1000 + i, x) for i, x in enumerate([*ODD, "abcdefgh" * 60, " " * 77 + "z", "a\u2581b"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    enc = sentencepiece_np.encode_documents(df, path)
    text = dict(docs)
    for r in enc.collect():
        want = sp.encode(text[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<i4").tobytes()).hexdigest()
        assert r.round_trip == ("\u2581" not in (text[r.doc_id] or ""))
    back = {r.doc_id: r.text for r in sentencepiece_np.decode_documents(enc, path).collect()}
    assert all(back[i] == sp.decode(sp.encode(t or "")) for i, t in docs)
    assert sentencepiece_np.encode_documents(empty_docs(spark), path).count() == 0
    odd = spark.createDataFrame([(1, None, "?"), (1, None, "?"), (2, [], "?"), (None, [300], "?")], "doc_id long, ids array<int>, text string").withColumn("id", F.lit(0))
    assert sorted((x.doc_id or 0, x.text == "") for x in sentencepiece_np.decode_documents(odd, path).collect()) == [(0, False), (1, True), (1, True), (2, True)]
    assert sentencepiece_np.decode_documents(odd.limit(0), path).count() == 0
    holes = spark.createDataFrame([(1, [None, 300, None]), (2, [300]), (3, [None])], "doc_id long, ids array<int>")
    texts = {r.doc_id: r.text for r in sentencepiece_np.decode_documents(holes, path).collect()}
    assert texts[1] == texts[2] != "" and texts[3] == ""
    for bad in (-1, sp.vocab_size()):
        with pytest.raises(Exception, match="of a model with"):
            sentencepiece_np.decode_documents(spark.createDataFrame([(1, [5, bad])], "doc_id long, ids array<int>"), path).collect()
    assert sentencepiece_np.encode_documents(odd_docs(spark), path).count() == len(ODD) + 2


def best_sum(model, unit):
    """Largest sum of scores over all segmentations, by brute force over prefixes."""
    best = {0: 0.0}
    for end in range(1, len(unit) + 1):
        options = []
        for start in range(end):
            i = model.usable.get(unit[start:end])
            s = model.scores[i] if i is not None else model.unknown_score if end - start == 1 else None
            if s is not None:
                options.append(best[start] + s)
        best[end] = max(options)
    return best[len(unit)]


def test_viterbi():
    """Unigram models: batched and single paths reach the best sum, and decode to the text."""
    r = random.Random(8)
    pieces = ["<unk>"] + [f"<0x{i:02X}>" for i in range(256)] + sorted({"".join(r.choice("ab▁c") for _ in range(r.randint(1, 5))).replace("▁", "") or "a" for _ in range(60)} | {"▁a", "▁ab", "▁"})
    scores = [0.0] * 257 + [-r.random() * 9 for _ in pieces[257:]]
    m = sentencepiece_np.Model("unigram", pieces, scores, [2] + [6] * 256 + [1] * (len(pieces) - 257))
    texts = ["".join(r.choice("abc d") for _ in range(r.randint(1, 30))) for _ in range(200)]
    for text in texts:
        units = m.units(text)
        batched = m.encode_units(units)
        for unit, data in zip(units, batched, strict=True):
            ids = np.frombuffer(data, np.int32).tolist()
            known = [i for i in ids if i >= 257]
            unknown = sum(c == "d" for c in unit) if "d" not in m.usable else 0
            assert math.isclose(sum(scores[i] for i in known) + unknown * m.unknown_score, best_sum(m, unit), abs_tol=1e-6)
            assert math.isclose(sum(scores[i] for i in m._one(unit) if i >= 257) + unknown * m.unknown_score, best_sum(m, unit), abs_tol=1e-6)
        assert m.decode(m.encode([text])[0]) == text
    long = "ab" * 400  # longer than what bpe models batch
    assert math.isclose(sum(scores[i] for i in np.frombuffer(m.encode_units([long])[0], np.int32)), best_sum(m, long), abs_tol=1e-6)
    with pytest.raises(ValueError):
        sentencepiece_np.Model("unigram", pieces, scores, [2] + [6] * 256 + [4] * (len(pieces) - 257))


def test_merges_batched_and_single(spark):
    """All units of up to the batched length, as a long one is encoded."""
    m = sentencepiece_np.Model.from_file(tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(2)
    units = sorted({u for x in table(spark, SF, "documents").collect() for u in m.units(x.text or "")})
    units = r.sample(units, 3000) + ["".join(r.choice("aeéhnst▁日\U0001f600") for _ in range(r.randint(1, 128))) for _ in range(500)]
    assert [np.frombuffer(x, np.int32).tolist() for x in m.encode_units(units)] == [m._one(u) for u in units]


def test_viterbi_over_bpe_scores_is_something_else():
    """Why bpe models are merged: their ranks are no scores to be summed."""
    m = sentencepiece_np.Model.from_file(tokenizer_path("piece_bpe_32k.model"))
    u = sentencepiece_np.Model("unigram", m.pieces, m.scores, m.types)
    units = m.units("Therblein eating unfortunately stationed whereas")
    assert m.encode_units(units) != u.encode_units(units)
