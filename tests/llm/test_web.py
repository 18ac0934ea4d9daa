"""WARC, url filter, chat formatting."""

import gzip
import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from helmsight.llm import chat_format, queries, warc
from helmsight.llm.url_filter import UrlTrie, split_url, url_filter

# ---------------------------------------------------------------------------------- WARC

PAGES = [
    (3, "http://a.org/x", "<p>same</p>"), (1, "http://a.org/y?z=1", "<p>same</p>"), (2, None, None), (4, "http://b.org", ""), (5, "no scheme", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3),
    (6, "http://c.org/é\r\nX: y", "日本 " * 5000), (None, "http://n.org/", "<p>same</p>"), (7, "http://d.org/", "\r\n\r\n"),
]


def captures(spark, tmp_path, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("hex", F.lit("?")).withColumn("id", F.lit(0))
    path = str(tmp_path / "warc")
    warc.write_archives(df, path, **more)
    return warc.read_archives(spark, path), path


def test_round_trip(spark, tmp_path):
    records, _ = captures(spark, tmp_path, PAGES, bytes_per_file=4000)
    assert records.count() == 3 * len(PAGES) and records.select("file").distinct().count() > 1
    rows = warc.assemble(records).collect()
    assert len(rows) == len(PAGES)
    import json

    by_id = {json.loads(r.metadata.payload).get("id"): r for r in rows}
    for i, url, html in PAGES:
        r = by_id[None if i is None else str(i)]
        assert r.request is not None and json.loads(r.metadata.payload)["url"] == (url or "")
        data = (html or "").encode()
        if r.response.type == "response":
            assert r.response.payload == data and r.response.stated_digest == "sha1:" + r.response.payload_digest
        else:
            assert r.response.payload == b"" and r.response.stated_bytes == len(data)
    assert {i: by_id[i].response.type for i in ("1", "3", "2", "4")} == {"1": "response", "3": "revisit", "2": "response", "4": "revisit"}
    assert by_id["3"].response.refers_to == by_id["1"].capture_id and by_id[None].response.refers_to == by_id["1"].capture_id


def test_small_payloads_are_no_revisits(spark, tmp_path):
    records, _ = captures(spark, tmp_path, PAGES, least_bytes=5)
    types = [r.type for r in records.filter("type in ('response', 'revisit')").collect()]
    assert types.count("revisit") == 2  # the two empty payloads are both responses


def test_empty_and_repeated(spark, tmp_path):
    records, _ = captures(spark, tmp_path, [(1, "http://a/", "x")] * 3)
    assert warc.assemble(records).count() == 1
    empty = records.filter("false")
    assert warc.assemble(empty).count() == 0


def test_every_page_row_is_a_capture(spark, tmp_path):
    """Repeated rows, ids with several urls and rows without an id, as OP2_SQL counts them."""
    same = [(1, "http://a/", "x")] * 3 + [(1, "http://b/", "x"), (2, "http://a/", "x"), (2, "http://a/", "x"), (3, "http://a/", "y")]
    rows = same + [(None, "http://n/", "x"), (None, "http://m/", "x"), (None, "http://m/", "x"), (None, "http://n/", "z"), (None, "http://n|/", "z")]
    records, _ = captures(spark, tmp_path, rows, every_row=True)
    assert records.count() == 3 * len(rows) == records.select("record_id").distinct().count()
    made = warc.assemble(records).collect()
    assert len(made) == len(rows) and all(r.request and r.metadata for r in made)
    own = {r.capture_id for r in made if r.response.type == "response"}
    assert all(r.response.refers_to in own for r in made if r.response.type == "revisit")

    from compare import connect, same as agree

    sf = str(tmp_path / "sf")
    spark.createDataFrame(same, "page_id long, url string, html string").repartition(3).write.parquet(f"{sf}/pages.parquet")
    con = connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet/*.parquet')")
    agree(queries.op2_warc(spark, sf), con, queries.OP2_SQL)


def test_no_pages_and_no_archives(spark, tmp_path):
    records, path = captures(spark, tmp_path, [], every_row=True)
    assert records.count() == 0 and warc.assemble(records).count() == 0


@pytest.mark.parametrize("every_row", [False, True])
def test_long_pages_and_file_sizes(spark, tmp_path, every_row):
    """Files are cut by bytes, not by pages; a page that is larger than a file has one by itself."""
    import glob

    rows = [(i, f"http://a/{i}", str(i) + "x" * 1000 * (i % 50)) for i in range(400)] + [(1000, "http://long/", "é" * 3_000_000), (1001, "http://long/", "é" * 3_000_000 + "!")]
    records, path = captures(spark, tmp_path, rows, bytes_per_file=400_000, every_row=every_row)
    assert records.count() == 3 * len(rows)
    sizes = [len(warc.inflated(open(f, "rb").read())) for f in glob.glob(f"{path}/part-*")]
    assert len(sizes) >= 25 and all(s <= 400_000 + 4 or 6_000_000 < s < 6_010_000 for s in sizes)
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert len(got) == len(rows) and max(r.response.payload_bytes for r in got.values()) == 6_000_001


def test_very_many_equal_rows(spark, tmp_path, monkeypatch):
    """More equal rows than one task makes; all come back, and revisits find the first of them."""
    monkeypatch.setattr(warc, "EQUAL_ROWS", 10)
    rows = [(1, "http://a/", "x")] * 95 + [(None, None, None)] * 41 + [(2, "http://b/", "x")] * 10 + [(3, "http://c/", "z")]
    records, _ = captures(spark, tmp_path, rows, every_row=True)
    made = warc.assemble(records).collect()
    assert len(made) == len(rows) == records.filter("type in ('response', 'revisit')").select("record_id").distinct().count()
    own = {r.capture_id for r in made if r.response.type == "response"}
    assert sorted(r.response.payload for r in made if r.response.type == "response") == [b""] * 41 + [b"x"] * 95 + [b"z"]
    assert len(own) == 95 + 41 + 1 and {r.response.refers_to for r in made if r.response.type == "revisit"} <= own


def test_a_popular_payload_can_be_split(spark, tmp_path):
    """Both sides of the joins that spread what a payload has are exchanges, which adaptive execution can split."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    seen = []
    keep = warc.written
    try:
        warc.written = lambda d, name: seen.append(d) or keep(d, name)
        warc.write_archives(df, str(tmp_path / "w"), every_row=True)
    finally:
        warc.written = keep
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = [x.strip(" :+-*") for x in seen[0]._jdf.queryExecution().executedPlan().toString().split("\n")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sides = [i for i, x in enumerate(lines) if x.startswith(("Sort [concat_ws", "Sort [_payload"))]
    assert len(sides) == 2 and all(lines[i + 1].startswith("Exchange hashpartitioning") for i in sides)
    assert sum(x.startswith("ReusedExchange") for x in lines) <= 1


def test_parsing_piece_by_piece():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 5\r\n\r\nhe\r\no\r\n\r\n"
    whole = list(warc.parse(record * 3))
    for n in (1, 2, 7, 50):
        data = record * 3
        assert list(warc.parse(data[i : i + n] for i in range(0, len(data), n))) == whole
    assert [o for o, _, _ in whole] == [0, len(record), 2 * len(record)]


def test_links_both_ways_and_orphans(spark):
    row = lambda i, t, to: (i, t, None, None, to, None, None, None, None, 0, "", b"", "f", 0)
    df = spark.createDataFrame([row("r1", "response", ["q1"]), row("q1", "request", []), row("m1", "metadata", ["r1", "zz"]), row("q2", "request", ["gone"]), row("r2", "revisit", []), row("m1", "metadata", ["r1"])], warc.RECORD)
    got = {r.capture_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in warc.assemble(df).collect()}
    assert got == {"r1": ("q1", "m1"), "r2": (None, None)}


def test_records_without_an_id(spark):
    """They are told apart by their places, and belong to what they name."""
    row = lambda i, t, to, at: (i, t, None, None, to, None, None, None, None, 0, "", b"", "f", at)
    rows = [row(None, "response", [], 0), row(None, "response", ["q1"], 9), row("q1", "request", [], 20), row("r1", "response", [], 30), row(None, "request", ["r1"], 40), row(None, "metadata", [], 50)]
    got = warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()
    assert sorted((r.capture_id or "", r.response.offset, r.request and r.request.offset, r.metadata) for r in got) == [("", 0, None, None), ("", 9, 20, None), ("r1", 30, 40, None)]


@pytest.mark.parametrize("length", ["", "Content-Length: x\r\n", "Content-Length: -5\r\n", "Content-Length: 5\r\nContent-Length: 4\r\n"])
def test_records_without_a_length_are_errors(length):
    with pytest.raises(ValueError, match="byte 0 has no Content-Length"):
        list(warc.parse(f"WARC/1.1\r\nWARC-Type: metadata\r\n{length}\r\nhello\r\n\r\n".encode()))


def test_cut_archives_are_errors():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [(h["warc-type"], b) for _, h, b in warc.parse(record * 2)] == [(["metadata"], b"hello")] * 2
    with pytest.raises(ValueError):
        list(warc.parse(record[:-7]))
    with pytest.raises(ValueError):
        list(warc.parse(b"junk"))
    assert warc.inflated(gzip.compress(record) + gzip.compress(record)) == record * 2
    with pytest.raises(ValueError):
        warc.inflated(gzip.compress(record)[:-9])


def test_base32(spark):
    import base64

    for text in ("", "a", "é"):
        got = spark.range(1).select(warc.base32_of_hex(F.sha1(F.lit(text)))).first()[0]
        assert got == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


# ---------------------------------------------------------------------------- url filter

hosts = st.lists(st.sampled_from(["a", "b", "org", "com"]), min_size=1, max_size=4).map(".".join)
paths = st.lists(st.sampled_from(["", "x", "xy", "1"]), max_size=4).map("/".join).map(lambda p: "/" + p)


@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), hosts, paths), max_size=8, unique_by=lambda r: r[1:]), hosts, st.one_of(paths, st.just("")))
def test_trie(rules, host, path):
    _, _, rule, verdict = brute.url(rules, f"http://{host}{path}?q")
    assert (UrlTrie(rules).match(host, path) or (None, "allow"))[:2] == (rule, verdict)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/en/1#x", "http://example.org?x", "http://xexample.org/es/", "x://é.org/%20?a://b", "http://com/de/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter(df, queries.URL_RULES).orderBy("page_id").collect()]
    assert got == [brute.url(queries.URL_RULES, u) for u in urls]
    assert url_filter(df.limit(0), queries.URL_RULES).count() == 0
    assert split_url("http://A.b/c?d") == ("a.b", "/c")
    assert {r.verdict for r in url_filter(df, []).collect()} == {"allow"}
    assert {r.verdict for r in url_filter(df, [], default="block").collect()} == {"block"}
    with pytest.raises(ValueError):
        UrlTrie([("deny", "a", "/")])


def test_rules_in_blocks(spark):
    """More rules than are broadcast at once give the same; of a rule given twice the last verdict counts; long urls are whole."""
    r = random.Random(4)
    host = lambda: ".".join(r.choice(["a", "b", "org", "com"]) for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "/".join(r.choice(["", "x", "xy", "1"]) for _ in range(r.randint(0, 4)))
    rules = list({(h, p): (r.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(60))}.values())
    urls = [f"http://{host()}{path()}?{i}" for i in range(300)] + ["http://a.org/x" + "/long" * 200_000, "http://" + "a." * 100_000 + "org/x", None, "http://a.org/x"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("labels", F.lit(1)).withColumn("length", F.lit("?"))
    want = [brute.url(rules, u) for u in urls]
    for most in (10**9, 400, 1):
        assert [(x.host, x.path, x.rule, x.verdict) for x in url_filter(df, rules, max_rule_bytes=most).orderBy("page_id").collect()] == want
    twice = [("allow", "org", "/"), ("block", "org", "/")]
    for most in (10**9, 1):
        assert {x.verdict for x in url_filter(df.filter("page_id = 300"), twice, max_rule_bytes=most).collect()} == {"block"}


# ---------------------------------------------------------------------------------- chat

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string, position int, formatted string"


def events(spark, rows):
    return spark.createDataFrame([(*r, 0, "?") for r in rows], EVENTS)


def test_fold(spark):
    rows = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", None), (1, 2, "delta", 1, None, "he"), (1, 3, "delta", 1, None, "llo"), (1, 4, "edit", 0, None, "hi there"),
        (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, None, "hey"), (1, 7, "delta", 1, None, "!"), (2, 0, "delta", 9, "assistant", "lone"), (3, 0, "message", 0, None, None),
    ]
    shuffled = list(rows)
    random.Random(1).shuffle(shuffled)
    got = [(r.conv_id, r.role, r.text) for r in chat_format.fold(events(spark, shuffled)).orderBy("conv_id", "position").collect()]
    assert got == [(1, "user", "hi there"), (1, "assistant", "hey!"), (2, "assistant", "lone"), (3, "", "")]
    assert chat_format.fold(events(spark, [])).count() == 0


def test_fold_ties_and_repeats(spark):
    rows = [
        (1, 5, "delta", 1, "user", "b"), (1, 5, "edit", 1, "user", "a"), (1, 2, "delta", 1, "x", "gone"), (1, 6, "delta", 1, None, "c"), (1, 6, "delta", 1, None, "c"),  # equal seq: by text
        (None, 1, "message", 7, "user", "no conversation"), (2, 1, "message", None, "user", "no number"), (2, 1, "delta", None, "assistant", "more"),
    ]
    got = sorted((r.conv_id or 0, r.role, r.text) for r in chat_format.fold(events(spark, rows)).collect())
    assert got == [(0, "user", "no conversation"), (1, "x", "abcc"), (2, "assistant", "moreno number")]


def test_logs_fold_to_their_turns(spark):
    turns = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("user", "hällo you"), ("assistant", "a"), ("user", ""), ("assistant", None), ("user", "</s>"), ("assistant", "odd👍number")] * 3)]
    log = queries.logged(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "regenerate", "edit"}
    got = [(r.conv_id, r.role, r.text) for r in chat_format.fold(log.orderBy(F.rand(1))).orderBy("conv_id", "position").collect()]
    assert got == [(c, r, x or "") for c, _, r, x in sorted(turns, key=lambda x: (x[0] or 0, x[1]))]
    plan = chat_format.render(chat_format.fold(log))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # all by conversation


AWKWARD = ["", "</s>", "<s>", "<\\s>", "<\\\\/s>\n", "[INST] a [/INST]", "[\\INST]", "\\", "a\nb", "</s>\n<s>user\nx", "é 👍", "x" * 100_000, " [/INST]", "<", "</s", "$1 \\1"]


def test_escapes_round_trip(spark):
    """Every awkward text in every role, read back from the formatted text alone."""
    roles = ["user", "assistant", "system", "a\nb", "\\n", "</s>", "", "a\0\nb", "\0", "\\", "\\\\n\\\n", "\t\\\0\\", "a" * 50]
    turns = [(r, t) for r in roles for t in AWKWARD]
    rows = [(1, i, "message", i, r, t) for i, (r, t) in enumerate(turns)] + [(2, 0, "message", 0, "assistant", "ok")]
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.render(chat_format.fold(events(spark, rows)))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == turns
    assert out[1].loss_text == "".join(t for r, t in turns if r == "assistant")
    assert out[1].formatted.count("<s>") == len(turns)  # no control string is left in a text
    assert "".join(out[2].formatted[s.start : s.end] for s in out[2].loss_spans) == "ok"


def test_native_and_ordered(spark):
    df = chat_format.read_back(chat_format.render(chat_format.fold(events(spark, []))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and df.count() == 0


def test_query_extra_conversation(spark):
    from compare import DATA

    r = queries.op6_chat_format(spark, f"{DATA}/sf0.001").filter("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == brute.sha(said)
    assert r.turns_sha256 == brute.sha(f"user\n{said}\nassistant\n{said}\n")
