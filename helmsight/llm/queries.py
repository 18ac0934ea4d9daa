"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import chat_format, warc
from .common import delete, discard, work_path, written
from .decontaminate import contamination
from .embedding_dedup import near_vectors
from .exact_dedup import exact_dedup
from .lm_score import lm_scores
from .near_dedup import near_duplicates
from .prefix_trie import numbered, prefix_trie
from .sentencepiece_np import encode_documents
from .spelling import contract_noise, spelling_variants, word_counts
from .token_count import token_counts
from .toxicity import toxicity, train
from .url_filter import url_filter

#: The rules of the url query: verdict, host, path. Fixed values.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), use=_remainder("doc_id", 4) != 2)
    return toxicity(docs, model, threshold=0.3).select(
        "doc_id", F.coalesce(_remainder("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "score", "predicted", F.size("sentences").cast("long").alias("n_offending")
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, least_bytes=0, every_row=True)
    records = written(warc.read_archives(spark, path, payloads=False), "records")  # parsed once, though assembly looks at it several times
    captures = warc.assemble(records).select(
        "capture_id",
        F.get_json_object(F.col("metadata.payload").cast("string"), "$.id").cast("long").alias("page_id"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers"),
        F.when(F.col("response.type") == "revisit", F.col("response.stated_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(F.col("response.type") == "revisit", F.substring_index("response.stated_digest", ":", -1))
        .otherwise(F.col("response.payload_digest"))
        .alias("payload_digest"),
    )
    originals = captures.filter("record_type = 'response'").select(F.col("capture_id").alias("key"), F.col("page_id").alias("refers_to"))
    # responses refer to nothing; a key of their own keeps them from meeting as nulls in one task
    captures = captures.withColumn("key", F.coalesce("refers", F.concat(F.lit("none "), "capture_id")))
    out = written(captures.join(originals, "key", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "captures")
    discard(records)
    delete(spark, path)
    return out


def logged(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as a log of streamed deltas, regenerations and edits, which folded gives the turns.

    By turns: two deltas; a draft that is regenerated; a text that is edited after the next
    message has begun.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.col("n")
    half = F.floor(F.length("text") / 2).cast("int")
    start, end = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    event = lambda step, kind, text: F.struct((n * 10 + step).alias("seq"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    streamed = F.array(event(0, "message", start), event(1, "delta", end))
    drafted = F.array(event(0, "message", F.lit("")), event(1, "delta", F.concat(F.lit("draft "), start)), event(2, "regenerate", F.lit(None)), event(3, "delta", start), event(4, "delta", end))
    edited = F.array(event(0, "message", F.concat(F.lit("first "), start)), event(1, "delta", F.lit(" and more")), event(15, "edit", F.col("text")))
    told = rows.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("n"))
    return told.select("conv_id", "role", n.alias("message"), F.inline(F.when(n % 3 == 1, streamed).when(n % 3 == 2, drafted).otherwise(edited)))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat_format.read_back(chat_format.render(chat_format.fold(logged(rows))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "round_trip")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, similarity=0.8)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), learn=_remainder("doc_id", 5) != 1)


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of the contract's trie: each conversation begins with the first h turns of the one
    whose id is the multiple of 5 below, and goes on with its own from the next. h is at most 8."""
    own = written(numbered(conversations), "turns")
    first = own.filter("conv % 5 = 0 AND n <= 8").groupBy(F.col("conv").alias("base"))
    first = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "turn_hash", "bytes"))), lambda t: F.struct(t["turn_hash"], t["bytes"])).alias("first"))
    h = (_remainder("conv", 9)).cast("int").alias("h")
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n_own")).select("conv", "n_own", h, (F.col("conv") - F.col("conv") % 5).alias("base"))
    heads = convs.join(first, "base", "left").select("conv", "n_own", "h", F.coalesce(F.slice("first", 1, F.greatest("h", F.lit(1))), F.array()).alias("first"))
    heads = heads.withColumn("first", F.when(F.col("h") == 0, F.slice("first", 1, 0)).otherwise(F.col("first")))
    heads = written(heads.withColumn("k", F.size("first").cast("long")), "heads")
    begun = heads.select("conv", F.posexplode("first").alias("i", "t")).select("conv", (F.col("i") + 1).cast("long").alias("n"), "t.turn_hash", "t.bytes")
    gone_on = own.join(heads.select("conv", "h", "k"), "conv").filter("n > h").select("conv", (F.col("n") - F.col("h") + F.col("k")).alias("n"), "turn_hash", "bytes")
    length = F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0).cast("long"))
    return begun.unionByName(gone_on), heads.select("conv", length.alias("length"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), noise=contract_noise()))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

#: Base32 of a SHA-1: 32 groups of 5 bits of its 160.
OP2_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT *, list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(CAST(strpos('0123456789abcdef', hex[i + 1]) - 1 AS BIGINT)), 4, '0')), 'string_agg', '') AS bits FROM p),
d AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
      + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT)]), 'string_agg', '') AS payload_digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP4_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, s)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + 9 + CASE WHEN role = 'user' THEN 15 ELSE 0 END + length(regexp_replace(
    regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')) AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP8_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n.n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN k USING (doc_id)
"""


#: CRC-32 of a text's UTF-8 bytes: each byte, then eight shifts
CRC_SQL = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(0, CAST(octet_length(encode({x})) AS BIGINT)),
    lambda i: list_concat([CAST(('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)], list_transform(range(0, 8), lambda j: CAST(-1 AS BIGINT)))))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END)"""


def crc_sql(x: str) -> str:
    return f"xor({CRC_SQL.format(x=x)}, CAST(4294967295 AS BIGINT))"


OP11_SQL = rf"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '')), md5(coalesce(text, ''))) AS n,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(t ORDER BY n) AS t, list(size ORDER BY n) AS s FROM t GROUP BY c),
h AS (SELECT *, {crc_sql("CAST(c AS VARCHAR)")} % 9 AS h FROM o),
r AS (
  SELECT h.c, list_concat(coalesce(b.t, [])[1:h], h.t[h + 1:]) AS t, list_concat(coalesce(b.s, [])[1:h], h.s[h + 1:]) AS s
  FROM h LEFT JOIN o b ON b.c = h.c - h.c % 5),
m AS (SELECT c, d, t[1:d] AS p, CASE WHEN d > 0 THEN t[1:d - 1] END AS up, coalesce(s[d], 0) AS size, d = len(t) AS ends FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM r)),
n AS (
  SELECT p, d, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends FROM m GROUP BY p, d),
k AS (SELECT up AS p, count(*) AS kids FROM n WHERE d > 0 GROUP BY up),
v AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (p)),
below AS (SELECT p[1:e] AS p, sum(CAST(kids = 0 AS BIGINT)) AS leaves, sum((n - 1) * size) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM v) GROUP BY 1)
SELECT v.c AS conv_id, v.d AS depth, a.c AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN below USING (p) LEFT JOIN n a ON a.p = v.up AND v.d > 0
"""

OP12_SQL = rf"""
WITH r AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  GROUP BY ALL),
h AS (SELECT *, {crc_sql("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM r),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
  FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)),
p AS (
  SELECT DISTINCT a.word AS a, b.word AS b, a.n AS n, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, a.n, b.n FROM w a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, a.word, b.n, a.n FROM w a JOIN cut b ON a.word = b.rest),
f AS (
  SELECT a AS word, count(*) AS n_near, CASE WHEN max(m) >= 5 * any_value(n) THEN arg_min(b, (-m, b)) END AS form, CASE WHEN max(m) >= 5 * any_value(n) THEN max(m) END AS form_n
  FROM p GROUP BY a),
up AS (
  WITH RECURSIVE g(word, top) AS (SELECT word, word FROM w UNION SELECT g.word, f.form FROM g JOIN f ON f.word = g.top AND f.form IS NOT NULL)
  SELECT g.word, g.top AS root FROM g LEFT JOIN f ON f.word = g.top WHERE f.form IS NULL)
SELECT w.word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM w LEFT JOIN f USING (word) JOIN up USING (word)
"""

OP13_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT vec_id, (SELECT count(*) FROM l WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_warc": op2_warc,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_decontamination": op5_decontamination,
        "op6_chat_format": op6_chat_format,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_near_dedup": op8_near_dedup,
        "op9_lm_score": op9_lm_score,
        "op10_token_count": op10_token_count,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_spelling": op12_spelling,
        "op13_embedding_dedup": op13_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": OP2_SQL,
        "op3_exact_dedup": OP3_SQL,
        "op4_url_filter": OP4_SQL,
        "op5_decontamination": OP5_SQL,
        "op6_chat_format": OP6_SQL,
        "op8_near_dedup": OP8_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op12_spelling": OP12_SQL,
        "op13_embedding_dedup": OP13_SQL,
    }
