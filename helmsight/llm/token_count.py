"""Token counts for byte-level BPE without materialising ids.

A text is cut into pre-tokens; merges never cross them, so a document's count is the
sum over its pre-tokens of their own counts. Each distinct pre-token of the corpus is
counted once by the library:

1. documents are packed into blocks of a bounded number of characters: the block's
   distinct pre-tokens, and for each document which of them it holds and how often;
2. blocks send their distinct pre-tokens; the pieces of each distinct one of the corpus
   are counted once, and the answers go back to the blocks (see `exchange`);
3. blocks join the answers to their documents' frequencies and sum.

A block sends a pre-token once however often it holds it, and hashes spread evenly, so
no frequent pre-token makes a task large.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, discard, packed, unpacked, word_hashes, written
from .exchange import FAN_IN, PARTS, Codec, answered, answers_of, fragments, hash_part

#: The pre-token pattern of byte-level BPE; fixed value.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceCounter:
    """Counts of pre-tokens by the library's own model, from the text of a tokenizer file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        said = json.loads(spec)
        step = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True):
            raise ValueError("this counter takes byte-level BPE files without a normalizer or prefix space")
        if any(x.get(flag) for x in said["added_tokens"] for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("this counter takes added tokens that are found as they are written")
        self.pattern = regex.compile(PRE_TOKEN)
        #: special strings inside a text are one token each, as by the library's default
        special = sorted((x["content"] for x in said["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.tokenizer = Tokenizer.from_str(spec)

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies of a text, and how many special strings it holds."""
        if self.special is None or not (n := len(self.special.findall(text))):
            return Counter(self.pattern.findall(text)), 0
        counts: Counter = Counter()
        for part in self.special.split(text):
            counts.update(self.pattern.findall(part))
        return counts, n

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        """Pieces of each pre-token."""
        out = []
        for start in range(0, len(pre_tokens), 20_000):
            out += [len(e.ids) for e in self.tokenizer.encode_batch_fast(pre_tokens[start : start + 20_000], add_special_tokens=False)]
        return np.array(out, np.uint32)


@lru_cache(maxsize=2)
def counter_of(spec: str) -> PieceCounter:
    """One counter per worker and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceCounter(spec)


def strings_out(tokens: pa.StringArray) -> tuple[bytes, bytes]:
    """Lengths and characters of strings, compressed."""
    offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    data = tokens.buffers()[2] or b""
    return packed(np.diff(offsets).astype(np.uint32)), packed(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]])


def strings_in(lengths: bytes, characters: bytes) -> pa.StringArray:
    sizes = unpacked(lengths, np.uint32)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(unpacked(characters, np.uint8).tobytes()))


class Pieces(Codec):
    """Distinct pre-tokens without values; answers are their numbers of pieces. ``spec`` gives the tokenizer's file."""

    def __init__(self, spec):
        self.spec = spec

    def opened(self, keys, vals):
        size = int.from_bytes(keys[:8], "little")
        return strings_in(keys[8 : 8 + size], keys[8 + size :]), None

    def closed(self, keys, vals):
        lengths, characters = strings_out(keys)
        return len(lengths).to_bytes(8, "little") + lengths + characters, b""

    def part_of(self, keys, parts):
        return hash_part(word_hashes(keys.to_pylist()), parts)

    def cut(self, keys, vals, start, end):
        return keys.slice(start, end - start), None

    def united(self, children, parts):
        coded = pa.concat_arrays([k for k, _ in children]).dictionary_encode()
        keys, order = self.ordered(coded.dictionary, parts)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return keys, None, np.split(rank[coded.indices.to_numpy()], np.cumsum([len(k) for k, _ in children])[:-1])

    def ordered(self, keys: pa.StringArray, parts: int) -> tuple[pa.StringArray, np.ndarray]:
        """By part, and inside parts by the text: neighbours are alike, which compresses."""
        by_text = pc.array_sort_indices(keys).to_numpy().astype(np.int64)
        order = by_text[np.argsort(self.part_of(keys, parts)[by_text], kind="stable")]
        return keys.take(pa.array(order)), order

    def answer(self, keys, vals):
        return [counter_of(self.spec.value).count(keys.to_pylist())], 0

    def packed_answer(self, answers):
        return packed(answers[0].astype(np.uint32))

    def opened_answer(self, data):
        return [unpacked(data, np.uint32)]


def token_counts(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, block_chars: int = 6_000_000,
    parts: int = PARTS, fan_in: int = FAN_IN
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``tokenizer_file`` is read on the driver and its text sent along: a fixed file of
    one or two MB, whatever the corpus. Null and empty texts have 0 bytes and tokens.
    Very long texts are a block of their own. Repeated rows are counted each; an empty
    table gives no rows; other columns are ignored. The result is a written table; the work
    tables are deleted.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    codec = Pieces(sent)
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    binary = lambda *names: [T.StructField(n, T.BinaryType()) for n in names]
    schema = T.StructType(
        [T.StructField("block", T.StringType()), T.StructField("distinct", T.LongType()), T.StructField("ids", T.ArrayType(kind))]
        + binary("bytes", "specials", "sizes", "held", "times", "tokens")
    )

    def pack(batches):
        for ids, texts in blocks(batches, block_chars):
            counter = counter_of(sent.value)
            each = [counter.frequencies(t) for t in texts]
            tokens, _ = codec.ordered(pa.array(set().union(*(c for c, _ in each)), pa.string()), parts)
            number = {t: i for i, t in enumerate(tokens.to_pylist())}
            held, times = [], []
            for c, _ in each:
                own = np.fromiter(map(number.__getitem__, c), np.int32, len(c))
                order = np.argsort(own)
                held.append(np.diff(own[order], prepend=np.int32(0)))
                times.append(np.fromiter(c.values(), np.uint32, len(c))[order])
            columns = [
                np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64),
                np.array([n for _, n in each], np.int64),
                np.array([len(c) for c, _ in each], np.int64),
                np.concatenate(held),
                np.concatenate(times),
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]),
                    pa.array([len(tokens)], pa.int64()),
                    pa.array([ids], pa.list_(id_type)),
                    *(pa.array([packed(c)], pa.binary()) for c in columns),
                    pa.array([codec.closed(tokens, None)[0]], pa.binary()),
                ],
                schema.names,
            )

    packs = written(docs.select(id_col, text_col).mapInArrow(pack, schema), "frequencies")

    def send(batches):
        for batch in batches:
            for name, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield fragments(codec, name, *codec.opened(tokens, b""), parts)

    # a block whose texts are all empty has nothing to ask
    asked = packs.filter("distinct > 0").select("block", "tokens").mapInArrow(send, "child string, part long, keys binary, vals binary")
    answers = answered(asked, packs.count(), codec, parts, fan_in)
    own = answers.groupBy(F.col("child").alias("block")).agg(F.collect_list(F.struct("part", "answer")).alias("answers"))  # of one block's own pre-tokens
    joined = packs.drop("tokens").join(own, "block", "left").drop("block")

    def add_up(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pieces = answers_of(codec, row["answers"])[0].astype(np.int64) if row["answers"] else np.zeros(0, np.int64)
                sizes, steps, times = unpacked(row["sizes"], np.int64), unpacked(row["held"], np.int32).astype(np.int64), unpacked(row["times"], np.uint32)
                ends = np.cumsum(sizes)
                places = np.cumsum(steps)
                before = np.concatenate(([0], places))[ends - sizes]  # each document's numbers start again from 0
                products = np.concatenate(([0], np.cumsum(pieces[places - np.repeat(before, sizes)] * times)))
                n = products[ends] - products[ends - sizes] + unpacked(row["specials"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], id_type), pa.array(unpacked(row["bytes"], np.int64)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"]
                )

    out = joined.mapInArrow(add_up, f"id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    out = written(out.withColumnRenamed("id", id_col), "counts")
    discard(packs)
    return out
