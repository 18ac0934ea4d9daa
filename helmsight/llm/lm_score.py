"""Language-model scores by deleted interpolation of n-gram estimates.

    p(w | v) = l2 * c(v w) / c(v)  +  l1 * c(w) / N  +  l0 / (V + 1)

The weights depend on the bucket of the context's frequency, floor(log2(1 + c(v))), and
are learned by expectation-maximisation: a fifth of the training documents is held out
of the counts, and the weights maximise the likelihood of its counts under the
estimates of the rest. Scores then use the counts of all training documents. A document
that was learned from finds its own n-grams among these, which makes it look likely
whatever it says; its score by the others' counts alone is given too, which can be
compared with that of a document that was not learned from.

How the counts get to the documents: documents are packed into blocks of a bounded
number of characters. A block sends each of its distinct n-grams once, as sorted 64-bit
hashes, and gets the corpus' counts of them back (see `exchange`). Hashes spread evenly
and a block sends an n-gram once however often it holds it, so no frequent word makes a
task large. Only the bounded table of the EM's cells comes to the driver.
"""

from __future__ import annotations

import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, blocks, coded, discard, packed, unpacked, word_hashes, written
from .exchange import FAN_IN, PARTS, Codec, answered, answers_of, fragments, hash_part
from .near_dedup import mixed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_END, _BEGIN = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
#: cells of the EM: estimates are rounded to quarters of an octave, down to 2^-LOWEST
STEPS, LOWEST = 4, 48
#: what a document is for
SCORED, COUNTED, HELD_OUT = 0, 1, 2


#: terms of a block that are numbered by frequency
HEAD = 4096


def packed_terms(terms: np.ndarray) -> bytes:
    """The end and the frequent terms as they are, the others, which are sorted, as differences."""
    head, rest = terms[: HEAD + 1], terms[HEAD + 1 :]
    return packed(np.concatenate([head, np.diff(rest, prepend=np.uint64(0))]))


def unpacked_terms(data: bytes) -> np.ndarray:
    terms = unpacked(data, np.uint64).copy()
    terms[HEAD + 1 :] = np.cumsum(terms[HEAD + 1 :])
    return terms


class Block:
    """Tokens of a block of documents; token 0 is the end, -1 stands for the begin."""

    def __init__(self, terms: np.ndarray, codes: np.ndarray, lengths: np.ndarray, use: np.ndarray):
        self.terms, self.codes, self.lengths, self.use = terms, codes, lengths, use

    def index(self) -> Block:
        """Work out the sorted keys of the block's words and pairs, and where each token finds its own."""
        terms, codes, lengths, use = self.terms, self.codes, self.lengths, self.use
        starts = np.cumsum(lengths) - lengths
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[starts] = -1
        self.before = before
        self.token_use = np.repeat(use, lengths)
        with_begin = np.append(terms, _BEGIN)
        # the last bit tells words (1) from pairs (0)
        self.word_keys = mixed(with_begin) | np.uint64(1)
        pairs = mixed(with_begin[before] * _ODD + terms[codes]) & ~np.uint64(1)
        self.keys, at = np.unique(np.concatenate([self.word_keys, pairs]), return_inverse=True)
        at = at.astype(np.int32)
        self.word_at, self.pair_at = at[: len(with_begin)], at[len(with_begin) :]
        return self

    @classmethod
    def of_texts(cls, texts: list[str], use: np.ndarray) -> Block:
        each = [WORD.findall(ascii_lower(t)) for t in texts]
        lengths = np.fromiter(map(len, each), np.int64, len(each)) + 1
        ends = np.cumsum(lengths) - 1
        codes, terms = coded(list(chain.from_iterable(each)))
        del each
        hashes = mixed(word_hashes(terms))
        # the frequent terms get small numbers, the others are in the order of their hashes; both compress
        rank = np.empty(len(terms), np.int64)
        order = np.argsort(-np.bincount(codes, minlength=len(terms)), kind="stable")
        order[HEAD:] = order[HEAD:][np.argsort(hashes[order[HEAD:]], kind="stable")]
        rank[order] = np.arange(1, len(terms) + 1)
        every = np.zeros(int(lengths.sum()), np.int32)
        words = np.ones(len(every), bool)
        words[ends] = False
        every[words] = rank[codes]
        return cls(np.concatenate([[_END], hashes[order]]).astype(np.uint64), every, lengths, use)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each key, occurrences in counted and in held-out documents. The begin counts as a context once a document."""
        out = []
        for kind in (COUNTED, HELD_OUT):
            pick = self.token_use == kind
            n = np.bincount(self.word_at[self.codes[pick]], minlength=len(self.keys))
            n += np.bincount(self.pair_at[pick], minlength=len(self.keys))
            n[self.word_at[-1]] += int((self.use == kind).sum())
            out.append(n.astype(np.uint32))
        return out[0], out[1]

    def read(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token the counts of its pair, its context and itself, from the counts of the keys."""
        return counts[self.pair_at], counts[self.word_at[self.before]], counts[self.word_at[self.codes]]

    def own(self, pair: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token, how often its document was counted for its pair, its context and itself. pair, word: the corpus' counts of these."""
        learned = self.token_use != SCORED
        doc = np.repeat(np.arange(len(self.lengths), dtype=np.int64), self.lengths)

        def within(at: np.ndarray, total: np.ndarray) -> np.ndarray:
            out = learned.astype(np.int64)
            several = np.flatnonzero(learned & (total > 1))  # what was counted once was counted here
            if len(several):
                _, place, n = np.unique(doc[several] * len(self.keys) + at[several], return_inverse=True, return_counts=True)
                out[several] = n[place]
            return out

        own_pair, own_word = within(self.pair_at, pair), within(self.word_at[self.codes], word)
        own_context = np.empty_like(own_word)
        own_context[1:] = own_word[:-1]
        starts = np.cumsum(self.lengths) - self.lengths
        own_context[starts] = learned[starts]  # the begin, once a document
        return own_pair, own_context, own_word


class Counts(Codec):
    """Sorted 64-bit keys with occurrences in counted and in held-out documents; answers are those of the corpus."""

    def opened(self, keys, vals):
        return np.cumsum(unpacked(keys, np.uint64), dtype=np.uint64), self.opened_answer(vals)

    def closed(self, keys, vals):
        return packed(np.diff(keys, prepend=np.uint64(0))), self.packed_answer(vals)

    def part_of(self, keys, parts):
        return hash_part(keys, parts)

    def cut(self, keys, vals, start, end):
        return keys[start:end], [v[start:end] for v in vals]

    def united(self, children, parts):
        every, at = np.unique(np.concatenate([k for k, _ in children]), return_inverse=True)
        vals = [np.bincount(at, weights=np.concatenate([v[i] for _, v in children]), minlength=len(every)).astype(np.uint64) for i in (0, 1)]
        return every, vals, np.split(at, np.cumsum([len(k) for k, _ in children])[:-1])

    def answer(self, keys, vals):
        """The number to be added up is that of distinct words."""
        return vals, int(((keys & np.uint64(1) == 1) & (vals[0] + vals[1] > 0)).sum())

    def packed_answer(self, answers):
        first, second = (packed(a.astype(np.uint64)) for a in answers)
        return len(first).to_bytes(8, "little") + first + second

    def opened_answer(self, data):
        size = int.from_bytes(data[:8], "little")
        return [unpacked(data[8 : 8 + size], np.uint64), unpacked(data[8 + size :], np.uint64)]


COUNTS = Counts()


def bucket(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(1.0 + context)).astype(np.int64)


def _quantum(p: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + quarters of octaves below 1, at most STEPS * LOWEST."""
    with np.errstate(divide="ignore"):
        q = 1 + np.rint(-STEPS * np.log2(np.where(p > 0, p, 1.0))).astype(np.int64)
    return np.where(p > 0, np.minimum(q, STEPS * LOWEST), 0)


def _value(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 2.0 ** (-(q - 1) / STEPS), 0.0)


def learn_weights(cells: dict[tuple[int, int, int], float], vocabulary: int, rounds: int = 100, tied: float = 20.0) -> np.ndarray:
    """Rows of (l2, l1, l0) by context bucket. cells: (bucket, quantum of the pair's estimate, quantum
    of the word's) to held-out tokens. Every bucket also sees ``tied`` tokens spread as all buckets' are.

    Without held-out tokens the weights are (0.4, 0.55, 0.05). A context that was never
    counted has no pair estimate: its l2 is 0.
    """
    weights = np.tile([0.4, 0.55, 0.05], (65, 1))
    if cells:
        keys = np.array(list(cells), np.int64)
        n = np.array(list(cells.values()), float)
        b, p = keys[:, 0], np.stack([_value(keys[:, 1]), _value(keys[:, 2]), np.full(len(keys), 1.0 / (vocabulary + 1))], axis=1)

        def climb(groups: np.ndarray, at: np.ndarray, prior: np.ndarray) -> np.ndarray:
            for _ in range(rounds):
                share = at[groups] * p
                share *= (n / share.sum(axis=1))[:, None]
                got = prior + np.stack([np.bincount(groups, weights=share[:, k], minlength=len(at)) for k in range(3)], axis=1)
                at = got / got.sum(axis=1, keepdims=True)
            return at

        together = climb(np.zeros(len(b), np.int64), weights[:1], np.full((1, 3), 1e-3))[0]
        weights = climb(b, np.tile(together, (65, 1)), np.tile(together * tied, (65, 1)))
    weights[0] = [0.0, weights[0, 1] / (1 - weights[0, 0]), weights[0, 2] / (1 - weights[0, 0])]
    return weights


BLOCK = T.StructType(
    [
        T.StructField("block", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_counted", T.LongType()),
        T.StructField("n_held_out", T.LongType()),
        *(T.StructField(n, T.BinaryType()) for n in ("terms", "codes", "lengths", "use")),
    ]
)


def lm_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 5_000_000, parts: int = PARTS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: id_col, held_out (not learned from), n_tokens, n_known, train_tokens, base_score, score, others_score.

    Tokens are the words, A-Z lower-cased, and one end. base_score is the add-half
    unigram log10 probability, score that of the model above. others_score is that of the
    same model (its weights and V) with the document's own counts taken away, which is
    score where the document was not learned from. ``learn`` says which rows are learned
    from; null counts as no.

    * null, empty and blank texts have the end as their one token;
    * null ids and repeated rows are scored (and learned from) as they come; a repeated row is one of the others;
    * very long texts are a block of their own;
    * nothing to learn from: N and V are 0, all scores are that of a uniform guess;
    * one document to learn from: by the others' counts, of which there are none, only the uniform part is left of it;
    * an empty table gives no rows; other columns are ignored, whatever their names.

    The result is a written table; the work tables are deleted.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(kind)
    schema = T.StructType([*BLOCK.fields, T.StructField("ids", T.ArrayType(kind))])
    deleted = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("deleted")), F.lit(5)) == 0
    use = F.when(F.coalesce(learn, F.lit(False)), F.when(deleted, HELD_OUT).otherwise(COUNTED)).otherwise(SCORED)

    def pack(batches):
        for keys, texts in blocks(batches, block_chars):
            ids, used = [k["id"] for k in keys], np.array([k["use"] for k in keys], np.int8)
            b = Block.of_texts(texts, used)
            n = [int(b.lengths[used == k].sum()) for k in (COUNTED, HELD_OUT)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]),
                    *(pa.array([x], pa.int64()) for x in (len(b.codes), *n)),
                    *(pa.array([x], pa.binary()) for x in (packed_terms(b.terms), packed(b.codes), packed(b.lengths.astype(np.int32)), used.tobytes())),
                    pa.array([ids], pa.list_(arrow_id)),
                ],
                schema.names,
            )

    rows = docs.select(F.struct(F.col(id_col).alias("id"), use.cast("int").alias("use")).alias("key"), F.col(text_col).alias("text"))
    packs = written(rows.mapInArrow(pack, schema), "blocks")
    total = packs.agg(F.count(F.lit(1)), F.sum("n_counted"), F.sum("n_held_out")).first()
    n_blocks, n_counted, n_held = (int(x or 0) for x in total)

    def opened(batch: pa.RecordBatch, i: int) -> Block:
        get = lambda name: batch.column(batch.schema.get_field_index(name))[i].as_py()
        return Block(
            unpacked_terms(get("terms")), unpacked(get("codes"), np.int32), unpacked(get("lengths"), np.int32).astype(np.int64), np.frombuffer(get("use"), np.int8)
        ).index()

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = opened(batch, i)
                yield fragments(COUNTS, batch.column(0)[i].as_py(), b.keys, list(b.counts()), parts)

    of_block = ["terms", "codes", "lengths", "use"]
    asked = packs.select("block", *of_block).mapInArrow(send, "child string, part long, keys binary, vals binary")
    answers = answered(asked, n_blocks, COUNTS, parts, fan_in)
    own = answers.groupBy(F.col("child").alias("block")).agg(F.collect_list(F.struct("part", "answer")).alias("answers"), F.sum("extra").alias("extra"))  # one block's own keys
    own = written(own, "answers")  # which ends the largest exchange, that of what the blocks ask

    def tally(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = opened(batch, i)
                totals = answers_of(COUNTS, batch.column(batch.schema.get_field_index("answers"))[i].as_py())
                pair, context, word = (x[b.token_use == HELD_OUT].astype(float) for x in b.read(totals[0]))
                p2 = np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)
                cell = (bucket(context) * 1000 + _quantum(p2)) * 1000 + _quantum(word / max(n_counted, 1))
                cells, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in ("ids", *of_block, "extra")),
                        pa.array([packed(totals[0] + totals[1])], pa.binary()),
                        *(pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in (cells, n)),
                    ],
                    ["ids", *of_block, "extra", "totals", "cells", "times"],
                )

    tallied = T.StructType([f for f in schema.fields if f.name in ("ids", *of_block)])
    tallied = T.StructType([tallied["ids"], *(tallied[c] for c in of_block), T.StructField("extra", T.LongType()), T.StructField("totals", T.BinaryType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("cells", "times"))])
    counted = written(packs.select("block", "ids", *of_block).join(own, "block").mapInArrow(tally, tallied), "counts")
    discard(packs, own)
    # the begin is a context and no token, so it is not one of the V words
    vocabulary = int(counted.agg(F.sum("extra")).first()[0] or 0) - (1 if n_counted + n_held else 0)
    if n_held and n_counted:
        found = counted.select(F.inline(F.arrays_zip(F.col("cells").alias("cell"), F.col("times").alias("n")))).toDF("cell", "n").groupBy("cell").agg(F.sum("n").alias("n"))
        cells = {(r.cell // 1_000_000, r.cell // 1000 % 1000, r.cell % 1000): r.n for r in found.toLocalIterator()}  # at most 64 * (STEPS * LOWEST + 1)^2, whatever the corpus
    else:
        cells = {}
    weights = learn_weights(cells, vocabulary)
    n_train = n_counted + n_held

    def estimate(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n) -> np.ndarray:
        """Probabilities of tokens from the counts of their pairs, contexts and words among n tokens."""
        if not n_train:
            return np.full(len(pair), 1.0)
        w = weights[bucket(context)]
        p2 = np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)
        return w[:, 0] * p2 + w[:, 1] * (word / np.maximum(n, 1)) + w[:, 2] / (vocabulary + 1)

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = opened(batch, i)
                totals = unpacked(batch.column(batch.schema.get_field_index("totals"))[i].as_py(), np.uint64)
                pair, context, word = (x.astype(float) for x in b.read(totals))
                p = estimate(pair, context, word, n_train)
                mine = b.own(pair, word)
                others = n_train - np.repeat(np.where(b.use == SCORED, 0, b.lengths), b.lengths)
                p_others = estimate(pair - mine[0], context - mine[1], word - mine[2], others)
                base = (word + 0.5) / (n_train + 0.5 * (vocabulary + 1))
                starts = np.cumsum(b.lengths) - b.lengths
                total = lambda x, starts=starts: np.add.reduceat(x, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.column(batch.schema.get_field_index("ids"))[i].as_py(), arrow_id),
                        pa.array(b.use == SCORED),
                        pa.array(b.lengths),
                        pa.array(total((word > 0).astype(np.int64))),
                        pa.array([n_train] * len(b.lengths), pa.int64()),
                        pa.array(total(np.log10(base))),
                        pa.array(total(np.log10(p))),
                        pa.array(total(np.log10(p_others))),
                    ],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "others_score"],
                )

    out = counted.select("ids", *of_block, "totals").mapInArrow(
        score, f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, others_score double"
    )
    out = written(out.withColumnRenamed("id", id_col), "scores")
    discard(counted)
    return out
