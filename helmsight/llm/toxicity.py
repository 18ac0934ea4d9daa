"""Toxicity by multiple-instance learning with noisy-or.

A document is a bag of sentences, and only documents have labels. A word w of a
sentence causes toxicity with a hazard h[w] >= 0, so

    p(sentence) = 1 - exp(-sum of h[w] over its distinct words)
    p(document) = 1 - (1 - leak) * product over sentences of (1 - p(sentence))

which is a noisy-or of the sentences (and inside them of the words), with a leak for
labels that no word explains. A word counts once a sentence, in training and in scoring.
The hazards are fitted by expectation-maximisation: of the cause of a toxic label a
sentence gets the share p(sentence) / p(document), and in it a word h[w] / p(sentence),
so what one word explains is not credited to the others; a clean label denies all
sentences. The product of both shares is h[w] / p(document), so for the fit a document
is told by the number of its sentences with each word. Once fitted, the sentence scores
say where a document offends.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, written

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of the sentences of a text that hold words."""
    out = []
    for m in SENTENCE.finditer(text):
        if ws := WORD.findall(m.group().lower()):
            out.append((m.start(), m.end(), ws))
    return out


@dataclass
class Model:
    hazard: dict[str, float]
    leak: float

    def __post_init__(self):
        self.telling = frozenset(self.hazard)

    def sentence_hazard(self, words: list[str]) -> float:
        """Sum over the distinct words, whatever their order."""
        return math.fsum(map(self.hazard.__getitem__, self.telling.intersection(words)))

    def sentence(self, words: list[str]) -> float:
        return -math.expm1(-self.sentence_hazard(words))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and (start, end, score) of each sentence that is not quite clean."""
        total, found = 0.0, []
        for m in SENTENCE.finditer(text):
            if h := self.sentence_hazard(WORD.findall(m.group().lower())):
                total += h
                found.append((m.start(), m.end(), -math.expm1(-h)))
        return 1.0 - (1.0 - self.leak) * math.exp(-total), found


def bag(text: str) -> Counter:
    """In how many sentences of a text each word occurs."""
    return Counter(w for _, _, ws in sentences(text) for w in set(ws))


def fit(words: pa.ListArray, times: np.ndarray, toxic: np.ndarray, least_docs: int = 3, prior: float = 2.0, rounds: int = 200) -> Model:
    """Hazards from the documents' words, how often each entry of them occurs, and the labels.

    Words of fewer than ``least_docs`` documents are left out. ``prior`` counts as so
    many clean sentences with each word. Without toxic examples all hazards are 0.
    """
    n_docs = len(words)
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    word, n_words = coded.indices.to_numpy(), len(coded.dictionary)
    toxic = np.asarray(toxic, bool)
    n_toxic = int(toxic.sum())
    if not n_toxic:
        return Model({}, 0.0)
    in_docs = np.bincount(word, minlength=n_words)
    in_toxic = np.bincount(word[toxic[doc]], minlength=n_words)
    shown = np.bincount(word, weights=times, minlength=n_words) + prior
    use = (in_docs >= least_docs) & (in_toxic >= min(2, least_docs))
    pick = toxic[doc] & use[word]
    order = np.cumsum(toxic) - 1  # toxic documents, numbered
    d, w, x = order[doc[pick]], word[pick], times[pick].astype(float)
    h, leak = np.where(use, in_toxic / shown, 0.0), 0.1
    for _ in range(rounds):
        total = np.bincount(d, weights=h[w] * x, minlength=n_toxic) + leak
        share = 1.0 / -np.expm1(-np.maximum(total, 1e-12))
        h = np.bincount(w, weights=h[w] * x * share[d], minlength=n_words) / shown
        leak = float((leak * share).sum() / (n_docs + 20))  # as if 20 clean documents more had been seen
    words = coded.dictionary.to_pylist()
    return Model({words[i]: float(h[i]) for i in np.flatnonzero(h)}, -float(np.expm1(-leak)))


def train(
    docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 10_000, most_bytes: int = 64_000_000
) -> Model:
    """Fit on at most ``most`` labelled documents of at most ``most_bytes`` of text in all: those of smallest
    hash among the rows of ``labels`` that ``use`` admits; a text that no longer fits is passed over.

    The bounds hold for the fit alone; scoring covers every document. An id labelled
    both ways counts as toxic; null ids and null labels are not learned from. Null and
    empty texts have no words. Of an id with several rows each is learned from. Without
    labels or documents the model is empty and its leak 0.
    """
    named = labels.filter(use & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    picked = named.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")  # at most `most` rows of two numbers

    def bags(batches):
        for batch in batches:
            each = [bag(t.as_py() or "") for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([list(b) for b in each], pa.list_(pa.string())), pa.array([list(b.values()) for b in each], pa.list_(pa.int32()))],
                ["at", "size", "y", "words", "times"],
            )

    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    told = rows.select(F.xxhash64("_id").alias("at"), size.alias("size"), F.col("_y").cast("int").alias("y"), "_text")
    told = written(told.mapInArrow(bags, "at long, size long, y int, words array<string>, times array<int>").withColumn("row", F.monotonically_increasing_id()), "bags")
    fits, total = [], 0
    for r in told.select("row", "size", "at").orderBy("at", "row").limit(most).collect():  # at most `most` rows of three numbers
        if total + r.size <= most_bytes:
            fits.append(r.row)
            total += r.size
    chosen = docs.sparkSession.createDataFrame([(r,) for r in fits], "row long")
    # in the order of their numbers, so that equal inputs give equal sums
    got = told.join(F.broadcast(chosen), "row").select("row", "y", "words", "times").orderBy("row").toArrow()
    discard(told)
    column = lambda name: got.column(name).combine_chunks()
    return fit(column("words"), column("times").flatten().to_numpy(), column("y").to_numpy() > 0)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: id_col, score, predicted, sentences (start, end, score of those at or over the threshold).

    Only the text is looked at. Null, empty and wordless texts score the leak and have
    no sentences. Repeated rows are scored each; an empty table gives no rows; other
    columns are ignored. The model is one number for each word that its bounded
    training set found telling, so it is sent to the tasks as it is.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(kind)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        model = sent.value
        for ids, texts in blocks(batches):
            scored = [model.score(t) for t in texts]
            where = [[dict(zip(("start", "end", "score"), s, strict=True)) for s in found if s[2] >= threshold] for _, found in scored]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_id), pa.array([s for s, _ in scored], pa.float64()), pa.array([int(s >= threshold) for s, _ in scored], pa.int32()), pa.array(where, place)],
                ["id", "score", "predicted", "sentences"],
            )

    out = docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind.simpleString()}, score double, predicted int, sentences array<struct<start: int, end: int, score: double>>"
    )
    return out.withColumnRenamed("id", id_col)


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold. Nothing is shuffled.

    Null, empty and wordless texts score the leak; very long ones are scored whole.
    Repeated rows are judged each, so they stay or go together; null ids and columns of
    any name pass through; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        model = sent.value
        for batch in batches:
            clean = [model.score(t.as_py() or "")[0] < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
