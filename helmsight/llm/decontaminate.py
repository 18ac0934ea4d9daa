"""Benchmark decontamination over a distributed positional inverted index.

`build_index` cuts the documents into segments of a bounded number of characters.
A segment row holds its own inverted index: the sorted terms and, for each, the
positions at which it occurs. Terms are never gathered across segments, so a word
that every document holds makes no task larger than its segment. The index is a
table in the shared folder and can be searched again.

`search` sends a block of benchmark phrases to all segments. In each, all phrases start
together from the positions of their rarest terms and keep those that the offset-adjusted
positions of their other terms confirm, from rare to frequent. `proximity` finds places
where all terms of a query lie within so many words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, blocks, coded, discard, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text or ""))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_chars: int = 3_000_000) -> DataFrame:
    """Positional inverted index of ``docs``, one row per segment; written to the shared folder.

    Positions number the words of the segment's documents one after the other, with
    one number left out between documents, so no run of positions crosses documents.
    Null and empty texts have no positions; a very long text is a segment by itself;
    repeated rows are documents each; an empty table gives no segments.
    """
    kind = docs.schema[id_col].dataType
    ids = T.ArrayType(kind)

    def index(batches):
        for keys, texts in blocks(batches, segment_chars):
            each = [words(t) for t in texts]
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            starts = np.concatenate(([0], np.cumsum(lengths + 1))).astype(np.int32)
            codes, terms = coded([w for ws in each for w in ws])
            where = np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(len(each), dtype=np.int32), lengths)
            order = np.argsort(codes.astype(np.int32), kind="stable")
            offsets = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(terms))))).astype(np.int32)
            positions = where[order]
            gaps = np.diff(positions, prepend=np.int32(0))  # small numbers, which compress
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]),
                    pa.array([keys], pa.list_(id_type)),
                    pa.array([terms], pa.list_(pa.string())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (starts, offsets, gaps)),
                ],
                ["segment", "ids", "terms", "starts", "offsets", "gaps"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    schema = T.StructType(
        [T.StructField("segment", T.StringType()), T.StructField("ids", ids), T.StructField("terms", T.ArrayType(T.StringType()))]
        + [T.StructField(n, T.BinaryType()) for n in ("starts", "offsets", "gaps")]
    )
    return written(docs.select(id_col, text_col).mapInArrow(index, schema), "postings")


class Segment:
    """One row of the index, opened."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda name: batch.column(batch.schema.get_field_index(name))[row]
        ints = lambda name: np.frombuffer(get(name).as_py(), np.int32)
        self.name = get("segment").as_py()
        self.ids = get("ids").as_py()
        self.terms = get("terms").values
        self.starts, self.offsets = ints("starts"), ints("offsets")
        self.positions = np.cumsum(ints("gaps"), dtype=np.int32)
        self.postings_in_order = np.repeat(np.arange(len(self.offsets) - 1, dtype=np.int64) << 32, np.diff(self.offsets)) + self.positions

    def find(self, vocabulary: pa.Array) -> np.ndarray:
        """The segment's number of each word, -1 where it has none."""
        at = pc.index_in(vocabulary, value_set=self.terms)
        return at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.offsets[term] : self.offsets[term + 1]]

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1

    def phrases(self, terms: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """terms: a row of term numbers a phrase. Pairs (row, position) at which a row's terms follow one another.

        Postings of rarest terms are taken ``most`` at a time, or those of one phrase.
        """
        held = self.offsets[terms + 1] - self.offsets[terms]
        order = np.argsort(held, axis=1, kind="stable")
        row = np.arange(len(terms))
        rarest = terms[row, order[:, 0]]
        first, n = self.offsets[rarest].astype(np.int64), held[row, order[:, 0]].astype(np.int64)
        cuts = np.cumsum(n) // most
        for part in np.split(row, np.flatnonzero(np.diff(cuts)) + 1):
            own = np.repeat(part, n[part])
            at = np.arange(len(own)) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + first[own]
            start = self.positions[at].astype(np.int64) - order[own, 0]
            for k in range(1, terms.shape[1]):
                place = order[own, k]
                ok = self.holds(terms[own, place], start + place)
                own, start = own[ok], start[ok]
                if not len(own):
                    break
            yield own, start

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether terms have positions: both sorted together, as the postings are."""
        want = (terms << 32) + positions
        at = np.searchsorted(self.postings_in_order, want)
        at[at == len(self.postings_in_order)] = 0
        return self.postings_in_order[at] == want

    def near(self, terms: np.ndarray, within: int) -> np.ndarray:
        """Last positions of stretches of at most ``within`` words that hold all terms, in any order."""
        held = [self.postings(t) for t in terms]
        if not all(map(len, held)):
            return np.empty(0, np.int32)
        ends = np.unique(np.concatenate(held)).astype(np.int64)
        first = ends.copy()
        for own in held:
            at = np.searchsorted(own, ends, side="right") - 1
            first = np.minimum(first, np.where(at >= 0, own[np.maximum(at, 0)].astype(np.int64), -(2**40)))
        ok = ends - first < within
        ends, first = ends[ok], first[ok]
        return ends[self.document(ends) == self.document(first)]


def phrase_blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """Rows (block, bytes, items), a written table: the items (id as a string, text) of each partition cut into blocks of at most so many bytes, or of one larger item.

    Cut where they lie: the driver sees no item.
    """

    def cut(batches):
        part, n = TaskContext.get().partitionId() << 32, 0
        names, texts, size = [], [], 0

        def block():
            entries = pa.array([[{"name": a, "text": b} for a, b in zip(names, texts, strict=True)]], pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())])))
            return pa.RecordBatch.from_arrays([pa.array([part + n]), pa.array([size], pa.int64()), entries], ["block", "bytes", "items"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                own = len(text.encode("utf-8", "surrogatepass"))
                if names and size + own > most:
                    yield block()
                    names, texts, size, n = [], [], 0, n + 1
                names.append("null" if key is None else str(key))
                texts.append(text)
                size += own
        if names:
            yield block()

    return written(items.select(id_col, text_col).mapInArrow(cut, "block long, bytes long, items array<struct<name: string, text: string>>"), "phrases")


def _chunks(phrases: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The items of neighbouring blocks of together at most so many bytes (or one larger block), one lot at a time."""
    lots, size = [[]], 0
    for block, own in sorted((r.block, r.bytes) for r in phrases.select("block", "bytes").collect()):  # two numbers a block
        if lots[-1] and size + own > most:
            lots.append([])
            size = 0
        lots[-1].append(block)
        size += own
    for lot in lots:
        rows = phrases.filter(F.col("block").isin(lot)).select("items").collect() if lot else []
        yield [(x.name, x.text) for r in rows for x in r["items"]]


def search(index: DataFrame, chunk: list[tuple], window: int = 10) -> DataFrame:
    """Rows (segment, ordinal, hits, items), one per document with hits: the numbers of its words that lie inside
    any occurrence of a window of any item of the chunk, and these items (ids as strings).

    chunk: (id, text). A window is ``window`` words that follow one another, or all of an item that
    has fewer. Null and empty texts have no windows; an item without an id is named "null"; items that
    repeat an id count once. No index and no items: no rows. The chunk's words go to all tasks as numbers.
    """
    each = [words(text) for _, text in chunk]
    codes, vocabulary = coded([w for ws in each for w in ws])
    names = ["null" if key is None else str(key) for key, _ in chunk]
    sent = index.sparkSession.sparkContext.broadcast((pa.array(vocabulary, pa.string()), codes.astype(np.int32), np.array([len(ws) for ws in each], np.int64), names))
    del each

    def windows(lengths: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(size, first words, items) of all windows, by their size."""
        size = np.minimum(lengths, window)
        n = np.where(lengths > 0, lengths - size + 1, 0)
        item = np.repeat(np.arange(len(lengths)), n)
        first = (np.cumsum(lengths) - lengths)[item] + np.arange(len(item)) - (np.cumsum(n) - n)[item]
        return [(int(k), first[size[item] == k], item[size[item] == k]) for k in np.unique(size[item])]

    def run(batches):
        vocabulary, codes, lengths, names = sent.value
        every = windows(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                s = Segment(batch, row)
                number = s.find(vocabulary)[codes] if len(codes) else np.empty(0, np.int64)
                missing = np.concatenate(([0], np.cumsum(number < 0)))
                hit, found = np.zeros(int(s.starts[-1]) + 1, bool), []
                for size, first, item in every:
                    here = np.flatnonzero(missing[first + size] == missing[first])
                    for some in np.split(here, range(200_000, len(here), 200_000)):
                        for own, start in s.phrases(number[first[some, None] + np.arange(size)]):
                            for step in range(size):
                                hit[start + step] = True
                            found.append(np.unique(s.document(start) * len(names) + item[some[own]]))
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                owner = s.document(at)
                docs = np.unique(owner)
                bounds = np.searchsorted(owner, np.append(docs, len(s.ids)))
                pairs = np.unique(np.concatenate(found))
                items = [sorted({names[i] for i in pairs[slice(*np.searchsorted(pairs, [d * len(names), (d + 1) * len(names)]))] % len(names)}) for d in docs.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s.name] * len(docs)),
                        pa.array(docs, pa.int32()),
                        pa.array([at[a:b] - s.starts[d] for d, a, b in zip(docs, bounds, bounds[1:], strict=False)], pa.list_(pa.int32())),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["segment", "ordinal", "hits", "items"],
                )

    out = index.mapInArrow(run, "segment string, ordinal int, hits array<int>, items array<string>")
    out._helmsight_sent = sent
    return out


def _found(index: DataFrame, chunk: list[tuple], window: int) -> DataFrame:
    """`search`, written; what was sent to the tasks is given up."""
    hits = search(index, chunk, window)
    out = written(hits, "hits")
    hits._helmsight_sent.destroy()
    return out


def documents_of(index: DataFrame, id_type: T.DataType) -> DataFrame:
    """Rows (segment, ordinal, doc, n_words), one per document of an index."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(id_type)

    def run(batches):
        for batch in batches:
            for name, ids, starts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                n = len(ids.values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(range(n), pa.int32()), ids.values.cast(arrow_type), pa.array(np.diff(np.frombuffer(starts, np.int32)).astype(np.int64) - 1)],
                    ["segment", "ordinal", "doc", "n_words"],
                )

    return index.select("segment", "ids", "starts").mapInArrow(run, f"segment string, ordinal int, doc {id_type.simpleString()}, n_words long")


def proximity(index: DataFrame, queries: dict[str, list[str]], id_type: T.DataType, within: int) -> DataFrame:
    """Rows (doc, query, ends): where all words of a query lie within so many words, in any order.

    ends are the numbers of last words. A word that a query repeats counts once; queries
    without words find nothing; repeated documents are reported each. Of many queries,
    give those of one call a bounded size: they go to all tasks.
    """
    asked = {name: [ascii_lower(w) for w in dict.fromkeys(ws)] for name, ws in queries.items() if ws}

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                s = Segment(batch, row)
                docs, names, ends = [], [], []
                for name, ws in asked.items():
                    terms = s.find(pa.array(ws, pa.string()))
                    found = s.near(terms, within) if (terms >= 0).all() else np.empty(0, np.int32)
                    owner = s.document(found)
                    for d in dict.fromkeys(owner.tolist()):
                        docs.append(s.ids[d])
                        names.append(name)
                        ends.append((found[owner == d] - s.starts[d]).tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, arrow_type), pa.array(names, pa.string()), pa.array(ends, pa.list_(pa.int32()))], ["doc", "query", "ends"]
                )

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(id_type)
    return index.mapInArrow(run, f"doc {id_type.simpleString()}, query string, ends array<int>")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    chunk_bytes: int = 8_000_000,
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, hits, items.

    Benchmarks of any size are taken in blocks of ``chunk_bytes``, each broadcast and
    searched against the whole index; blocks only add hits, so their union is exact. Blocks
    are cut in the tasks that read the benchmark, however its partitions are; the driver
    takes one at a time, which costs it some 20 times its bytes for a moment, and a task 10
    times. An item larger than a block is one by itself.

    * null and empty texts have no words, no hits and no items; null and empty items match nothing;
    * items that repeat a text all count, items that repeat an id count once, items without an id are named "null";
    * repeated rows of ``docs`` are told apart and reported each; null ids stay;
    * an empty benchmark leaves all documents clean; an empty table gives no rows;
    * other columns are ignored, whatever their names.

    The result is a written table; the index is deleted.
    """
    kind = docs.schema[id_col].dataType
    index = build_index(docs, id_col, text_col)
    phrases = phrase_blocks(benchmark, item_col, item_text_col, chunk_bytes)
    parts = [_found(index, chunk, window) for chunk in _chunks(phrases, chunk_bytes)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    gathered = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  one entry per block of the benchmark
    found = every.groupBy("segment", "ordinal").agg(gathered("hits"), gathered("items"))
    out = documents_of(index, kind).join(found, ["segment", "ordinal"], "left")
    none = lambda c, of: F.coalesce(c, F.array().cast(f"array<{of}>")).alias(c)
    out = written(out.select(F.col("doc").alias(id_col), "n_words", none("hits", "int"), none("items", "string")), "contamination")
    discard(index, phrases, *parts)
    return out
