"""SentencePiece encoding and decoding in batched numpy, from a model file.

Texts are cut where no piece can cross (before a run of word marks), so the units are
words. Each distinct unit of a block of documents is encoded once: units of equal
length form a matrix and advance together. A unit's substrings have polynomial hashes,
and these probe the sorted hashes of the pieces.

* `unigram` models: Viterbi. For each end, all lengths are tried for all units at once;
  vectorised maxima keep the best score and the backpointer.
* `bpe` models: their ids are defined by merging in order of rank, and the path of the
  largest sum of scores is a different one. A symbol of a unit is then known by its first
  character; in each round every unit merges its best pair (vectorised maxima, leftmost of
  equals), and only the two neighbouring pairs are probed again.

Characters without a piece become their UTF-8 bytes' pieces, or the unknown piece in
models without byte fallback.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import chain

import numpy as np

from .common import coded

MARK = "▁"
_BASE = np.uint64(0x100000001B3)
#: Longer units are encoded one by one; the result is the same.
BATCHED_LENGTH = 128
#: Units whose ids are remembered between blocks; a matter of speed only.
REMEMBERED = 500_000
NO_PIECE = np.float64(-np.inf)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _char_values(points: np.ndarray) -> np.ndarray:
    """Code points as well-spread odd-looking numbers, so that sums of powers do not cancel."""
    return _spread(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Model:
    """kind: 'unigram' or 'bpe'; types as in model files: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""

    kind: str
    pieces: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool = True
    byte_fallback: bool = True
    usable: dict[str, int] = field(init=False)
    known: dict[str, bytes] = field(init=False, default_factory=dict)

    def __post_init__(self):
        if 4 in self.types:
            raise ValueError("this encoder takes no models with user-defined pieces, which are matched before all others")
        self.usable = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == 1}
        self.unknown = next((i for i, t in enumerate(self.types) if t == 2), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == 6}
        self.longest = max(map(len, self.usable), default=1)
        #: no piece has a mark after another character, so units can be cut before marks
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.usable)
        self.unknown_score = min((self.scores[i] for i in self.usable.values()), default=0.0) - 10.0
        names = list(self.usable)
        hashes = np.array([self._hash(n) for n in names], np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        if len(self.keys) > 1 and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.key_ids = np.array([self.usable[n] for n in names], np.int64)[order]
        self.key_points = [np.frombuffer(names[i].encode("utf-32-le"), np.uint32) for i in order]
        self.score_of = np.array(self.scores, np.float64)
        #: scores by their order, equal ones alike; -1 where there is no piece (the last entry, which -1 reads)
        self.priority = np.append(np.unique(self.score_of, return_inverse=True)[1], -1).astype(np.int32)
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in self.usable.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.decoded = [b"" if t == 3 else bytes([int(p[3:5], 16)]) if t == 6 else b" \xe2\x81\x87 " if t == 2 else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]

    @staticmethod
    def _hash(text: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for v in _char_values(np.frombuffer(text.encode("utf-32-le"), np.uint32)):
            h = h * _BASE + v
        return _spread(h)[0]

    @classmethod
    def from_file(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        kind = {1: "unigram", 2: "bpe"}.get(m.trainer_spec.model_type)
        n = m.normalizer_spec
        if kind is None or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this encoder takes unigram and bpe models with identity normalisation that keep all white space")
        return cls(
            kind, [p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], n.add_dummy_prefix, m.trainer_spec.byte_fallback
        )

    # -- probing -------------------------------------------------------------------------

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is no such piece."""
        h = _spread(hashes)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, self.key_ids[at], -1)

    # -- units ---------------------------------------------------------------------------

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        text = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return _UNIT.findall(text) if self.cuts else [text]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, as 32-bit numbers."""
        out: list = [None] * len(units)
        by_length = defaultdict(list)
        for i, n in enumerate(map(len, units)):
            by_length[n].append(i)
        for length, members in by_length.items():
            if length > BATCHED_LENGTH and self.kind == "bpe":
                for i in members:
                    out[i] = np.array(self._one(units[i]), np.int32).tobytes()
                continue
            for start in range(0, len(members), 1 + 2_000_000 // length):
                part = members[start : start + 1 + 2_000_000 // length]
                points = np.frombuffer("".join([units[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                ids, ends = self._viterbi(points) if self.kind == "unigram" else self._merge(points)
                data, bounds = ids.astype(np.int32).tobytes(), [0, *(4 * ends).tolist()]
                for i, a, b in zip(part, bounds, bounds[1:], strict=False):
                    out[i] = data[a:b]
                starts = np.concatenate(([0], ends[:-1]))
                for k in np.flatnonzero(np.minimum.reduceat(ids, starts) < 0).tolist():
                    out[part[k]] = np.array(self._with_bytes(ids[starts[k] : ends[k]].tolist()), np.int32).tobytes()
        return out

    def _with_bytes(self, ids: list[int]) -> list[int]:
        """Replace -1 - c, which stands for the character c that has no piece."""
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.bytes[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:  # unknown characters in a row are one unknown piece
                out.append(self.unknown)
        return out

    def _prefixes(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = points.shape
        h = np.zeros((n, length + 1), np.uint64)
        values = _char_values(points)
        for j in range(length):
            h[:, j + 1] = h[:, j] * _BASE + values[:, j]
        powers = np.ones(length + 1, np.uint64)
        powers[1:] = np.cumprod(np.full(length, _BASE))
        return h, powers

    def _viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = points.shape
        h, powers = self._prefixes(points)
        best = np.full((n, length + 1), NO_PIECE)
        best[:, 0] = 0.0
        back = np.zeros((n, length + 1), np.int64)
        piece = np.full((n, length + 1), -1, np.int64)
        for end in range(1, length + 1):
            starts = np.arange(max(0, end - self.longest), end)
            ids = self.probe((h[:, [end]] - h[:, starts] * powers[end - starts]).ravel()).reshape(n, len(starts))
            scores = np.where(ids >= 0, self.score_of[ids], NO_PIECE)
            alone = ids[:, -1] < 0
            scores[alone, -1] = self.unknown_score  # any character can stand alone
            scores += best[:, starts]
            pick = scores.argmax(axis=1)
            rows = np.arange(n)
            best[:, end], back[:, end] = scores[rows, pick], starts[pick]
            chosen = ids[rows, pick]
            piece[:, end] = np.where(chosen >= 0, chosen, -1 - points[:, end - 1].astype(np.int64))
        at, used = np.full(n, length), np.zeros((n, length + 1), bool)
        rows = np.arange(n)
        while (open_ := at > 0).any():
            used[rows[open_], at[open_]] = True
            at[open_] = back[rows[open_], at[open_]]
        return piece[used], np.cumsum(used.sum(axis=1))

    def _merge(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = points.shape
        h, powers = self._prefixes(points)
        # a symbol is known by the column of its first character; where it ends the next one begins
        ids = self.single[points]
        after = np.broadcast_to(np.arange(1, length + 2, dtype=np.int32), (n, length + 1)).copy()
        before = np.broadcast_to(np.arange(-1, length, dtype=np.int32), (n, length + 1)).copy()
        pair = np.full((n, length), -1, np.int32)  # the piece that a symbol makes with the next one
        if length > 1:
            pair[:, :-1] = self.probe((h[:, 2:] - h[:, :-2] * powers[2]).ravel()).reshape(n, length - 1)
        rank = self.priority[pair]
        begins = np.ones((n, length), bool)
        live = np.arange(n)
        while True:
            ranks = rank[live]
            k = ranks.argmax(axis=1)
            going = ranks[np.arange(len(live)), k] >= 0
            live, k = live[going], k[going]
            if not len(live):
                break
            gone = after[live, k]
            end = after[live, gone]
            ids[live, k] = pair[live, k]
            after[live, k], before[live, end] = end, k
            begins[live, gone], rank[live, gone], rank[live, k] = False, -1, -1
            right, left = np.flatnonzero(end < length), np.flatnonzero(k > 0)
            row = np.concatenate([live[right], live[left]])
            first = np.concatenate([k[right], before[live[left], k[left]]])
            past = np.concatenate([after[live[right], end[right]], end[left]])
            found = self.probe(h[row, past] - h[row, first] * powers[past - first])
            pair[row, first], rank[row, first] = found, self.priority[found]
        return np.where(ids >= 0, ids, -1 - points.astype(np.int64))[begins], np.cumsum(begins.sum(axis=1))

    def _one(self, unit: str) -> list[int]:
        """A long unit by itself, with dictionaries."""
        get, scores = self.usable.get, self.scores
        n = len(unit)
        if self.kind == "unigram":
            best, back = [0.0] + [float("-inf")] * n, [(0, 0)] * (n + 1)
            for end in range(1, n + 1):
                for start in range(max(0, end - self.longest), end):
                    i = get(unit[start:end], -1)
                    s = scores[i] if i >= 0 else self.unknown_score if end - start == 1 else None
                    if s is not None and best[start] + s > best[end]:
                        best[end], back[end] = best[start] + s, (start, i if i >= 0 else -1 - ord(unit[start]))
            out, at = [], n
            while at:
                at, i = back[at]
                out.append(i)
            return self._with_bytes(out[::-1])
        nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(a: int) -> None:
            if a >= 0 and (b := nxt[a]) < n and (i := get(unit[a : end[b]])) is not None:
                heapq.heappush(heap, (-scores[i], a, end[b]))

        for a in range(n - 1):
            offer(a)
        gone = [False] * n
        while heap:
            _, a, e = heapq.heappop(heap)
            if gone[a] or (b := nxt[a]) >= n or end[b] != e:
                continue
            gone[b], end[a], nxt[a] = True, e, nxt[b]
            if nxt[b] < n:
                prev[nxt[b]] = a
            offer(prev[a])
            offer(a)
        out, a = [], 0
        while a < n:
            out.append(get(unit[a : end[a]], -1 - ord(unit[a])))
            a = nxt[a]
        return self._with_bytes(out)

    # -- texts ---------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; every distinct unit of the texts is encoded once."""
        units = [self.units(t) for t in texts]
        n_units = np.fromiter(map(len, units), np.int64, len(units))
        codes, distinct = coded(list(chain.from_iterable(units)))
        del units
        new = [u for u in distinct if u not in self.known]
        self.known.update(zip(new, self.encode_units(new), strict=True))
        each = list(map(self.known.__getitem__, distinct))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(each), np.int32)
        n = sizes[codes]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(int(n.sum()))]
        # a text's ids end where those of its last unit do
        return np.split(ids, np.concatenate(([0], ends))[np.cumsum(n_units)[:-1]]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters, control pieces nothing."""
        data = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


# ---------------------------------------------------------------------------- operators


def encode_documents(docs, model_file: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False):
    """One row per row of ``docs``: id_col, ids (array of int), n_tokens, ids_sha256 (of the ids as
    little-endian 32-bit numbers), round_trip (decoding gives the text back).

    The model file is read on the driver and its pieces are broadcast, a fixed few MB
    whatever the corpus. Null and empty texts have no ids and make the round trip. Texts
    that hold the word mark itself do not, as it decodes to a space. Very long texts and
    unbroken words are encoded whole. Repeated rows each; an empty table gives no rows;
    other columns are ignored.
    """
    import hashlib

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from .common import blocks

    kind = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(kind)
    m = Model.from_file(model_file)
    sent = docs.sparkSession.sparkContext.broadcast((m.kind, m.pieces, m.scores, m.types, m.dummy_prefix, m.byte_fallback))

    def run(batches):
        model = Model(*sent.value)
        for keys, texts in blocks(batches, 4_000_000):
            ids = model.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, arrow_id),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids]),
                    pa.array([model.decode(i) == t for i, t in zip(ids, texts, strict=True)]),
                ],
                ["id", "ids", "n_tokens", "ids_sha256", "round_trip"],
            )

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, ids array<int>, n_tokens long, ids_sha256 string, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded, model_file: str, id_col: str = "doc_id", ids_col: str = "ids"):
    """One row per row of ``encoded``: id_col, text.

    Null and empty lists give an empty text, nulls inside a list are skipped; very long
    ones one long text. Repeated rows each; an empty table gives no rows; other columns are
    ignored. Ids that the model does not have, negative ones too, end the query.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = encoded.schema[id_col].dataType
    arrow_id = to_arrow_type(kind)
    m = Model.from_file(model_file)
    sent = encoded.sparkSession.sparkContext.broadcast((m.kind, m.pieces, m.scores, m.types, m.dummy_prefix, m.byte_fallback))

    def known(ids, n):
        if len(ids) and not 0 <= ids.min() <= ids.max() < n:
            raise ValueError(f"ids from {ids.min()} to {ids.max()} of a model with {n} pieces")
        return ids

    def run(batches):
        model = Model(*sent.value)
        for batch in batches:
            texts = [model.decode(known(np.array([x for x in i or [] if x is not None], np.int64), len(model.pieces))) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow_id), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"id {kind.simpleString()}, text string").withColumnRenamed("id", id_col)
