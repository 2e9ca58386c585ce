"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A text, with a space put in front, is cut before every space and newline; no piece crosses such a cut but pieces of
several spaces, which are not used. Each part is a lattice whose arcs are the vocabulary's pieces; characters without
a piece are read byte by byte. A piece weighs rank ** -alpha by its rank in the vocabulary's scores (the model holds
merge ranks, no probabilities). Forward filtering gives every lattice node the weight of all readings up to it. It
depends on what precedes the node alone, so the lattices of all parts share one prefix tree that a worker keeps.
Backward sampling then draws arcs from each part's end, for all parts of a batch at once; the random numbers
are a hash of seed, row key, part and step, so a row's segmentation is the same on every run and cluster.
alpha = inf takes the best arc instead of a draw.

A space that the text itself writes as the vocabulary's space mark is read byte by byte, so decoding returns exactly the text.

Defined results: a null text is empty and has no ids; a null key is a key like any other; repeated rows get equal ids; an empty
table gives an empty result; other columns are ignored. A task holds some megabytes of text and a tree of bounded size.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = "▁"
#: Nodes of the tree before it is started anew, characters of text drawn at once, and ids sent on at once.
NODES = 300_000
#: Characters of a part from which its weights are kept as logarithms.
LONG = 40
SLICE = 1 << 19
OUT_IDS = 1 << 18

_segmenters: dict[tuple, Segmenter] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Segmenter:
    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self._alpha = alpha
        self._piece: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = [b""] * n
        self._byte = [0] * 256
        rank = {i: r + 1 for r, i in enumerate(sorted(range(n), key=lambda i: (-model.get_score(i), i)))}
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self._byte[int(text[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(text[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)) and SPACE not in text[1:]:
                self._piece[text] = (i, rank[i] ** -(1.0 if math.isinf(alpha) else alpha))
                self.bytes_of[i] = text.replace(SPACE, " ").encode()
        # every ending of a piece: (id, weight) if it is a piece itself, else None
        self._ending: dict[str, tuple[int, float] | None] = {p[i:]: None for p in self._piece for i in range(len(p))}
        self._ending.update(self._piece)
        self._reset()

    @classmethod
    def at(cls, path: str, alpha: float) -> Segmenter:
        if (path, alpha) not in _segmenters:
            _segmenters[path, alpha] = cls(path, alpha)
        return _segmenters[path, alpha]

    def _reset(self) -> None:
        self._end: dict[str, int] = {"": 0}  # node of a part read so far
        self._weight = array("d", [1.0])  # of all readings up to the node
        # arcs into node v: first[v] .. first[v + 1], node 0 starts every part; cum: running weight of the arcs,
        # made into v + share once the nodes of a batch are complete
        self._first, self._before, self._id, self._cum = array("q", [0, 0]), array("i"), array("i"), array("d")
        self._shared = 1  # nodes whose cum is made into shares

    def _close(self, weight: float) -> int:
        """Ends the node whose arcs were added last."""
        self._weight.append(weight)
        self._first.append(len(self._before))
        return len(self._weight) - 1

    def _only(self, before: int, piece: int, weight: float = 1.0) -> int:
        """A new node with one arc."""
        self._before.append(before)
        self._id.append(piece)
        total = self._weight[before] * weight
        self._cum.append(total)
        return self._close(total)

    def _bytes(self, v: int, c: str) -> int:
        for b in c.encode("utf-8", "replace"):
            v = self._only(v, self._byte[b])
        return v

    def _grow(self, part: str) -> int:
        """The end node of a part (a leading space written as the mark); adds the nodes it lacks."""
        ends, n = self._end, len(part)
        have = n - 1
        while part[:have] not in ends:
            have -= 1
        path: list[int] = [-1] * (n + 1)
        path[have] = ends[part[:have]]
        ending, weight, best = self._ending, self._weight, math.isinf(self._alpha)
        before, ids, cum = self._before, self._id, self._cum
        for e in range(have + 1, n + 1):
            total, top, s = 0.0, 0.0, e - 1
            while s >= 0 and (hit := ending.get(part[s:e], 0)) != 0:
                if hit is not None:
                    if (v := path[s]) < 0:
                        v = path[s] = ends[part[:s]]
                    w = weight[v] * hit[1]
                    if not best:
                        total += w
                        before.append(v)
                        ids.append(hit[0])
                        cum.append(total)
                    elif w > top:
                        total = top = w
                        arc = v, hit[0]
                s -= 1
            if best and total:
                before.append(arc[0])
                ids.append(arc[1])
                cum.append(total)
            if ending.get(part[e - 1]) is None:  # no piece reads this character alone
                if total:
                    raise ValueError(f"the vocabulary has a longer piece but none for {part[e - 1]!r} alone")
                if (v := path[e - 1]) < 0:
                    v = path[e - 1] = ends[part[: e - 1]]
                v = self._bytes(v, part[e - 1])
            else:
                v = self._close(total)
            ends[part[:e]] = path[e] = v
        return path[n]

    def _grow_long(self, part: str) -> int:
        """As _grow, for parts so long that weights would underflow: each node's weight counts relative to its own."""
        logs, path, first = [0.0], [0], math.isinf(self._alpha)
        for e in range(1, len(part) + 1):
            arcs, s = [], e - 1
            while s >= 0 and (hit := self._ending.get(part[s:e], 0)) != 0:
                if hit is not None:
                    arcs.append((logs[s] + math.log(hit[1]), path[s], hit[0]))
                s -= 1
            if arcs:
                most = max(arcs)[0]
                total = 0.0
                for x, v, i in [max(arcs)] if first else arcs:
                    total += math.exp(x - most)
                    self._before.append(v)
                    self._id.append(i)
                    self._cum.append(total)
                path.append(self._close(total))
                logs.append(most + (0.0 if first else math.log(total)))
            else:
                path.append(self._bytes(path[-1], part[e - 1]))
                logs.append(logs[-1])
        self._end[part] = path[-1]
        return path[-1]

    def _share(self) -> None:
        """Turns the running weights of new nodes into node + share, which rise over all arcs."""
        n, old = len(self._weight), self._shared
        if n > old:
            first = np.array(self._first[old:], np.int64)
            cum = np.array(self._cum[first[0] :])
            node = np.repeat(np.arange(old, n), np.diff(first))
            last = np.repeat(cum[first[1:] - first[0] - 1], np.diff(first))
            self._cum[first[0] :] = array("d", (node + cum / np.where(last > 0, last, 1.0) * 0.999999).tobytes())
            self._shared = n

    def encode(self, texts: list[str], keys: np.ndarray, seed: int = 0) -> Iterator[np.ndarray]:
        """The ids of each text; keys: one unsigned 64-bit integer per text."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < SLICE:
                size += len(texts[end])
                end += 1
            yield from self._encode(texts[at:end], keys[at:end], seed)
            at = end

    def _encode(self, texts: list[str], keys: np.ndarray, seed: int) -> Iterator[np.ndarray]:
        # a part after a space holds no leading mark yet; a newline starts a part of its own
        spaced = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n")
        lists = pc.split_pattern(spaced, " ")
        coded = lists.flatten().dictionary_encode()
        parts = coded.dictionary.to_pylist()
        if len(self._weight) > NODES:
            self._reset()
        nodes = np.array([self._part(p) for p in parts], np.int64)
        self._share()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        counts = np.diff(offsets)
        cur = nodes[coded.indices.to_numpy()] if len(parts) else np.empty(0, np.int64)
        place = np.arange(len(cur)) - np.repeat(offsets[:-1], counts)
        # an empty text is one empty part, which has nothing to encode
        empty = np.array([not t for t in texts], bool)
        cur = np.where(np.repeat(empty, counts), 0, cur)
        noise = _mixed(np.repeat(_mixed(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)), counts) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first, before, piece, cum = np.frombuffer(self._first, np.int64), np.frombuffer(self._before, np.int32), np.frombuffer(self._id, np.int32), np.frombuffer(self._cum)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        who = np.flatnonzero(cur)
        cur = cur[who]
        t = 0
        taken = np.zeros(len(place), np.int64)
        while len(who):
            arc = first[cur]
            choice = np.flatnonzero(first[cur + 1] - arc > 1)
            t += 1
            if len(choice):
                draw = (_mixed(noise[who[choice]] + np.uint64(t * 0xA0761D6478BD642F % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                arc[choice] = np.minimum(np.searchsorted(cum, cur[choice] + draw * 0.999999, "right"), first[cur[choice] + 1] - 1)
            steps.append((who, piece[arc]))
            taken[who] += 1
            cur = before[arc].astype(np.int64)
            more = cur > 0
            who, cur = who[more], cur[more]
        del first, before, piece, cum  # the arrays must be free to grow again
        ends = np.cumsum(taken)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        left = ends.copy()
        for who, ids in steps:  # from the end of each part
            left[who] -= 1
            flat[left[who]] = ids
        cuts = np.concatenate(([0], ends))[offsets].tolist()
        for x, y in zip(cuts, cuts[1:], strict=False):
            yield flat[x:y]

    def _part(self, p: str) -> int:
        """p: what follows a space, or starts with a newline."""
        name = p if p[:1] == "\n" else SPACE + p
        v = None if SPACE in p else self._end.get(name)
        if v is not None:
            return v
        if SPACE in p:
            return self._grow_bytes(p)
        return self._grow(name) if len(name) <= LONG else self._grow_long(name)

    def _grow_bytes(self, p: str) -> int:
        """A part that holds the vocabulary's mark as text, which no piece may read: byte by byte. Its name
        starts with a space, as no other does."""
        if (v := self._end.get(" " + p)) is None:
            v = self._end[" " + p] = self._bytes(0 if p[:1] == "\n" else self._only(0, self._piece[SPACE][0]), p)
        return v

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids encode: their bytes without the space put in front."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def encode_pieces(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = True, check: bool = True) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), text_crc32 (of the decoded text
    in UTF-8), lossless (the decoded text is the text), and with_ids the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter.at(model, alpha)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys = batch.column(2).to_numpy().astype(np.int64).view(np.uint64)
            rows, ids_of, size, at = [], [], 0, 0
            for t, ids in zip(texts, segmenter.encode(texts, keys, seed), strict=True):
                back = segmenter.decode(ids) if check else t
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode("utf-8", "replace")), back == t))
                ids_of.append(ids if with_ids else ids[:0])
                size += len(ids)
                if size >= OUT_IDS:  # a batch of results need not be as large as one of texts
                    yield out(batch.column(0).slice(at, len(rows)), rows, ids_of)
                    at += len(rows)
                    rows, ids_of, size = [], [], 0
            if rows:
                yield out(batch.column(0).slice(at, len(rows)), rows, ids_of)
            pa.default_memory_pool().release_unused()  # workers live on between stages

    def out(ids, rows, ids_of) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        arrays = [ids.cast(pa.int64()), *(pa.array(c, x) for c, x in zip(cols, types, strict=True))]
        names = ["doc_id", "n_pieces", "ids_crc32", "text_crc32", "lossless"]
        if with_ids:
            offsets = pa.array(np.cumsum([0, *map(len, ids_of)]), pa.int32())
            arrays, names = [*arrays, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids_of), pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean" + (", ids array<int>" if with_ids else "")
    return small_batches(docs).select(F.col(key), F.col(text), F.xxhash64(F.col(key).cast("string")).alias("k")).mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: doc_id and the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter.at(model, 1.0)
        for batch in batches:
            texts = [segmenter.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(key, ids).mapInArrow(run, "doc_id long, text string")
