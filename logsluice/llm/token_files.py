"""Token ids in binary files, plane by plane.

Documents are range-partitioned and sorted by id, so files in order hold them in order. Each task tokenizes its
texts and writes ids in fixed-size blocks; a block is transposed into byte or bit planes (the k-th byte or bit of every id
together), each plane is compressed with Zstandard on its own, and the file ends with a chunk index (where each
block's planes lie) and a document index (id and number of tokens of each document). A manifest lists the files and
their number of ids, from which the global start of each file follows.

Texts are tokenized chunk by chunk between white space; each distinct chunk goes through the tokenizers library once per worker and
cache life. That holds for tokenizers that never cross white space, lower ASCII letters and end words with a mark. Encoder tries
this on samples when it loads a file; with any other file, whole texts go through the library.

Defined results: a null or empty text has the end id alone; null ids come first; rows with one id follow each other in the order of
their texts; an empty table writes no file and gives an empty result; other columns are ignored. A task holds one
block of ids and one Arrow batch of texts.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, new_path, pieces, small_batches
from .files import Written, open_input

END_ID = 2
BLOCK = 1 << 16
FILE_IDS = 1 << 25
TASK_BYTES = 6 << 20
CACHE = 800_000
SLICE = 4 << 20
_MAGIC = b"TOKPLN01"
#: Letters, then ASCII punctuation but apostrophes: two words for the tokenizer.
_STEM = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
#: Samples on which a tokenizer must give the same ids for a whole and for its parts.
_SAMPLES = (("Ab", " ", "cde"), ("XY", "\t", "zÄé"), ("end", "", "."), ("Größe", "", "?!"), ("a", "", '"...'), ("word", "\n", "(x"), ("q", "  ", "r"))

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Texts to id arrays; keeps the ids of chunks already seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self.wide = max(vocabulary.values()) > 0xFFFF
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._seen: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        ids = lambda t: self._ids(t).tolist()
        self._in_chunks = all(ids(a + gap + b) == ids(a) + ids(b) and ids(a) == ids(a.lower()) and self._ends_word[ids(a)[-1]] for a, gap, b in _SAMPLES)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    @staticmethod
    def _plain(word: str) -> bool:
        """Whether the word stays one word of letters when it is lowered: a capital dotted I becomes a letter and a mark."""
        return word.isalpha() and (word.isascii() or len(low := word.lower()) == len(word) and low.isalpha())

    def _learn(self, chunks: list[str]) -> None:
        words: set[str] = set()
        split: list[tuple[str, str, str]] = []
        for c in chunks:
            if self._plain(c):
                words.add(c)
            elif (m := _STEM.fullmatch(c)) and self._plain(m[1]):
                words.update(m.groups())
                split.append((c, *m.groups()))
            else:
                self._seen[c] = self._ids(c).tobytes()
        new = [w for w in words if w not in self._seen]
        # words in one call; a word ends with the token that carries the end-of-word mark
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids = self._ids(" ".join(part))
            ends = (np.flatnonzero(self._ends_word[ids]) + 1) * ids.itemsize
            if len(ends) == len(part):
                raw, cuts = ids.tobytes(), [0, *ends.tolist()]
                self._seen.update((w, raw[x:y]) for w, x, y in zip(part, cuts, cuts[1:], strict=False))
            else:
                self._seen.update((w, self._ids(w).tobytes()) for w in part)
        for c, stem, tail in split:
            self._seen[c] = self._seen[stem] + self._seen[tail]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, without an end id. The texts are taken some megabytes at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while self._in_chunks and end < len(texts) and size < SLICE and "<|" not in texts[end]:
                size += len(texts[end])
                end += 1
            if end > at:
                yield from self._encode(pa.array(texts[at:end], pa.large_string()))
            else:  # the text may hold a special token, which is matched before letters are lowered
                yield self._ids(texts[end])
                end += 1
            at = end

    def _encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        known = list(map(self._seen.get, chunks))
        if None in known:
            if len(self._seen) > CACHE // 2:  # what was not used for a while goes
                self._old, self._seen = self._seen, {}
                known = [None] * len(chunks)
            missing = []
            for c, x in zip(chunks, known, strict=True):
                if x is None:
                    if (before := self._old.get(c)) is None:
                        missing.append(c)
                    else:
                        self._seen[c] = before
            self._learn(missing)
            known = list(map(self._seen.__getitem__, chunks))
        ids = np.frombuffer(b"".join(known), self.dtype)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = ids[np.repeat(starts[at] - (ends - n), n) + np.arange(total)]
        cuts = np.concatenate(([0], ends))[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        for x, y in zip(cuts, cuts[1:], strict=False):
            yield flat[x:y]


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte or bit planes of an array of unsigned integers, lowest first."""
    octets = ids.view(np.uint8).reshape(len(ids), ids.itemsize)
    if not bits:
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(ids.itemsize)]
    spread = np.unpackbits(octets, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(spread.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, dtype: np.dtype, bits: bool) -> np.ndarray:
    if not bits:
        return np.ascontiguousarray(np.array([np.frombuffer(p, np.uint8) for p in planes]).reshape(dtype.itemsize, n).T).view(dtype).ravel()
    rows = np.unpackbits(np.array([np.frombuffer(p, np.uint8) for p in planes]), axis=1, count=n, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little")).view(dtype).ravel()


class PlaneWriter:
    def __init__(self, folder: str, stem: str, dtype: np.dtype, bits: bool):
        self.out = Written(folder, stem, ".tok")
        self.out.write(_MAGIC)
        self._dtype, self._bits, self._zstd = dtype, bits, zstandard.ZstdCompressor(level=1)
        self._held, self._bytes = [], 0
        self._chunks: list[bytes] = []
        self._docs: list[tuple[int, int, int]] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append((doc_id or 0, doc_id is None, len(ids) // self._dtype.itemsize))
        self._held.append(ids)
        self._bytes += len(ids)
        if self._bytes >= BLOCK * self._dtype.itemsize:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        raw, size = b"".join(self._held), BLOCK * self._dtype.itemsize
        whole = len(raw) if rest else len(raw) // size * size
        for i in range(0, whole, size):
            ids = np.frombuffer(raw[i : i + size], self._dtype)
            planes = [self._zstd.compress(p) for p in to_planes(ids, self._bits)]
            self._chunks.append(struct.pack(f"<QI{len(planes)}I", self.out.size, len(ids), *map(len, planes)))
            self.n_ids += len(ids)
            for p in planes:
                self.out.write(p)
        self._held, self._bytes = [raw[whole:]], len(raw) - whole

    def close(self) -> tuple[str, int, int]:
        """The file's URI and its numbers of ids and documents."""
        self._flush(True)
        docs = np.array(self._docs, "<i8").reshape(-1, 3)
        index = self._zstd.compress(b"".join(self._chunks))
        listed = self._zstd.compress(np.ascontiguousarray(docs.T).tobytes())
        self.out.write(index)
        self.out.write(listed)
        self.out.write(struct.pack("<QQIIBB", len(index), len(listed), len(self._chunks), len(docs), self._dtype.itemsize, self._bits) + _MAGIC)
        self.out.close()
        return self.out.uri, self.n_ids, len(docs)


_TAIL = struct.calcsize("<QQIIBB") + len(_MAGIC)


def read_planes(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file, one block in memory at a time."""
    with open_input(uri) as file:
        size = file.size()
        file.seek(size - _TAIL)
        tail = file.read(_TAIL)
        if tail[-len(_MAGIC) :] != _MAGIC:
            raise ValueError(f"{uri} is no token file")
        n_index, n_listed, n_chunks, n_docs, width, bits = struct.unpack("<QQIIBB", tail[: -len(_MAGIC)])
        file.seek(size - _TAIL - n_listed - n_index)
        zstd = zstandard.ZstdDecompressor()
        planes = width * (8 if bits else 1)
        entry = struct.Struct(f"<QI{planes}I")
        chunks = list(entry.iter_unpack(zstd.decompress(file.read(n_index)))) if n_chunks else []
        docs = np.frombuffer(zstd.decompress(file.read(n_listed)), "<i8").reshape(3, n_docs) if n_docs else np.empty((3, 0), "<i8")
        dtype = np.dtype(f"<u{width}")
        held, at = np.empty(0, dtype), 0

        def more() -> np.ndarray:
            nonlocal at
            offset, n, *sizes = chunks[at]
            at += 1
            file.seek(offset)
            return from_planes([zstd.decompress(file.read(s)) for s in sizes], n, dtype, bool(bits))

        for doc_id, unnamed, n in docs.T.tolist():
            if len(held) < n:
                parts, have = [held], len(held)
                while have < n:
                    parts.append(more())
                    have += len(parts[-1])
                held = np.concatenate(parts)
            yield None if unnamed else doc_id, held[:n]
            held = held[n:]


MANIFEST = "part int, seq int, file string, n_ids long, n_docs long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, bits: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all texts below folder; the stored manifest: part, seq, file, n_ids, n_docs, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, writer = Encoder.at(tokenizer), TaskContext.get().partitionId(), 0, None
        end = np.array([end_id], encoder.dtype).tobytes()

        def row():
            uri, n_ids, n_docs = writer.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [uri], "n_ids": [n_ids], "n_docs": [n_docs]})

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                writer = writer or PlaneWriter(folder, f"tokens-{part:06d}-{seq:04d}", encoder.dtype, bits)
                writer.add(doc_id, ids.tobytes() + end)
                if writer.n_ids >= FILE_IDS:
                    yield row()
                    writer, seq = None, seq + 1
        if writer:
            yield row()

    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = rows.repartitionByRange(pieces(docs, TASK_BYTES), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(placed.mapInArrow(run, MANIFEST), "token-manifest")
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                start, rows = f["start"], []
                for doc_id, ids in read_planes(f["file"]):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.tolist() if with_ids else None))
                    start += len(ids)
                    if len(rows) == 1000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    def out(rows) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            arrays, names = [*arrays, pa.array(cols[4], pa.list_(pa.int64()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    files = max(1, manifest.count())
    return manifest.select("file", "start").repartition(files, "file").mapInArrow(run, schema)


def token_round_trip(docs: DataFrame, tokenizer: str, bits: bool = False) -> DataFrame:
    folder = new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, bits=bits))
