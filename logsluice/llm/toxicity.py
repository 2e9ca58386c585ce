"""Toxicity scores over deobfuscated text.

1. A character language model: trigram counts over all documents, added up from per-task counts (the
   alphabet is fixed, so the table is bounded whatever the input).
2. Restoring: stretches that may be disguised (tokens of letters and leetspeak signs, letters repeated three times or
   more, words spelled letter by letter) become a lattice of readings, in which every sign may also stand for itself. Viterbi
   decoding finds the reading with the best sum of language-model and channel scores, in time linear in the stretch, whatever its
   length. All other text reads as itself; so do tokens of digits alone, which are numbers.
3. A classifier over restored words: whole words and word beginnings that (almost) only toxic labels have, in
   enough texts that are not copies of each other, so a group of copies cannot bring in its incidental words. Enough is where
   chance would give no more than CHANCE of all features of toxic texts so many texts without a clean one. It
   is fitted on a bounded sample of the labelled rows (TOXIC_SAMPLE, CLEAN_SAMPLE rows; all where there are
   fewer; rows equal in id and text count once). The score is the noisy-or of the features found.

Rows with crc32(id) mod 3 = 1 are held out of the fit. Labels, language, source and id are never inputs of a score.

Defined results: a null or empty text has the score of a text without features; a null id is not held out; repeated
rows are scored each; without labels, or with labels of one kind, every score is the share of toxic labels (0
without any); an empty table gives an empty result; other columns are ignored. Whole texts are read; a task
holds one Arrow batch.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, small_batches

TOXIC_SAMPLE, CLEAN_SAMPLE = 4_000, 12_000
THRESHOLD = 0.7
LEAST_PRECISION = 0.9
CHANCE = 1.0

#: Character classes: 0 is anything but a letter, then a-z, these letters, and one class for all others.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
CLASSES = len(_LETTERS) + 2
_CLASS_OF = {c: i + 1 for i, c in enumerate(_LETTERS)}

# The letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
    "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c",
}
_WILD = "*#"
_VOWELS = "aeiou"
#: Channel costs in nats: reading a sign as a letter, a wild sign as a vowel, dropping a sign within or at the edge of
#: a word, dropping a gap between spelled letters or reading it as a space, shortening a run of letters, keeping a sign.
SIGN, WILD, DROP, EDGE, GAP, WORD_GAP, RUN, KEEP = 1.0, 3.0, 14.0, 2.0, 0.2, 3.0, 0.5, 2.5
#: Readings of stretches up to this length are kept for later ones.
KEPT_LENGTH = 64

_SIGNS = re.compile(r"[0-9@$!|+€(*#]+(?=[^\W\d_])|[0-9@$]+")
_TRIPLES = tuple(c * 3 for c in _LETTERS)
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*·/,;:~=\\]{1,3}[^\W_@$!|+]|[ .\-_*·/,;:~=\\]{1,3}[@$!|+](?=[ .\-_*·/,;:~=\\])){2,}(?![^\W_])")
_WORD = re.compile(r"[^\W\d_]+")
_IN_TOKEN = frozenset("0123456789@$!|+€(*#")


def _class_table() -> np.ndarray:
    table = np.array([0 if not chr(i).isalpha() else CLASSES - 1 for i in range(0x250)] + [CLASSES - 1], np.int32)
    for c, i in _CLASS_OF.items():
        table[ord(c)] = table[ord(c.upper()) if len(c.upper()) == 1 and ord(c.upper()) < 0x250 else ord(c)] = i
    return table


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n) of all character trigrams of all texts."""
    table = _class_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            joined = "\n\n".join(t for t in batch.column(0).to_pylist() if t)
            for i in range(0, len(joined), 1 << 22):  # two characters of overlap
                points = np.frombuffer(joined[max(0, i - 2) : i + (1 << 22)].encode("utf-32-le", "replace"), np.uint32)
                c = table[np.minimum(points, 0x250)]
                if len(c) > 2:
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["code", "n"])

    return small_batches(docs).select(text).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(c | a, b) for all classes, interpolated over orders; the table has CLASSES**3 entries at most."""
    n = np.zeros(CLASSES**3)
    rows = trigram_counts(docs, text).collect()  # at most CLASSES**3 rows
    if rows:
        n[[r[0] for r in rows]] = [r[1] for r in rows]
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
    two = (n.sum(0) + 5 * one) / (n.sum((0, 2))[:, None] + 5)
    return np.log((n + 5 * two[None]) / (n.sum(2)[:, :, None] + 5))


class Restorer:
    """Reads texts as the language model most likely means them."""

    def __init__(self, model: np.ndarray):
        self._logs = model.tolist()
        self._kept = lru_cache(50_000)(self._decode)

    def decode(self, s: str) -> str:
        return self._kept(s) if len(s) <= KEPT_LENGTH else self._decode(s)

    def arcs(self, s: str) -> list[list[tuple[int, str, float]]]:
        """From each place: (next place, what is read, channel cost)."""
        arcs: list[list[tuple[int, str, float]]] = []
        end = 0  # of the run of equal letters around the place
        for i, c in enumerate(s):
            here: list[tuple[int, str, float]] = []
            if c.isalpha():
                here.append((i + 1, c, 0.0))
                if i >= end:
                    start = end = i
                    while end < len(s) and s[end] == c:
                        end += 1
                    if end - start >= 3:
                        here = [(end, c, RUN), (end, c * 2, RUN)]
                    elif end - start == 2:
                        here.append((end, c, 4 * RUN))
            else:
                here += [(i + 1, x, SIGN) for x in LEET.get(c, "")]
                if c in _WILD:
                    here += [(i + 1, x, WILD) for x in _VOWELS]
                if c in LEET or c in _WILD:
                    here += [(i + 1, "", DROP if 0 < i < len(s) - 1 else EDGE), (i + 1, c, KEEP)]
                else:
                    here += [(i + 1, "", GAP), (i + 1, " ", WORD_GAP)]
            arcs.append(here)
        return arcs

    def weight(self, a: int, b: int, read: str) -> tuple[float, int, int]:
        """The language model's score of what is read after classes a and b, and the last two classes then."""
        total = 0.0
        for c in read:
            z = _CLASS_OF.get(c) or (CLASSES - 1 if c.isalpha() else 0)
            total += self._logs[a][b][z]
            a, b = b, z
        return total, a, b

    def _decode(self, s: str) -> str:
        """The best reading of s by Viterbi over states (place, last two classes). A state keeps its score and a link to what was read."""
        at: list[dict[tuple[int, int], tuple[float, tuple | None]]] = [{} for _ in range(len(s) + 1)]
        at[0][0, 0] = (0.0, None)
        for i, arcs in enumerate(self.arcs(s)):
            for (a, b), (score, link) in at[i].items():
                for to, out, cost in arcs:
                    more, x, y = self.weight(a, b, out)
                    new = score - cost + more
                    old = at[to].get((x, y))
                    if old is None or new > old[0]:
                        at[to][x, y] = (new, (link, out))
            at[i] = {}
        link = max(((score + self._logs[a][b][0], n) for n, ((a, b), (score, _)) in enumerate(at[-1].items())), default=None)
        if link is None:
            return s
        link, read = list(at[-1].values())[link[1]][1], []
        while link is not None:
            link, out = link
            read.append(out)
        return "".join(reversed(read))

    @staticmethod
    def _tokens(low: str, pattern: re.Pattern, inside) -> Iterator[tuple[int, int]]:
        """The whole tokens around matches, each once: (start, end). Linear in the text."""
        done = 0
        while m := pattern.search(low, done):
            a, b = m.span()
            while a > done and inside(low[a - 1]):
                a -= 1
            while b < len(low) and inside(low[b]):
                b += 1
            yield a, b
            done = b

    def restore(self, text: str) -> str:
        """The text in lower case with disguised stretches replaced by their readings."""
        low = text.lower()
        found: list[tuple[int, int]] = [m.span() for m in _SPELLED.finditer(low)]
        for a, b in self._tokens(low, _SIGNS, lambda c: c.isalpha() or c in _IN_TOKEN):
            while a < b and low[a] in "!*#|+(" and not low[a + 1 : a + 2].isalpha():
                a += 1
            while a < b and low[b - 1] in "!*#|+(":
                b -= 1
            if not low[a:b].isdigit() and (b - a > 1):
                found.append((a, b))
        if any(t in low for t in _TRIPLES):
            found += self._tokens(low, _TRIPLE, str.isalpha)
        if not found:
            return low
        out, last = [], 0
        for a, b in sorted(set(found)):
            if a >= last:
                out += (low[last:a], self.decode(low[a:b]))
                last = b
        return "".join(out) + low[last:]


def features(restored: str) -> set[str]:
    """Words (with a closing $) and word beginnings of 4 to 6 letters."""
    out = set()
    for w in set(_WORD.findall(restored)):
        if len(w) > 2:
            out.add(w + "$")
            if len(w) > 3:
                out.update((w[:4], w[:5], w[:6]))
    return out


def held_out(key: str | Column = "doc_id") -> Column:
    crc = F.crc32(F.encode(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), "UTF-8"))
    return F.coalesce(crc % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, model, key: str = "doc_id", text: str = "text") -> tuple[dict[str, float], float]:
    """Feature weights (the chance that a text with the feature is toxic) and the chance without any feature.

    Everything that reaches the driver is bounded by the two sample sizes, which count rows (an id may have several)."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("__id")).agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(key).alias("__id"), row_key(text).alias("__row"), F.col(text).alias("text"))
    rows = texts.select("__id", "__row").join(known, "__id").distinct()
    rows = materialize(rows, "toxicity-labelled")
    drawn = [rows.where(F.col("toxic") == t).orderBy(F.xxhash64("__id", "__row"), "__id", "__row").limit(n) for t, n in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE))]
    total = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    sample = materialize(drawn[0].unionByName(drawn[1]), "toxicity-drawn")  # TOXIC_SAMPLE + CLEAN_SAMPLE thin rows at most
    drawn = texts.join(F.broadcast(sample), ["__id", "__row"]).groupBy("__id", "__row").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = materialize(drawn.select("text", "toxic").repartition(16), "toxicity-sample")

    def toxic_features(batches):
        restorer = Restorer(model.value)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(sorted(features(restorer.restore(t or ""))), pa.string())], names=["f"])

    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    seen_toxic, seen = total.get(1, 0), sum(total.values())
    if not toxic or not clean:
        return {}, seen_toxic / seen if seen else 0.0
    counts = materialize(rows.where("toxic = 1").select("text").mapInArrow(toxic_features, "f string").groupBy("f").count(), "toxicity-features")
    # a feature without a bearing has only toxic texts, k of them, with a chance of (share of toxic rows) ** k
    least = max(2, math.ceil(math.log(max(counts.count(), 1) / CHANCE) / math.log((toxic + clean) / toxic)))
    names = sorted(r[0] for r in counts.where(F.col("count") >= least).select("f").collect())
    index = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def listed(batches):
        restorer = Restorer(model.value)
        counted: Counter = Counter()
        schema = pa.schema([("toxic", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])
        packed = lambda xs: np.array(xs, np.int32).tobytes()
        for batch in batches:
            out = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = [index.value[f] for f in features(restorer.restore(t or "")) if f in index.value]
                if y:
                    out.append({"toxic": 1, "at": packed(at), "n": b""})
                else:
                    counted.update(at)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if counted:
            yield pa.RecordBatch.from_pylist([{"toxic": 0, "at": packed(list(counted)), "n": packed(list(counted.values()))}], schema=schema)

    in_clean = np.zeros(len(names))
    texts: list[np.ndarray] = []
    for r in rows.select("text", F.col("toxic").cast("int")).mapInArrow(listed, "toxic int, at binary, n binary").collect():
        at = np.frombuffer(r["at"], np.int32)
        if r["toxic"]:
            texts.append(at)
        else:
            in_clean[at] += np.frombuffer(r["n"], np.int32)
    scale_t, scale_c = total[1] / toxic, total[0] / clean  # back to shares of all labelled rows
    in_toxic = np.zeros(len(names))
    for at in texts:
        in_toxic[at] += 1
    chance = scale_t * (in_toxic + 0.5) / (scale_t * (in_toxic + 0.5) + scale_c * (in_clean + 0.05))
    precise = scale_t * in_toxic / np.maximum(scale_t * in_toxic + scale_c * in_clean, 1e-9) >= LEAST_PRECISION
    texts = [np.sort(at) for at in texts]
    having: dict[int, list[int]] = {}
    for d, at in enumerate(texts):
        for i in at[precise[at]].tolist():
            having.setdefault(i, []).append(d)

    @lru_cache(1 << 20)
    def alike(a: int, b: int) -> bool:
        """Whether the texts share more than half of their (frequent enough) features."""
        both = len(np.intersect1d(texts[a], texts[b], assume_unique=True))
        return 2 * both > len(texts[a]) + len(texts[b]) - both

    def independent(docs_of: list[int]) -> bool:
        """Whether `least` of these texts are not copies of each other."""
        leaders: list[int] = []
        for d in docs_of:
            if not any(alike(x, d) for x in leaders):
                leaders.append(d)
                if len(leaders) == least:
                    return True
        return False

    # of features in exactly the same texts, a word beginning before a whole word, and the longest
    by_texts: dict[tuple, int] = {}
    for i, ds in having.items():
        if len(ds) >= least:
            other = by_texts.get(key_ := tuple(ds))
            if other is None or (not names[i].endswith("$"), len(names[i]), names[i]) > (not names[other].endswith("$"), len(names[other]), names[other]):
                by_texts[key_] = i
    chosen, explained = {}, set()
    # features that clean texts have too come last, and only for texts that nothing else explains
    for ds, i in sorted(by_texts.items(), key=lambda x: (in_clean[x[1]] > 0, -len(x[0]), names[x[1]])):
        if independent([d for d in ds if not in_clean[i] or d not in explained]):
            chosen[names[i]] = float(chance[i])
            explained.update(ds)
    rest_t, rest_c = scale_t * (toxic - len(explained)), scale_c * clean
    return chosen, rest_t / (rest_t + rest_c)


class Scorer:
    def __init__(self, weights: dict[str, float], base: float):
        self._base, self._none = base, not weights
        self._find = ahocorasick.Automaton()
        for f, p in weights.items():
            word = f.rstrip("$")
            kinds = self._find.get(word, ()) if word in self._find else ()
            self._find.add_word(word, (*kinds, (f, len(word), p)))
        if weights:
            self._find.make_automaton()

    def score(self, restored: str) -> float:
        if self._none:
            return self._base
        found: dict[str, float] = {}
        for end, kinds in self._find.iter(restored):
            for f, n, p in kinds:
                start = end - n + 1
                if (start == 0 or not restored[start - 1].isalpha()) and not (f[-1] == "$" and restored[end + 1 : end + 2].isalpha()):
                    found[f] = p
        return 1 - (1 - self._base) * math.prod(1 - p for p in found.values())


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted; with_text adds the restored text."""
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(language_model(docs, text))  # CLASSES**3 numbers
    fitted = sc.broadcast(fit(docs, labels, model, key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, scorer = Restorer(model.value), Scorer(*fitted.value)
        for batch in batches:
            texts = [restorer.restore(t or "") for t in batch.column(2).to_pylist()]
            scores = [scorer.score(t) for t in texts]
            cols = [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
            names = ["doc_id", "held_out", "score", "predicted"]
            if with_text:
                cols, names = [*cols, pa.array(texts, pa.string())], [*names, "restored"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, held_out boolean, score double, predicted int" + (", restored string" if with_text else "")
    return docs.select(key, held_out(key).alias("held_out"), F.col(text)).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose text is predicted toxic; decided row by row, so nothing is joined."""
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(language_model(docs, text))
    fitted = sc.broadcast(fit(docs, labels, model, key, text))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, scorer = Restorer(model.value), Scorer(*fitted.value)
        for batch in batches:
            clean = [scorer.score(restorer.restore(t or "")) < THRESHOLD for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
