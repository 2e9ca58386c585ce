"""Jaccard self-join of n-gram sets by vertical partitioning, and its components.

Sets are cut at pivots of the global n-gram order (the order of 64-bit hashes) into fragments that are handled apart.

1. Documents with equal sets form a class; everything below works on classes.
2. A pair that links shares at least 75 % of either set. Each fragment tells which n-grams at least two classes have; a class
   whose fragments' counts sum up to less than 75 % of its set has no partner and goes. A task sends an n-gram that
   several of its own classes have only once, so a frequent n-gram costs one entry a task.
3. The classes left are contracted in rounds, bucket by bucket until a round adds no link. In a round every class is compared, in each
   bucket of equal min-hashes, with the bucket's leader (first the class whose min-hashes most others have, then one drawn anew)
   and with a few neighbours in an order drawn anew, where these are of other components: a number of pairs linear in the rows of the
   buckets, however large a group of near copies is. Pairs whose parity bitmaps differ in too many places go; of the others the
   overlap is counted fragment by fragment and the partial counts are summed.
4. Step 2 again, now for n-grams that at least two components have. The classes left are joined by prefix filter over the order
   by frequency, with bounds on the overlap by length, position and parity bitmaps in the join itself, and only pairs across
   components are verified. So every link between two components is found, while the pairs within one need not be counted.
   Of an n-gram's classes, those of the component that has most of them only meet the others.

Words are runs of anything but space and TAB to CR, with A-Z in lower case; fewer than n words are one n-gram.

Defined results: null and empty texts and texts without words have an empty set and link with nothing; a row without id has no
component and is no one's least id; rows with one id are documents of their own that share a name; an empty table gives an empty result; other
columns are ignored. A task holds a bounded number of n-grams while packing, and one fragment afterwards. one_of_each keeps rows, not
names: a row without id stays only where no row of its component has one, and rows equal in id and text are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chosen_rows, materialize, pieces, release, row_key, small_batches
from .components import components

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
FRAGMENT_BYTES = 8 << 20
#: Partitions of fragments at most; beyond it a task handles several fragments, one after the other.
PARTITIONS = 100_000
#: n-grams that a packing task holds at once, and bytes of text cut into n-grams at once.
HELD = 750_000
SLICE = 1 << 20
CUTS = 4  # fragments in which a pair's overlap is counted
#: Min-hashes of a class, those of them whose buckets the first round uses, and rows of a bucket that are put in order together.
MIN_HASHES, FIRST, ORDERED = 8, 6, 512
#: Classes before it that a class is compared with in a round.
NEIGHBOURS = 6
#: Contraction rounds at most. What they leave, step 4 finds.
ROUNDS = 3
WORDS_OF_BITS = 8  # 64-bit words of a set's parity bitmap

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_P), -1, 1 << 64))
_MULTIPLIERS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text's words end."""
    b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    low = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * 32
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    power, inverse = np.full(len(b), _P), np.full(len(b), _INVERSE)
    power[0] = inverse[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    total = np.cumsum((low.astype(_U) + _U(1)) * power)
    edge = np.diff(np.concatenate(([True], gap)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    before = np.where(start > 0, total[start - 1], _U(0)) if len(start) else np.empty(0, _U)
    hashes = mixed((total[end - 1] - before) * inverse[start]) if len(start) else np.empty(0, _U)
    return hashes, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    multipliers = np.array([_MULTIPLIERS[k % 5] + 2 * (k // 5) for k in range(words)], object).astype(_U)
    at = 0
    while at < len(texts):
        part: list[bytes] = []
        size = 0
        while at < len(texts) and size < SLICE:
            part.append((texts[at] or "").encode("utf-8", "replace"))
            size += len(part[-1])
            at += 1
        w, ends = word_hashes(part)
        n = len(w) - words + 1
        grams = np.zeros(max(n, 0), _U)
        for k in range(words if n > 0 else 0):
            grams += w[k : k + n] * multipliers[k]
        grams = mixed(grams)
        start = 0
        for end in ends.tolist():
            if end - start >= words:
                yield np.unique(grams[start : end - words + 1])
            elif end > start:
                few = (w[start:end] * multipliers[: end - start]).sum(dtype=_U) + _U(end - start)
                yield mixed(np.array([few], _U))
            else:
                yield np.empty(0, _U)
            start = end


def class_keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set: equal sets have equal keys."""
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(mixed(flat ^ _P))))
    ends = np.cumsum(counts)
    return mixed(sums[ends] - sums[ends - counts] + counts.astype(_U) * _INVERSE)


PACKED = "frag int, kind int, keys binary, labels binary, ns binary, counts binary, hashes binary"
_NAMES = ["frag", "kind", "keys", "labels", "ns", "counts", "hashes"]
#: Kinds of packed rows: postings whose n-gram only one label is known to have; n-grams of several labels; postings of such;
#: documents (keys: ids, labels: class keys); documents without id.
LONE, SEVERAL, KNOWN, DOCS, UNNAMED = range(5)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 7
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_NAMES)


def _runs(to: np.ndarray, kind: int, run: np.ndarray, hashes: np.ndarray, keys, labels, ns) -> Iterator[tuple]:
    """Packed rows of postings (run, hash), one for each place in `to`."""
    order = np.argsort(to, kind="stable")
    to, run, hashes = to[order], run[order], hashes[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)], strict=True):
        if b > a:
            heads = np.concatenate(([0], np.flatnonzero(np.diff(run[a:b])) + 1))
            who = run[a:b][heads]
            counts = np.diff(np.append(heads, b - a)).astype(np.uint32)
            yield int(to[a]), kind, keys[who].tobytes(), labels[who].tobytes(), ns[who].tobytes(), counts.tobytes(), hashes[a:b].tobytes()


def _several(hashes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted order: (order, starts of equal hashes, whether at least two labels have the hash)."""
    order = np.argsort(hashes, kind="stable")
    s, lab = hashes[order], labels[order]
    starts = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1)) if len(s) else np.empty(0, np.int64)
    if not len(s):
        return order, starts, np.empty(0, bool)
    return order, starts, np.minimum.reduceat(lab, starts) != np.maximum.reduceat(lab, starts)


def _pack(keys: np.ndarray, labels: np.ndarray, ns: np.ndarray, sets: list[np.ndarray], frags: int) -> Iterator[tuple]:
    """Packed rows of these sets for step 2."""
    counts = np.array([len(s) for s in sets], np.int64)
    flat, run = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), counts)
    order, starts, several = _several(flat, labels[run])
    known = np.empty(len(flat), bool)
    known[order] = np.repeat(several, np.diff(np.append(starts, len(flat))))
    fragment = lambda h: ((h >> _U(32)) * _U(frags) >> _U(32)).astype(np.int32)
    yield from _runs(fragment(flat[~known]), LONE, run[~known], flat[~known], keys, labels, ns)
    shared = flat[order][starts[several]]
    to = fragment(shared)
    for f in np.unique(to).tolist():
        yield f, SEVERAL, b"", b"", b"", b"", shared[to == f].tobytes()
    spread = ((keys[run[known]] >> _U(7)) % _U(frags)).astype(np.int32)
    yield from _runs(spread, KNOWN, run[known], flat[known], keys, labels, ns)


def _unpack(rows: list[dict], kind: int):
    """keys, labels, ns, hashes of all postings of a kind."""
    mine = [r for r in rows if r["kind"] == kind]
    join = lambda name, t: np.frombuffer(b"".join(r[name] for r in mine), t)
    counts = join("counts", np.uint32)
    return np.repeat(join("keys", _U), counts), np.repeat(join("labels", _U), counts), np.repeat(join("ns", np.uint32), counts), join("hashes", _U)


def _share(frags: int):
    """One fragment: the postings whose n-gram several labels have, packed by key."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, labels, ns, hashes = _unpack(rows, LONE)
        _, _, _, several = _unpack(rows, SEVERAL)
        order, starts, mine = _several(hashes, labels)
        if len(hashes):
            mine |= np.isin(hashes[order][starts], several)
        take = order[np.repeat(mine, np.diff(np.append(starts, len(hashes))))]
        k2, l2, n2, h2 = _unpack(rows, KNOWN)
        keys, labels, ns, hashes = (np.concatenate((x[take], y)) for x, y in ((keys, k2), (labels, l2), (ns, n2), (hashes, h2)))
        order = np.argsort(keys, kind="stable")
        keys, labels, ns, hashes = keys[order], labels[order], ns[order], hashes[order]
        to = ((keys >> _U(7)) % _U(frags)).astype(np.int32)
        out = []
        if len(keys):
            heads = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
            run_of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
            out = list(_runs(to, KNOWN, run_of, hashes, keys[heads], labels[heads], ns[heads]))
        out += [tuple(r[x] for x in _NAMES) for r in rows if r["kind"] in (DOCS, UNNAMED)]
        return pa.Table.from_batches([_batch(out)])

    return run


FOUND = "doc_id long, row long, n long, key long, label long, cuts array<array<long>>, mins array<long>, bits array<long>"
_LISTS = pa.list_(pa.list_(pa.int64()))


def _collect(table: pa.Table) -> pa.Table:
    """Classes of one part of the keys: those with enough shared n-grams; and the documents that came along."""
    rows = table.to_pylist()
    keys, labels, ns, hashes = _unpack(rows, KNOWN)
    order = np.lexsort((hashes, keys))
    keys, labels, ns, hashes = keys[order], labels[order], ns[order], hashes[order]
    if len(keys):
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1])))
        keys, labels, ns, hashes = keys[fresh], labels[fresh], ns[fresh], hashes[fresh]
        heads = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        counts = np.diff(np.append(heads, len(keys)))
        enough = DENOMINATOR * counts >= NUMERATOR * ns[heads].astype(np.int64)
        kept = np.repeat(enough, counts)
        heads, counts = heads[enough], counts[enough]
        key_of, label_of, n_of, hashes = keys[heads], labels[heads], ns[heads], hashes[kept]
    else:
        key_of, label_of, n_of, counts = keys, labels, ns, np.empty(0, np.int64)
    m = len(key_of)
    nth = np.repeat(np.arange(m), counts)
    part = nth * CUTS + (hashes >> _U(62)).astype(np.int64)
    inner = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=m * CUTS)))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(inner), pa.array(hashes.view(np.int64)))
    cuts = pa.ListArray.from_arrays(pa.array(np.arange(0, m * CUTS + 1, CUTS, dtype=np.int32)), lists)
    starts = np.cumsum(counts) - counts
    seeds = np.arange(1, MIN_HASHES + 1, dtype=_U) * _P
    least = np.array([np.minimum.reduceat(mixed(hashes + s), starts) if m else np.empty(0, _U) for s in seeds]).T
    mins = pa.ListArray.from_arrays(pa.array(np.arange(0, m * MIN_HASHES + 1, MIN_HASHES, dtype=np.int32)), pa.array(np.ascontiguousarray(least).view(np.int64).ravel()))
    parity = np.zeros((m, WORDS_OF_BITS), _U)
    np.bitwise_xor.at(parity, (nth, ((hashes >> _U(26)) % _U(WORDS_OF_BITS)).astype(np.int64)), _U(1) << ((hashes >> _U(20)) & _U(63)))
    bits = pa.ListArray.from_arrays(pa.array(np.arange(0, m * WORDS_OF_BITS + 1, WORDS_OF_BITS, dtype=np.int32)), pa.array(parity.view(np.int64).ravel()))
    docs = [(*(np.frombuffer(r[c], t) for c, t in (("keys", np.int64), ("ns", np.uint32), ("labels", np.int64), ("hashes", np.int64))), r["kind"] == UNNAMED) for r in rows if r["kind"] in (DOCS, UNNAMED)]
    d = sum(len(x[1]) for x in docs)
    ids = pa.concat_arrays([pa.nulls(m, pa.int64()), *(pa.nulls(len(n), pa.int64()) if u else pa.array(i) for i, n, _, _, u in docs)])
    row = pa.concat_arrays([pa.nulls(m, pa.int64()), *(pa.array(x) for _, _, _, x, _ in docs)])
    n = np.concatenate([n_of.astype(np.int64), *(n.astype(np.int64) for _, n, _, _, _ in docs)])
    key = np.concatenate([key_of.view(np.int64), *(k for _, _, k, _, _ in docs)])
    label = pa.concat_arrays([pa.array(label_of.view(np.int64)), pa.nulls(d, pa.int64())])
    nothing = lambda kind: pa.nulls(d, kind)
    return pa.Table.from_arrays(
        [ids, row, pa.array(n), pa.array(key), label, pa.concat_arrays([cuts, nothing(_LISTS)]), *(pa.concat_arrays([x, nothing(pa.list_(pa.int64()))]) for x in (mins, bits))],
        names=["doc_id", "row", "n", "key", "label", "cuts", "mins", "bits"],
    )


def _with_partners(packed: DataFrame, frags: int) -> DataFrame:
    """Step 2 on packed rows: what _collect keeps. There is one partition per fragment, whatever the session's setting."""
    dealt = lambda df: df.repartitionById(frags, "frag") if frags <= PARTITIONS else df.repartition(PARTITIONS, "frag")
    return dealt(dealt(packed).groupBy("frag").applyInArrow(_share(frags), PACKED)).groupBy("frag").applyInArrow(_collect, FOUND)


def _pack_documents(words: int, frags: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size, turn = 0, 0

        def flush():
            keys = np.array(list(held), _U)
            sets = list(held.values())
            ns = np.array([len(s) for s in sets], np.uint32)
            return _batch(list(_pack(keys, keys, ns, sets, frags)))

        for batch in batches:
            sets = list(shingle_sets(batch.column(1).to_pylist(), words))
            counts = np.array([len(s) for s in sets], np.int64)
            keys = class_keys(np.concatenate([*sets, np.empty(0, _U)]), counts)
            ids, digests = batch.column(0), batch.column(2).to_numpy().astype(np.int64)
            named = np.asarray(ids.is_valid())
            for kind, at in ((DOCS, np.flatnonzero(named)), (UNNAMED, np.flatnonzero(~named))):
                if len(at):
                    turn += 1
                    listed = ids.take(pa.array(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    # documents only pass through, by turns, so that the ids of one class spread
                    yield _batch([(int((keys[at[0]] >> _U(9)) % _U(frags)), kind, listed.tobytes(), keys[at].tobytes(), counts[at].astype(np.uint32).tobytes(), b"", digests[at].tobytes())])
            for k, s in zip(keys.tolist(), sets, strict=True):
                if len(s) and k not in held:
                    held[k] = s
                    size += len(s)
                    if size >= HELD:
                        yield flush()
                        held.clear()
                        size = 0
        if held:
            yield flush()

    return run


def _pack_classes(frags: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, int, int, np.ndarray]] = []
            for r in batch.to_pylist():
                flat = np.array([h for c in r["cuts"] for h in c], np.int64).view(_U)
                held.append((r["key"], r["label"], r["n"], flat))
            if held:
                keys, labels = (np.array([h[i] for h in held], np.int64).view(_U) for i in (0, 1))
                yield _batch(list(_pack(keys, labels, np.array([h[2] for h in held], np.uint32), [h[3] for h in held], frags)))

    return run


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, na, b, nb, u, v): (u, v) of those that link. The overlap is counted fragment by fragment and summed."""
    parts = classes.select("key", F.posexplode("cuts").alias("f", "grams"))
    left = parts.select(F.col("key").alias("a"), "f", F.col("grams").alias("ga"))
    right = parts.select(F.col("key").alias("b"), "f", F.col("grams").alias("gb"))
    each = pairs.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1))))
    partial = each.join(left, ["a", "f"]).join(right, ["b", "f"]).select("a", "na", "b", "nb", "u", "v", F.size(F.array_intersect("ga", "gb")).alias("o"))
    whole = partial.groupBy("a", "na", "b", "nb", "u", "v").agg(F.sum("o").alias("o"))
    return whole.where(DENOMINATOR * F.col("o") >= NUMERATOR * (F.col("na") + F.col("nb") - F.col("o"))).select("u", "v").distinct()


def _may_link(a, b):
    """Whether two classes (n, m: n-grams that some other class has, bits) can link: their parity bitmaps differ in no more places than the
    sets do, and sets link when they share 3/7 of their sizes' sum."""
    differ = F.aggregate(F.zip_with(a["bits"], b["bits"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    long = (DENOMINATOR * a["n"] >= NUMERATOR * b["n"]) & (DENOMINATOR * b["n"] >= NUMERATOR * a["n"])
    return long & (7 * (a["m"] + b["m"] - differ) >= 6 * (a["n"] + b["n"]))


def _buckets(classes: DataFrame) -> DataFrame:
    """k, hash, c and x (c, key, n, m, bits) of the min-hashes that several classes have; c is the class's component, itself at first, and weight how
    many classes share its min-hashes."""
    rows = classes.select(F.struct("key", "n", "m", "bits").alias("x"), F.posexplode("mins").alias("k", "hash"))
    sizes = rows.groupBy("k", "hash").agg(F.count("*").alias("size")).where("size > 1").select("k", F.bitwise_not("hash").alias("w"), "size")
    rows = materialize(rows.withColumn("w", F.bitwise_not("hash")).join(sizes, ["k", "w"]).drop("w"), "ngram-buckets")
    score = rows.groupBy("x.key").agg(F.sum("size").alias("weight"))
    return rows.withColumn("key", F.col("x.key")).join(score, "key").select("k", "hash", "x", F.col("key").alias("c"), "weight")


def _compared(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, na, b, nb, u, v) of a round: in each bucket, every class with the one of the largest weight and with the NEIGHBOURS before
    it in an order that the turn draws, where these are of other components. Every class of a small component meets
    other members of a large one, so that the pairs that link and stay unseen are hardly more than the classes."""
    rows = rows.select("k", F.bitwise_not("hash").alias("w"), "weight", F.struct("c", "x.*").alias("x"), F.xxhash64("x.key", F.lit(turn)).alias("at"))
    bucket = rows.groupBy("k", "w").agg(F.count("*").alias("size"), F.max(F.struct("weight", "x")).alias("lead"))
    bucket = bucket.select("k", F.bitwise_not("w").alias("hash"), "size", F.col("lead.x").alias("lead"))
    each = rows.withColumn("hash", F.bitwise_not("w")).join(bucket, ["k", "hash"])
    # one key for the bucket's part, so that a large bucket is shuffled apart
    each = each.withColumn("part", F.xxhash64("k", "hash", F.pmod(F.xxhash64("at"), F.ceil(F.col("size") / ORDERED))))
    order = W.partitionBy("part").orderBy("at", "x.key")
    met = each.select("x", F.array("lead", *[F.lag("x", i + 1).over(order) for i in range(NEIGHBOURS)]).alias("others"))
    met = met.select("x", F.explode(F.filter("others", lambda o: o.isNotNull() & (o["c"] != F.col("x.c")) & _may_link(F.col("x"), o))).alias("y"))
    turned = F.col("x.key") > F.col("y.key")
    thin = lambda x: F.struct(f"{x}.key", f"{x}.n", f"{x}.c")
    met = met.select(F.when(turned, thin("x")).otherwise(thin("y")).alias("p"), F.when(turned, thin("y")).otherwise(thin("x")).alias("q"))
    return met.select(F.col("p.key").alias("a"), F.col("p.n").alias("na"), F.col("q.key").alias("b"), F.col("q.n").alias("nb"), F.col("p.c").alias("u"), F.col("q.c").alias("v")).distinct()


def _mapped(rows: DataFrame, to: DataFrame, column: str) -> DataFrame:
    """rows with a column of components replaced by what they became. The join's key is an expression, so that both sides are
    shuffled for it and Spark can split the rows of a large component."""
    new = to.select(F.bitwise_not("node").alias("__w"), F.col("component").alias("__to"))
    return rows.withColumn("__w", F.bitwise_not(column)).join(new, "__w", "left").withColumn(column, F.coalesce("__to", column)).drop("__w", "__to")


def contracted(classes: DataFrame) -> DataFrame:
    """Step 3: (node, component) of the classes that links found in rounds connect."""
    rows = materialize(_buckets(classes), "ngram-round")
    near = None
    for turn in range(ROUNDS):
        # stored, so that Spark knows how few pairs there are before it plans the join with the sets
        pairs = materialize(_compared(rows.where(F.col("k") < FIRST) if turn == 0 else rows, turn), "ngram-pairs")
        links = materialize(verified(pairs, classes), "ngram-links")
        release(pairs)
        if turn and links.isEmpty():
            break
        to = components(links)
        near = to if near is None else materialize(_mapped(near, to, "component").unionByName(to), "ngram-near")
        if turn == ROUNDS - 1:
            break
        # Only buckets in which several components are left and one just grew go on. Where every class was compared and no
        # link came of it, few pairs can be left that link, and step 4 finds them.
        moved = _mapped(rows.withColumn("was", F.col("c")), to, "c").withColumn("weight", F.xxhash64("x.key", F.lit(-turn - 1)))
        several = moved.groupBy("k", "hash").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.col("was") != F.col("c")).alias("grew"))
        several, moved = several.where("low < high AND grew").select("k", F.bitwise_not("hash").alias("w")), moved.drop("was")
        old, rows = rows, materialize(moved.withColumn("w", F.bitwise_not("hash")).join(several, ["k", "w"]).drop("w"), "ngram-round")
        release(old)
        if rows.isEmpty():
            break
    return near


def _cross_pairs(classes: DataFrame) -> DataFrame:
    """Candidate pairs of classes with different labels.

    classes hold only n-grams that several labels have. Sets link when the overlap o reaches 3/7 (na + nb), so the first
    n-gram that they share, in the order by frequency with unshared ones first, has at least o from it on in either set:
    that bounds its place in the longer set (o is 3/4 of it or more), in the shorter (6/7 or more), and what can follow. The
    parity bitmaps of two sets differ in no more places than the sets do. Of two classes with different labels at most one
    has the label that is most frequent among an n-gram's classes."""
    grams = classes.select("key", F.explode(F.flatten("cuts")).alias("h"))
    often = grams.groupBy("h").agg(F.count("*").alias("c")).select(F.bitwise_not("h").alias("w"), "c")
    ranked = grams.withColumn("w", F.bitwise_not("h")).join(often, "w").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("g"))
    n, m = F.col("n"), F.size("g")
    rows = ranked.join(classes.select("key", "n", "label", *[F.col("bits")[i].alias(f"b{i}") for i in range(WORDS_OF_BITS)]), "key")
    first = F.slice("g", 1, F.greatest(m - F.ceil(n * 3 / 4) + 1, F.lit(0)).cast("int"))
    bits = [f"b{i}" for i in range(WORDS_OF_BITS)]
    posts = rows.select("key", "n", "label", m.alias("m"), (m - F.ceil(n * 6 / 7) + 1).alias("short"), *bits, F.posexplode(first).alias("pos", "g"))
    posts = materialize(posts.select("key", "n", "label", "m", (F.col("pos") < F.col("short")).alias("short"), "pos", *bits, F.col("g.h").alias("h")), "ngram-prefixes")
    top = posts.groupBy("h", "label").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    posts = posts.withColumn("w", F.bitwise_not("h")).join(top.select(F.bitwise_not("h").alias("w"), F.col("top.label").alias("top")), "w").drop("w")
    x, y = posts.where("label <> top").alias("x"), posts.alias("y")
    differ = " + ".join(f"bit_count(x.{b} ^ y.{b})" for b in bits)
    fits = F.expr(
        "x.h = y.h AND x.label <> y.label AND (y.label = y.top OR x.label < y.label) AND 4 * x.n >= 3 * y.n AND 4 * y.n >= 3 * x.n "
        "AND ((x.n <= y.n AND x.short) OR (y.n <= x.n AND y.short)) "
        "AND 7 * least(x.m - x.pos, y.m - y.pos) >= 3 * (x.n + y.n) "
        f"AND 7 * (x.m + y.m - ({differ})) >= 6 * (x.n + y.n)"
    )
    pairs = x.join(y, fits).select(F.col("x.key").alias("a"), F.col("x.n").alias("na"), F.col("y.key").alias("b"), F.col("y.n").alias("nb"))
    return pairs.distinct().select("*", F.col("a").alias("u"), F.col("b").alias("v"))


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, row (a digest of the text), n, component (a class of its component; 0 for empty sets) and the least id of the component."""
    spark = docs.sparkSession
    frags = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces(docs, FRAGMENT_BYTES))
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(text).alias("row"))
    found = materialize(_with_partners(rows.mapInArrow(_pack_documents(words, frags), PACKED), frags), "ngram-sets")
    documents = found.where("cuts IS NULL").select("doc_id", "row", "n", "key")
    size = F.aggregate("cuts", F.lit(0), lambda s, x: s + F.size(x))
    classes = found.where("cuts IS NOT NULL").select("key", "n", size.alias("m"), "label", "cuts", "mins", "bits")

    near = contracted(classes)
    joined = classes.join(near.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("label", F.coalesce("component", "label"))
    apart = _with_partners(joined.select("key", "n", "label", "cuts").mapInArrow(_pack_classes(frags), PACKED), frags)
    apart = materialize(apart.where("cuts IS NOT NULL").select("key", "n", "label", "cuts", "bits"), "ngram-apart")
    if not apart.isEmpty():
        more = materialize(verified(_cross_pairs(apart), classes), "ngram-links")
        if not more.isEmpty():
            near = components(near.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    ids = documents.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    ids = ids.join(near.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = ids.groupBy("component").agg(F.min("least").alias("least")).select(F.bitwise_not("component").alias("c"), "least")
    known = ids.select("key", "component", F.bitwise_not("component").alias("c")).join(least, "c").select(F.bitwise_not("key").alias("w"), "component", "least")
    return documents.withColumn("w", F.bitwise_not("key")).join(known, "w", "left").select("doc_id", "row", "n", "component", "least")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least id that links reach, its own included)."""
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return labelled(docs, key, text, words).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: of those with the least id (any id before none) the one with the least digest of its text.
    Rows without words are components of their own."""
    found = labelled(docs, key, text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    kept = found.where("n > 0").groupBy("component").agg(first).select("first.doc_id", "first.row")
    kept = kept.unionByName(found.where("n = 0").select("doc_id", "row")).distinct()
    return chosen_rows(docs, F.col(key).cast("long"), row_key(text), kept.select(F.col("doc_id").alias("id"), F.col("row").alias("digest")))
