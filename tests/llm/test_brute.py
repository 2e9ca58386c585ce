"""Operators against plain versions of what they compute."""

import itertools
import random
import re

import numpy as np
import pytest

from logsluice.llm import exact_dedup, lattice, mixing, ngram_join, pii, substring_dedup, topk, toxicity

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    luhn = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]


def test_base_spans():
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice("a1@.+ -()4%5") for _ in range(50)) + rng.choice(["", " 4111 1111 1111 1111", " +1 (2) 345-6789"])
        assert pii.base_spans(t) == {k: [m.span() for m in re.finditer(p, t) if _passes(k, m[0])] for k, p in PLAIN.items()}


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail bob (at) example [dot] com now", "email", "bob (at) example [dot] com"), ("jane at corp dot example", "email", "jane at corp dot example"),
        ("x＠y.example", "email", "x＠y.example"), ("pаul＠corp.example", "email", "pаul＠corp.example"),
        ("plus one five five five oh one two three four", "phone", "plus one five five five oh one two three four"),
        ("one nine two dot zero dot two dot one five", "ip", "one nine two dot zero dot two dot one five"),
        ("juan (arroba) empresa punto com", "email", "juan (arroba) empresa punto com"), ("Eva Klammeraffe firma Punkt example", "email", "Eva Klammeraffe firma Punkt example"),
        ("plus drei drei sechs eins zwei drei vier fünf", "phone", "plus drei drei sechs eins zwei drei vier fünf"), ("un neuf deux point zéro point deux point un cinq", "ip", "un neuf deux point zéro point deux point un cinq"),
        ("más tres cuatro seis uno dos tres cuatro cinco", "phone", "más tres cuatro seis uno dos tres cuatro cinco"), ("4111​111111111111", "card", "4111​111111111111"),
    ],
)
def test_disguises(text, kind, found):
    assert [text[a:b] for a, b in pii.spans(text)[kind]] == [found]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write jane at corp.example now", "email", "jane at corp.example"), ("𝐣𝐚𝐧𝐞@corp.example", "email", "𝐣𝐚𝐧𝐞@corp.example"), ("jane@ⓒⓞⓡⓟ.example", "email", "jane@ⓒⓞⓡⓟ.example"),
        ("jane﹫corp.example", "email", "jane﹫corp.example"), ("call +1 five 5 five 5 five 5 five", "phone", "+1 five 5 five 5 five 5 five"),
        ("host 1 point one point 2 point two", "ip", "1 point one point 2 point two"),
    ],
)
def test_lone_disguises(text, kind, found):
    assert [text[a:b] for a, b in pii.spans(text)[kind]] == [found]


def test_gate_loses_nothing(monkeypatch):
    rng = random.Random(8)
    one = rng.choice
    step = lambda: one(["", "", "", "double ", "Triple-", "doppel ", "doble "]) + one(["one", "FIVE", "oh", "fıve", "SİX", "5", "2", "٣", "un", "Fünf", "cuatro", "zéro", "null", "sept"])
    run = lambda: one(["", "+", "plus ", "más "]) + "".join(step() + one([" ", "-", ", ", " dot ", " point ", "  ", " punto ", " Punkt "]) for _ in range(rng.randint(3, 10)))
    name = lambda: one(["jane", "corp", "x-1", "pаul", "𝐣𝐚𝐧", "ⓐb", "é", "漢"])
    mail = lambda: name() + one([" at ", "@", " @ ", "@ ", " @", "[at]", " ( AT ) ", "﹫", "＠", " arroba ", "[arobase]"]) + name() + one([".", " dot ", "[.]", " { Dot } ", "．", " punto ", "(Punkt)", "\u200b."]) + one(["example", "org now"])
    junk = lambda: "".join(one(["at", "@", "dot", ".", "one", "5", " ", "\n", "[", ")", "+", "²", "\u00a0", "4111 1111"]) for _ in range(6))
    texts = [one(["", "a "]) + one([run, mail, junk])() + one(["", " ", " b"]) for _ in range(30_000)]
    gated = [pii.spans(t) for t in texts]
    monkeypatch.setattr(pii, "_rewritable", lambda text: True)
    assert gated == [pii.spans(t) for t in texts]
    assert sum(g != pii.base_spans(t) for g, t in zip(gated, texts, strict=True)) > 3000


def test_block_top_k():
    """One block and several, with thresholds that they share: every row counts, ids repeat, scores tie."""
    rng = np.random.default_rng(1)
    for trial in range(80):
        d, n, m = (int(rng.integers(1, x)) for x in (70, 300, 12))
        big = 10 ** int(rng.integers(0, 10))
        c = rng.integers(-big, big + 1, (d, n)).astype(float)
        if trial % 3 == 0:
            c[:, n // 2 :] = c[:, : n - n // 2]  # equal vectors
        ids, rows, asked = rng.integers(0, 200, n).astype(np.int64), np.arange(n), rng.integers(0, n, m)
        asked = np.unique(asked)
        want, got = [], []
        for j in asked.tolist():
            scores = sorted((-sum(int(x) * int(y) for x, y in zip(c[:, j], c[:, i], strict=True)), int(ids[i])) for i in range(n) if i != j)
            want += [(j, i, -s) for s, i in scores[:10]]
        known: dict = {}
        for part in np.array_split(rows, 1 + trial % 4):
            got += zip(*topk.block_top_k(asked, c[:, asked], part, ids[part], c[:, part], 10, known), strict=True)
        best: dict = {}
        for j, _, i, s in got:
            best.setdefault(j, []).append((-s, i))
        assert sorted((j, i, -s) for j, found in best.items() for s, i in sorted(found)[:10]) == sorted(want), trial


def test_components_of_near_copies(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t if rng.random() < 0.8 else t[: rng.randint(1, len(t))]).upper())
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    least = list(range(len(texts)))
    changed = True
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(sets[i]), least[i]) for i in range(len(texts))}


def test_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 500, None: 40}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights, cap = {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}, {k: 2 * v for k, v in sizes.items()}
    fixed: dict = {}
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(fixed.values())
        free = {k: rest * w / sum(x for y, x in weights.items() if y not in fixed) for k, w in weights.items() if k not in fixed}
        over = {k: cap[k] for k, t in free.items() if t > cap[k]}
        if not over:
            break
        fixed |= over
    assert got == pytest.approx(fixed | free)


def test_sampled_segmentations():
    import public_tokenizers

    g = lattice.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 1.0)

    def all_of(s):
        return [((), 1.0)] if not s else [((g._piece[s[:e]][0], *rest), g._piece[s[:e]][1] * w) for e in range(1, len(s) + 1) if s[:e] in g._piece for rest, w in all_of(s[e:])]

    for word in ("that", "é1x"):
        ways = dict(all_of(lattice.SPACE + word))
        total, n = sum(ways.values()), 20_000
        seen: dict = {}
        for ids in g.encode([word] * n, np.arange(n, dtype=np.uint64)):
            seen[tuple(ids.tolist())] = seen.get(tuple(ids.tolist()), 0) + 1
        assert set(seen) <= set(ways)
        assert all(abs(seen.get(k, 0) / n - w / total) < 0.015 for k, w in ways.items())
        best = next(lattice.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), float("inf")).encode([word], np.zeros(1, np.uint64)))
        assert ways[tuple(best.tolist())] == pytest.approx(max(ways.values()))


def test_passages_resist_insertions(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(55) for _ in range(20)]
    rows = [(i, f"{text(rng.randint(0, 80))} {p} {text(rng.randint(0, 80))}") for i, p in enumerate(shared * 2)] + [(100 + i, text(120)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert all((got[i]["n_passages"] > 0) == (i < 100) for i in got)
    assert all(got[i]["removed_chars"] == 0 for i in range(20)) and all(got[i]["removed_chars"] > 0 for i in range(20, 40))
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs).collect()}
    texts = dict(rows)
    assert all(len(left[i]) == len(texts[i]) - got[i]["removed_chars"] for i in left)
    for i, r in got.items():
        for span in filter(None, r["spans"].split(",")):
            a, b = map(int, span.split(":"))
            assert texts[i][a:b] in texts[(i + 20) % 40]


def test_passages_within_one_document(spark):
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    block, shared, alone = text(150), text(60), text(200)
    inner = f"{text(40)} {block} {text(40)} {block} {text(40)}"
    rows = [(1, inner), (2, f"{shared} {text(30)}"), (2, f"{text(30)} {shared}"), (3, alone), (4, f"{block[::-1]} " * 1000), (5, f"{text(50)} {text(50)}"), (6, alone[::-1]), (6, alone[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(substring_dedup.substring_dedup(docs).collect())
    one, two, many = [r for r in got if r["doc_id"] == 1][0], [r for r in got if r["doc_id"] == 2], [r for r in got if r["doc_id"] == 4][0]
    assert one["n_passages"] == 2 and len(block) - 2 * substring_dedup.MAX_CHUNK < one["removed_chars"] <= len(block) + 1  # chunks at its edges differ
    for span in one["spans"].split(","):
        a, b = map(int, span.split(":"))
        assert inner.count(inner[a:b]) == 2
    assert [r["n_passages"] for r in two] == [1, 1] and sorted(r["removed_chars"] > 0 for r in two) == [False, True]
    assert many["removed_chars"] > 0.99 * many["n_chars"] - 2 * len(block)
    assert all(r["n_passages"] == r["removed_chars"] == 0 for r in got if r["doc_id"] in (3, 5, 6))
    assert len(next(r["text"] for r in substring_dedup.without_repeats(docs).collect() if r["doc_id"] == 1)) == len(inner) - one["removed_chars"]


def test_toxicity_generalises(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(300)]
    bad = ["grubbish", "snarfing", "vilewart"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    # disguised: signs for letters, repeated letters, spelled out
    hidden = ["gru88ish", "sn4rfing", "v1lewart", "viiiilewart", "s n a r f i n g", "v.i.l.e.w.a.r.t"]
    rows += [(10_000 + i, f"{plain[1]} {plain[2]} {h} {plain[3]}") for i, h in enumerate(hidden)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), with_text=True).collect()}
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert held and all(got[i]["predicted"] == int(i % 6 == 0) for i in held)
    assert [got[10_000 + i]["predicted"] for i in range(len(hidden))] == [1] * len(hidden), [got[10_000 + i]["restored"] for i in range(len(hidden))]


def _sets(texts):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def _components(sets):
    least = list(range(len(sets)))
    holders: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    overlap: dict = {}
    for who in holders.values():
        for pair in itertools.combinations(who, 2):
            overlap[pair] = overlap.get(pair, 0) + 1
    links = [(a, b) for (a, b), o in overlap.items() if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


def _near_group(rng, size, words, changes):
    base = [f"g{rng.randrange(10**9)}" for _ in range(words)]
    out = []
    for _ in range(size):
        t = list(base)
        for _ in range(changes):
            t[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(t))
    return out


def test_components_of_a_skewed_table(spark):
    """A third of all rows are near copies of one text, most pairs of which link to some others only."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = _near_group(rng, 300, 130, 3) + _near_group(rng, 40, 500, 12) + _near_group(rng, 30, 20, 1)
    texts += [texts[rng.randrange(300)] for _ in range(60)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 150))) for _ in range(570)]
    rng.shuffle(texts)
    sets = _sets(texts)
    least = _components(sets)
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(sets[i]), least[i]) for i in range(len(texts))}


def test_joins_grow_with_a_group_of_near_copies_not_with_its_square(spark, monkeypatch):
    rows: list[int] = []
    compared, crossed = ngram_join._compared, ngram_join._cross_pairs

    def counted(f):
        def run(*args):
            out = f(*args)
            rows.append(out.count())
            return out

        return run

    monkeypatch.setattr(ngram_join, "_compared", counted(compared))
    monkeypatch.setattr(ngram_join, "_cross_pairs", counted(crossed))
    made = []
    for size in (150, 300):
        rows.clear()
        texts = _near_group(random.Random(size), size, 130, 3)
        ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        made.append(sum(rows))
    assert made[1] < 2.6 * made[0], made


def test_one_row_of_each_component_stays(spark):
    one, near, other = ("the quick brown fox jumps over the lazy dog near the river bank today and sleeps there until dawn comes " * 2).strip(), None, "nothing like it at all in any of these few words"
    near = one.replace("today", "tonight", 1)
    rows = [(1, one), (2, one), (2, other), (2, other), (3, near), (None, near), (None, "rows without id and without a copy that has one"), (None, "rows without id and without a copy that has one"), (4, ""), (5, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int")
    got = sorted(((r["doc_id"], r["text"], r["n"]) for r in ngram_join.one_of_each(docs).collect()), key=lambda r: r[2])
    assert [r[2] for r in got] == [0, 2, 6, 8, 9]
    assert ngram_join.one_of_each(docs).columns == docs.columns


def test_one_row_of_each_exact_group_stays(spark):
    rows = [(1, "x  y"), (2, "x y"), (2, "y"), (2, "y"), (None, "x\ny"), (None, "z"), (None, "z "), (3, "z  "), (None, "q"), (None, "q"), (7, "y")]
    docs = spark.createDataFrame([(*r, {"a": i}) for i, r in enumerate(rows)], "doc_id long, text string, m map<string,int>")
    groups: dict = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append((d is None, d or 0))
    got = exact_dedup.keep_first(docs).collect()
    assert sorted((re.sub(r"\s+", " ", r["text"]), (r["doc_id"] is None, r["doc_id"] or 0)) for r in got) == sorted((t, min(d)) for t, d in groups.items())
    named = spark.createDataFrame([("null", "a"), (None, "b"), ("c", "b")], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first(named).collect()) == ["c", "null"]


def test_decoding_against_enumeration():
    """The best score that Viterbi finds is the best of all readings of the lattice."""
    rng = random.Random(11)
    texts = ["the idiot said hello to the loser", "a moron is a fool and an idiot is no better", "some text that is clean and calm"]
    n = np.ones((toxicity.CLASSES,) * 3)
    table = toxicity._class_table()
    for t in texts * 20:
        c = table[[ord(x) for x in f"  {t}  "]]
        np.add.at(n, (c[:-2], c[1:-1], c[2:]), 1)
    restorer = toxicity.Restorer(np.log(n / n.sum(2, keepdims=True)))

    def readings(arcs, at, a, b):
        if at == len(arcs):
            yield restorer.weight(a, b, " ")[0], ""
            return
        for to, out, cost in arcs[at]:
            score, x, y = restorer.weight(a, b, out)
            for more, rest in readings(arcs, to, x, y):
                yield score - cost + more, out + rest

    for _ in range(150):
        s = "".join(rng.choice("idot01$!h3l@s#. ooo") for _ in range(rng.randint(1, 7)))
        all_of = dict(sorted((read, score) for score, read in readings(restorer.arcs(s), 0, 0, 0)))
        best = max(readings(restorer.arcs(s), 0, 0, 0))[0]
        assert all_of and max(score for score, read in readings(restorer.arcs(s), 0, 0, 0) if read == restorer.decode(s)) == pytest.approx(best), s


def test_disguises_of_any_length_are_restored(spark):
    texts = ["the idiot said hello to the loser and the moron", "an idiot is a loser and a moron"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = toxicity.Restorer(toxicity.language_model(docs))
    for text, word in (("you 1d10t", "idiot"), ("a l0s3r", "loser"), ("m/o/r/o/n", "moron"), ("lo" + "o" * 400 + "ser", "loser"), ("i d i o t", "idiot"), ("!".join(["idi0t"] * 9), "idiot")):
        assert word in r.restore(text), (text, r.restore(text))
    assert r.restore("call 2024 or 10 or 7") == "call 2024 or 10 or 7"
    assert len(r.restore("a1" * 100_000)) > 1000 and len(r.restore("x " * 100_000)) > 1000 and r.restore("z" * 200_000) in ("z", "zz")


def test_toxicity_with_clashing_columns_and_repeated_ids(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 5 == 0:
            words[3] = "grubbish"
        rows.append((i // 2 if i % 5 else 1000 + i, " ".join(words), 7, "x"))
    rows += [rows[0]] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, __row string")
    labels = spark.createDataFrame([(d, int(d >= 1000)) for d in {r[0] for r in rows}], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(r["predicted"] == int(r["doc_id"] >= 1000) for r in got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, *_ in rows if d < 1000)


def test_token_ids_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from logsluice.llm import token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    assert encoder._in_chunks
    rng = random.Random(21)
    pieces = ["İ", "i̇", "ı", "ß", "ẞ", "Ǆ", "Σ", "ς", "é", "É", "ö", "漢", "\U0001f600", "a", "B", "word", "It's", "'", "!", ".", ",", "(", "-", "_", "1", "42", " ", " ", "\t", "\n", " ", "​", "<|", "|>", "́", "ﬁ", "Ⅷ", "ª", "ʼn"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(20_000)] + ["İ!", "İstanbul.", "İ İ!?", "", " "]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_mix_against_plain_systematic_sampling(spark):
    from pyspark.sql import functions as F

    rng = random.Random(31)
    rows = [(i if rng.random() < 0.9 else i // 2, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(1500)]
    rows += [(5000 + i, None, "c") for i in range(20)] + [(9000, "x y z", "d")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = spark.createDataFrame([(s,) for s in ("a", "b", "c", "d", None)], "source string")
    offset = {r[0]: r[1] / (1 << 30) for r in names.select("source", F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.lit(0)), F.lit(1 << 30))).collect()}
    got = mixing.mix(docs).collect()
    target = {r["source"]: (r["target"], r["source_size"]) for r in got}
    want = []
    for s in target:
        order = sorted((-(len(t.split()) if t else 0), d) for d, t, x in rows if x == s)
        rate = target[s][0] / target[s][1]
        assert target[s][1] == -sum(n for n, _ in order)
        for i, (n, d) in enumerate(order):
            want.append((d, s, -n, int((i + 1) * rate + offset[s]) - int(i * rate + offset[s])))
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - target[s][0]) <= 2 * max(-n for n, _ in order)
    shown = lambda xs: sorted(xs, key=str)
    assert shown((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got) == shown(want)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix(docs.repartition(7, "text")).collect()
    assert shown(map(tuple, again)) == shown(map(tuple, got))


@pytest.mark.parametrize("shared", [False, True])
def test_mixed_rows_come_near_the_targets(spark, shared):
    """Rows that share an id, or have none, are counted each by itself."""
    if shared:
        rng = random.Random(8)
        rows = [(rng.choice([None, *range(40)]), rng.choice(["a", "b", "b", None]), rng.choice([1, 9, 30, 31])) for _ in range(700)] + [(None, "b", 5)] * 301
    else:
        rows = [(1, "a", 100), (1, "b", 100), (2, "a", 50), (3, "b", 50), (None, "a", 50), (None, "b", 9)]
    docs = spark.createDataFrame([(d, " ".join(["w"] * n), s, n, i) for i, (d, s, n) in enumerate(rows)], "doc_id long, text string, source string, n_words long, copies int")
    plan = mixing.mix(docs).collect()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = out.collect()
    words, want, times = {}, {}, {}
    for r in plan:
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
    for r in got:
        words[r["source"]] = words.get(r["source"], 0) + r["n_words"]
        times[r["copies"]] = times.get(r["copies"], 0) + 1
    assert words == {s: n for s, n in want.items() if n}
    assert max(times.values()) <= 2
    groups: dict = {}
    for i, row in enumerate(rows):
        groups.setdefault(row, []).append(times.get(i, 0))
    assert all(max(g) - min(g) <= 1 for g in groups.values())
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, got))


def test_passages_of_repeated_rows_count_once(spark):
    rng = random.Random(17)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    shared = text(80)
    one, two = f"{text(40)} {shared} {text(40)}", f"{text(30)} {shared} {text(50)}"
    schema = "doc_id long, text string"
    plain = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame([(1, one), (2, two)], schema)).collect()}
    got = substring_dedup.substring_dedup(spark.createDataFrame([(1, one), (2, two), (2, two), (2, two)], schema)).collect()
    assert len(got) == 4 and all(r == plain[r["doc_id"]] for r in got)
    assert plain[2]["n_passages"] == 1 and plain[2]["removed_chars"] > 0 == plain[1]["removed_chars"]


@pytest.mark.parametrize("fits", [1 << 18, 3])
def test_components_against_union_find(spark, monkeypatch, fits):
    from logsluice.llm import components

    monkeypatch.setattr(components, "EDGES", fits)
    rng = random.Random(40)
    for n, m in ((1, 0), (2, 1), (60, 45), (200, 190), (40, 39)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if (n, m) != (40, 39) else [(i, i + 1) for i in range(39)]  # the last is a path
        least = list(range(n))
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                if least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
        got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert sorted((r["node"], r["component"]) for r in got) == [(i, c) for i, c in enumerate(least) if i != c]
