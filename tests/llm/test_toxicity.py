"""The toxicity operator: its automaton against plain edit distances, its counts against
loops, contexts, held-out accuracy, and odd rows."""

import math
import random
import zlib

import numpy as np
import pytest

from factloom.llm import toxicity as T


def distance(a, b):
    """Edits and swaps of neighbours, no letter touched twice."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def plain_match(word, terms):
    best = []
    for n, t in enumerate(terms):
        if t.stem and word.startswith(t.text):
            best.append((t.weight * T.STEMMED, -n, 0))
        elif not t.stem and (e := distance(word, t.text)) <= t.allowed:
            best.append((t.weight * T.MISSPELLED**e, -n, e))
    return (-max(best)[1], max(best)[2]) if best else (-1, None)


def test_automaton_equals_edit_distances(monkeypatch):
    rng = random.Random(5)
    letters = "abcde"
    texts = {"".join(rng.choice(letters) for _ in range(n)) for n in (3, 4, 5, 6, 6, 7, 9, 9, 10, 12)} | {"scum", "abcab", "abcabd"}
    terms = [T.Term(t, False, 2 + 0.37 * k) for k, t in enumerate(sorted(texts))] + [T.Term("cad", True, 3.3), T.Term("ébé", True, 1.1)]
    words = ["".join(rng.choice(letters + "x") for _ in range(rng.randint(1, 13))) for _ in range(1500)] + ["ébéxyz", "cad", "ca", "cadabra" * 3]
    for t in terms:
        for _ in range(60):
            w = list(t.text)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(w))
                k = rng.randrange(4)
                if k == 0:
                    w[i] = rng.choice(letters)
                elif k == 1:
                    w.insert(i, rng.choice(letters))
                elif k == 2 and len(w) > 2:
                    del w[i]
                elif i:
                    w[i - 1], w[i] = w[i], w[i - 1]
            words.append("".join(w))
    codes = np.array([ord(c) for w in words for c in w], np.uint32)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    for states in (T.STATES, 3):  # and with a table that is forgotten between portions
        monkeypatch.setattr(T, "STATES", states)
        a = T.Automaton(terms)
        for _ in range(2):
            term, edits = a.match(codes, start, size)
            for w, t, e in zip(words, term.tolist(), edits.tolist()):
                want = plain_match(w, terms)
                assert t == want[0] and (t < 0 or e == want[1]), (w, t, e, want)


def test_words_and_disguises():
    texts = ["you stuuupid id1ot!!", "", "m0ron$$$ sc@m a-b", "straße ÉTÉ 4 a*b", "!x!"]
    w = T.words_of([t.lower() for t in texts])
    got = [("".join(map(chr, w.codes[s : s + n])), int(d), texts[d][f:e], bool(x)) for s, n, d, f, e, x in zip(w.start, w.size, w.doc, w.first, w.last, w.disguised)]
    assert got == [
        ("you", 0, "you", False), ("stupid", 0, "stuuupid", True), ("idiot", 0, "id1ot", True),
        ("moron", 2, "m0ron", True), ("scam", 2, "sc@m", True), ("a", 2, "a", False), ("b", 2, "b", False),
        ("straße", 3, "straße", False), ("été", 3, "ÉTÉ", False), ("a", 3, "4", True), ("a*b", 3, "a*b", False), ("x", 4, "x", False),
    ]
    assert len(T.words_of([]).start) == len(T.words_of(["", ""]).start) == 0


def test_quotation_and_abuse():
    def at(text, term="idiot"):
        return T.context(text, text.index(term), text.index(term) + len(term))

    assert at("he is an idiot and") == (False, 1.0)
    assert at('the "idiot" of the novel') == (True, T.QUOTED)
    assert at("the word idiot comes from") == (True, T.QUOTED)
    assert at('the word "idiot" comes') == (True, T.QUOTED / 2)
    assert at("you are an idiot, they said") == (False, T.ADDRESSED)
    assert at('you "idiot"') == (False, T.ADDRESSED)
    assert at('"well" an idiot he "is"') == (False, 1.0)
    assert at("«\nidiot »") == (False, 1.0)
    model = T.Model([T.Term("idiot", False, 5.0)], {"ediot": 0.0})
    x = T.features(["an idiot", 'an "idiot"', "an idoit", "an ediot", "an id1ot", "", "nothing"], model)
    s = x @ T.PRIOR
    assert s[0] > s[4] > s[2] > s[1] > s[6] == s[5] == s[3] == T.PRIOR[0]


def test_terms_are_those_of_the_counts():
    rows = [("bad", 40, 0), ("bad*", 40, 0), ("ba*", 40, 300), ("the", 50, 400), ("rare", 5, 0), ("vile*", 30, 1), ("vilest", 20, 0), ("oops", 9, 30)]
    terms = T.choose(rows, 50, 400)
    assert [(t.text, t.stem) for t in terms] == [("bad", False), ("vile", True)]
    assert terms[0].weight == pytest.approx(math.log(40.5 / 51) - math.log(0.5 / 401))
    o, n = np.array([[40, 0], [10, 400]]), 450
    e = o.sum(1, keepdims=True) * o.sum(0) / n
    assert T.g2(40, 0, 50, 400) == pytest.approx(2 * (o[o > 0] * np.log(o[o > 0] / e[o > 0])).sum())
    assert T.spelling_weight(4.0, 0, 900, 50, 400) == 0 and T.spelling_weight(4.0, 0, 0, 50, 400) > 2
    x = np.c_[np.ones(80), np.r_[np.zeros(60), np.ones(20)], np.zeros(80), np.zeros(80)]
    y = (np.arange(80) >= 60).astype(float)
    b = T.fit(x, y)
    g = x.T @ (y - 1 / (1 + np.exp(-x @ b))) - T.RIDGE * (b - T.PRIOR)
    assert np.abs(g).max() < 1e-6 and b[2] == T.PRIOR[2]
    assert (T.fit(x, np.zeros(80)) == T.PRIOR).all()


def test_copies_prove_nothing():
    text = "Alpha beta gamma; alpha beta"
    one = T.candidates(text)
    assert set(one) == {"alpha", "beta", "gamma", "alp*", "alph*", "bet*", "gam*", "gamm*"}
    assert [one[w].bit_count() for w in ("alpha", "beta", "gamma")] == [2, 1, 1]
    assert T.candidates(text, frozenset({"beta", "gam*"})).keys() == {"beta", "gam*"}
    assert T.apart(900, 1) < 1.1 and T.apart(900, (1 << T.BITS) - 1) == 900 and T.apart(3, 0b11111) == 3


def corpus(n=400):
    rng = random.Random(1)
    calm = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(20, 80))]
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "pathetic", "worthless"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    return docs, labels


D, L = "doc_id long, text string, toxic int, score double", "doc_id long, quality int, toxic int"


def test_held_out_documents_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, "idiot"), (None, None), (5000, ""), (5001, None), (5002, "you pathettic idoit " * 3), (5003, "x" * 300_000 + " worthless idiot" * 9000), (5004, 'the word "idiot" ' + "wab " * 50), (3, docs[3][1]), (3, docs[3][1])]
    frame = spark.createDataFrame([(i, t, 1, 0.5) for i, t in docs + odd], D).repartition(3)
    told = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None), (3, 1, 0)], L)
    rows = T.scored(frame, told).collect()
    assert len(rows) == len(docs) + len(odd)
    by_id = {r.doc_id: r for r in rows}
    assert [r.score for r in rows if r.doc_id == 3] == [by_id[3].score] * 3
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == (r.doc_id % 4 == 0)
    assert by_id[5000].predicted == by_id[5001].predicted == by_id[5004].predicted == 0
    assert by_id[5002].predicted == by_id[5003].predicted == 1
    assert {r.doc_id for r in rows if r.held_out and r.predicted} > {i for i in range(0, 400, 4) if zlib.crc32(str(i).encode()) % 4 == 2 and i < 200}


def test_labels_of_the_held_out_are_not_read(spark):
    docs, labels = corpus(200)
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    frame = spark.createDataFrame([(i, t, 1, 0.5) for i, t in docs], D)
    one = T.scored(frame, spark.createDataFrame(labels, L)).collect()
    other = T.scored(frame, spark.createDataFrame([(i, q, 1 - x if i in held else x) for i, q, x in labels], L)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_no_labels_and_no_documents(spark):
    frame = spark.createDataFrame([(1, "idiot", 1, 0.5), (2, None, 0, 0.5)], D)
    none = spark.createDataFrame([], L)
    assert {(r.score, r.predicted) for r in T.scored(frame, none).collect()} == {(round(1 / (1 + math.exp(4)), 9), 0)}
    assert T.scored(frame.limit(0), none).collect() == []
