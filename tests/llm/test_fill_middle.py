"""The fill-in-the-middle kernel against a plain version with a regular expression."""

import hashlib
import re
from collections import Counter

import pyarrow as pa

from factloom.llm import fill_middle

ODD = [
    None, "", " ", "\n\n", "a", "ab cd", "<P>x", "x<S", "<S>", ">", "<", "P>", "Über straße y \x85", "a" * 5000, "éé　é aß", "한국어 텍스트 👍🏽 é", "one <M> two", "<P", "tail <",
    "x" * 70_000 + " é", "a1b2c3", "\x00\x01z",
]


def plain(doc_id, text):
    text = text or ""
    words = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(words)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(words[:lo]), "".join(words[lo:hi]), "".join(words[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def test_equals_the_plain_version(spark):
    rows = [(100 * k + i, t) for k in range(25) for i, t in enumerate(ODD)] + [(None, "no id é b"), (None, None), (7, "same"), (7, "same"), (-3, "a b")]
    docs = spark.createDataFrame([(i, t, "x", "y", True) for i, t in rows], "doc_id long, text string, form string, output string, moved boolean")
    got = fill_middle.restored(fill_middle.transformed(docs.repartition(3))).collect()
    assert Counter(map(tuple, got)) == Counter(plain(*r) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.restored(fill_middle.transformed(docs.limit(0))).collect() == []


def test_digests_are_those_of_the_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((*p[:5], sha(p[5]), sha(p[6])) for p in (plain(i, t) for i, t in enumerate(ODD)))
    assert Counter(map(tuple, fill_middle.digests(fill_middle.transformed(docs)).collect())) == want


def test_slices_and_other_rates(spark):
    texts = pa.array(["zz", None, "ab é cd", "", "q <P>"])[1:]
    out = fill_middle.cut(texts, *(pa.array(x).to_numpy(zero_copy_only=False) for x in ([5, 2, 9, 1], [1, 4, 2, 0], [True] * 4, [True, False, True, False])))
    assert out[0].tolist() == [0, 5, 0, 5] and out[1].tolist() == ["plain", "psm", "plain", "plain"]
    assert out[4].to_pylist()[1] == "<P>ab <S>cd<M>é "
    docs = spark.createDataFrame([(i, "a b c d") for i in range(60)], "doc_id long, text string")
    assert {r.form for r in fill_middle.transformed(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_middle.transformed(docs, rate=100, spm_rate=100).collect()} == {"spm"}
