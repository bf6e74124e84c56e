"""The operators with a contract against plain brute-force versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import xxhash
from tokenizers import Tokenizer

from factloom.llm import multiset_hash, packing, simhash, token_counts

DOCS = "doc_id long, text string, lang string, bucket int, cell string"
ODD = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "one two",
    "<|endoftext|>a<|endoftext|>",
    "Über  straße   x　y \x85",
    "a" * 5000,
    "the same line\nthe same line\nanother",
    "another\nthe same line\nthe same line",
    "the same line\nanother",
    "aaa bbb ccc 123 4567!!! don't I'LL _x_",
    "한국어 텍스트 👍🏽 é",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "x") for i, t in rows], DOCS)


def odd_rows():
    return [(i, t) for i, t in enumerate(ODD)] + [(3, "dup id"), (None, "no id"), (None, None), (99, ODD[4]), (98, ODD[4]), (98, ODD[4])]


def words(rng, n):
    return [f"w{int(x)}" for x in rng.integers(0, 4000, n)]


def corpus(seed=3, n=150):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        t = words(rng, int(rng.integers(3, 400)))
        out.append((i, " ".join(t)))
        if i % 5 == 0:
            for j in range(3):
                u = list(t)
                u[int(rng.integers(len(u)))] = "edited"
                out.append((1000 + 10 * i + j, " ".join(u)))
    return out


def test_token_counts(spark):
    rows = odd_rows() + corpus()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)
    got = token_counts.token_counts(frame(spark, rows), P.path("byte_bpe_50k.json"))
    assert Counter(map(tuple, got.collect())) == want
    assert token_counts.token_counts(frame(spark, []), P.path("byte_bpe_50k.json")).collect() == []


def test_packing_holds_each_id_once(spark):
    rows = [(k, t) for k, (_, t) in enumerate(odd_rows() + corpus())] + [(5000, " ".join(words(np.random.default_rng(1), 9000)))]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    got = packing.pack(frame(spark, rows).repartition(2), P.path("word_bpe_49k.json")).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for s, n in sorted(by_doc[i]):
            assert s == at and n > 0
            at += n
        assert at == len(x)
    for pieces in by_seq.values():
        at = 0
        for s, n in sorted(pieces):
            assert s == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
    assert packing.pack(frame(spark, []), P.path("word_bpe_49k.json")).collect() == []


def test_packer_level_is_the_least_sum_of_squares():
    rng = np.random.default_rng(0)
    p = packing.Packer(16)
    for i in range(400):
        s = int(rng.integers(1, 16))
        n = p.counts.copy()
        best = {}
        for h in range(0, 16 - s + 1):
            if h and not n[h]:
                continue
            m = n.copy()
            m[h] -= h > 0
            m[h + s] += h + s < 16
            best[h] = int((m**2).sum())
        h = p.level(s)
        assert best[h] == min(best.values())
        p.add(i, s)


def test_packer_pours_when_many_are_open():
    p, out = packing.Packer(4096), []
    for i in range(5000):
        out += p.add(i, 3000)
        if p.waiting > packing.OPEN:
            out += p.pour()
        assert p.waiting <= packing.OPEN + 1
    out += p.finish()
    assert sum(x[2] for x in out) == 5000 * 3000


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] * (len(w) > 0)
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_simhash_components(spark):
    rows = odd_rows() + corpus()
    got = simhash.near_components(frame(spark, rows))
    assert Counter(map(tuple, got.collect())) == plain_components(rows)
    assert simhash.near_components(frame(spark, [])).collect() == []


def test_simhash_blocks_give_the_same_links(spark, monkeypatch):
    """A large group near one fingerprint: runs too long for a task go on in blocks."""
    rng = np.random.default_rng(7)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 900:
        f = list(fps)[int(rng.integers(len(fps)))]
        for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    signed = np.array(sorted(fps), np.uint64).view(np.int64)
    cell, role, i = simhash.half_cells(signed)
    points = [(int(c), 0, int(r), int(signed[x]), signed[x].tobytes()) for c, r, x in zip(cell, role, i)]
    df = spark.createDataFrame(points, "cell long, part int, role byte, id long, fp binary")
    from factloom.operators.graph import connected_components

    def grouped(links):
        roots = {r.node: r.root for r in connected_components(links).collect()}
        return Counter(Counter(roots.get(int(x), int(x)) for x in signed).values())

    far = np.bitwise_count(signed.view(np.uint64)[:, None] ^ signed.view(np.uint64)[None]) <= 3
    label = np.arange(len(signed))
    while True:
        new = np.array([label[far[i]].min() for i in range(len(label))])
        if (new == label).all():
            break
        label = new
    want = Counter(Counter(label.tolist()).values())
    assert grouped(simhash.grid_links(df, 3, 1)) == want
    assert grouped(simhash.grid_links(df, 3, 1, limit=30)) == want


def test_multiset_hash_contract(spark):
    rows = [(i, t) for i, t in odd_rows() if i is not None] + [(10_000 + i, t) for i, t in corpus()]
    got = multiset_hash.document_fingerprints(frame(spark, rows)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1].encode()))
    want = Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        h = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.fingerprint].add(r.doc_id)
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[9] == same[10] != same[11]  # the order of paragraphs does not matter, their number does
    assert multiset_hash.document_fingerprints(frame(spark, [])).collect() == []
    one = multiset_hash.document_fingerprints(frame(spark, [(1, "x\ny")])).collect()[0]
    assert one.near_next == 1


def test_multiset_hash_is_homomorphic(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\nb\nb", "b", "a\nb"), ("", "x", None), ("q", "q", "q\nq")], "t string, p string, u string")
    v = multiset_hash.vector
    r = df.select(
        (multiset_hash.deleted(multiset_hash.inserted(v(F.col("t")), F.col("p")), F.col("p")) == v(F.col("t"))).alias("back"),
        (multiset_hash.inserted(v(F.col("u")), F.col("p")) == v(F.col("t"))).alias("added"),
        (multiset_hash.deleted(v(F.col("t")), F.col("p")) == v(F.col("u"))).alias("removed"),
    ).collect()
    assert [x.back for x in r] == [True] * 3
    assert r[0].added and r[0].removed and not r[1].added


def test_next_document_does_not_depend_on_ranges(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    a = multiset_hash.with_next(frame(spark, rows).select("doc_id", "text"), ["text"], 2)
    b = multiset_hash.with_next(frame(spark, rows).select("doc_id", "text"), ["text"], 37)
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))
