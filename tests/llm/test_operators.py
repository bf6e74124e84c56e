"""The other operators against brute force, exact round trips or held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from test_contracts import ODD, corpus, frame, odd_rows, words
from tokenizers import Tokenizer

from factloom.llm import array_bpe, cross_entropy, line_dedup, metric_tree, mixing, quality, simhash, training_order

TIKTOKEN = P.path("byte_bpe_50k.tiktoken")


# 1 ---------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = training_order.Feistel(n, 9)
    slots = f.slot(np.arange(n))
    assert sorted(slots) == list(range(n))
    assert (f.number(slots) == np.arange(n)).all()
    if n > 100:
        assert (slots != training_order.Feistel(n, 10).slot(np.arange(n))).any()


def encode(text):
    with open(TIKTOKEN, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("ids", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return np.array([*library.encode_ordinary(text or ""), training_order.END], "<u2")


def test_training_order_round_trip(spark, tmp_path):
    rows = odd_rows() + corpus() + [(-1, "minus one"), (7000, " ".join(words(np.random.default_rng(2), 30_000)))]
    folder = f"file://{tmp_path}/shards"
    made = training_order.materialise(frame(spark, rows).repartition(3), P.path("byte_bpe_50k.json"), folder, sequence=16, per_shard=100)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "shards").rglob("*")}
    got = made.collect()
    made.count()
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "shards").rglob("*")} == files  # actions write nothing
    want = Counter()
    for i, t in rows:
        ids = encode(t)
        for s in range(0, len(ids), 16):
            want[i, s, ids[s : s + 16].tobytes()] += 1
    assert sorted(r.slot for r in got) == list(range(sum(want.values())))
    read = list(training_order.read_slots(folder, 0, len(got), 16, 100))
    assert Counter((d, s, ids.tobytes()) for d, s, _, ids in read) == want
    by = {r.slot: r for r in got}
    for slot, (d, s, n, ids) in enumerate(read):
        r = by[slot]
        assert (r.doc_id, r.start, r.length, r.ids_crc32, r.shard) == (d, s, n, zlib.crc32(ids.tobytes()), slot // 100)
    resumed = list(training_order.read_slots(folder, 95, 20, 16, 100))
    assert [(d, s) for d, s, _, _ in resumed] == [(d, s) for d, s, _, _ in read[95:115]]
    assert training_order.materialise(frame(spark, []), P.path("byte_bpe_50k.json"), folder + "2").collect() == []


@pytest.mark.parametrize("kind", ["word", "byte", "ordinary"])
def test_array_tokenizer_is_the_library(kind, monkeypatch):
    monkeypatch.setattr(array_bpe, "MEMORY", 500)
    monkeypatch.setattr(array_bpe, "CHUNK", 3000)
    path = P.path("word_bpe_49k.json" if kind == "word" else "byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = kind == "ordinary"
    mine = array_bpe.word_tokenizer(path) if kind == "word" else array_bpe.byte_tokenizer(path, kind == "byte")
    parts = [*"abc'stmdrevl  \n\t\r019!?.,_", "'s", "'ll", "'re", " '", "  ", "'LL", "é", "ß", "\u2026", "\u3000", "\u2177", "\u4f60", "\u044b", "\x85", "\xa0", "\xbd", "<|", "<|endoftext|>", "\U0001f44d", "e\u0301", "\ue000"]
    rng = random.Random(4)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in mine.encode(texts)] == want
    assert mine.counts(texts).tolist() == list(map(len, want))


# 2 ---------------------------------------------------------------------------


def normal(line):
    """(words, form)"""
    low = line.lower()
    if len(line.encode()) >= line_dedup.WIDE * max(1, len(line)):
        w = [c for c in low if c.isalnum()]
        return tuple(w), "".join(w)
    w = [w for w in re.split(r"[\W_]+", low) if w]
    return tuple(w), " ".join(w)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sim64(ws):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in ws]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_line_dedup(rows):
    forms, first = {}, {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            w = normal(line)
            if w[0]:
                forms.setdefault(w, sim64(w[0]))
                at = (d is not None, d or 0, i)
                first[w] = min(first.get(w, at), at)
    root = {w: w for w in forms}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = list(forms)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (forms[a] ^ forms[b]).bit_count() <= 3:
                x, y = a[1], b[1]
                if edit(x, y) <= np.floor((1 - line_dedup.SIMILAR) * max(len(x), len(y)) + 1e-9):
                    root[find(a)] = find(b)
    kept = {}
    for w in every:
        r = find(w)
        kept[r] = min(kept.get(r, first[w]), first[w])
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None))
            continue
        left = []
        for i, line in enumerate(t.split("\n")):
            w = normal(line)
            if not w[0] or kept[find(w)] == (d is not None, d or 0, i):
                left.append(line)
        out.append((d, "\n".join(left)))
    return Counter(out)


def lined():
    rng = np.random.default_rng(4)
    rows, base = [], [" ".join(f"word{int(x)}" for x in rng.integers(0, 900, 60)) for _ in range(12)]
    for i in range(60):
        some = []
        for b in rng.choice(12, 3):
            w = base[int(b)].split()
            if rng.random() < 0.6:
                w[int(rng.integers(60))] = f"other{int(rng.integers(5))}"
            some.append((" ".join(w)).title() + "!" if rng.random() < 0.3 else " ".join(w))
        some.append(f"only here {i} and nowhere else at all")
        some.append("short line")
        rows.append((100 + i, "\n".join(some)))
    return rows


def test_line_dedup(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + lined() + [(100, lined()[0][1]), (None, "a b c d e f\nx"), (1, "a b c d e f")]
    df = frame(spark, rows)
    got = line_dedup.deduplicated(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == plain_line_dedup(rows)
    assert line_dedup.deduplicated(frame(spark, [])).collect() == []
    told = line_dedup.report(df).collect()
    assert len(told) == len(rows) and all(r.n_kept <= r.n_lines for r in told)


def test_line_dedup_bits_are_simhash(spark, monkeypatch):
    ws = [f"w{i} " * (i % 5 + 1) + "some more words here" for i in range(50)]
    df = frame(spark, list(enumerate(ws))).select("doc_id", "text")
    for most in (32_767, 6):  # lanes, and bit by bit
        monkeypatch.setattr(line_dedup, "MAX_WORDS", most)
        got = {r.doc_id: r.sim % (1 << 64) for r in line_dedup.fingerprints(df).collect()}
        assert got == {i: sim64(normal(t)[0]) for i, t in enumerate(ws)}


def test_line_dedup_of_a_very_long_line(spark):
    line = " ".join(words(np.random.default_rng(3), 34_000))
    rows = [(1, line), (2, "one here\n" + line.replace(" w7 ", " w8 ", 3)), (3, line.upper())]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(frame(spark, rows)).collect()}
    assert got == {1: line, 2: "one here", 3: ""}


def test_line_dedup_of_a_line_whose_lanes_would_overflow(spark):
    line = " ".join(words(np.random.default_rng(4), 70_000))
    got = line_dedup.fingerprints(frame(spark, [(1, line), (2, "same " * 70_000 + "\none here")]))
    want = {(1, 0): sim64(normal(line)[0]), (2, 0): xxhash.xxh64_intdigest(b"same", 42), (2, 1): sim64(["one", "here"])}
    assert {(r.doc_id, r.line_no): r.sim % (1 << 64) for r in got.collect()} == want


def test_line_dedup_reads_texts_without_long_lines_once(spark, tmp_path):
    frame(spark, [(i, f"line number {i}\nand more of it") for i in range(20)]).write.parquet(str(tmp_path / "d"))
    found = line_dedup.fingerprints(spark.read.parquet(str(tmp_path / "d")))
    assert found.count() == 40 and "FileScan" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cell", [1, 256])
def test_line_dedup_of_crowded_blocks(spark, cell, monkeypatch):
    monkeypatch.setattr(line_dedup, "CELL", cell)
    monkeypatch.setattr(line_dedup, "PIVOTS", 2)
    rng = np.random.default_rng(6)
    some = []
    for b in range(2):
        base = [f"b{b}{i % 5}" for i in range(60)]
        for i in range(16):
            w = list(base)
            for at in rng.integers(0, 60, 1 + i % 3):
                w[int(at)] = f"x{i}"
            some.append(" ".join(w[30:] + w[:30] if i % 5 == 4 else w))  # turned about: equal bits, many edits
    rows = [(i, t) for i, t in enumerate(some)]
    assert Counter((r.doc_id, r.text) for r in line_dedup.deduplicated(frame(spark, rows)).collect()) == plain_line_dedup(rows)


def test_line_dedup_of_short_lines_other_scripts_and_odd_names(spark):
    chinese = "今天天气很好我们一起去公园散步看花然后回家吃饭休息看书写字听音乐最后睡觉明天再去" * 6
    rows = [(1, "Les.\n---\n\n" + chinese), (2, "les\n---\n\n" + chinese[:20] + "的" + chinese[21:]), (None, "les\nnew"), (None, "les\nold")]
    want = plain_line_dedup(rows)
    assert want[None, "les\nnew"] == 1 and want[1, "---\n\n" + chinese] == 1 and want[2, "---\n"] == 1
    df = frame(spark, rows)
    odd = df.selectExpr("doc_id", "text", "lang as gone", "bucket as h", "lang as __gone", "lang as doc", "lang as g", "bucket as `text.x`")
    got = line_dedup.deduplicated(odd)
    assert got.columns == odd.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_line_dedup_of_repeated_words_and_spread_edits(spark):
    lines = ["0 " * 40 + "17 23 95", "0 " * 40 + "41 68 52", "win " * 30 + "alpha beta", "win " * 30 + "gamma delta"]
    rng = np.random.default_rng(8)
    for i in range(6):
        w = [f"{int(x)}word" for x in rng.integers(0, 90, 8)] + ["common"] * 40
        rng.shuffle(w)
        line = " ".join(w)
        at = set(range(5, len(line), 17))  # an edit in each piece of 20 characters
        lines += [line, "".join("q" if j in at and c == "m" else c for j, c in enumerate(line))]
    rows = [(i, line) for i, line in enumerate(lines)]
    want = plain_line_dedup(rows)
    assert want[1, ""] == want[3, ""] == 1
    assert Counter((r.doc_id, r.text) for r in line_dedup.deduplicated(frame(spark, rows)).collect()) == want


# 4 ---------------------------------------------------------------------------


def mix_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"t{int(rng.integers(40))} " + "w " * int(rng.integers(0, 90)), ["en", "de", None][int(rng.integers(3))], f"s{min(int(rng.integers(9)), 5)}") for i in range(3000)]
    rows += [(None, None, None, None), (5, "", "en", "s0"), (5, "x", "en", "s0")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_mixing_equals_sql(spark, tmp_path):
    df = mix_rows(spark)
    df.coalesce(1).write.parquet(f"{tmp_path}/documents")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 6), r[6]) for r in c.execute(mixing.query_sql()).fetchall())
    got = Counter((r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(r.probability, 6), r.sampled) for r in mixing.mixed(df).collect())
    assert got == want
    kept = Counter(r.doc_id for r in mixing.sampled(df).collect())
    assert kept == Counter(k[0] for k, n in want.items() for _ in range(n) if k[6])


def test_mixing_takes_the_topics_of_the_table(spark):
    df = mix_rows(spark).selectExpr("*", "case when doc_id % 3 = 0 then null else concat('about ', doc_id % 3) end as topic")
    got = mixing.mixed(df).collect()
    assert len(got) == df.count() and {r.topic for r in got} == {"(none)", "about 1", "about 2"}


def test_mixing_reaches_its_margins(spark):
    rows = mixing.mixed(mix_rows(spark)).collect()
    cells, total = defaultdict(float), sum(r.n_tokens for r in rows)
    for r in rows:
        for c in mixing.MARGINS:
            cells[c, r[c]] += r.n_tokens * r.probability
    for c, power in mixing.POWERS.items():
        tokens = Counter()
        for r in rows:
            tokens[r[c]] += r.n_tokens
        norm = sum(t**power for t in tokens.values() if t)
        for v, t in tokens.items():
            if t > 0.02 * total:
                assert abs(cells[c, v] - 0.8 * total * t**power / norm) < 0.08 * total
    assert mixing.mixed(frame(spark, []).withColumnsRenamed({"cell": "source"})).collect() == []


# 5 in the pipeline -----------------------------------------------------------


def jaccard(a, b, k=5):
    def sh(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y)


def test_near_groups_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    rows, pairs = [], []
    for i in range(120):
        n = int(rng.integers(40, 400))
        t = [f"v{int(x)}" for x in rng.integers(0, 3000, n)]
        rows.append((2 * i, " ".join(t)))
        u = list(t)
        for at in rng.choice(n, max(1, int(n * rng.choice([0.004, 0.01, 0.1]))), replace=False):
            u[at] = "changed" + str(int(rng.integers(1000)))
        rows.append((2 * i + 1, " ".join(u)))
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    group = {r.doc_id: r.component_id for r in simhash.near_groups(frame(spark, rows)).collect()}
    hit = [group[2 * i] == group[2 * i + 1] for i in range(120)]
    close = [h for h, j in zip(hit, pairs) if j >= 0.85]
    assert len(close) > 40 and sum(close) >= 0.97 * len(close)
    assert not any(h for h, j in zip(hit, pairs) if j < 0.6)
    assert all(group[d] // 2 == d // 2 for d in group)  # nothing else is tied


def test_near_groups_are_exact_around_the_bound(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(150):
        n = int(rng.integers(60, 300))
        t = [f"v{int(x)}" for x in rng.integers(0, 3000, n)]
        m, at = int(n * rng.uniform(0.08, 0.15)), int(rng.integers(0, n // 2))
        new = [f"z{int(x)}" for x in rng.integers(0, 3000, 2 * m)]
        u = [t[:at] + new[:m] + t[at + m :], t + new, [new[0] if x % 55 == 0 else w for x, w in enumerate(t)]][i % 3]
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(u))]
    group = {r.doc_id: r.component_id for r in simhash.near_groups(frame(spark, rows)).collect()}
    near = [jaccard(rows[2 * i][1], rows[2 * i + 1][1]) for i in range(150)]
    assert all(sum(lo <= j < hi for j in near) > 15 for lo, hi in ((0.75, 0.8), (0.8, 0.85)))
    assert [group[2 * i + 1] == 2 * i for i in range(150)] == [j >= 0.8 for j in near]
    assert all(group[2 * i] == 2 * i for i in range(150))


def test_near_groups_link_fingerprints_first(spark, monkeypatch):
    """Copies with one changed word are tied by SimHash on the grid; others by their shingles."""
    rng = np.random.default_rng(31)
    rows = []
    for i in range(20):
        t = [f"v{int(x)}" for x in rng.integers(0, 3000, 400)]
        rows += [(3 * i, " ".join(t)), (3 * i + 1, " ".join(t[:-1] + ["other"])), (3 * i + 2, " ".join(t[:370] + [f"n{int(x)}" for x in rng.integers(0, 3000, 20)]))]
    links, tied = simhash.fingerprint_links, []
    monkeypatch.setattr(simhash, "fingerprint_links", lambda prints: tied.append(links(prints)) or tied[-1])
    group = {r.doc_id: r.component_id for r in simhash.near_groups(frame(spark, rows)).collect()}
    assert group == {d: d // 3 * 3 for d, _ in rows}
    prints = {simhash.fingerprint(t, simhash.K): d for d, t in rows}
    found = {frozenset((prints[r.a] // 3, prints[r.b] // 3)) for r in tied[0].collect()}
    near = {frozenset((prints[p] // 3, prints[q] // 3)) for p in prints for q in prints if p < q and ((p ^ q) & (2**64 - 1)).bit_count() <= simhash.RADIUS}
    assert len(tied) == 1 and found == near and all(len(f) == 1 for f in found) and found


def test_without_near_copies(spark):
    rows = odd_rows() + [(500 + i, "one and the same text of a number of words " * 3) for i in range(40)] + [(3, "dup id"), (400, "nothing like the other"), (400, "another text of this id"), (400, "another text of this id")]
    df = frame(spark, rows)
    got = simhash.without_near_copies(df)
    assert got.columns == df.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert [i for i in ids if i is not None and i >= 500] == [500]
    # of rows with one doc_id those with unlike texts stay, and one of those with equal texts
    assert ids[None] == 2 and ids[3] == 1 and ids[400] == 2
    assert simhash.without_near_copies(frame(spark, [])).collect() == []


def test_a_hot_group_is_one_component(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(700):
        t = list(base)
        t[int(rng.integers(200))] = f"x{i}"
        rows.append((i, " ".join(t)))
    for limit in (simhash.SENT, 90):
        got = simhash.near_groups(frame(spark, rows), limit=limit).collect()
        assert {r.component_id for r in got} == {0}


# 6 ---------------------------------------------------------------------------


def plain_top(rows, k, every):
    ok = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in sorted(ok, key=lambda r: r[1], reverse=True):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out[i] = [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return Counter(x for v in out.values() for x in v)


@pytest.mark.parametrize("seed,n,dim,leaf", [(1, 900, 8, 16), (2, 700, 64, 32), (3, 3, 4, 512), (4, 400, 2, 8)])
def test_top_k_against_all_pairs(spark, seed, n, dim, leaf, monkeypatch):
    monkeypatch.setattr(metric_tree, "LEAF", leaf)
    monkeypatch.setattr(metric_tree, "PAGE", 40)
    monkeypatch.setattr(metric_tree, "BLOCK", 7)
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=dim) * (3 if i % 7 == 0 else 1)).tolist()) for i in range(n)]
    rows += [(1000 + i, [0.5] * dim) for i in range(n // 4)]  # ties
    rows += [(5000, None), (5050, [None] * dim), (5100, [float("nan")] * dim), (5150, [float("inf")] * dim), (None, [1.0] * dim), (2000, [0.0] * dim)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, leaf string")
    got = metric_tree.search(df, 5, 50)
    assert Counter(map(tuple, got.collect())) == plain_top(rows, 5, 50)


def test_top_k_sends_no_partition_of_routing_vectors_to_the_driver(spark):
    """Each of 64 partitions may not send its own sample; copies alone give one vector."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(64)
    data = metric_tree.quantised(df).cache()
    assert data.count() == 6000
    some = metric_tree.routing_sample(data, 6000, 100)
    assert 90 <= len({tuple(v) for v in some}) == len(some) <= 100
    same = spark.createDataFrame([(i, [0.5, 1.0]) for i in range(5000)], "vec_id long, embedding array<float>")
    assert metric_tree.routing_sample(metric_tree.quantised(same), 5000, 10) == [[128, 256]]
    data.unpersist()


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert metric_tree.search(df).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert metric_tree.search(one).collect() == []


# 7 ---------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("doc_id % 4 <> 0")
    held = {r.doc_id: r for r in labels.where("doc_id % 4 = 0").collect()}
    kept = {r.doc_id for r in quality.scored(docs, train).where(f"tail_probability >= {quality.KEEP}").collect()}
    rate = lambda f: np.mean([d in kept for d, r in held.items() if f(r)])
    assert rate(lambda r: r.quality == 1 and r.toxic == 0) > 0.97
    assert rate(lambda r: r.toxic == 1) < 0.1
    assert rate(lambda r: r.quality == 0) < 0.1


def test_classifier_edge_cases(spark):
    df = frame(spark, odd_rows())
    none = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.selected(df, none).count() == df.count()
    labels = spark.createDataFrame([(4, 1, None), (4, 0, 0), (5, 1, 0), (6, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    scored = quality.scored(df, labels).collect()
    assert len(scored) == df.count() and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in scored)
    assert quality.selected(df, labels).columns == df.columns
    assert quality.scored(frame(spark, []), labels).collect() == []


# 9 ---------------------------------------------------------------------------


def test_cross_entropy_against_a_plain_model(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + corpus(n=30) + [(None, "x y")]
    labels = spark.createDataFrame([(4, 1, 0), (10, 1, 0), (9, 1, 1), (8, 0, 0), (None, 1, 0), (12, 1, None), (12, 0, 0)], "doc_id long, quality int, toxic int")
    target = {4, 10, 12}
    counts = [Counter(), Counter()]

    def split(t):
        return (t or "").encode().lower().split()

    for d, t in rows:
        counts[1].update(split(t))
        if d in target:
            counts[0].update(split(t))
    size = sum(counts[0].values())
    share = size / sum(counts[1].values())
    models = []
    for i, c in enumerate(counts):
        pair, one, after = Counter(), Counter(), defaultdict(set)
        for w in c:
            b = b" " + w + b" "
            for x, y in zip(b, b[1:]):
                pair[x, y] += 1
                one[y] += 1
                after[x].add(y)
        total = sum(one.values())

        def spelling(w, pair=pair, one=one, after=after, total=total):
            p, b = 0.0, b" " + w + b" "
            for x, y in zip(b, b[1:]):
                q, n = (one[y] + 1) / (total + 256), sum(pair[x, z] for z in after[x])
                p += np.log2((pair[x, y] + len(after[x]) * q) / (n + len(after[x])) if n else q)
            return p

        drawn = sum(1 - (1 - share) ** n for n in c.values()) if i else len(c)

        def loss(w, c=c, spelling=spelling, drawn=drawn, r=share if i else 1):
            seen = np.log2(r * c[w]) if c[w] else -np.inf
            return np.log2(size + drawn) - np.logaddexp2(seen, np.log2(drawn) + spelling(w))

        models.append({w: loss(w) for w in counts[1]})
    want = defaultdict(list)
    for d, t in rows:
        some = split(t)
        m = [sum(p[w] for w in some) / len(some) if some else 0.0 for p in models]
        want[d].append((len(some), *m))
    for frequent in (cross_entropy.FREQUENT, 20):
        got = defaultdict(list)
        for r in cross_entropy.score(frame(spark, rows).repartition(3), labels, frequent=frequent).collect():
            assert abs(r.difference - (r.target_loss - r.background_loss)) < 1e-8
            got[r.doc_id].append((r.n_tokens, r.target_loss, r.background_loss))
        assert got.keys() == want.keys()
        for d in want:
            np.testing.assert_allclose(sorted(got[d]), sorted(want[d]), atol=1e-6)
    assert cross_entropy.score(frame(spark, []), labels).collect() == []
    alone = cross_entropy.score(frame(spark, [(1, "a b"), (2, None)]), labels).collect()  # no document is labelled
    assert {r.doc_id: r.target_loss for r in alone} == {1: 16.0, 2: 0.0}


def test_cross_entropy_tells_words_of_any_script(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(["мир", "дом", "лес", "река"] if i % 2 else ["рим", "мод", "сел", "акер"]))) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.difference for r in cross_entropy.score(frame(spark, rows), labels).collect()}
    assert max(got[i] for i in range(1, 40, 2)) < min(got[i] for i in range(0, 40, 2))


def test_lines_of_a_crowded_block_meet_in_their_length_class(spark):
    """Near lines of lengths on both sides of a class's end; lengths at the bound itself."""
    rows = [(n, n, 0, float(m)) for n, m in enumerate([9, 10, 1, 1, 90, 100, 99, 110, 899, 999, 45, 50])]
    forms = spark.createDataFrame([(0, 0, 0, n, n, int(m)) for n, _, _, m in rows], "key long, rest long, top int, sim long, h long, n_chars int")
    keys = {}
    for r in line_dedup._lengths(forms).collect():
        keys.setdefault(r.h, set()).add(r.key)
    for a, _, _, m in rows:
        for b, _, _, n in rows:
            if abs(m - n) <= 0.1 * max(m, n) + 1e-9:
                assert keys[a] & keys[b]
            elif max(m, n) > 1.4 * min(m, n):
                assert not keys[a] & keys[b]


def test_lines_meet_once_on_two_blocks(spark, monkeypatch):
    """All pairs within three bits, each in one cell; a line is cut in cells by few bits more than 16."""
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    sims = base + [b ^ sum(1 << int(i) for i in rng.choice(63, int(n), replace=False)) for b in base for n in rng.integers(1, 6, 6)]
    forms = spark.createDataFrame([(i, s, 100) for i, s in enumerate(sims)], "h long, sim long, n_chars int")
    want = {(i, j) for i, a in enumerate(sims) for j, b in enumerate(sims) if i < j and (a ^ b).bit_count() <= 3}
    pairs, crowded = line_dedup.candidates(forms)
    got = [tuple(r) for r in pairs.collect()]
    assert crowded is None and set(got) == want and len(got) == len(want) > 50
    dealt = line_dedup._two_blocks(forms)
    for rows in (dealt, dealt.drop("key")):  # no pair is met twice
        assert sorted(map(tuple, line_dedup._met(rows).collect())) == sorted(want)
    # one block of 16 bits that a table's lines share does not bring them together
    alike = spark.createDataFrame([(i, int(x) << 16 | 7, 100) for i, x in enumerate(rng.integers(0, 1 << 47, 600))], "h long, sim long, n_chars int")
    largest = line_dedup._two_blocks(alike).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert largest <= line_dedup.CELL


def test_runs_lost_are_edits_at_least():
    """As _runs_lost counts: runs of five side by side, looked for about their place."""
    rng = np.random.default_rng(10)
    for _ in range(300):
        s = "".join(rng.choice(list("abcd "), int(rng.integers(0, 90))))
        t = list(s)
        for _ in range(int(rng.integers(0, 9))):
            at = int(rng.integers(0, len(t) + 1))
            t[at : at + int(rng.integers(0, 2))] = list(rng.choice(list("abcdx"), int(rng.integers(0, 2))))
        t, g = "".join(t), line_dedup.GRAM
        most = edit(s, t)
        lost = sum(s[i : i + g] not in t[max(0, i - most) : i + most + g] for i in range(0, len(s) - g + 1, g))
        assert lost <= most


def test_verification_in_spark_is_the_edit_similarity(spark):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(150):
        s = " ".join(rng.choice(["ab", "cde", "fghij", "kä", "lmnopqr"], int(rng.integers(1, 30))))
        t = "".join(c if rng.random() > 0.1 * rng.random() * 2 else str(rng.choice(["", "x", c + "y"])) for c in s)
        texts.append((s, t))
    df = spark.createDataFrame(texts, "s string, t string")
    for r in df.select("s", "t", line_dedup.similar(df.s, df.t).alias("told")).collect():
        assert r.told == (edit(r.s, r.t) <= np.floor((1 - line_dedup.SIMILAR) * max(len(r.s), len(r.t)) + 1e-9))


def test_unlike_forms_are_counted_to_the_bound_alone(spark):
    """Of two long forms with nothing in common neither count goes on once it is over `most`."""
    df = spark.createDataFrame([("ab cd " * 500, "xy zw " * 500, 20)], "s string, t string, most int")
    both = F.struct(F.split("s", " ").alias("x"), F.split("t", " ").alias("y"), F.col("most"))
    edits, lost = df.select(line_dedup._let(both, line_dedup._edits_at_most), line_dedup._runs_lost(df.s, df.t, df.most)).first()
    assert 20 < edits < 25 and lost == 21


def test_only_lines_at_the_places_are_read(spark):
    docs = frame(spark, [(1, "a\nb\nc"), (1, "d"), (None, "e\nf"), (2, None), (3, "g\nh")])
    at = spark.createDataFrame([(10, 1, 0), (12, 1, 2), (20, None, 1), (30, 2, 0), (40, 9, 0)], "h long, doc_id long, line_no int")
    got = line_dedup.lines_at(docs, at)
    assert sorted(map(tuple, got.collect())) == [(10, "a"), (10, "d"), (12, "c"), (20, "f")]
    # documents meet their places before a line of theirs is made a row
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.index("Generate explode") < plan.index("Join Inner")


# the pipeline ----------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            after = {r.doc_id: r for r in docs.collect()}
            assert after.keys() <= before.keys() and after
            if name == "line_dedup":
                assert after.keys() == before.keys()
                assert Counter((d, r.text) for d, r in after.items()) == plain_line_dedup([(d, r.text) for d, r in before.items()])
            else:
                assert all(after[d] == before[d] for d in after)
        else:
            assert {r.doc_id for r in docs.collect()} == before.keys()
    assert hashlib and seen


def test_segment_counts_bound_the_difference():
    rng = np.random.default_rng(21)
    for n in (0, 1, 50, 5000):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(-(2**63), 2**63 - 1, n // 3)]))
        a, b = (np.frombuffer(simhash.segment_counts(s), np.uint8).astype(int) for s in (x, y))
        assert np.abs(a - b).sum() <= len(np.setxor1d(x, y)) and a.sum() == len(x)
