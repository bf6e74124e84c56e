"""Hard negatives against comparing every anchor with every row, and the tree's bounds."""

from collections import Counter

import numpy as np
import pytest

from factloom.llm import vantage_tree as V

SCHEMA = "vec_id long, embedding array<float>, label int, score double, leaf string"


def plain(rows, every=100, positives=5, negatives=5, share=80):
    whole = []
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            whole.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab))
    anchors = {}
    for i, v, lab in whole:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (v, lab)), (v, lab))
    out = []
    for a, (q, lab) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, v)), i, m == lab) for i, v, m in whole if i != a]
        own = sorted((s, i) for s, i, same in scored if same)[:positives]
        for n, (ps, p) in enumerate(own, 1):
            hard = sorted((s, i) for s, i, same in scored if not same and share * -ps <= 100 * -s <= 100 * -ps)[:negatives]
            out += [(a, p, r, i, -ps, -s, n) for r, (s, i) in enumerate(hard, 1)]
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0.5, "x") for i, v, lab in rows], SCHEMA)


def vectors(seed, n, dim, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dim))
    out = []
    for i in range(n):
        lab = int(rng.integers(labels))
        v = centre[lab] * 0.6 + rng.normal(size=dim) * rng.choice([0.3, 1.0])
        out.append((i, [float(x) for x in v.astype(np.float32)], lab))
    return out


def test_equals_all_pairs_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAF", 16)
    monkeypatch.setattr(V, "SAMPLED", 4)
    monkeypatch.setattr(V, "PAGE", 10)
    monkeypatch.setattr(V, "BLOCK", 3)
    monkeypatch.setattr(V, "FIRST", 1)
    monkeypatch.setattr(V, "FANOUT", 3)
    rows = vectors(1, 500, 6)
    rows += [(1000 + i, [0.5] * 6, i % 3) for i in range(120)]  # one vector many times, with anchors among its rows
    rows += [(2000, None, 1), (2100, [1.0, None], 1), (2200, [float("nan")] * 6, 1), (2300, [float("inf")] * 6, 1), (2400, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(2500, [0.25, -1.0], 2), (2600, [], 1), (100, [0.1] * 6, 1), (77, rows[77][1], rows[77][2]), (2700, [-9.0] * 6, 3)]
    got = V.hard_negatives(frame(spark, rows).repartition(3), every=20)
    assert Counter(map(tuple, got.collect())) == plain(rows, every=20)


@pytest.mark.parametrize("share", [80, 0, 100])
def test_other_windows(spark, share):
    rows = vectors(2, 90, 3, labels=2)
    got = V.hard_negatives(frame(spark, rows), every=10, positives=2, negatives=3, share=share)
    assert Counter(map(tuple, got.collect())) == plain(rows, 10, 2, 3, share)


def test_few_and_no_rows(spark):
    for rows in ([], [(100, None, 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 1)], [(100, [], 1), (1, [], 1), (2, [], 2)], [(100, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (6, [1.0, 1.9], 2), (7, [0.0, 0.0], 2)]):
        got = V.hard_negatives(frame(spark, rows))
        assert Counter(map(tuple, got.collect())) == plain(rows)
    with pytest.raises(ValueError, match="55 bits"):
        V.hard_negatives(frame(spark, [(100, [1e9], 1)]))


def test_bounds_hold_for_every_leaf(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAF", 20)
    rows = vectors(3, 400, 5)
    index, pages = V.indexed(V.labelled(frame(spark, rows)))
    assert index.tree.leaves > 8 and int(index.size.sum()) == 400
    held = [r for p in pages.collect() for r in zip(np.frombuffer(p.ids, np.int64).tolist(), [p.leaf] * 10**6, np.frombuffer(p.vecs, index.kind).reshape(-1, 5).astype(float))]
    assert sorted(i for i, _, _ in held) == list(range(400))
    skipped = 0
    for _, _, q in held[:40]:
        low, high, far = index.bounds(q)
        d = {i: (leaf, float(np.sqrt(((index.space.lift(v[None]) - index.space.query(q[None])) ** 2).sum()))) for i, leaf, v in held}
        assert all(low[leaf] - index.slack <= x <= high[leaf] + index.slack for leaf, x in d.values())
        tenth = sorted(x for _, x in d.values())[10]
        skipped += int((low > tenth).sum())
    assert skipped  # the bounds rule out leaves
