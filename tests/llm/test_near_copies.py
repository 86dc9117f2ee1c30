import random

import numpy as np
from tests.llm import helpers as H

from cellwright.llm import neardup as N
from cellwright.llm.common import text_bytes

import pyarrow as pa


def classes_by_hand(rows):
    """Class of each row: equal texts, similar texts, null texts by id."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, t, *_) in enumerate(rows):
        for j, (b, u, *_) in enumerate(rows[:i]):
            if (t is None or u is None) and (t is u and a == b) or t is not None and u is not None and (t == u or H.similarity(t, u) >= 0.8):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return {(r[0], r[1]): (min((x[0] for x in g if x[0] is not None), default=None), k) for k, g in groups.items() for r in g}


def test_probability_jaccard():
    rng = random.Random(1)
    a = H.prose(rng, 60, 30)
    for b in (a, H.edited(rng, a, 3), H.edited(rng, a, 20), H.prose(rng, 60, 30), a + " " + a, "w1é"):
        x, y = N._split(pa.array([a, b], pa.string()))
        assert abs(N.probability_jaccard(x, y) - H.similarity(a, b)) < 1e-9


def test_signatures_estimate_it():
    rng = random.Random(2)
    a = H.prose(rng, 300)
    b, c = H.edited(rng, a, 6), a + " " + " ".join(a.split(" ")[:150])
    doc, ids, count = N.shingles(*text_bytes(pa.array([a, b, c, "", "one"], pa.string())))
    sig = N.signatures(doc, ids, count, 5, 4096)
    for i, t in ((1, b), (2, c)):
        assert abs((sig[0] == sig[i]).mean() - H.similarity(a, t)) < 0.04
    assert len(set(sig[4].tolist())) == 1 and (sig[3] == 0).all()
    # a text alone has the same signature as among others
    alone = N.signatures(*N.shingles(*text_bytes(pa.array([b], pa.string()))), 1, 4096)
    assert (alone[0] == sig[1]).all()


def test_classes(spark):
    rows = H.texts()
    got = N.classes(H.documents(spark)).collect()
    assert len(got) == len(rows)
    want = classes_by_hand(rows)
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == sorted(((i, want[i, t][0]) for i, t, _ in rows), key=repr)
    kept = N.drop_duplicates(H.documents(spark))
    assert kept.columns == H.documents(spark).columns
    keep = kept.collect()
    assert len(keep) == len({want[r.doc_id, r.text][1] for r in keep}) == len({k for _, k in want.values()})
    assert N.classes(H.documents(spark, [])).count() == 0


def test_a_wide_group(spark):
    """Copies at all distances: chains must hold together, and what is too far must stay apart."""
    rng = random.Random(4)
    base = H.prose(rng, 150)
    rows = [(i, H.edited(rng, base, i % 12), "s") for i in range(90)] + [(100 + i, H.prose(rng, 30), "s") for i in range(30)]
    want = classes_by_hand(rows)
    got = {(r.doc_id, r.class_id) for r in N.classes(H.documents(spark, rows)).collect()}
    assert got == {(i, want[i, t][0]) for i, t, _ in rows}
    assert len(set(want.values())) > 30


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 102), (102, 101), (200, 200)]
    df = spark.createDataFrame([(f"{a:03}".encode(), f"{b:03}".encode()) for a, b in edges], "a binary, b binary")
    got = {bytes(r.node): bytes(r.comp) for r in N.components(df).collect()}
    assert {k: v for k, v in got.items() if k < b"100"} == {f"{i:03}".encode(): b"000" for i in range(51)}
    assert got[b"101"] == got[b"102"] == b"100"
    assert np.unique(list(got.values())).size == 3
