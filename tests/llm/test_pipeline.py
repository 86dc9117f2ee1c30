import hashlib
import math
import random
import re

import numpy as np
import pytest
from tests.llm import helpers as H

import __spark_entry__ as entry

from cellwright.llm import sharding, toxicity

pipeline = pytest.importorskip("corpus_pipeline")


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and len([n for n in names if n.startswith("op") and n[2].isdigit()]) == 10
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


def test_stages(spark, tmp_path):
    rows = [(i, t, s) for i, t, s in H.texts() if i is not None]
    rng = random.Random(8)
    rows += [(600 + i, "you worthless idiot " + H.prose(rng, 60), "s1") for i in range(60)]
    docs = H.documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 600)) for i, _, _ in rows if i not in (3, 4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[2][1].split(" ")[5:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps, df = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        df = spark.read.parquet(f"{tmp_path}/out-{name}")
        steps[name] = df
        if name != "sharding":
            assert df.columns == docs.columns
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in steps.items()}
    assert sum(i >= 600 for i in ids["toxicity"]) < 3 and {0, 1, 2, 52} <= ids["toxicity"]
    assert {0, 1, 2} <= ids["near_dedup"] and not ids["near_dedup"] & {20, 21, 30, 31}
    assert ids["near_dedup"] - ids["decontamination"] == {2}
    assert {"slot", "shard"} <= set(steps["sharding"].columns)
    got = pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, steps["sharding"].collect()))


def naive(spark, rows, labels, items):
    """The pipeline row by row: rows are (doc_id, text, source)."""
    model = toxicity.train(H.documents(spark, rows), labels)
    rows = [r for r in rows if model.score(np.frombuffer((r[1] or "").encode(), np.uint8), np.array([0, len((r[1] or "").encode())]))[0] < 0.5]
    # one row of each class: the least id, then the first text by digest
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, t, _) in enumerate(rows):
        for j, (_, u, _) in enumerate(rows[:i]):
            if t is not None and u is not None and (t == u or H.similarity(t, u) >= 0.8):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i) if r[1] is not None else ("null", r[0]), []).append(r)
    rows = [min(g, key=lambda r: (r[0], hashlib.md5((r[1] or "").encode()).digest())) for g in groups.values()]
    # without benchmark passages
    grams = {tuple(w[i : i + 10]) for w in map(H.words, items) for i in range(len(w) - 9)}
    rows = [r for r in rows if not any(tuple(H.words(r[1])[i : i + 10]) in grams for i in range(len(H.words(r[1])) - 9))]
    # mixed
    quality = {r.doc_id: r.quality for r in labels.collect()}
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = {}
    for (_, _, s), n in zip(rows, size, strict=True):
        total[s] = total.get(s, 0) + n
    order = sorted((s for s in total if s is not None), key=str.encode) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(size), set(order)
    while free and left > 1e-9:
        level = left / sum(weight[s] for s in free)
        for s in list(free):
            add = min(level * weight[s], 2 * total[s] - target[s])
            target[s], left = target[s] + add, left - add
            if target[s] >= 2 * total[s] - 1e-9:
                free.discard(s)

    def key(r):
        th = hashlib.md5((r[1] or "").encode()).hexdigest()
        u = (int(hashlib.md5("\x1f".join(["mix-1", str(r[0]), th]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / {1: 1.0, 0: 0.25}.get(quality.get(r[0]), 0.5)

    out = []
    for s in order:
        own = sorted((key(r), r[0], r[1] or "", n, r) for r, n in zip(rows, size, strict=True) if r[2] == s)
        epochs, running = math.floor(target[s] / total[s]) if total[s] else 0, 0
        rest = target[s] - epochs * total[s]
        for _, _, _, n, r in own:
            running += n
            out += [r] * (epochs + (rest > 0 and running - n / 2 <= rest))
    # placed
    table = sharding.fill_table(sharding.shard_names())
    slot = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % sharding.SIZE
    return sorted((r[0], r[1] or "", r[2] or "", slot(r[0]), table[slot(r[0])]) for r in out)


def test_whole_pipeline_like_a_naive_one(spark, tmp_path):
    rng = random.Random(18)
    rows = [(i, t, s) for i, t, s in H.texts() if i not in (None, 3, 4)]
    rows += [(600 + i, "you worthless idiot " + H.prose(rng, 60), "s1") for i in range(60)]
    rows += [(700 + i, H.prose(rng, rng.randint(1, 80)), rng.choice(["s0", "s1", "s2", None])) for i in range(80)]
    items = [" ".join(rows[2][1].split(" ")[5:30]), H.prose(rng, 40)]
    H.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2, int(600 <= i < 700)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.text or "", r.source or "", r.slot, r.shard) for r in pipeline.run(spark, str(tmp_path)).collect())
    want = naive(spark, rows, labels, items)
    assert got == want and len(got) > 80
