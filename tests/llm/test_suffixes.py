import hashlib
import random

import numpy as np
import pytest
from tests.llm import helpers as H

from cellwright.llm import common as C
from cellwright.llm import suffixes as S


def by_hand(rows):
    """Documents by id (null first) and digest; repeated rows are one document."""
    distinct = sorted({(i, t) for i, t, *_ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    return dict(zip(distinct, S.brute_force([(t or "").encode() for _, t in distinct]), strict=True))


def table(rng, n=14):
    base = [H.prose(rng, 60) for _ in range(4)]
    rows = [(i, H.prose(rng, rng.randint(0, 50)), "s") for i in range(n)]
    rows += [(100 + i, base[0], "s") for i in range(5)]
    rows += [(200 + i, base[1][rng.randint(0, 200) :] + H.prose(rng, 9) + base[2][: rng.randint(90, 300)], "s") for i in range(12)]
    rows += [(300, "a" * 350, "s"), (301, "a" * 150, "s"), (302, "ab" * 200, "s"), (303, "é" * 120, "s"), (304, "é" * 49 + "e", "s"), (305, "x\0y" * 60, "s"), (306, None, "s"), (307, None, "s"), (308, "", "s")]
    rows += [(400, base[3], "s")] * 3 + [(None, base[3] + "!", "s")]
    rows += [(500, base[0][:99], "s"), (501, base[0][:100], "s"), (502, base[0][5:104] + "Q", "s")]
    return rows


@pytest.mark.parametrize("most, levels", [(S.MOST_PIECES, S.LEVELS), (3, S.LEVELS), (1, S.LEVELS), (3, 1)])
def test_like_brute_force(spark, monkeypatch, most, levels):
    monkeypatch.setattr(S, "MOST_PIECES", most)
    monkeypatch.setattr(S, "LEVELS", levels)
    rows = table(random.Random(11))
    want = by_hand(rows)
    got = S.report(H.documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *want[i, t]) for i, t, *_ in rows), key=repr)


def test_odd_tables(spark):
    assert S.report(H.documents(spark, [])).count() == 0
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.report(H.documents(spark, [(1, "short", "s"), (2, "short", "s"), (None, None, "s")])).collect()}
    assert got == {1: (5, 0, 0), 2: (5, 0, 0), None: (0, 0, 0)}
    long = H.prose(random.Random(1), 30000)
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in S.report(H.documents(spark, [(1, long, "s"), (2, "start " + long[5000:] + " end", "s")])).collect()}
    n = len(long[5000:].encode())
    assert got[1][1] == 0 and n <= got[2][1] <= n + 2


def test_shared_windows_like_a_table():
    rng = random.Random(2)
    base = [bytes(rng.choice(b"abcd ") for _ in range(130)) for _ in range(20)]
    pieces = list(dict.fromkeys(bytes(b[:k]) + bytes([rng.randrange(97, 100)]) + b[k:] for b in base for k in rng.sample(range(130), 6)))
    for group in (pieces, [p + b"\xff" for p in pieces], pieces[:1]):
        block, piece, offset = S.shared_windows(group)
        found = {}
        for b, i, j in zip(block.tolist(), piece.tolist(), offset.tolist(), strict=True):
            found.setdefault(b, set()).add((i, j))
        where = {}
        for i, p in enumerate(group):
            for j in range(len(p) - 99):
                where.setdefault(p[j : j + 100], set()).add((i, j))
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in where.values() if len(v) > 1)
    every = bytes(range(256))
    assert len(S.shared_windows([every, every[1:], every])[0]) == 157 * 3 - 1


@pytest.mark.parametrize("kind", ["null", "same", "text"])
def test_many_rows_without_ids_of_their_own(spark, kind):
    rng = random.Random(21)
    passage = [H.prose(rng, 25) for _ in range(40)]
    texts = [f"{H.prose(rng, 3)} {rng.choice(passage)} {H.prose(rng, rng.randint(0, 6))}" for _ in range(6000)]
    texts += texts[:50] + [None, ""]
    ids = {"null": lambda i: None, "same": lambda i: i % 3, "text": lambda i: f"d{i % 7}" if i % 5 else None}[kind]
    rows = [(ids(i), t) for i, t in enumerate(texts)]
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, hashlib.md5((r[1] or "").encode()).digest()))
    want = dict(zip(distinct, S.brute_force([(t or "").encode() for _, t in distinct]), strict=True))
    df = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'text' else 'long'}, text string").repartition(5)
    got = S.report(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *want[i, t]) for i, t in rows), key=repr)


def test_finer_pieces():
    """Parts of a piece are runs of windows, all of them, and equal windows of different pieces are in parts of equal hash."""
    rng = random.Random(31)
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(400))
    texts = [base, base[:150] + b"#" + base[150:], b"?" + base[40:300]]
    pieces, keys = [], []
    for t in texts:
        key, start, n = S.pieces_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        pieces += [t[a : a + k + 99] for a, k in zip(start.tolist(), n.tolist(), strict=True)]
        keys += key.tolist()
    for level in (1, 2, 3):
        offsets = np.cumsum([0] + [len(p) for p in pieces])
        data = b"".join(pieces)
        own, h, start, n = S.finer_pieces(np.frombuffer(data, np.uint8), offsets, level)
        assert [sum(n[own == i]) for i in range(len(pieces))] == [len(p) - 99 for p in pieces]
        seen = {}
        for i, x, a, k in zip(own.tolist(), h.tolist(), start.tolist(), n.tolist(), strict=True):
            for j in range(a, a + k):
                assert seen.setdefault((keys[i], data[j : j + 100]), x) == x
        # one level down, parts are pieces
        keys = [(keys[i], x) for i, x in zip(own.tolist(), h.tolist(), strict=True)]
        pieces = [data[a : a + k + 99] for a, k in zip(start.tolist(), n.tolist(), strict=True)]


def test_hot_anchors_are_dealt_apart(spark, monkeypatch):
    rng = random.Random(22)
    line = "the very same line of a hundred bytes and more that all of the documents of this table have somewhere in it."
    rows = [(i, f"{H.prose(rng, 20)} {line} {H.prose(rng, 20)}", "s") for i in range(300)]
    want = by_hand(rows)
    monkeypatch.setattr(S, "HOT_ROWS", 50)
    got = S.report(H.documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *want[i, t]) for i, t, *_ in rows), key=repr)


@pytest.mark.parametrize("drop", [2, 8, 14, 200])
@pytest.mark.parametrize("shards", [1, 3, 8])
def test_single_windows_may_go_at_any_time(monkeypatch, drop, shards):
    rng = random.Random(41)
    base = [bytes(rng.choice(b"ab") for _ in range(160)) for _ in range(4)] + [b"a" * 140, b"ab" * 80]
    pieces = list(dict.fromkeys(b[rng.randrange(9) : rng.randrange(99, 161)] for b in base for _ in range(7)))
    monkeypatch.setattr(S, "DROP", drop)
    block, piece, offset = S.shared_windows(pieces, shards=shards)
    found, where = {}, {}
    for b, i, j in zip(block.tolist(), piece.tolist(), offset.tolist(), strict=True):
        found.setdefault(b, set()).add((i, j))
    for i, p in enumerate(pieces):
        for j in range(len(p) - 99):
            where.setdefault(p[j : j + 100], set()).add((i, j))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in where.values() if len(v) > 1)


@pytest.mark.parametrize("shared, rows_a_window", [(32, 20), (118, 3 * 50 + 2)])
def test_a_merge_sorts_only_windows_that_may_be_equal(monkeypatch, shared, rows_a_window):
    """In 50 rounds, three sorts with a row for each window at most; few where pieces have no more than an anchor in common."""
    rng = random.Random(42)
    middle = bytes(rng.randrange(97, 123) for _ in range(shared))
    ends = [bytes(rng.randrange(97, 123) for _ in range(136 - shared)) for _ in range(200)]
    pieces = [e[: len(e) // 2] + middle + e[len(e) // 2 :] for e in ends]
    rows = 0

    def counting(f):
        def run(x, *args, **kwargs):
            nonlocal rows
            rows += np.shape(x)[-1]
            return f(x, *args, **kwargs)

        return run

    transforms = S.shard_transform

    def untold(*args):
        nonlocal rows
        before = rows
        out = transforms(*args)
        rows = before
        return out

    for name in ("argsort", "sort", "lexsort"):
        monkeypatch.setattr(np, name, counting(getattr(np, name)))
    monkeypatch.setattr(S, "shard_transform", untold)
    assert len(S.shared_windows(pieces)[0]) >= 200 * max(0, shared - 99)  # more where ends agree by chance
    assert rows <= rows_a_window * 200 * 37


def test_anchors_are_the_smallest_hashes():
    """Against the definition, window by window, for texts that are cut at any place and hashed in one."""
    rng = random.Random(43)
    texts = ["".join(rng.choice("abcé ") for _ in range(k)).encode() for k in (0, 99, 100, 101, 400, 5, 250)] + [b"a" * 300, b"", b"xy" * 90]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    prefix = C.prefix_hash(C.BYTE_VALUE[data])
    at = np.arange(len(data) - 31)
    h = C.span_hash(prefix, at, at + 32)
    assert (C.span_hashes(C.BYTE_VALUE[data], 32) == h).all()
    assert len(C.span_hashes(C.BYTE_VALUE[data[:31]], 32)) == 0
    want = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        last = None
        for w in range(a, b - 99):
            place = min(range(w, w + 69), key=lambda p: (int(h[p]) >> 31, p))
            if place == last:
                want[-1][2] += 1
            else:
                want.append([int(h[place]), w, 1])
            last = place
    key, start, n = S.pieces_of(data, offsets)
    assert [list(r) for r in zip(key.tolist(), start.tolist(), n.tolist(), strict=True)] == want
    assert S.anchors_of(data[start[:, None] + np.arange(100)]).tolist() == key.tolist()
    assert len(S.anchors_of(np.zeros((0, 100), np.uint8))) == 0
