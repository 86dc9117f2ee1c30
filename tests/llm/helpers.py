"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words int, key string, node string, size long, slot int, bands string, h int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}é" for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def texts():
    """(doc_id, text, source): plain, exact and near copies, shared passages, odd ones."""
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(12)]
    passage = prose(rng, 70)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20 + i, base[0]) for i in range(6)]  # exact copies
    out += [(30 + i, edited(rng, base[1], 1)) for i in range(6)]  # near copies
    out += [(40 + i, f"{prose(rng, 40)}\n{passage}\n{prose(rng, 40)}") for i in range(4)]  # a passage
    out += [(50, None), (51, None), (52, ""), (53, ""), (54, "one"), (55, "ONE!"), (56, "a b c"), (57, "\x00\x01 ?!"), (58, "日本語 текст é" * 30), (59, "x" * 5000), (60, "ab " * 4000)]
    out += [(None, "no id here at all, none"), (None, "no id here at all, none"), (None, None)]
    out += [(3, base[3]), (3, base[3])]  # a row three times
    out += [(4, prose(rng, 90))]  # an id with another text
    out += [(70, " ".join(base[5].split(" ") * 40))]  # a long one
    return [(i, t, ["s0", "s1", None, "s0"][k % 4]) for k, (i, t) in enumerate(out)]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "k", "n", 9, 8, "b", 7) for i, t, s in rows], SCHEMA).repartition(3)


def similarity(a, b):
    """Probability Jaccard index by its definition."""
    from collections import Counter

    def weights(t):
        w = words(t)
        c = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        return {k: v / sum(c.values()) for k, v in c.items()}

    x, y = weights(a), weights(b)
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x if i in y)
