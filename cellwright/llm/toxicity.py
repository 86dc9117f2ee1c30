"""Toxicity: a counterfactual-regularised classifier.

A logistic regression on the presence of words and word beginnings (4, 5 and 6 bytes).  Beside the
usual loss, training penalises the squared change of the score when the identity terms of a labelled
text are swapped for others of their group, so that neutral mentions of a group don't count.  Groups of terms are a parameter
(``IDENTITY``: English, German, French and Spanish); ``gaps`` tells how much scores still change under swaps.  Where no labelled
text has a term, there is nothing to penalise, and the model is the plain one.

Labels come from rows whose crc32(doc_id as text) mod 5 is not 0, at most about ``SAMPLE`` of them (chosen
by a hash of the id if there are more).  Candidate features are counted over the whole sample on
the executors; the ``FEATURES`` strongest are collected.  The model, of that bounded size, is sent to the
executors, which score every whole text in one pass, without a shuffle.

Null and empty texts get the score of a text without any feature.  Ids with several labels count as
toxic if one label is.  Null ids have no labels.  Without labels of both kinds the score is the share of toxic
ones (0 without any).  Repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import BYTE_VALUE, mix, prefix_hash, span_hash, sub_batches, text_bytes, word_spans

SAMPLE = 12_000
FEATURES = 4096
BEGINNINGS = (4, 5, 6)
#: How often a feature must occur in the sample.
LEAST = 3
PENALTY = 1.0
DECAY = 1e-4
STEPS = 400

#: Terms within a group are swapped for one another.
IDENTITY = [
    ["women", "men"],
    ["woman", "man"],
    ["girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["black", "white", "asian", "latino", "indigenous"],
    ["african", "european", "american", "arab", "mexican", "chinese"],
    ["immigrant", "refugee", "foreigner", "citizen"],
    ["immigrants", "refugees", "foreigners", "citizens"],
    ["disabled", "deaf", "blind"],
    ["frauen", "männer"],
    ["mädchen", "junge"],
    ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"],
    ["schwule", "lesben", "heterosexuelle", "bisexuelle"],
    ["schwarze", "weiße", "asiaten"],
    ["ausländer", "flüchtlinge", "einwanderer", "bürger"],
    ["femmes", "hommes"],
    ["fille", "garçon"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    ["homosexuels", "hétérosexuels", "bisexuels"],
    ["noirs", "blancs", "asiatiques"],
    ["étrangers", "réfugiés", "immigrés", "citoyens"],
    ["mujeres", "hombres"],
    ["niña", "niño"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    ["homosexuales", "heterosexuales", "bisexuales"],
    ["negros", "blancos", "asiáticos"],
    ["extranjeros", "refugiados", "inmigrantes", "ciudadanos"],
]


class Swaps:
    """Replaces each identity term by the next of its group; of a term in several groups the first counts."""

    def __init__(self, groups: list[list[str]]) -> None:
        self.next: dict[str, str] = {}
        for g in groups:
            for i, t in enumerate(g):
                self.next.setdefault(t.lower(), g[(i + 1) % len(g)].lower())
        terms = "|".join(re.escape(t) for t in sorted(self.next, key=len, reverse=True))
        self.pattern = re.compile(r"(?<![0-9A-Za-z\x80-\U0010ffff])(" + terms + r")(?![0-9A-Za-z\x80-\U0010ffff])", re.I) if terms else None

    def found(self, text: str | None) -> bool:
        return bool(text and self.pattern and self.pattern.search(text))

    def swapped(self, text: str) -> str:
        return self.pattern.sub(lambda m: self.next.get(m[0].lower(), m[0]), text) if self.pattern else text


def swapped(text: str, groups: list[list[str]] | None = None) -> str:
    return Swaps(IDENTITY if groups is None else groups).swapped(text)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and 64-bit feature of every word and word beginning, repeats included."""
    low, start, end, doc = word_spans(data, offsets)
    prefix = prefix_hash(BYTE_VALUE[low])
    docs, found = [doc], [span_hash(prefix, start, end)]
    for k in BEGINNINGS:
        long = end - start > k
        docs.append(doc[long])
        found.append(mix(span_hash(prefix, start[long], start[long] + k) + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(found)


def _of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return features(*text_bytes(pa.array(texts, pa.string())))


def _present(doc: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once."""
    if not len(doc):
        return doc, found
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return doc[new], found[new]


class Model:
    """Sorted features with weights, and a bias."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.ids, self.weights, self.bias = ids, weights, bias
        self.seen = np.zeros(1 << 20, bool)  # a filter before the exact search
        self.seen[(ids >> np.uint64(44)).astype(np.int64)] = True

    def select(self, doc: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and index of the model's features that are present."""
        hit = np.flatnonzero(self.seen[(found >> np.uint64(44)).astype(np.int64)]) if len(self.ids) else np.zeros(0, np.int64)
        doc, found = doc[hit], found[hit]
        at = np.searchsorted(self.ids, found)
        at[at == len(self.ids)] = 0
        same = self.ids[at] == found if len(self.ids) else np.zeros(0, bool)
        pair = np.unique(doc[same] * np.int64(max(1, len(self.ids))) + at[same])
        return pair // max(1, len(self.ids)), pair % max(1, len(self.ids))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, at = self.select(*features(data, offsets))
        z = np.bincount(doc, self.weights[at], minlength=len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], n: int, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Gradient descent with momentum on loss + penalty * mean of squared score changes."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    p_at = np.concatenate([x for p in pairs for x in p]) if pairs else np.zeros(0, np.int64)
    p_doc = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    p_sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs]) if pairs else np.zeros(0)
    w, share = np.zeros(n), y.mean()
    bias = float(np.log(share / (1 - share)))
    vw, vb = np.zeros(n), 0.0
    # each class counts half, so that rare toxic rows matter
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    # steps short enough for the steepest direction, and more of them where they are shorter
    steep = 0.25 * float(sum(e * len(r) for e, r in zip(each, rows, strict=True)))
    if pairs:
        steep += 2 * penalty * float(np.mean([len(np.setxor1d(a, b)) for a, b in pairs]))
    rate = min(0.3, 3 / max(steep, 1e-9))
    for _ in range(int(STEPS * min(10, 0.3 / rate))):
        z = np.bincount(doc, w[flat], minlength=len(rows)) + bias
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * each
        g = np.bincount(flat, e[doc], minlength=n) + DECAY * w
        if pairs:
            change = np.bincount(p_doc, p_sign * w[p_at], minlength=len(pairs))
            g += np.bincount(p_at, 2 * penalty * change[p_doc] * p_sign / len(pairs), minlength=n)
        vw, vb = 0.9 * vw - rate * g, 0.9 * vb - rate * e.sum()
        w, bias = w + np.clip(vw, -0.5, 0.5), bias + float(np.clip(vb, -0.5, 0.5))
    return w, bias


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features_kept: int = FEATURES, identity: list[list[str]] | None = None, penalty: float = PENALTY) -> Model:
    """The model of the labelled rows that aren't held out.  Runs jobs."""
    swaps = Swaps(IDENTITY if identity is None else identity)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    count = known.count()
    if count > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / count))
    # bounded by ``sample``
    rows = docs.select("doc_id", "text").join(F.broadcast(known.withColumnRenamed("doc_id", "label_id")), F.col("doc_id") == F.col("label_id")).select("text", "y")
    rows = materialize(rows, "toxicity")

    def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
            doc, found = _present(*features(*text_bytes(batch.column(0))))
            ids, at = np.unique(found, return_inverse=True)
            n = np.bincount(at, minlength=len(ids))
            pos = np.bincount(at, y[doc], minlength=len(ids)).astype(np.int64) if len(ids) else n
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n), pa.array(pos)], names=["f", "n", "pos"])

    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    n, pos = totals["n"], totals["pos"] or 0
    if not pos or pos == n:
        share = pos / n if n else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), 30.0 if share == 1 else -30.0)
    counts = rows.mapInArrow(count_features, "f long, n long, pos long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= LEAST)
    # log odds against the rest, with a lower weight where few rows speak for it
    rate = (F.col("pos") + 0.5) / (F.col("n") + 1.0)
    odds = F.log(rate / (1 - rate)) - float(np.log((pos + 0.5) / (n - pos + 0.5)))
    strong = F.abs(odds) * F.sqrt(F.least(F.col("n"), n - F.col("n") + 1.0) * rate * (1 - rate) + 0.25 * F.log1p(F.col("pos")))
    chosen = counts.select("f", strong.alias("s")).orderBy(F.col("s").desc(), "f").limit(features_kept).collect()
    terms = _of_texts(sorted(swaps.next))[1].view(np.int64)
    model = Model(np.unique(np.r_[np.array([r.f for r in chosen], np.int64), terms].view(np.uint64)), np.zeros(0), 0.0)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            n = batch.num_rows
            doc, at = model.select(*features(*text_bytes(batch.column(0))))
            texts = batch.column(0).to_pylist()
            other = [i for i, t in enumerate(texts) if swaps.found(t)]
            doc2, at2 = model.select(*_of_texts([swaps.swapped(texts[i]) for i in other])) if other else (doc[:0], at[:0])
            split = lambda d, a, k: np.split(a, np.searchsorted(d, np.arange(1, k))) if k else []
            own, alt = split(doc, at, n), dict(zip(other, split(doc2, at2, len(other)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int64()), pa.array([x.tolist() for x in own], pa.list_(pa.int64())), pa.array([alt[i].tolist() if i in alt else None for i in range(n)], pa.list_(pa.int64()))], names=["y", "own", "alt"]
            )

    coded = rows.mapInArrow(encode, "y long, own array<long>, alt array<long>").collect()
    coded.sort(key=lambda r: (r.y, r.own))
    own = [np.array(r.own, np.int64) for r in coded]
    pairs = [(a, np.array(r.alt, np.int64)) for a, r in zip(own, coded, strict=True) if r.alt is not None]
    w, bias = fit(own, np.array([r.y for r in coded], float), pairs, len(model.ids), penalty)
    return Model(model.ids, w, bias)


def gaps(docs: DataFrame, model: Model, identity: list[list[str]] | None = None) -> DataFrame:
    """doc_id, score and swapped_score of the rows that have an identity term."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    swaps = Swaps(IDENTITY if identity is None else identity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            texts = batch.column(1).to_pylist()
            some = [i for i, t in enumerate(texts) if swaps.found(t)]
            own = [model.score(*text_bytes(pa.array(x, pa.string()))) for x in ([texts[i] for i in some], [swaps.swapped(texts[i]) for i in some])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), *map(pa.array, own)], names=["doc_id", "score", "swapped_score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, swapped_score double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(*text_bytes(batch.column(1))))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't call toxic."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            good = model.score(*text_bytes(batch.column(batch.schema.get_field_index("text")))) < 0.5
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
