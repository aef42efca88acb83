"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Training uses labelled rows alone, EXAMPLES per class at most, the first in the order of a hash of their ids. Terms
are words and beginnings of words; the model's terms are all that separate the classes: LIFT times as frequent in one
as in the other, with a chi-square above LEAST_CHI. The cosine is exact over these; over every term of the examples it
would cost several times what a document may (README). A text's K nearest examples vote with the square of their
cosine; votes are calibrated by isotonic regression on about CALIBRATED of the examples, each judged by the others.
Labels, lang, source and doc_id are no inputs of a score, so a text that was learned from, or a copy of it, meets its
own example among its neighbours: only held-out rows say how good the scores are.

The index is broadcast: its size is bounded by the terms of EXAMPLES per class and doesn't grow with the input.

Null and empty texts, and texts without a term of the model, have no neighbours and get the calibrated score of such
examples. Ties in cosine go to the smaller example number, that is to the smaller doc_id. Labels of null count for
nothing; several labels of an id count as several examples. Repeated rows each give a row, and of documents to learn
from each is an example. Very long texts are scored whole. Without any labels each text scores 0. An empty table
gives no rows. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import table
from tagloom.llm.word_ids import Memo

EXAMPLES, SUPPORT, LIFT, LEAST_CHI, K, BLOCK, PRIOR_WEIGHT, CALIBRATED = 6000, 4, 4, 10.8, 16, 64, 0.25, 3000
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(chunk: str) -> list[str]:
    """The terms of what stands between white space: its words, and their beginnings of 4 to 6 letters."""
    found = []
    for word in _WORD.findall(chunk.lower()):
        found.append(word)
        found.extend(word[:k] + "*" for k in (4, 5, 6) if len(word) > k - 1)
    return found


class _TermIds(Memo):
    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = self.old.get(chunk)
        if found is None:
            found = tuple(self.ids[t] for t in terms_of(chunk) if t in self.ids)
        return self.keep(chunk, found) if len(chunk) <= 64 else found


class Index:
    """Examples' unit vectors as postings by term, cut into blocks of consecutive examples with each block's largest weight."""

    def __init__(self, ids: dict[str, int], idf: np.ndarray, examples: list[tuple[dict[int, int], int]], evidence: list[int]):
        self.ids, self.idf = ids, idf
        self.labels = np.array([y for _, y in examples], np.float64)
        self.doc_ids = np.array(evidence, np.int64)
        rows = [self.vector(counts) for counts, _ in examples]
        e = np.concatenate([np.full(len(t), i) for i, (t, _) in enumerate(rows)] or [np.empty(0)]).astype(np.int64)
        t = np.concatenate([t for t, _ in rows] or [np.empty(0)]).astype(np.int64)
        w = np.concatenate([w for _, w in rows] or [np.empty(0)])
        order = np.lexsort((e, t))
        self.examples, terms, self.weights = e[order], t[order], w[order]
        blocks = max(1, -(-len(examples) // BLOCK))
        cell = terms * blocks + self.examples // BLOCK
        self.starts = np.searchsorted(cell, np.arange(len(ids) * blocks + 1))
        self.most = np.zeros(len(ids) * blocks)
        np.maximum.at(self.most, cell, self.weights)
        self.most = self.most.reshape(len(ids), blocks)
        self.blocks = blocks
        self.knots, self.values = np.array([0.0]), np.array([0.0])

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        if not len(terms):
            return terms, np.empty(0)
        weights = (1 + np.log([counts[t] for t in terms.tolist()])) * self.idf[terms]
        return terms, weights / np.sqrt((weights**2).sum())

    def nearest(self, counts: dict[int, int], k: int = K, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with any term in common, best first; exact.

        Blocks are read in the order of their bounds, the sums of largest weights, until a bound is below the k-th cosine.
        """
        terms, weights = self.vector(counts)
        best = np.empty(0, np.int64), np.empty(0)
        if not len(terms):
            return best
        bounds = weights @ self.most[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[: int((bounds > 0).sum())]
        at, step = 0, 4
        while at < len(order):
            kth = best[1][k - 1] if len(best[1]) >= k else 0.0
            if bounds[order[at]] < kth * (1 - 1e-12):
                break
            # The next blocks together, twice as many each time; their postings of the text's terms side by side.
            cells = terms[:, None] * self.blocks + order[None, at : at + step]
            at, step = at + step, 2 * step
            lows = self.starts[cells].ravel()
            sizes = self.starts[cells + 1].ravel() - lows
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1]) + np.repeat(lows - (ends - sizes), sizes)
            scores = np.bincount(self.examples[places], self.weights[places] * np.repeat(np.repeat(weights, cells.shape[1]), sizes), len(self.labels))
            own = np.flatnonzero(scores > 0)
            own = own[own != without]
            numbers, scores = np.concatenate([best[0], own]), np.concatenate([best[1], scores[own]])
            keep = np.lexsort((numbers, -scores))[:k]
            best = numbers[keep], scores[keep]
        return best

    def vote(self, numbers: np.ndarray, cosines: np.ndarray, prior: float) -> float:
        w = cosines**2
        return float(((w * self.labels[numbers]).sum() + PRIOR_WEIGHT * prior) / (w.sum() + PRIOR_WEIGHT))

    def calibrate(self, examples: list[tuple[dict[int, int], int]], rate: float) -> None:
        """Isotonic regression (adjacent violators pooled) of labels on votes, classes weighted to `rate` of label 1."""
        share = self.labels.mean() if len(self.labels) else 0.0
        self.prior = rate
        judged = range(0, len(examples), max(1, len(examples) // CALIBRATED))
        labels = self.labels[judged.start :: judged.step]
        votes = np.array([self.vote(*self.nearest(examples[i][0], without=i), rate) for i in judged])
        weight = np.where(labels == 1, rate / max(share, 1e-9), (1 - rate) / max(1 - share, 1e-9))
        pools: list[list[float]] = []
        for v in np.unique(votes):
            at = votes == v
            pools.append([float(v), float((weight * labels)[at].sum()), float(weight[at].sum())])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, y, w = pools.pop()
                pools[-1][1] += y
                pools[-1][2] += w
        if pools:
            self.knots, self.values = np.array([p[0] for p in pools]), np.array([(p[1] + 0.1 * rate) / (p[2] + 0.1) for p in pools])

    def score(self, vote: float) -> float:
        """Nine parts the calibrated vote and one the vote, so that within a pool the order stays."""
        return float(0.9 * np.interp(vote, self.knots, self.values) + 0.1 * vote)


def training(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, text and y of the labelled rows to learn from: `examples` per class at most."""
    usable = labels.filter("toxic in (0, 1) and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y"))
    picked = None
    for y in (0, 1):
        some = usable.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(examples)
        picked = some if picked is None else picked.unionByName(some)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, least_chi: float = LEAST_CHI, lift: float = LIFT) -> Index | None:
    rows = training(docs, labels, examples).persist()
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    usable = labels.filter("toxic in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rate = float(usable.agg(F.avg("toxic")).first()[0])
    n0, n1 = n.get(0, 0), n.get(1, 0)

    def distinct(batches):
        seen = Counter(), Counter()
        memo = Memo()
        for batch in batches:
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
                own = set()
                for chunk in set((text or "").split()):
                    own.update(memo.get(chunk) or memo.keep(chunk, terms_of(chunk)))
                seen[y].update(own)
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(seen[y]), pa.string()), pa.array([y] * len(seen[y]), pa.int32()), pa.array(list(seen[y].values()), pa.int64())], ["term", "y", "n"])

    # chi-square of a term and the label, from the numbers of examples of each class that have it.
    counted = rows.select("text", "y").mapInArrow(distinct, "term string, y int, n long").groupBy("term").agg(F.sum(F.expr("n * y")).alias("b"), F.sum(F.expr("n * (1 - y)")).alias("a")).filter(f"a + b >= {SUPPORT}")
    share = F.expr(f"({n0 + n1}D * power(b * {n0}D - a * {n1}D, 2)) / greatest((a + b) * {n0}D * {n1}D * greatest({n0 + n1}D - a - b, 1), 1)")
    terms = counted.withColumn("x", share).filter(f"x > {least_chi} and (b * {n0}D >= {lift} * a * {n1}D or a * {n1}D >= {lift} * b * {n0}D)").orderBy("term").collect()
    ids = {r["term"]: i for i, r in enumerate(terms)}
    idf = np.array([math.log((1 + n0 + n1) / (1 + r["a"] + r["b"])) + 1 for r in terms])

    def vectors(batches):
        memo = _TermIds(ids)
        for batch in batches:
            found = [Counter(t for ts in map(memo.__getitem__, (text or "").split()) for t in ts) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))], ["doc_id", "y", "terms", "counts"])

    kept = sorted(rows.mapInArrow(vectors, "doc_id long, y int, terms array<int>, counts array<long>").collect(), key=lambda r: (r["doc_id"], r["y"]))
    rows.unpersist()
    vectors_ = [(dict(zip(r["terms"], r["counts"], strict=True)), r["y"]) for r in kept]
    index = Index(ids, idf, vectors_, [r["doc_id"] for r in kept])
    index.calibrate(vectors_, rate)
    return index


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted, and evidence: the doc_ids of the nearest examples."""
    index = fit(docs, labels, examples)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def judge(batches):
        index = sent.value
        memo = _TermIds(index.ids) if index else None
        none = index.score(index.prior) if index else 0.0
        for batch in batches:
            scores, evidence = [], []
            for text in batch["text"].to_pylist():
                found = [t for ts in filter(None, map(memo.__getitem__, text.split())) for t in ts] if text and index else []
                if not found:
                    scores.append(none)
                    evidence.append([])
                    continue
                numbers, cosines = index.nearest(Counter(found))
                scores.append(min(1.0, max(0.0, index.score(index.vote(numbers, cosines, index.prior)))))
                evidence.append(index.doc_ids[numbers[:3]].tolist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, score double, evidence array<long>")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
