"""Toxicity by the nearest labelled examples, exact in TF-IDF cosine, through block-max inverted lists.

Fitting takes a bounded sample of labelled rows (`examples` of each class, those with the least hash of their id). Every
word of every example is a term; a word is a run of letters, lower-cased. A term weighs (1 + log tf) * idf * rf ** LEAN,
where rf, the relevance frequency log2(2 + toxic / clean examples with the term), is 1 for a term that only clean examples
or none have: so every term counts and those that mark the class count more. A text's vector has all its words, unknown
ones too, and unit length.

Examples are numbered so that like ones are neighbours, and cut into blocks of BLOCK. Each term's list has an entry for
each block that holds it: the block's largest value and its postings (example, value). The COMMON commonest terms, whose
lists fill most blocks, are whole rows instead: one product for CHUNK texts gives their share of each similarity. A query
adds the block's largest share and the largest values of its other terms to an upper bound for each block, opens the
blocks of the highest bounds and then all whose bound reaches the k-th similarity found: the neighbours are exact. Values
are multiples of 2**-25 and 2**-26, so sums in double precision are exact in any order: equal texts and equal examples
have equal similarities. Of equal similarities the example first in the index counts.

A neighbour votes with its similarity times its class's weight in all labelled rows. The share of toxic votes becomes a
rate by a logistic curve in its log-odds, fitted on the votes that the examples themselves get with each left out. Texts
without a neighbour get the rate of all labelled rows. The ids, labels and similarities of the nearest are the evidence.

The index is of bounded size, whatever the table; its arrays are broadcast, terms as 64-bit hashes. Scoring reads whole
texts once and shuffles nothing.

Defined results: null and empty texts have no words; several labels of one id count as the largest, several texts of one
labelled id as the least; null labels and ids are left out of fitting; without toxic examples every score is 0, without
clean ones 1; equal texts get equal scores; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import batched, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.llm.common import cut

#: Chosen by two-fold cross-validation inside the rows that may be learnt from (README).
LEAN, NEIGHBOURS = 3, 31
BLOCK = 32
#: Blocks opened first, terms kept as rows, texts scored at once; results don't depend on them.
OPENED, COMMON, CHUNK = 8, 128, 32
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, in order, and how often each stands in it."""
    counts = Counter(LETTERS.findall((text or "").lower()))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts))
    order = np.argsort(hashes)
    return hashes[order], np.fromiter(counts.values(), np.int64, len(counts))[order]


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, none of them empty, one range after the other."""
    if not len(begin):
        return np.zeros(0, np.int64)
    first = np.cumsum(end - begin)
    step = np.ones(first[-1], np.int64)
    step[0] = begin[0]
    step[first[:-1]] = begin[1:] - end[:-1] + 1
    return np.cumsum(step)


def _whole(value: np.ndarray, bits: int) -> np.ndarray:
    """Positive values as multiples of 2**-bits, at least one."""
    return np.maximum(np.rint(value * (1 << bits)), 1) / (1 << bits)


class Index:
    """Block-max inverted lists of examples [(id, label, hashes, counts)]; `rates`: how many labelled rows an example of each class stands for."""

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], rates: tuple[float, float] = (1.0, 1.0), neighbours: int = NEIGHBOURS, block: int = BLOCK):
        self.n, self.k, self.block = len(examples), neighbours, block
        none = [np.zeros(0, np.uint64)]
        every = np.concatenate([e[2] for e in examples] + none)
        self.terms, number = np.unique(every, return_inverse=True)
        owner = np.repeat(np.arange(self.n), [len(e[2]) for e in examples])
        tf = 1 + np.log(np.concatenate([e[3] for e in examples] + [np.zeros(0, np.int64)]))
        label = np.array([e[1] for e in examples], dtype=np.int64)
        n_toxic, n_clean = max(int(label.sum()), 1), max(int((1 - label).sum()), 1)
        having = np.bincount(number, minlength=len(self.terms))
        toxic = np.bincount(number, label[owner], minlength=len(self.terms))
        clean = (having - toxic) * (n_toxic / n_clean)
        self.weight = ((np.log((1 + self.n) / (1 + having)) + 1) * np.log2(2 + toxic / np.maximum(clean, 1)) ** LEAN).astype(np.float32)
        self.unknown = np.float32(np.log(1 + self.n) + 1)
        value = tf * self.weight[number]
        value = value / np.sqrt(np.bincount(owner, value * value, minlength=self.n))[owner] if len(value) else value
        place = self._places(examples, number, owner, value, having)
        kept = np.argsort(place)
        self.ids, self.labels = [examples[j][0] for j in kept], label[kept]
        self.votes = np.where(self.labels == 1, rates[1], rates[0])
        total = self.votes.sum()
        self.base = float(self.votes[self.labels == 1].sum() / total) if total else 0.0
        self.curve = (0.0, 1.0)
        # postings by term and example; an entry is a term's postings in one block
        at = place[owner]
        order = np.lexsort((at, number))
        self.at, self.value, number = at[order].astype(np.int32), _whole(value[order], 25).astype(np.float32), number[order]
        blocks = self.at // block
        new = np.ones(len(order), dtype=bool)
        new[1:] = (number[1:] != number[:-1]) | (blocks[1:] != blocks[:-1])
        begin = np.nonzero(new)[0]
        self.begin = np.append(begin, len(order)).astype(np.int32)
        self.in_block = blocks[begin].astype(np.int32)
        self.most = np.maximum.reduceat(self.value, begin) if len(begin) else self.value[:0]
        self.entries = np.searchsorted(number[begin], np.arange(len(self.terms) + 1)).astype(np.int32)
        self.blocks = -(-self.n // block)
        common = np.argsort(-having, kind="stable")[:COMMON]
        self.row = np.full(len(self.terms), -1, dtype=np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.blocks * block))
        filled = self.row[number] >= 0
        self.rows[self.row[number[filled]], self.at[filled]] = self.value[filled]

    def _places(self, examples, number, owner, value, having) -> np.ndarray:
        """The place of each example: by class, the commonest words it has, its heaviest word of several examples, and id."""
        common = np.argsort(-having, kind="stable")[:24]
        has = np.zeros((self.n, len(common)), dtype=np.int8)
        for c, t in enumerate(common):
            has[owner[number == t], c] = 1
        shared = np.nonzero(having[number] > 1)[0]
        order = shared[np.lexsort((number[shared], value[shared], owner[shared]))]
        heaviest = np.full(self.n, -1, dtype=np.int64)
        heaviest[owner[order]] = number[order]  # the last of an owner is the heaviest
        keys = [(-e[1], heaviest[j] if e[1] else -1, tuple(-has[j]), heaviest[j], j) for j, e in enumerate(examples)]
        ranked = sorted(range(self.n), key=lambda j: (*keys[j][:4], str(examples[j][0]), j))
        place = np.empty(self.n, dtype=np.int64)
        place[ranked] = np.arange(self.n)
        return place

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the known terms, their values in the text's unit vector)."""
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0)
        found = np.searchsorted(self.terms, hashes)
        found[found == len(self.terms)] = 0
        known = self.terms[found] == hashes if len(self.terms) else np.zeros(len(hashes), dtype=bool)
        value = (1 + np.log(counts)) * np.where(known, self.weight[found] if len(self.terms) else 0, self.unknown)
        return found[known], _whole(value[known] / np.sqrt((value * value).sum()), 26)

    def nearest(self, hashes: np.ndarray, counts: np.ndarray, but=None) -> list[tuple[float, int]]:
        """The (similarity, place) of the k nearest examples of positive similarity, nearest first; `but`: an id that doesn't count."""
        return next(self.nearest_of([(hashes, counts)], [but]))

    def nearest_of(self, texts: Iterable[tuple[np.ndarray, np.ndarray]], but: Iterable | None = None) -> Iterator[list[tuple[float, int]]]:
        """The nearest of each of several texts; but: an id for each."""
        for some in batched(zip(texts, repeat(None) if but is None else but, strict=False), CHUNK):
            vectors = [self.vector(*x) for x, _ in some]
            common = np.zeros((len(vectors), len(self.rows)))
            for own, (term, query) in zip(common, vectors, strict=True):
                row = self.row[term]
                own[row[row >= 0]] = query[row >= 0]
            shares = common @ self.rows
            most = shares.reshape(len(vectors), self.blocks, self.block).max(axis=2)
            for j, (term, query) in enumerate(vectors):
                rest = self.row[term] < 0
                yield self._nearest(term[rest], query[rest], shares[j], most[j], some[j][1])

    def _nearest(self, term: np.ndarray, query: np.ndarray, total: np.ndarray, bound: np.ndarray, but) -> list[tuple[float, int]]:
        """The nearest by the terms that have no row; total: the shares of those that have one, bound: the largest of each block."""
        entry, length = _ranges(self.entries[term], self.entries[term + 1]), self.entries[term + 1] - self.entries[term]
        weight, own = np.repeat(query, length), self.in_block.take(entry)
        bound = bound + np.bincount(own, weight * self.most.take(entry), minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        skipped = [j for j, i in enumerate(self.ids) if i == but] if but is not None else []
        least = self._kth(total, skipped)
        for chosen in (order[:OPENED], order[OPENED:]):
            opened = np.zeros(self.blocks, dtype=bool)
            opened[chosen] = (bound[chosen] > 0) & (bound[chosen] >= least)
            here = np.nonzero(opened.take(own))[0]
            e = entry.take(here)
            begin, end = self.begin.take(e), self.begin.take(e + 1)
            postings = _ranges(begin, end)
            total = total + np.bincount(self.at.take(postings), np.repeat(weight.take(here), end - begin) * self.value.take(postings), minlength=len(total))
            least = self._kth(total, skipped)
        found = np.nonzero(total >= least if least > 0 else total > 0)[0]
        return [(float(total[j]), int(j)) for j in found[np.lexsort((found, -total[found]))][: self.k]]

    def _kth(self, total: np.ndarray, skipped: list[int]) -> float:
        """The k-th similarity, 0 if there are fewer; what is skipped has none."""
        total[skipped] = 0
        return float(np.partition(total, -self.k)[-self.k]) if len(total) >= self.k else 0.0

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The toxic share of the neighbours' votes."""
        votes = [(s * self.votes[at], self.labels[at]) for s, at in near]
        return sum(v for v, label in votes if label) / sum(v for v, _ in votes)

    def calibrate(self, votes: list[tuple[float, int]]) -> None:
        """Fit the curve from (vote, label) of examples that were left out, each weighing as many rows as it stands for."""
        x = np.array([_log_odds(v, self.base) for v, _ in votes])
        y = np.array([label for _, label in votes], dtype=float)
        if not len(y) or y.min() == y.max():
            return
        w = np.where(y == 1, self.votes[self.labels == 1][0], self.votes[self.labels == 0][0])
        design, beta = np.stack([np.ones(len(x)), x], axis=1), np.array([0.0, 1.0])
        for _ in range(50):  # Newton's steps, with a weak pull to the identity
            p = 1 / (1 + np.exp(-(design @ beta)))
            slope = design.T @ (w * (p - y)) + (beta - (0.0, 1.0))
            step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + np.eye(2), slope)
            beta = beta - np.clip(step, -1, 1)
        self.curve = (float(beta[0]), float(beta[1]))

    def score(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[float, str | None]:
        """Score and evidence of one text."""
        return next(self.scores([(hashes, counts)]))

    def scores(self, texts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, str | None]]:
        """Score and evidence of each text."""
        return ((self.base, None) for _ in texts) if self.base in (0.0, 1.0) else map(self._judged, self.nearest_of(texts))

    def _judged(self, near: list[tuple[float, int]]) -> tuple[float, str | None]:
        """Score and evidence by the nearest examples."""
        if not near:
            return self.base, None
        a, b = self.curve
        evidence = " ".join(f"{self.ids[at]}:{self.labels[at]}:{s:.3f}" for s, at in near[:3])
        return float(1 / (1 + np.exp(-(a + b * _log_odds(self.vote(near), self.base))))), evidence


def _log_odds(vote: float, base: float) -> float:
    """Log-odds of a vote, drawn a little to the base rate so that votes of 0 and 1 have some."""
    p = (vote + 0.02 * base) / 1.02
    return float(np.log(p / (1 - p)))


def fit(docs: DataFrame, labels: DataFrame, examples: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """The index of a bounded sample of rows that are not held out, with its curve."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label is not null").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    known = cut(known)
    sample = known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(examples).union(known.where("label <> 1").orderBy(F.xxhash64("id"), "id").limit(examples))
    all_of = {bool(r["label"]): r["n"] for r in known.groupBy((F.col("label") == 1).alias("label")).agg(F.count("*").alias("n")).collect()}
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = cut(texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")))  # 2 * examples ids at most
    kind = rows.schema["id"].dataType.simpleString()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms_of(t.as_py()) for t in b.column(2)]
            packed = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *packed], ["id", "label", "hashes", "counts"])

    taken = rows.mapInArrow(vectors, f"id {kind}, label int, hashes binary, counts binary").collect()
    found = [(r["id"], int(r["label"] == 1), np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in sorted(taken, key=lambda r: r["id"])]
    toxic = sum(label for _, label, *_ in found)
    index = Index(found, (all_of.get(False, 0) / max(len(found) - toxic, 1), all_of.get(True, 0) / max(toxic, 1)))
    if index.base not in (0.0, 1.0):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for b in batches:
                near = own.nearest_of((terms_of(t.as_py()) for t in b.column(2)), b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([own.vote(x) if x else None for x in near], pa.float64()), b.column(1)], ["vote", "label"])

        votes = rows.mapInArrow(left_out, "vote double, label int").where("vote is not null").collect()
        index.calibrate(sorted((r["vote"], int(r["label"] == 1)) for r in votes))
        sent.destroy()
    return index


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted: 1 from the threshold on, evidence: id:label:similarity of the nearest examples)."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            found = list(own.scores(terms_of(t.as_py()) for t in b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.string())], ["id", "score", "evidence"])

    scored = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double, evidence string")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def judge(docs: DataFrame, labels: DataFrame, examples: int = 2000, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Fit on the labelled rows that are not held out, and score every whole text."""
    return score(docs, fit(docs, labels, examples, id_col, text_col), id_col, text_col, threshold)


def keep(docs: DataFrame, labels: DataFrame, examples: int = 2000, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows that are not predicted to be toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, examples, id_col, text_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            yield b.filter(pa.array([s < threshold for s, _ in own.scores(terms_of(t.as_py()) for t in b.column(place))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
