"""Toxicity: neighbours, votes and scores against a plain computation with whole vectors."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from strandex.llm import toxicity

WORDS = [f"{a}{b}" for a in ("lor", "mip", "tan", "vel", "gor", "été") for b in ("ane", "itu", "oss", "ely", "und", "ark")]


def examples(n, seed, toxic=0.3):
    r = random.Random(seed)
    texts = [(i, int(r.random() < toxic), " ".join(r.choice(WORDS[: 30 if r.random() < 0.7 else 36]) for _ in range(r.randint(0, 25)))) for i in range(n)]
    return texts + [(n, 1, texts[0][2]), (n + 1, 0, texts[0][2])]


def plain(texts, rates, query, k):
    """(score before the curve, similarities) by whole vectors."""
    split = lambda t: toxicity.LETTERS.findall(t.lower())
    having = {w: [label for _, label, t in texts if w in split(t)] for w in {w for *_, t in texts for w in split(t)}}
    n_toxic = max(sum(label for _, label, _ in texts), 1)
    n_clean = max(len(texts) - sum(label for _, label, _ in texts), 1)

    def vector(text):
        out = {}
        for w in set(split(text)):
            labels = having.get(w, [])
            idf = math.log((1 + len(texts)) / (1 + len(labels))) + 1
            rf = math.log2(2 + sum(labels) / max((len(labels) - sum(labels)) * n_toxic / n_clean, 1)) if labels else 1
            out[w] = (1 + math.log(split(text).count(w))) * idf * rf**toxicity.LEAN
        norm = math.sqrt(sum(v * v for v in out.values())) or 1
        return {w: v / norm for w, v in out.items()}

    q = vector(query)
    near = sorted(((sum(v * x.get(w, 0) for w, v in q.items()), label) for x, label in ((vector(t), label) for _, label, t in texts)), reverse=True)
    near = [(s, label) for s, label in near if s > 0]
    return near[:k], near


@pytest.mark.parametrize(("n", "block", "k"), [(150, 4, 7), (150, 64, 7), (12, 32, 31)])
def test_neighbours_votes_and_scores_equal_whole_vectors(n, block, k):
    texts = examples(n, 3)
    rates = (3.0, 1.0)
    index = toxicity.Index([(i, label, *toxicity.terms_of(t)) for i, label, t in texts], rates, k, block)
    index.curve = (0.3, 1.2)
    r = random.Random(9)
    for _ in range(40):
        query = " ".join(r.choice([*WORDS, "never", "met"]) for _ in range(r.randint(1, 20)))
        near = index.nearest(*toxicity.terms_of(query))
        brute, every = plain(texts, rates, query, k)
        assert [s for s, _ in near] == pytest.approx([s for s, _ in brute], abs=1e-5)
        if near and (len(every) <= k or every[k - 1][0] - every[k][0] > 1e-4):  # else a tie at the end decides which of the equals votes
            toxic = sum(s * rates[1] for s, label in brute if label)
            vote = toxic / (toxic + sum(s * rates[0] for s, label in brute if not label))
            p = (vote + 0.02 * index.base) / 1.02
            want = 1 / (1 + math.exp(-(0.3 + 1.2 * math.log(p / (1 - p)))))
            assert index.score(*toxicity.terms_of(query))[0] == pytest.approx(want, abs=1e-4)
        assert bool(near) == (index.score(*toxicity.terms_of(query))[1] is not None)


def test_every_word_is_a_term():
    texts = examples(60, 4)
    index = toxicity.Index([(i, label, *toxicity.terms_of(t)) for i, label, t in texts])
    assert len(index.terms) == len({w for *_, t in texts for w in t.split()})
    assert (index.weight > 0).all()


def test_an_example_left_out_has_no_vote():
    texts = examples(60, 4)
    index = toxicity.Index([(i, label, *toxicity.terms_of(t)) for i, label, t in texts])
    i, _, text = next(t for t in texts if len(t[2].split()) > 5)
    assert i in {index.ids[at] for _, at in index.nearest(*toxicity.terms_of(text))}
    assert i not in {index.ids[at] for _, at in index.nearest(*toxicity.terms_of(text), but=i)}


def test_curve_is_fitted_to_rates():
    index = toxicity.Index([(i, i % 2, *toxicity.terms_of("word")) for i in range(100)])
    r = np.random.default_rng(1)
    votes = r.random(4000)
    index.calibrate([(float(v), int(r.random() < v * v)) for v in votes])
    for v in (0.3, 0.5, 0.8):
        a, b = index.curve
        assert 1 / (1 + math.exp(-(a + b * toxicity._log_odds(v, index.base)))) == pytest.approx(v * v, abs=0.06)


def test_blank_index_and_texts():
    assert toxicity.Index([]).score(*toxicity.terms_of("a word")) == (0.0, None)
    index = toxicity.Index([(1, 1, *toxicity.terms_of("bad word")), (2, 0, *toxicity.terms_of("")), (3, 0, *toxicity.terms_of("good word"))], (2.0, 1.0))
    for text in (None, "", " 123 !", "unknown"):
        assert index.score(*toxicity.terms_of(text)) == (pytest.approx(0.2), None)


def test_similarities_are_exact_sums_in_any_order_and_company():
    texts = examples(150, 5)
    index = toxicity.Index([(i, label, *toxicity.terms_of(t)) for i, label, t in texts], block=4)
    queries = [toxicity.terms_of(t) for *_, t in texts]
    together = list(index.nearest_of(queries))
    for query, near in zip(queries, together, strict=True):
        assert near == index.nearest(*query)
        values = {}
        for term, value in zip(*index.vector(*query), strict=True):
            for at in range(index.begin[index.entries[term]], index.begin[index.entries[term + 1]]):
                values.setdefault(int(index.at[at]), []).append(Fraction(float(value)) * Fraction(float(index.value[at])))
        every = sorted(((-sum(v), at) for at, v in values.items()))
        assert [(Fraction(s), at) for s, at in near] == [(-s, at) for s, at in every[: index.k]]


def test_few_of_the_lists_are_read(monkeypatch):
    r = random.Random(2)
    texts = [(i, i % 2, " ".join(r.sample(WORDS, 24) + [f"{'xy'[i % 2]}{'abcdefghij'[r.randint(0, 9)]}{'klmnop'[r.randint(0, 5)]}" for _ in range(6)])) for i in range(2000)]
    index = toxicity.Index([(i, label, *toxicity.terms_of(t)) for i, label, t in texts])
    read, ranges = [], toxicity._ranges
    monkeypatch.setattr(toxicity, "_ranges", lambda begin, end: read.append(int((end - begin).sum())) or ranges(begin, end))
    lists = [int((index.begin[index.entries[t + 1]] - index.begin[index.entries[t]]).sum()) for t in (index.vector(*toxicity.terms_of(text))[0] for *_, text in texts[:50])]
    for *_, text in texts[:50]:
        index.nearest(*toxicity.terms_of(text))
    assert sum(read) < 0.1 * sum(lists)
