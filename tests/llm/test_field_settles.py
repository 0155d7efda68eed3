"""The field's probabilities of a text don't depend on the texts beside it; no Spark is needed."""

import random

import numpy as np

from revsync.llm import pii_crf


def field():
    rng = np.random.default_rng(3)
    k = len(pii_crf.LABELS)
    pairs = rng.normal(0, 2, (2, k, k))
    weights = rng.normal(0, 1, (len(pii_crf.FEATURES) + 1, k))
    return pii_crf.Field(weights, (pairs + pairs.transpose(0, 2, 1)) / 2)


def some_texts():
    rng = random.Random(4)
    words = ["+12025550143", "12025550143", "a@b.org", "10.0.0.1", "call", "42", "x9", "2025550143,", "4111 1111 1111 1111"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", "no digits"]


def marginals(f, texts):
    g = pii_crf.Graph()
    where = [g.add(t, pii_crf.base_spans(t)) for t in texts]
    p = f.marginals(g) if g.spans else np.zeros((0, len(pii_crf.LABELS)))
    return [p[list(w)] for w in where]


def test_a_text_alone_and_among_others():
    f, texts = field(), some_texts()
    together = marginals(f, texts)
    for t, p in zip(texts, together):
        (alone,) = marginals(f, [t])
        assert np.allclose(alone, p, rtol=0, atol=1e-12)
        assert not len(p) or np.allclose(p.sum(axis=1), 1)


def test_a_chain_has_exact_marginals():
    f = field()
    f.pairs = f.pairs * 0.3  # settled to within SETTLED of the exact sums
    text = "a1 b2 c3 d4"
    (p,) = marginals(f, [text])
    g = pii_crf.Graph()
    g.add(text, [])
    own, k = f.unary(g.shapes), len(pii_crf.LABELS)
    total = np.zeros((len(g.spans), k))
    for labels in np.ndindex(*[k] * len(g.spans)):
        score = sum(own[i, y] for i, y in enumerate(labels))
        score += sum(f.pairs[e, labels[a], labels[b]] for a, b, e in g.edges)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(score)
    assert np.allclose(p, total / total.sum(axis=1, keepdims=True), atol=5e-3)


def test_training_reads_whole_texts():
    g = pii_crf.Graph()
    assert len(g.add("7 " * 2000, [])) == 2000
