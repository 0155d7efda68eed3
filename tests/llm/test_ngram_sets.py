"""The n-gram join's sets and bounds against plain Python; no Spark is needed."""

import random

import numpy as np
import pyarrow as pa
import pytest

from revsync.llm import jaccard_join


def plain(text, width=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def some_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB cé\t\n\x0b x") for _ in range(rng.randint(0, 120))) for _ in range(800)]
    giant = "a" * 50 + " " + "b" * 300 + " c d e f g " + "B" * 300 + " c d e"
    return [None, "", "   ", "\x85 a", *texts, giant, "b" * 300 + " c d e"]


@pytest.mark.parametrize("block", [1 << 18, 64, 16])
def test_sets_are_those_of_a_plain_version_however_texts_are_cut(monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    whole = pa.array(some_texts())
    for column in (whole, whole.slice(3, 500), pa.array([], pa.string()), pa.array([None, None], pa.string())):
        got = list(jaccard_join.Sets(5)(column))
        want = [plain(t) for t in column.to_pylist()]
        assert [len(g) for g in got] == [len(w) for w in want]
        named = {}
        for g, w in zip(got, want):
            assert named.setdefault(w, g.tobytes()) == g.tobytes()
        assert len(set(named.values())) == len(named)


def test_a_block_changes_no_hash(monkeypatch):
    column = pa.array(some_texts())
    whole = [g.tobytes() for g in jaccard_join.Sets(5)(column)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 400)
    assert [g.tobytes() for g in jaccard_join.Sets(5)(column)] == whole


def test_parities_differ_in_no_more_cells_than_sets_in_ngrams():
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    for _ in range(200):
        a, b = (np.sort(rng.choice(grams, rng.integers(1, 300), replace=False)) for _ in "ab")
        x, y = (jaccard_join._parities(s) for s in (a, b))
        differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        apart = len(np.setxor1d(a, b))
        assert differ <= apart and (apart - differ) % 2 == 0


def test_finer_parities_never_refute_a_pair_that_is_similar():
    r = np.random.default_rng(5)
    for n, m in ((256, 256), (300, 380), (1000, 1024), (1025, 800), (5000, 6600)):
        for common in (0, n // 2, min(n, m)):
            a = r.integers(0, 1 << 63, n, np.uint64)
            b = np.append(a[:common], r.integers(0, 1 << 63, m - common, np.uint64))
            differ = jaccard_join._differ(jaccard_join._fine(np.sort(a)), jaccard_join._fine(np.sort(b)))
            assert differ <= n + m - 2 * common
            if not common:
                assert differ * 175 > (n + m) * 25


def test_long_texts_that_finer_parities_refute_send_no_sets(spark, docs_of, monkeypatch):
    """Two long texts share one n-gram, the rarest of both: 512 parities let that pair pass."""
    long = [" ".join(f"{who}{k}" for k in range(3000)) for who in "ab"]
    texts = [f"r0 r1 r2 r3 r4 {t}" for t in long] + [f"{t} {end}" for t in long for end in ("more", "other")]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    asked, wanted = [], jaccard_join._wanted
    monkeypatch.setattr(jaccard_join, "_wanted", lambda pairs: asked.append(pairs.count()) or wanted(pairs))
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs_of(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 1} and asked == [4]
