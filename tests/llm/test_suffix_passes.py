"""What op6 has on disk at once, and the passes it takes for that."""

import random

import numpy as np
import pyarrow as pa

from revsync import session
from revsync.llm import suffix_array

LENGTH = suffix_array.LENGTH


def _near_copies(n=20, words=3000, seed=3):
    """Texts, and of each a copy in which a word here and there is another."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrst", k=r.randint(3, 9))) for _ in range(20_000)]
    texts = [r.choices(vocabulary, k=words) for _ in range(n)]
    texts += [[r.choice(vocabulary) if r.random() < 0.01 else w for w in t] for t in texts]
    return [(i - 7, " ".join(t), "en", "a") for i, t in enumerate(texts)]


def _left(rows):
    seen, want = set(), {}
    for i, text, _, _ in sorted(rows):
        data = text.encode()
        strings = [data[k : k + LENGTH] for k in range(len(data) - LENGTH + 1)]
        gone = np.zeros(len(data) + 1, np.int64)
        for k, x in enumerate(strings):
            if x in seen:
                gone[k] += 1
                gone[k + LENGTH] -= 1
        seen |= set(strings)
        keep = np.cumsum(gone)[:-1] == 0
        want[i] = np.frombuffer(data, np.uint8)[keep].tobytes()
    return want


def test_op6_has_a_share_of_its_runs_on_disk_at_a_time(spark, docs_of, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr("revsync.llm.common.shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(suffix_array, "PASS", 1000, raising=False)
    rows = _near_copies()
    stage, sizes, staged = suffix_array.stage, [], []

    def watched(df, name):
        out = stage(df, name)
        sizes.append(sum(p.stat().st_size for p in tmp_path.rglob("part-*")))
        staged.append(name)
        return out

    monkeypatch.setattr(suffix_array, "stage", watched)
    got = suffix_array.dedup(docs_of(spark, rows))
    assert max(sizes) < sum(len(t) for _, t, _, _ in rows)
    assert staged.count("suffix-contexts") == suffix_array.PASSES
    assert {r.doc_id: bytes(r.kept) for r in got.collect()} == _left(rows)


def test_rows_that_travel_keep_their_first_documents():
    r = np.random.default_rng(2)
    n = 4000
    key = r.integers(0, 60, n).astype(np.uint64) << np.uint64(57)
    docs = r.integers(-1 << 40, 1 << 40, 9)
    c = {"key": key, "q": r.integers(0, 3, n).astype(np.uint64), "doc": docs[r.integers(0, 9, n)]}
    c |= {"version": r.integers(0, 2, n), "lo": np.arange(n), "n": np.ones(n, np.int64)}
    names = ("key", "q", *suffix_array._PLACE)
    sent = [suffix_array._sent({k: v[at : at + 500] for k, v in c.items()}, names) for at in range(0, n, 500)]
    assert sum(b.num_rows for b in sent) <= 8 * 60
    batches = pa.Table.from_batches(sent).sort_by("part").to_batches()
    late = []
    for rest, gone in suffix_array._met(batches, names):
        late += zip(suffix_array._doc(gone).tolist(), gone["version"].tolist(), gone["lo"].tolist())
        assert len(set(zip(rest["key"].tolist(), rest["q"].tolist(), suffix_array._doc(rest).tolist()))) == len(
            set(zip(rest["key"].tolist(), rest["q"].tolist()))
        )
    first = {}
    rows = list(zip(c["key"].tolist(), c["q"].tolist(), c["doc"].tolist()))
    for k, q, doc in rows:
        first[k, q] = min(doc, first.get((k, q), doc))
    want = [(doc, v, lo) for (k, q, doc), v, lo in zip(rows, c["version"].tolist(), range(n)) if doc > first[k, q]]
    assert sorted(late) == sorted(want)
