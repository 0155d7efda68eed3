"""Joins by similarity, repeated strings, URL filters, mixing, and the pipeline."""

import hashlib
import math
from collections import Counter, defaultdict

import check
import numpy as np
import pytest
from helpers_llm import as_counter, components, smallest
from pyspark.sql import GroupedData, functions as F

import __spark_entry__ as entry
import corpus_pipeline
from revsync.llm import catalog, cover_tree, jaccard_join, mixing, suffix_array, url_filter

SF_DIR = "/root/testdata/sf0.001"


def shingles(text, width=5):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def expected_groups(rows):
    sets = [shingles(r[1]) for r in rows]
    links = [
        (a, b) for a in range(len(sets)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    least = smallest([r[0] for r in rows], components(len(rows), links))
    return Counter((r[0], len(s), m if s else r[0]) for r, s, m in zip(rows, sets, least))


def test_jaccard_join(spark, docs_of, rows_of_corpus):
    got = jaccard_join.join(docs_of(spark, rows_of_corpus, clash=True))
    assert as_counter(got, "doc_id", "n_shingles", "component_id") == expected_groups(rows_of_corpus)


def test_jaccard_join_of_a_chain_with_divided_groups(spark, docs_of, monkeypatch):
    """Links that no group's first class has, and n-grams dealt out over several groups."""
    monkeypatch.setattr(jaccard_join, "GROUP", 2)
    w = [f"w{i}" for i in range(130)]
    rows = [(500 - k, " ".join(w[k * 6 : k * 6 + 60]), None, None) for k in range(11)]
    rows += [(1000 + k, " ".join(w[:60] + [f"x{k}"]), None, None) for k in range(30)]
    got = jaccard_join.join(docs_of(spark, rows))
    assert as_counter(got, "doc_id", "n_shingles", "component_id") == expected_groups(rows)


@pytest.mark.parametrize("block", [16, 4096])
def test_cover_tree(spark, block):
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 8))
    v = [b.tolist() for b in base] + [(base[i % 9] + r.normal(size=8) * 0.12).tolist() for i in range(90)]
    v += [v[0]] * 5 + [(np.array(v[1]) * 1e-200).tolist(), (np.array(v[2]) * 1e200).tolist()]
    v += [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [math.nan] * 8, [math.inf] + [0.0] * 7, [1.0, 0.0], [1.0, 0.01]]
    rows = [(i, x, 0) for i, x in enumerate(v)] + [(3, v[3], 1), (None, v[4], 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = cover_tree.near_duplicates(df.withColumnRenamed("label", "key"), block=block)

    def unit(x):
        if not x or any(c is None or not math.isfinite(c) for c in x) or not any(x):
            return None
        a = np.array(x) / np.abs(x).max()
        return a / np.linalg.norm(a)

    u = [unit(x) for _, x, _ in rows]
    links = [
        (a, b) for a in range(len(u)) for b in range(a)
        if u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.9
    ]
    n = Counter(i for link in links for i in link)
    least = smallest([r[0] for r in rows], components(len(rows), links))
    least = [i if x is None else m for (i, _, _), x, m in zip(rows, u, least)]
    want = Counter((r[0], n[k], m, r[0] == m) for k, (r, m) in enumerate(zip(rows, least)))
    assert as_counter(got, "vec_id", "n_links", "component_id", "kept") == want


def expected_removal(rows):
    first = {}
    for i, t, _, _ in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - 49):
                first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = Counter()
    for i, t, _, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(bytes(gone).replace(b"\0", b" ").split())
        out[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


REMOVAL = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_suffix_dedup(spark, docs_of, rows_of_corpus):
    passage = "This passage of rather more than fifty bytes stands in several of the documents. "
    rows = rows_of_corpus + [
        (5000, "before " + passage + "after " * 3, None, None), (5001, "other " + passage * 3, None, None),
        (5002, passage[:60] + "é" + passage[10:], None, None), (5003, "é" * 40 + passage[5:55], None, None),
        (5000, "an id that has another text, too: " + passage, None, None), (7, "ab" * 40, None, None),
        (-3, passage[:50], None, None), (5004, "ab" * 100, None, None),
    ]
    got = suffix_array.dedup(docs_of(spark, rows, clash=True))
    assert as_counter(got, *REMOVAL) == expected_removal(rows)


def test_suffix_dedup_by_small_blocks(spark, docs_of, rows_of_corpus):
    """Texts longer than a block are judged over their whole length."""
    rows = [(i, (t or "")[: 9000], None, None) for i, t, _, _ in rows_of_corpus if i is not None]
    long = max((t for _, t, _, _ in rows if " " in t), key=len)
    rows.append((9000, "x " + long[100:8000] * 2, None, None))
    before = suffix_array.BLOCK, suffix_array.HELD
    suffix_array.BLOCK, suffix_array.HELD = 1 << 12, 500
    try:
        got = as_counter(suffix_array.dedup(docs_of(spark, rows)), *REMOVAL)
    finally:
        suffix_array.BLOCK, suffix_array.HELD = before
    assert got == expected_removal(rows)


def test_suffix_dedup_of_a_hot_q_gram(spark, docs_of, monkeypatch):
    """No task is given a q-gram's whole bucket, and strings at every distance from it count."""

    def whole_bucket(*_):
        raise AssertionError("a group is held whole")

    monkeypatch.setattr(GroupedData, "applyInPandas", whole_bucket)
    phrase = "0123456789 hot phrase of the day"
    rows = [(i, f"{i * 7919:030d}{phrase}{i * 104729:030d}", None, None) for i in range(300)]
    rows += [(1000 + k, "<" + rows[k][1][k : k + 50] + ">", None, None) for k in range(40)]
    got = suffix_array.dedup(docs_of(spark, rows))
    assert as_counter(got, *REMOVAL) == expected_removal(rows)


def test_suffix_dedup_tells_strings_apart_whose_hashes_share_40_bits(spark, docs_of):
    a, b, c, d = ("0000000000018823abcdefghijklmnopq" + x for x in
                  ("oaypjvkgnlpsyvvtw", "fodsnhbtvoinrgquj", "oxoipuayuhkzfbnyw", "zdyqzcsvqtxuyrrlh"))
    text = suffix_array.Text(200)
    text.load((a + b + c + d).encode())
    h = text.of(np.arange(0, 200, 50), 50) >> np.uint64(24)
    assert h[0] == h[1] and h[2] == h[3]
    rows = [(1, a, None, None), (2, b, None, None), (3, c + " one tail", None, None), (4, d + " another", None, None)]
    got = suffix_array.dedup(docs_of(spark, rows))
    assert as_counter(got, *REMOVAL) == expected_removal(rows)


PAGES = [
    (1, "https://a.example.org/es/1?utm_source=x", '<link rel="canonical" href="http://b.net/x">'),
    (2, "http://b.net/x#top", None),
    (3, "http://c.net/y", "<meta http-equiv='refresh' content='0; url=//b.net/x'>"),
    (4, "http://sub.EXAMPLE.org/en/12", ""),
    (5, "https://example.org/en/2", "<p>"),
    (6, "https://x.com/fr/1", '<link href="/de/9" rel=canonical>'),
    (7, "https://x.com/de/9", None),
    (8, "https://x.com/it/1", '<link rel="canonical" href="/de/9">'),
    (9, None, '<link rel="canonical" href="http://b.net/x">'),
    (10, "no address", None),
    (11, "http://org", None),
    (12, "http://notexample.org/es/1", None),
    (13, "http://d.net/1", "<link rel=canonical href=http://e.net/2>"),
    (14, "http://e.net/2", None),
    (1, "https://a.example.org/es/1?utm_source=x", None),
    (None, "http://e.net/2", None),
]
VERDICTS = {
    1: ("example.org/es/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("example.org/en/1", "block"),
    5: ("org/", "allow"), 6: ("com/fr/", "allow"), 7: ("com/de/", "block"), 8: (None, "allow"),
    9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: ("org/", "allow"),
    13: (None, "allow"), 14: (None, "allow"), None: (None, "allow"),
}


def test_url_filter(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as k", "'y' as rule")
    got = url_filter.judge(df, catalog.URL_RULES)
    want = Counter((p, *VERDICTS[p]) for p, _, _ in PAGES)
    assert as_counter(got, "page_id", "rule", "verdict") == want
    hosts = {r.page_id: (r.host, r.path) for r in got.collect()}
    assert hosts[4] == ("sub.example.org", "/en/12") and hosts[9] == hosts[10] == ("", "")
    more = spark.createDataFrame([("http://e.net/2", "http://sub.example.org/en/1")], "a string, b string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, catalog.URL_RULES, redirects=more).collect()}
    assert (got[13], got[14], got[None]) == ("block", "block", "block")


def test_mix(spark, docs_of, rows_of_corpus):
    rows = rows_of_corpus + [(8000 + i, "w " * 9, None, "m" * (i % 2 + 1)) for i in range(6)]
    got = mixing.mix(docs_of(spark, rows, clash=True), [5, 2, 1])
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(3), [5, 2, 1])
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert as_counter(got, *columns) == as_counter(again, *columns)
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len((t or "").encode().split())
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, free, target = sum(size.values()), set(size), {}
    while free:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= set(over)
    per = {round(r.target, 6): r for r in got.groupBy("source_size", "target").sum("taken").collect()}
    assert sorted(per) == sorted({round(t, 6) for t in target.values()})
    for r in per.values():
        assert abs(r["sum(taken)"] - r.target) <= 1 or r["sum(taken)"] % round(r.target) <= 2
    assert all(0 <= r.taken <= 3 * r["size"] for r in got.collect())


def test_empty_tables(spark, docs_of, tmp_path):
    none = docs_of(spark, [], clash=True)
    assert jaccard_join.join(none).count() == 0
    assert suffix_array.dedup(none).count() == 0
    assert mixing.mix(none, [1]).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cover_tree.near_duplicates(vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(pages, catalog.URL_RULES).count() == 0
    path = str(tmp_path)
    docs_of(spark, []).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for name in ("op1_license_scan", "op2_decontaminate", "op3_token_counts", "op7_pii_crf", "op10_language_bits"):
        assert catalog.queries()[name](spark, path).count() == 0
    assert corpus_pipeline.run(spark, path).count() == 0


def test_pipeline(spark, docs_of, rows_of_corpus, tmp_path):
    """Every stage against a plain version of its decision."""
    item = "a benchmark question of more than ten words which must not be in any training text"
    rows = rows_of_corpus + [(6000, f"some words before {item} and some after", "en", "a"), (6001, "call me at a@b.cd", "en", "b")]
    path = str(tmp_path)
    docs_of(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, docs, path)
        assert out.columns == docs.columns or f is corpus_pipeline.mix_sources
        docs = corpus_pipeline.stage(out, "test-stage")
        seen.append(docs.collect())
    letters = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert Counter((r.doc_id, r.text) for r in seen[0]) == Counter(r[:2] for r in letters)
    groups = {(i, m) for i, _, m in expected_groups(letters)}
    assert Counter(r.doc_id for r in seen[1] if r.doc_id is not None) == Counter(i for i, m in groups if i is not None and i == m)
    assert {r.doc_id for r in seen[1]} - {r.doc_id for r in seen[2]} == {6000}
    assert {r.doc_id: r.text for r in seen[3]}[6001] == "call me at [EMAIL]"
    assert Counter(r.doc_id for r in seen[4]) == Counter(r.doc_id for r in seen[3])
    whole = corpus_pipeline.run(spark, path)
    assert as_counter(whole, "doc_id", "size") == Counter((r.doc_id, r["size"]) for r in seen[4])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_the_check(spark, name):
    assert check.compare(spark, check.duck(SF_DIR), SF_DIR, name) is None


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))


def test_pipeline_stages_keep_columns_of_any_name(spark, docs_of, rows_of_corpus, tmp_path):
    """A column named like one of a stage's own comes out as it went in."""
    item = "a benchmark question of more than ten words which must not be in any training text"
    path = str(tmp_path)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = docs_of(spark, [*rows_of_corpus[:20], (6000, f"x {item}", "en", "a")])
    for c in ("row_key", "doc_key", "doc_mark"):
        docs = docs.withColumn(c, F.lit("mine"))
    for stage in (corpus_pipeline.keep_one_of_each_group, corpus_pipeline.drop_contaminated):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        assert {(r.row_key, r.doc_key, r.doc_mark) for r in out.collect()} == {("mine",) * 3}
    assert 6000 not in {r.doc_id for r in out.collect()}


def test_an_id_with_two_texts_stays_whole_or_goes(spark, docs_of, tmp_path):
    long = [" ".join(f"w{k}{i}" for i in range(30)) for k in "abc"]
    rows = [(1, long[0]), (1, long[1]), (2, long[1]), (3, long[2]), (3, long[2]), (2, long[0] + " more")]
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in rows])
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, str(tmp_path))
    assert as_counter(kept, "doc_id", "text") == Counter([(1, long[0]), (1, long[1]), (3, long[2])])


def test_pipeline_leaves_its_last_rows_only(spark, docs_of, rows_of_corpus, tmp_path):
    import os

    from revsync import session

    path = str(tmp_path)
    docs_of(spark, rows_of_corpus[:30]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "no such text")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    base = f"{session.shared_dir(spark).removeprefix('file:')}/revsync"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    corpus_pipeline.run(spark, path).count()
    left = {x[: x.rfind("-")] for x in set(os.listdir(base)) - before if not x.startswith("_scratch")}
    assert left <= {"pipeline-personal-data", "kept-ids", "contaminated", "mix-sizes", "mix-sources", "mix-targets", "mix-ranges"}
