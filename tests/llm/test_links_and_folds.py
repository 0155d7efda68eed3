"""Targets of canonical and refresh links in all their forms; the fold of a row without id."""

import duckdb
import pandas as pd
import pytest

from revsync.llm import catalog, url_filter

TARGETS = [
    # (page, target, what the target names or None)
    ("http://x.com/it/a/b", "../../de/9", "http://x.com/de/9"),
    ("http://x.com/it/a/b", "./c", "http://x.com/it/a/c"),
    ("http://x.com/it/a/b", "..", "http://x.com/it/"),
    ("http://x.com/it/a/b", "../../../../de/1", "http://x.com/de/1"),
    ("http://x.com/it/c", "/fr/./x/../y", "http://x.com/fr/y"),
    ("http://x.com/it/a/b", "?p=2", "http://x.com/it/a/b?p=2"),
    ("http://x.com/it/a/b?p=1", "?p=2&amp;q=../r", "http://x.com/it/a/b?p=2&q=../r"),
    ("http://x.com", "c", "http://x.com/c"),
    ("http://x.com", "?p=2", "http://x.com?p=2"),
    ("http://x.com/a", "//y.net/de/../b", "http://y.net/b"),
    ("http://x.com/a", "https://k.net/q?x=1&amp;y=2", "https://k.net/q?x=1&y=2"),
    ("http://x.com/a", "https:&#47;&#x2F;k.net/q", "https://k.net/q"),
    ("http://x.com/a", "#top", None),
    ("http://x.com/a", "mailto:a@b.org", None),
    ("http://x.com/a/", "..b/.c", "http://x.com/a/..b/.c"),
]


def canonical(target):
    return f'<html><link rel="canonical" href="{target}"></html>'


def test_links_of_every_form_of_target(spark):
    rows = [(page, canonical(t)) for page, t, _ in TARGETS]
    rows += [(page, f'<meta http-equiv="refresh" content="0; url={t}">') for page, t, _ in TARGETS]
    pages = spark.createDataFrame([*rows, (None, canonical("/x")), ("http://x.com/", None)], "url string, html string")
    got = sorted((r.a, r.b) for r in url_filter.links(pages, "url", "html").collect())
    assert got == sorted(2 * [(page, b) for page, _, b in TARGETS if b])


def test_every_tag_of_a_page_counts(spark):
    html = canonical("/a") + canonical("/b") + '<meta http-equiv=refresh content="1;url=c"><LINK href=/d rel=canonical>'
    got = url_filter.links(spark.createDataFrame([("http://x.com/p/q", html)], "url string, html string"), "url", "html")
    assert {r.b for r in got.collect()} == {f"http://x.com/{p}" for p in ("a", "b", "p/c", "d")}


@pytest.mark.parametrize("extra", [[], [("http://free.net/p", canonical("http://x.com/de/9"))]])
def test_verdicts_agree_with_sql(spark, tmp_path, extra):
    pages = [(page, canonical(t)) for page, t, _ in TARGETS] + extra
    pages += [("http://x.com/de/9", None), ("https://k.net/q?x=1&y=2", canonical("http://x.com/de/3")), (None, None), ("a", "")]
    rows = pd.DataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], columns=["page_id", "url", "html"])
    rows.to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    want = con.execute(catalog.oracle_sql()["op8_url_redirects"]).fetchall()
    got = catalog.op8_url_redirects(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    verdict = {r.page_id: r.verdict for r in got}
    assert verdict[0] == "block"  # its canonical page is x.com/de/9
    assert verdict[10] == "block"  # by way of k.net/q?x=1&y=2
    assert not extra or verdict[len(TARGETS)] == "block"


def test_a_row_without_id_is_not_held_out(spark, tmp_path):
    rows = [(i, "der hund und die katze " * 3, "de") for i in range(12)] + [(None, "der hund", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op10_language_bits(spark, str(tmp_path)).collect()
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.held_out for r in got if r.doc_id is not None} == {True, False}
