"""Connected components: what they are, and how many times they are written out."""

import random

import pytest
from helpers_llm import components

from revsync.llm import common, jaccard_join


def _edges(spark, links):
    return spark.createDataFrame(links, "x long, y long")


def _graph(kind):
    r = random.Random(7)
    if kind == "path":
        return [(i, i + 1) for i in range(40)]
    if kind == "hub":  # the hub has the largest number
        return [(99, i) for i in range(60)] + [(5, 70), (70, 71)]
    return [(r.randrange(100), r.randrange(100)) for _ in range(60)]


@pytest.fixture
def staged(monkeypatch):
    names, stage = [], common.stage
    monkeypatch.setattr(common, "stage", lambda df, name: names.append(name) or stage(df, name))
    return names


@pytest.mark.parametrize("kind", ["path", "hub", "random"])
def test_links_that_come_later_give_the_same_components(spark, kind):
    links = _graph(kind)
    random.Random(1).shuffle(links)
    want = {i: c for i, c in enumerate(components(100, links)) if any(i in x and x[0] != x[1] for x in links)}
    whole = common.components(_edges(spark, [*links, (None, 3), (4, None)]), "x", "y").collect()
    assert sorted((r.node, r.component) for r in whole) == sorted(want.items())
    cuts = (0, len(links) // 3, len(links) // 2, len(links))
    found = common.components(_edges(spark, links[: cuts[1]]), "x", "y")
    for at, to in zip(cuts[1:], cuts[2:]):
        found = common.extended(found, _edges(spark, links[at:to]), "x", "y")
    assert sorted((r.node, r.component) for r in found.collect()) == sorted(want.items())


def test_no_links_have_no_components(spark):
    none = common.components(_edges(spark, []), "x", "y")
    assert none.isEmpty() and common.extended(none, _edges(spark, [(2, 2)]), "x", "y").isEmpty()
    some = common.extended(none, _edges(spark, [(2, 1)]), "x", "y")
    assert sorted(map(tuple, some.collect())) == [(1, 1), (2, 1)]


def test_stars_are_settled_without_another_round(spark, staged):
    found = common.components(_edges(spark, [(0, i) for i in range(1, 50)] + [(60, i) for i in range(61, 90)]), "x", "y")
    assert staged == ["edges", "low"]
    assert {r.component for r in found.collect()} == {0, 60}
    del staged[:]
    common.extended(found, _edges(spark, [(7, 65)]), "x", "y")  # two leaves; the stars are two nodes now
    assert staged == ["edges", "low", "components"]


def test_only_pairs_of_long_sets_meet_their_finer_parities(spark):
    """A short pair stays as it is; a long one goes by its parities, whichever of the two is larger."""
    row = "cls long, n long, fine binary"
    parities = spark.createDataFrame([(1, 300, b"\x00" * 64), (2, 300, b"\x00" * 64), (3, 300, b"\xff" * 64), (4, 9, None)], row)
    pairs = spark.createDataFrame([(1, 2, True), (1, 3, True), (2, 3, True), (1, 4, False)], "a long, b long, long boolean")
    got = jaccard_join._refined(pairs, parities, 75).collect()
    assert sorted((r.a, r.b) for r in got) == [(1, 2), (1, 4)]
