"""Components against a loop, whole and stopped early."""

import random

from ledgerloom.llm.components import components


def by_loop(links):
    root = {n: n for ab in links for n in ab if ab[0] != ab[1]}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if a != b and root[a] != root[b]:
                low = min(root[a], root[b])
                root[a] = root[b] = low
                moved = True
    return root


def test_components_match_a_loop(spark):
    draw = random.Random(3)
    path = [(i, i + 1) for i in range(1000, 1040)]
    star = [(2000, i) for i in range(2001, 2030)]
    loose = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)]
    links = path + star + loose + loose[:5] + [(3000, 3000), (-7, 5000)]
    frame = spark.createDataFrame(links, "a long, b long")
    expected = by_loop(links)
    assert dict((r.node, r.root) for r in components(frame).collect()) == expected
    early = [(r.node, r.root) for r in components(frame, rounds=1).collect()]
    assert {n for n, _ in early} == set(expected)
    assert all(expected[n] == expected[r] for n, r in early)


def test_no_links(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).count() == 0
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0
