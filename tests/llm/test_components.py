"""Connected components against union-find."""

import random

from tessera.llm.components import components, extended


def brute(links):
    label = {x: x for ab in links for x in ab}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)]  # a chain and a star
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7), (3, 2)]
    rng.shuffle(links)
    shape = "a long, b long"
    got = components(spark.createDataFrame(links, shape))
    assert {r.node: r.label for r in got.collect()} == brute([x for x in links if x[0] != x[1]])
    more = [(60, 100), (500, 501), (500, 30), (210, 320)]
    both = extended(got, spark.createDataFrame(more, shape))
    assert {r.node: r.label for r in both.collect()} == brute([x for x in links if x[0] != x[1]] + more)
