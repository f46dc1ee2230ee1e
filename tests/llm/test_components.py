import random

from grainfold.llm.components import components


def by_hand(links):
    label = {x: x for link in links for x in link if link[0] != link[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label.get(a, a), label.get(b, b))
            for x in (a, b):
                if label.get(x, least) > least:
                    label[x], changed = least, True
    return label


def test_every_node_once_with_its_smallest(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 130)]
    rng.shuffle(chain)
    links = [*chain, *[(rng.randrange(60), rng.randrange(60)) for _ in range(35)], (500, 400), (400, 500), (400, 500), (-7, -7), *[(1000 + i, 999) for i in range(20)]]
    found = [tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()]
    assert sorted(found) == sorted(by_hand(links).items())
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
