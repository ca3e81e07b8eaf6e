import random

import pytest

from finquarry.llm.components import UnionFind, connected_components


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_of_chains_hubs_and_pairs(spark, few):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 300)] + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(250)]
    links += [(7, 7), (None, 3), (3, None), (5, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(3), few=few, heavy=40).collect()}
    uf, nodes = UnionFind(2000), set()
    for a, b in links:
        if a is not None and b is not None and a != b:
            uf.union(a, b)
            nodes |= {a, b}
    assert got == {n: uf.find(n) for n in nodes}


def test_no_links_and_too_few_rounds(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(chain, most_rounds=1, few=0)
