"""Connected components where ids are not in the order of the links."""

import random

from voltrace.llm.components import connected_components


def test_long_chain_in_random_order(spark):
    order = list(range(500))
    random.Random(5).shuffle(order)
    links = [*zip(order, order[1:], strict=False), (1000, 1001), (1002, 1001)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["label"] for r in got} == dict.fromkeys(order, 0) | dict.fromkeys((1000, 1001, 1002), 1000)
    assert len(got) == 503
