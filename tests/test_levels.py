"""Levels of random graphs, most of whose links are set aside before the rounds."""

import random

import pytest

from sieveline.operators import graph


def plain(nodes, links):
    level, links = {}, {(a, b) for a, b in links if a in nodes and b in nodes}
    while ready := {n for n in nodes - set(level) if all(b in level for a, b in links if a == n)}:
        level |= {n: max((1 + level[b] for a, b in links if a == n), default=0) for n in ready}
    return level


@pytest.mark.parametrize("seed", range(4))
def test_levels_are_the_plain_loop(spark, seed, monkeypatch):
    rng = random.Random(seed)
    nodes = set(range(60))
    links = [(a, rng.randrange(max(1, a // 3)) if rng.random() < 0.97 or not seed else rng.randrange(64)) for a in range(1, 60) for _ in range(2)] + [(99, 1)] * (seed > 1)
    rounds = []
    true = graph._rounds
    monkeypatch.setattr(graph, "_rounds", lambda df: rounds.append(df.count()) or true(df))
    edges = spark.createDataFrame(links, "src long, dst long")
    got = graph.levels(edges, spark.createDataFrame([(n,) for n in nodes], "node_id long")).collect()
    assert len(got) == len(dict(got)) and dict(got) == plain(nodes, links)
    assert sum(rounds) < len(set(links)) / 2
