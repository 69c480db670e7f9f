"""Clusters of many blocks, chains, stars that chance joined, and large centres, against brute force."""

import random

import pytest

from sparkloom.llm import graph, ngram_join

from test_llm_operators import _brute


def _texts(r):
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    base = [r.choice(vocabulary) for _ in range(120)]
    for _ in range(60):  # near copies around one text
        words = list(base)
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    words = list(base)
    for i in range(40):  # a chain that leads away from it
        words[(3 * i) % 120] = f"c{i}"
        words[(3 * i + 1) % 120] = f"d{i}"
        texts.append(" ".join(words))
    passage = [r.choice(vocabulary) for _ in range(90)]
    for i in range(30):  # texts that share most of a passage, some of them near each other
        texts.append(" ".join(passage + [f"x{i // 3}y{k}" for k in range(12)]))
    texts += texts[:5] + [None, "", "one two"]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("rule", [ngram_join.Rule(3, 90), ngram_join.Rule(5, 80)])
@pytest.mark.parametrize("rare", [3, 64])
def test_many_blocks(spark, rule, rare, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 4)
    texts = _texts(random.Random(rare + rule.num))
    want, sizes = _brute(texts, rule)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {x.doc_id: (x.component_id, x.n_shingles) for x in ngram_join.near_duplicates(df, rule).collect()}
    assert got == {i: (want[i], sizes[i]) for i in range(len(texts))}


def test_links_of_one_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 5)
    r, rule = random.Random(2), ngram_join.Rule(1, 60)
    sets = [sorted(r.sample(range(40), 12)) for _ in range(80)] + [sorted([*range(10), r.randrange(10, 14)]) for _ in range(40)]
    import numpy as np

    members = spark.createDataFrame([(i, 0, 24, r.randrange(24)) for i in range(120)], "node bigint, cluster bigint, blocks int, block int")
    held = spark.createDataFrame([(i, np.array(s, np.uint64).tobytes()) for i, s in enumerate(sets)] * 2, "node bigint, shingles binary")
    got = {x.node: x.component for x in graph.components(ngram_join._links(members, held, rule)).collect()}
    root = list(range(120))
    for i in range(120):
        for j in range(i):
            both = len(set(sets[i]) & set(sets[j]))
            if 100 * both >= 60 * (len(set(sets[i]) | set(sets[j]))):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert {i: got.get(i, i) for i in range(120)} == dict(enumerate(root)) and len(set(root)) > 2


def test_components_around_large_centres(spark, monkeypatch):
    monkeypatch.setattr(graph, "SALTS", 4)
    r = random.Random(3)
    edges = [(0, i) for i in range(1, 400)] + [(500 + i, 399) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(150)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = root[a], root[b]
        if a != b:
            root = {x: min(a, b) if y in (a, b) else y for x, y in root.items()}
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: y for x, y in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_rules_that_cannot_hold():
    for rule in ((3, 50), (3, 0), (3, 101), (0, 90)):
        with pytest.raises(ValueError):
            ngram_join.Rule(*rule)
    assert ngram_join.Rule(1, 51).num == 51 and ngram_join.Rule(1, 100).num == 100
