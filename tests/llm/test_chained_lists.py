"""Lists of sets that touch each other by chance stay apart, and no link is lost by it."""

import itertools

import numpy as np
import pytest

from cohortloom.llm import ngram_join


def test_lists_that_only_touch_are_not_met_as_one_cluster(spark):
    size = 600
    name = lambda k: int(k).to_bytes(16, "big")
    rows = [(k, bytearray(name(j)), 20) for k in range(size - 2) for j in range(k, k + 3)]
    # Two lists of the same sets are one block.
    rows += [(size, bytearray(name(j)), 20) for j in range(3)]
    lists = spark.createDataFrame(rows, "gram long, node binary, n long")
    found = spark.createDataFrame([(bytearray(name(j)), bytearray()) for j in range(size)], "node binary, sketch binary")
    labels = spark.createDataFrame([(bytearray(name(7)), bytearray(name(6)))], "node binary, root binary")
    met = {}
    for r in ngram_join._met(lists, found, labels, 75).collect():
        met.setdefault((bytes(r.root), r.lo, r.hi), []).append(int.from_bytes(r.node, "big"))
    assert sum(map(len, met.values())) <= 3 * size
    pairs = {p for block in met.values() for p in itertools.combinations(sorted(block), 2)}
    assert {(a, b) for a in range(size) for b in range(a + 1, min(a + 3, size))} - {(6, 7)} <= pairs
    assert len(pairs) <= 2 * size


def components_of(texts, percent):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(len(sets))]


@pytest.mark.parametrize("percent", [60, 75])
def test_links_within_lists_without_their_hub(spark, percent):
    rng = np.random.default_rng(percent)
    phrase = lambda: [f"w{rng.integers(40)}" for _ in range(rng.integers(8, 30))]
    shared, texts = [phrase() for _ in range(12)], []
    for _ in range(60):
        text = sum((shared[k] for k in rng.integers(0, 12, 3)), phrase())
        texts.append(text)
        for _ in range(rng.integers(0, 4)):  # copies with some words changed
            other = list(text)
            for at in rng.integers(0, len(other), rng.integers(1, 4)):
                other[at] = f"w{rng.integers(40)}"
            texts.append(other)
    texts = list(dict.fromkeys(" ".join(t) for t in texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, percent, cells=1 << 16).collect()}
    assert [got[k] for k in range(len(texts))] == components_of(texts, percent)
    assert len(set(got.values())) < len(texts)
