"""Sets whose sketches rule a link out are not made again, and no link is lost by it."""

import numpy as np
import pyarrow as pa

from cohortloom.llm import ngram_join


def test_only_sets_that_can_link_are_made_again(spark, monkeypatch):
    def passage(k, words=40):
        return [f"w{k}x{i}" for i in range(words)]

    # Two of these texts share one of three passages at most, so their rarest shared shingles meet but they cannot link.
    rows = [(k, " ".join(passage(k) + passage((k + 5) % 40) + passage((k + 13) % 40))) for k in range(40)]
    near = passage("near", 100)
    rows += [(100, " ".join(near)), (101, " ".join(near[:-4])), (102, " ".join(near[3:]))]
    made, kept = {}, ngram_join.kept

    def counted(df, name):
        table = kept(df, name)
        if name == "segments":
            made.update({r.node: 1 for r in table.select("node").distinct().collect()})
        return table

    monkeypatch.setattr(ngram_join, "kept", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), cells=1 << 16).collect()}
    assert got == {k: k for k in range(40)} | {100: 100, 101: 100, 102: 100}
    assert len(made) == 3


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    possible = ngram_join._possible(75)
    for n in (1, 2, 7, 31, 128, 129, 500, 5000):
        for share in (0.7, 0.8, 0.86, 0.9, 1.0):
            both = rng.integers(-(2**63), 2**63 - 1, int(np.ceil(n * share)))
            x, y = (np.unique(np.r_[both, rng.integers(-(2**63), 2**63 - 1, k)]) for k in (n - len(both), max(0, n - len(both) - n // 20)))
            common = len(np.intersect1d(x, y))
            row = pa.RecordBatch.from_pydict({"a": [b"a"], "na": [len(x)], "sketch_a": [ngram_join._sketch(x)], "b": [b"b"], "nb": [len(y)], "sketch_b": [ngram_join._sketch(y)]})
            if 100 * common >= 75 * (len(x) + len(y) - common):
                assert next(possible(iter([row]))).num_rows == 1
    full = np.arange(5000, dtype=np.int64)  # one bucket holds all: no sketch, so nothing is ruled out
    assert ngram_join._sketch(full) == b""
