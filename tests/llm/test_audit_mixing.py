"""Source divergence audit and source mixing against plain recomputation, with their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import divergence, mixing

DOC = "doc_id long, text string, lang string, source string"


def table(spark, rows, parts=4):
    """Rows of documents with further columns whose names the operators use themselves."""
    made = spark.createDataFrame(rows, DOC)
    for name in ("size", "term", "shard", "t", "key", "value", "row"):
        made = made.withColumn(name, F.lit("x"))
    return made.repartition(parts)


def sample(rng, n):
    words = ["Über", "the", "THE", "a1b", "x-y", "naïve", "日本", "rain", "snow", "é", "Ω q", "zzz", "\x00k"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 4, 30]))) for _ in range(n)]
    rows = [(rng.choice([None, i]), t, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "ß", None, "", "S"])) for i, t in enumerate(texts)]
    return rows + [(1, None, "xx", "only"), (1, "", "yy", None), (1, "lone term", "yy", "b")] + [(7, "rain rain snow", "en", "s1")] * 5


def plain_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    seen, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        seen.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        terms = [w for (g, w), n in seen.items() if g == lang and n >= least]
        every = Counter()
        for s in sources:
            every.update(counts[lang, s])

        def shares(c):
            n = sum(c[w] for w in terms)
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(terms)) for w in terms}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(every)
        for s in sources:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in terms)) for o in sources if o != s]
            lead = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in terms if counts[lang, s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", lead, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("tight", [False, True])
def test_audit_matches_recomputation(spark, monkeypatch, tight):
    if tight:
        for name, value in {"SHARD_TERMS": 3, "ROUND_BYTES": 200, "BLOCK": 2, "HELD_TERMS": 5, "SLOT_BYTES": 100, "SLICE": 3}.items():
            monkeypatch.setattr(divergence, name, value)
    rows = sample(random.Random(4), 150)
    got = divergence.audit(table(spark, rows), top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, top=4)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOC)).collect() == []


def test_perfect_hash_is_minimal_and_verifies_keys():
    keys = [f"k{i}é".encode() for i in range(5000)]
    made = divergence.PerfectHash.build(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(5000))
    assert (made.slots([f"q{i}".encode() for i in range(5000)]) == -1).all()
    assert made.slots([]).tolist() == [] and divergence.PerfectHash.build([b"one"]).slots([b"one", b"two"]).tolist() == [0, -1]


def test_perfect_hash_keeps_keys_that_share_every_place(monkeypatch):
    monkeypatch.setattr(divergence, "LEVELS", 1)
    keys = [b"%d" % i for i in range(200)]
    assert sorted(divergence.PerfectHash.build(keys).slots(keys).tolist()) == list(range(200))


def test_shares_are_exact_beyond_64_bit_products():
    import numpy as np

    count, n, v = 8 * 10**14, 9 * 10**14, 12345
    assert divergence.shares(np.array([count]), np.array([n]), v)[0] == 1 + 10**9 * (count + 1) // (n + v)


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares of the total by weight, exact, capped one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        share = {s: Fraction(most * sizes[s]) if s in full else Fraction(left * weight[s], open_) for s in order}
        more = {s for s in order if share[s] > most * sizes[s]}
        if not more:
            return share
        full |= more


def check_mix(rows, got):
    sizes, words = defaultdict(int), lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, text, _, source in rows:
        sizes[source] += words(text)
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    assert Counter((r.row.doc_id, r.size, r.source_size) for r in got) == Counter((i, words(t), sizes[s]) for i, t, _, s in rows)
    for r in got:
        source = r.row.source
        assert r.target == pytest.approx(float(want[source]))
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert abs(r.copies - float(want[source]) / max(sizes[source], 1)) < 1 or r.size == 0
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    for source, total in taken.items():
        assert abs(total - want[source]) <= largest[source] / 2
    return taken


def test_mix_meets_targets_whatever_the_partitions(spark):
    rng = random.Random(8)
    rows = sample(rng, 200)
    first = mixing.mix(table(spark, rows, 3), carry=["doc_id", "source", "text"]).collect()
    check_mix(rows, first)
    again = mixing.mix(table(spark, rows[::-1], 6), carry=["doc_id", "source", "text"]).collect()
    assert Counter(map(str, first)) == Counter(map(str, again))
    assert mixing.mixed(table(spark, rows, 3)).count() == sum(r.copies for r in first if r.copies)


def test_target_met_among_equal_rows(spark):
    rows = [(None, "one two three", "en", "a")] * 90 + [(i, "w " * 40, "en", "b") for i in range(30)] + [(5, " ", "en", "c"), (6, None, "en", None)]
    got = mixing.mix(table(spark, rows), carry=["doc_id", "source"]).collect()
    taken = check_mix(rows, got)
    assert taken["a"] == 3 * 270 and taken["c"] == taken[None] == 0
    rows = [(None, "one two three", "en", "a")] * 90 + [(i, "w " * 9, "en", "b") for i in range(200)]
    got = mixing.mix(table(spark, rows), carry=["doc_id", "source"], weights=(1, 6)).collect()
    few = Counter(r.copies for r in got if r.row.source == "a")
    assert few == {1: 81, 2: 9}  # a seventh of 2070 words is 295.7: 270, and 27 of a sample whose rows all tie


def test_preference_raises_inclusion(spark):
    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(600)]
    docs = table(spark, rows)
    liked = F.when(F.col("doc_id") < 300, 9.0).otherwise(1.0)
    got = mixing.mix(docs, carry=["doc_id", "source"], weights=(1, 3), preference=liked).collect()
    extra = Counter((r.row.doc_id < 300) for r in got if r.row.source == "b" and r.copies == 2)
    assert extra[True] > 2 * extra[False] > 0


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOC)).collect() == []


def test_ranks_come_from_id_and_text(spark):
    row = spark.createDataFrame([(3, "ab")], "doc_id long, text string").select(mixing.uniform(F.col("doc_id").cast("string"), F.col("text")).alias("u")).first()
    head = int(hashlib.md5(("3:" + hashlib.md5(b"ab").hexdigest()).encode()).hexdigest()[:13], 16)
    assert row.u == (head + 0.5) / 2**52
