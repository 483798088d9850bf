"""Training-data operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import bpe, chat, fingerprints, language_id, line_dedup, near_embeddings, ngram_join, packing, quality, queries, warc
from cohortloom.llm.common import Shingler, components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "İstanbul ² m² <|endoftext|> it's 中文 字。 \x1c x", "a" * 5000, "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    """Prose, copies, near copies, odd texts, null and repeated ids, and columns with clashing names."""
    rng = random.Random(3)
    words = ["the", "of", "and", "rain", "stone", "river", "glass", "light", "north", "salt", "paper", "iron"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120]))) for _ in range(40)]
    near = [re.sub(r"^(\S+ ){2}", f"x{i} y{i} ", prose[2] + " " + prose[3] + " " + prose[5]) for i in range(12)]
    texts = prose + prose[:6] + near + ODD
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, prose[0], None, None, None), (1, prose[1], "en", "s", 0)]
    return spark.createDataFrame(rows, DOC).withColumn("score", F.lit(9)).withColumn("n", F.lit("n")).withColumn("node", F.lit(1)).withColumn("words", F.lit(2)).repartition(5)


def plain_set(text, n=5):
    w = [x.decode() for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def groups(n, links):
    parent = list(range(n))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        p, q = top(a), top(b)
        parent[max(p, q)] = min(p, q)
    return [top(i) for i in range(n)]


def test_shingler_matches_words():
    import pyarrow as pa

    texts = ["A b  C d e f", "a B c D E F g", "", None, "x", "x y", "xy", "é É é É é É", *ODD]
    got = list(Shingler().sets(pa.array(texts)))
    want = [plain_set(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for (g, w), (h, v) in itertools.combinations(zip(got, want, strict=True), 2):
        assert len(np.intersect1d(g, h)) == len(w & v)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}}


def test_jaccard_components_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = [plain_set(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = groups(len(rows), links + [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][0] is not None and rows[i][0] == rows[j][0]])
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    want = sorted((str(d), len(s), None if d is None else least[r]) for (d, _), s, r in zip(rows, sets, root, strict=True))
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, cells=1 << 16).collect())
    assert got == want


def test_jaccard_components_of_hub_free_groups(spark):
    """Chains whose members link only to neighbours, so that hubs alone can't join them; small blocks."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[12 * k : 12 * k + 110]) for k in range(20)]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old, ngram_join.BLOCK = ngram_join.BLOCK, 4
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(data, cells=1 << 16).collect()}
    finally:
        ngram_join.BLOCK = old
    sets = [plain_set(t) for t in texts]
    assert [got[i] for i in range(20)] == groups(20, [(i, j) for i, j in itertools.combinations(range(20), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert ngram_join.jaccard_components(none, cells=1 << 16).count() == 0
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert packing.pack(none).count() == 0
    assert bpe.transcoded(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert near_embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert warc.records(warc.archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    assert chat.read_back(chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    pieces = language_id.load_pieces()
    model = language_id.train(none, pieces, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, model, pieces).collect()} == {"und"}
    blank = quality.train(none, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r.score for r in quality.scored(docs, blank).collect()} == {0.5}


def test_edited_fingerprints(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    want = []
    for k, (d, t) in enumerate(rows):
        half, after = len(t) // 2, rows[(k + 1) % len(rows)][1]
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = fingerprints.edited_fingerprints(docs, buckets=7).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)


def test_sketch_estimates_and_merges(spark):
    rng = random.Random(5)
    w = [f"w{rng.randrange(10**6)}" for _ in range(8000)]
    data = spark.createDataFrame([(" ".join(w), " ".join(w[:4000]), " ".join(w[4000:]))], "a string, b string, c string")
    for c in "abc":
        data = fingerprints.with_sketch(data, c, f"s{c}")
    s = {c: F.col(f"s{c}") for c in "abc"}
    r = data.select(fingerprints.containment(s["b"], s["a"]).alias("inside"), fingerprints.resemblance(s["a"], s["b"], F.lit(False)).alias("like"), fingerprints.containment(fingerprints.merge(s["b"], s["c"]), s["a"]).alias("merged"), F.size("sa").alias("kept")).first()
    assert r.inside == 1 and abs(r.like - 0.5) < 0.05 and r.merged == 1 and abs(r.kept / 7996 - 0.25) < 0.03


def test_forward_sums_every_segmentation():
    pieces = language_id.load_pieces()
    names = {}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = sorted({p for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for p in [model.id_to_piece(i)] if p == "▁" or (p.removeprefix("▁").isalpha() and p == p.lower())})
    names = {p: i for i, p in enumerate(plain)}
    table = np.random.default_rng(0).random((pieces.count + 1, 2)) / 1000
    table[-1] = 0

    def brute(text):
        if not text:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(text) + 1):
            p = table[names[text[:k]]] if text[:k] in names else np.full(2, language_id.UNKNOWN) if k == 1 else None
            if p is not None:
                total = total + p * brute(text[k:])
        return total

    words = ["stone", "an", "中x", "thing"]
    assert np.allclose(language_id.log_likelihood(pieces, table, words), np.log([brute("▁" + w) for w in words]))
    long = "abcdefgh" * 8
    assert np.isfinite(language_id.log_likelihood(pieces, table, [long])).all()


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_of_odd_texts(spark):
    pieces = language_id.load_pieces()
    model = language_id.train(spark.createDataFrame([("the rain", "en"), ("der regen", "de"), (None, "de"), ("x", None)], "text string, lang string"), pieces, F.lit(True))
    got = [r.lang_pred for r in language_id.identify(spark.createDataFrame([(t,) for t in [None, "", "12 ²!", "der regen", "the rain"]], "text string").coalesce(1), model, pieces).collect()]
    assert got == ["und", "und", "und", "de", "en"]


def test_packing_tiles_all_ids(docs):
    window = 64
    got = packing.pack(docs, window=window).toPandas()
    at = sorted((s * window + o, n) for s, o, n in zip(got.sequence_id, got.offset, got.length, strict=True))
    assert [a for a, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1]] and (got.offset + got.length <= window).all()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    want = []
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((str(r.doc_id), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    whole = packing.pack(docs, window=1 << 20).toPandas()
    ids = ["None" if x != x else str(int(x)) for x in whole.doc_id]
    assert sorted(zip(ids, whole.length, whole.ids_crc32, strict=True)) == sorted(want)
    assert packing.padded_length(4096) == 4096 and packing.padded_length(1024) == 1024 and packing.padded_length(1000) == 4096


def test_packing_query_reads_special_tokens_as_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["foo <|endoftext|> bar", "Foo<|endoftext|>Bar.", "<|ENDOFTEXT|> a<|StartOfText|>b", "<|startoftext|><|endoftext|>!", "X<|ENDOFTEXT|><|endoftext|>Y", "\u0130<|endoftext|>\u00e9", "<|endo ftext|> plain Words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts)}
    for got in (queries.op4_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        assert {r.doc_id: r.ids_crc32 for r in got.collect()} == want


def test_quality_held_out(spark):
    got = queries.op5_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_bpe_equals_the_library(spark, docs):
    import tiktoken

    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(200)) for _ in range(30)]
    data = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*odd, "<unk> ▁▁", "\x00 \x1c\x85"])], "doc_id long, text string"))
    for text, r in zip([r.text or "" for r in data.collect()], bpe.transcoded(data, ids=True).collect(), strict=True):
        assert r.ids == own.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    with pytest.raises(ValueError):
        bpe.model_bytes({b"a": 0})


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "a\n### user: b </turn>\n", "\\\\", "", "#<:\\"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, None), (3, None, "assistant", "x"), (3, 1, "assistant", "x"), (None, 0, "a:b", "y")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    examples = chat.expand(data)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    said = [("assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    loss = texts[1] + texts[3]
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (5, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (got[3].n_turns, got[3].loss_chars, got[2].loss_chars, got[None].n_turns) == (2, 2, 0, 1)
    spans = [r for r in examples.filter("conv_id = 1").orderBy("example").collect()]
    assert [r.text[r.mask_start : r.mask_end] for r in spans] == [chat.escape(texts[1]), chat.escape(texts[3]), ""]
    with pytest.raises(ValueError):
        chat.read_turns("x" + spans[0].text)


def test_line_templates(spark):
    lines = [f"user {i} logged in from host h{i} at night" for i in range(4)]
    same = "this line is the same in every document here"
    rows = [(i, f"{lines[i]}\nonly in document {'abcd'[i]} is this {'wxyz'[i] * 3} line and nothing like it {'efgh'[i]} {'mnop'[i]}\n{same}\nshort line\n{same}") for i in range(4)]
    rows += [(None, same), (9, None), (10, ""), (11, "one two three four fife six"), (12, "one two three four five six"), (13, "one two three four five6 six")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).withColumn("line", F.lit(1))).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    assert got[3].text.split("\n")[0].startswith("only in document d") and got[3].n_dropped == 3 and got[3].text.endswith("short line")
    assert got[None].text == same and got[9].text is None and got[10].text == ""
    assert got[11].text == rows[7][1] and got[12].text == "" and got[13].text == ""


def test_a_line_of_two_documents_recurs(spark):
    passage = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "stuvwxy")
    rows = [(1, f"{passage}\none of its own lines here"), (2, f"another line of its own\n{passage}"), (3, "five tokens in one line"), (4, "five tokens in one line"), (5, passage + " more")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.n_dropped for d, r in got.items()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}
    assert got[1].text == rows[0][1] and got[2].text == "another line of its own"


def test_short_lines_recur_too(spark):
    rows = [(i, f"All rights reserved.\nPage {i} of 9\n{100 + i}\n\n7\n{'Nine of us.' if i < 9 else 'Ten.'}") for i in range(10)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    for i in range(1, 10):
        assert got[i].text == f"{100 + i}\n\n{'Nine of us.' if i < 9 else 'Ten.'}" and got[i].n_dropped == 3


def test_large_leaves_have_the_templates_of_small_ones(spark, monkeypatch):
    rng = random.Random(5)
    lines = []
    for family in range(60):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)]
        for _ in range(5 if family < 40 else 1):
            own = [rng.choice("ABCDEFGH") if i in rng.sample(range(20), 2) else w for i, w in enumerate(base)]
            lines.append(" ".join(["one", "two", "three", "four", *own]))
    at = len(lines)
    lines += [f"one two three four {'is a line with few words' + ' of the same kind' * 3} {w} in" for w in "mnopqrstuvwxyzABCDEF"]
    lines += [f"here is one more leaf {a} {b} and no more" for a in "abc" for b in "abcdef"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = []
    for most in (4000, 30):
        monkeypatch.setattr(line_dedup, "LEAF_LINES", most)
        templates = line_dedup.line_templates(docs)[1].collect()
        found.append({(r.leaf, r.line): (r.template, r.pattern) for r in templates})
        assert sum(r.n_dropped for r in line_dedup.dedup_lines(docs.filter(f"doc_id >= {at} and doc_id < {at + 20}")).collect()) == 19
    assert found[0] == found[1] and 40 < len(set(found[0].values())) < 200


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 64))
    v = np.concatenate([base, base[:10] + 0.3 * rng.standard_normal((10, 64)), base[:5], 1e-3 * base[20:25], base[30:31] + 0.4 * rng.standard_normal((40, 64))])
    data = [(int(i), [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    bad = [(900, None), (901, [0.0] * 64), (902, [None] * 64), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (None, data[0][1]), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    frame = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("node", F.lit("x"))
    x = np.array([r for _, r in data])
    c = x @ x.T / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None]
    link = (c >= 0.9) & ~np.eye(len(x), dtype=bool)
    root = groups(len(x), np.argwhere(link).tolist())
    got = {r.vec_id: r for r in near_embeddings.near_vectors(frame, block=16).collect() if r.vec_id is not None}
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(x))] == [(int(link[i].sum()), root[i], root[i] == i) for i in range(len(x))]
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905)) and got[906].component_id == 905


def test_the_estimate_never_loses_a_pair():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 64))
    x = np.concatenate([x, x + 0.45 * rng.standard_normal(x.shape)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = near_embeddings.rotation(64)
    bits, factor = near_embeddings.encode(x, turn)
    found = {(a, b) for p, q in near_embeddings.candidates(bits, factor, (x @ turn.T).astype(np.float32), 0.9) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    assert {tuple(p) for p in np.argwhere(x @ x.T >= 0.9).tolist()} <= found and len(found) < 0.05 * len(x) ** 2
    estimate = (near_embeddings.signs(bits, 64) @ (x @ turn.T).T) / factor[:, None]
    assert abs((estimate - x @ x.T).mean()) < 0.01


def test_warc_round_trip_and_validation(spark):
    long = "<p>" + "é" * 80 + "</p>"
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, None), (4, "u\r\nWARC-Type: x", "short"), (5, "u", "short"), (6, "u", "x" * 300_000), (None, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit(1)).coalesce(1)
    stored = warc.archives(pages, archive_bytes=1000)
    got = {r.page_id: r for r in warc.records(stored).collect()}
    for page, _, html in rows:
        payload = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert bytes(got[page].body) == (b"" if page == 2 else payload)
    assert {p: (r.record_type, r.refers_to) for p, r in got.items() if r.record_type == "revisit"} == {2: ("revisit", 1)}
    whole = max((bytes(r.archive) for r in stored.collect()), key=len)
    assert len(list(warc.read_archive(whole))) >= 1 and int.from_bytes(whole[:4], "little") == warc.DICTIONARY_MAGIC
    for broken in (whole[:-3], whole[:20], whole + b"xx"):
        with pytest.raises(warc.FormatError):
            list(warc.read_archive(broken))
    good = warc.record_bytes(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), "response", None)
    assert warc.parse_record(good)["body"] == b"body"
    for bad in (good.replace(b"body", b"bodi"), good.replace(b"Content-Length: 4", b"Content-Length: 5"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Type", b"WARC-Kind")):
        with pytest.raises(warc.FormatError):
            warc.parse_record(bad)


def test_pipeline_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "line dedup", "n-gram Jaccard join", "packing"]
    kept = corpus_pipeline.one_of_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    groups_ = {r.component_id for r in ngram_join.jaccard_components(docs).filter("doc_id is not null").collect()}
    assert {r.doc_id for r in kept.collect()} - {None} == groups_
    cut = corpus_pipeline.without_repeated_lines(spark, docs, SF)
    assert cut.columns == docs.columns and {9} == {r.score for r in cut.collect()}
    assert corpus_pipeline.known_language(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.good_quality(spark, docs, SF).columns == docs.columns
