"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import bpe, chat, divergence, fingerprints, language_id, line_dedup, mixing, near_embeddings, ngram_join, packing, quality, repair, warc
from cohortloom.llm.common import kept

ACCEPTED = 0.3
"""Least quality score that is predicted as label 1."""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int):
    """crc32 of the id as text, modulo the number of parts."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pieces, held = _table(spark, sf_dir, "documents"), language_id.load_pieces(), _fold(4) == 2
    model = language_id.train(docs, pieces, ~held)
    labelled = language_id.identify(docs.select("doc_id", "text"), model, pieces)
    return labelled.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprints.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch"), F.col("same_edited")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch"), F.col("same_next")).alias("near_next"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), special=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), _fold(5) == 0
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~held)
    scored = quality.scored(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.transcoded(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.read_back(chat.expand(turns))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = kept(warc.archives(_table(spark, sf_dir, "pages")), "archives")
    return warc.records(stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "copies", "taken")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(turns), turns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_fingerprints,
        op3_ngram_jaccard,
        op4_packing,
        op5_quality,
        op6_byte_bpe,
        op7_chat,
        op8_line_templates,
        op9_near_vectors,
        op10_warc,
        op11_source_divergence,
        op12_mixing,
        op13_repair,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS own FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
s AS (SELECT own, count(*) AS n_copies FROM n GROUP BY own)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, coalesce(s.n_copies, 1) AS n_copies
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id LEFT JOIN s USING (own)""",
    "op7_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
      15 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS chars FROM t),
e AS (SELECT *, sum(CASE WHEN role = 'assistant' OR k = n THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k DESC) AS uses FROM i),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
      coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars * uses) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM a""",
    "op9_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a), d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)""",
    "op11_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + CAST(1000000000 AS HUGEINT) * (c + 1) // (sum(c) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM f),
l AS (SELECT lang, term, sum(c) AS c FROM f GROUP BY lang, term),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (c + 1) // (sum(c) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM l),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200""",
    "op12_mixing": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS key,
      (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
b AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM b),
o AS (SELECT *, sum(source_size) OVER () AS total, row_number() OVER f AS k, coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
      sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / weight, source)),
e AS (SELECT k, total - held AS room, open FROM o WHERE cap * open >= (total - held) * weight ORDER BY k LIMIT 1),
s AS (SELECT source, source_size, CASE WHEN o.k < e.k THEN CAST(cap AS DOUBLE) ELSE CAST(room * weight AS DOUBLE) / CAST(e.open AS DOUBLE) END AS target FROM o, e),
h AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / CAST(source_size AS DOUBLE)), 3) END AS whole FROM s),
g0 AS (SELECT *, target - whole * CAST(source_size AS DOUBLE) AS gap FROM h),
y AS (SELECT d.*, g0.source_size, target, whole, gap, gap / CAST(g0.source_size AS DOUBLE) AS pi FROM d JOIN g0 ON d.source IS NOT DISTINCT FROM g0.source),
q AS (SELECT *, (u / (1 - u)) / (pi / (1 - pi)) AS q FROM y WHERE size > 0 AND pi > 0),
r AS (SELECT rid, source, size, key, gap, q / (1 + q) AS t FROM q),
c1 AS (SELECT rid, source, size FROM r WHERE size <= gap QUALIFY sum(size) OVER (PARTITION BY source ORDER BY t, key, size ROWS UNBOUNDED PRECEDING) <= gap),
r1 AS (SELECT * REPLACE (gap - coalesce((SELECT CAST(sum(size) AS DOUBLE) FROM c1 WHERE c1.source IS NOT DISTINCT FROM r.source), 0) AS gap) FROM r WHERE rid NOT IN (SELECT rid FROM c1)),
c2 AS (SELECT rid, source, size FROM r1 WHERE size <= gap QUALIFY sum(size) OVER (PARTITION BY source ORDER BY t, key, size ROWS UNBOUNDED PRECEDING) <= gap),
r2 AS (SELECT * REPLACE (gap - coalesce((SELECT CAST(sum(size) AS DOUBLE) FROM c2 WHERE c2.source IS NOT DISTINCT FROM r1.source), 0) AS gap) FROM r1 WHERE rid NOT IN (SELECT rid FROM c2)),
c3 AS (SELECT rid, source, size FROM r2 WHERE size <= gap QUALIFY sum(size) OVER (PARTITION BY source ORDER BY t, key, size ROWS UNBOUNDED PRECEDING) <= gap),
r3 AS (SELECT * REPLACE (gap - coalesce((SELECT CAST(sum(size) AS DOUBLE) FROM c3 WHERE c3.source IS NOT DISTINCT FROM r2.source), 0) AS gap) FROM r2 WHERE rid NOT IN (SELECT rid FROM c3)),
c4 AS (SELECT rid FROM r3 WHERE abs(size - gap) < gap QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), size, t, key) = 1),
c AS (SELECT rid FROM c1 UNION ALL SELECT rid FROM c2 UNION ALL SELECT rid FROM c3 UNION ALL SELECT rid FROM c4),
n AS (SELECT *, CAST(whole AS BIGINT) + CASE WHEN rid IN (SELECT rid FROM c) THEN 1 ELSE 0 END AS copies FROM y)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, copies, CAST(copies * size AS BIGINT) AS taken FROM n""",
    "op13_repair": r"""
WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
          lambda a, b: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(a, b)), 4294967295), 4294967295) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS time FROM x WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS i FROM d),
f AS (SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
      CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 0 ELSE 3 END AS fault FROM o),
w(g, n, h, s, t) AS (VALUES (0, 0, 0, '', ''), (0, 1, 2, 'I', chr(10) || 'user:'), (0, 2, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
      (1, 0, 1, '', ''), (1, 1, 2, 'I', chr(10) || 'user:'), (1, 2, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
      (2, 0, 2, '', ''), (2, 1, 3, 'I', chr(10) || 'assistant:'), (2, 2, 2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'),
      (3, 0, 3, '', ''), (3, 1, 2, 'I', chr(10) || 'user:'), (3, 2, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
r(conv_id, i, g, m) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'c': 0, 'a': '', 't': ''} FROM f
      UNION ALL SELECT conv_id, i, e.g, min({'c': c + e.c, 'a': a || e.l, 't': t || e.line}) FROM (
        SELECT r.conv_id, f.i, r.m.c + 5 * w.n AS c, r.m.a || w.s AS a, r.m.t || w.t AS t,
          unnest([{'g': w.h, 'c': 2, 'l': 'D', 'line': ''}]
            || CASE WHEN fault IN (0, 3) AND ((f.c = 's' AND h = 0) OR (f.c = 'u' AND h <> 2) OR (f.c = 'a' AND h = 2)) THEN [{'g': CASE f.c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'c': CASE WHEN fault = 3 THEN 5 ELSE 0 END, 'l': 'K', 'line': chr(10) || role || ':' || text}] ELSE [] END
            || CASE WHEN fault IN (0, 3) THEN [{'g': CASE WHEN h = 2 THEN 3 ELSE 2 END, 'c': CASE WHEN fault = 3 THEN 6 ELSE 1 END, 'l': 'R', 'line': chr(10) || CASE WHEN h = 2 THEN 'assistant' ELSE 'user' END || ':' || text}] ELSE [] END) AS e
        FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 JOIN w ON w.g = r.g) GROUP BY conv_id, i, e.g),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
      count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT n.conv_id, min({'c': r.m.c + 5 * e.k, 'a': r.m.a || e.s, 't': r.m.t || e.t}) AS m FROM n JOIN r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.n
      JOIN (VALUES (0, 0, '', ''), (1, 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 1, 'I', chr(10) || 'assistant:'), (3, 0, '', '')) e(g, k, s, t) ON e.g = r.g GROUP BY n.conv_id)
SELECT q.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      CAST(coalesce(z.m.c, 0) AS BIGINT) AS cost, coalesce(z.m.a, '') AS audit, sha256(coalesce(substr(z.m.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM q.conv_id""",
}
