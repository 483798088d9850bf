"""Threshold-scaled document sketches, in DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range. Sketches made
with the same fraction merge by union, and the share of one sketch found in another estimates
containment, also between texts of very unequal length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.llm.common import shingle_hashes, words

FRACTION = 0.25
LEAST = -(2**63)


def with_sketch(df: DataFrame, text: str, name: str, fraction: float = FRACTION, n: int = 5) -> DataFrame:
    """Add ``name`` array<bigint>: sorted distinct shingle hashes of ``text`` below ``fraction`` of the range.

    A null or blank text has an empty sketch; fewer than ``n`` words are one shingle.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be over 0 and at most 1")
    limit = min(LEAST + int(fraction * 2**64), 2**63 - 1)
    held = f"__{name}_words"
    found = df.withColumn(held, words(F.col(text)))
    low = F.filter(shingle_hashes(F.col(held), n), lambda h: h <= F.lit(limit))
    return found.withColumn(name, F.sort_array(F.array_distinct(low))).drop(held)


def fingerprint(sketch: Column, fraction: float = FRACTION) -> Column:
    """The sketch as text: its fraction, then the hashes in hexadecimal."""
    return F.concat(F.lit(f"{fraction:g}:"), F.concat_ws(",", F.transform(sketch, lambda h: F.hex(h))))


def resemblance(a: Column, b: Column, same: Column) -> Column:
    """Share of the merged sketch that both hold. Two empty sketches are alike only if ``same``: the texts are equal."""
    both = F.size(F.array_intersect(a, b))
    merged = F.size(a) + F.size(b) - both
    return F.when(merged == 0, same.cast("double")).otherwise(both / merged)


def containment(a: Column, b: Column) -> Column:
    """Share of ``a``'s sketch that ``b`` holds; null where ``a`` keeps nothing."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column) -> Column:
    """Sketch of both texts together."""
    return F.sort_array(F.array_union(a, b))


def _constants(values: list[int], kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _bounds(df: DataFrame, key: str, count: int) -> list[int]:
    """Inner bounds of about equally full ranges of ``key``: fewer than ``count`` numbers, however large the table."""
    row = df.agg(F.percentile_approx(key, [i / count for i in range(1, count)], 100 * count).alias("b")).first()
    return sorted({int(x) for x in (row.b or [])})


def _place(bounds: list[int], key: Column) -> Column:
    """Number of bounds at or below the key, by halving steps over one constant array."""
    if not bounds:
        return F.lit(0)
    held, most = _constants(bounds, "bigint"), len(bounds)
    top = most.bit_length() - 1
    steps = _constants([1 << i for i in range(top, -1, -1)], "int")

    def step(at: Column, s: Column) -> Column:
        inside = (at + s <= most) & (F.element_at(held, F.least(at + s, F.lit(most))) <= key)
        return F.when(inside, at + s).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def edited_fingerprints(docs: DataFrame, fraction: float = FRACTION, n: int = 5, buckets: int | None = None) -> DataFrame:
    """Sketch every text and the text it becomes when its tail is replaced by its neighbour's head.

    The last floor(n_chars / 2) code points of a text give way to the first as many (or all) of the
    next document in descending doc_id; after the last comes the first. Equal ids are ordered by
    text. A null id counts as the smallest, a null text as empty; an empty table gives no rows; other
    columns are ignored. One exchange of the texts: rows go to ranges of ids, and the first row of
    each range is also sent, as a guest, to the range before it.

    Returns doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch, and as booleans
    same_edited and same_next, whether the edited and the next text equal this one.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)))
    bounds = _bounds(rows, "key", buckets or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = rows.withColumn("range", _place(bounds, F.col("key")))
    # One row for each range, of which there are fewer than `buckets`.
    heads = sorted(((r.range, r.head) for r in rows.groupBy("range").agg(F.max("key").alias("head")).collect()), reverse=True)
    if not heads:
        heads = [(0, 0)]
    size = heads[0][0] + 1
    first, before = [0] * size, [0] * size
    for at, (place, head) in enumerate(heads):
        first[place], before[place] = head, heads[at - 1][0]
    here = F.col("range") + 1
    leads = F.element_at(_constants(first, "bigint"), here) == F.col("key")
    own = F.struct(F.col("range").alias("to"), F.lit(False).alias("guest"))
    visit = F.struct(F.element_at(_constants(before, "int"), here).alias("to"), F.lit(True).alias("guest"))
    sent = rows.withColumn("stop", F.explode(F.when(leads, F.array(own, visit)).otherwise(F.array(own))))
    sent = sent.select("doc_id", "text", "key", "stop.to", "stop.guest").repartition("to")
    sent = with_sketch(sent, "text", "sketch", fraction, n).withColumn("n_chars", F.length("text").cast("bigint"))
    order = Window.partitionBy("to").orderBy("guest", F.desc("key"), "text")
    near = sent.withColumn("after", F.lead(F.struct("text", "sketch")).over(order)).filter(~F.col("guest"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    head = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    near = near.select("doc_id", "n_chars", "sketch", F.col("after.sketch").alias("next_sketch"), (F.col("text") == F.col("after.text")).alias("same_next"), "text", F.concat(head, F.substring(F.col("after.text"), F.lit(1), half)).alias("edited"))
    near = with_sketch(near, "edited", "edited_sketch", fraction, n)
    return near.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch", "next_sketch", (F.col("text") == F.col("edited")).alias("same_edited"), "same_next")
