"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

1. A document's size is its number of words. The sources, by code point with null last, weigh ``WEIGHTS`` in turn and
   share the size of the corpus; a target stops at ``MOST`` times its source's size and the excess is shared again.
2. Every document of a source is taken ``floor(target / source size)`` times whole. What then lacks is a sample.
3. A document's rank is the odds of a random number, a hash of its id and text, divided by the odds of its inclusion
   (the lacking share, times its ``preference`` if one is given). Ranks are followed until the next document would pass
   the target; the gap is filled ``REFILLS`` times by the documents that still fit, in the same order, and at last by
   one more document if that brings the source nearer. The size drawn is thus fixed, up to half of one document.

Ranks lie in buckets: totals by bucket find the one in which a target is met, finer buckets in it come next, and only
the rows of one fine bucket are ordered. No task sees a source as a whole.

Null text counts as empty and a null source as a source. Repeated rows are documents of their own and share one rank;
if the target is met among them, as many as fit are taken. Empty and blank texts have size 0 and are taken 0 words;
a source of such texts has target 0. An empty table gives no rows. Other columns are carried on request, under names of
their own, and may be called anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.llm.common import kept

WEIGHTS = (5, 2, 1)
MOST = 3
REFILLS = 2
COARSE, FINE = 1 << 12, 1 << 24
"""Buckets of ranks: all rows are counted in coarse ones, those of one coarse bucket in fine ones."""
SALTS = 1024
BITS = 52


def size_of(text: Column) -> Column:
    """Number of words; none for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, text: Column) -> Column:
    """A number in (0, 1) from the head of an MD5 of a document's id and text."""
    digest = F.md5(F.concat(key, F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long") + 0.5) / float(1 << BITS)


def _weighted(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Weights by position among the sources, counted range by range."""
    order = F.col("source").asc_nulls_last()
    dealt = kept(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "sources")
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ahead = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    cycle = F.array(*map(F.lit, weights))
    return kept(dealt.join(ahead, "range").select("source", "source_size", F.get(cycle, (place % len(weights)).cast("int")).cast("long").alias("weight")), "sources")


def _targets(sources: DataFrame, most: int) -> DataFrame:
    """(source, source_size, target, whole, gap): shares of the total, full sources left out round by round."""
    exact = "decimal(38,0)"
    room = F.col("source_size").cast(exact) * F.lit(most)
    total, all_weights = sources.agg(F.coalesce(F.sum(F.col("source_size").cast(exact)), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, weights = int(total), int(all_weights)
    while True:
        full = room * F.lit(weights).cast(exact) < F.lit(left).cast(exact) * F.col("weight").cast(exact)
        held, open_weights = sources.agg(F.coalesce(F.sum(F.when(full, room)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if (int(total) - int(held), int(open_weights)) == (left, weights):
            break
        left, weights = int(total) - int(held), int(open_weights)
    share = (F.lit(left).cast(exact) * F.col("weight").cast(exact)).cast("double") / F.lit(float(max(weights, 1)))
    target = F.when(full, room.cast("double")).otherwise(share)
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).cast("long")
    sized = sources.select("source", "source_size", target.alias("target")).withColumn("whole", whole)
    return kept(sized.withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size")), "targets")


PICKS = "array<struct<gap:double,t:double,key:string,size:bigint,taken:bigint,over:bigint>>"


def _passed(p: Column) -> Column:
    """Whether a pick takes all rows of this rank."""
    return (F.col("size") <= p["gap"]) & (F.struct("t", "key", "size") < F.struct(p["t"].alias("t"), p["key"].alias("key"), p["size"].alias("size")))


def _met(p: Column) -> Column:
    return (F.col("t") == p["t"]) & (F.col("key") == p["key"]) & (F.col("size") == p["size"])


def _first_over(sums: DataFrame, *bucket: str) -> DataFrame:
    """The first bucket of each source whose running total passes the gap, and the total before it."""
    here = Window.partitionBy("source").orderBy(*bucket)
    run = sums.withColumn("upto", F.sum("words").over(here) + F.col("before"))
    found = run.filter(F.col("upto") > F.col("gap")).groupBy("source", "gap").agg(F.min_by(F.struct(*bucket, (F.col("upto") - F.col("words")).alias("before"), *(c for c in ("size", "n") if c in sums.columns and c not in bucket)), F.struct(*bucket)).alias("at"))
    return found.select("source", "gap", "at.*")


def _draw(rows: DataFrame) -> DataFrame:
    """One pick for each source: how far the order of ranks goes until the next row passes the gap.

    ``rows`` holds what fits. A source whose rows all fit is taken whole, with a rank above all others.
    """
    key = ["source", "gap"]
    coarse = kept(rows.groupBy(*key, F.floor(F.col("t") * COARSE).alias("coarse")).agg(F.sum("size").alias("words")).withColumn("before", F.lit(0).cast("long")), "coarse")
    at = kept(_first_over(coarse, "coarse").withColumnRenamed("gap", "same"), "coarse-cut")
    inside = rows.join(at, rows.source.eqNullSafe(at.source) & (F.floor(rows.t * COARSE) == at.coarse)).select(rows["*"], "before")
    fine = inside.groupBy(*key, "before", F.floor(F.col("t") * FINE).alias("fine")).agg(F.sum("size").alias("words"))
    low = kept(_first_over(fine, "fine").withColumnRenamed("gap", "same"), "fine-cut")
    last = rows.join(low, rows.source.eqNullSafe(low.source) & (F.floor(rows.t * FINE) == low.fine)).select(rows["*"], "before")
    single = last.groupBy(*key, "before", "t", "key", "size").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    cut = _first_over(single, "t", "key", "size")
    fits = F.floor((F.col("gap") - F.col("before")) / F.col("size")).cast("long")
    part = F.struct("gap", "t", "key", "size", fits.alias("taken"), (F.col("n") - fits).alias("over"))
    whole = coarse.groupBy(*key).agg(F.sum("words").alias("words")).filter(F.col("words") <= F.col("gap"))
    every = F.struct("gap", F.lit(2.0).alias("t"), F.lit("").alias("key"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("over"))
    drawn = cut.select("source", part.alias("pick"), (F.col("before") + fits * F.col("size")).alias("words"))
    return kept(drawn.unionByName(whole.select("source", every.alias("pick"), "words")), "picks")


def mix(docs: DataFrame, carry: Sequence[str] = ("doc_id",), weights: Sequence[int] = WEIGHTS, most: int = MOST, preference: Column | None = None) -> DataFrame:
    """``carry`` as the struct ``row``, with size, source_size, target, copies and taken (``copies * size``).

    ``preference`` is a positive number by which the inclusion odds of a document are multiplied.
    """
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    liked = F.lit(1.0) if preference is None else F.coalesce(preference.cast("double"), F.lit(1.0))
    sized = docs.select(F.struct(*carry).alias("row"), key.alias("key"), source.alias("source"), size_of(text).alias("size"), uniform(key, text).alias("u"), liked.alias("liked"))
    sized = kept(sized.withColumn("place", F.monotonically_increasing_id()), "sized")
    sources = _targets(_weighted(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), most)

    def joined(table: DataFrame) -> DataFrame:
        named = table.withColumnRenamed("source", "name")
        both = sized.join(named, sized.source.eqNullSafe(named.name)).drop("name")
        share = F.try_divide(F.col("target") - F.col("whole") * F.col("source_size"), F.col("source_size"))
        odds = F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(share, 1 - share) * F.col("liked"))
        return both.withColumn("t", F.when((F.col("size") > 0) & (share > 0), odds / (1 + odds)))

    state = sources.withColumn("picks", F.array().cast(PICKS))
    for _ in range(1 + REFILLS):
        rows = joined(state).filter(F.col("t").isNotNull() & (F.col("size") <= F.col("gap")) & ~F.exists("picks", lambda p: _passed(p) | _met(p)))
        pick = _draw(rows.select("source", "size", "t", "key", "gap")).withColumnRenamed("source", "name")
        after = state.join(pick, state.source.eqNullSafe(pick.name), "left")
        grown = F.when(F.col("pick").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array("pick"))).cast(PICKS)
        state = kept(after.select("source", "source_size", "target", "whole", (F.col("gap") - F.coalesce("words", F.lit(0))).alias("gap"), grown.alias("picks")), "mixed")
    near = F.abs(F.col("size") - F.col("gap"))
    free = joined(state).filter(F.col("t").isNotNull() & (near < F.col("gap")) & ~F.exists("picks", lambda p: _passed(p) | (_met(p) & (p["over"] == 0))))
    best = free.groupBy("source").agg(F.min(F.struct(near.alias("far"), "size", "t", "key")).alias("best")).withColumnRenamed("source", "name")
    one = F.struct(F.lit(-1.0).alias("gap"), F.col("best.t").alias("t"), F.col("best.key").alias("key"), F.col("best.size").alias("size"), F.lit(1).cast("long").alias("taken"), F.lit(0).cast("long").alias("over"))
    after = state.join(best, state.source.eqNullSafe(best.name), "left")
    grown = F.when(F.col("best").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array(one))).cast(PICKS)
    state = kept(after.select("source", "source_size", "target", "whole", grown.alias("picks")), "mixed")

    room = F.aggregate("picks", F.lit(0).cast("long"), lambda a, p: a + F.when(_met(p), p["taken"]).otherwise(0))
    final = joined(state).withColumn("sure", F.coalesce(F.exists("picks", _passed), F.lit(False))).withColumn("room", F.coalesce(room, F.lit(0)))
    equal = ["source", "t", "key", "size"]
    tied = final.filter(~F.col("sure") & F.exists("picks", _met) & F.col("t").isNotNull())
    more = kept(tied.groupBy(*equal, "room").agg(F.count("*").alias("n")).filter(F.col("n") > F.col("room")).drop("n"), "ties")
    chosen = F.col("sure") | (F.col("room") > 0)
    if not more.isEmpty():
        salted = tied.select(*equal, "room", "place", F.pmod(F.xxhash64("place"), F.lit(SALTS)).alias("salt"))
        ahead = F.sum("n").over(Window.partitionBy(*equal).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
        counts = salted.groupBy(*equal, "salt").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(ahead, F.lit(0)))
        same = [salted[c].eqNullSafe(counts[c]) for c in [*equal, "salt"]]
        numbered = salted.join(counts, same).select("place", "room", (F.col("ahead") + F.row_number().over(Window.partitionBy(*(salted[c] for c in [*equal, "salt"])).orderBy("place"))).alias("number"))
        last = kept(numbered.filter(F.col("number") > F.col("room")).select("place", F.lit(True).alias("left_out")), "left-out")
        final = final.join(last, "place", "left")
        chosen = F.col("sure") | ((F.col("room") > 0) & F.col("left_out").isNull())
    copies = F.col("whole") + F.when(chosen, 1).otherwise(0)
    return final.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    rows = mix(docs, carry=docs.columns, **options).filter(F.col("copies") > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
