"""Words, shingles, tables kept in the shared folder, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import scratch_path

SPACE = "[\\x20\\x09-\\x0D]+"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back, so that later jobs never repeat its work."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_at = path
    return table


def discard(*tables: DataFrame, shuffles: bool = False) -> None:
    """Removes the files of ``kept`` tables that nothing unfinished reads.

    Spark removes shuffle files once the driver has collected the plans that made them as garbage, by itself each half
    hour; with ``shuffles`` it is asked to now, after a large step, so that steps do not pile up their shuffles on the
    executors' disks.
    """
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables and shuffles:
        sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Asks Spark to remove the shuffles of plans that nothing refers to any more."""
    spark._jvm.System.gc()


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space; no words for a null or blank text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE), "")


def shingle_hashes(found: Column, n: int = 5) -> Column:
    """64-bit hash of every run of ``n`` words; fewer words make one shingle, no words none.

    ``found`` must be a column that is already computed: it is read once for each shingle.
    """
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(found) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(found, i, n)))
    return F.when(F.size(found) == 0, F.array().cast("array<bigint>")).otherwise(runs)


FACTOR = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of many texts at once, straight from their UTF-8 bytes.

    Words lie between ASCII white space, with A-Z lower-cased. A word's hash is the difference of two prefix
    sums of its text's bytes times powers of an odd factor. Fewer than ``n`` words are one shingle.
    """

    def __init__(self, n: int = 5):
        self.n = n
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < size:
            up, down = np.full(size, FACTOR, np.uint64), np.full(size, pow(FACTOR, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.power, self.inverse = np.cumprod(up), np.cumprod(down)
        return self.power[:size], self.inverse[:size]

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        base = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        low = np.where((base >= 65) & (base <= 90), base + np.uint8(32), base)
        solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
        edge = np.zeros(len(base) + 1, bool)
        edge[offsets] = True
        before = np.r_[False, solid[:-1]] if len(base) else solid
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.r_[solid[1:], False] if len(base) else solid
        stop = np.flatnonzero(solid & (~after | edge[1:])) + 1
        power, inverse = self._powers(len(base) + 1)
        sums = np.zeros(len(base) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        word = _mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
        first = np.searchsorted(start, offsets)
        runs = np.full(max(0, len(word) - self.n + 1), self.n, np.uint64)
        for k in range(self.n):
            runs = _mix((runs ^ word[k : k + len(runs)]) * np.uint64(FACTOR))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= self.n:
                yield np.unique(runs[a : b - self.n + 1]).view(np.int64)
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    h = _mix((h ^ word[k : k + 1]) * np.uint64(FACTOR))
                yield h.view(np.int64)
            else:
                yield np.zeros(0, np.int64)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """One set for each text; a null text has an empty one. Unsigned order, seen as signed numbers."""
        column = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
        if not len(column):
            return
        _, at, raw = column.buffers()
        offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        lo = 0
        with np.errstate(over="ignore"):
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES)))
                hi = min(hi, len(column))
                yield from self._slice(data, offsets[lo : hi + 1])
                lo = hi


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every end of an edge; root is the smallest node that links reach.

    Smallest labels spread along the edges and then jump to their own label, so long chains
    take a number of rounds that grows with the logarithm of their length. Only labels move;
    each round is written to the shared folder as a table, which
    has its real size (a checkpoint keeps the planner's guess, and guesses multiply from round to round).
    Joins are merges, as every broadcast would hold pages of the driver's memory until the end.
    """
    both = kept(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).filter("u <> v").distinct(), "edges")
    labels = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.hint("merge"), both.v == labels.node).groupBy("u").agg(F.min("root").alias("m"))
        step = labels.join(near.hint("merge"), labels.node == near.u).select("node", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        jump = step.select(F.col("node").alias("j"), F.col("root").alias("far"))
        moved = kept(step.join(jump.hint("merge"), step.root == jump.j).select("node", F.least("root", "far").alias("root"), "old"), "labels")
        labels, old = moved.select("node", "root"), labels
        discard(old)
        labels.kept_at = moved.kept_at
        if moved.filter("root <> old").isEmpty():
            discard(both)
            return labels
