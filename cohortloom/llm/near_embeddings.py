"""Near-duplicate vectors by randomised-rotation binary codes.

Every unit vector is rotated at random; its code is the signs of the result, scaled to unit length, and
its stored correction factor is the inner product f of code and rotated vector. For another unit vector y,
<code, Py> / f estimates <x, y> without bias, and with c = <x, y> the error is at most
sqrt(1 - f^2) / f * sqrt(1 - c^2). So a pair of cosine t or more has an estimate of at least
t - sqrt(1 - f^2) / f * sqrt(1 - t^2): the bound decides which pairs are computed exactly, and none is lost.

All pairs are estimated, block by block. The work grows with the square of the number of different vectors,
as it must for a lossless answer on vectors that do not cluster; a task holds two blocks whatever the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import components, kept
from cohortloom.session import parallelism

LEAST = 0.9
BLOCK = 4096
TILE = 1024
SLACK = 1e-4
"""Allowance for single precision in the estimate."""


def rotation(size: int, seed: int = 20240229) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits (packed) and correction factors of unit rows."""
    turned = unit @ turn.T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def signs(codes: np.ndarray, size: int) -> np.ndarray:
    return (np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))


def lowest_estimate(factor: np.ndarray, least: float) -> np.ndarray:
    """No pair of cosine ``least`` or more has a lower estimate."""
    f = np.clip(factor, 1e-9, 1)
    return least - np.sqrt(1 - f * f) / f * np.sqrt(max(0.0, 1 - least * least)) - SLACK


def candidates(codes: np.ndarray, factor: np.ndarray, others: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that the bound does not exclude, tile by tile. others: rotated unit rows, single precision."""
    limit = (lowest_estimate(factor, least) * np.clip(factor, 1e-9, 1)).astype(np.float32)
    for lo in range(0, len(codes), TILE):
        part = signs(codes[lo : lo + TILE], others.shape[1])
        for at in range(0, len(others), TILE):
            x, y = np.nonzero(part @ others[at : at + TILE].T >= limit[lo : lo + TILE, None])
            yield x + lo, y + at


def _block_links(turn: np.ndarray, least: float):
    def links(table: pa.Table) -> pa.Table:
        """Of one block pair: weighted link counts by vector, and a spanning forest of the links."""
        size = turn.shape[0]
        node = table.column("node").to_numpy()
        copies = table.column("copies").to_numpy()
        home = table.column("block").to_numpy()
        low, high = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        values = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(-1, size)
        norms = np.sqrt((values * values).sum(axis=1))
        unit = values / norms[:, None]
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(node), -1)
        factor = table.column("factor").to_numpy()
        left, right = np.flatnonzero(home == low), np.flatnonzero(home == high)
        turned = (unit[right] @ turn.T).astype(np.float32)
        count, root = np.zeros(len(node), np.int64), np.arange(len(node))
        edges: list[tuple[int, int]] = []

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for x, y in candidates(codes[left], factor[left], turned, least):
            x, y = left[x], right[y]
            if low == high:
                x, y = x[x < y], y[x < y]
            for lo in range(0, len(x), 100_000):
                a, b = x[lo : lo + 100_000], y[lo : lo + 100_000]
                cosine = np.einsum("ij,ij->i", values[a], values[b]) / (norms[a] * norms[b])
                a, b = a[cosine >= least], b[cosine >= least]
                np.add.at(count, a, copies[b])
                np.add.at(count, b, copies[a])
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    p, q = top(i), top(j)
                    if p != q:
                        root[p] = q
                        edges.append((i, j))
        some = np.flatnonzero(count)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table(
            {
                "node": pa.array(np.r_[node[some], node[ends[:, 0]]], pa.int64()),
                "links": pa.array(np.r_[count[some], np.zeros(len(ends), np.int64)], pa.int64()),
                "other": pa.array([None] * len(some) + node[ends[:, 1]].tolist(), pa.int64()),
            }
        )

    return links


def near_vectors(vectors: DataFrame, least: float = LEAST, id_column: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Links between vectors of cosine ``least`` or more, in double precision.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id that links reach)
    and kept (vec_id = component_id), one row for each row. Vectors that are null, zero, or hold a null or
    a value that is not finite, and those without an id, link with nothing; vectors of different lengths do
    not link. Equal vectors are compared once. Other columns are ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    value = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), value.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    # Adding zero makes -0.0 and 0.0 one value.
    rows = rows.withColumn("node", F.when(good, F.xxhash64(F.size("v"), F.transform("v", lambda x: x + F.lit(0.0)))))
    classes = kept(rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("v").alias("v")), "classes")
    shapes = sorted((r.size, r.n) for r in classes.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect())
    counts = None
    for size, n in shapes:
        found = _links(classes.filter(F.size("v") == size), size, n, least, block)
        counts = found if counts is None else counts.union(found)
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts = kept(counts, "counts")
    edges = counts.filter("other is not null").select("node", "other")
    labels = components(edges, "node", "other")
    links = counts.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "copies", "first").join(labels, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    facts = named.select("node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    whole = rows.select("vec_id", "node").join(facts, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return whole.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _links(classes: DataFrame, size: int, n: int, least: float, block: int) -> DataFrame:
    turn = rotation(size)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            values = values / np.abs(values).max(axis=1)[:, None]
            bits, factor = encode(values / np.linalg.norm(values, axis=1)[:, None], turn)
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "copies": batch.column("copies"), "vector": pa.array([x.tobytes() for x in values], pa.binary()), "code": pa.array([x.tobytes() for x in bits], pa.binary()), "factor": pa.array(factor)})

    coded = classes.select("node", "copies", "v").mapInArrow(code, "node long, copies long, vector binary, code binary, factor double")
    # Enough block pairs for all tasks, and never more than two blocks in one.
    blocks = max(-(-n // block), min(-(-n // 512), int(np.ceil(np.sqrt(2 * parallelism(classes))))))
    placed = coded.withColumn("block", F.pmod("node", F.lit(blocks)))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    sent = sent.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    return sent.groupBy("lo", "hi").applyInArrow(_block_links(turn, least), "node long, links long, other long")
