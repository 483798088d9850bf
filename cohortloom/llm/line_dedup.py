"""Line deduplication by a log-template tree.

A line's leaf is its token count and its first tokens, after tokens with digits have become variable
fields. Lines of one leaf that agree in most positions share a template; positions that differ become
fields too. A template that recurs in several documents stays only in the first of them. A line of fewer
than LEAST_TOKENS tokens has a leaf of its own, and must recur in more documents.

Lines that agree are linked, and a template is what links reach. So templates depend neither on the order
of lines nor on how a large leaf is dealt out to tasks.

Equal lines are counted before anything else, so a line in a third of all documents is one row of its
leaf. Only lines of leaves with several different lines are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from cohortloom.llm.common import components, kept

DEPTH = 4
"""Leading tokens of a leaf."""
LEAST_TOKENS = 5
"""Shorter lines also recur by chance: for them SHORT_DOCS holds instead of LEAST_DOCS."""
LEAST_DOCS = 2
"""Documents from which on a template recurs, whatever the length of its lines or the size of the corpus."""
SHORT_DOCS = 10
SIMILAR = 0.8
"""Share of positions that must agree for two lines to be linked; a field agrees with a field."""
LEAF_LINES = 4000
"""Different lines of a leaf that a task compares; of larger leaves, each pair of blocks is a task. Results do not depend on it."""
FIELD = "<*>"
VARIABLE = re.compile(r"\S*\d\S*")
DIGIT = re.compile(r"\d")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(line: str, depth: int = DEPTH, least: int = LEAST_TOKENS) -> tuple[int, int, list[str]] | None:
    """Leaf, line hash and tokens of a line, with fields for tokens that hold a digit; None for a blank line.

    The leaf of a line of fewer than ``least`` tokens is made of all of them and is odd, other leaves are
    even. A short line of nothing but fields keeps its digits: numbers alone are no template.
    """
    tokens = (VARIABLE.sub(FIELD, line) if DIGIT.search(line) else line).split()
    if not tokens:
        return None
    short = len(tokens) < least
    if short and all(t == FIELD for t in tokens):
        tokens = line.split()
    leaf = _hash(f"{len(tokens)} " + " ".join(tokens if short else tokens[:depth]))
    return leaf & ~1 | short, _hash(" ".join(tokens)), tokens


def _lines(depth: int, least: int, wanted: bool = False):
    """Different lines of each document; with ``wanted`` only those of the third column, with their tokens."""
    names = ["doc_id", "leaf", "line", *(["tokens"] if wanted else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), *([pa.string()] if wanted else [])]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            asked = batch.column(2).to_pylist() if wanted else [None] * batch.num_rows
            for doc, text, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), asked, strict=True):
                seen, some = set(), set(some or ())
                for line in (text or "").split("\n"):
                    found = parse(line, depth, least)
                    if found and found[1] not in seen and (not wanted or found[1] in some):
                        seen.add(found[1])
                        row = (doc, found[0], found[1], " ".join(found[2]))
                        for c, v in zip(columns, row, strict=False):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return lines


def _linked(table: pa.Table, similar: float) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Order of rows by their hash, the first row in that order that links reach from each, and the rows' tokens."""
    order = np.argsort(table.column("line").to_numpy())
    lines = [table.column("tokens")[int(i)].as_py().split(" ") for i in order]
    number: dict[str, int] = {}
    codes = np.array([[number.setdefault(t, len(number)) for t in x] for x in lines], np.int32)
    of = np.arange(len(codes))
    for i in range(1, len(codes)):
        near = np.unique(of[:i][(codes[:i] == codes[i]).mean(axis=1) >= similar])
        if len(near):
            of[i] = near[0]
            if len(near) > 1:
                of[: i + 1][np.isin(of[: i + 1], near)] = near[0]
    return order, of, lines


def _grow(similar: float):
    def grow(table: pa.Table) -> pa.Table:
        """Templates of all lines of one leaf: the smallest hash of a linked line, and fields where lines differ."""
        order, of, lines = _linked(table, similar)
        text: dict[int, list[str]] = {}
        for t, words in zip(of.tolist(), lines, strict=True):
            text[t] = [a if a == b else FIELD for a, b in zip(text[t], words, strict=True)] if t in text else words
        line = table.column("line").to_numpy()[order]
        return pa.table({"leaf": table.column("leaf").take(order), "line": pa.array(line), "template": pa.array(line[of]), "pattern": pa.array([" ".join(text[t]) for t in of.tolist()], pa.string())})

    return grow


def _link(similar: float):
    def link(table: pa.Table) -> pa.Table:
        """Lines of two blocks of a leaf that are linked to one with a smaller hash."""
        order, of, _ = _linked(table, similar)
        line = table.column("line").to_numpy()[order]
        moved = np.flatnonzero(of != np.arange(len(of)))
        return pa.table({"leaf": table.column("leaf").take(order[moved]), "line": pa.array(line[moved]), "to": pa.array(line[of[moved]])})

    return link


GROWN = "leaf long, line long, template long, pattern string"


def _met(rows: DataFrame, similar: float) -> DataFrame:
    """``GROWN`` for large leaves (leaf, line, different, tokens), the same as ``_grow`` over all lines of a leaf.

    Each pair of blocks of a leaf is a task, so any two lines meet; work is quadratic in the lines of a leaf.
    """
    blocks = F.ceil(2 * F.col("different") / LEAF_LINES).cast("int")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("line"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).filter("block <> other")
    pairs = dealt.select("leaf", "line", "tokens", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    links = kept(pairs.groupBy("leaf", "a", "b").applyInArrow(_link(similar), "leaf long, line long, to long"), "links")
    roots = components(links, "line", "to")
    of = kept(rows.join(roots, rows.line == roots.node, "left").select("leaf", "line", "root", "tokens"), "roots")
    words = of.filter("root is not null").select("leaf", "root", F.posexplode(F.split("tokens", " ")).alias("pos", "word"))
    words = words.groupBy("leaf", "root", "pos").agg(F.min("word").alias("low"), F.max("word").alias("high"))
    words = words.withColumn("word", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(FIELD))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    merged = words.groupBy("leaf", "root").agg(text.alias("pattern"))
    return of.join(merged, ["leaf", "root"], "left").select("leaf", "line", F.coalesce("root", "line").alias("template"), F.coalesce("pattern", "tokens").alias("pattern"))


def line_templates(docs: DataFrame, depth: int = DEPTH, least: int = LEAST_TOKENS, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Lines of documents (doc_id, leaf, line), and a template for each different line of a leaf (leaf, line, template).

    Rows without an id are left out.
    """
    rows = docs.filter("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    lines = kept(rows.mapInArrow(_lines(depth, least), "doc_id long, leaf long, line long"), "lines")
    distinct = kept(lines.groupBy("leaf", "line").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs")), "distinct")
    leaves = distinct.groupBy("leaf").agg(F.count("*").alias("different"), F.sum("docs").alias("total"))
    several = leaves.filter("different > 1").select("leaf", "different")
    asked = distinct.join(several, "leaf").groupBy(F.col("first").alias("doc_id")).agg(F.collect_set("line").alias("wanted"))
    texts = rows.join(asked, "doc_id").select("doc_id", "text", "wanted")
    again = texts.mapInArrow(_lines(depth, least, True), "doc_id long, leaf long, line long, tokens string")
    held = again.dropDuplicates(["leaf", "line"]).join(several, "leaf").select("leaf", "line", "different", "tokens")
    large = F.col("different") > LEAF_LINES
    some = not several.filter(large).isEmpty()
    held = kept(held, "held") if some else held
    grown = held.filter(~large).groupBy("leaf").applyInArrow(_grow(similar), GROWN)
    if some:
        grown = grown.union(_met(held.filter(large), similar))
    single = distinct.join(leaves.filter("different = 1"), "leaf").select("leaf", "line", F.col("line").alias("template"), F.lit(None).cast("string").alias("pattern"))
    return lines, single.union(grown)


def dedup_lines(docs: DataFrame, depth: int = DEPTH, least: int = LEAST_TOKENS, similar: float = SIMILAR, least_docs: int = LEAST_DOCS, short_docs: int = SHORT_DOCS) -> DataFrame:
    """``docs`` with text cut to the lines that stay, and n_lines, n_dropped.

    Lines end at a line feed. A line is dropped if its template occurs in at least ``least_docs``
    documents and this is not the one of them with the smallest id; repetition within a document does
    not count. Lines of fewer than ``least`` tokens need ``short_docs`` documents; blank lines stay. A null text stays null with no lines. Rows
    without an id stay as they are; rows that repeat an id are one document. Columns named n_lines or
    n_dropped are replaced, all others stay.
    """
    lines, templates = line_templates(docs, depth, least, similar)
    placed = kept(lines.join(templates.select("leaf", "line", "template"), ["leaf", "line"]).select("doc_id", "leaf", "line", "template"), "placed")
    recurring = placed.groupBy("leaf", "template").agg(F.min("doc_id").alias("first"), F.countDistinct("doc_id").alias("docs")).filter(F.col("docs") >= F.when(F.col("leaf").bitwiseAND(1) == 1, short_docs).otherwise(least_docs))
    drop = placed.join(recurring.select("leaf", "template", "first"), ["leaf", "template"]).filter("doc_id <> first")
    lists = drop.groupBy("doc_id").agg(F.collect_set("line").alias("__drop")).withColumnRenamed("doc_id", "__doc")
    base = docs.drop("n_lines", "n_dropped")
    joined = base.join(lists, base.doc_id.cast("long") == lists["__doc"], "left").drop("__doc")
    at, schema = base.columns.index("text"), base.schema

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lines_, dropped = [], [], []
            for t, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                own = t.split("\n") if t is not None else []
                stay = own
                if gone:
                    gone = set(gone)
                    stay = [x for x in own if not ((p := parse(x, depth, least)) and p[1] in gone)]
                text.append(None if t is None else "\n".join(stay))
                lines_.append(len(own))
                dropped.append(len(own) - len(stay))
            columns = batch.columns[:-1]
            columns[at] = pa.array(text, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64())], names=[*batch.schema.names[:-1], "n_lines", "n_dropped"])

    return joined.mapInArrow(strip, StructType([*schema.fields]).add("n_lines", LongType()).add("n_dropped", LongType()))
