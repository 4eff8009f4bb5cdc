"""SimHash near-duplicates by a hierarchical index in Gray order.

A document's fingerprint has a bit for each bit that more than half of its word shingles' hashes
have (XXH64 of the shingle's bytes; repeated shingles vote each time). Distinct fingerprints are
ordered by their Gray rank, in which neighbours tend to differ in one bit, and numbered by range
partitions; every ``GROUP`` of them are a leaf of the index, every ``FANOUT`` nodes a node above. A
node keeps the bit pattern that all fingerprints below it share, with the mask of the shared
bits. Pairs of nodes are followed from the top, level by level: the bits in which their shared
patterns differ count, and a pair that has more than ``radius`` is dropped with all that lies
below it. Of the leaves that remain as pairs, all fingerprints are compared.

Every level's pairs are a table and every step a join on node numbers, of which each has
``FANOUT`` children. A fingerprint has at most 2080 others within two bits, so links are bounded
however many documents are alike; equal fingerprints are one. Inside a pair of leaves only links
that span its components are handed on.

Defined results: texts without words, empty and null ones have the fingerprint 0 and are linked
like any other; a text of fewer words than a shingle's is one shingle; repeated rows and equal ids
are rows of their own, a component is told by its least id (null where it has none); an empty table
gives an empty result; columns other than doc_id and text are unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.graph import connected_components
from eventloom.operators.numbering import number_in_order
from eventloom.operators.resident import Resident
from eventloom.operators.skew import join_facts
from eventloom.session import Scratch

WORDS, SEED, RADIUS = 3, 42, 2
GROUP, FANOUT, TOP = 64, 16, 64
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SLICE = 1 << 16  # shingles whose bits are counted at once


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every run of ``words`` words, joined by spaces, in order; of fewer words, of all of them."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _SLICE):
        raw = hashes[k : k + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = WORDS, key: str = "doc_id") -> DataFrame:
    """(key, fp) for each row, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([majority(shingle_hashes(t.as_py(), words)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[key, "fp"])

    return documents.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(run, f"{key} long, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern among all in Gray order, as a signed number that sorts alike."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.call_function("shiftrightunsigned", rank, F.lit(shift)))
    return rank.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _apart(x: str, y: str) -> Column:
    """How many bits that all fingerprints of a node share differ from those that all of another share."""
    mixed = F.col(f"low{x}").bitwiseXOR(F.col(f"high{x}")).bitwiseOR(F.col(f"low{y}").bitwiseXOR(F.col(f"high{y}")))
    return F.bit_count(F.col(f"low{x}").bitwiseXOR(F.col(f"low{y}")).bitwiseAND(F.bitwise_not(mixed)))


def index(prints: DataFrame, scratch: Scratch, group: int = GROUP, fanout: int = FANOUT, top: int = TOP) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves (node, prints) and the levels of the index over distinct ``prints`` (fp), lowest first.

    A level has (node, up, low, high): the shared pattern is ``low`` where ``low`` and ``high``, all bits
    that every fingerprint and that any has, agree. The last level has ``top`` nodes at most.
    """
    numbered = number_in_order(prints.select("fp", gray_rank(F.col("fp")).alias("rank")), [F.col("rank")], "n", "gray")
    leaf = F.floor((F.col("n") - 1) / group).cast("long")
    leaves = scratch.save(numbered.groupBy(leaf.alias("node")).agg(F.collect_list("fp").alias("prints"), F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high")), "leaves")
    up = F.floor(F.col("node") / fanout).cast("long").alias("up")
    levels = [leaves.select("node", up, "low", "high")]
    while levels[-1].count() > top:
        nodes = levels[-1].groupBy(F.col("up").alias("node")).agg(F.bit_and("low").alias("low"), F.bit_or("high").alias("high"))
        levels.append(scratch.save(nodes.select("node", up, "low", "high"), f"level{len(levels)}"))
    return leaves, levels


def near_nodes(levels: list[DataFrame], scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(x, y), x <= y: leaves whose shared patterns, and those of all nodes above them, differ in ``radius`` bits at most."""
    side = lambda level, n: level.select(F.col("node").alias(n), F.col("up").alias(f"up{n}"), F.col("low").alias(f"low{n}"), F.col("high").alias(f"high{n}"))
    near = F.col("x") <= F.col("y")
    pairs = None
    for k in range(len(levels) - 1, -1, -1):
        x, y = side(levels[k], "x"), side(levels[k], "y")
        if pairs is None:  # the top has a bounded number of nodes
            met = F.broadcast(x).join(y, near)
        else:
            met = pairs.select(F.col("x").alias("upx"), F.col("y").alias("upy")).join(x, "upx").join(y, "upy").where(near)
        pairs = scratch.save(met.where(_apart("x", "y") <= radius).select("x", "y"), f"pairs{k}")
    return pairs


def _spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links (a, b) join parts that the links before them left apart."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up]
        return v

    kept = []
    for k, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = find(p), find(q)
        if p != q:
            parent[p] = q
            kept.append(k)
    return kept


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for p, q in zip(batch.column(0), batch.column(1), strict=True):
                x, y = np.asarray(p.values).view(np.uint64), np.asarray(q.values).view(np.uint64)
                i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
                a, b = x[i], y[j]
                other = a != b
                a, b = a[other], b[other]
                kept = _spanning(a, b) if len(a) > 1 else list(range(len(a)))
                left.append(a[kept])
                right.append(b[kept])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side).view(np.int64)) for side in (left, right)], names=["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, group: int = GROUP, fanout: int = FANOUT, top: int = TOP) -> DataFrame:
    """(a, b) of distinct fingerprints (fp) within ``radius`` bits, enough of them to join all that are linked."""
    scratch = Scratch(prints.sparkSession, "gray-index")
    leaves, levels = index(prints, scratch, group, fanout, top)
    pairs = near_nodes(levels, scratch, radius)
    of = lambda n: leaves.select(F.col("node").alias(n), F.col("prints").alias(f"prints{n}"))
    met = pairs.join(of("x"), "x").join(of("y"), "y").select("printsx", "printsy")
    return scratch.save(met.mapInArrow(_compare(radius), "a long, b long"), "links")


def _parts(classes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """``classes`` (fp and more) with ``part``, the least fingerprint that links lead to."""
    found = connected_components(near_links(classes.select("fp"), radius), "simhash-components").toDF("fp", "part")
    return scratch.save(classes.join(found, "fp", "left").withColumn("part", F.coalesce("part", "fp")), "parts")


def simhash_classes(documents: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: the least id that links of ``radius`` bits at most lead to."""
    scratch = Scratch(documents.sparkSession, "simhash-classes")
    rows = scratch.save(fingerprints(documents, words), "rows")
    classes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("held")), "classes")
    known = _parts(classes, radius, scratch)
    heads = scratch.save(known.groupBy("part").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints")), "heads")
    facts = scratch.save(join_facts(known, heads, "part", "prints", "inner").select("fp", "held", "component_id"), "facts")
    out = join_facts(rows, facts, "fp", "held", "inner")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(documents: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Documents without near copies, all columns kept: of each component the row of the least id, of equal ids the first as read.

    A component without ids keeps its first row; texts without words all stay.
    """
    scratch, names = Scratch(documents.sparkSession, "simhash-kept"), documents.columns
    texts = Resident(documents.select("text", F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("others")), scratch, "texts")
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    ids = scratch.save(texts.table().where(worded).select("row", F.col("others.doc_id").cast("long").alias("doc_id")), "ids")
    rows = scratch.save(fingerprints(texts.table().where(worded), words, "row").join(ids, "row"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    known = _parts(scratch.save(rows.groupBy("fp").agg(first.alias("first")), "classes"), radius, scratch)
    heads = known.groupBy("part").agg(F.min("first").alias("first")).select("first.row")
    gone = scratch.save(rows.select("row").join(heads, "row", "left_anti"), "gone")
    kept = texts.save(texts.join(gone, "left_anti").select(*[F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in names]), scratch, "kept")
    texts.drop()
    return kept
