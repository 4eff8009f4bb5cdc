"""SimHash document fingerprints and search in permuted block tables.

Every distinct term (a pair of neighbouring words) votes with the signed bits of its 256-bit
hash, weighted by the square root of how often it occurs: the part of the votes that a passage
holds is then the part of the words that it holds, be it repetitive or not. Fingerprints within a chosen Hamming
radius are found exactly: bits are cut into blocks, of which some must agree, or differ in a
few bits only; tables are keyed by these blocks, and pairs that share a key in some table are
verified by their distance.

For each document's successor, rows are range-partitioned by doc_id, so that a task streams
neighbours; only the first and last text of each partition meet those of the next.

Defined results: null text is empty and has the fingerprint of no votes (all zero bits);
repeated ids follow each other in the order of their texts; a single document is its own
successor; null ids come first; an empty table gives an empty result; columns other than
doc_id and text are unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import bytehash
from eventloom.operators.skew import join_facts
from eventloom.session import Scratch

BITS, TERM_WORDS = 256, 2
RADIUS, BLOCKS = 15, 8  # of 256 bits; blocks of 32 bits, one bit of which may differ
_LANES = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 15


def _vote(votes: np.ndarray, terms: np.ndarray, text: np.ndarray, weight: int) -> None:
    """Add ``weight`` votes of each term, signed by its bits, to its text."""
    for s in range(0, len(terms), _SLICE):
        part, own = terms[s : s + _SLICE], text[s : s + _SLICE]
        raw = bytehash.mix(part[:, None] + _LANES[None, :]).view(np.uint8)
        packed = np.unpackbits(raw, axis=1).view(np.uint64)  # eight counters of a byte each in a word
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        seg = np.unique(np.concatenate([begins, np.arange(0, len(part), 255)]))
        ones = np.add.reduceat(packed, seg, axis=0).view(np.uint8).astype(np.int64)
        sizes = np.diff(np.concatenate([seg, [len(part)]]))
        np.add.at(votes, own[seg], weight * (2 * ones - sizes[:, None]))


def simhash(texts: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of BITS/8 bytes; at most 2**14 texts at once."""
    hashes, at = bytehash.words(texts)
    terms, text = bytehash.shingles(hashes, at, TERM_WORDS)
    tagged, times = np.unique((text.astype(np.uint64) << np.uint64(50)) | (terms >> np.uint64(14)), return_counts=True)
    weight = np.rint(4 * np.sqrt(times)).astype(np.int64)
    votes = np.zeros((len(texts), BITS), np.int64)
    for bit in range(int(weight.max(initial=0)).bit_length()):
        chosen = tagged[(weight >> bit) & 1 == 1]
        if len(chosen):
            _vote(votes, chosen & np.uint64((1 << 50) - 1), (chosen >> np.uint64(50)).astype(np.int64), 1 << bit)
    return np.packbits(votes > 0, axis=1)


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_EDGE = [("part", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string())]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _rows(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """Finished columns for documents with known successors."""
    raw = [t.encode() for t in texts]
    changed = [edit(a, b).encode() for a, b in zip(texts, following, strict=True)]
    n = len(raw)
    prints = simhash(raw + changed + [b.encode() for b in following])
    own, edited, after = prints[:n], prints[n : 2 * n], prints[2 * n :]
    values = [ids, [len(t) for t in texts], [hashlib.sha256(x).hexdigest() for x in changed], [x.tobytes().hex() for x in own], [x.tobytes().hex() for x in edited], _likeness(own, edited), _likeness(own, after)]
    return [pa.array(v, k) for v, (_, k) in zip(values, _FIELDS, strict=True)]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted neighbours; the last text waits in the partition's edge row."""
    names = [n for n, _ in _FIELDS + _EDGE]
    part, first, held = TaskContext.get().partitionId(), None, None
    for batch in bytehash.slices(batches):
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        if not ids:
            continue
        if first is None:
            first = texts[0]
        if held is not None:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = ids[-1], texts[-1]
        for a, b in bytehash.chunks([len(t) for t in texts[:-1]], 1 << 18):
            done = _rows_shared(ids[a:b], texts[a : b + 1])
            yield pa.RecordBatch.from_arrays(done + [pa.nulls(b - a, k) for _, k in _EDGE], names=names)
    if held is not None:
        empty = [pa.nulls(1, k) for _, k in _FIELDS[1:]]
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), *empty, pa.array([part], pa.int32()), pa.array([first]), pa.array([held[1]])], names=names)


def _rows_shared(ids: list, texts: list[str]) -> list[pa.Array]:
    """As _rows, for a run of neighbours with one more text at the end: each original is hashed once."""
    raw = [t.encode() for t in texts]
    n = len(ids)
    changed = [edit(texts[k], texts[k + 1]).encode() for k in range(n)]
    prints = simhash(raw + changed)
    own, after, edited = prints[:n], prints[1 : n + 1], prints[n + 1 :]
    values = [ids, [len(t) for t in texts[:n]], [hashlib.sha256(x).hexdigest() for x in changed], [x.tobytes().hex() for x in own], [x.tobytes().hex() for x in edited], _likeness(own, edited), _likeness(own, after)]
    return [pa.array(v, k) for v, (_, k) in zip(values, _FIELDS, strict=True)]


def _finish_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, following = (batch.column(k).to_pylist() for k in range(3))
        for k in range(len(ids)):
            yield pa.RecordBatch.from_arrays(_rows(ids[k : k + 1], texts[k : k + 1], following[k : k + 1]), names=[n for n, _ in _FIELDS])


def fingerprint_table(documents: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and both likenesses."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "fingerprints")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    found = scratch.save(ordered.mapInArrow(_chain, _SCHEMA + ", part int, first_text string, last_text string"), "rows")
    edges = found.where(F.col("part").isNotNull())
    parts = sorted(r["part"] for r in edges.select("part").collect())  # partition numbers, not rows
    follow = spark.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part int, next int")
    heads = edges.select(F.col("part").alias("next"), F.col("first_text").alias("following"))
    pairs = edges.select("doc_id", "last_text", "part").join(follow, "part").join(heads, "next").select("doc_id", "last_text", "following")
    return found.where(F.col("part").isNull()).drop("part", "first_text", "last_text").unionByName(pairs.mapInArrow(_finish_edges, _SCHEMA))


def near_fingerprints(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fingerprint, distance): all distinct fingerprints within ``radius`` bits of each distinct query.

    Both inputs have a column ``fingerprint`` of hex digits, which ``blocks`` must divide. Below
    as many bits as blocks, at least ``blocks - radius`` blocks agree, and each table is keyed by
    one choice of so many. Beyond, some block differs in ``radius // blocks`` bits at most: each
    table is keyed by one block, and a query asks for its block with every such change. Keys and
    fingerprints travel as numbers; a pair met in several tables is told by the first.
    """
    digits, flips = BITS // 4 // blocks, radius // blocks
    if digits * blocks * 4 != BITS or (flips and 64 % (4 * digits)):
        raise ValueError("blocks must divide the fingerprint, and words of 64 bits where bits are changed")
    choices = list(combinations(range(blocks), 1 if flips else blocks - radius))
    changes = [sum(1 << j for j in bits) for n in range(flips + 1) for bits in combinations(range(4 * digits), n)]

    def word(k: int):
        return F.conv(F.substring("fingerprint", 1 + 16 * k, 16), 16, -10).cast("long")

    def block(name: str, b: int) -> list:
        """The block's bits, from the words that hold them."""
        first, last = b * digits * 4, (b + 1) * digits * 4 - 1
        parts = []
        for k in range(first // 64, last // 64 + 1):
            low, high = max(first, 64 * k) - 64 * k, min(last, 64 * k + 63) - 64 * k
            value = F.call_function("shiftrightunsigned", F.col(f"{name}{k}"), F.lit(63 - high))
            parts.append(value if high - low == 63 else value.bitwiseAND(F.lit((1 << (high - low + 1)) - 1)))
        return parts

    def keyed(df: DataFrame, name: str, masks: list[int]) -> DataFrame:
        one = df.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct().select(*[word(k).alias(f"{name}{k}") for k in range(BITS // 64)])
        masks_ = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])

        def asked(t: int):
            head, *rest = (x for b in choices[t] for x in block(name, b))
            return F.transform(masks_, lambda m: F.xxhash64(F.lit(t), head.bitwiseXOR(m), *rest))

        keys = [asked(t) for t in range(len(choices))]
        tables = one.select("*", F.posexplode(F.array(*keys)).alias("table", "keys"))
        return tables.select(*one.columns, "table", F.explode("keys").alias("key"))

    # Each query asks by hundreds of keys, which its size before them doesn't tell: never broadcast.
    met = keyed(queries, "q", changes).hint("merge").join(keyed(prints, "p", [0]), ["table", "key"])
    distance = sum((F.bit_count(F.col(f"q{k}").bitwiseXOR(F.col(f"p{k}"))) for k in range(BITS // 64)), F.lit(0))
    apart = {b: sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(block("q", b), block("p", b), strict=True)), F.lit(0)) for b in range(blocks)}
    met = met.withColumn("distance", distance).where(F.col("distance") <= radius).withColumn("apart", F.array(*apart.values()))
    near = F.array(*[F.forall(F.array(*[F.lit(b) for b in chosen]), lambda b: F.get(F.col("apart"), b) <= flips) for chosen in choices])
    spelled = lambda name: F.concat(*[F.lpad(F.lower(F.hex(F.col(f"{name}{k}"))), 16, "0") for k in range(BITS // 64)])
    return met.where(F.array_position(near, True) == F.col("table") + 1).select(spelled("q").alias("query"), spelled("p").alias("fingerprint"), "distance")


def simhash_report(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The fingerprint table; for ids divisible by 50 also n_near, how many distinct fingerprints lie within the radius,
    its own included, and near_ids, the least doc_id of each, by distance and id."""
    table = fingerprint_table(documents)
    scratch = Scratch(documents.sparkSession, "simhash")
    table = scratch.save(table, "table")
    asked = table.where(F.col("doc_id") % 50 == 0)
    classes = scratch.save(table.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("held")), "classes")
    pairs = near_fingerprints(classes, asked, radius).join(classes.select("fingerprint", "rep"), "fingerprint")
    near = pairs.groupBy(F.col("query").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("distance", "rep"))).alias("near"))
    near = scratch.save(near.join(classes.select("fingerprint", "held"), "fingerprint").withColumn("near", F.transform("near", lambda x: x["rep"])), "near")
    joined = join_facts(table, near, "fingerprint", "held")
    query = F.col("doc_id") % 50 == 0
    return joined.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.when(query, F.col("n")).alias("n_near"), F.when(query, F.col("near")).alias("near_ids"))
