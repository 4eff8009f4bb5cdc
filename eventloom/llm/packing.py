"""Best-fit packing planned on the histogram of lengths.

Texts are tokenised once into pieces of at most ``capacity`` tokens (only longer documents are
cut). The histogram of piece lengths, at most ``capacity`` counts, is all the planner sees: it
runs best-fit decreasing over counts, so that every step places a run of equal pieces into a
run of equal open sequences. The plan is a list of slot runs; pieces are numbered within their
length, in parallel, and take the slot whose run holds their number, by a join on length.

Tokens never cross ASCII white space, so the texts of a slice are split there and each distinct
chunk is looked up once; its ids are kept, in a cache of bounded size, for the task's later
slices. The ids of the texts are then gathered from those of their chunks.

Defined results: null and empty texts are one piece of one token (the separator); repeated
rows are packed each on their own; an empty table gives an empty result; null doc_id is kept;
columns other than doc_id and text are unread.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import bytehash
from eventloom.operators.numbering import rank_in_group
from eventloom.session import Scratch

CAPACITY, SEPARATOR = 4096, 1
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_CACHE_SIZE = 250_000
_SLICE_BYTES, _LEAST_BYTES = 1 << 23, 1 << 12  # texts tokenised together; each counts for so many at least


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of whole texts; ids of chunks are kept in two generations of bounded size, of which the older is dropped."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word of the splitter
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.now: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        self.now, self.older = {}, {}

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. A run of simple chunks is encoded as one text and cut at the ends of words.

        A chunk of letters has at least one word, one of letters and a stop at least two, so where
        a run has as many words as that in all, every chunk has; else it is encoded chunk by chunk.
        """
        arrow = pa.array(chunks, pa.string())
        simple = np.asarray(pc.match_substring_regex(arrow, r"^\p{L}+[.,;:!?]?$"))
        words = 1 + np.asarray(pc.match_substring_regex(arrow, "[.,;:!?]$")).astype(np.int64)
        found: list = [None] * len(chunks)
        order, rest = np.flatnonzero(simple), np.flatnonzero(~simple).tolist()
        parts = [order[a : a + 1000] for a in range(0, len(order), 1000)]
        texts = [" ".join([chunks[k] for k in p.tolist()]) for p in parts]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(words[part]) - 1
            if len(stops) != last[-1] + 1:
                rest += part.tolist()
                continue
            raw, start = ids.tobytes(), 0
            for k, stop in zip(part.tolist(), (4 * stops[last]).tolist(), strict=True):
                found[k] = raw[start:stop]
                start = stop
        for a in range(0, len(rest), 8192):
            part = rest[a : a + 8192]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([chunks[k] for k in part], add_special_tokens=False), strict=True):
                ids = e.ids
                found[k] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each chunk."""
        if len(self.now) > _CACHE_SIZE:
            self.now, self.older = {}, self.now
        found = list(map(self.now.get, chunks))
        lost = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(lost, map(self.older.get, [chunks[k] for k in lost]), strict=True):
            found[k] = x
        fresh = [k for k in lost if found[k] is None]
        for k, x in zip(fresh, self._encode([chunks[k] for k in fresh]), strict=True):
            found[k] = x
        self.now.update((chunks[k], found[k]) for k in lost)
        return found

    def gather(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, the separator after each; where each text's begin, and their end."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        ends = np.asarray(split.offsets)
        ends = ends - ends[0]
        coded = split.flatten().dictionary_encode()
        known = self._ids_of(coded.dictionary.to_pylist())
        flat = np.concatenate([np.frombuffer(b"".join(known), "<u4"), np.array([SEPARATOR], "<u4")])
        kind = np.int32 if texts.nbytes < 1 << 30 else np.int64
        sizes = np.append(np.fromiter(map(len, known), kind, len(known)) // 4, kind(1))
        first = np.cumsum(sizes, dtype=kind) - sizes
        word = np.insert(np.asarray(coded.indices), ends[1:], len(known))
        size = sizes[word]
        stop = np.cumsum(size, dtype=kind)
        at = np.concatenate([[0], stop[ends[1:] + np.arange(len(texts))].astype(np.int64)])
        place = np.repeat(first[word] - (stop - size), size)
        place += np.arange(len(place), dtype=kind)
        return flat[place], at

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without a separator, as little-endian 32-bit bytes."""
        flat, at = self.gather(pa.array(texts, pa.string()))
        return [flat[a : b - 1].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One for each worker process; its cache starts empty in each task, so that no worker holds it between tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    _tokenizers[path].forget()
    return _tokenizers[path]


def _tokenise(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in bytehash.chunks([max(n, _LEAST_BYTES) for n in sizes], _SLICE_BYTES):
                ids, at = tokenizer.gather(batch.column(1).slice(a, b - a))
                count = -(-np.diff(at) // capacity)
                owner = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(at)[owner] - start)
                begin = at[:-1][owner] + start
                cuts = [ids[x : x + n] for x, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in cuts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([x.tobytes() for x in cuts], pa.binary())] if with_ids else []), names=names)
        tokenizer.forget()

    return run


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit, where asked for)."""
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(tokenizer_path, capacity, with_ids), schema)


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first, last, sequence, per, offset) runs.

    Pieces of ``length`` numbered first..last go, ``per`` to a sequence, into sequences from
    ``sequence`` on, the first of each at ``offset``.
    """
    runs, following = [], 0
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: runs of sequences (first, how many)
    for length in sorted(histogram, reverse=True):
        left, number = histogram[length], 0
        room = length
        while left:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:
                fit = capacity // length
                need = -(-left // fit)
                free[capacity].append((following, need))
                following += need
                room = capacity
            first, many = free[room].pop()
            fit = room // length
            full = min(many, left // fit)
            if full:
                runs.append((length, number, number + full * fit - 1, first, fit, capacity - room))
                free[room - fit * length].append((first, full))
                number, left = number + full * fit, left - full * fit
                first, many = first + full, many - full
            if left and many:
                runs.append((length, number, number + left - 1, first, left, capacity - room))
                free[room - left * length].append((first, 1))
                first, many, left = first + 1, many - 1, 0
            if many:
                free[room].append((first, many))
    return runs


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All pieces with their sequence_id and offset; the plan and histogram are bounded by ``capacity``."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.save(pieces(documents, tokenizer_path, capacity, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = spark.createDataFrame([(k, max(1, -(-n // 100_000), min(64, n // 256))) for k, n in histogram.items()], "length long, _parts long")
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    numbered = rank_in_group(rows.drop("ids"), ["length"], spread, [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "number", counts=counts)
    plan = plan_runs(histogram, capacity)
    by_length: dict[int, list] = {}
    for length, first, last, sequence, per, offset in plan:
        by_length.setdefault(length, []).append((first, last, sequence, per, offset))
    slots = spark.createDataFrame(list(by_length.items()), "length long, runs array<struct<first:long,last:long,sequence:long,per:long,offset:long>>")
    joined = numbered.join(F.broadcast(slots), "length")
    run = F.get(F.filter("runs", lambda r: (r["first"] <= F.col("number")) & (r["last"] >= F.col("number"))), F.lit(0))
    joined = joined.withColumn("run", run).drop("runs")
    rank = F.col("number") - F.col("run.first")
    out = joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.sequence") + F.floor(rank / F.col("run.per"))).cast("long").alias("sequence_id"), (F.col("run.offset") + F.pmod(rank, F.col("run.per")) * F.col("length")).cast("long").alias("offset"))
    if with_ids:
        ids = rows.select(F.col("doc_id").alias("_doc"), F.col("piece").alias("_piece"), F.col("ids_crc32").alias("_crc"), "ids").dropDuplicates(["_doc", "_piece", "_crc"])
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("piece") == F.col("_piece")) & (F.col("ids_crc32") == F.col("_crc"))
        out = out.join(ids, same).drop("_doc", "_piece", "_crc")
    return out


def packing_table(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack(documents, tokenizer_path)
