"""Removal of repeated 100-byte strings by bucket-pointer refinement of suffixes.

Texts are cut into segments: runs of consecutive windows of ``WINDOW`` bytes whose least hash
of a ``GRAM``-byte gram is the same. Equal windows have equal least hashes, so all of them
meet under one key.

1. Keys of all segments are counted, bucket by bucket; a key met once holds no repeat.
2. Segments under repeated keys are sent to their bucket with their bytes. Equal segments of
   one flush travel once: the earliest stays, the others are repeats already, so a passage
   found in a third of all documents costs a few rows for each input task. Keys that hold over
   1/4096 of all segments are dealt on, window by window, by first and last gram.
3. In a bucket the suffixes are sorted to depth ``WINDOW``: initial buckets by 8-byte grams
   are refined by the bucket identifiers of the suffixes 8, 16, 32 bytes later, each pass
   reusing the last one's updated identifiers; suffixes alone in their bucket leave. Windows
   that end in one bucket are equal; all but the earliest are repeats.

Texts that equal another whole text collapse before step 1: the least doc_id keeps its bytes.

Defined results: null text is empty; texts under ``WINDOW`` bytes lose nothing; of repeated
rows one stays; equal ids with different texts are ordered by the hash of their texts; null
ids come first; an empty table gives an empty result; columns other than doc_id and text are
unread. Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import bytehash
from eventloom.operators.resident import Resident
from eventloom.operators.skew import join_facts
from eventloom.session import Scratch

WINDOW, GRAM = 100, 32
_PLACE = np.uint64((1 << 24) - 1)
_PIECE = 1 << 20  # windows of one text that are looked at together


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, key, repeats itself) of all segments, for texts of 2**24 bytes together at most."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    sums = bytehash.prefix_sums(data)
    down = bytehash._power("down", bytehash.BASE_INVERSE, len(sums))
    grams = bytehash.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    size, span = 1, WINDOW - GRAM + 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: size - span], least[span - size :])
    ends = np.cumsum(lens)
    stop = np.repeat(ends, lens)[: len(least)] - WINDOW + 1
    valid = stop > np.arange(len(least))
    new = np.concatenate([[True], (least[1:] != least[:-1]) | ~valid[:-1]])
    start = np.flatnonzero(valid & new)
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    key = grams[(least[start] & _PLACE).astype(np.int64)]
    stop = np.minimum(np.concatenate([start[1:], [len(least)]]), stop[start])
    head = np.concatenate([[True], (key[1:] != key[:-1]) | (stop[:-1] != start[1:])])
    own = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    text = np.searchsorted(ends, start[first], side="right")
    return text, start[first] - (ends - lens)[text], stop[last] - start[first], key[first], np.bincount(own) > 1


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Runs of texts, long ones in overlapping pieces: (text, offset, bytes)."""
    who, offset, part, total = [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), _PIECE):
            cut = t[at : at + _PIECE + WINDOW - 1]
            if total + len(cut) > _PIECE and who:
                yield who, offset, part
                who, offset, part, total = [], [], [], 0
            who.append(k)
            offset.append(at)
            part.append(cut)
            total += len(cut)
            if total >= 1 << 18:
                yield who, offset, part
                who, offset, part, total = [], [], [], 0
    if who:
        yield who, offset, part


def all_segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for who, offset, part in pieces(texts):
        text, start, run, key, self_ = segments(part)
        yield np.asarray(who, np.int64)[text], start + np.asarray(offset, np.int64)[text], run, key, self_


def _short(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(32)).astype(np.uint32)


def _batch(names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


_KEYS = "bucket int, kind int, keys binary, values binary"
_SINGLE, _KNOWN, _COUNT = 0, 1, 2  # (key, row) met once here; (key, row) of keys met twice here; (key, how often) of those


def _send_keys(buckets: int, flush: int = 600_000):
    """Keys of all segments, packed by bucket; keys met twice here are known as repeated at once."""

    def pack(keys: list[np.ndarray], owners: list[np.ndarray], selfs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        key, owner, self_ = np.concatenate(keys), np.concatenate(owners), np.concatenate(selfs)
        order = np.argsort(key, kind="stable")
        key, owner, self_ = key[order], owner[order], self_[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.concatenate([first, [len(key)]]))
        times = times + np.add.reduceat(self_.astype(np.int64), first)
        many = np.repeat(times > 1, np.diff(np.concatenate([first, [len(key)]])))
        bucket_of = ((key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        rows: list[tuple] = []

        def deal(at: np.ndarray, values: np.ndarray, kind: int) -> None:
            order_ = np.argsort(bucket_of[at], kind="stable")
            at, values = at[order_], values[order_]
            cuts = np.searchsorted(bucket_of[at], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                z = slice(cuts[b], cuts[b + 1])
                rows.append((int(b), kind, _short(key[at[z]]).tobytes(), values[z].tobytes()))

        deal(np.flatnonzero(~many), owner[~many], _SINGLE)
        deal(np.flatnonzero(many), owner[many], _KNOWN)
        deal(first[times > 1], times[times > 1].astype(np.int32), _COUNT)
        for a in range(0, len(rows), 128):
            columns = zip(*rows[a : a + 128], strict=True)
            yield _batch(["bucket", "kind", "keys", "values"], [pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, selfs, held = [], [], [], 0
        for batch in bytehash.slices(batches):
            owner = np.asarray(batch.column("row").to_pylist(), np.int64)
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            for text, _, _, key, self_ in all_segments(texts):
                keys.append(key)
                owners.append(owner[text])
                selfs.append(self_)
                held += len(key)
            if held >= flush:
                yield from pack(keys, owners, selfs)
                keys, owners, selfs, held = [], [], [], 0
        yield from pack(keys, owners, selfs)

    return run


_REPEATED = "row long, bucket int, key int, n long"


def _repeated_keys(least_hot: int):
    """Bucket by bucket: (row, key) of all segments whose key is met twice or more, (bucket, key, n) of often met keys, (n) of all segments."""

    def rows_of(owner: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return _batch(["row", "bucket", "key", "n"], [pa.array(owner), pa.nulls(len(key), pa.int32()), pa.array(key.view(np.int32)), pa.nulls(len(key), pa.int64())])

    def settle(bucket: int, parts: dict[int, list[tuple[bytes, bytes]]]) -> Iterator[pa.RecordBatch]:
        single = np.concatenate([np.frombuffer(k, np.uint32) for k, _ in parts[_SINGLE]] or [np.zeros(0, np.uint32)])
        owner = np.concatenate([np.frombuffer(v, np.int64) for _, v in parts[_SINGLE]] or [np.zeros(0, np.int64)])
        marked = np.concatenate([np.frombuffer(k, np.uint32) for k, _ in parts[_COUNT]] or [np.zeros(0, np.uint32)])
        counts = np.concatenate([np.frombuffer(v, np.int32) for _, v in parts[_COUNT]] or [np.zeros(0, np.int32)])
        values, inverse = np.unique(np.concatenate([single, marked]), return_inverse=True)
        times = np.bincount(inverse, weights=np.concatenate([np.ones(len(single)), counts]), minlength=len(values)).astype(np.int64)
        tell = times[inverse[: len(single)]] > 1
        yield rows_of(owner[tell], single[tell])
        often = np.flatnonzero(times >= least_hot)
        n = len(often) + 1
        yield _batch(["row", "bucket", "key", "n"], [pa.nulls(n, pa.int64()), pa.array([bucket] * n, pa.int32()), pa.array([*values[often].view(np.int32).tolist(), None], pa.int32()), pa.array([*times[often].tolist(), int(times.sum())], pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, {_SINGLE: [], _COUNT: []}
        for batch in batches:
            for bucket, kind, keys, values in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "keys", "values")), strict=True):
                if bucket != now and now is not None:
                    yield from settle(now, parts)
                    parts = {_SINGLE: [], _COUNT: []}
                now = bucket
                if kind == _KNOWN:
                    yield rows_of(np.frombuffer(values, np.int64), np.frombuffer(keys, np.uint32))
                else:
                    parts[kind].append((keys, values))
        if now is not None:
            yield from settle(now, parts)

    return run


_FOUND = "bucket int, o long, t long, row long, start long, run long, raw binary"
_FOUND_NAMES = ["bucket", "o", "t", "row", "start", "run", "raw"]
_FOUND_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _send_segments(buckets: int, hot: frozenset[tuple[int, int]] = frozenset(), flush: int = 16 << 20):
    """Segments under repeated keys, each distinct content once a flush; later equals are repeats, without bytes.

    Segments under a ``hot`` key go window by window, to buckets by the windows' first and last
    gram, so that what surrounds a common passage doesn't meet in one bucket.
    """

    def pack(kept: dict, repeats: list) -> Iterator[pa.RecordBatch]:
        rows = [(b, *mine, raw) for (b, raw), mine in kept.items()]
        repeats.sort(key=lambda r: (r[2], r[3]))
        last = None
        for o, t, row, s, run in repeats:  # runs that follow each other are one
            if last is not None and last[3] == row and last[4] + last[5] == s:
                last[5] += run
                continue
            last = [row % buckets, o, t, row, s, run, None]
            rows.append(last)
        for a in range(0, len(rows), 4096):
            columns = zip(*rows[a : a + 4096], strict=True)
            yield _batch(_FOUND_NAMES, [pa.array(list(c), k) for c, k in zip(columns, _FOUND_TYPES, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        repeats: list = []
        held = 0
        for batch in bytehash.slices(batches):
            order, owner, row = (batch.column(c).to_pylist() for c in ("o", "t", "row"))
            asked = [np.frombuffer(x, ">u4") for x in batch.column("keys").to_pylist()]
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            wanted = np.unique(np.concatenate([(np.uint64(k) << np.uint64(32)) | a.astype(np.uint64) for k, a in enumerate(asked)])) if asked else np.zeros(0, np.uint64)
            for text, start, runs, key, _ in all_segments(texts):
                short = _short(key)
                tag = (text.astype(np.uint64) << np.uint64(32)) | short.astype(np.uint64)
                at = np.searchsorted(wanted, tag)
                hit = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == tag) if len(wanted) else np.zeros(0, np.int64)
                bucket = (key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
                for i in hit.tolist():
                    k, s, r, b = int(text[i]), int(start[i]), int(runs[i]), int(bucket[i])
                    raw = texts[k][s : s + r + WINDOW - 1]
                    if hot and (b, int(short[i])) in hot:
                        windows = [raw[j : j + WINDOW] for j in range(r)]
                        places = [((zlib.crc32(w[-GRAM:], zlib.crc32(w[:GRAM])) % buckets, w), s + j, 1) for j, w in enumerate(windows)]
                    else:
                        places = [((b, raw), s, r)]
                    for place, s_, r_ in places:
                        mine = (order[k], owner[k], row[k], s_, r_)
                        have = kept.get(place)
                        if have is None:
                            kept[place] = mine
                            held += len(place[1]) + 200
                        elif have[:4] != mine[:4]:
                            if (mine[0], mine[1], mine[3]) < (have[0], have[1], have[3]):
                                kept[place], mine = mine, have
                            repeats.append(mine)
                            held += 150
                if held >= flush:
                    yield from pack(kept, repeats)
                    kept, repeats, held = {}, [], 0
        yield from pack(kept, repeats)

    return run


def _refine(bucket: np.ndarray, step: int, at: np.ndarray) -> np.ndarray:
    """Buckets of twice the depth (or step more) for the suffixes ``at``, from their own and the later suffix's; -1 where alone."""
    out = np.full(len(bucket), -1, np.int32)
    own, later = bucket[at], bucket[at + step]
    alive = (own >= 0) & (later >= 0)
    at = at[alive]
    if len(at):
        _, inverse, times = np.unique((own[alive].astype(np.uint64) << np.uint64(32)) | later[alive].astype(np.uint64), return_inverse=True, return_counts=True)
        out[at] = np.where(times[inverse] > 1, inverse, -1)
    return out


def window_classes(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, class) of all windows that equal another; ``data`` holds segments of ``lens`` bytes one after another."""
    left = (np.repeat(np.cumsum(lens), lens) - np.arange(len(data))).astype(np.int32)
    gram = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(8):
        gram <<= np.uint64(8)
        gram |= padded[k : k + len(data)]
    at = np.flatnonzero(left >= 8)
    _, inverse, times = np.unique(gram[at], return_inverse=True, return_counts=True)
    bucket = np.full(len(data), -1, np.int32)
    bucket[at] = np.where(times[inverse] > 1, inverse, -1)
    depth = 8
    while 2 * depth <= WINDOW:
        bucket = _refine(bucket, depth, np.flatnonzero((left >= 2 * depth) & (bucket >= 0)))
        depth *= 2
    bucket = _refine(bucket, WINDOW - depth, np.flatnonzero((left >= WINDOW) & (bucket >= 0)))
    at = np.flatnonzero(bucket >= 0)
    return at, bucket[at]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket: runs of windows that start earlier elsewhere, as (row, start, run)."""
    names = ["row", "start", "run"]

    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        lens = np.fromiter((len(r[5]) for r in rows), np.int64, len(rows))
        base = np.cumsum(lens) - lens
        at, cls = window_classes(np.frombuffer(b"".join(r[5] for r in rows), np.uint8), lens)
        if not len(at):
            return None
        seg = np.searchsorted(base, at, side="right") - 1
        # texts in order, ties of one text by the start of the window
        texts = {x: k for k, x in enumerate(sorted({r[:3] for r in rows}))}
        text = np.array([texts[r[:3]] for r in rows], np.int64)[seg]
        start = np.array([r[3] for r in rows], np.int64)[seg] + (at - base[seg])
        order = np.lexsort((start, text, cls))
        c, x, s = cls[order], text[order], start[order]
        head = np.concatenate([[True], c[1:] != c[:-1]])
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (x != x[lead]) | (s != s[lead])
        x, s = x[later], s[later]
        if not len(x):
            return None
        order = np.lexsort((s, x))
        x, s = x[order], s[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (s[1:] > s[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(x)]]) - 1
        owner = np.array([row for _, _, row in sorted(texts)], np.int64)
        return _batch(names, [pa.array(owner[x[first]]), pa.array(s[first]), pa.array(s[last] - s[first] + 1)])

    now, rows = None, []
    for batch in batches:
        done = batch.filter(pc.is_null(batch.column("raw")))
        if done.num_rows:
            yield _batch(names, [done.column(c) for c in names])
        batch = batch.filter(pc.is_valid(batch.column("raw")))
        for bucket, o, t, row, start, run, raw in zip(*(batch.column(c).to_pylist() for c in _FOUND_NAMES), strict=True):
            if bucket != now and rows:
                if (done := settle(rows)) is not None:
                    yield done
                rows = []
            now = bucket
            rows.append((o, t, row, start, run, raw))
    if rows and (done := settle(rows)) is not None:
        yield done


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by runs of windows (start, run)."""
    out: list[list[int]] = []
    for start, run in sorted(spans):
        stop = start + run + WINDOW - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(with_text: bool):
    """The result of each text from its repeated runs; a copy of an earlier text keeps nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytehash.slices(batches):
            sizes, removed, counts, shas, texts = [], [], [], [], []
            for text, copy, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "copy", "spans")), strict=True):
                raw = (text or "").encode()
                holes = [(0, len(raw))] if copy and len(raw) >= WINDOW else merge([(s["start"], s["run"]) for s in spans or []])
                ends = [0, *(x for h in holes for x in h), len(raw)]
                kept = b"".join(raw[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2)) if holes else raw
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept))
                counts.append(len(holes))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, removed, counts)), pa.array(shas, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield _batch(names + ["kept"], [*columns, pa.array(texts, pa.binary())]) if with_text else _batch(names, columns)

    return run


def dedup_substrings(documents: DataFrame, with_text: bool = False, least_hot: int = 256, most_hot: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay, where asked for).

    The texts are written once and stay there; what is found about them, a few bytes a segment, is brought to them.
    A key is hot if it holds ``least_hot`` segments or more, and over 1 / ``most_hot`` of all.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "suffixes")
    partitions = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions  # a task holds one bucket at a time
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumns({"t": F.xxhash64("text"), "o": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    texts = Resident(docs, scratch, "texts")
    ids = texts.table().select("row", "o", "t")
    heads = ids.groupBy("t").agg(F.min(F.struct("o", "row")).alias("head"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copies = join_facts(ids, scratch.save(heads, "heads"), "t", "rows", "inner").where(F.struct("o", "row") > F.col("head"))
    copies = scratch.save(copies.select("row"), "copies")

    firsts = texts.join(copies, "left_anti").where(F.octet_length("text") >= WINDOW).select("row", "text")
    sent = firsts.mapInArrow(_send_keys(buckets), _KEYS).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    known = texts.save(sent.mapInArrow(_repeated_keys(least_hot), _REPEATED), scratch, "known")
    total = known.where("row is null and key is null").agg(F.sum("n").alias("n")).first()["n"] or 0
    often = known.where(F.col("row").isNull() & F.col("key").isNotNull() & (F.col("n") > total / most_hot))
    hot = frozenset((r["bucket"], r["key"] & 0xFFFFFFFF) for r in often.select("bucket", "key").collect())  # fewer than most_hot
    digits = F.transform(F.collect_set("key"), lambda k: F.lpad(F.hex(k.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    asked = known.where("row is not null").groupBy("row").agg(F.unhex(F.array_join(digits, "")).alias("keys"))

    found = texts.join(scratch.save(asked, "asked")).select("o", "t", "row", "keys", "text").mapInArrow(_send_segments(buckets, hot), _FOUND)
    again = found.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeats, "row long, start long, run long")
    spans = texts.save(again.groupBy("row").agg(F.collect_list(F.struct("start", "run")).alias("spans")), scratch, "spans")
    scratch.drop("known", "asked")
    marks = spans.select("row", F.lit(False).alias("copy"), "spans").unionByName(copies.select("row", F.lit(True).alias("copy"), F.lit(None).cast("array<struct<start:long,run:long>>").alias("spans")))
    rows = texts.join(marks, "left").select("doc_id", "text", "copy", "spans")
    out = texts.save(rows.mapInArrow(_cut(with_text), _RESULT + (", kept binary" if with_text else "")), scratch, "results")
    texts.drop()
    scratch.drop("texts", "texts-homes", "heads", "copies", "spans")
    return out
