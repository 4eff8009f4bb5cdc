"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Everything is DataFrame functions. A text is lower-cased (A-Z only) and cut into words; every
window of ``n`` words is hashed inside the row and tested against a bit table of the benchmark's
window hashes, two bits a window in ``BITS_PER_WINDOW`` or more, up to ``MAX_BITS`` (two million
windows; a larger benchmark fills the table further, so more windows pass). What passes is
spelled out and looked up, by its text, in the set of benchmark windows, so that every hit is
verified word for word. That set is broadcast up to ``max_broadcast_windows``; a larger one is
joined by a shuffle of the few windows that passed.

Defined results: null text has no words and is clean; empty items are ignored; repeated items
count once each by item_id; repeated documents each get their row; an empty table of
documents gives no rows, an empty benchmark hits nothing. Only ``doc_id``, ``text``,
``item_id`` and ``text`` are read, so further columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# In a text as it is. Case-blind matching would take every ASCII letter out of a negated class.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
BITS_PER_WINDOW, MAX_BITS = 64, 1 << 27
MOST_BROADCAST_HITS = 1 << 20


def words_of(text: Column) -> Column:
    """Words in order; null and wordless texts give an empty array."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(window, len, items): distinct normalised windows and the items that hold them."""
    words = benchmark.select(F.col("item_id").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
    each = words.select("item_id", F.least(size, F.lit(n)).alias("len"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))).alias("window"))
    return each.groupBy("window", "len").agg(F.collect_set("item_id").alias("items"))


def _slots(words: Column, bits: int) -> list[Column]:
    """The places of a window's bits; the second is asked for only where the first is set."""
    return [F.pmod(F.xxhash64(words), F.lit(bits)), F.pmod(F.xxhash64(words, F.lit("second")), F.lit(bits))]


def _bit_table(windows: DataFrame, count: int) -> tuple[Column, int]:
    """A constant array of 64-bit words with the bits set of each benchmark window; at most MAX_BITS bits."""
    bits = 1 << 12
    while bits < min(MAX_BITS, BITS_PER_WINDOW * count):
        bits *= 2
    slots = windows.select(F.explode(F.array(*_slots(F.split("window", " "), bits))).alias("slot"))
    rows = slots.distinct().groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("v")).collect()
    table = ["0"] * (bits // 64)
    for r in rows:
        table[r["at"]] = str(r["v"])
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>"), bits


def _candidates(words: Column, length: int, table: Column, bits: int) -> Column:
    """The windows of ``length`` words whose bits are set in ``table``, spelled out."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - length + 1)).otherwise(F.array().cast("array<int>"))

    def is_set(slot: Column) -> Column:
        return F.call_function("shiftright", F.get(table, F.floor(slot / 64).cast("int")), (slot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    def passes(i: Column) -> Column:
        first, second = _slots(F.slice(words, i, length), bits)
        return is_set(first) & is_set(second)

    def spell(i: Column) -> Column:
        return F.struct(i.alias("at"), F.lit(length).alias("len"), F.array_join(F.slice(words, i, length), " ").alias("window"))

    return F.transform(F.filter(starts, passes), spell)


def find_hits(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_broadcast_windows: int = 1 << 17) -> DataFrame:
    """A row for each input row: doc_id, text_key, n_words, spans (array of word start and length), items (array of item_id)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "decontamination")
    windows = scratch.save(benchmark_windows(benchmark, n), "windows")
    per_length = {r["len"]: r["count"] for r in windows.groupBy("len").count().collect()}
    count = sum(per_length.values())
    small = count <= max_broadcast_windows
    docs = documents.select(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull()).alias("text_key"), words_of(F.col("text")).alias("words"))
    words, size = F.col("words"), F.size("words")
    table, bits = _bit_table(windows, count) if count else (F.array().cast("array<bigint>"), 64)
    found = [_candidates(words, length, table, bits) for length in sorted(per_length)]
    found = F.concat(*found) if len(found) > 1 else found[0] if found else F.array().cast("array<struct<at:int,len:int,window:string>>")
    rows = docs.select("doc_id", "text_key", size.alias("n_words"), F.posexplode_outer(found).alias("j", "c"))
    rows = rows.select("doc_id", "text_key", "n_words", (F.coalesce("j", F.lit(0)) == 0).alias("first"), F.col("c.at").alias("at"), F.col("c.len").alias("len"), F.col("c.window").alias("window"))
    known = windows.select("window", "items")
    joined = rows.join(F.broadcast(known) if small else known, "window", "left")
    span = F.when(F.col("items").isNotNull(), F.struct(F.col("at"), F.col("len")))
    grouped = joined.groupBy("doc_id", "text_key", "n_words").agg(F.count_if("first").alias("copies"), F.collect_set(span).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy", "copies")


def hit_words(spans: Column) -> Column:
    """Distinct word positions (from 1) that the spans cover."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """Documents without benchmark passages, all columns kept.

    ``remove="documents"`` drops every document with a hit; ``remove="spans"`` cuts the hit
    words, and the separators before them, out of the text and keeps the document. Up to
    ``MOST_BROADCAST_HITS`` hit documents (two numbers each; a 64th of that with their spans) are
    broadcast, so that texts stay where they are; more are joined by a shuffle.
    """
    hits = find_hits(documents, benchmark, n).where(F.size("spans") > 0).select(F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key"), F.col("spans").alias("_hit_spans")).dropDuplicates(["_hit_id", "_hit_key"])
    hits = Scratch(documents.sparkSession, "hits").save(hits, "hits")
    few = hits.count() <= (MOST_BROADCAST_HITS if remove == "documents" else MOST_BROADCAST_HITS // 64)
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    match = F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (key == F.col("_hit_key"))
    if remove == "documents":
        hits = hits.drop("_hit_spans")
        return documents.join(F.broadcast(hits) if few else hits, match, "left_anti")
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")
    names = documents.columns
    joined = documents.join(F.broadcast(hits) if few else hits, match, "left")
    raw = F.regexp_extract_all(F.col("text"), F.lit(WORD), 0)
    gaps = F.split(F.col("text"), WORD, -1)
    hit = hit_words(F.col("_hit_spans"))
    kept = F.transform(F.sequence(F.lit(1), F.size(raw)), lambda i: F.when(F.array_contains(hit, i), F.lit("")).otherwise(F.concat(F.get(gaps, i - 1), F.get(raw, i - 1))))
    cut = F.concat(F.array_join(kept, ""), F.element_at(gaps, -1))
    return joined.withColumn("text", F.when(F.col("_hit_key").isNull(), F.col("text")).otherwise(cut)).select(*names)


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of the hits of each document."""
    found = find_hits(documents, benchmark)
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.size(hit_words(F.col("spans"))).cast("long")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (
  SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), pos AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid
), it AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
