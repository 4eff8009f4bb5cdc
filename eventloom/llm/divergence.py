"""Source divergence audit: how far the word use of each source is from the others of its language.

Texts are cut into terms (runs of letters, A-Z lowered) and counted in Arrow batches; a task adds
up what it meets before it hands rows on. Each language keeps the terms of at least
``least_documents`` of its documents. A kept term becomes one row, a vector of its counts indexed by
the language's sources; JVM higher-order functions turn it into smoothed frequencies and emit
what the term adds to the distance of each pair of sources, and partial aggregates sum these
where they are made. Frequencies are integers, ``1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``,
computed digit by digit so that no product leaves 64 bits.

A vector is as long as its language has sources, and pairs are emitted source by source, so a row
never holds more than that. The profiles (a language's sources and their totals) are broadcast
while there are at most ``MOST_BROADCAST`` groups, and joined by salted keys beyond.

Defined results: null text, language and source are empty strings; a group without terms has count 0
for each kept term; a language without kept terms has distances of 0; repeated rows count each;
an empty table gives an empty result; columns other than text, lang and source are unread.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import Scratch

LEAST_DOCUMENTS, TOP_TERMS, PRIOR, SCALE = 30, 50, 5, 10**9
MOST_BROADCAST, SALTS = 100_000, 64
_FLUSH = 1 << 18  # distinct terms that a task holds before it hands them on
# Letters stay (A-Z lowered), as do all bytes of other scripts; everything else parts terms.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("documents", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    """All terms of a text, in order."""
    return text.encode().translate(_LETTERS).split()


def _flush(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (times, documents) in held.items():
        terms = list(times)
        columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t.decode() for t in terms], pa.string()), pa.array([times[t] for t in terms], pa.int64()), pa.array([documents[t] for t in terms], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)
    held.clear()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source; a group without terms tells itself by an empty one."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            key = lang.as_py(), source.as_py()
            if key not in held:
                held[key] = Counter({b"": 0}), Counter()
                size += 1
            times, documents = held[key]
            words = Counter(terms_of(text.as_py()))
            before = len(times)
            times.update(words)
            documents.update(words.keys())
            size += len(times) - before
            if size > _FLUSH:
                yield from _flush(held)
                size = 0
    yield from _flush(held)


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents), each group with a row of an empty term besides."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, documents long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def frequency(count: Column, total: Column) -> Column:
    """``1 + floor(SCALE * count / total)``, exact for totals up to 9e15: three digits at a time, and the rest carried on."""
    thousand = F.lit(1000).cast("long")
    digits, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        rest = rest * thousand
        digits = digits * thousand + F.call_function("div", rest, total)
        rest = rest % total
    return digits + 1


def _with_profile(vectors: DataFrame, profiles: DataFrame, groups: int, most_broadcast: int) -> DataFrame:
    """Each term's row with its language's profile; a language of many terms is salted where profiles are too many to broadcast."""
    if groups <= most_broadcast:
        return vectors.join(F.broadcast(profiles), "lang")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return vectors.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(profiles.withColumn("_salt", salt), ["lang", "_salt"]).drop("_salt")


def divergence(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, the distance to each other source of the language,
    and part ``term``, the terms that the source uses most beyond its language."""
    scratch = Scratch(documents.sparkSession, "divergence")
    counts = scratch.save(term_counts(documents), "counts")
    held = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    wide = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"), held.alias("held")).where(F.col("documents") >= least_documents)
    wide = scratch.save(wide.drop("documents"), "wide")

    # A language's profile: its sources in order, their totals over the kept terms, its own total and number of terms.
    groups = counts.where("term = ''").select("lang", "source")
    own = wide.select("lang", F.explode("held").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    totals = groups.join(own, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("t"))
    sizes = wide.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    profiles = totals.join(sizes, "lang", "left").select("lang", F.col("t.source").alias("sources"), F.col("t.n").alias("totals"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    profiles = scratch.save(profiles, "profiles")

    room = PRIOR * F.col("terms")
    met = _with_profile(wide, profiles, groups.count(), most_broadcast)
    vector = F.transform("sources", lambda s: F.coalesce(F.try_element_at("held", s), F.lit(0).cast("long")))
    met = met.withColumn("counts", vector).drop("held")
    p = F.zip_with("counts", "totals", lambda c, t: frequency(c + PRIOR, t + room))
    vectors = scratch.save(met.select("lang", "term", "counts", p.alias("p"), frequency(F.col("n") + PRIOR, F.col("lang_total") + room).alias("q"), "sources"), "vectors")

    # What a term adds to each pair, source by source; every pair begins with 0.
    one = vectors.select("lang", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("i"))
    each = one.select("lang", "i", F.posexplode(F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x: F.abs(x - F.get("p", F.col("i"))))).alias("k", "f"))
    each = each.select("lang", "i", (F.col("i") + F.col("k") + 1).alias("j"), "f")
    blank = profiles.select("lang", F.size("sources").alias("s"), F.explode(F.sequence(F.lit(0), F.size("sources") - 1)).alias("i"))
    blank = blank.where("i + 1 < s").select("lang", "i", F.explode(F.sequence(F.col("i") + 1, F.col("s") - 1)).alias("j"), F.lit(0).cast("long").alias("f"))
    pairs = scratch.save(each.unionByName(blank).groupBy("lang", "i", "j").agg(F.sum("f").alias("value")), "pairs")
    both = pairs.unionByName(pairs.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    named = groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    named = scratch.save(named, "named")
    both = both.join(named, ["lang", "i"]).join(named.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    found = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))

    own = F.transform(F.arrays_zip("sources", "counts", "p"), lambda x: F.struct(x["sources"].alias("source"), x["counts"].alias("n"), (x["p"] - F.col("q")).alias("value")))
    more = vectors.select("lang", F.col("term").alias("item"), F.explode(F.filter(own, lambda x: (x["n"] > 0) & (x["value"] > 0))).alias("x"))
    more = more.select("lang", "x.source", F.lit("term").alias("part"), "item", "x.value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return found.unionByName(more)


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT id, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), ps AS (
  SELECT *, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM cells
), langs AS (
  SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term
), qs AS (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM langs
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM ps a JOIN ps b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), out AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT ps.lang, source, 'term', ps.term, p - q FROM ps JOIN qs ON ps.lang = qs.lang AND ps.term = qs.term WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM out
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= 50
"""
