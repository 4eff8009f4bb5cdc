"""Secret scans: base patterns and character Markov models compared by log-likelihood ratio.

Everything is DataFrame functions. Places of matches come from the pieces between them
(``split``) and the matches themselves (``regexp_extract_all``), in code points. The method
adds spans of kind ``random``: candidate strings of ``CANDIDATE``, shorter ones (``SHORT``) beside a
word that hints at a secret, or where base spans cover a part of one, each of its parts outside
them, that hold a letter and a digit and whose mean log-likelihood ratio a character pair, under a first-order Markov model of random strings
against one of ordinary identifiers, exceeds a threshold. Both models are trained from labelled
samples. Random: strings made by hash rules and the values that the base patterns find in a
bounded sample of documents (``max_train_docs``, a documented bound). Ordinary: identifiers made
from word lists by rule, the words of that sample, and identifiers made of them. A quarter of the
strings is held out, and the threshold is chosen on it.

The sample is drawn by the hash of id and text, so that rows of one id or of none are drawn apart;
it is written once. Defined results: null and empty texts have no spans; repeated rows are scanned alike; an empty
table gives an empty result; all columns are kept by ``with_spans`` and new names carry a
prefix, so extra columns don't clash.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import Scratch

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is long enough is the same match as any run, filtered by length afterwards.
ACCESS, HEX, CANDIDATE = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_=-]{20,}"
# Shorter values count beside words that hint at a secret, with as much evidence as the shortest candidate needs.
HINTS = "pwd|passphrase|passcode|auth|bearer|credential|private_key|access_key|signature"
SHORT = rf"""(?<=(?i:{HINTS})["']?[\x20]{{0,3}}[:=]?[\x20]{{0,3}}["']?)(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{10,19}}(?![A-Za-z0-9+/_=-])"""
LEAST_LONG = 20
KINDS = ("assign", "access", "hex", "random")
CODES, MAX_TRAIN_DOCS, THRESHOLD, SMOOTH = 96, 500, 0.35, 0.5
SPAN = "array<struct<start:int,ord:int,kind:string,stop:int>>"
SPAN_RAW = "array<struct<start:int,ord:int,kind:string,stop:int,raw:string>>"
# Fixed word lists of the identifier rule.
_VERBS = "get set load save make find read write open close parse build check update delete create handle render fetch store".split()
_NOUNS = "user account session request response config index table record message client server buffer cache file path image token_count page event".split()
_ENDS = "name count list map id size value type key index url path v2 2024 01 test tmp backup handler factory service".split()


def _places(text: Column, pattern: str, kind: str, group: int | None = None, least_group: int = 0, least_length: int = 0, with_raw: bool = False) -> Column:
    """Spans of all leftmost non-overlapping matches, failing ones dropped; ``with_raw`` adds their text."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    inner = F.regexp_extract_all(text, F.lit(pattern), group) if group else found
    need = least_group if group else least_length
    block = 256

    def total(array: Column, first: Column, count: Column) -> Column:
        return F.aggregate(F.slice(array, first, count), F.lit(0), lambda a, x: a + x)

    def spans(parts: Column) -> Column:
        steps, lead, own, whole = parts["steps"], parts["lead"], parts["own"], parts["whole"]
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / block).cast("int")), lambda b: total(steps, F.lit(1), b * block))

        def place(i: Column) -> Column:
            b = F.floor(i / block).cast("int")
            start = F.get(blocks, b) + total(steps, b * block + 1, i - b * block) + F.get(lead, i)
            return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), (start + F.get(whole, i)).alias("stop"), F.get(own, i).alias("need"), F.get(parts["raw"], i).alias("raw"))

        placed = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), place)
        good = F.filter(placed, lambda s: s["need"] >= need)
        return F.transform(good, lambda s: F.struct(s["start"], s["ord"], s["kind"], s["stop"], *([s["raw"]] if with_raw else [])))

    whole = F.transform(found, F.length)
    lead = F.transform(F.slice(between, F.lit(1), F.size(found)), F.length)
    parts = F.struct(F.zip_with(lead, whole, lambda a, b: a + b).alias("steps"), lead.alias("lead"), F.transform(inner, F.length).alias("own"), whole.alias("whole"), found.alias("raw"))
    # A one-element array binds the parts once for the expressions that use them.
    return F.flatten(F.transform(F.array(parts), spans))


def _when(test: Column, spans: Column) -> Column:
    return F.when(test, spans)


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _samples(spark: SparkSession, documents: DataFrame | None, max_train_docs: int) -> DataFrame:
    """(text, random): labelled strings."""
    h = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    b64 = F.base64(F.unhex(h))
    strings = spark.range(3000).select(F.explode(F.array(F.substring(h, 1, 40), F.substring(b64, 1, 40), F.upper(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 24)), F.lower(F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 24)))).alias("text"), F.lit(True).alias("random"))
    verbs, nouns, ends = (F.array(*map(F.lit, x)) for x in (_VERBS, _NOUNS, _ENDS))
    pick = lambda xs, n, k: F.get(xs, F.pmod(F.floor(F.col("id") / k), F.lit(n)).cast("int"))
    v, n, e = pick(verbs, len(_VERBS), 1), pick(nouns, len(_NOUNS), len(_VERBS)), pick(ends, len(_ENDS), len(_VERBS) * len(_NOUNS))
    names = spark.range(len(_VERBS) * len(_NOUNS) * len(_ENDS)).select(F.explode(F.array(F.concat_ws("_", v, n, e), F.concat(v, F.initcap(n), F.initcap(e)), F.concat_ws("-", n, e, v), F.concat_ws("/", F.lit(""), n, v, e), F.upper(F.concat_ws("_", n, e)))).alias("text"), F.lit(False).alias("random"))
    out = strings.unionByName(names)
    if documents is not None:
        total = documents.count()
        rows = documents.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id", "text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_train_docs / max(1, total))))
        text = F.coalesce(F.col("text"), F.lit(""))
        words = F.regexp_extract_all(text, F.lit("[A-Za-z]{4,}"), 0)
        glue = F.sequence(F.lit(0), F.greatest(F.size(words) - 4, F.lit(0)), F.lit(4))
        names = F.when(F.size(words) >= 4, F.transform(glue, lambda i: F.concat_ws("_", F.slice(words, i + 1, 4)))).otherwise(words)
        met = F.concat(F.regexp_extract_all(text, F.lit(ACCESS), 0), F.regexp_extract_all(text, F.lit(HEX), 0), F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), 2), lambda x: F.length(x) >= 16))
        known = rows.select(F.explode(met).alias("text"), F.lit(True).alias("random"))
        out = out.unionByName(rows.select(F.explode(F.concat(words, names)).alias("text"), F.lit(False).alias("random"))).unionByName(known)
    return out


def _held(text: Column) -> Column:
    """A quarter of the labelled strings, by hash, is kept from training."""
    return F.pmod(F.xxhash64(F.lit("held"), text), F.lit(4)) == 0


def fit(spark: SparkSession, documents: DataFrame | None, max_train_docs: int = MAX_TRAIN_DOCS) -> dict:
    """{table, threshold, precision, recall}: the models, and the threshold chosen on held-out labelled strings.

    Thresholds go in steps of 0.05; an ordinary string above one weighs as much as ten random
    strings below it, and of equals the largest wins. Only strings as long as candidates decide; their ratios are counted in
    bins, so the driver sees a few hundred rows.
    """
    samples = Scratch(spark, "secret-samples").save(_samples(spark, documents, max_train_docs), "samples")
    table = train(samples.where(~_held(F.col("text"))))
    asked = samples.where(_held(F.col("text")) & (F.length("text") >= 20) & F.col("text").rlike("^[A-Za-z0-9+/_=-]+$")).distinct()
    bins = asked.select("random", F.floor(ratio(F.col("text"), table) * 20).cast("int").alias("bin")).groupBy("random", "bin").count().collect()
    count = {(r["random"], r["bin"]): r["count"] for r in bins if r["bin"] is not None}
    above = lambda label, t: sum(n for (x, b), n in count.items() if x == label and b >= t)
    most = sum(n for (x, _), n in count.items() if x)
    if not most:
        return {"table": table, "threshold": THRESHOLD, "precision": None, "recall": None}
    t = max(range(-40, 80), key=lambda t: (above(True, t) - 10 * above(False, t), t))
    hit, wrong = above(True, t), above(False, t)
    return {"table": table, "threshold": t / 20, "precision": hit / max(1, hit + wrong), "recall": hit / most}


def train(samples: DataFrame) -> list[float]:
    """The table of log-likelihood ratios of character pairs, CODES * CODES values; pairs are counted in the cluster."""
    code = lambda c: F.greatest(F.least(F.ascii(c) - 32, F.lit(CODES - 1)), F.lit(0))
    chars = F.transform(F.split("text", ""), code)
    pairs = samples.where(F.length("text") > 1).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.element_at(chars, i) * CODES + F.element_at(chars, i + 1))).alias("pair"))
    counts: dict[bool, dict[int, int]] = {True: defaultdict(int), False: defaultdict(int)}
    for r in pairs.groupBy("random", "pair").count().collect():
        counts[r["random"]][r["pair"]] = r["count"]
    used = sorted({p % CODES for c in counts.values() for p in c} | {p // CODES for c in counts.values() for p in c})
    heads = {label: defaultdict(int) for label in counts}
    for label, c in counts.items():
        for p, n in c.items():
            heads[label][p // CODES] += n
    table = [0.0] * (CODES * CODES)
    for a in used:
        for b in used:
            rate = {label: (counts[label][a * CODES + b] + SMOOTH) / (heads[label][a] + SMOOTH * len(used)) for label in counts}
            table[a * CODES + b] = round(math.log(rate[True] / rate[False]), 4)
    return table


def ratio(text: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio a character pair."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    codes = F.transform(F.split(text, ""), lambda c: F.greatest(F.least(F.ascii(c) - 32, F.lit(CODES - 1)), F.lit(0)))

    def mean(x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 2), F.lit(0.0), lambda acc, i: acc + F.get(values, F.get(x, i) * CODES + F.get(x, i + 1))) / (F.size(x) - 1)

    return F.get(F.transform(F.array(codes), mean), F.lit(0))


def with_spans(documents: DataFrame, table: list[float], prefix: str = "secret_", threshold: float = THRESHOLD) -> DataFrame:
    """All columns, with arrays of spans: {prefix}assign, {prefix}access, {prefix}hex, {prefix}base and {prefix}all, by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = {k: f"{prefix}{k}" for k in ("assign", "access", "hex", "cand", "base", "all")}
    none = F.array().cast(SPAN)
    low = F.lower(text)
    weak = low.rlike(HINTS)
    hint = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    out = documents.withColumns({
        name["assign"]: F.coalesce(_when(hint & text.rlike(ASSIGN), _places(text, ASSIGN, "assign", group=2, least_group=6)), none),
        name["access"]: F.coalesce(_when(F.contains(text, F.lit("AKIA")), _places(text, ACCESS, "access", least_length=20)), none),
        name["hex"]: F.coalesce(_when(text.rlike(HEX), _places(text, HEX, "hex", least_length=24)), none),
        name["cand"]: F.coalesce(_when(text.rlike(CANDIDATE), _places(text, CANDIDATE, "random", least_length=20, with_raw=True)), F.array().cast(SPAN_RAW)),
    })
    short = F.coalesce(_when(weak, _places(text, SHORT, "random", with_raw=True)), F.array().cast(SPAN_RAW))
    out = out.withColumn(name["cand"], F.when(weak, F.concat(F.col(name["cand"]), short)).otherwise(F.col(name["cand"])))
    out = out.withColumn(name["base"], F.array_sort(F.concat(F.col(name["assign"]), F.col(name["access"]), F.col(name["hex"]))))

    def clear(s: Column) -> Column:
        """The parts of a candidate outside the base spans."""
        met = F.filter(F.col(name["base"]), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
        # The text of a part comes from the candidate's own, not from the document's start.
        part = lambda a, b: F.struct(a.alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), b.alias("stop"), F.substring(s["raw"], a - s["start"] + 1, b - a).alias("raw"))

        def before(i: Column) -> Column:
            return F.greatest(s["start"], F.coalesce(F.array_max(F.transform(F.slice(met, F.lit(1), i), lambda b: b["stop"])), s["start"]))

        gaps = F.transform(F.sequence(F.lit(0), F.size(met)), lambda i: part(before(i), F.coalesce(F.get(met, i)["start"], s["stop"])))
        return F.when(F.size(met) == 0, F.array(s)).otherwise(F.filter(gaps, lambda g: g["start"] < g["stop"]))

    def odd(s: Column) -> Column:
        # A mean over few pairs must be the higher: all together weigh what those of the shortest long candidate do.
        least = F.lit(threshold) * F.greatest(F.lit(1.0), F.lit(float(LEAST_LONG - 1)) / (F.length(s["raw"]) - 1))
        return (F.length(s["raw"]) > 1) & s["raw"].rlike("[0-9]") & s["raw"].rlike("[A-Za-z]") & (ratio(s["raw"], table) > least)

    parts = F.filter(F.flatten(F.transform(F.col(name["cand"]), clear)), odd)
    added = F.transform(parts, lambda s: F.struct(s["start"], s["ord"], s["kind"], s["stop"]))
    out = out.withColumn(name["all"], F.when(F.size(name["cand"]) > 0, F.array_sort(F.concat(F.col(name["base"]), added))).otherwise(F.col(name["base"])))
    return out.drop(name["cand"])


def redact(documents: DataFrame, table: list[float], mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """Documents with every span, overlapping ones together, replaced by ``mark``; n_chars, where present, follows."""
    names = documents.columns
    found = with_spans(documents, table, "_secret_", threshold)
    start = F.struct(F.array().cast("array<struct<start:int,stop:int>>").alias("done"))

    def take(acc: Column, s: Column) -> Column:
        done = acc["done"]
        joins = (F.size(done) > 0) & (s["start"] < F.coalesce(F.try_element_at(done, F.lit(-1))["stop"], F.lit(-1)))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["stop"], s["stop"]).alias("stop"))))
        return F.struct(F.when(joins, grown).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))).alias("done"))

    found = found.withColumn("_secret_cuts", F.when(F.size("_secret_all") > 0, F.aggregate("_secret_all", start, take, lambda a: a["done"])))
    cuts = F.col("_secret_cuts")

    def kept(i: Column) -> Column:
        a = F.when(i > 0, F.get(cuts, i - 1)["stop"]).otherwise(F.lit(0))
        b = F.when(i < F.size(cuts), F.get(cuts, i)["start"]).otherwise(F.length("text"))
        return F.substring(F.col("text"), a + 1, b - a)

    text = F.when(cuts.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.size(cuts)), kept), mark)).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(cuts.isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in names])


def secret_report(documents: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document; n_spans counts those of all kinds."""
    model = fit(documents.sparkSession, documents)
    found = with_spans(documents.select("doc_id", "text"), model["table"], "s_", model["threshold"])
    return found.select("doc_id", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(_join(F.col("s_base")).cast("binary"), 256).alias("base_sha256"), _join(F.col("s_all")).alias("spans"), F.size("s_all").cast("long").alias("n_spans"))
