"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

Every row gets four coordinates (byte size, language, source, position of its id), scaled to
0..1 and held as 20-bit integers. A node is cut along its widest coordinate at the weighted
median of (coordinate, text hash, row hash), found by a radix descent: each pass sums the
bytes of at most 4096 bins a node, for all nodes of a level in one aggregate, and only the
bin that holds the median is looked into further. Equal texts share their coordinates, so a
group of copies stays in one shard unless it is larger than the tolerance and a cut falls
inside it. The driver sees bins and nodes, never rows.

Defined results: null text weighs 1 byte and is a group of its own kind (all null texts are
equal); null lang and source are values of their own; repeated rows are rows of their own;
null doc_id sorts by its hash like any other; fewer rows than shards leave shards empty; an
empty table gives an empty result. Columns other than doc_id, text, lang, source are unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.numbering import rank_in_group
from eventloom.operators.skew import join_facts
from eventloom.session import Scratch

DIMENSIONS = ("size", "lang", "source", "position")
COORDINATE_HEX, GROUP_HEX, NAME_BINS = 5, 16, 4096


def _hex64(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _coordinate(share: Column) -> Column:
    """A share of 0..1 as five hex digits."""
    return F.lpad(F.lower(F.hex(F.least(F.floor(share * (1 << 20)), F.lit((1 << 20) - 1)).cast("long"))), COORDINATE_HEX, "0")


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _share(rows: DataFrame, name: str, group_name: str) -> Column:
    """Where a name lies on the scale of bytes: the share of all bytes under names of lesser hash, in NAME_BINS bins.

    The distance of two names is then the weight between them, so that a dimension is as wide
    as what it can part.
    """
    found = rows.groupBy(F.pmod(F.crc32(F.col(name).cast("binary")), F.lit(NAME_BINS)).alias("bin")).agg(F.sum("size").alias("w")).collect()
    weight = [0] * NAME_BINS
    for r in found:
        weight[r["bin"]] = r["w"]
    total, before, scale = max(1, sum(weight)), 0, []
    for w in weight:
        scale.append(f"{(before + w / 2) / total:.9f}")
        before += w
    places = F.split(F.lit(",".join(scale)), ",").cast("array<double>")
    return F.get(places, F.pmod(F.crc32(F.col(group_name).cast("binary")), F.lit(NAME_BINS)).cast("int"))


def _meta(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """One small row for each document: doc_id, size, text_crc32, group and the four coordinates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.col("text").isNull()).alias("grp"),
        F.coalesce(_optional(documents, "lang"), F.lit("")).alias("lang"),
        F.coalesce(_optional(documents, "source"), F.lit("")).alias("source"),
    )
    rows = scratch.save(rows, "rows")
    ends = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, width = ends["lo"] or 0, max(1, (ends["hi"] or 0) - (ends["lo"] or 0))
    groups = rows.groupBy("grp").agg(F.min("doc_id").alias("g_id"), F.min("lang").alias("g_lang"), F.min("source").alias("g_source"), F.count(F.lit(1)).alias("g_rows"))
    joined = join_facts(rows.drop("lang", "source").withColumn("number", F.monotonically_increasing_id()), scratch.save(groups, "groups"), "grp", "g_rows", "inner")
    shares = (F.log2(F.col("size").cast("double")) / 48, _share(rows, "lang", "g_lang"), _share(rows, "source", "g_source"), (F.coalesce("g_id", F.lit(lo)) - lo) / float(width))
    # Equal rows are told apart by their numbers, so that a cut may part them.
    own = _hex64(F.xxhash64("doc_id", "text_crc32", "number"))
    return joined.select("doc_id", "size", "text_crc32", F.concat(_hex64(F.col("grp")), own).alias("tail"), F.array(*[_coordinate(x) for x in shares]).alias("at"))


def _cut_nodes(spark, rows: DataFrame, nodes: dict[int, tuple[int, int]], target: float, tolerance: float) -> dict[int, tuple[int, str]]:
    """For each node with more than one leaf the dimension and the key before which rows go left."""
    ends = [f(F.col("at")[k]).alias(f"{n}{k}") for k in range(len(DIMENSIONS)) for n, f in (("lo", F.min), ("hi", F.max))]
    stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *ends).collect()}
    state, cuts = {}, {}
    for node, (_, leaves) in nodes.items():
        if leaves < 2 or node not in stats:
            continue
        r = stats[node]
        dim = max(range(len(DIMENSIONS)), key=lambda k: int(r[f"hi{k}"], 16) - int(r[f"lo{k}"], 16))
        state[node] = [dim, "", r["w"] * (leaves // 2) / leaves]
    while state:
        asked = spark.createDataFrame([(n, s[0], s[1]) for n, s in state.items()], "node long, dim int, prefix string")
        keyed = rows.join(F.broadcast(asked), "node").withColumn("key", F.concat(F.get(F.col("at"), F.col("dim")), F.col("tail"))).where(F.col("key").startswith(F.col("prefix")))
        bins = keyed.groupBy("node", F.expr("substring(key, length(prefix) + 1, 3)").alias("bin")).agg(F.sum("size").alias("w"), F.min(F.substring("key", 1, COORDINATE_HEX + GROUP_HEX)).alias("a"), F.max(F.substring("key", 1, COORDINATE_HEX + GROUP_HEX)).alias("b"))
        seen: dict[int, list] = {}
        for r in bins.collect():
            seen.setdefault(r["node"], []).append((r["bin"], r["w"], r["a"], r["b"]))
        for node in list(state):
            dim, prefix, need = state[node]
            for name, w, a, b in sorted(seen[node]):
                if w < need:
                    need -= w
                    continue
                whole = w <= tolerance * target or len(prefix + name) >= COORDINATE_HEX + 2 * GROUP_HEX
                if whole:
                    cuts[node] = (dim, prefix + name if need < w / 2 else prefix + name + "~")
                    del state[node]
                elif a == b and len(prefix + name) < len(a):
                    state[node] = [dim, a, need]
                else:
                    state[node] = [dim, prefix + name, need]
                break
            else:
                cuts[node] = (dim, "~")
                state.pop(node, None)
    return cuts


def kd_shards(documents: DataFrame, shards: int | None = None, target_bytes: int | None = None, tolerance: float = 0.0025) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 ..), slot (gapless from 0 in its shard).

    Give the number of shards, or the bytes a shard should reach at most. A group of equal
    texts, or a single text, is cut only where it weighs over ``tolerance`` of a shard.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "shards")
    rows = scratch.save(_meta(documents, scratch).withColumn("node", F.lit(0).cast("long")), "level0")
    scratch.drop("rows", "groups")
    total = rows.agg(F.sum("size").alias("w")).first()["w"] or 0
    leaves = shards or max(1, -(-total // target_bytes))
    nodes, level = {0: (0, leaves)}, 0
    while any(n > 1 for _, n in nodes.values()):
        cuts = _cut_nodes(spark, rows, nodes, total / leaves, tolerance)
        following, plan = {}, []
        for node, (first, n) in nodes.items():
            if n == 1:
                following[2 * node] = (first, 1)
                continue
            following[2 * node], following[2 * node + 1] = (first, n // 2), (first + n // 2, n - n // 2)
            if node in cuts:
                plan.append((node, *cuts[node]))
        asked = spark.createDataFrame(plan, "node long, dim int, cut string")
        right = F.col("cut").isNotNull() & (F.concat(F.get(F.col("at"), F.coalesce("dim", F.lit(0))), F.col("tail")) >= F.col("cut"))
        rows = rows.join(F.broadcast(asked), "node", "left").withColumn("node", F.col("node") * 2 + F.coalesce(right, F.lit(False)).cast("long")).drop("dim", "cut")
        nodes, level = following, level + 1
        if level % 4 == 0:
            rows = scratch.save(rows, f"level{level}")
            scratch.drop(f"level{level - 4}")
    names = spark.createDataFrame([(n, first) for n, (first, _) in nodes.items()], "node long, shard int")
    placed = rows.join(F.broadcast(names), "node").select("doc_id", "size", "text_crc32", "shard")
    return rank_in_group(placed, ["shard"], F.xxhash64("doc_id", "text_crc32"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")


def shard_table(documents: DataFrame, shards: int = 16) -> DataFrame:
    """The placement with the law it keeps."""
    placed = kd_shards(documents, shards=shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
