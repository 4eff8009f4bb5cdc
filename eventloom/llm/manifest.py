"""Merkle manifest of a dataset: a tree over each source, a tree over the sources, a proof for each row.

A row's leaf is the hash of its fields; digests are hex text throughout. Leaves of a source
ascend by doc_id; every ``FANOUT`` consecutive nodes become the hash of their concatenation, until
one is left, the source's subroot; subroots in the order of their sources give the root alike.

Rows are numbered within their source by range partitions and dealt to aligned blocks of
``FANOUT ** LEVELS`` leaves, so that neither a source nor the table is one task's. In a block
the proofs are scheduled as a Merkle traversal: each level holds the run of nodes that are
siblings now, and a treehash stack that hashes the next run while the leaves of this one are
passed, a leaf a step; so a block is traversed with memory logarithmic in its size. Block roots
are hashed upwards level by level, and each block's upper path, shared by its leaves, is
appended to theirs.

Defined results: nulls are fields of their own (``-``), a null source comes first, null ids
come first in their source; rows of equal ids are ordered by their leaves, equal rows are
leaves of their own; a row whose source has one row is its subroot; an empty table has no rows
and no root; columns other than the five fields are unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.numbering import number_within
from eventloom.operators.skew import join_facts
from eventloom.session import Scratch

FANOUT, LEVELS = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, other letters as they are."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def _field(c: Column) -> Column:
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    """The leaf of a row, its fields given by name."""
    return F.sha2(F.concat(*[_field(fields[f]) for f in FIELDS]).cast("binary"), 256)


def leaves(documents: DataFrame, tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """(doc_id, source_key, leaf, other): ``other`` is the leaf with the text ``changed`` where ``tampered``, else null.

    ``source_key`` is never null and sorts as the sources do, a null one first.
    """
    own = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "n_chars": F.col("n_chars").cast("long"), "text": F.col("text").cast("string")}
    other = F.lit(None).cast("string")
    if tampered is not None and changed is not None:
        other = F.when(tampered, leaf_of(own | {"text": changed}))
    key = F.coalesce(F.concat(F.lit("s"), own["source"]), F.lit(""))
    return documents.select(own["doc_id"].alias("doc_id"), key.alias("source_key"), leaf_of(own).alias("leaf"), other.alias("other"))


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above ``n`` leaves."""
    depth = 0
    while n > 1:
        n, depth = -(-n // FANOUT), depth + 1
    return depth


class _Treehash:
    """Hashes leaves, one a step, into the nodes of one run at a level; a stack holds the unfinished runs below."""

    def __init__(self, level: int):
        self.level, self.run, self.below = level, [], [[] for _ in range(level)]

    def push(self, node: str, height: int = 0) -> None:
        while height < self.level:
            part = self.below[height]
            part.append(node)
            if len(part) < FANOUT:
                return
            node, self.below[height] = _hash(part), []
            height += 1
        self.run.append(node)

    def close(self) -> list[str]:
        """The run, once no leaf is left: unfinished runs become nodes, fewer than ``FANOUT`` as they are."""
        for height in range(self.level):
            if self.below[height]:
                node, self.below[height] = _hash(self.below[height]), []
                self.push(node, height + 1)
        return self.run


def _next_run(leaf: list[str], level: int, start: int) -> list[str]:
    """The run of nodes at ``level`` that begins with leaf ``start``."""
    tree = _Treehash(level)
    for node in leaf[start : start + FANOUT ** (level + 1)]:
        tree.push(node)
    return tree.close()


def traverse(leaf: list[str], depth: int) -> Iterator[list[tuple[list[str], list[str]]]]:
    """For each leaf in order, its path: the siblings to its left and to its right, from the lowest of ``depth`` levels.

    At each level the nodes of the present run are kept; the treehash of the level takes one leaf
    of the next run a step, which is then whole when it is needed.
    """
    now = [_next_run(leaf, level, 0) for level in range(depth)]
    ahead = [_Treehash(level) for level in range(depth)]
    for i in range(len(leaf)):
        path = []
        for level in range(depth):
            width = FANOUT**level
            if i and i % (width * FANOUT) == 0:
                now[level], ahead[level] = ahead[level].close(), _Treehash(level)
            at = i // width % FANOUT
            path.append((now[level][:at], now[level][at + 1 :]))
        yield path
        for level in range(depth):
            following = i + FANOUT ** (level + 1)
            if following < len(leaf):
                ahead[level].push(leaf[following])


def fold(node: str, path: list[tuple[list[str], list[str]]]) -> str:
    """The node that the path leads to."""
    for left, right in path:
        node = _hash([*left, node, *right])
    return node


def _depth_in_block(held: int, levels: int) -> int:
    return min(levels, levels_of(held))


def _block_roots(levels: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        held = table["held"][0].as_py()
        depth = _depth_in_block(held, levels)
        nodes = table["leaf"].to_pylist()
        if depth:
            nodes = [_hash(_next_run(nodes, depth - 1, 0))]
        return pa.table({"tree": [table["source_key"][0].as_py()], "idx": [table["block"][0].as_py()], "n": [-(-held // FANOUT**levels)], "node": nodes}, _NODE)

    return run


_NODE = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("node", pa.string())])
_PATH = "array<struct<left:string,right:string>>"


def climb(nodes: DataFrame, scratch: Scratch, label: str) -> tuple[DataFrame, DataFrame]:
    """Roots (tree, node) of the trees over ``nodes`` (tree, idx, n, node), and (tree, idx, path) of each node.

    ``n`` is how many nodes the tree has; levels are written once each, and paths are handed down
    from the roots, so that no key holds more than ``FANOUT`` rows.
    """
    levels = [scratch.save(nodes, f"{label}0")]
    while levels[-1].where("n > 1").head(1):
        kids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "node"))), lambda x: x["node"])
        runs = levels[-1].where("n > 1").groupBy("tree", F.floor(F.col("idx") / FANOUT).cast("long").alias("idx")).agg(F.max(F.ceil(F.col("n") / FANOUT).cast("long")).alias("n"), kids.alias("kids"))
        runs = runs.withColumn("node", F.sha2(F.array_join("kids", "").cast("binary"), 256))
        levels.append(scratch.save(runs, f"{label}{len(levels)}"))
    tops = [level.where("n = 1").select("tree", "node") for level in levels]
    roots = tops[0]
    for top in tops[1:]:
        roots = roots.unionByName(top)
    paths = levels[-1].select("tree", "idx", F.array().cast(_PATH).alias("path"))
    for k in range(len(levels) - 2, -1, -1):
        above = levels[k + 1].select("tree", F.col("idx").alias("_up"), "kids").join(paths.withColumnRenamed("idx", "_up"), ["tree", "_up"])
        own = levels[k].where("n > 1").select("tree", "idx", F.floor(F.col("idx") / FANOUT).cast("long").alias("_up"))
        at = (F.col("idx") % FANOUT).cast("int")
        step = F.struct(F.array_join(F.slice("kids", F.lit(1), at), "").alias("left"), F.array_join(F.slice("kids", at + 2, F.lit(FANOUT)), "").alias("right"))
        down = own.join(above, ["tree", "_up"]).select("tree", "idx", F.concat(F.array(step), "path").alias("path"))
        paths = down.unionByName(levels[k].where("n = 1").select("tree", "idx", F.array().cast(_PATH).alias("path")))
    return roots, paths


_ROW = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("source_key", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def _proofs(levels: int):
    def run(rows: pa.Table, upper: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _ROW.empty_table()
        rows = rows.sort_by("pos")
        above = [([p["left"]], [p["right"]]) for p in upper["path"][0].as_py()]
        shared = "".join(x for left, right in above for x in (*left, *right))
        leaf, other = rows["leaf"].to_pylist(), rows["other"].to_pylist()
        sums, folded = [], []
        for own, changed, path in zip(leaf, other, traverse(leaf, _depth_in_block(rows["held"][0].as_py(), levels)), strict=True):
            siblings = "".join(x for left, right in path for x in (*left, *right))
            sums.append(hashlib.sha256((siblings + shared).encode()).hexdigest())
            folded.append(fold(changed or own, path + above))
        return pa.table([rows["doc_id"], rows["leaf"], rows["source_key"], pa.array(sums, pa.string()), pa.array(folded, pa.string())], schema=_ROW)

    return run


def manifest(documents: DataFrame, tampered: Column | None = None, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row.

    ``folded_root`` is what the row's proof leads to, from its leaf or, where ``tampered``, from the
    leaf of the row with the text ``changed``; ``verified`` tells whether that is the root.
    """
    scratch = Scratch(documents.sparkSession, "manifest")
    rows = scratch.save(leaves(documents, tampered, changed), "leaves")
    placed = number_within(rows, "source_key", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "pos", "held", "manifest-order")
    placed = scratch.save(placed.withColumn("block", F.floor(F.col("pos") / FANOUT**levels).cast("long")), "placed")
    blocks = placed.select("source_key", "block", "pos", "held", "leaf").groupBy("source_key", "block").applyInArrow(_block_roots(levels), "tree string, idx long, n long, node string")
    subroots, upper = climb(blocks, scratch, "block")
    subroots = scratch.save(subroots, "subroots")
    ordered = number_within(subroots.withColumn("all", F.lit("")), "all", [F.col("tree")], "idx", "n", "manifest-sources")
    ordered = scratch.save(ordered.withColumnRenamed("tree", "source_key"), "ordered")
    root, over = climb(ordered.select(F.col("all").alias("tree"), "idx", "n", "node"), scratch, "source")
    facts = ordered.join(over.select("idx", F.col("path").alias("rest")), "idx").select("source_key", F.col("node").alias("subroot"), "rest")
    facts = scratch.save(facts.crossJoin(F.broadcast(root.select(F.col("node").alias("root")))), "facts")  # one root
    # Each block's path goes on with its source's; a source of many blocks is met by its blocks, not its rows.
    paths = upper.join(facts.select(F.col("source_key").alias("tree"), "rest"), "tree").select(F.col("tree").alias("source_key"), F.col("idx").alias("block"), F.concat("path", "rest").alias("path"))
    paths = scratch.save(paths, "paths")
    keys = ["source_key", "block"]
    proven = placed.select(*keys, "pos", "held", "doc_id", "leaf", "other").groupBy(*keys).cogroup(paths.groupBy(*keys)).applyInArrow(_proofs(levels), "doc_id long, leaf string, source_key string, proof_sha256 string, folded_root string")
    sizes = placed.groupBy("source_key").agg(F.count(F.lit(1)).alias("_held"))
    known = scratch.save(facts.select("source_key", "subroot", "root").join(sizes, "source_key"), "known")
    out = join_facts(scratch.save(proven, "proven"), known, "source_key", "_held", "inner")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def manifest_report(documents: DataFrame) -> DataFrame:
    """The manifest, with texts lower-cased (A-Z) behind its back where 5 divides the checksum of the id."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    return manifest(documents, F.coalesce(hit, F.lit(False)), ascii_lower(F.col("text").cast("string")))


def _oracle(below: int = 7, above: int = 5) -> str:
    """The same by levels: ``below`` levels above the leaves of a source, ``above`` above the subroots."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda t: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", t)) + ")"
    parts = [
        """bits AS (
  SELECT doc_id AS id, 4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
    lambda i: [CAST(ascii(substring(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
)""",
        f"""rows0 AS (
  SELECT d.doc_id, coalesce('s' || source, '') AS tree, {leaf("text")} AS leaf, CASE WHEN coalesce(crc % 5 = 0, false) THEN {leaf(low)} END AS other
  FROM documents d LEFT JOIN bits b ON d.doc_id = b.id
)""",
        """rows1 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows0
)""",
        "a0 AS (SELECT tree, pos AS idx, n, leaf AS node, NULL::VARCHAR[] AS kids FROM rows1)",
    ]

    def up(p: str, k: int) -> str:
        return f"""{p}{k} AS (
  SELECT tree, CASE WHEN n > 1 THEN idx // 16 ELSE idx END AS idx, max((n + 15) // 16) AS n,
    CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY idx)) ELSE max(node) END AS node, list(node ORDER BY idx) AS kids
  FROM (SELECT tree AS tree, idx, n, node FROM {p}{k - 1}) GROUP BY tree, CASE WHEN n > 1 THEN idx // 16 ELSE idx END
)"""

    parts += [up("a", k) for k in range(1, below + 1)]
    parts.append(f"sub AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM a{below})")
    parts.append("b0 AS (SELECT '' AS tree, idx, n, node, NULL::VARCHAR[] AS kids FROM sub)")
    parts += [up("b", k) for k in range(1, above + 1)]
    parts.append("f0 AS (SELECT r.*, sub.node AS subroot, sub.idx AS own, sub.n AS trees, coalesce(other, leaf) AS node, '' AS proof FROM rows1 r JOIN sub ON sub.tree = r.tree)")
    count = 0
    for p, depth, tree, place, held in (("a", below, "f.tree", "pos", "f.n"), ("b", above, "''", "own", "trees")):
        for k in range(1, depth + 1):
            w, v = 16 ** (k - 1), 16**k
            at = f"CAST({place} // {w} % 16 AS INTEGER)"
            many = f"({held} + {w - 1}) // {w} > 1"
            left, right = f"coalesce(array_to_string(kids[1:{at}], ''), '')", f"coalesce(array_to_string(kids[{at} + 2:], ''), '')"
            parts.append(f"""f{count + 1} AS (
  SELECT f.* EXCLUDE (node, proof), CASE WHEN {many} THEN sha256({left} || f.node || {right}) ELSE f.node END AS node, CASE WHEN {many} THEN proof || {left} || {right} ELSE proof END AS proof
  FROM f{count} f JOIN {p}{k} u ON u.tree = {tree} AND u.idx = {place} // {v}
)""")
            count += 1
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root.node AS root, sha256(proof) AS proof_sha256, f.node AS folded_root, f.node = root.node AS verified FROM f{count} f CROSS JOIN b{above} root"


ORACLE = _oracle()
