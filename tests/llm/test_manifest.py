"""The Merkle manifest against a plain tree, and on the edge rows."""

import hashlib
import random
import zlib

import pytest

from eventloom.llm import manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[k : k + 16])) for k in range(0, len(now), 16)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((run[: i % 16], run[i % 16 + 1 :]))
        i //= 16
    return out


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 4095, 4097])
def test_traversal(n):
    leaf = [sha(str(k)) for k in range(n)]
    levels = plain_tree(leaf)
    for i, path in enumerate(manifest.traverse(leaf, manifest.levels_of(n))):
        assert path == plain_path(levels, i)
        assert manifest.fold(leaf[i], path) == levels[-1][0]


def test_traversal_memory():
    """A treehash stack holds less than a run for each level, whatever the leaves."""
    tree = manifest._Treehash(3)
    for k in range(16**4):
        tree.push(str(k))
        assert len(tree.run) <= 16 and all(len(x) < 16 for x in tree.below)
    assert len(tree.close()) == 16


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    trees = {}
    for i, text, lang, source, chars in rows:
        leaf = lambda t: sha("".join(map(field, (i, source, lang, chars, t))))
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        trees.setdefault(source, []).append((i, leaf(text), leaf(low(text)) if hit else None))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or ""))
        below[s] = plain_tree([r[1] for r in trees[s]])
    above = plain_tree([below[s][-1][0] for s in order])
    root, out = above[-1][0], []
    for k, s in enumerate(order):
        for j, (i, leaf, other) in enumerate(trees[s]):
            path = plain_path(below[s], j) + plain_path(above, k)
            node = other or leaf
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            out.append((i, leaf, below[s][-1][0], root, sha("".join(x for p in path for side in p for x in side)), node, node == root))
    return out


def same(df, rows):
    return sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, plain_manifest(rows)))


def test_edges(edge_docs, empty_docs, edge_rows):
    assert same(manifest.manifest_report(edge_docs), edge_rows)
    assert manifest.manifest_report(empty_docs).count() == 0


@pytest.mark.parametrize("levels", [1, 2])
def test_against_plain_trees(spark, levels):
    rng = random.Random(3)
    rows = [(rng.randrange(900), rng.choice(["Ab", "é", "", None]), None, rng.choice([None, "", "hot", "hot", "hot", *(f"s{k}" for k in range(40))]), k) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    from pyspark.sql import functions as F

    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    assert same(manifest.manifest(docs, hit, manifest.ascii_lower(F.col("text")), levels), rows)


def test_one_row(spark):
    docs = spark.createDataFrame([(7, "x", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = manifest.manifest(docs).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == sha("")
