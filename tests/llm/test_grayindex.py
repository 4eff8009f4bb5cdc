"""The Gray-order index against brute force, and fingerprints against a plain vote."""

import random

import xxhash

from eventloom.llm import grayindex


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    """The least print reachable, by search over all pairs."""
    part = {}
    for p in sorted(set(prints)):
        if p in part:
            continue
        part[p], todo = p, [p]
        while todo:
            at = todo.pop()
            for q in set(prints):
                if q not in part and (at ^ q).bit_count() <= radius:
                    part[q] = p
                    todo.append(q)
    return part


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def test_edges(edge_docs, empty_docs, edge_rows):
    rows = grayindex.simhash_classes(edge_docs).collect()
    prints = [(r[0], plain_print(r[1])) for r in edge_rows]
    part = plain_components([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[part[p]] = min(i, least.get(part[p], i))
    want = [(i, f"{p:016x}", least.get(part[p])) for i, p in prints]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    assert grayindex.simhash_classes(empty_docs).count() == 0
    kept = grayindex.keep_one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(6) == 1 and not {7, 9} & set(ids) and {1, 2, 3} <= set(ids) and ids.count(None) == 1
    assert grayindex.keep_one_of_each(empty_docs).count() == 0


def test_long_text_and_ties():
    text = "One two  THREE four\tone two three four " * 30_000
    assert grayindex.majority(grayindex.shingle_hashes(text)) == plain_print(text)
    for t in ("a", "a b", "a b c", "a b c d", "É é", "", None, " \n"):
        assert grayindex.majority(grayindex.shingle_hashes(t)) == plain_print(t)


def test_gray_rank(spark):
    from pyspark.sql import functions as F

    codes = [k ^ (k >> 1) for k in range(64)] + [(1 << 64) - 1, 1 << 63, (1 << 63) + 5]
    got = [r[0] for r in spark.createDataFrame([(signed(c),) for c in codes], "fp long").select(grayindex.gray_rank(F.col("fp"))).collect()]

    def rank(c):
        out = 0
        while c:
            out, c = out ^ c, c >> 1
        return out - (1 << 63)

    assert got == [rank(c) for c in codes] and got[:64] == sorted(got[:64])


def test_links_join_what_brute_force_joins(spark):
    rng = random.Random(11)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):  # clouds of near prints, chains, and prints apart
        centre = rng.getrandbits(64)
        cloud = [centre]
        for _ in range(rng.choice([0, 3, 30])):
            cloud.append(rng.choice(cloud) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        prints |= set(cloud)
    low = rng.getrandbits(64)
    prints |= {low ^ k for k in range(256)}  # a full cube
    prints = sorted(prints)
    rows = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(3)
    for group, fanout, top in ((64, 16, 64), (8, 4, 2), (1, 2, 1)):
        links = [(a % (1 << 64), b % (1 << 64)) for a, b in grayindex.near_links(rows, 2, group, fanout, top).collect()]
        assert all(a != b and (a ^ b).bit_count() <= 2 for a, b in links)
        part = {p: p for p in prints}

        def find(p, part=part):
            while part[p] != p:
                p = part[p]
            return p

        for a, b in links:
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
        want = plain_components(prints)
        assert {p: find(p) for p in prints} == want
    pairs = grayindex.near_nodes(grayindex.index(rows, s := grayindex.Scratch(spark, "t"), 8, 4, 2)[1], s)
    n = -(-len(prints) // 8)
    assert pairs.count() < n * (n + 1) / 2 / 2  # whole groups are pruned
