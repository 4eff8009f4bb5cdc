"""The source divergence audit against a plain version, on edge rows and with salted joins."""

import random
import re
from collections import Counter

import pytest

from eventloom.llm import divergence


def plain(rows, least=30, top=50):
    groups, held = {}, {}
    for text, lang, source in rows:
        lang, source, text = lang or "", source or "", text or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(words)
        held.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang, of in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def freq(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // total for t in kept}

        p = {s: freq(c) for s, c in of.items()}
        q = freq(sum(of.values(), Counter()))
        for s in of:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in of if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_edges(edge_docs, empty_docs, edge_rows):
    given = [(r[1], r[2], r[3]) for r in edge_rows]
    assert rows_of(divergence.divergence(edge_docs, 2)) == plain(given, 2)
    nothing = rows_of(divergence.divergence(edge_docs))
    assert nothing == plain(given) and {r[4] for r in nothing} == {0}
    assert divergence.divergence(empty_docs).count() == 0


@pytest.mark.parametrize("most_broadcast", [0, 100])
def test_plain(spark, most_broadcast):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcXYZéß漢") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = []
    for k in range(900):
        words = [vocab[int(rng.paretovariate(0.8)) % 150] for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice([" ", "-9", "\x00"]).join(words) or None, rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "a", "b", "ü", None])))
    rows += [("only", "xx", "one")] + [(None, "yy", s) for s in "abc"]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert rows_of(divergence.divergence(docs, 30, 7, most_broadcast)) == plain(rows, 30, 7)


def test_frequency_is_exact(spark):
    from pyspark.sql import functions as F

    pairs = [(5, 7), (9 * 10**14, 9 * 10**15), (10**15 + 1, 10**15 + 1), (123456789012345, 987654321098765), (1, 9 * 10**15)]
    got = spark.createDataFrame(pairs, "c long, t long").select(divergence.frequency(F.col("c"), F.col("t")).alias("p"), "c", "t").collect()
    assert all(r["p"] == 1 + 10**9 * r["c"] // r["t"] for r in got)
