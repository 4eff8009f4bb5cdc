"""Cases of the third round's findings."""

import datetime
import random

from oracle_tool import compare
from pyspark.sql import functions as F

from eventloom.functions import text
from eventloom.operators import resolve, similarity, trending
from eventloom.plans import registry

LARGER = "/root/testdata/sf0.01"


def test_windows_follow_what_the_judge_compares(spark):
    """Titles of two starts that alternate in normalised order, more than a window apart from their like."""
    titles = [("Ab" if k % 60 == 0 else "ab") + f"{k:04d}" for k in range(300)]
    rows = spark.createDataFrame(list(enumerate(titles)), "seq long, title string")

    def judge(frame):
        seen = {}
        for k, t in enumerate(frame["title"]):
            seen.setdefault(t[:2], []).append(k)
        return list(seen.values())

    got = {r["seq"]: r["cluster"] for r in resolve.global_windows(rows, judge, by=F.col("title")).collect()}
    assert got == {k: 0 if k % 60 == 0 else 1 for k in range(300)}


def test_global_adjudication_on_larger_tables(spark):
    assert compare(registry.QUERIES["global_adjudication"](spark, LARGER), registry.ORACLES["global_adjudication"], LARGER) == ""


def test_entities_of_the_present_count(spark):
    """An entity without recent days, one with them, one known to the baseline and one too short."""
    today = datetime.date(2024, 3, 1)
    day = lambda n: today - datetime.timedelta(days=n)
    history = spark.createDataFrame([("old", "a", day(20)), ("warm", "a", day(2)), ("ancient", "a", day(40))], "entity string, source string, date date")
    events = spark.createDataFrame([(1, ["Fresh"], ["x"]), (2, ["fresh", "warm"], ["y"]), (3, ["old"], ["z"]), (4, ["ab"], ["z"]), (5, ["ancient"], [None])], "seq long, who array<string>, sources array<string>")
    hits = trending.recent_hits(trending.named_entities(events), history, today)
    got = {r["entity"]: (r["sources"], r["days"]) for r in trending.trending_entities(trending.with_current(hits, events, history, today)).collect()}
    assert got == {"fresh": (2, 1), "warm": (2, 2), "ancient": (1, 1)}


def _alike(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0


def _rows(seed, n, letters, width):
    rng = random.Random(seed)
    return [(i, rng.sample(letters, rng.randint(0, width))) for i in range(n)]


def test_set_join_of_many_tokens_across_blocks(spark):
    """More tokens than a signature tells apart, hot ones among them, and blocks of a few rows."""
    rng = random.Random(5)
    rows = [(i, ["hot"] * (i % 3 > 0) + [f"w{rng.randrange(40)}" for _ in range(6)] + [f"r{i}-{k}" for k in range(i % 7)]) for i in range(160)]
    got = [(r["a"], r["b"], round(r["sim"], 9)) for r in similarity.set_join(spark.createDataFrame(rows, "id long, tokens array<string>"), 0.3, block=20).collect()]
    want = [(a, b, round(_alike(x, y), 9)) for a, x in rows for b, y in rows if a < b and _alike(x, y) >= 0.3 - 1e-12]
    assert sorted(got) == sorted(want) and len({t for _, x in rows for t in x}) > similarity.FEW


def test_set_join_makes_no_rows_of_pairs_that_are_not_alike(spark):
    """Pairs are decided in arrays: no row of the plan holds a candidate."""
    plan = similarity.set_join(spark.createDataFrame(_rows(6, 20, "abcdef", 4), "id long, tokens array<string>"), 0.5)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "array_intersect" not in plan


def test_pairs_and_components_of_copies(spark):
    rows = [(i, "".join(t)) for i, t in _rows(7, 90, "abcde", 4)]
    df = spark.createDataFrame(rows, "id long, title string")
    want = {(a, b): _alike(x, y) for a, x in rows for b, y in rows if a < b and _alike(x, y) >= 0.65}
    got = similarity.like_pairs(df, text.char_set("title"), 0.65).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["sim"] for r in got} == want
    found = {r["id"]: r["component"] for r in similarity.like_components(df, text.char_set("title"), 0.65).collect()}
    assert set(found) == {k for p in want for k in p} and all(found[a] == found[b] for a, b in want) and all(c <= k for k, c in found.items())


def test_candidate_edges_of_copies_and_several_entities(spark):
    """Copies, two shared entities (a pair is told once) and words of the rule."""
    rng = random.Random(8)
    names, words = ["zeta", "eta", "theta"], ["veo x", "veo long and other", "ipo q", "ipo wxyzjkh", "abc", ""]
    rows = [(i, rng.choice(words) + rng.choice(["", "mnop", "rst"]), rng.sample(names, rng.randint(0, 3))) for i in range(60)]
    got = [(r["a"], r["b"]) for r in similarity.candidate_edges(spark.createDataFrame(rows, "id long, title string, who array<string>")).collect()]
    want = set()
    for a, s, p in rows:
        for b, t, q in rows:
            sim = _alike(s.replace(" ", ""), t.replace(" ", ""))
            both = lambda w: w in s and w in t  # noqa: B023, E731
            if a < b and (sim >= 0.65 or (set(p) & set(q) and (sim >= 0.2 or (both("ipo") and sim >= 0.18) or both("veo")))):
                want.add((a, b))
    assert len(got) == len(set(got)) and set(got) == want


def test_texts_do_not_travel_for_single_words(spark):
    """What texts tell of single words and of longer names, once each."""
    texts = [(1, "Alpha x1", "s"), (2, "alpha ALPHA", "s"), (3, "alphas alpha-beta", "t"), (4, None, "t")]
    asked = spark.createDataFrame([("alpha",), ("alpha-beta",), ("x1",), ("lph",)], "entity string")
    got = trending.history_told(asked, spark.createDataFrame(texts, "text_id long, text string, source string"), ["source"]).collect()
    assert sorted((r["entity"], r["source"]) for r in got) == [("alpha", "s"), ("alpha", "t"), ("alpha-beta", "t"), ("x1", "s")]


def test_keys_of_fingerprint_queries_are_not_broadcast(spark):
    """Each query asks by hundreds of keys, which go to no driver, however few the queries seem."""
    from eventloom.llm import fingerprints

    df = spark.createDataFrame([("0" * 64,), ("f" * 64,)], "fingerprint string")
    met = fingerprints.near_fingerprints(df, df)
    assert len(met.collect()) == 2 and "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()


def test_shuffles_end_with_a_written_table(spark):
    """Files of a shuffle go with the write that made them, without a garbage collection."""
    import time
    from pathlib import Path

    from eventloom.session import Scratch

    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    held = lambda: {f.name for d in folders for f in Path(d.toString()).rglob("shuffle_*")}
    earlier = held()
    saved = Scratch(spark, "ends").save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")), "x")
    for _ in range(50):
        if not held() - earlier:
            break
        time.sleep(0.1)
    assert not held() - earlier and saved.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_sent_shingles_take_few_bytes():
    """Ten bytes, instead of twenty, of each of a quarter, instead of a third, of a set's shingles."""
    import pyarrow as pa

    from eventloom.llm import jaccard

    texts = [" ".join(f"w{k}x{i}" for i in range(400)) for k in range(50)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(50), pa.int64()), "text": texts, "row": pa.array(range(50), pa.int64())})
    sent = [b for b in jaccard._send(jaccard.Rule(4, 85, 100), 16)(iter([batch]))]
    size = sum(len(x or b"") for b in sent for c in ("tokens", "keys", "counts") for x in b.column(c).to_pylist())
    assert 0 < size <= 50 * 400 * 0.26 * 10
    known = pa.Table.from_batches(jaccard._known(16)(iter(sent))).to_pylist()
    assert sum(r["n"] is not None for r in known) == 50 and not [r for r in known if r["token"] is not None]
