"""Extension points: typed answers, defaults, retries and time budgets; maintenance of stored days."""

import json
import time

from pyspark.sql import functions as F

from eventloom import session
from eventloom.operators import aggregates, extract, filters, ranking, resolve
from eventloom.sources import feeds, store


def _items(spark, n=6):
    return spark.createDataFrame([(i, f"t{i}", f"s{i}") for i in range(n)], "seq long, title string, summary string").coalesce(1)


def test_answers_join_by_index():
    assert extract.by_index([{"idx": "1", "x": 5}, {"idx": 0, "x": 4}, {"x": 9}, "odd", {"idx": 7}], 3) == [{"idx": 0, "x": 4}, {"idx": "1", "x": 5}, {}]
    assert extract.by_index("no list", 2) == [{}, {}]


def test_classify(spark):
    def model(rows):
        if any(r["title"] == "t3" for r in rows):
            raise RuntimeError("refused")
        return [{"idx": i, "is_ai": r["title"] != "t1", "category": "cybersecurity" if r["title"] == "t0" else "odd", "reason": "r" * 200} for i, r in enumerate(rows) if r["title"] != "t5"]

    out = {r["seq"]: (r["is_ai"], r["category"], len(r["classify_reason"])) for r in extract.classify(_items(spark), model, batch=4).collect()}
    assert out == {0: (True, "cybersecurity", 80), 1: (False, "none", 80), 2: (True, "uncategorized", 80), 3: (True, "uncategorized", 0), 4: (True, "uncategorized", 80), 5: (True, "uncategorized", 0)}


def test_rank_and_rewrite_and_tags(spark):
    ranked = extract.rank(_items(spark), lambda rows: [{"idx": 0, "keep": rows[0]["title"] != "t0", "importance": "9", "reason": "x" * 90}, {"idx": 1, "importance": "high"}], batch=3).collect()
    assert {r["seq"]: (r["importance"], len(r["quality_reason"])) for r in ranked} == {1: (5, 0), 2: (5, 0), 3: (9, 60), 4: (5, 0), 5: (5, 0)}
    new = extract.rewrite(_items(spark, 3), lambda xs: [x.upper() if x != "s1" else " " for x in xs])
    twice = extract.rewrite(new, lambda xs: [x + "!" for x in xs]).orderBy("seq").collect()
    assert [(r["summary"], r["summary_original"]) for r in twice] == [("S0!", "s0"), ("s1!", "s1"), ("S2!", "s2")]

    def tagger(rows):
        if any(r["title"] == "t2" for r in rows):
            raise RuntimeError("refused")
        return [{"idx": i, "tags": ["IPO", "zeroday", "odd"]} for i in range(len(rows))]

    tags = {r["seq"]: r["tags"] for r in extract.tag_events(_items(spark, 4), tagger).collect()}
    assert tags == {0: ["ipo", "zero_day"], 1: ["ipo", "zero_day"], 2: None, 3: ["ipo", "zero_day"]}


def test_texts_have_two_attempts_and_a_budget(spark):
    events = _items(spark, 4).withColumn("full_content", F.when(F.col("seq") == 3, "there"))

    def model(prompt, temperature):
        if prompt.startswith("t0"):
            return "好的，\n" + "x" * 400 if temperature > 0.4 else "short"
        if prompt.startswith("t1"):
            raise RuntimeError("refused")
        return "weak"

    out = {r["seq"]: (r["full_content"], r["text_source"]) for r in extract.write_texts(events, model).collect()}
    assert out == {0: ("x" * 400, "model"), 1: ("s1", "summary"), 2: ("weak", "model"), 3: ("there", "kept")}

    def slow(prompt, temperature):
        time.sleep(0.2)
        return "y" * 400

    late = extract.write_texts(events, slow, seconds=0.1).collect()
    assert sorted(r["text_source"] for r in late) == ["deadline", "deadline", "kept", "model"]


def test_covers(spark):
    rows = _items(spark, 2).withColumn("category", F.lit("ipo")).withColumn("cover_image", F.struct(F.lit("remote").alias("kind"), F.when(F.col("seq") == 0, "http://x").alias("url")))
    assert [tuple(r["cover_image"]) for r in extract.with_covers(rows).orderBy("seq").collect()] == [("remote", "http://x", None), ("fallback", None, "ipo")]
    mine = extract.with_covers(rows, lambda f: f.concat(f.lit("c"), f.col("seq")))
    assert [r["cover_image"] for r in mine.orderBy("seq").collect()] == ["c0", "c1"]


def test_names_as_text(spark):
    raw = spark.createDataFrame([(1, "t", "s", "ipo", "7.9", "A、B / C", None, None, ["x"])], "seq long, title string, summary string, category string, importance string, who string, what string, `when` string, tags array<string>")
    r = extract.normalize_events(raw).first()
    assert (r["who"], r["importance"], r["category"]) == (["A", "B", "C"], 7, "uncategorized")


def _docs(spark, day, n=3):
    rows = [(f"e{i}", i, f"t{i}", "cybersecurity", "Security", 5 + i, 1, ["ipo"], i == 0, "") for i in range(n)]
    df = spark.createDataFrame(rows, "event_id string, seq long, title string, category string, category_label string, importance int, mention_count int, tags array<string>, is_top boolean, full_content string")
    return df.withColumn("date", F.lit(day).cast("date"))


def test_maintenance(spark, tmp_path):
    s = store.EventStore(spark, str(tmp_path / "s"))
    s.write_days(_docs(spark, "2026-11-18").unionByName(_docs(spark, "2026-11-19")))
    untouched = {p.name for p in (tmp_path / "s/events/date=2026-11-18").rglob("*")}
    changes = s.day("2026-11-19").where("event_id = 'e1'").select("date", "event_id", F.lit("new").alias("full_content"))
    s.update_columns(changes, ["full_content"])
    assert {r["event_id"]: r["full_content"] for r in s.day("2026-11-19").collect()} == {"e0": "", "e1": "new", "e2": ""}
    assert {p.name for p in (tmp_path / "s/events/date=2026-11-18").rglob("*")} == untouched
    assert [r["importance"] for r in s.ranged("2026-11-18", "2026-11-19").limit(2).collect()] == [7, 6]
    for p in (tmp_path / "s/events/date=2026-11-18").rglob("*.parquet"):
        p.write_bytes(b"broken")
    for p in (tmp_path / "s/events/date=2026-11-18").rglob(".*.crc"):
        p.unlink()
    assert s.day("2026-11-18") is None and s.day("2026-11-17") is None and s.day("2026-11-19").count() == 3


def test_json_files(spark, tmp_path):
    store.write_json(_docs(spark, "2026-11-18"), str(tmp_path / "out"))
    read = lambda name: [json.loads(x) for p in (tmp_path / "out" / name).glob("*.json") for x in p.read_text().splitlines()]
    assert len(read("db")) == 3 and [r["event_id"] for r in read("top")] == ["e0"]
    assert read("db_head") == [{"total": 3, "by_category_label": {"Security": 3}}]
    (tmp_path / "db_2026-05-20.json").write_text('[{"event_id": "a"}, {"event_id": "b"}]')
    (tmp_path / "top_2026-05-20.json").write_text('[{"event_id": "b"}]')
    rows = store.import_json_days(spark, str(tmp_path / "db_*.json"), str(tmp_path / "top_*.json")).collect()
    assert {r["event_id"]: r["is_top"] for r in rows} == {"a": False, "b": True}


def test_branches_fail_alone(spark):
    def broken():
        raise OSError("unreachable")

    found, failed = feeds.union_isolated({"a": lambda: spark.range(2).toDF("x"), "b": broken, "c": lambda: spark.range(3).toDF("y")}, only=["a", "b", "c"])
    assert found.count() == 5 and set(found.columns) == {"x", "y"} and list(failed) == ["b"]
    assert feeds.window_of_days(6) == "daily" and feeds.window_of_days(7) == "weekly"
    rows = spark.createDataFrame([("vendor",), ("media",)], "source_kind string")
    assert feeds.of_kinds(rows, ["media"]).count() == 1 and feeds.of_kinds(rows, None).count() == 2


def test_pager_and_budget():
    assert ranking.pager(95, 1, 10) == {"pages": 10, "page": 1, "shown": [1, 2, 3, 4, 5]}
    assert ranking.pager(95, 99, 10) == {"pages": 10, "page": 10, "shown": [6, 7, 8, 9, 10]}
    assert ranking.pager(95, 6, 10)["shown"] == [4, 5, 6, 7, 8] and ranking.pager(0, 3, 10) == {"pages": 1, "page": 1, "shown": [1]}
    assert ranking.affordable() == 48 and ranking.affordable(5000) == 0


def test_forced_covers(spark):
    rows = spark.range(1).withColumn("cover_image", F.struct(F.lit("local").alias("kind"), F.lit("u").alias("url")))
    asked = rows.select(filters.needs_cover().alias("a"), filters.needs_cover(True).alias("b"), filters.needs_cover(kinds=("remote",)).alias("c")).first()
    assert tuple(asked) == (False, True, True)


def test_event_keys(spark):
    rows = [(1, "Acme | Launch", "first", 3, "S1/S2"), (2, "acme｜launch", "head", 9, "S3"), (3, " acme|launch ", "third", 9, "S1"), (4, "vague", "x", 5, "S1"), (5, None, "y", 5, None)]
    df = spark.createDataFrame(rows, "seq long, event_key string, title string, importance int, source_name string")
    out = {r["head_seq"]: r for r in aggregates.event_key_clusters(df, most_names=2).collect()}
    assert set(out) == {2, 4, 5}
    assert (out[2]["n"], out[2]["sources"], out[2]["others"]) == (3, "S1 / S2 +1", ["first", "third"])
    assert out[5]["sources"] == "" and resolve.WIDTH == 45


def test_scratch_is_cleared(spark):
    kept = session.Scratch(spark, "trial")
    kept.save(spark.range(3), "x")
    other = session.Scratch(spark, "trial")
    assert kept.base != other.base and spark.read.parquet(f"{kept.base}/x").count() == 3
    kept.drop("x")
    assert session._SCRATCH.search(kept.base)
