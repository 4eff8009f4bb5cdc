"""Stores, feeds and streams."""

import pytest
from pyspark.sql import functions as F

from eventloom.sources import feeds, store
from eventloom.streaming import streams


def _docs(spark, day, ids, importance=5):
    rows = [(f"e{i}", i, f"t{i}", "cybersecurity", importance, ["ai_agent"], i == ids[0]) for i in ids]
    df = spark.createDataFrame(rows, "event_id string, seq long, title string, category string, importance int, tags array<string>, is_top boolean")
    return df.withColumn("mention_count", F.lit(1)).withColumn("date", F.lit(day).cast("date"))


def test_store(spark, tmp_path):
    s = store.EventStore(spark, str(tmp_path / "store"))
    assert s.list_dates() == [] and s.range() is None and s.summaries() is None and s.history("2026-11-20").count() == 0
    s.write_days(_docs(spark, "2026-11-18", [1, 2]).unionByName(_docs(spark, "2026-11-19", [3])))
    s.write_days(_docs(spark, "2026-11-19", [4, 5]))
    s.write_days(_docs(spark, "2026-11-19", [4, 5]))  # a day twice is a day once
    assert s.list_dates() == ["2026-11-19", "2026-11-18"]
    assert {r["event_id"] for r in s.range().collect()} == {"e4", "e5"}
    assert s.range("2026-11-19", "2026-11-18").count() == 4 and s.day("2026-11-18").count() == 2
    assert s.history("2026-11-19", 30, ["event_id"]).columns == ["event_id"] and s.history("2026-11-19").count() == 2
    with pytest.raises(ValueError):
        s.range("19.11.2026")
    assert [(str(r["date"]), r["total_db"]) for r in s.summaries().collect()] == [("2026-11-19", 2), ("2026-11-18", 2)]
    s.import_missing(_docs(spark, "2026-11-19", [9]).unionByName(_docs(spark, "2026-11-17", [8])))
    assert s.list_dates()[-1] == "2026-11-17" and s.day("2026-11-19").count() == 2
    twice = _docs(spark, "2026-11-16", [1]).unionByName(_docs(spark, "2026-11-16", [1], 9).withColumn("seq", F.lit(2).cast("long")))
    s.write_days(twice, unique=True)
    assert [r["importance"] for r in s.day("2026-11-16").collect()] == [9]
    plan = s.range("2026-11-18", "2026-11-18")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    store.write_sheets(s.day("2026-11-16").withColumn("category_label", F.lit("x")).withColumn("summary", F.lit("")), str(tmp_path / "csv"))


def test_documents(spark):
    ev = spark.createDataFrame([("e1", 1, "t", "s", "cybersecurity", ["robotics"], 7, 2), ("e2", 2, "t", "s", None, None, None, None)], "event_id string, seq long, title string, summary string, category string, tags array<string>, importance int, mention_count int")
    out = {r["event_id"]: r for r in store.to_documents(ev, ev.limit(1), {"cybersecurity": "資訊安全"}, "2026-11-19").collect()}
    assert (out["e1"]["tags"], out["e1"]["tags_by"], out["e1"]["category_label"]) == (["robotics"], "extract", "資訊安全")
    assert (out["e2"]["tags"], out["e2"]["tags_by"], out["e2"]["category_label"], out["e2"]["mention_count"]) == ([], "none", "其他", 1)


def test_json_import(spark, tmp_path):
    (tmp_path / "db_2026-05-20.json").write_text('[{"title": "a"}, {"title": "b"}]')
    rows = store.import_json_days(spark, str(tmp_path / "db_*.json")).collect()
    assert [(r["title"], str(r["date"])) for r in rows] == [("a", "2026-05-20"), ("b", "2026-05-20")]


def test_feeds(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>http://x/1</link><description><![CDATA[<p>Hi</p>]]></description><pubDate>Tue, 03 Nov 2026 10:00:00 GMT</pubDate></item></channel></rss>"
    atom = '<feed><entry><title>C</title><link href="http://x/2"/><summary>S</summary><updated>2026-11-03T10:00:00Z</updated></entry></feed>'
    rows = feeds.parse_rss(spark.createDataFrame([("r", rss), ("a", atom), ("none", "")], "source_name string, body string")).orderBy("source_name").collect()
    assert [(r["title"], r["url"], r["summary"]) for r in rows] == [("C", "http://x/2", "S"), ("A & B", "http://x/1", "Hi")]
    assert all(r["published"] is not None for r in rows)


def test_pages(spark):
    html = '<meta content="The dek" property="og:description"><meta property="og:image" content="//img.x/y.png"><a href="/q">z</a>'
    df = spark.createDataFrame([(1, "https://a.b/c", html), (2, "https://a.b/c", '<meta name="twitter:image" content="/r.png">'), (3, "https://a.b/c", None)], "page_id long, url string, html string")
    rows = df.select("page_id", feeds.page_description().alias("d"), feeds.page_image().alias("i")).orderBy("page_id").collect()
    assert [(r["d"], r["i"]) for r in rows] == [("The dek", "https://img.x/y.png"), ("", "https://a.b/r.png"), ("", None)]
    lib = '<a href="/library/one" class="x">one · First 8b model</a> <a href="/library/two">' + "words " * 60 + '</a><a href="/library/one">again</a><a href="/library/last"> </a>'
    rows = feeds.library_page(df.limit(1).withColumn("html", F.lit(lib))).orderBy("pos").collect()
    assert [(r["title"], r["url"]) for r in rows] == [(f"[Ollama 新模型] {n}", f"https://ollama.com/library/{n}") for n in ("one", "two", "last")]
    assert rows[0]["summary"] == "First model <a" and rows[1]["summary"] == ("words " * 40).strip() + "…" and rows[2]["summary"] == "Ollama 新上架模型 last"
    box = '<article class="Box-row"><h2 class="h3"> <a data="1" href="/{}">x</a></h2><p class="col-9 x">{}</p><span itemprop="programmingLanguage">Rust</span> 1,234 stars today</article>'
    html = box.format("me / kit", "A <b>voice</b> kit") + box.format("me/todo", "Lists") + box.format("me/train", "") + "<article>" + box.format("a/llm", "x")[30:]
    rows = feeds.repo_pages(df.limit(1).withColumn("html", F.lit(html)), "daily").orderBy("pos").collect()
    assert [(r["title"], r["url"], r["summary"], r["stars"], r["lang"]) for r in rows] == [("[GitHub 今日熱門] me/kit", "https://github.com/me/kit", "Rust · 今日 +1,234 stars。A voice kit", "1,234", "Rust"), ("[GitHub 今日熱門] me/train", "https://github.com/me/train", "Rust · 今日 +1,234 stars", "1,234", "Rust")]
    assert all(r["source_name"] == "GitHub Trending" and r["is_opensource"] for r in rows)
    many = spark.createDataFrame([(k, box.format("me/ai", "x") * 3) for k in range(4)], "page_id long, html string")
    assert feeds.repo_pages(many, limit=2).count() == 8  # the limit is a page's


def test_feeds_that_differ(spark):
    rdf = '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><item><title>R &nbsp; &amp; D &rsquo;</title><link>http://x/3</link><dc:date>2026-11-03</dc:date></item></rdf:RDF>'
    full = '<rss xmlns:content="c"><channel><item><title><![CDATA[A <b>b</b>]]></title><link>http://x/4</link><content:encoded><![CDATA[<p>P & Q</p>]]></content:encoded></item><item><title/></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">T &lt;i&gt;x&lt;/i&gt;</title><link rel="self" href="http://x/no"/><link rel="alternate" href="http://x/5"/><summary type="xhtml"><div>in <b>y</b></div></summary></entry></feed>'
    given = spark.createDataFrame([("rdf", rdf), ("full", full), ("atom", atom), ("cut", full[:90]), ("empty", " "), ("none", None), ("text", "no feed")], "source_name string, body string")
    rows = {(r["source_name"], r["feed_pos"]): (r["title"], r["url"], r["summary"]) for r in feeds.parse_rss(given).collect()}
    assert rows == {("rdf", 0): ("R & D ’", "http://x/3", ""), ("full", 0): ("A b", "http://x/4", "P & Q"), ("full", 1): ("", None, ""), ("atom", 0): ("T x", "http://x/5", "in y")}
    assert {(r["source_name"], r["reason"]) for r in feeds.bad_feeds(given).collect()} == {("cut", "not well-formed"), ("empty", "empty"), ("none", "empty"), ("text", "not well-formed")}


def test_apis(spark):
    cut = F.to_timestamp(F.lit("2026-11-01"))
    m = spark.createDataFrame([("a/b", "2026-11-02T00:00:00Z", "text", 1234567, 5), ("old", "2026-01-01T00:00:00Z", "t", 1, 1), (None, "2026-11-02T00:00:00Z", "t", 1, 1), ("bad", "soon", "t", 1, 1)], "id string, createdAt string, pipeline_tag string, downloads long, likes long")
    line = "Hugging Face 熱門模型，任務類型：text；下載 1,234,567 次、likes 5。模型卡：https://huggingface.co/a/b"
    assert [(r["title"], r["summary"], r["source_name"]) for r in feeds.models_api(m, cut).collect()] == [("[HF Trending] a/b", line, "HuggingFace Trending")]
    p = spark.createDataFrame([("t", "2026-11-02T00:00:00Z", ("1", "P  t", "sum", "2026-10-03T00:00:00Z", 3)), ("alone", "2026-11-02T00:00:00Z", None)], "title string, publishedAt string, paper struct<id:string,title:string,summary:string,publishedAt:string,upvotes:long>")
    assert [(r["title"], r["url"], r["upvotes"]) for r in feeds.papers_api(p, cut).collect()] == [("[HF Paper] P  t", "https://huggingface.co/papers/1", 3), ("[HF Paper] alone", "https://huggingface.co/papers", 0)]
    g = spark.createDataFrame([("x", "X", "d", 1793600000, 4096, {"prompt": "1", "completion": "2"}), ("y", "Y", None, 1, 1, None), ("z", None, None, 1793600000, None, None)], "id string, name string, description string, created long, context_length long, pricing map<string,string>")
    assert [(r["title"], r["summary"]) for r in feeds.registry_api(g, cut).collect()] == [("[OpenRouter 新模型] X", "context=4,096 · price in=1/out=2。d"), ("[OpenRouter 新模型] z", "OpenRouter 上架模型 z")]


def test_bad_days_are_named_and_left_out(spark, tmp_path):
    s = store.EventStore(spark, str(tmp_path / "store"))
    s.write_days(_docs(spark, "2026-11-18", list(range(50))).unionByName(_docs(spark, "2026-11-19", [3, 4])))
    file = next((tmp_path / "store" / "events" / "date=2026-11-18").rglob("part-*.parquet"))
    whole = file.read_bytes()
    file.write_bytes(whole[: len(whole) // 2])
    assert s.bad_days() == ["2026-11-18"] and s.day("2026-11-18") is None and s.day("2026-11-19").count() == 2
    assert s.events().count() == 2 and s.range("2026-11-17", "2026-11-20").count() == 2 and s.rows_committed("2026-11-18") == 50
    change = _docs(spark, "2026-11-18", [1]).select("date", "event_id", F.lit(9).alias("importance"))
    with pytest.raises(store.ShortDay):
        s.update_columns(change, ["importance"])
    file.write_bytes(whole)  # the cause went: nothing was lost meanwhile
    assert s.bad_days() == [] and s.day("2026-11-18").count() == 50
    s.update_columns(change, ["importance"])
    assert s.day("2026-11-18").where("importance = 9").count() == 1 and s.day("2026-11-18").count() == 50
    made = s.regenerate(F.col("importance") < 6, lambda rows: rows.select("date", "event_id", F.lit("new").alias("title")), ["title"], "2026-11-18", "2026-11-19")
    assert made == 2 and sorted(r["event_id"] for r in s.events().where("title = 'new'").collect()) == ["e0", "e3"]
    assert s.clear_versions() > 0 and s.events().count() == 52 and s.bad_days() == []


def test_documents_and_summary_are_one_commit(spark, tmp_path):
    s = store.EventStore(spark, str(tmp_path / "store"))
    s.write_days(_docs(spark, "2026-11-18", [1, 2]))
    stage, publish = s._stage, s._publish

    def fails_at(which):
        def broken(*args):
            if which == "publish" or args[1] == s.summary_path:
                raise OSError("disk")
            stage(*args)

        return broken

    for name in ("_stage", "_publish"):
        setattr(s, name, fails_at(name[1:]))
        with pytest.raises(OSError):
            s.write_days(_docs(spark, "2026-11-18", [7]).unionByName(_docs(spark, "2026-11-19", [8])))
        s._stage, s._publish = stage, publish
        assert s.list_dates() == ["2026-11-18"] and {r["event_id"] for r in s.day("2026-11-18").collect()} == {"e1", "e2"}
        assert [(str(r["date"]), r["total_db"]) for r in s.summaries().collect()] == [("2026-11-18", 2)]
    late = s._commit()
    s.write_days(_docs(spark, "2026-11-19", [8]))
    with pytest.raises(RuntimeError):  # a second write from the same state doesn't undo the first
        s._publish(late | {"number": late["number"] + 1})
    assert s.list_dates() == ["2026-11-19", "2026-11-18"]
    empty = store.EventStore(spark, str(tmp_path / "none")).history("2026-11-20", 7, ["event_id", "date", "tags", "importance"])
    assert dict(empty.dtypes) == {"event_id": "string", "date": "date", "tags": "array<string>", "importance": "int"}


def test_streams(spark, tmp_path):
    s = store.EventStore(spark, str(tmp_path / "days"))
    src = str(tmp_path / "src")
    _docs(spark, "2026-11-18", [1, 2]).write.parquet(src)
    schema = spark.read.parquet(src).schema
    streams.write_day_stream(spark.readStream.schema(schema).parquet(src), s, str(tmp_path / "cp")).awaitTermination()
    _docs(spark, "2026-11-18", [3]).write.mode("append").parquet(src)
    streams.write_day_stream(spark.readStream.schema(schema).parquet(src), s, str(tmp_path / "cp")).awaitTermination()
    assert s.day("2026-11-18").count() == 3
    ts = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:10:00"), (1, "2026-01-01 02:00:00")], "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    assert streams.sessions(ts).count() == 2


def _stream(spark, path, rows, schema):
    """One file a batch, in order."""
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_entity_windows_by_batches(spark, tmp_path):
    """Several batches, repeated and late rows: the last row of each day is the plain count of all rows so far that came in time."""
    import datetime
    import random

    rng, start = random.Random(4), datetime.datetime(2026, 1, 1)
    batches = []
    for k in range(4):
        days = [rng.randint(12 * k, 12 * k + 14) for _ in range(60)]
        batches.append([(rng.choice("abc"), rng.choice(["s1", "s2", "s3", None]), start + datetime.timedelta(days=d, hours=rng.randint(0, 23))) for d in days])
    batches[1] += batches[1][:20]
    got = streams.latest_available(spark, streams.entity_windows(_stream(spark, str(tmp_path / "in"), batches, "entity string, source string, ts timestamp"), late="20 days"), "windows", ["entity", "day"]).collect()
    seen = {(e, s or "", t.date()) for b in batches for e, s, t in b}
    want = {}
    for e in "abc":
        for day in {d + datetime.timedelta(k) for x, _, d in seen if x == e for k in range(30)}:
            of = lambda a, b: len({s for x, s, d in seen if x == e and a <= (day - d).days < b})  # noqa: B023,E731
            want[e, day] = (of(0, 7), of(7, 30))
    assert {(r["entity"], r["day"]): (r["recent"], r["baseline"]) for r in got} == want


def test_late_rows(spark, tmp_path):
    import datetime

    t = lambda day: datetime.datetime(2026, 1, day)
    batches = [[(1, t(10)), (2, t(1))], [(3, t(8)), (4, t(9)), (5, None), (6, t(20))], [(7, t(18)), (8, t(19)), (9, t(2))]]
    root, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    stream = _stream(spark, str(tmp_path / "in"), batches, "id long, ts timestamp")
    streams.split_late(stream, root, trigger_checkpoint=cp).awaitTermination()
    read = lambda name: sorted(r["id"] for r in spark.read.schema("id long, ts timestamp").parquet(f"{root}/{name}").collect())
    assert read("late") == [3, 7, 9] and read("kept") == [1, 2, 4, 5, 6, 8]
    # A batch that is run again, its checkpoint lost, gives the same.
    streams.split_late(spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), root, trigger_checkpoint=str(tmp_path / "cp2")).awaitTermination()
    assert read("late") == [3, 7, 9] and read("kept") == [1, 2, 4, 5, 6, 8]
