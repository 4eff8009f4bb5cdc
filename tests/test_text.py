"""Text functions against plain Python models and fixtures."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.functions import dicts, text

MIXED = st.text(alphabet="abC's ,.-'’!AI4é漢字的台。　\t", max_size=24)


def model_norm(s):
    return re.sub(dicts.PUNCTUATION, "", re.sub(r"['’]s\b", "", s.lower()))


def model_shingles(s, n=4):
    s = model_norm(s)
    return {s} - {""} if len(s) <= n else {s[i : i + n] for i in range(len(s) - n + 1)}


def model_words(s):
    out = set()
    for t in re.sub(r"[^\w一-鿿]+", " ", re.sub(r"['’]s\b", "", s.lower())).split():
        if t.isascii():
            out |= {t} if len(t) >= 3 and t not in dicts.STOPWORDS else set()
        else:
            out |= {t[i : i + 2] for i in range(len(t) - 1)}
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(MIXED, min_size=30, max_size=60))
def test_normalisers_and_sets(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "s string").select("s", text.norm_title("s").alias("n"), text.char_shingles("s").alias("g"), text.word_set("s").alias("w")).collect()
    for r in rows:
        assert r["n"] == model_norm(r["s"])
        assert set(r["g"]) == model_shingles(r["s"]) and len(r["g"]) == len(set(r["g"]))
        assert set(r["w"]) == model_words(r["s"])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dates(spark):
    cases = {"近期": None, "Recently": None, "2026-11-19": "2026-11-19", "2026/1/9": "2026-01-09", "於 2026年11月5日 發布": "2026-11-05", "2026-13-01": None, "": None, "2026.02.30": None, "2026-11-19T08:00": "2026-11-19"}
    for raw, want in cases.items():
        got = one(spark, text.fuzzy_date(F.lit(raw)))
        assert (str(got) if got else None) == want, raw


def test_counts_and_numbers(spark):
    for raw, want in {"1.2k": 1200.0, "3,400": 3400.0, "2M": 2e6, "": 0.0, "77": 77.0, "abc": 0.0, "5 K": 5000.0}.items():
        assert one(spark, text.parse_count(F.lit(raw))) == want
    for raw, want in {999: "999", 1000: "1K", 1250: "1.3K", 204450: "204.4K", 3_000_000: "3M", 0: "0"}.items():
        assert one(spark, text.compact_number(F.lit(raw))) == want


def test_relative_days(spark):
    for raw, want in {"Updated 2 hours ago": 2 / 24, "an hour ago": 1 / 24, "yesterday": 1.0, "3 weeks ago": 21.0, "a month ago": 30.0, "2 years ago": 730.0, "just now": 0.0, "": 0.0, "who knows": 9999.0}.items():
        assert abs(one(spark, text.relative_days(F.lit(raw))) - want) < 1e-9, raw


def test_entities(spark):
    assert one(spark, text.align_entity(F.lit("Facebook Inc."))) == "meta"
    assert one(spark, text.align_entity(F.lit("Claude"))) == "anthropic"
    assert one(spark, text.align_entity(F.lit("Acme's"))) == "acme"
    assert one(spark, text.align_entity(F.lit(""))) == "microsoft"  # an empty name is part of the first alias
    assert one(spark, text.fingerprint(F.array(F.lit("B"), F.lit("a"), F.lit("b ")), F.lit("Ships it!"))) == "a+b|shipsit"


def test_html_and_blocks(spark):
    assert one(spark, text.strip_html(F.lit("<p>a &amp;lt; b</p>　<i>c</i>&nbsp;"))).replace(" ", " ").strip() == "a &lt; b c"
    blocks = one(spark, text.content_blocks(F.lit("Head\n\nA sentence that ends！\nhttps://x.y"), F.lit("")))
    assert [b["t"] for b in blocks] == ["h", "p", "p"]
    assert one(spark, text.lead_paragraph(F.lit("a" * 200 + "." + "b" * 200), F.lit(""))) == "a" * 200 + "."
    assert one(spark, text.lead_paragraph(F.lit(""), F.lit(" short "))) == "short"
    assert one(spark, text.lead_paragraph(F.lit("b" * 400), F.lit(""))) == "b" * 320 + "…"
    assert one(spark, text.clean_generated(F.lit("以下是彙整：\n\n好的，開始\nBody one\n\n\n\nBody two  "))) == "Body one\n\nBody two"
    assert one(spark, text.published(F.lit("Tue, 03 Nov 2026 10:00:00 GMT"))).isoformat() == "2026-11-03T10:00:00"
    assert one(spark, text.published(F.lit("nonsense"))) is None
    assert tuple(one(spark, text.crop_box(F.lit(1024), F.lit(1024)))) == (0, 224, 1024, 576)


def test_covers_and_paths(spark):
    shape = lambda k, u, c: tuple(one(spark, text.cover(F.lit(k), F.lit(u), F.lit(c))))
    assert shape("remote", "https://x/y.jpg", "a") == ("remote", "https://x/y.jpg", None)
    assert shape("local", "./2026/a.jpg", "a") == ("local", "media/2026/a.jpg", None)
    assert shape("remote", "ftp://x", "a") == shape(None, None, "a") == ("fallback", None, "a")
    assert [one(spark, text.base_path(F.lit(x))) for x in ("", "/", "a/", "//a/b/")] == ["", "", "/a", "/a/b"]
    assert one(spark, text.versioned_url(F.lit("u"), F.lit("abc"))) == "u?v=a9993e36"
    assert str(one(spark, text.event_date(F.lit(None).cast("string"), F.lit("2026-11-03T10:00:00Z")))) == "2026-11-03"
    kinds = "array<struct<is_opensource:boolean,stars:string,pulls:string,downloads:bigint,likes:bigint,upvotes:bigint>>"
    rows = spark.createDataFrame([([(True, "1.2k", "", 900, None, 3), (False, "9M", "", 0, 0, 0)],), ([],), ([(True, None, None, None, None, None)],)], f"s {kinds}")
    got = [round(r["x"], 6) for r in rows.select(text.opensource_raw("s").alias("x")).collect()]
    assert got == [3.079543, 0.0, 0.30103]
