"""Tags: cleaning, merging, rules and counts."""

from pyspark.sql import functions as F

from eventloom.functions import dicts, tagging
from eventloom.operators import aggregates


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lits(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def test_dictionary():
    assert len(dicts.TAG_IDS) == 56 == len(set(dicts.TAG_IDS)) and [len(v) for v in dicts.TAG_GROUPS.values()] == [14, 2, 9, 7, 6, 9, 9]
    assert set(dicts.TAG_ALIASES.values()) <= set(dicts.TAG_IDS) and len(dicts.TAG_ALIASES) == 39


def test_spec(spark):
    rows = [("b", 2, "g1", "B", "second", None), ("a", 1, "g1", "A", "first", False), ("c", 3, "g2", "C", None, False), ("d", 4, "g2", "D", "old", True)]
    out = {r["grp"]: r["spec"] for r in tagging.tag_spec(spark.createDataFrame(rows, "tag string, pos int, grp string, label string, descr string, deprecated boolean")).collect()}
    assert out == {"g1": "- a (A): first\n- b (B): second", "g2": "- c (C): "}


def test_normalize(spark):
    assert one(spark, tagging.normalize_tags(lits(" IPO", "ipo", "nothing like it", "zeroday", "breach", "privacy"))) == ["ipo", "zero_day", "data_breach"]
    assert one(spark, tagging.normalize_tags(tagging.split_tags(F.lit("privacy；ipo|earnings")))) == ["privacy", "ipo", "earnings"]
    assert one(spark, tagging.normalize_tags(F.lit(None).cast("array<string>"))) == [] == one(spark, tagging.normalize_tags(lits()))
    assert one(spark, tagging.normalize_tags(lits("Data Breach", "Open-Source", "made_up"))) == ["data_breach", "open_source"]


def test_merge(spark):
    merged = tagging.merge_tags(F.array(lits("ipo", "privacy"), lits("earnings", "ipo"), lits("earnings", "education")))
    assert one(spark, merged) == ["ipo", "earnings", "privacy"]
    assert one(spark, tagging.merge_tags(F.array(lits(), lits()))) == []


RULES = [("alpha", 1, "keyword", "red"), ("alpha", 2, "keyword", "blue"), ("beta", 3, "keyword", "gre+n"), ("beta", 4, "exclude", "evergreen"), ("gamma", 5, "keyword", r"\bsky\b"), ("delta", 6, "keyword", "sea")]


def test_rules(spark):
    rules = tagging.load_rules(spark.createDataFrame(RULES, "tag string, pos int, kind string, pattern string"))
    assert [r[0] for r in rules] == ["alpha", "beta", "gamma", "delta"]
    tag = lambda title, body="", least=2: one(spark, tagging.rule_tags(F.lit(title), F.lit(body), rules, least=least))
    assert tag("A red door") == ["alpha"]  # a hit in the title is enough
    assert tag("A door", "painted red") == [] and tag("A door", "red and blue") == ["alpha"]  # one mention in the body is not, two are
    assert tag("Green door") == ["beta"] and tag("Green door", "an evergreen plant") == []  # an exclusion blocks
    assert tag("red greeen sky sea") == ["alpha", "beta", "gamma"] and len(tag("red green sky sea", least=1)) == dicts.MAX_TAGS


def test_report(spark):
    ev = spark.createDataFrame([(["ai_agent", "zero_day"],), (["ai_agent"],), ([],), (None,)], "tags array<string>")
    out = {r["tag"]: (r["events"], r["pct"]) for r in tagging.report(ev).collect()}
    assert len(out) == 56 and out["ai_agent"] == (2, 50.0) and out["zero_day"] == (1, 25.0) and out["ipo"] == (0, 0.0)


def test_stats_and_summary(spark):
    rows = [("2026-11-19", "cybersecurity", 8, 3, ["ai_security", "ai_agent"], True), ("2026-11-19", "products_apps", 5, 1, ["ai_agent"], False)]
    ev = spark.createDataFrame(rows, "date string, category string, importance int, mention_count int, tags array<string>, is_top boolean")
    stats = {r["tag"]: (r["events"], r["mentions"], r["high"]) for r in tagging.tag_stats(ev, []).collect()}
    assert stats == {"ai_security": (1, 3, 1), "ai_agent": (2, 4, 1)}
    s = aggregates.daily_summary(ev).first()
    assert (s["total_db"], s["total_top"], s["tags_version"]) == (2, 1, "v1")
    assert s["by_tag"] == {"ai_security": 1, "ai_agent": 2} and s["mentions_by_tag"]["ai_agent"] == 4 and s["high_importance_by_tag"] == {"ai_security": 1, "ai_agent": 1}
