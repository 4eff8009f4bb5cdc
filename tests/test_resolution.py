"""Similarity joins, components, greedy merging, trending, quotas."""

import hashlib
import random

from pyspark.sql import functions as F

from eventloom.functions import text
from eventloom.operators import extract, filters, ranking, report, resolve, similarity, trending
from eventloom.operators.graph import connected_components


def test_set_join_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.sample("abcdefghijkl", rng.randint(1, 9))) for i in range(120)]
    for t in (0.42, 0.65, 0.8):
        got = {(r["a"], r["b"]) for r in similarity.set_join(spark.createDataFrame(rows, "id long, tokens array<string>"), t).collect()}
        want = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= t - 1e-12}
        assert got == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(64)] + [(7, 7), (None, 3), (5000, 5000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _event(seq, title, who=(), summary="s", importance=5, tags=(), url=None, when="", where=""):
    return (seq, title, summary, importance, list(who), list(tags), when, where, [(url or f"u{seq}", "n", "media")])


def test_greedy_merge(spark):
    rows = [
        _event(1, "微軟發表全新雲端模型", ["微軟"], tags=["ai_agent"], when="近期"),
        _event(2, "微軟發表全新雲端模型！", ["Microsoft Corp"], "a longer summary", 8, ["ai_security", "ai_agent"], "u1", "2026-11-01", "US"),
        _event(3, "谷歌推出影片生成工具", ["Google Cloud"]),
        _event(4, "完全不同的事件標題abc", ["x"]),
    ]
    out = {r["seq"]: r for r in resolve.programmatic_dedup(spark.createDataFrame(rows, resolve.EVENT)).collect()}
    assert set(out) == {1, 3, 4}
    r = out[1]
    assert (r["title"], r["summary"], r["importance"], r["when"], r["where"], r["tags"]) == ("微軟發表全新雲端模型！", "a longer summary", 8, "2026-11-01", "US", ["ai_agent", "ai_security"])
    assert len(r["sources"]) == 1 and r["who"] == ["微軟", "Microsoft Corp"]
    again = resolve.programmatic_dedup(resolve.programmatic_dedup(spark.createDataFrame(rows, resolve.EVENT)))
    assert again.count() == 3  # twice is once


def _plain_leaders(rows):
    """One list, one pass after another: the first event takes all later ones that match it, as it grows."""
    norm = lambda t: "".join(c for c in t.lower() if c.isalnum())
    alias = {"微軟": "microsoft"}
    now = [{"ids": [r[0]], "title": r[1], "who": list(r[4])} for r in rows]
    before = None
    while before != len(now):
        before, kept = len(now), []
        for e in now:
            for k in kept:
                a, b = set(norm(k["title"])), set(norm(e["title"]))
                sim = len(a & b) / len(a | b)
                shared = {alias.get(w, w) for w in k["who"]} & {alias.get(w, w) for w in e["who"]}
                if norm(k["title"]) == norm(e["title"]) or sim >= 0.68 or (sim >= 0.42 and shared):
                    k["ids"] += e["ids"]
                    k["who"] += [w for w in e["who"] if w not in k["who"]]
                    k["title"] = e["title"] if len(e["title"]) > len(k["title"]) else k["title"]
                    break
            else:
                kept.append(e)
        now = kept
    return {e["ids"][0]: (e["title"], sorted(e["who"])[:8], sorted(e["ids"])) for e in now}


def test_leaders_agree_with_a_plain_loop(spark):
    """Two by two, where who takes first cannot matter; then a fixed case where a leader grows."""
    rng = random.Random(4)
    chars = [chr(0x4E00 + k) for k in range(600)]
    rows = []
    for i in range(40):
        own = rng.sample(chars, 12)
        rows.append(_event(2 * i, "".join(own), [rng.choice(["acme", "bolt", "微軟"])]))
        rows.append(_event(2 * i + 1, "".join(own[: rng.randint(4, 12)] + rng.sample(chars, rng.randint(0, 3))), [rng.choice(["acme", "bolt", "Microsoft Corp"])]))
    clusters = {}
    for r in resolve.leading_clusters(spark.createDataFrame(rows, resolve.EVENT)).collect():
        clusters.setdefault(r["cluster"], []).append(r["seq"])
    plain = _plain_leaders([(*r[:4], [{"Microsoft Corp": "微軟"}.get(w, w) for w in r[4]], *r[5:]) for r in rows])
    assert {k: sorted(v) for k, v in clusters.items()} == {k: v[2] for k, v in plain.items()}
    # 1 takes 2 and with it bolt's name; so it takes 3, which 2 alone would not bring by its title.
    a = "甲乙丙丁戊己庚辛壬癸"
    grown = [_event(1, a, ["acme"]), _event(2, a[:8] + "子丑", ["acme", "bolt"]), _event(3, a[:6] + "天地玄黃", ["bolt"]), _event(4, "宇宙洪荒", ["bolt"])]
    got = {r["seq"]: r["cluster"] for r in resolve.leading_clusters(spark.createDataFrame(grown, resolve.EVENT)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_first_match_is_the_loop(spark):
    """2,000 random rows (and two smaller cases) on a graph of keys with growing leaders, names cut at 8, and longer members; then the plain case."""
    from eventloom.operators.leaders import first_match

    rng = random.Random(12)
    for case, n in ((0, 2000), (1, 200), (2, 200)):
        keys = list(range(300 if n == 2000 else 40))
        near = {(a, b): rng.random() < 0.5 for a in keys for b in keys if a < b and rng.random() < (0.01 if case == 0 else 0.2)} | {(k, k): True for k in keys[:-3]}
        rows = [(i, rng.choice([None, *keys * 3]), 0 if case == 2 else rng.randint(0, 30), [(f"n{x}", f"e{x % 30}") for x in rng.sample(range(60), rng.choice([0, 1, 2, 12]))]) for i in range(n)]
        got = {r["id"]: (r["leader"], r["reigned"]) for r in first_match(spark.createDataFrame(rows, "id long, key long, size long, names array<struct<n:string,e:string>>"), spark.createDataFrame([(a, b, s) for (a, b), s in near.items()], "a long, b long, sure boolean")).collect()}
        heads, want, reigned = [], {}, set()
        for i, key, size, names in rows:
            own = {e for _, e in names}
            for h in heads:
                sure = None if key is None or h["key"] is None else near.get((min(key, h["key"]), max(key, h["key"])))
                if sure or (sure is False and own & {e for _, e in h["names"]}):
                    held = {x for x, _ in h["names"]}
                    h["names"] = (h["names"] + [x for x in names if x[0] not in held])[:8]
                    if size > h["size"]:
                        h["key"], h["size"] = key, size
                        reigned.add(i)
                    want[i] = h["id"]
                    break
            else:
                heads.append({"id": i, "key": key, "size": size, "names": list(names)})
                want[i] = i
                reigned.add(i)
        assert {i: x[0] for i, x in got.items()} == want
        assert {i for i, x in got.items() if x[1]} == reigned
        assert 1 < len(heads) < n


def test_first_duplicates_are_the_loop(spark):
    rng = random.Random(13)
    words = [f"word{k}" for k in range(30)]
    rows = [(i, " ".join(rng.sample(words, rng.randint(0, 6))) or None, "s" * rng.randint(0, 20) or None) for i in range(150)]
    items = spark.createDataFrame(rows, "id long, title string, summary string")
    sims = lambda a, b: len(a & b) / len(a | b) if a and b else 0

    def grams(t):
        s = (t or "").replace(" ", "")
        return {s[k : k + 4] for k in range(len(s) - 3)} if len(s) > 4 else {s} - {""}

    kept, want = [], {}
    for i, t, s in rows:
        for k in kept:
            if max(sims(set((t or "").split()), set((k[1] or "").split())), sims(grams(t), grams(k[1]))) >= 0.55:
                want[i] = k[0]
                if len(s or "") > len(k[2] or ""):
                    k[1], k[2] = t, s
                break
        else:
            kept.append([i, t, s])
            want[i] = i
    assert {r["id"]: r["first"] for r in resolve.first_duplicates(items, 0.55).collect()} == want and 1 < len(kept) < 150
    # A chain: 3 is like 2 and 2 like 1, but 3 isn't like what is kept.
    chain = spark.createDataFrame([(1, "a1a b2b c3c d4d"), (2, "b2b c3c d4d e5e"), (3, "c3c d4d e5e f6f")], "id long, summary string").withColumn("title", F.lit(""))
    assert {r["id"]: r["first"] for r in resolve.first_duplicates(chain, 0.55, words_only=True).collect()} == {1: 1, 2: 1, 3: 3}


def test_failing_judges(spark):
    rows = spark.createDataFrame([(k, f"title {k:03d}") for k in range(100)], "seq long, title string")
    calls = spark.sparkContext.accumulator(0)

    def refuses(frame):
        calls.add(1)
        raise RuntimeError("busy")

    alone = resolve.global_windows(rows, refuses)
    assert all(r["seq"] == r["cluster"] for r in alone.collect()) and calls.value == 3 * 3
    for silent in (lambda f: None, lambda f: [], lambda f: [[]], lambda f: [[999]], lambda f: "x"):
        groups = rows.select("seq", F.lit(1).alias("group"))
        assert {(r["seq"], r["cluster"]) for r in resolve.adjudicate(rows.limit(5), groups, silent).collect()} == {(k, k) for k in range(5)}


def test_verdict_heads(spark):
    """A verdict's first row is the head and is rewritten; a window's head is its most important row; neither takes longer texts."""
    rows = [_event(1, "甲乙丙丁 sora", ["acme"], "long summary", 3), _event(2, "sora 戊己庚辛壬癸子丑寅", ["acme"], "s", 9), _event(3, "完全不同", ["x"], "s", 2), _event(4, "全無關係的", ["y"], "much longer summary", 7)]
    judge = lambda f: [([1, 0], {"title": "both", "importance": 4})]
    window = lambda f: [[i for i, t in enumerate(f["title"]) if "全" in t]]
    out = {r["seq"]: r for r in resolve.merge_events(spark.createDataFrame(rows, resolve.EVENT), judge, window).collect()}
    assert set(out) == {2, 4} or set(out) == {1, 4}
    head = out[min(out)]
    assert (head["title"], head["importance"], head["mention_count"]) == ("both", 4, 2)
    assert (out[4]["title"], out[4]["summary"], out[4]["importance"], out[4]["who"]) == ("全無關係的", "much longer summary", 7, ["y", "x"])


def test_many_equal_titles(spark):
    rows = [_event(i, "完全相同的標題", [f"n{i}"], url=f"u{i % 5}") for i in range(300)]
    out = resolve.programmatic_dedup(spark.createDataFrame(rows, resolve.EVENT)).collect()
    assert len(out) == 1 and out[0]["seq"] == 0 and len(out[0]["who"]) == 8 and len(out[0]["sources"]) == 5


def test_merge_events(spark):
    rows = [
        _event(1, "微軟發表全新雲端模型", ["微軟"], tags=["ai_agent"], when="近期"),
        _event(2, "微軟發表全新雲端模型！", ["Microsoft Corp"], "a longer summary", 8, url="u2", when="2026-11-01"),
        _event(3, "sora 影片工具", ["OpenAI"]),
        _event(4, "OpenAI 的 Sora 上線", ["ChatGPT"]),
        _event(5, "完全不同的事件abc", ["x"]),
        _event(6, "完全不同的事物qqqqqqwwwwzzzz", ["y"]),
    ]
    events = spark.createDataFrame(rows, resolve.EVENT).withColumn("what", F.lit("launch"))
    asked = lambda frame: [(list(range(len(frame))), {"title": "joined"})]
    plain = {r["seq"]: r for r in resolve.merge_events(events).collect()}
    assert set(plain) == {1, 3, 4, 5, 6} and plain[1]["mention_count"] == 2 and plain[1]["when"] == "2026-11-01"
    assert plain[5]["event_id"] == hashlib.sha1(b"x|launch").hexdigest()[:10]
    out = {r["seq"]: r for r in resolve.merge_events(events, asked, lambda f: resolve.same_head(f, 3)).collect()}
    assert set(out) == {1, 3, 5} and out[3]["title"] == "joined" and out[5]["mention_count"] == 2


def test_windows_join_unlike_titles(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("abcdefgh") * 6 + str(i)) for i in range(200)]
    got = {r["seq"]: r["cluster"] for r in resolve.global_windows(spark.createDataFrame(rows, "seq long, title string"), resolve.same_head, width=9, step=5).collect()}
    least = {}
    for i, t in rows:
        least[t[:6]] = min(i, least.get(t[:6], i))
    assert got == {i: least[t[:6]] for i, t in rows}


def test_likely_pairs_and_folding(spark):
    rows = [(1, "acme opens large factory in ohio", "short", "S1"), (2, "Acme opens a large factory in Ohio!", "a longer summary", "S2"), (3, "bolt sells cars", "x", "S1"), (4, "bolt ends car sales", "x", "S3"), (5, "", "", None), (6, "acme opens large factory in ohio", "z", "S1")]
    items = spark.createDataFrame(rows, "id long, title string, summary string, source_name string")
    plain = resolve.first_duplicates(items, 0.55)
    out = {r["id"]: r for r in resolve.fold_duplicates(items, plain).collect()}
    assert set(out) == {1, 3, 4, 5} and (out[1]["source_name"], out[1]["summary"], out[1]["n_items"]) == ("S1 / S2", "a longer summary", 3)
    judged = resolve.first_duplicates(items, 0.55, 0.05, lambda a, b: a.str.startswith("bolt") & b.str.startswith("bolt"))
    assert set(r["id"] for r in resolve.fold_duplicates(items, judged).collect()) == {1, 3, 5}


def test_word_pairs_brute(spark):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(60)]
    rows = [(i, " ".join(rng.sample(words, 3)), " ".join(rng.sample(words[:25], rng.randint(5, 20)))) for i in range(80)]
    got = {(r["a"], r["b"]) for r in resolve.likely_pairs(spark.createDataFrame(rows, "id long, title string, summary string"), 0.40, words_only=True).collect()}
    sets = {i: set(f"{t} {s}".split()) for i, t, s in rows}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.40}


def test_hub_components(spark):
    edges = [(9_999, i) for i in range(3000)] + [(20_000, 20_000 + i) for i in range(1, 3000)] + [(40_000, 39_999)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).groupBy("component").count().collect()
    assert {(r["component"], r["count"]) for r in got} == {(0, 3001), (20_000, 3000), (39_999, 2)}


def test_edges(spark):
    rows = [(1, "OpenAI 推出 Sora 影片", ["OpenAI"]), (2, "sora 上線", ["ChatGPT"]), (3, "完全無關的新聞", ["x"]), (4, "zzz", None)]
    got = {(r["a"], r["b"]) for r in similarity.candidate_edges(spark.createDataFrame(rows, "id long, title string, who array<string>")).collect()}
    assert got == {(1, 2)}


def test_trending_boundaries(spark):
    today = "2026-11-20"
    history = [("acme", "s1", "2026-11-13"), ("acme", "s2", "2026-11-14"), ("bolt", "s1", "2026-11-12"), ("bolt", "s2", "2026-11-15"), ("core", "s1", "2026-10-20"), ("core", "s2", "2026-11-19"), ("core", "s3", "2026-11-19"), ("dune", "s1", "2026-11-19")]
    h = spark.createDataFrame(history, "entity string, source string, d string").withColumn("date", F.to_date("d"))
    rows = [(1, 8, ["Acme"], ["s9"]), (2, 9, ["acme"], ["s1"]), (3, 10, ["acme"], ["s8", "s9", None]), (4, 5, ["other", "Core"], ["s1"]), (5, 5, ["bolt", "ab"], ["s3"]), (6, 5, ["dune"], ["a"]), (7, 5, ["dune"], ["b"]), (8, 5, ["dune"], ["c", "d", "e", "f"]), (9, 5, None, None)]
    ev = spark.createDataFrame(rows, "seq long, importance int, who array<string>, sources array<string>")
    hits = trending.recent_hits(trending.named_entities(ev), h, today)
    found = {r["entity"]: (r["sources"], r["days"]) for r in trending.trending_entities(hits).collect()}
    assert found == {"acme": (2, 2), "core": (2, 1), "dune": (1, 1)}  # bolt is in the baseline (8 days ago), core's 31 days ago isn't, ab is too short
    got = {r["seq"]: (r["importance"], r["trending"] and tuple(r["trending"])) for r in trending.boost(ev, hits).collect()}
    # Each event counts its own sources: dune's three events together have six, but only the last has enough.
    assert got == {1: (9, ("Acme", 3, 3)), 2: (9, None), 3: (10, ("acme", 5, 3)), 4: (6, ("Core", 3, 2)), 5: (5, None), 6: (5, None), 7: (5, None), 8: (7, ("dune", 5, 2)), 9: (5, None)}


def test_history_matches(spark):
    e = spark.createDataFrame([("gpt-4",), ("acme corp",), ("c++",), ("***",)], "entity string")
    t = spark.createDataFrame([(1, "new GPT-4 out"), (2, "gpt-45 out"), (3, "the acme corp."), (4, "acme corporation"), (5, "c+++ or c++"), (6, "a *** b, *"), (7, None), (8, "")], "text_id long, text string")
    assert {(r["entity"], r["text_id"]) for r in trending.history_matches(e, t).collect()} == {("gpt-4", 1), ("acme corp", 3), ("c++", 5), ("***", 6)}


def test_entities_of_any_script(spark):
    rng = random.Random(8)
    chars = [chr(0x4E00 + k) for k in range(40)] + list("ab1 é")
    entities = {"".join(rng.choice(chars[:40]) for _ in range(rng.choice([1, 2, 3, 3, 3]))) for _ in range(25_000)}
    texts = [(k, "".join(rng.choice(chars) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    got = {(r["entity"], r["text_id"]) for r in trending.history_matches(spark.createDataFrame([(x,) for x in entities], "entity string"), spark.createDataFrame(texts, "text_id long, text string")).collect()}
    edge = set("abcdefghijklmnopqrstuvwxyz0123456789")
    want = set()
    for k, t in texts:
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                if t[i : i + n] in entities and (i == 0 or t[i - 1] not in edge) and (i + n == len(t) or t[i + n] not in edge):
                    want.add((t[i : i + n], k))
    assert len(entities) > 10_000 and got == want


def test_quota_is_the_loop(spark):
    rng = random.Random(5)
    for case in range(12):
        n, quota = rng.choice([(6, 2), (3, 1), (9, 3)])
        rows = [(i, rng.choice(["q", "q", "a"]) if case % 3 else "q", rng.randint(1, 3), rng.randint(0, 2)) for i in range(rng.randint(0, 20))]
        df = spark.createDataFrame(rows, "seq long, category string, importance int, mention_count int")
        got = [r["seq"] for r in ranking.quota_top(df, n, quota, "q").orderBy("pick").collect()]
        picks, over, used = [], [], 0
        for r in sorted(rows, key=lambda r: (-r[2], -r[3], r[0])):
            if len(picks) >= n:
                break
            if r[1] == "q":
                if used >= quota:
                    over.append(r)
                    continue
                used += 1
            picks.append(r)
        assert got == [r[0] for r in picks + over[: n - len(picks)]]


def test_limit_before_filter(spark):
    rows = [("s", i, "t" if i != 1 else "", f"u{i}", f"2026-01-0{i + 1}" if i != 2 else None) for i in range(5)]
    df = spark.createDataFrame(rows, "source_name string, seq int, title string, url string, p string").withColumn("published", F.to_timestamp("p"))
    cut = F.to_timestamp(F.lit("2026-01-03"))
    assert {r["seq"] for r in filters.limit_then_filter(df, 4, cut).collect()} == {2, 3}
    assert {r["seq"] for r in filters.limit_then_filter(df, 4, cut, undated_ok=False).collect()} == {3}


def test_keywords_and_dek(spark):
    rows = [("RAISE funds", "", "media"), ("New AI chip", "", "media"), ("New AI chip 星座", "", "media"), ("anything", "", "vendor"), ("Ransomware hits", "", "media")]
    df = spark.createDataFrame(rows, "title string, summary string, source_kind string")
    assert [r["title"] for r in filters.prefilter(df, ai=["AI"], security=["ransomware"]).collect()] == ["New AI chip", "anything", "Ransomware hits"]
    items = spark.createDataFrame([("u1", "short", "media"), ("u2", "short", "vendor")], "url string, summary string, source_kind string")
    deks = spark.createDataFrame([("u1", "d" * 40), ("u2", "d" * 40)], "url string, dek string")
    got = {r["url"]: r["summary"] for r in filters.enrich_with_dek(items, deks).collect()}
    assert got == {"u1": "d" * 40 + " short", "u2": "short"}


def test_extract_retry_and_json(spark):
    calls = []

    def model(rows):
        calls.append(len(rows))
        if any(r["title"] == "bad" for r in rows):
            raise RuntimeError("refused")
        return [[{"title": r["title"], "summary": "s", "category": "x", "importance": 99, "who": [], "what": "", "when": "", "tags": ["hbm"]}] * 2 for r in rows]

    assert extract.with_retry(lambda xs: [x * 2 for x in xs] if 3 not in xs else 1 / 0, [1, 2, 3, 4], lambda x: -1) == [2, 4, -1, 8]
    items = spark.createDataFrame([(1, "a", "s", "n", "u"), (2, "bad", "s", "n", "u")], "seq long, title string, summary string, source_name string, url string")
    out = extract.normalize_events(extract.extract_events(items, model)).collect()
    assert [(r["seq"], r["importance"], r["category"], r["tags"]) for r in out] == [(1, 10, "uncategorized", ["memory_hbm"])] * 2
    assert extract.find_json('x ```json\n[1, 2]\n``` y') == [1, 2] and extract.find_json('say {"a": [1]} or [2]') == {"a": [1]} and extract.find_json("none") is None


def test_report_parts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab 漢。!;.\n") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["x" * 50, "x" * 20, "", None, "a" * 9 + "。" + "b" * 30]

    def plain(t):
        out = []
        while t:
            head = t[:20]
            stop = max(head.rfind(c) for c in report.SENTENCE_ENDS) + 1
            cut = len(t) if len(t) <= 20 else stop if stop > 9 else 20
            out.append(t[:cut])
            t = t[cut:]
        return out

    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", report.split_paragraph("t", 20).alias("p")).collect()
    assert {r["id"]: r["p"] for r in got} == {k: plain(t or "") for k, t in enumerate(texts)}
    ev = spark.createDataFrame([("a",), ("a",), ("b",)], "category string")
    assert {r["category"]: (r["n"], r["active"]) for r in report.facet_tabs(ev, "zzz").collect()} == {"all": (3, True), "a": (2, False), "b": (1, False)}
    assert text is not None
