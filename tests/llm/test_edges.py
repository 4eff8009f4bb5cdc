"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import zlib

import pytest

from eventloom.llm import decontamination, fingerprints, fixity, jaccard, language, packing, pii, secrets, sharding, suffixes


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "word"), (4, "word"), (None, "two words")], "item_id long, text string")


def _by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_packing(edge_docs, empty_docs, edge_rows):
    rows = packing.pack(edge_docs, packing.word_tokenizer_path()).collect()
    by = _by_id(rows)
    assert set(by) == {r[0] for r in edge_rows}
    assert len(by[1]) == 1 and by[1][0]["length"] == 1 and by[1][0]["ids_crc32"] == zlib.crc32(b"\1\0\0\0")
    assert len(by[7]) == 2  # repeated rows are packed each
    assert all(0 < r["length"] <= 4096 for r in rows)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack(empty_docs, packing.word_tokenizer_path()).count() == 0


def test_language(edge_docs, empty_docs, edge_rows):
    rows = language.language_table(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    by = _by_id(rows)
    assert all(by[k][0]["lang_pred"] == "und" and by[k][0]["score"] == 0 for k in (1, 2, 3, 12))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.language_table(empty_docs).count() == 0


def test_jaccard(edge_docs, empty_docs, edge_rows):
    rows = jaccard.jaccard_classes(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    by = _by_id(rows)
    assert by[1][0]["n_shingles"] == by[2][0]["n_shingles"] == by[3][0]["n_shingles"] == 0
    assert by[4][0]["n_shingles"] == by[5][0]["n_shingles"] == 1
    assert {by[k][0]["component_id"] for k in (6, 7, 9)} == {6}
    assert {r["component_id"] for r in by[8]} == {6, 8}
    assert by[6][0]["n_links"] == 4
    assert jaccard.jaccard_classes(empty_docs).count() == 0
    kept = jaccard.keep_one_of_each(edge_docs, 4, 85, 100)
    assert kept.columns == edge_docs.columns
    assert kept.where("doc_id in (7, 9)").count() == 0 and kept.where("doc_id = 6").count() == 1


def test_one_row_of_each_component_stays(spark, edge_docs):
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one_of_each(edge_docs, 4, 85, 100).select("doc_id", "text").collect()]
    assert [t[:12] for i, t in kept if i == 8] == ["another text"]
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    near, nearer = a.replace("a30", "zz"), a.replace("a30", "zz").replace("a45", "yy")
    rows = [(1, a), (1, a), (2, near), (2, c), (None, a), (None, near), (None, b), (None, b), (None, b.replace("b30", "zz")), (3, d), (None, d), (4, None), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one_of_each(docs, 4, 85, 100).collect()]
    of_b = [x for x in kept if x[1] and x[1].startswith("b")]
    assert len(of_b) == 1 and of_b[0][0] is None
    assert sorted((x for x in kept if x not in of_b), key=str) == sorted([(1, a), (2, c), (3, d), (4, None), (4, None), (None, "")], key=str)
    bridged = spark.createDataFrame([(1, a), (None, near), (2, nearer)], "doc_id long, text string")  # 1 and 2 meet by a row without id only
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_classes(bridged, 4, 85, 100).collect()} == {(1, 1, 1), (None, 1, 2), (2, 1, 1)}


def test_suffixes(edge_docs, empty_docs, edge_rows):
    rows = suffixes.dedup_substrings(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    by = _by_id(rows)
    assert all(r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1 for k in (7, 9) for r in by[k])
    assert by[6][0]["n_removed"] == 0 and by[14][0]["n_removed"] == 5000 - 1  # all but the first window's first byte
    assert by[1][0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert suffixes.dedup_substrings(empty_docs).count() == 0


def test_fingerprints(edge_docs, empty_docs, edge_rows):
    rows = fingerprints.simhash_report(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    by = _by_id(rows)
    assert by[6][0]["fingerprint"] == by[7][0]["fingerprint"] == by[9][0]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.simhash_report(empty_docs).count() == 0
    one = empty_docs.sparkSession.createDataFrame([(5, "abcd efgh", None, None, None)], empty_docs.schema)
    r = fingerprints.simhash_report(one).collect()[0]
    assert r["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and r["near_next"] == 1.0


def test_sharding(edge_docs, empty_docs, edge_rows):
    rows = sharding.shard_table(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in shards.values()) and set(shards) <= set(range(16))
    assert sharding.shard_table(empty_docs).count() == 0


def test_decontamination(edge_docs, empty_docs, edge_rows, benchmark):
    rows = decontamination.contamination_report(edge_docs, benchmark).collect()
    assert len(rows) == len(edge_rows)
    by = _by_id(rows)
    assert by[1][0]["n_words"] == 0 and not by[1][0]["contaminated"]
    assert by[4][0]["n_hit"] == 1 and by[4][0]["n_items"] == 2 and by[5][0]["n_hit"] == 2
    assert decontamination.contamination_report(empty_docs, benchmark).count() == 0
    assert decontamination.contamination_report(edge_docs, benchmark.limit(0)).where("contaminated").count() == 0
    kept = decontamination.decontaminate(edge_docs, benchmark)
    assert kept.columns == edge_docs.columns and kept.where("doc_id = 4").count() == 0 and kept.where("doc_id = 1").count() == 1
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(edge_docs, benchmark, remove="spans").where("doc_id in (4, 6)").collect()}
    assert cut[4] == "" and cut[6].startswith(edge_rows[5][1][:20])


def test_secrets(edge_docs, empty_docs, edge_rows):
    rows = secrets.secret_report(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    by = _by_id(rows)
    assert by[17][0]["n_assign"] == 1 and by[18][0]["n_access"] == 1 and by[18][0]["n_hex"] == 1
    assert by[1][0]["spans"] == "" and by[14][0]["spans"] == ""
    assert secrets.secret_report(empty_docs).count() == 0
    table = secrets.train(secrets._samples(edge_docs.sparkSession, None, 0))
    out = secrets.redact(edge_docs, table)
    assert out.columns == edge_docs.columns
    got = {r["doc_id"]: r["text"] for r in out.where("doc_id in (1, 17, 18)").collect()}
    assert got[1] is None and got[18] == "[SECRET] [SECRET]" and got[17].startswith("[SECRET] and")


def test_pii(edge_docs, empty_docs, edge_rows):
    rows = pii.pii_report(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    by = _by_id(rows)
    r = by[19][0]
    assert (r["n_phone"], r["n_ip"], r["n_card"]) == (1, 1, 1)
    assert r["spans"].count("phone") == 2  # the number without its plus sign has evidence elsewhere
    assert by[17][0]["n_email"] == 1 and by[17][0]["spans"].count("email") == 2
    assert pii.pii_report(empty_docs).count() == 0
    model = pii.fit(edge_docs)
    assert pii.annotate(edge_docs, model).columns == [*edge_docs.columns, "pii_spans"]


def test_fixity(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", "x"), (2, "u", "x"), (2, "u", "y"), (None, "n", "z"), (5000, "far", "q" * 100000)], "page_id long, url string, html string")
    rows = fixity.fixity_report(pages, pages).collect()
    assert len(rows) == 6 and {r["status"] for r in rows} == {"ok"}
    assert fixity.fixity_report(pages.limit(0), pages.limit(0)).count() == 0
    bad, _, _ = fixity.audit(pages, pages.where("page_id <> 5000 or page_id is null"))
    assert [(r["file_id"], r["fault"]) for r in bad.collect()] == [(5, "missing")]


def test_pipeline(edge_docs, spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(3, "word")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert out.columns == edge_docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    assert 4 not in ids and 1 not in ids and 7 not in ids and {6, 10, 17} <= ids
