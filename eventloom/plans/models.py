"""Queries through the extension points for outside models, with offline models that the SQL twins can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import tagging
from eventloom.operators import extract
from eventloom.plans.registry import EVENTS, ITEMS, _stored_events, _table, events, items, query
from eventloom.session import Scratch
from eventloom.sources import store


def _length_classes(rows: list[dict]) -> list[dict]:
    """Answers by the length of the summary, in another order than asked, some missing, some odd; batches of which one is refused."""
    if len(rows) > 1 and any(len(r["summary"] or "") % 11 == 0 for r in rows):
        raise RuntimeError("refused")
    out = []
    for k, r in enumerate(rows):
        n = len(r["summary"] or "")
        if n % 5:
            out.append({"idx": str(k), "is_ai": n % 3 > 0, "category": ["cybersecurity", "nonsense"][n % 2], "reason": f"length {n}"})
    return out[::-1]


@query(
    "classified_items",
    f"""WITH {ITEMS}, n AS (SELECT seq, length(summary) AS n FROM items)
SELECT seq, n % 5 = 0 OR n % 3 > 0 AS is_ai, CASE WHEN n % 5 = 0 THEN 'uncategorized' WHEN n % 2 = 0 THEN 'cybersecurity' WHEN n % 3 > 0 THEN 'uncategorized' ELSE 'none' END AS category, CASE WHEN n % 5 = 0 THEN '' ELSE 'length ' || n END AS classify_reason FROM n""",
)
def classified_items(spark, sf):
    """Classes joined by the answers' numbers; refused batches are asked by halves; silence keeps an item."""
    return extract.classify(items(spark, sf), _length_classes).select("seq", "is_ai", "category", "classify_reason")


def _length_ranks(rows: list[dict]) -> list[dict]:
    return [{"idx": k, "keep": len(r["summary"] or "") % 7 > 0, "importance": f"{len(r['summary'] or '') % 10}" if len(r["summary"] or "") % 2 else "high", "reason": "r" * (len(r["summary"] or "") % 90)} for k, r in enumerate(rows)]


@query("ranked_items", f"WITH {ITEMS}, n AS (SELECT seq, length(summary) AS n FROM items) SELECT seq, CAST(CASE WHEN n % 2 = 1 THEN n % 10 ELSE 5 END AS INT) AS importance, repeat('r', CAST(least(60, n % 90) AS INT)) AS quality_reason FROM n WHERE n % 7 > 0")
def ranked_items(spark, sf):
    """Items that a model keeps, with its importance where that is a number."""
    return extract.rank(items(spark, sf), _length_ranks).select("seq", "importance", "quality_reason")


def _objects(replies):
    """What JSON replies hold, spelled again."""
    import json

    import pandas as pd

    return pd.Series([json.dumps(extract.find_json(x), sort_keys=True) for x in replies])


@query("json_in_replies", "SELECT doc_id, '{\"lang\": \"' || lang || '\", \"n\": [' || n_chars || ', 1]}' AS found FROM documents WHERE text IS NOT NULL")
def json_in_replies(spark, sf):
    """JSON found in answers around which a model talks, by a fence or by the longest that parses."""
    made = F.to_json(F.struct("lang", F.array("n_chars", F.lit(1)).alias("n")))
    small = F.lit(" [1] {bad} ")
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), made, F.lit("\n```\nfor "), small)).otherwise(F.concat(small, F.lit("so "), made, F.lit(" and [0]")))
    rows = _table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", reply.alias("reply"))
    return rows.select("doc_id", F.pandas_udf(_objects, "string")("reply").alias("found"))


@query("tag_dictionary", "SELECT n_name AS grp, string_agg('- ' || c_custkey || ' (' || c_mktsegment || '): ' || c_name, chr(10) ORDER BY c_custkey) AS spec FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0 GROUP BY n_name")
def tag_dictionary(spark, sf):
    """A dictionary rendered by group, retired entries hidden; customers stand for tags, nations for groups."""
    rows = _table(spark, sf, "customer").join(_table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    tags = rows.select(F.col("c_custkey").cast("string").alias("tag"), F.col("n_name").alias("grp"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("descr"), (F.col("c_custkey") % 4 == 0).alias("deprecated"), F.col("c_custkey").alias("pos"))
    return tagging.tag_spec(tags)


@query("store_imports", f"WITH {EVENTS} SELECT seq, date, CASE WHEN day(date) % 2 = 0 THEN importance ELSE 1 END AS importance FROM ev")
def store_imports(spark, sf):
    """Days that the store has are skipped by an import, the others are taken."""
    kept = store.EventStore(spark, Scratch(spark, "import-store").base)
    rows = _stored_events(events(spark, sf))
    kept.write_days(rows.where("day(date) % 2 = 0"))
    kept.import_missing(rows.withColumn("importance", F.lit(1)))
    return kept.events().select("seq", "date", "importance")


@query("store_updates", f"WITH {EVENTS} SELECT seq, date, CASE WHEN day(date) = 10 AND seq % 3 = 0 THEN 'new' ELSE category END AS category FROM ev")
def store_updates(spark, sf):
    """Some documents of one day changed through the store; the rest of it, and all other days, stay."""
    kept = store.EventStore(spark, Scratch(spark, "update-store").base)
    kept.write_days(_stored_events(events(spark, sf)))
    changes = kept.events().where("day(date) = 10 AND seq % 3 = 0").select("date", "event_id", F.lit("new").alias("category"))
    kept.update_columns(changes, ["category"])
    return kept.events().select("seq", "date", "category")
