"""Extension points for outside models, with offline defaults.

Each protocol works on whole Arrow batches inside a task, splits a failing batch in halves down
to single rows, and gives the documented default where a single row fails.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import dicts, text

RAW_EVENT = "seq long, title string, summary string, category string, importance int, who array<string>, what string, `when` string, tags array<string>, source_name string, url string"


def with_retry(call: Callable[[list], list], rows: list, default: Callable[[object], object]) -> list:
    """``call`` on all rows, on halves where it fails or miscounts, and ``default`` for a single failing row."""
    if not rows:
        return []
    try:
        out = call(rows)
        if len(out) == len(rows):
            return out
    except Exception:  # noqa: BLE001  a model's failure is a result here
        pass
    if len(rows) == 1:
        return [default(rows[0])]
    half = len(rows) // 2
    return with_retry(call, rows[:half], default) + with_retry(call, rows[half:], default)


def offline_extract(rows: list[dict]) -> list[list[dict]]:
    """One event an item with a title: the item's own words."""
    return [[{"title": r["title"][:80], "summary": (r["summary"] or "")[:400], "category": dicts.UNCATEGORIZED, "importance": 5, "who": [], "what": "", "when": "", "tags": []}] if r["title"] else [] for r in rows]


def extract_events(items: DataFrame, model: Callable[[list[dict]], list[list[dict]]] = offline_extract, batch: int = 5) -> DataFrame:
    """0..n events an item, each with its item's seq, source and url."""
    columns = ["seq", "title", "summary", "source_name", "url"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.to_dict("records")
            out = []
            for a in range(0, len(rows), batch):
                part = rows[a : a + batch]
                for item, events in zip(part, with_retry(model, part, lambda _: []), strict=True):
                    out += [{**e, "seq": item["seq"], "source_name": item["source_name"], "url": item["url"]} for e in events]
            yield pd.DataFrame(out, columns=["seq", "title", "summary", "category", "importance", "who", "what", "when", "tags", "source_name", "url"])

    return items.select(*columns).mapInPandas(run, RAW_EVENT)


def normalize_events(raw: DataFrame) -> DataFrame:
    """Required fields, known categories, importance of 1 to 10, capped texts and lists."""
    from eventloom.functions import tagging

    cap = lambda c, n: F.substring(F.trim(F.coalesce(F.col(c), F.lit(""))), 1, n)
    known = F.col("category").isin(dicts.CATEGORIES)
    names = text.split_names("who") if raw.schema["who"].dataType.typeName() == "string" else F.filter(F.transform(F.coalesce("who", F.array().cast("array<string>")), lambda w: F.trim(w)), lambda w: w != "")
    out = raw.where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("summary", F.lit(""))) != ""))
    return out.withColumns({"title": cap("title", 80), "summary": cap("summary", 400), "what": cap("what", 20), "when": cap("when", 20), "category": F.when(known, F.col("category")).otherwise(dicts.UNCATEGORIZED), "importance": text.clamp(text.safe_int("importance"), 1, 10), "who": F.slice(names, 1, 6), "tags": tagging.normalize_tags(F.col("tags"))})


def judge_column(df: DataFrame, column: str, out: str, kind: str, model: Callable[[list[str]], list], default) -> DataFrame:
    """A model's answer for each text as a new column; a failing row gets ``default``."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(with_retry(model, values.fillna("").tolist(), lambda _: default))

    return df.withColumn(out, run.asNondeterministic()(F.col(column)))


def by_index(reply: list, n: int) -> list[dict]:
    """Answers in the order of the questions, joined by their idx; a missing, repeated or odd one gives an empty answer or the last."""
    found: dict[int, dict] = {}
    for r in reply if isinstance(reply, list) else []:
        try:
            found[int(r["idx"])] = r
        except (KeyError, TypeError, ValueError):
            continue
    return [found.get(i, {}) for i in range(n)]


def _asked(df: DataFrame, columns: list[str], kind: str, model: Callable[[list[dict]], list], shape: Callable[[dict], dict], out: str, batch: int) -> DataFrame:
    """``out``, a struct of type ``kind``: ``shape`` of the model's answer for each row; an empty answer where a row fails."""

    @F.pandas_udf(kind)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        records = rows.to_dict("records")
        answers: list[dict] = []
        for a in range(0, len(records), batch):
            part = records[a : a + batch]
            answers += with_retry(lambda xs: by_index(model(xs), len(xs)), part, lambda _: {})
        return pd.DataFrame([shape(x) for x in answers])

    return df.withColumn(out, run.asNondeterministic()(F.struct(*columns)))  # a model is asked once a row


def classify(items: DataFrame, model: Callable[[list[dict]], list], batch: int = 10) -> DataFrame:
    """Items with is_ai, category and reason: kept and uncategorised where the model says nothing; an unknown category of what is no AI is ``none``."""

    def shape(r: dict) -> dict:
        is_ai = bool(r.get("is_ai", True))
        category = r.get("category")
        known = category in dicts.CATEGORIES
        return {"is_ai": is_ai, "category": category if known else dicts.UNCATEGORIZED if is_ai else "none", "reason": str(r.get("reason", ""))[:80]}

    out = _asked(items, ["title", "summary"], "is_ai boolean, category string, reason string", model, shape, "_c", batch)
    return out.withColumns({"is_ai": F.col("_c.is_ai"), "category": F.col("_c.category"), "classify_reason": F.col("_c.reason")}).drop("_c")


def rank(items: DataFrame, model: Callable[[list[dict]], list], batch: int = 10) -> DataFrame:
    """Items that the model keeps, with importance (5 by default) and reason."""

    def shape(r: dict) -> dict:
        try:
            importance = int(r.get("importance", 5))
        except (TypeError, ValueError):
            importance = 5
        return {"keep": bool(r.get("keep", True)), "importance": importance, "reason": str(r.get("reason", ""))[:60]}

    out = _asked(items, ["title", "summary"], "keep boolean, importance int, reason string", model, shape, "_r", batch)
    return out.withColumns({"importance": F.col("_r.importance"), "quality_keep": F.col("_r.keep"), "quality_reason": F.col("_r.reason")}).drop("_r").where("quality_keep")


def rewrite(items: DataFrame, model: Callable[[list[str]], list]) -> DataFrame:
    """Items with rewritten summaries; the first original stays beside them, and an empty rewrite changes nothing."""
    original = F.coalesce("summary_original", "summary") if "summary_original" in items.columns else F.col("summary")
    out = judge_column(items.withColumn("summary_original", original), "summary", "_new", "string", model, "")
    return out.withColumn("summary", F.when(F.trim(F.coalesce("_new", F.lit(""))) != "", F.col("_new")).otherwise(F.col("summary"))).drop("_new")


def write_texts(events: DataFrame, model: Callable[[str, float], str], attempts: int = 2, seconds: float | None = None) -> DataFrame:
    """Events with ``full_content``: what is there stays; else the first good text of ``attempts`` at rising temperature, or the summary.

    ``seconds`` after a task's first rows its remaining ones take their summaries at once, so that a run
    within a time budget always ends with every text filled. ``text_source`` tells which it was.
    """

    @F.pandas_udf("text string, origin string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = None
        for frame in batches:
            if seconds is not None and end is None:
                end = time.monotonic() + seconds
            out = []
            for title, summary in zip(frame["title"].fillna(""), frame["summary"].fillna(""), strict=True):
                if end is not None and time.monotonic() > end:
                    out.append((summary, "deadline"))
                    continue
                best = ""
                for k in range(attempts):
                    try:
                        best = (model(f"{title}\n{summary}", 0.3 + 0.2 * k) or "").strip()
                    except Exception:  # noqa: BLE001  a model's failure is a result here
                        best = ""
                    if best and best != summary.strip() and len(best) >= max(350, 2.5 * len(summary.strip())):
                        break
                out.append((best or summary, "model" if best else "summary"))
            yield pd.DataFrame(out, columns=["text", "origin"])

    have = F.coalesce("full_content", F.lit("")) != ""
    done = events.where(have).withColumn("text_source", F.lit("kept"))
    made = events.where(~have).withColumn("_t", run.asNondeterministic()(F.struct("title", "summary")))
    made = made.withColumns({"full_content": text.clean_generated("_t.text"), "text_source": F.col("_t.origin")}).drop("_t")
    return done.unionByName(made)


def tag_events(events: DataFrame, model: Callable[[list[dict]], list], batch: int = 20) -> DataFrame:
    """Events with the model's tags, normalised; null where the model fails, so that nothing is written for them."""
    from eventloom.functions import tagging

    def shape(r: dict) -> dict:
        tags = r.get("tags")
        return {"tags": [str(t) for t in tags] if isinstance(tags, list) else None}

    out = _asked(events, ["title", "summary"], "tags array<string>", model, shape, "_m", batch)
    return out.withColumn("tags", F.when(F.col("_m.tags").isNotNull(), tagging.normalize_tags(F.col("_m.tags")))).drop("_m")


def with_covers(events: DataFrame, resolver: Callable | None = None) -> DataFrame:
    """Events with their covers as stored; ``resolver`` (event columns by name -> cover Column) replaces the default."""
    made = resolver(F) if resolver else text.keep_cover("cover_image.kind", "cover_image.url", "category")
    return events.withColumn("cover_image", made)


def find_json(reply: str):
    """JSON in a reply: a fenced block first, else the longest balanced array or object that parses."""
    if "```" in reply:
        for block in reply.split("```")[1::2]:
            try:
                return json.loads(block.removeprefix("json").strip())
            except ValueError:
                continue
    best = None
    decoder = json.JSONDecoder()
    at = 0
    while at < len(reply):
        if reply[at] in "[{":
            try:
                value, end = decoder.raw_decode(reply, at)
                if best is None or end - at > best[0]:
                    best = (end - at, value)
                at = end
                continue
            except ValueError:
                pass
        at += 1
    return best[1] if best else None
