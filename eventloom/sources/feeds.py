"""Parsers of landed payloads: feeds, JSON APIs and HTML pages. Nothing here reaches a network."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import dicts, text

ITEM = "title string, url string, summary string, published timestamp, source_name string, source_region string, source_kind string, source_lang string, source_topic string"
_ENTRY = "struct<title:string,link:array<struct<_VALUE:string,_href:string,_rel:string>>,description:string,summary:string,content:string,encoded:string,pubDate:string,published:string,updated:string,date:string>"
_FEED = f"channel struct<item:array<{_ENTRY}>>, item array<{_ENTRY}>, entry array<{_ENTRY}>, _bad string"
_XML_ENTITIES = ("&amp;", "&lt;", "&gt;", "&quot;", "&apos;")


def _parsed(body: Column) -> Column:
    """A feed as a struct; names of HTML's characters and bare ampersands, which XML doesn't know, are spelled first."""
    for name, char in text.ENTITIES.items():
        if name not in _XML_ENTITIES and name.startswith("&") and "#" not in name:
            body = F.replace(body, F.lit(name), F.lit("".join(f"&#{ord(c)};" for c in char)))
    body = F.regexp_replace(body, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")
    return F.from_xml(F.trim(body), _FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"})


def parse_rss(payloads: DataFrame, summary_cap: int = 1200) -> DataFrame:
    """(source_name, feed_pos, title, url, summary, published) from whole feeds in ``body``: RSS, RDF and Atom.

    A feed that is no well-formed XML gives no rows; ``bad_feeds`` names it.
    """
    found = payloads.select("source_name", _parsed(F.col("body")).alias("x"))
    rows = found.select("source_name", F.posexplode(F.coalesce("x.channel.item", "x.entry", "x.item")).alias("feed_pos", "e"))
    said = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"e.{n}")), F.lit("")) for n in names])
    spelled = F.filter(F.transform("e.link", lambda x: F.trim(x["_VALUE"])), lambda x: x != "")
    named = F.filter("e.link", lambda x: x["_href"].isNotNull())
    main = F.filter(named, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(F.get(spelled, F.lit(0)), F.get(main, F.lit(0))["_href"], F.get(named, F.lit(0))["_href"])
    return rows.select("source_name", "feed_pos", text.strip_html(said("title")).alias("title"), link.alias("url"), F.substring(text.strip_html(said("description", "summary", "content", "encoded")), 1, summary_cap).alias("summary"), text.published(said("pubDate", "published", "updated", "date")).alias("published"))


def bad_feeds(payloads: DataFrame) -> DataFrame:
    """(source_name, reason) of the feeds that gave no rows because they are empty or can't be read."""
    found = payloads.select("source_name", "body", _parsed(F.col("body")).alias("x"))
    reason = F.when(F.coalesce(F.trim("body"), F.lit("")) == "", "empty").when(F.col("x._bad").isNotNull() | F.col("x").isNull(), "not well-formed")
    return found.select("source_name", reason.alias("reason")).where(F.col("reason").isNotNull())


def union_families(parts: list[DataFrame]) -> DataFrame:
    """One table from source families with different columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _field(rows: DataFrame, path: str, kind: str = "string") -> Column:
    """A column or field of a struct; null where the rows have none."""
    at: T.DataType | None = rows.schema
    for part in path.split("."):
        at = at[part].dataType if isinstance(at, T.StructType) and part in at.names else None
    return F.col(path).cast(kind) if at is not None else F.lit(None).cast(kind)


def _said(*columns: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def _counted(*columns: Column) -> Column:
    """The first that isn't 0, else 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0).cast("long")) for c in columns], F.lit(0).cast("long"))


def _opensource(name: str) -> list[Column]:
    values = {"source_name": name, "source_region": "GLOBAL", "source_kind": "opensource", "source_lang": "en", "is_opensource": True}
    return [F.lit(v).alias(k) for k, v in values.items()]


def models_api(rows: DataFrame, cutoff: Column) -> DataFrame:
    """Trending models to items: the last change, else the creation, must be a time not before ``cutoff``; synthetic title and summary."""
    own = _said(_field(rows, "id"), _field(rows, "modelId"))
    when = _said(_field(rows, "lastModified"), _field(rows, "createdAt")).try_cast("timestamp")
    downloads, likes, task = _counted(_field(rows, "downloads", "long")), _counted(_field(rows, "likes", "long")), F.coalesce(_field(rows, "pipeline_tag"), F.lit(""))
    address = F.concat(F.lit("https://huggingface.co/"), own)
    line = F.concat(F.lit("Hugging Face 熱門模型，任務類型："), F.coalesce(_said(task), F.lit("未標註")), F.lit("；下載 "), F.format_number(downloads, 0), F.lit(" 次、likes "), F.format_number(likes, 0), F.lit("。模型卡："), address)
    kept = rows.where(own.isNotNull() & F.coalesce(when >= cutoff, F.lit(False)))
    return kept.select(F.concat(F.lit("[HF Trending] "), own).alias("title"), address.alias("url"), line.alias("summary"), when.alias("published"), *_opensource("HuggingFace Trending"), downloads.alias("downloads"), likes.alias("likes"), task.alias("task"))


def papers_api(rows: DataFrame, cutoff: Column) -> DataFrame:
    """Daily papers to items. Title, abstract and id are the nested paper's where there is one, time and votes the entry's first."""
    nested = _field(rows, "paper.title").isNotNull() | _field(rows, "paper.id").isNotNull() | _field(rows, "paper.summary").isNotNull()
    of = lambda *names: F.when(nested, _said(*[_field(rows, f"paper.{n}") for n in names])).otherwise(_said(*[_field(rows, n) for n in names]))
    title, abstract = of("title"), F.coalesce(of("summary", "abstract"), F.lit(""))
    own = _said(_field(rows, "paper.id"), _field(rows, "id"))
    votes = _counted(_field(rows, "upvotes", "long"), _field(rows, "paper.upvotes", "long"))
    when = _said(_field(rows, "publishedAt"), _field(rows, "paper.publishedAt")).try_cast("timestamp")
    address = F.concat(F.lit("https://huggingface.co/papers"), F.coalesce(F.concat(F.lit("/"), own), F.lit("")))
    line = F.concat(F.lit("HuggingFace Daily Papers · upvotes "), votes.cast("string"), F.lit("。\n\n"), F.substring(abstract, 1, 600))
    kept = rows.where(title.isNotNull() & F.coalesce(when >= cutoff, F.lit(False)))
    return kept.select(F.concat(F.lit("[HF Paper] "), title).alias("title"), address.alias("url"), line.alias("summary"), when.alias("published"), *_opensource("HuggingFace Daily Papers"), votes.alias("upvotes"))


def registry_api(rows: DataFrame, cutoff: Column, limit: int = 25) -> DataFrame:
    """Model registry, newest first (equals by ``pos``, else by id), the limit after the filter."""
    own, created = _said(_field(rows, "id")), _counted(_field(rows, "created", "long"))
    when = F.when(created != 0, F.timestamp_seconds(created))
    room, description = _counted(_field(rows, "context_length", "long")), F.substring(F.coalesce(_field(rows, "description"), F.lit("")), 1, 500)
    pricing = F.create_map().cast("map<string,string>")
    if "pricing" in rows.columns:
        kind = rows.schema["pricing"].dataType
        pricing = F.col("pricing").cast("map<string,string>") if isinstance(kind, T.MapType) else F.from_json(F.to_json("pricing"), "map<string,string>")
    price = lambda k: _said(F.try_element_at(pricing, F.lit(k)))
    cost = F.concat(F.lit("price in="), price("prompt"), F.lit("/out="), price("completion"))
    meta = F.concat_ws(" · ", F.when(room != 0, F.concat(F.lit("context="), F.format_number(room, 0))), cost)
    line = _said(F.when(meta != "", F.concat(meta, F.lit("。"), description)).otherwise(description), F.concat(F.lit("OpenRouter 上架模型 "), own))
    tie = F.col("pos") if "pos" in rows.columns else own
    kept = rows.where(own.isNotNull() & F.coalesce(when >= cutoff, F.lit(False))).orderBy(created.desc(), tie).limit(limit)
    return kept.select(F.concat(F.lit("[OpenRouter 新模型] "), F.coalesce(_said(_field(rows, "name")), own)).alias("title"), F.concat(F.lit("https://openrouter.ai/models/"), own).alias("url"), line.alias("summary"), when.alias("published"), *_opensource("OpenRouter Models"), room.alias("context_length"), pricing.alias("pricing"))


def _first_of_pages(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows (pos) of each page."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("page").orderBy("pos"))).where(F.col("_k") <= limit).drop("_k", "page")


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select((F.col("page_id") if "page_id" in pages.columns else F.lit(0)).alias("page"), F.coalesce("html", F.lit("")).alias("html"))


def repo_pages(pages: DataFrame, since: str = "weekly", limit: int = 25) -> DataFrame:
    """Repositories of trending pages that hint at AI by name or description; the limit of a page comes after the filter."""
    period = "今日" if since == "daily" else "本週"
    blocks = F.regexp_extract_all("html", F.lit(r'(?s)<article class="Box-row">(.*?)</article>'), F.lit(1))
    rows = _pages(pages).select("page", F.posexplode(blocks).alias("pos", "b"))
    one = lambda pattern: F.regexp_extract("b", pattern, 1)
    rows = rows.select("page", "pos", F.regexp_replace(one(r'<h2[^>]*>\s*<a[^>]*href="/([^"]+)"'), r"\s+", "").alias("repo"), text.squeeze(text.strip_tags(one(r'(?s)<p class="col-9[^"]*"[^>]*>(.*?)</p>'))).alias("about"), F.trim(one(r'itemprop="programmingLanguage"[^>]*>([^<]+)<')).alias("lang"), one(r"(\d[\d,]*)\s*stars (?:this week|today|this month)").alias("stars"))
    hint = r"(?iU)\b(?:" + "|".join(dicts.REPOSITORY_HINTS) + r")\b"
    kept = _first_of_pages(rows.where(F.contains("repo", F.lit("/")) & F.concat_ws(" ", "repo", "about").rlike(hint)), limit)
    bits = F.concat_ws(" · ", _said(F.col("lang")), F.when(F.col("stars") != "", F.concat(F.lit(f"{period} +"), "stars", F.lit(" stars"))))
    line = F.substring(F.when(F.col("about") != "", F.concat(bits, F.lit("。"), "about")).otherwise(bits), 1, 600)
    return kept.select("pos", F.concat(F.lit(f"[GitHub {period}熱門] "), "repo").alias("title"), F.concat(F.lit("https://github.com/"), "repo").alias("url"), line.alias("summary"), F.lit(None).cast("timestamp").alias("published"), *_opensource("GitHub Trending"), "stars", "lang")


def library_page(pages: DataFrame, limit: int = 8, cap: int = 240, last: int = 1400) -> DataFrame:
    """Models of a library page by first appearance, described by the text up to the next one (``last`` characters after the last)."""
    link = r'href="/library/[a-z0-9._\-]+"'
    parts = F.regexp_extract_all("html", F.lit(rf"(?s){link}.*?(?={link}|\z)"), F.lit(0))
    rows = _pages(pages).withColumn("parts", parts).select("page", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "b"))
    after = F.regexp_replace("b", r'(?s)^href="[^"]*"(?:[^>]*>)?', "")
    after = F.when(F.col("pos") + 1 == F.col("n"), F.substring(after, 1, last)).otherwise(after)
    rows = rows.select("page", "pos", F.regexp_extract("b", r"/library/([a-z0-9._\-]+)", 1).alias("name"), F.trim(text.unescape(text.squeeze(text.strip_tags(after)))).alias("d"))
    first = rows.groupBy("page", "name").agg(F.min_by(F.struct("pos", "d"), F.col("pos")).alias("r")).select("page", "name", "r.pos", "r.d")
    ends = lambda c, chars: F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+$", "")
    d = F.when(F.startswith(F.lower("d"), F.col("name")), ends(F.substring(F.col("d"), F.length("name") + 1, F.length("d")), r" ·:\-")).otherwise(F.col("d"))
    d = F.trim(F.regexp_replace(ends(F.regexp_replace(d, r"\b\d+(?:\.\d+)?[bB]\b", ""), " ·,"), r"\s{2,}", " "))
    kept = _first_of_pages(first.withColumn("d", d), limit)
    short = F.concat(F.regexp_replace(F.substring("d", 1, cap), r" [^ ]*$", ""), F.lit("…"))
    line = F.coalesce(F.when(F.length("d") > cap, short).otherwise(_said(F.col("d"))), F.concat(F.lit("Ollama 新上架模型 "), "name"))
    return kept.select("pos", F.concat(F.lit("[Ollama 新模型] "), "name").alias("title"), F.concat(F.lit("https://ollama.com/library/"), "name").alias("url"), line.alias("summary"), F.lit(None).cast("timestamp").alias("published"), *_opensource("Ollama Library"))


def _meta(keys: list[str]) -> Column:
    found = []
    for key in keys:
        k = key.replace(".", r"\.")
        for pattern in (rf"(?is)<meta[^>]+(?:property|name)=[\"']{k}[\"'][^>]+content=[\"']([^\"']+)", rf"(?is)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+(?:property|name)=[\"']{k}[\"']"):
            found.append(F.nullif(F.regexp_extract(F.col("html"), pattern, 1), F.lit("")))
    return F.coalesce(*found)


def page_description() -> Column:
    return text.strip_html(_meta(["og:description", "description"]))


def page_image(url: str = "url") -> Column:
    """The preview image, protocol-relative and root-relative addresses resolved; others than http give null."""
    raw = F.trim(text.unescape(_meta(["og:image", "twitter:image"])))
    base = F.regexp_extract(url, r"^(https?://[^/]+)", 1)
    full = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("/"), F.concat(base, raw)).otherwise(raw)
    return F.when(full.rlike("^https?://"), full)


def page_facts(pages: DataFrame) -> DataFrame:
    """Title, first heading, number of links, and the plain text's length of each page."""
    body = F.coalesce(F.col("html"), F.lit(""))
    one = lambda p: text.strip_html(F.regexp_extract(body, p, 1))
    return pages.select("page_id", one(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), one(r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"), F.size(F.regexp_extract_all(body, F.lit(r"(?i)<a\s[^>]*href="), 0)).cast("long").alias("n_links"))


def union_isolated(branches: dict[str, object], only: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The union of named branches (callables that give a frame), and what went wrong in those that failed.

    A branch that raises while it is planned is left out, and the others go on; ``only`` restricts the names.
    """
    found, failed = [], {}
    for name, make in branches.items():
        if only is not None and name not in only:
            continue
        try:
            found.append(make())
        except Exception as wrong:  # noqa: BLE001  isolated, and told
            failed[name] = f"{type(wrong).__name__}: {wrong}"
    if not found:
        raise ValueError(f"no branch could be read: {failed}")
    return union_families(found), failed


def window_of_days(days_back: int) -> str:
    """Trending lists are asked for by day, or by week from seven days on."""
    return "daily" if days_back < 7 else "weekly"


def of_kinds(items: DataFrame, kinds: list[str] | None) -> DataFrame:
    return items if not kinds else items.where(F.col("source_kind").isin(kinds))


def search_feed(items: DataFrame, cutoff=None, most: int = 30) -> DataFrame:
    """The first entries of each query (query, seq), then those not older than ``cutoff``; undated ones go where there is a cutoff.

    Each item is named after its source with the search's mark and is of kind ``search``.
    """
    first = items.withColumn("_k", F.row_number().over(Window.partitionBy("query").orderBy("seq"))).where(F.col("_k") <= most).drop("_k")
    kept = first if cutoff is None else first.where(F.coalesce(F.col("published") >= cutoff, F.lit(False)))
    return kept.withColumns({"source_name": F.concat(F.lit("GoogleNews:"), F.coalesce("source_name", F.lit(""))), "source_kind": F.lit("search"), "summary": F.substring(F.coalesce("summary", F.lit("")), 1, 800)})


def fan_out(queries: list[str], read) -> DataFrame:
    """The union of ``read(query)`` over all queries, each row with its query."""
    frames = [read(q).withColumn("query", F.lit(q)) for q in queries]
    return union_families(frames)
