"""Scalar functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import dicts

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": html.unescape("&nbsp;"), "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&rsquo;": "’", "&lsquo;": "‘", "&rdquo;": "”", "&ldquo;": "“", "&amp;": "&"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Column | str) -> Column:
    """Runs of white space (Unicode) to one space, trimmed."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def strip_tags(x: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), "<[^>]+>", " ")


def unescape(x: Column) -> Column:
    """Common named entities; the ampersand last, so that nothing is unescaped twice."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), x)


def strip_html(x: Column | str) -> Column:
    """Tags to spaces, then entities, then white space."""
    return squeeze(unescape(strip_tags(x)))


def norm_title(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)['’]s\b", ""), f"(?U){dicts.PUNCTUATION}", "")


def norm_token(x: Column | str) -> Column:
    return norm_title(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)^\s+|\s+$", ""))


def bind(x: Column, use) -> Column:
    """``use(x)`` with x computed once: a lambda over a one-element array names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def char_shingles(x: Column | str, n: int = 4) -> Column:
    """Distinct character n-grams of the normalised title; short ones whole, empty ones none."""

    def grams(s: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, n))
        return F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) <= n, F.array(s)).otherwise(F.array_distinct(every))

    return bind(norm_title(x), grams)


def word_set(x: Column | str) -> Column:
    """ASCII words of three letters or more without stopwords; other words by pairs of characters."""
    s = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)['’]s\b", "")
    words = F.split(F.trim(F.regexp_replace(s, r"(?U)[^\w一-鿿]+", " ")), " ")
    stop = F.array(*[F.lit(w) for w in dicts.STOPWORDS])

    def spread(w: Column) -> Column:
        pairs = F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, 2))).otherwise(F.array().cast("array<string>"))
        plain = F.when((F.length(w) >= 3) & ~F.array_contains(stop, w), F.array(w)).otherwise(F.array().cast("array<string>"))
        return F.when(w.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(pairs)

    return F.array_distinct(F.flatten(F.transform(words, spread)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets held as distinct arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def char_set(x: Column | str) -> Column:
    return bind(norm_token(x), lambda s: F.when(F.length(s) > 0, F.array_distinct(F.split(s, ""))).otherwise(F.array().cast("array<string>")))


def align_entity(x: Column | str) -> Column:
    """The canonical company of the first alias that contains, or is contained in, the name; else the normalised name."""

    def first(w: Column) -> Column:
        tests = [F.when(F.contains(w, F.lit(a)) | F.contains(F.lit(a), w), F.lit(t)) for a, t in dicts.ENTITY_ALIASES]
        return F.coalesce(*tests, w)

    return bind(norm_token(x), first)


def fingerprint(who: Column | str, what: Column | str) -> Column:
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(_c(who), F.array().cast("array<string>")), lambda w: w.isNotNull() & (w != "")), norm_token)))
    return F.concat_ws("|", F.array_join(names, "+"), norm_token(what))


def short_id(x: Column) -> Column:
    return F.substring(F.sha1(x.cast("binary")), 1, 10)


def fuzzy_date(x: Column | str) -> Column:
    """A date from free text; vague, missing or impossible ones give null."""
    s = F.trim(_c(x))
    pattern = r"(\d{4})[-/年.](\d{1,2})[-/月.](\d{1,2})"
    part = lambda k: F.regexp_extract(s, pattern, k)
    loose = F.when(s.rlike(pattern), F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd"))
    iso = F.when(F.substring(s, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
    return F.when(s.isNull() | (s == "") | F.lower(s).rlike("近期|recent|n/a|未知|未提及"), F.lit(None).cast("date")).otherwise(F.coalesce(iso, loose))


def safe_int(x: Column | str, default: int = 5) -> Column:
    return F.coalesce(_c(x).cast("string").try_cast("double").try_cast("int"), F.lit(default))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def relative_days(x: Column | str) -> Column:
    """Days of texts like "3 weeks ago"; 9999 where unknown."""
    s = F.trim(F.replace(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("updated"), F.lit("")))
    out = F.when((s == "") | s.rlike("just now|second|minute"), F.lit(0.0))
    for unit, days in (("hour", 1 / 24), ("day", 1.0), ("week", 7.0), ("month", 30.0), ("year", 365.0)):
        many = F.regexp_extract(s, rf"(\d+)\s+{unit}", 1)
        out = out.when(F.contains(s, F.lit(unit)), F.when(many != "", many.try_cast("double") * days).otherwise(F.lit(days)))
    return out.otherwise(F.lit(9999.0))


def parse_count(x: Column | str) -> Column:
    """Numbers like "1.2k", "3,400", "2M"."""
    s = F.replace(F.lower(F.trim(F.coalesce(_c(x).cast("string"), F.lit("")))), F.lit(","), F.lit(""))
    number = F.coalesce(F.regexp_extract(s, r"^([\d.]+)\s*([km])?", 1).try_cast("double"), F.lit(0.0))
    unit = F.regexp_extract(s, r"^([\d.]+)\s*([km])?", 2)
    return number * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)


def compact_number(x: Column | str) -> Column:
    """1.2K, 3M: one decimal by the double's exact value, halves up, a zero decimal dropped."""
    n = F.coalesce(_c(x).cast("double"), F.lit(0.0))

    def shown(v: Column, unit: str) -> Column:
        whole = F.floor(v)
        rest = v - whole
        tenth = F.floor(rest * 10)
        tenths = whole * 10 + tenth + (rest >= (tenth * 10 + 5) / 100).cast("long")
        digit = tenths % 10
        return F.concat(F.floor(tenths / 10).cast("string"), F.when(digit > 0, F.concat(F.lit("."), digit.cast("string"))).otherwise(F.lit("")), F.lit(unit))

    whole = F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    return F.when(n >= 1e6, shown(n / 1e6, "M")).when(n >= 1e3, shown(n / 1e3, "K")).otherwise(whole)


def entity_key(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(_c(x), F.lit("")))), r"(?U)[\s\"'()（）\-_、,，。.]", "")


def lead_paragraph(full: Column | str, summary: Column | str) -> Column:
    text, short = F.trim(F.coalesce(_c(full), F.lit(""))), F.trim(F.coalesce(_c(summary), F.lit("")))
    first = F.trim(F.get(F.split(text, r"\n+"), F.lit(0)))
    first = F.when(first == "", text).otherwise(first)
    cut = F.substring(first, 1, 320)
    stop = F.length(F.regexp_extract(cut, r"(?s)^(.*[。．.])", 1))
    return F.when(text == "", short).when(F.length(first) <= 320, first).when(stop > 161, F.substring(cut, F.lit(1), stop)).otherwise(F.concat(cut, F.lit("…")))


def content_blocks(full: Column | str, summary: Column | str) -> Column:
    """Array of (t, text): lines of at most 34 characters without a closing mark are headings."""
    text = F.trim(F.coalesce(F.nullif(_c(full), F.lit("")), _c(summary), F.lit("")))
    lines = F.filter(F.transform(F.split(text, r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    head = lambda x: (F.length(x) <= 34) & ~x.rlike("[。！？!?]$") & ~x.rlike("^https?:")
    return F.transform(lines, lambda x: F.struct(F.when(head(x), "h").otherwise("p").alias("t"), x.alias("text")))


def good_fulltext(full: Column | str, summary: Column | str, least: int = 350, times: float = 2.5) -> Column:
    a, b = F.trim(F.coalesce(_c(full), F.lit(""))), F.trim(F.coalesce(_c(summary), F.lit("")))
    return (a != "") & (a != b) & (F.length(a) >= least) & (F.length(a) >= times * F.length(b))


def clean_generated(x: Column | str) -> Column:
    """Generated text without its opening pleasantries and repeated blank lines."""
    starts = "|".join(dicts.OPENING_LINES)
    body = F.regexp_replace(F.trim(F.coalesce(_c(x), F.lit(""))), rf"\A(?:[^\S\n]*(?:(?:{starts})[^\n]*)?(?:\n|\z))+", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n"), r"(?U)\A\s+|\s+\z", "")


def image_kind(x: Column | str) -> Column:
    head = F.hex(F.substring(_c(x), 1, 12))
    return F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E47"), "png").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").otherwise("png")


def event_key(event_id: Column | str, title: Column | str, url: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(event_id).cast("string"), F.lit("")), F.concat_ws("|", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(url), F.lit(""))))


def published(x: Column | str) -> Column:
    """Feed times to UTC: ISO first, then RFC 822; bad ones give null."""
    s = F.trim(_c(x))
    return F.coalesce(s.try_cast("timestamp"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(s, r"^\w{3}, ", ""), "GMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")))


def crop_box(width: Column, height: Column) -> Column:
    """The centred 16:9 box of a picture, as (x, y, w, h)."""
    w = F.least(width, F.floor(height * 16 / 9)).cast("int")
    h = F.least(height, F.floor(width * 9 / 16)).cast("int")
    return F.struct(F.floor((width - w) / 2).cast("int").alias("x"), F.floor((height - h) / 2).cast("int").alias("y"), w.alias("w"), h.alias("h"))


def cover(kind: Column | str, url: Column | str, category: Column | str, media_base: str = "media") -> Column:
    """A cover as (kind, url, category): remote ones with an http address, local ones under ``media_base``, else the fallback of the category."""
    k, u = _c(kind), F.coalesce(_c(url), F.lit(""))
    remote = (k == "remote") & u.rlike("^https?://")
    local = (k == "local") & (u != "")
    path = F.concat(F.lit(media_base.rstrip("/") + "/"), F.regexp_replace(u, r"^(?:\./|/)+", ""))
    shape = lambda a, b, c: F.struct(F.lit(a).alias("kind"), b.alias("url"), c.alias("category"))
    none = F.lit(None).cast("string")
    return F.when(F.coalesce(remote, F.lit(False)), shape("remote", u, none)).when(F.coalesce(local, F.lit(False)), shape("local", path, none)).otherwise(shape("fallback", none, F.coalesce(_c(category), F.lit(dicts.UNCATEGORIZED))))


def versioned_url(url: Column | str, content: Column | str) -> Column:
    """An address that changes with its content."""
    return F.concat(_c(url), F.lit("?v="), F.substring(F.sha1(_c(content).cast("binary")), 1, 8))


def base_path(x: Column | str) -> Column:
    """A path prefix with one leading and no trailing slash; the root is empty."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(_c(x), F.lit(""))), "^/+", ""), "/+$", "")
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit("/"), inner))


def event_date(date: Column | str, first_published: Column | str) -> Column:
    """The event's own day, else that of its first source."""
    day = lambda c: F.nullif(F.regexp_extract(_c(c).cast("string"), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.try_to_date(F.coalesce(day(date), day(first_published)), "yyyy-MM-dd")


def opensource_raw(sources: Column | str) -> Column:
    """log10(1 + v) of the largest counter over open-source sources, at least 1 where there is one."""
    own = F.filter(_c(sources), lambda s: F.coalesce(s["is_opensource"], F.lit(False)))
    most = F.array_max(F.transform(own, lambda s: F.greatest(F.lit(1.0), *[parse_count(s[k]) for k in ("stars", "pulls", "downloads", "likes", "upvotes")])))
    return F.when(F.size(own) > 0, F.log10(1 + most)).otherwise(F.lit(0.0))


def published_of(structured: list[Column | str], spelled: Column | str) -> Column:
    """The first structured time of an entry that reads as one, else its spelled time; naive ones are UTC."""
    known = [_c(x).cast("string").try_cast("timestamp") for x in structured]
    return F.coalesce(*known, published(spelled))


def split_names(x: Column | str) -> Column:
    """Names of a text divided by ideographic or plain commas or slashes; blank ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), "[、,，/]"), lambda w: F.trim(w)), lambda w: w != "")


def shift_date(x: Column | str, days: int) -> Column:
    return F.date_add(_c(x).cast("date"), days)


def day_label(x: Column | str) -> Column:
    """Month and day without leading zeros, and the weekday's short name."""
    d = _c(x).cast("date")
    return F.concat(F.date_format(d, "M/d"), F.lit(" "), F.date_format(d, "EEE"))


def source_line(names: Column, most: int = 6) -> Column:
    """Distinct source names, the first few, for the line under a report's text."""
    held = F.array_distinct(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""))
    more = F.size(held) - most
    return F.concat(F.array_join(F.slice(held, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(F.lit("")))


def keep_cover(kind: Column | str, url: Column | str, category: Column | str) -> Column:
    """A cover as it is stored: remote and local ones with an address stay as they are, else the category's fallback."""
    k, u, none = _c(kind), _c(url), F.lit(None).cast("string")
    good = F.coalesce(k.isin("remote", "local") & (u != ""), F.lit(False))
    return F.struct(F.when(good, k).otherwise("fallback").alias("kind"), F.when(good, u).otherwise(none).alias("url"), F.when(good, none).otherwise(F.coalesce(_c(category), F.lit(dicts.UNCATEGORIZED))).alias("category"))


SOURCE_TEXTS = ["url", "title", "source_name", "source_kind", "source_region", "published", "stars", "pulls", "task"]
SOURCE_COUNTS = ["downloads", "likes", "upvotes", "context_length"]


def stored_sources(sources: Column, have: list[str]) -> Column:
    """Evidence in the stored shape: texts default to empty, counts to 0, the flag to false; fields that are absent too."""

    def one(s: Column) -> Column:
        got = lambda f: s[f] if f in have else F.lit(None)
        texts = [F.coalesce(got(f).cast("string"), F.lit("")).alias(f) for f in SOURCE_TEXTS]
        counts = [F.coalesce(got(f).cast("string").try_cast("double").try_cast("long"), F.lit(0).cast("long")).alias(f) for f in SOURCE_COUNTS]
        pricing = F.coalesce(s["pricing"], F.create_map().cast("map<string,string>")) if "pricing" in have else F.create_map().cast("map<string,string>")
        return F.struct(*texts, F.coalesce(got("is_opensource").cast("boolean"), F.lit(False)).alias("is_opensource"), *counts, pricing.alias("pricing"))

    return F.transform(sources, one)


def opensource_badges(sources: Column) -> Column:
    """What a card shows of its open-source evidence: the first texts, the largest counts, names in order; null without any."""
    own = F.filter(sources, lambda s: F.coalesce(s["is_opensource"], F.lit(False)))
    first = lambda f: F.coalesce(F.get(F.filter(F.transform(own, lambda s: s[f].cast("string")), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0)), F.lit(""))
    most = lambda f: F.coalesce(F.array_max(F.transform(own, lambda s: F.coalesce(s[f].cast("long"), F.lit(0).cast("long")))), F.lit(0).cast("long"))
    names = F.array_distinct(F.filter(F.transform(own, lambda s: s["source_name"]), lambda x: F.coalesce(x, F.lit("")) != ""))
    ctx = most("context_length")
    window = F.when(ctx >= 1024, F.concat(F.floor(ctx / 1024).cast("string"), F.lit("k"))).when(ctx > 0, ctx.cast("string")).otherwise(F.lit(""))
    return F.when(F.size(own) > 0, F.struct(names.alias("names"), first("stars").alias("stars"), first("pulls").alias("pulls"), most("downloads").alias("downloads"), most("likes").alias("likes"), most("upvotes").alias("upvotes"), window.alias("context"), first("task").alias("task")))


def endpoint(base: Column | str, path: str) -> Column:
    """A service's address: the base without closing slashes, and the path once."""
    bare = F.regexp_replace(F.trim(F.coalesce(_c(base), F.lit(""))), "/+$", "")
    tail = "/" + path.strip("/")
    return F.when(bare == "", F.lit("")).when(bare.endswith(tail), bare).otherwise(F.concat(bare, F.lit(tail)))
