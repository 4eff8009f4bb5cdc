"""The day store: Parquet partitioned by date, with a summary table beside it."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators import aggregates
from eventloom.session import Scratch

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


def last_of_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key the last stays; partial maxima before the shuffle."""
    names = df.columns
    best = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.col(order)).alias("_row"))
    return best.select("_row.*")


#: Types of a document's columns, for a store that holds nothing yet; others are strings there.
DOCUMENT = {"date": "date", "seq": "long", "importance": "int", "mention_count": "int", "is_top": "boolean", "tags": "array<string>", "who": "array<string>", "generated_at": "timestamp"}


class ShortDay(RuntimeError):
    """A day that is to be rewritten can't be read whole."""


class EventStore:
    """Days of documents and their summaries. Reads prune to the dates asked for; writes replace whole days.

    A write puts its days into version folders of their own (``date=.../v=...``), which no read
    sees. Then one file, moved into place by a rename, names the version of every day, its rows
    and its files with their sizes, for documents and summaries alike: readers see all of a
    write or nothing, and a failed one leaves the days before it. A day whose files aren't those
    that were committed is bad: reads leave it out whole and ``bad_days`` names it, and nothing is
    rewritten from it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.events_path, self.summary_path, self.commits_path = f"{self.root}/events", f"{self.root}/daily_summary", f"{self.root}/commits"

    # --- files

    def _files(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _listed(self, path: str) -> dict[str, int]:
        """Names and sizes of a folder's data files."""
        files, where = self._files(), self._path(path)
        if not files.exists(where):
            return {}
        return {e.getPath().getName(): e.getLen() for e in files.listStatus(where) if e.isFile() and not e.getPath().getName().startswith(("_", "."))}

    def _commit(self) -> dict:
        """The last commit: number, shape, and the days with version, rows and files."""
        names = [n for n in self._listed(self.commits_path) if re.fullmatch(r"\d{20}\.json", n)]
        if not names:
            return {"number": 0, "shape": None, "days": {}}
        text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.commits_path}/{max(names)}").collect())  # a line a commit
        return json.loads(text)

    def _publish(self, commit: dict) -> None:
        files, name = self._files(), f"{commit['number']:020d}.json"
        staged, final = self._path(f"{self.commits_path}/_{uuid.uuid4().hex}"), self._path(f"{self.commits_path}/{name}")
        files.mkdirs(self._path(self.commits_path))
        out = files.create(staged, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        if files.exists(final) or not files.rename(staged, final):
            files.delete(staged, False)
            raise RuntimeError(f"another write has made commit {commit['number']}; nothing was changed")

    # --- reads

    def _whole(self, commit: dict) -> tuple[list[str], list[str]]:
        """Days whose files are as committed, and the others."""
        good, bad = [], []
        for day, held in sorted(commit["days"].items()):
            same = all(self._listed(f"{top}/date={day}/v={held['v']}") == held[kind] for top, kind in ((self.events_path, "events"), (self.summary_path, "summary")))
            (good if same else bad).append(day)
        return good, bad

    def bad_days(self) -> list[str]:
        """Days that reads leave out, because files are missing, cut short or not theirs."""
        return self._whole(self._commit())[1]

    def _read(self, top: str, commit: dict, days: list[str], shape: T.StructType | None) -> DataFrame | None:
        paths = [f"{top}/date={d}/v={commit['days'][d]['v']}" for d in days]
        if not paths:
            return None
        read = self.spark.read.option("basePath", top)
        # Partition columns are read as they are named, not guessed.
        read = read.schema(T.StructType([*shape.fields, T.StructField("v", T.StringType())])) if shape else read
        return read.parquet(*paths).drop("v")

    def events(self) -> DataFrame | None:
        """All good days, in the columns of all writes so far."""
        commit = self._commit()
        days = self._whole(commit)[0]
        return self._read(self.events_path, commit, days, T.StructType.fromJson(commit["shape"])) if days else None

    def list_dates(self) -> list[str]:
        """Newest first; a bad day is listed too."""
        return sorted((d for d in self._commit()["days"] if _DAY.fullmatch(d)), reverse=True)

    def range(self, start: str | None = None, end: str | None = None) -> DataFrame | None:
        """[start, end]: end defaults to the latest day, start to end; reversed bounds are swapped, bad ones raise."""
        for d in (start, end):
            if d is not None and not _DAY.fullmatch(d):
                raise ValueError(f"not a date: {d}")
        days = self.list_dates()
        if not days:
            return None
        end = end or days[0]
        start = start or end
        start, end = min(start, end), max(start, end)
        found = self.events()
        return found if found is None else found.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

    def day(self, day: str) -> DataFrame | None:
        """One day; none where it is missing or bad."""
        commit = self._commit()
        if day not in commit["days"] or day in self._whole({"days": {day: commit["days"][day]}})[1]:
            return None
        return self.range(day, day)

    def rows_committed(self, day: str) -> int | None:
        """How many documents the day was committed with."""
        held = self._commit()["days"].get(day)
        return held["rows"] if held else None

    def history(self, today: str, days: int = 30, columns: list[str] | None = None) -> DataFrame:
        """[today - days, today - 1] with only the columns asked for; empty where nothing is stored."""
        found = self.events()
        if found is None:
            return self.spark.createDataFrame([], ", ".join(f"`{c}` {DOCUMENT.get(c, 'string')}" for c in columns or ["event_id", "date"]))
        t = F.lit(today).cast("date")
        found = found.where((F.col("date") >= F.date_sub(t, days)) & (F.col("date") < t))
        return found.select(*columns) if columns else found

    def ranged(self, start: str | None = None, end: str | None = None) -> DataFrame | None:
        """A range in the order of the list: newest day, importance, mentions."""
        found = self.range(start, end)
        return found if found is None else found.orderBy(F.col("date").desc(), F.col("importance").desc(), F.col("mention_count").desc(), "event_id")

    def summaries(self) -> DataFrame | None:
        commit = self._commit()
        found = self._read(self.summary_path, commit, self._whole(commit)[0], None)
        return found if found is None else found.orderBy(F.col("date").desc())

    # --- writes

    def write_days(self, docs: DataFrame, unique: bool = False, order: str = "seq") -> None:
        """Replace the days that ``docs`` holds; ``unique`` keeps the last of each (date, event_id). Documents and summaries are committed together."""
        docs = last_of_key(docs, ["date", "event_id"], order) if unique else docs
        docs = Scratch(self.spark, "write-days").save(docs, "docs")
        before, version = self._commit(), uuid.uuid4().hex[:12]
        rows = {str(r["date"]): r["n"] for r in docs.where(F.col("date").isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("n")).collect()}  # a write's days
        if not rows:
            return
        self._stage(docs.where(F.col("date").isNotNull()), self.events_path, version)
        self._stage(aggregates.daily_summary(docs.where(F.col("date").isNotNull())), self.summary_path, version)
        fresh = {d: {"v": version, "rows": n, "events": self._listed(f"{self.events_path}/date={d}/v={version}"), "summary": self._listed(f"{self.summary_path}/date={d}/v={version}")} for d, n in rows.items()}
        self._publish({"number": before["number"] + 1, "shape": self._shape(before, docs.schema).jsonValue(), "days": before["days"] | fresh})

    def _stage(self, rows: DataFrame, top: str, version: str) -> None:
        rows.withColumn("v", F.lit(version)).write.mode("append").partitionBy("date", "v").parquet(top)

    def _shape(self, before: dict, fresh: T.StructType) -> T.StructType:
        """The columns of all writes so far, the day last."""
        old = T.StructType.fromJson(before["shape"]) if before["shape"] else T.StructType()
        names = [f.name for f in fresh.fields]
        fields = [f for f in fresh.fields if f.name != "date"] + [f for f in old.fields if f.name not in names and f.name != "date"]
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in [*fields, fresh["date"]]])

    def clear_versions(self) -> int:
        """Delete version folders that the last commit doesn't name, and older commits; how many folders went. For times without writers or readers."""
        commit, files, gone = self._commit(), self._files(), 0
        for top in (self.events_path, self.summary_path):
            if not files.exists(self._path(top)):
                continue
            for day in files.listStatus(self._path(top)):
                name = day.getPath().getName()
                held = commit["days"].get(name[5:], {}).get("v") if name.startswith("date=") else None
                for version in files.listStatus(day.getPath()) if name.startswith("date=") else []:
                    if version.getPath().getName() != f"v={held}":
                        gone += bool(files.delete(version.getPath(), True))
        for name in self._listed(self.commits_path):
            if name != f"{commit['number']:020d}.json":
                files.delete(self._path(f"{self.commits_path}/{name}"), False)
        return gone

    def import_missing(self, docs: DataFrame, overwrite: bool = False) -> None:
        """Days that are absent (or all, to overwrite), by importance and mentions; the days' names are a short list."""
        have = [] if overwrite else self.list_dates()
        fresh = docs.where(~F.col("date").cast("string").isin(have)) if have else docs
        self.write_days(fresh.repartition("date").sortWithinPartitions("date", F.col("importance").desc(), F.col("mention_count").desc()))

    def whole_days(self, days: list[str]) -> DataFrame | None:
        """The documents of these days, for a rewrite: raises ``ShortDay`` where a stored one can't be read whole."""
        commit = self._commit()
        stored = {d: commit["days"][d] for d in days if d in commit["days"]}
        good, bad = self._whole({"days": stored})
        if bad:
            raise ShortDay(f"not whole: {', '.join(bad)}")
        return self._read(self.events_path, commit, good, T.StructType.fromJson(commit["shape"])) if good else None

    def update_columns(self, changes: DataFrame, columns: list[str]) -> None:
        """Rewrite only the days of ``changes`` (date, event_id, and the columns), with the new values where there are any."""
        days = [str(r["date"]) for r in changes.select("date").distinct().collect()]  # a maintenance job's days
        old = self.whole_days(days)
        if old is None:
            return
        new = changes.select("date", "event_id", *[F.col(c).alias(f"_new_{c}") for c in columns])
        out = old.join(new, ["date", "event_id"], "left")
        for c in columns:
            out = out.withColumn(c, F.coalesce(f"_new_{c}", c))
        self.write_days(out.select(*old.columns))

    def regenerate(self, eligible, make, columns: list[str], start: str | None = None, end: str | None = None, only_top: bool = True) -> int:
        """Make ``columns`` anew for stored documents that ``eligible`` (a Column) selects, the top ones only unless told otherwise.

        ``make`` gives a table (date, event_id, the columns) from the documents chosen; rows that it
        leaves out or gives nulls for keep what they have. Returns how many were chosen.
        """
        found = self.range(start, end)
        if found is None:
            return 0
        chosen = found.where(eligible & F.coalesce("is_top", F.lit(False))) if only_top else found.where(eligible)
        chosen = Scratch(self.spark, "regenerate").save(chosen, "chosen")
        n = chosen.count()
        if n:
            self.update_columns(Scratch(self.spark, "regenerate").save(make(chosen).select("date", "event_id", *columns), "made"), columns)
        return n


def import_json_days(spark: SparkSession, glob: str, top_glob: str | None = None) -> DataFrame:
    """Daily JSON files, an array of events each, the date in the file's name; ids of the optional top files are marked."""
    day = F.try_to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    raw = spark.read.option("multiLine", True).json(glob).withColumn("date", day)
    if not top_glob:
        return raw
    top = spark.read.option("multiLine", True).json(top_glob).withColumn("date", day).select("date", "event_id", F.lit(True).alias("_top")).distinct()
    return raw.join(top, ["date", "event_id"], "left").withColumn("is_top", F.coalesce("_top", F.lit(False))).drop("_top")


def write_json(docs: DataFrame, path: str) -> None:
    """The day's list and its top list as JSON lines, and a head of totals beside each."""
    for name, rows in (("db", docs), ("top", docs.where(F.coalesce("is_top", F.lit(False))))):
        rows.write.mode("overwrite").json(f"{path}/{name}")
        counts = rows.groupBy("category_label").agg(F.count(F.lit(1)).alias("n"))
        head = counts.agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category_label", "n")))).alias("by_category_label"))
        head.select(F.coalesce("total", F.lit(0)).alias("total"), "by_category_label").write.mode("overwrite").json(f"{path}/{name}_head")


def to_documents(events: DataFrame, top: DataFrame, labels: dict[str, str], date) -> DataFrame:
    """Event documents: defaults filled, label and top flag joined, the origin of tags told by their presence."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    flags = top.select("event_id").distinct().withColumn("_top", F.lit(True))
    out = events.join(flags, "event_id", "left")
    return out.select(
        "event_id", F.lit(date).cast("date").alias("date"), "seq", "title", "summary", F.coalesce("category", F.lit("uncategorized")).alias("category"), F.coalesce(F.try_element_at(names, F.col("category")), F.lit("其他")).alias("category_label"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.when(F.col("tags").isNotNull(), "extract").otherwise("none").alias("tags_by"), F.coalesce("importance", F.lit(0)).alias("importance"), F.coalesce("mention_count", F.lit(1)).alias("mention_count"), F.coalesce("_top", F.lit(False)).alias("is_top"),
    )


def flatten_rows(docs: DataFrame) -> DataFrame:
    """A flat projection for spreadsheets."""
    return docs.select("date", "category_label", "title", "summary", "importance", "mention_count", F.array_join("tags", ", ").alias("tags"), "is_top")


def write_sheets(docs: DataFrame, path: str) -> None:
    """CSV files of all rows and of each category."""
    flat = flatten_rows(docs)
    every = flat.withColumn("sheet", F.lit("all")).unionByName(flat.withColumn("sheet", F.col("category_label")))
    every.write.mode("overwrite").partitionBy("sheet").option("header", True).csv(path)


def missing_days(have: DataFrame, start, end) -> DataFrame:
    """Dates of [start, end] without a partition."""
    spark = have.sparkSession
    every = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return every.join(have.select("date").distinct(), "date", "left_anti")


