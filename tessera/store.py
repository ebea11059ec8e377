"""Stored analyses and themes on Parquet folders: commits over both, history pages, search, removal, theme changes."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import url
from .functions.numbers import half_up

ANALYSES = "id string, url string, final_url string, route string, theme_id string, site_name string, duration_ms double, tokens string, created_at timestamp"
THEMES = "id string, name string, builtin boolean, archived boolean, updated_at timestamp"


def search_predicate(query: str, *columns: Column) -> Column:
    """LIKE with the user's own % and _ as wildcards, without regard to ASCII case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).like(f"%{query.lower()}%"), F.lit(False))
    return out


def history_page(analyses: DataFrame, themes: DataFrame, page: int, size: int, query: str = "", order: str = "created_at") -> DataFrame:
    """One page of analyses with their theme's name, newest first, then by id. A page beyond the end is the last one."""
    rows = analyses.join(themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme_name")), "theme_id", "left")
    if query:
        rows = rows.where(search_predicate(query, F.col("url"), F.col("theme_name"), F.col("site_name")))
    last = max(1, -(-rows.count() // size))
    return rows.orderBy(F.col(order).desc(), F.col("id")).offset((min(max(1, page), last) - 1) * size).limit(size)


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was made from."""


class Store:
    """Tables as parts and removals that a manifest names, so a commit over several tables shows at once or not at all.

    A commit appends Parquet parts, records removed ids as small tables of their own, and then creates the manifest of the next version, which exists once only: of two writers
    that started from one version the second is refused and can try again from the new one. Readers use one manifest throughout; nothing that it names is ever rewritten. Creating a file that must not
    exist is atomic in HDFS and in object stores with conditional puts; a local file system checks first and then creates.
    """

    TABLES = {"analyses": ANALYSES, "themes": THEMES}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm  # noqa: SLF001
        self._files = self._path("manifests").getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def version(self) -> int:
        """The last committed version, -1 for none."""
        where = self._path("manifests")
        if not self._files.exists(where):
            return -1
        names = (s.getPath().getName() for s in self._files.listStatus(where))
        return max((int(n[1:-5]) for n in names if n.endswith(".json") and n[1:-5].isdigit()), default=-1)

    def _manifest(self, version: int) -> dict[str, dict[str, list]]:
        if version < 0:
            return {t: {"parts": [], "removals": []} for t in self.TABLES}
        stream = self._files.open(self._path(f"manifests/v{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table's rows at a version, the last one if none is named. A removal hides the rows of earlier commits only."""
        empty = self.spark.createDataFrame([], self.TABLES[table])
        of = self._manifest(self.version() if version is None else version)[table]
        rows = None
        for at, name in of["parts"]:
            part = self.spark.read.parquet(f"{self.folder}/{name}")
            for field in empty.schema:  # columns added since
                if field.name not in part.columns:
                    part = part.withColumn(field.name, F.lit(None).cast(field.dataType))
            part = part.withColumn("_at", F.lit(at))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if rows is None:
            return empty
        if of["removals"]:
            gone = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.folder}/{name}").select("id", F.lit(at).alias("_gone")) for at, name in of["removals"]))
            rows = rows.join(gone.groupBy("id").agg(F.max("_gone").alias("_gone")), "id", "left").where(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_at"))).drop("_gone")
        return rows.drop("_at")

    def commit(self, expected: int, append: dict[str, DataFrame] | None = None, remove: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> int:
        """Adds rows, removes ids (a column id) and replaces tables, together, on top of version expected; the new version. Removals take rows of earlier commits, so a row can be removed and added anew in one commit."""
        at = expected + 1
        made = self._manifest(expected)
        written: list[str] = []

        def put(kind: str, rows: DataFrame) -> list:
            name = f"data/{kind}-{uuid.uuid4().hex}"
            written.append(name)
            rows.write.parquet(f"{self.folder}/{name}")
            return [at, name]

        for table, rows in (replace or {}).items():
            made[table] = {"parts": [put(table, rows)], "removals": []}
        for table, ids in (remove or {}).items():
            made[table]["removals"].append(put(f"{table}-gone", ids.select("id").distinct()))
        for table, rows in (append or {}).items():
            made[table]["parts"].append(put(table, rows))
        try:
            if self.version() != expected:
                raise Conflict(f"version {expected} is not the last one")
            self._create(f"manifests/v{at}.json", json.dumps(made))
        except Conflict:
            for name in written:
                self._files.delete(self._path(name), True)
            raise
        return at

    def _create(self, name: str, text: str) -> None:
        try:
            out = self._files.create(self._path(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
                raise Conflict(f"{name} was written by another writer") from e
            raise
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def write(self, table: str, rows: DataFrame) -> None:
        """Replaces a table."""
        self.commit(self.version(), replace={table: rows})

    def save(self, analyses: DataFrame, expected: int | None = None) -> int:
        """Appends analyses, URLs sanitised and routes filled in; ids that are there already are replaced."""
        clean = analyses.withColumn("url", url.sanitised(F.col("url"))).withColumn("final_url", url.sanitised(F.col("final_url")))
        route = url.route_identity(F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url")))
        clean = clean.withColumn("route", F.coalesce(F.nullif(F.col("route"), F.lit("")), route))
        duration = F.when((F.col("duration_ms") >= 0) & (F.col("duration_ms") < float("inf")), half_up(F.col("duration_ms")))
        return self.commit(self.version() if expected is None else expected, {"analyses": clean.withColumn("duration_ms", duration)}, {"analyses": clean})

    def delete(self, ids: DataFrame, expected: int | None = None) -> int:
        """Removes analyses by id."""
        return self.commit(self.version() if expected is None else expected, remove={"analyses": ids})

    def _change_themes(self, expected: int | None, themes: DataFrame, moved: DataFrame) -> int:
        """themes: rows that stand instead of those of their ids; moved: theme_id and to, what analyses of a theme that goes belong to from now on. Only what changes is written."""
        base = self.version() if expected is None else expected
        rows = self.read("analyses", base)
        changed = rows.join(moved, "theme_id").withColumn("theme_id", F.col("to")).select(*rows.columns)
        gone = moved.select(F.col("theme_id").alias("id")).unionByName(themes.select("id"))
        return self.commit(base, {"analyses": changed, "themes": themes}, {"analyses": changed.select("id"), "themes": gone})

    def merge_themes(self, expected: int | None = None) -> int:
        """Themes whose names differ in case only become the one updated last; analyses follow, in the same commit."""
        base = self.version() if expected is None else expected
        themes = self.read("themes", base)
        keep = themes.groupBy(F.lower("name").alias("_k")).agg(F.max_by("id", F.struct("updated_at", "id")).alias("to"))
        moved = themes.withColumn("_k", F.lower("name")).join(keep, "_k").where("id <> to").select(F.col("id").alias("theme_id"), "to")
        return self._change_themes(base, themes.where("false"), moved)

    def update_themes(self, changes: DataFrame, expected: int | None = None) -> int:
        """Renames and archives themes: changes has id, name and archived, null for what stays. Built-in themes and unknown ids stay as they are."""
        base = self.version() if expected is None else expected
        new = changes.select("id", F.col("name").alias("_name"), F.col("archived").alias("_archived"))
        themes = self.read("themes", base)
        out = themes.where(~F.coalesce("builtin", F.lit(False))).join(new, "id").withColumns({"name": F.coalesce("_name", "name"), "archived": F.coalesce("_archived", "archived"), "updated_at": F.current_timestamp()})
        return self._change_themes(base, out.select(*themes.columns), self._nothing_moved())

    def delete_themes(self, ids: DataFrame, expected: int | None = None) -> int:
        """Removes themes that are not built in; their analyses belong to none afterwards."""
        base = self.version() if expected is None else expected
        themes = self.read("themes", base)
        going = themes.where(~F.coalesce("builtin", F.lit(False))).join(ids.select("id"), "id", "left_semi")
        return self._change_themes(base, themes.where("false"), going.select(F.col("id").alias("theme_id"), F.lit(None).cast("string").alias("to")))

    def _nothing_moved(self) -> DataFrame:
        return self.spark.createDataFrame([], "theme_id string, to string")

    def themes(self, archived: bool = False, version: int | None = None) -> DataFrame:
        """Themes with the number of their analyses, built-in ones first, then the last updated; archived ones only if asked for."""
        counts = self.read("analyses", version).groupBy("theme_id").agg(F.count(F.lit(1)).alias("analyses"))
        rows = self.read("themes", version).where(F.lit(archived) | ~F.coalesce("archived", F.lit(False)))
        listed = rows.join(counts.withColumnRenamed("theme_id", "id"), "id", "left").withColumn("analyses", F.coalesce("analyses", F.lit(0)))
        return listed.orderBy(F.coalesce("builtin", F.lit(False)).desc(), F.col("updated_at").desc_nulls_last(), "id")
