"""Projects' tables with versions to go back to (CAT-7, CAT-8), switched by commit records instead of copies.

A state holds a set of projects' rows of every table and is never changed. A pointer says which state a project is in, a
version names a state to come back to. All that one call writes lies under the number of its step, and counts only once a
commit record of one row, written last, names that number: readers see the whole step or nothing of it. A snapshot and a
restore therefore write a row for each project, whatever the projects hold. Every step writes pointers and versions, if only
empty ones, so what a failed one left is written over by the next. Writers hold a lock of their own, as two at a time would commit the same number. States are kept for good.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "project_id long, state int, version_id string"
_VERSION = "version_id string, project_id long, state int, reason string, created timestamp, status string, completed int, progress int"


class Versions:
    """The store under a path. Tables have a project_id; `chapters` has chapter_no, status and content besides."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]) -> None:
        if "chapters" not in schemas:
            raise ValueError("a store of versions needs a table of chapters")
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    # ---- reading --------------------------------------------------------------------------------------------------

    def _stored(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def last(self) -> int:
        """The number of the last commit, 0 before the first."""
        return self._stored("commits", "number int").agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]

    def _steps(self, name: str, schema: str, at: int) -> DataFrame:
        return self._stored(name, schema + ", step int").filter(F.col("step") <= at)

    def pointers(self, at: int | None = None) -> DataFrame:
        """(project_id, state, version_id) as of a commit; version_id is that of the last restore, null after a save."""
        rows = self._steps("pointers", _POINTER, self.last() if at is None else at)
        newest = rows.groupBy("project_id").agg(F.max_by(F.struct("state", "version_id"), "step").alias("x"))
        return newest.select("project_id", "x.state", "x.version_id")

    def current(self, table: str, at: int | None = None) -> DataFrame:
        """A table's rows as of a commit, the last one if none is named."""
        at = self.last() if at is None else at
        rows = self._stored(table, self.schemas[table] + ", state int").filter(F.col("state") <= at)
        return rows.join(self.pointers(at).select("project_id", "state"), ["project_id", "state"], "left_semi").drop("state").select(*self._columns(table))

    def versions(self, at: int | None = None) -> DataFrame:
        """CAT-9's input: all versions with the step that made them."""
        return self._steps("versions", _VERSION, self.last() if at is None else at)

    def _columns(self, table: str) -> list[str]:
        return self.spark.createDataFrame([], self.schemas[table]).columns

    # ---- writing --------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def _commit(self, number: int) -> None:
        self.spark.createDataFrame([(number,)], "number int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def save(self, frames: dict[str, DataFrame], projects: DataFrame | None = None, into_empty: bool = False) -> int:
        """Replaces all tables of the projects that occur in frames, or in `projects`, by the rows given, and returns the
        commit. Every table must be given; rows without a project are refused, other columns than the schema's are left
        out. A project of `projects` without rows becomes empty; rows of projects that `projects` lacks are refused.
        With `into_empty`, a store that has any commit is refused."""
        was = self.last()
        if into_empty and was:
            raise ValueError("the store is not empty")
        if set(frames) != set(self.schemas):
            raise ValueError(f"tables {sorted(self.schemas)} are needed, not {sorted(frames)}")
        number = was + 1
        for name, df in frames.items():
            self._write(df.select(*self._columns(name)), f"{name}/state={number}")
        ids = [self.spark.read.schema(self.schemas[n]).parquet(f"{self.path}/{n}/state={number}").select("project_id") for n in frames]
        named = ids[0]
        for more in ids[1:]:
            named = named.unionByName(more)
        named = named.distinct()
        chosen = named if projects is None else projects.select(F.col("project_id").cast("long").alias("project_id")).distinct()
        if not named.filter("project_id is null").isEmpty() or (projects is not None and not named.join(chosen, "project_id", "left_anti").isEmpty()):
            raise ValueError("rows without a project, or of a project that is not saved")
        self._write(chosen.filter("project_id is not null").select("project_id", F.lit(number).alias("state"), F.lit(None).cast("string").alias("version_id")), f"pointers/step={number}")
        self._write(self.spark.createDataFrame([], _VERSION), f"versions/step={number}")
        self._commit(number)
        return number

    def _versioned(self, ids: DataFrame, reason: str, created: datetime | None, number: int, at: int, share: int, all_of: int) -> DataFrame:
        """Version rows of those projects that have any content. Progress: `share` for each chapter after 0 that is complete
        and has content, 100 if there are `all_of` chapters and all of them are."""
        filled = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)\s+", " ")) != ""
        complete = filled & F.coalesce(F.col("status") == "complete", F.lit(False))
        c = self.current("chapters", at).join(ids.select("project_id").distinct(), "project_id", "left_semi")
        c = c.groupBy("project_id").agg(F.count_if(filled).alias("filled"), F.count_if(complete & (F.col("chapter_no") > 0)).cast("int").alias("completed"), ((F.count("*") == all_of) & F.bool_and(complete)).alias("whole")).filter("filled > 0")
        c = c.join(self.pointers(at).select("project_id", "state"), "project_id")
        return c.select(F.concat(F.lit(f"v{number}-"), F.col("project_id").cast("string")).alias("version_id"), "project_id", "state", F.lit(reason).alias("reason"), (F.lit(created) if created else F.current_timestamp()).cast("timestamp").alias("created"),
                        F.when(F.col("whole"), "complete").otherwise("interrupted").alias("status"), "completed", F.when(F.col("whole"), 100).otherwise(F.col("completed") * share).cast("int").alias("progress"))

    def snapshot(self, projects: DataFrame, reason: str, created: datetime | None = None, share: int = 9, all_of: int = 11) -> DataFrame:
        """CAT-7: makes a version of each of projects(project_id) as it is now, and returns the versions made. Unknown
        projects, and those without content, get none."""
        at = self.last()
        self._write(self._versioned(projects, reason, created, at + 1, at, share, all_of), f"versions/step={at + 1}")
        self._write(self.spark.createDataFrame([], _POINTER), f"pointers/step={at + 1}")
        self._commit(at + 1)
        return self.versions(at + 1).filter(F.col("step") == at + 1)

    def restore(self, chosen: DataFrame, reason: str = "before a restore", created: datetime | None = None, share: int = 9, all_of: int = 11) -> DataFrame:
        """CAT-8: puts projects back to versions, chosen(project_id, version_id), and returns (project_id, state, version_id) of
        those put back. What each of them holds is kept as a version first, in the same commit, if it has content. A version
        of another project, or one that doesn't exist, changes nothing; of several for one project the newest counts."""
        at = self.last()
        number = at + 1
        found = chosen.select("project_id", "version_id").distinct().join(self.versions(at), ["project_id", "version_id"])
        target = found.groupBy("project_id").agg(F.max_by(F.struct("state", "version_id"), "step").alias("x")).select("project_id", "x.state", "x.version_id")
        self._write(target, f"pointers/step={number}")
        target = self.spark.read.schema(_POINTER).parquet(f"{self.path}/pointers/step={number}")
        self._write(self._versioned(target, reason, created, number, at, share, all_of), f"versions/step={number}")
        self._commit(number)
        return target
