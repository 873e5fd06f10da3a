"""Tables that change together: immutable folders and an append-only manifest (RUN-2, SNK-1, SNK-2, SNK-4).

A commit first writes its rows to folders of its own and then appends one row to the manifest, as one file that Spark's
committer moves into place. Readers look at folders of committed changes only, so all tables of all repositories in a commit
change at once, and a crash between any two writes leaves the old state. Deletes are rows too (tombstones), applied on read;
``compact`` writes the present state as the base of all later reads. One writer commits at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from codelode.session import is_small, maybe_broadcast

Rows = Callable[[dict[str, DataFrame]], DataFrame]
# Repositories whose newest change or delete may be copied to every task.
REPOSITORY_ROWS = 500_000
#: How a table's rows supersede each other: by id, the newest commit counts ("latest"); by repository, the newest commit with
#: rows of it counts ("replace"); or all count ("append").
KINDS = {
    "repositories": ("latest", "id"),
    "repository_status": ("latest", "repository_id"),
    "runs": ("latest", "id"),
    "conversations": ("latest", "id"),
    "messages": ("append", "id"),
    "chunks": ("replace", "repository_id"),
    "postings": ("replace", "repository_id"),
}
#: The column that says to which repository a row belongs; messages belong to their conversation's.
_OWNER = {"repositories": "id", "messages": None}
_MANIFEST = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("commit", T.StringType()),
        T.StructField("base", T.BooleanType()),
        T.StructField("tables", T.ArrayType(T.StringType())),
    ]
)


def _write(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Every write of a commit goes through here."""
    rows.write.mode(mode).parquet(path)


@dataclass(frozen=True)
class CommitLog:
    """The store below ``path``, a folder that all executors share."""

    spark: SparkSession
    path: str

    def visible(self) -> list[tuple[int, str, list[str]]]:
        """(version, commit, tables) of the commits that count, oldest first: the newest base and what came after it."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()
        except Exception as error:  # nothing was ever committed
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise
        base = max((r["version"] for r in rows if r["base"]), default=0)
        return sorted((r["version"], r["commit"], list(r["tables"])) for r in rows if r["version"] >= base)

    def commit(
        self, tables: dict[str, DataFrame | Rows], gone: DataFrame | None = None, base: bool = False, dealt: Collection[str] = ()
    ) -> int:
        """Add rows to ``tables`` and delete everything of the repositories in ``gone(repository_id)``; the version.

        ``latest`` tables hold one row per id in a commit. Rows that are read from this store may be written to it.
        Deletes touch rows of earlier commits only. A table's rows may be a function of the tables that stand before it, as
        this commit has written them. The rows of tables in ``dealt`` lie together by repository and key already and are
        written as they are.
        """
        seen = self.visible()
        version, name = (seen[-1][0] if seen else 0) + 1, uuid.uuid4().hex
        made: dict[str, DataFrame] = {}
        for table, rows in tables.items():
            kind, key = KINDS[table]
            folder = f"{self.path}/data/{table}/{name}"
            if callable(rows):
                rows = rows(made)
            if kind == "replace":
                if table not in dealt:
                    rows = rows.hint("rebalance", key).sortWithinPartitions(key, *(["match_key"] if "match_key" in rows.columns else []))
            _write(rows, folder)
            made[table] = self.spark.read.schema(rows.schema).parquet(folder)
            if kind == "replace":
                _write(made[table].select(key).distinct(), f"{self.path}/changes/{table}/{name}")
        if gone is not None:
            _write(gone.select("repository_id").distinct(), f"{self.path}/data/tombstones/{name}")
        listed = [*tables, *(["tombstones"] if gone is not None else [])]
        entry = self.spark.createDataFrame([(version, name, base, listed)], _MANIFEST)
        _write(entry.coalesce(1), f"{self.path}/manifest", "append")
        return version

    def _rows(self, table: str, folder: str = "data") -> DataFrame | None:
        """All visible rows of a table with the version that wrote them."""
        found = None
        parts = [(version, f"{self.path}/{folder}/{table}/{name}") for version, name, tables in self.visible() if table in tables]
        if parts:
            schema = self.spark.read.parquet(parts[-1][1]).schema
            for version, path in parts:
                rows = self.spark.read.schema(schema).parquet(path).withColumn("_version", F.lit(version))
                found = rows if found is None else found.unionByName(rows)
        return found

    def _alive(self, rows: DataFrame, owner: str) -> DataFrame:
        dead = self._rows("tombstones")
        if dead is None:
            return rows
        last = dead.groupBy(F.col("repository_id").alias("_owner")).agg(F.max("_version").alias("_dead"))
        last = maybe_broadcast(last, is_small(last, REPOSITORY_ROWS))
        joined = rows.join(last, F.col(owner) == F.col("_owner"), "left")
        return joined.where(F.col("_dead").isNull() | (F.col("_version") > F.col("_dead"))).drop("_owner", "_dead")

    def current(self, table: str) -> DataFrame:
        """The rows that count now; LookupError if the table was never written."""
        kind, key = KINDS[table]
        rows = self._rows(table)
        if rows is None:
            raise LookupError(f"nothing committed to {table}")
        columns = [c for c in rows.columns if c != "_version"]
        if kind == "append":
            return self._of_living_conversations(rows).select(*columns)
        rows = self._alive(rows, _OWNER.get(table, "repository_id"))
        if kind == "replace":
            changes = self._rows(table, "changes")
            newest = changes.groupBy(F.col(key).alias("_key")).agg(F.max("_version").alias("_newest"))
            newest = maybe_broadcast(newest, is_small(newest, REPOSITORY_ROWS))
            return rows.join(newest, (F.col(key) == F.col("_key")) & (F.col("_version") == F.col("_newest"))).select(*columns)
        row: Column = F.max_by(F.struct(*columns), F.col("_version"))
        return rows.groupBy(F.col(key).alias("_key")).agg(row.alias("_row")).select("_row.*")

    def _of_living_conversations(self, messages: DataFrame) -> DataFrame:
        dead, talks = self._rows("tombstones"), self._rows("conversations")
        if dead is None or talks is None:
            return messages
        last = dead.groupBy("repository_id").agg(F.max("_version").alias("_dead"))
        # A message goes with the deletes of its conversation's repository that came after it.
        owners = talks.groupBy(F.col("id").alias("conversation_id")).agg(F.max_by("repository_id", "_version").alias("repository_id"))
        fates = owners.join(last, "repository_id").select("conversation_id", "_dead")
        joined = messages.join(fates, "conversation_id", "left")
        return joined.where(F.col("_dead").isNull() | (F.col("_version") > F.col("_dead")))

    def compact(self) -> int:
        """Write the present state as a new base; earlier folders are no longer read."""
        names = {table for _, _, tables in self.visible() for table in tables} - {"tombstones"}
        # Every commit has dealt out its rows by repository, and they are read in the order of its files.
        return self.commit({table: self.current(table) for table in KINDS if table in names}, base=True, dealt=KINDS)
