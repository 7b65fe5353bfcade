"""All-or-nothing publishing of raw items, bids, jobs and errors, and of whole small tables.

Rows are written under folders of their own attempt; a numbered commit makes
them visible, together with everything else the attempt changes: rows deleted
from earlier batches, references set to NULL, new versions of whole tables.
Stored rows are never written anew for that. Deleted rows are lists of ids
beside the batches, applied when a batch is read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidflow import schemas
from bidflow.functions.keys import item_key
from bidflow.plans.commits import LOG_FILES, Commits, Conflict
from bidflow.schemas import FOREIGN_KEYS
from bidflow.shared import COMPRESSION, shuffles_gone

# Keys of stored raw items, so that harvesting again need not read their payloads.
KEYS = T.StructType([T.StructField("source_id", T.LongType()), T.StructField("key", T.StringType())])
IDS = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("id", T.LongType())])

COUNTED = {"raw_items": "raw", "bids": "bid", "jobs": "job", "errors": "error"}

# A writer that loses against others starts again, so many times.
ATTEMPTS = 5


class Warehouse:
    """File tables under one root, for any number of readers and writers.

    A writer works against the last commit it has seen and commits only if it is
    still the last; ``attempt`` runs it again otherwise. Keys of raw items stay
    when the items go, so that an idempotent harvest does not bring them back.
    """

    def __init__(self, spark: SparkSession, root: str, log_files: int = LOG_FILES):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, self.root, log_files)
        self._begun: dict[str, int] = {}
        self._folders: dict[str, str] = {}
        self._changes: dict[str, dict] = {}

    def _read(self, schema: T.StructType, *paths: str, base: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema)
        try:
            return (reader.option("basePath", base) if base else reader).parquet(*paths)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    # --- commits ---

    def manifest(self) -> DataFrame:
        return self.commits.frame()

    def batches(self) -> dict[str, dict]:
        """The committed batches by id; commits of whole tables alone have none."""
        return {r["batch_id"]: r for r in self.commits.rows() if r["batch_id"] is not None}

    def is_committed(self, batch_id: str) -> bool:
        return batch_id in self.batches()

    def last_id(self, table: str) -> int:
        """Highest id ever given in a table, from the commits alone."""
        return max((r[f"max_{COUNTED[table]}_id"] or 0 for r in self.commits.rows()), default=0)

    def last_ids(self) -> tuple[int, int]:
        """Highest raw and bid id of all committed batches."""
        return self.last_id("raw_items"), self.last_id("bids")

    def begin(self, batch_id: str) -> tuple[int, int]:
        """Start an attempt at a batch; the ids it starts after. Its commit fails if another one comes first."""
        self._begun[batch_id] = self.commits.last()
        self._folders[batch_id] = uuid.uuid4().hex
        self._changes[batch_id] = defaultdict(list)
        return self.last_ids()

    def attempt(self, batch_id: str, work: Callable[[], bool], now: datetime, tries: int = ATTEMPTS) -> bool:
        """Run ``work``, which stages a batch, and commit it; again from the start when another writer came first.

        False when the batch is committed already or ``work`` has nothing to write.
        """
        for left in reversed(range(tries)):
            if self.is_committed(batch_id):
                return False
            self.begin(batch_id)
            if not work():
                return False
            try:
                self.commit(batch_id, now)
                return True
            except Conflict:
                if not left:
                    raise
        return False

    # --- batches ---

    def _path(self, table: str, batch_id: str) -> str:
        folder = self._folders.setdefault(batch_id, uuid.uuid4().hex)
        return f"{self.root}/{table}/attempt={folder}/batch_id={batch_id}"

    def stage(self, table: str, batch_id: str, rows: DataFrame, one_day: bool = False) -> None:
        """Write one table's part of a batch. Invisible until ``commit``.

        Rows are regrouped by creation day (AQE splits large days) and laid out
        in day folders so that ``since`` reads prune whole folders; inside a file
        they lie by source and time for row-group pruning. Rows of ``one_day``
        need no regrouping. The keys of raw items are written beside them.
        Columns the table does not have are stored, too, but only ``staged`` reads them.
        """
        parted = rows.withColumn("created_part", F.to_date("created_at"))
        laid_out = (parted if one_day else parted.hint("rebalance", F.col("created_part"))).sortWithinPartitions(
            "created_part", "source_id", "created_at"
        )
        self._write(laid_out, self._path(table, batch_id), "created_part")
        if table == "raw_items":
            keys = self.staged(table, batch_id).select("source_id", item_key().alias("key"))
            self._write(keys, self._path("raw_keys", batch_id))

    def _write(self, rows: DataFrame, path: str, *parts: str) -> None:
        """Write rows to a path of this attempt, in a folder for each value of ``parts``; the shuffles they come from go with it."""
        with shuffles_gone(self.spark):
            rows.write.mode("overwrite").option("compression", COMPRESSION).partitionBy(*parts).parquet(path)

    def staged(self, table: str, batch_id: str, more: Iterable[str] = ()) -> DataFrame:
        """One table's part of a batch as written; ``more`` names text columns that were stored beside its own."""
        extra = [T.StructField(name, T.StringType()) for name in more]
        schema = T.StructType([*schemas.TABLES[table].fields, *extra, T.StructField("created_part", T.DateType())])
        return self._read(schema, self._path(table, batch_id))

    def stage_deletes(self, batch_id: str, table: str, rows: DataFrame) -> bool:
        """Delete stored rows (batch_id, id) with the commit of a batch; False when there are none."""
        path = self._path(f"deleted/{table}", batch_id)
        self._write(rows.select("batch_id", "id"), path)
        counts = self._read(IDS, path).groupBy("batch_id").agg(F.count("*").alias("n")).collect()
        found = [{"table": table, "batch_id": r["batch_id"], "n": r["n"], "path": path} for r in counts]
        self._changes[batch_id]["deletes"] += found
        return bool(found)

    def _stage_releases(self, batch_id: str, table: str, column: str, hit: DataFrame, path: str) -> None:
        """Set a reference to NULL where it is among the ids under ``path``; ``hit``: the rows (batch_id) it concerns."""
        touched = sorted(r["batch_id"] for r in hit.select("batch_id").distinct().collect())
        self._changes[batch_id]["releases"] += [
            {"table": table, "column": column, "batch_id": b, "path": path} for b in touched
        ]

    def tie(self, batch_id: str, others: Iterable[str]) -> None:
        """Remember that a batch has rebuilt others."""
        self._changes[batch_id]["ties"] = sorted(others)

    def commit(self, batch_id: str, now: datetime) -> None:
        """Make a batch and all its changes visible; counts and highest ids come from the files as written."""
        if batch_id not in self._begun:
            self._begun[batch_id] = self.commits.last()
        changes = self._changes.pop(batch_id, {})
        parts = [self.staged(t, batch_id).select(F.lit(short).alias("t"), "id") for t, short in COUNTED.items()]
        counts = reduce(DataFrame.unionAll, parts).groupBy("t").agg(F.count("*").alias("n"), F.max("id").alias("most"))
        found = {r["t"]: r for r in counts.collect()}
        row = {"batch_id": batch_id, "folder": self._folders[batch_id], "committed_at": now, **changes}
        for short in COUNTED.values():
            row[f"{short}_count"] = found[short]["n"] if short in found else 0
            row[f"max_{short}_id"] = found[short]["most"] if short in found else None
        self.commits.add(self._begun.pop(batch_id), row)

    def _state(self, table: str) -> dict[str, dict]:
        """Visible batches of a table: their commit, how many rows are deleted and where, what is released and where."""
        count = f"{COUNTED[table]}_count"
        found: dict[str, dict] = {}
        for r in self.commits.rows():
            for hidden in r["hides"] or ():
                if hidden["table"] == table:
                    found.pop(hidden["batch_id"], None)
            if r["batch_id"] is not None and r[count]:
                found[r["batch_id"]] = {"row": r, "rows": r[count], "deletes": [], "releases": []}
            for d in r["deletes"] or ():
                if d["table"] == table and d["batch_id"] in found:
                    found[d["batch_id"]]["rows"] -= d["n"]
                    found[d["batch_id"]]["deletes"].append(d["path"])
            for d in r["releases"] or ():
                if d["table"] == table and d["batch_id"] in found:
                    found[d["batch_id"]]["releases"].append((d["column"], d["path"]))
        return {b: s for b, s in found.items() if s["rows"]}

    def visible(self, table: str) -> list[str]:
        """Batches that have rows left."""
        return sorted(self._state(table))

    def family(self, batches: Iterable[str]) -> list[str]:
        """All batches tied to the named ones, by having rebuilt them or having been rebuilt."""
        rows, todo, found = self.batches(), list(batches), set()
        unknown = sorted(set(todo) - set(rows))
        if unknown:
            raise ValueError(f"no committed batches {unknown}")
        tied: dict[str, set[str]] = {b: set() for b in rows}
        for b, r in rows.items():
            for other in set(r["ties"] or ()) & set(rows):
                tied[b].add(other)
                tied[other].add(b)
        while todo:
            batch = todo.pop()
            if batch not in found:
                found.add(batch)
                todo += tied[batch]
        return sorted(found)

    def read(
        self, table: str, keep_partition: bool = False, batches: Iterable[str] | None = None, replaced: bool = False
    ) -> DataFrame:
        """Rows that count, of all batches or of those named; ``replaced``: with those that have been deleted.

        Only the folders of these batches are listed. Lists of deleted ids are
        joined to the batches they are about and to no others. Keys of raw items
        are those of all batches, deleted items included.
        """
        wanted = None if batches is None else set(batches)
        keys = table == "raw_keys"
        if keys or replaced:
            count = "raw_count" if keys else f"{COUNTED[table]}_count"
            state = {b: {"row": r, "deletes": [], "releases": []} for b, r in self.batches().items() if r[count]}
            hidden = {h["batch_id"] for r in self.commits.rows() for h in r["hides"] or () if h["table"] == table}
            state = {b: s for b, s in state.items() if b not in hidden}
        else:
            state = self._state(table)
        state = {b: s for b, s in sorted(state.items()) if wanted is None or b in wanted}
        extra = [T.StructField("batch_id", T.StringType())]
        if not keys:
            extra.append(T.StructField("created_part", T.DateType()))
        schema = T.StructType([*(KEYS if keys else schemas.TABLES[table]).fields, *extra])
        changed: dict[tuple, list[str]] = defaultdict(list)
        for b, s in state.items():
            changed[tuple(sorted(set(s["deletes"]))), tuple(sorted(set(s["releases"])))].append(b)
        rows = None
        for (deletes, releases), names in changed.items():
            base = f"{self.root}/{table}"
            folders = [f"{base}/attempt={state[b]['row']['folder']}/batch_id={b}" for b in names]
            part = self._read(schema, *folders, base=base)
            if deletes:
                gone = self._read(IDS, *deletes).where(F.col("batch_id").isin(names))
                part = part.join(gone, ["batch_id", "id"], "left_anti")
            for column in sorted({c for c, _ in releases}):
                gone = self._read(IDS, *[path for c, path in releases if c == column]).select(F.col("id").alias("_gone"))
                part = part.join(gone.distinct(), F.col(column) == F.col("_gone"), "left")
                part = part.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")
            part = part.select(*schema.fieldNames())
            rows = part if rows is None else rows.unionAll(part)
        if rows is None:
            rows = self.spark.createDataFrame([], schema)
        return rows if keep_partition else rows.drop("batch_id", "created_part")

    # --- deletes ---

    def _cascade(self, batch_id: str, parent: str, gone: DataFrame, path: str) -> None:
        """What the foreign keys make of deleting ``gone`` (id; written under ``path``) from ``parent``."""
        for child, column, owner, rule in FOREIGN_KEYS:
            if owner != parent or rule == "restrict":
                continue
            ids = gone.select(F.col("id").alias(column))
            hit = self.read(child, keep_partition=True).join(ids, column, "left_semi").select("batch_id", "id")
            if rule == "set_null":
                self._stage_releases(batch_id, child, column, hit, path)
            elif self.stage_deletes(batch_id, child, hit):
                below = self._path(f"deleted/{child}", batch_id)
                self._cascade(batch_id, child, self._read(IDS, below), below)

    def delete(self, batch_id: str, table: str, ids: DataFrame, now: datetime) -> bool:
        """Delete rows (id) of a table, and what the foreign keys say of their children, in one commit.

        An error, and no change, where a key restricts and children are left.
        False when there is nothing to delete or ``batch_id`` is committed.
        """

        def work() -> bool:
            gone = ids.select("id").distinct()
            for child, column, owner, rule in FOREIGN_KEYS:
                blocked = owner == table and rule == "restrict"
                if blocked and not self.read(child).join(gone.withColumnRenamed("id", column), column, "left_semi").isEmpty():
                    raise ValueError(f"{table} still have {child}")
            path = self._path(f"deleted/{table}", batch_id)
            if table in COUNTED:
                hit = self.read(table, keep_partition=True).select("batch_id", "id").join(gone, "id", "left_semi")
                if not self.stage_deletes(batch_id, table, hit):
                    return False
            else:
                rows = self.current(table)
                hit = rows.select(F.lit(None).cast("string").alias("batch_id"), "id").join(gone, "id", "left_semi")
                hit.write.mode("overwrite").parquet(path)
                if self._read(IDS, path).isEmpty():
                    return False
                left = rows.join(self._read(IDS, path).select("id"), "id", "left_anti")
                self._changes[batch_id]["tables"] = {table: self._write_version(table, left.select(*rows.columns))}
            self._cascade(batch_id, table, self._read(IDS, path), path)
            return True

        return self.attempt(batch_id, work, now)

    def retain(self, batch_id: str, cutoff: datetime, now: datetime) -> bool:
        """Drop stored raw items created before ``cutoff``; False when there are none."""
        old = self.read("raw_items", keep_partition=True).where(
            (F.col("created_part") <= F.lit(cutoff.date())) & (F.col("created_at") < F.lit(cutoff))
        )
        return self.delete(batch_id, "raw_items", old.select("id"), now)

    def delete_sources(self, batch_id: str, ids: DataFrame, now: datetime) -> bool:
        """Delete sources with their raw items; an error, and no change, when bids still refer to them."""
        return self.delete(batch_id, "sources", ids, now)

    # --- whole-table versions ---

    def _write_version(self, table: str, rows: DataFrame) -> str:
        path = f"{self.root}/{table}/version={uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def replace(self, table: str, rows: DataFrame) -> None:
        """Write a new version of a small table next to the old one and switch to it, whatever others have made of it."""
        path = self._write_version(table, rows)
        while True:
            try:
                self.commits.add(self.commits.last(), {"tables": {table: path}})
                return
            except Conflict:
                continue

    def change(self, table: str, make: Callable[[DataFrame], DataFrame], tries: int = ATTEMPTS) -> None:
        """Replace a small table by what ``make`` makes of its current rows; again if another commit came first."""
        for left in reversed(range(tries)):
            base = self.commits.last()
            path = self._write_version(table, make(self.current(table)))
            try:
                self.commits.add(base, {"tables": {table: path}})
                return
            except Conflict:
                if not left:
                    raise

    def current(self, table: str) -> DataFrame:
        for r in reversed(self.commits.rows()):
            if table in (r["tables"] or {}):
                return self._read(schemas.TABLES[table], r["tables"][table])
        return self.spark.createDataFrame([], schemas.TABLES[table])
