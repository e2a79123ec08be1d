"""Where documents, threads and their derived tables are kept.

Every write makes a new generation folder and then moves one pointer row, so
that readers see the old or the new state and never a half.  Rows are sorted
by document in every file, so that a filter on the document skips the others'
row groups; there is no folder per document, which millions of them would break.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA, STRUCTURE = 3, 4


class Store:
    """Parquet tables under ``root`` on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/_pointers"

    def _current(self, name: str):
        """(folder, schema as JSON) of the last committed generation."""
        path = self._pointer(name)
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return None
        return self.spark.read.schema("at long, folder string, fields string").json(path).agg(F.max_by(F.struct("folder", "fields"), "at")).first()[0]

    def read(self, name: str) -> DataFrame | None:
        now = self._current(name)
        return self.spark.read.schema(T.StructType.fromJson(json.loads(now.fields))).parquet(now.folder) if now else None

    def write(self, name: str, rows: DataFrame, **versions: int) -> None:
        """Replaces a table: new folder first, pointer after it is complete."""
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        rows = rows.withColumns({k: F.lit(v) for k, v in versions.items()})
        (rows.sortWithinPartitions("doc") if "doc" in rows.columns else rows).write.parquet(folder)
        self.spark.createDataFrame([(time.time_ns(), folder, rows.schema.json())], "at long, folder string, fields string").coalesce(1).write.mode("append").json(self._pointer(name))

    def replace(self, name: str, doc: str, rows: DataFrame, **versions: int) -> None:
        """Replaces one document's rows of a table."""
        old = self.read(name)
        new = rows.withColumns({k: F.lit(v) for k, v in versions.items()})
        self.write(name, new if old is None else old.where(F.col("doc") != doc).unionByName(new, allowMissingColumns=True))

    def delete(self, name: str, doc: str) -> None:
        old = self.read(name)
        if old is not None:
            self.write(name, old.where(F.col("doc") != doc))

    def needs_reindex(self) -> DataFrame | None:
        """(doc, stale): documents whose chunks have another schema, or no current structure."""
        chunks, structures = self.read("chunks"), self.read("sections")
        if chunks is None:
            return None
        state = chunks.groupBy("doc").agg(F.bool_and(F.coalesce(F.col("schema") == SCHEMA, F.lit(False))).alias("current"))
        if structures is None:
            return state.select("doc", F.lit(True).alias("stale"))
        known = structures.where(F.col("version") == STRUCTURE).select("doc").distinct().withColumn("_s", F.lit(True))
        return state.join(known, "doc", "left").select("doc", (~F.col("current") | F.col("_s").isNull()).alias("stale"))

    # ---- digests: cached summaries by key

    def digests(self, asked: DataFrame) -> DataFrame:
        """``asked`` (doc, key, ...) with the cached text, null where none is kept."""
        kept = self.read("digests")
        if kept is None:
            return asked.withColumn("cached", F.lit(None).cast("string"))
        return asked.join(kept.select("doc", "key", F.col("text").alias("cached")), ["doc", "key"], "left")

    def save_digests(self, rows: DataFrame) -> None:
        """Adds (doc, key, text); a key that is kept already gets the new text."""
        kept = self.read("digests")
        rows = rows.select("doc", "key", "text")
        self.write("digests", rows if kept is None else kept.select("doc", "key", "text").join(rows, ["doc", "key"], "left_anti").unionByName(rows))

    # ---- threads and messages

    def create_thread(self, name: str) -> str:
        """A new thread's id; names have at most 80 characters."""
        doc = uuid.uuid4().hex
        row = self.spark.range(1).select(F.lit(doc).alias("doc"), F.lit((name.strip() or "New thread")[:80]).alias("name"), F.current_timestamp().alias("created_at"), F.lit(None).cast("string").alias("pdf_name"))
        old = self.read("threads")
        self.write("threads", row if old is None else old.unionByName(row, allowMissingColumns=True))
        return doc

    def threads(self) -> DataFrame | None:
        """All threads, newest first."""
        rows = self.read("threads")
        return None if rows is None else rows.orderBy(F.col("created_at").desc(), "doc")

    def append_messages(self, rows: DataFrame) -> None:
        """Adds messages (doc, turn, role, content)."""
        old = self.read("messages")
        self.write("messages", rows if old is None else old.unionByName(rows, allowMissingColumns=True))

    def drop_thread(self, doc: str) -> None:
        for name in ("threads", "messages", "chunks", "sections", "digests"):
            self.delete(name, doc)
