"""The index as versioned snapshots on Parquet.

A commit writes new tables beside the old ones and then one small file that names the
tables of the next version. The greatest version counts, so readers see the old index
or the new one, and a failure before that file leaves the index as it was. The file of
a version is made only if there is none: of two writers that began at the same version
one fails and nothing is lost. Tables with a ``file_path`` are kept in buckets of its
hash, and a run rewrites the buckets that it touches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 3
TABLES = {
    "files": "path string, hash string, chunks int, indexed string, size long, embedded boolean, metadata string",
    "parents": "id string, file_path string, content string, line_start int, line_end int, heading string, hash string, indexed_at string, tokens int",
    "chunks": "id string, file_path string, chunk_content string, line_start int, line_end int, chunk_hash string, indexed_at string, tokens int, parent_id string",
    "vectors": "id string, file_path string, embedding array<float>",
    "meta": "key string, value string",
}


BUCKETED, BUCKETS = ("parents", "chunks", "vectors"), 64


class IndexStore:
    """A snapshot index in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest version; 0 for an empty store."""
        at = self._path(f"{self.root}/versions")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _snapshot(self) -> dict[str, list[str]]:
        """Folders of each table in the newest version."""
        number = self.version()
        if not number:
            return {}
        rows = self.spark.read.text(f"{self.root}/versions/{number:010d}.json").collect()  # one line
        return json.loads("".join(r.value for r in rows))

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.root}/{at}" for at in folders))

    def table(self, name: str) -> DataFrame:
        return self._read(name, self._snapshot().get(name, []))

    def _write(self, name: str, df: DataFrame) -> list[str]:
        """The folders of a new copy of a table: one, or one for each bucket that has rows."""
        at = f"{name}/{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows = df.select(*columns)
        if name not in BUCKETED:
            rows.write.mode("errorifexists").parquet(f"{self.root}/{at}")
            return [at]
        rows = rows.withColumn("_bucket", bucket(F.col("file_path")))
        # a bucket is written by several tasks, so that a hot file does not make one of them large
        rows = rows.repartition("_bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
        rows.write.mode("errorifexists").partitionBy("_bucket").parquet(f"{self.root}/{at}")
        there = self._fs.listStatus(self._path(f"{self.root}/{at}"))
        return [f"{at}/{x.getPath().getName()}" for x in there if x.getPath().getName().startswith("_bucket=")]

    def commit(self, base: int | None = None, **tables: DataFrame) -> None:
        """New copies of some tables; the others keep theirs. All become visible at once, or a RuntimeError is raised.

        ``base`` is the version that the tables were made from, if they were.
        """
        base = self.version() if base is None else base
        now = dict(self._snapshot())
        self._publish(base, now | {name: self._write(name, df) for name, df in tables.items()})

    def _publish(self, base: int, folders: dict[str, list[str]]) -> None:
        if self.version() != base:
            raise RuntimeError("the index was changed meanwhile")
        at = self._path(f"{self.root}/versions/{base + 1:010d}.json")
        staged = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(staged, at):
            self._fs.delete(staged, False)
            raise RuntimeError("the index was changed meanwhile")

    def replace_files(
        self, files: DataFrame, parents: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, values: dict[str, str] | None = None
    ) -> None:
        """Everything of the given files, and some values, in one commit; their metadata stays unless it is given.

        Only buckets that hold one of the files are written anew.
        """
        base, now = self.version(), self._snapshot()
        gone = files.select(F.col("path").alias("file_path")).distinct()
        touched = {r[0] for r in gone.select(bucket(F.col("file_path"))).distinct().collect()}  # at most BUCKETS
        new = {"files": self._write("files", upsert_files(self.table("files"), files))}
        for name, rows in (("parents", parents), ("chunks", chunks), ("vectors", vectors)):
            mine, rest = [], []
            for at in now.get(name, []):
                (mine if _number(at) in touched else rest).append(at)
            kept = self._read(name, mine).join(gone, "file_path", "left_anti")
            new[name] = rest + self._write(name, kept if rows is None else kept.unionByName(rows.select(kept.columns)))
        if values:
            new["meta"] = self._write("meta", self._with_values(values))
        self._publish(base, now | new)

    def prune(self, targets: DataFrame) -> None:
        """Files that are not in ``targets(path)`` go, with all that is theirs."""
        base = self.version()
        self.commit(base, **{n: pruned(self.table(n), targets) for n in ("files", "parents", "chunks", "vectors")})

    def set_metadata(self, tags: DataFrame) -> None:
        """``tags(path, metadata)``; null clears. Paths that are not indexed change nothing."""
        base = self.version()
        self.commit(base, files=apply_tags(self.table("files"), tags))

    def replace_rows(self, files: DataFrame) -> None:
        """Rows of ``files`` in place of those of the same path; metadata that are not given are lost."""
        base = self.version()
        self.commit(base, files=upsert_files(self.table("files"), files, keep_metadata=False))

    def delete_files(self, paths: DataFrame) -> None:
        """Rows of ``paths(path)`` leave the table of files; what was read from them stays."""
        base = self.version()
        self.commit(base, files=self.table("files").join(paths.select("path").distinct(), "path", "left_anti"))

    def set_embedded(self, paths: DataFrame, embedded: bool) -> None:
        """The flag of ``paths(path)``; paths that are not indexed change nothing."""
        base, given = self.version(), paths.select("path", F.lit(True).alias("_given")).distinct()
        rows = self.table("files").join(given, "path", "left")
        self.commit(base, files=rows.withColumn("embedded", F.when(F.col("_given"), F.lit(embedded)).otherwise(F.col("embedded"))))

    def _with_values(self, values: dict[str, str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(values.items()), TABLES["meta"])
        return self.table("meta").where(~F.col("key").isin(*values)).unionByName(rows)

    def set_value(self, key: str, value: str) -> None:
        base = self.version()
        self.commit(base, meta=self._with_values({key: value}))

    def value(self, key: str) -> str | None:
        row = self.table("meta").where(F.col("key") == key).first()
        return row and row["value"]

    def clear(self) -> None:
        self.commit(**{n: self.spark.createDataFrame([], s) for n, s in TABLES.items()})

    def vacuum(self) -> int:
        """Delete folders that the newest version does not name, and older versions; how many folders. Not to be called while those are read."""
        number = self.version()
        current, gone = {at for folders in self._snapshot().values() for at in folders}, 0
        for name in TABLES:
            at = self._path(f"{self.root}/{name}")
            for copy in self._fs.listStatus(at) if self._fs.exists(at) else []:
                top = f"{name}/{copy.getPath().getName()}"
                inside = [f"{top}/{x.getPath().getName()}" for x in self._fs.listStatus(copy.getPath())] if name in BUCKETED else []
                kept = [x for x in inside if x in current]
                if top not in current and not kept:
                    gone += bool(self._fs.delete(copy.getPath(), True))
                else:
                    gone += sum(bool(self._fs.delete(self._path(f"{self.root}/{x}"), True)) for x in inside if "/_bucket=" in x and x not in current)
        for k in range(1, number):
            self._fs.delete(self._path(f"{self.root}/versions/{k:010d}.json"), False)
        return gone

    def migrate(self, dimensions: int) -> bool:
        """Vectors of another width are dropped and their files marked for embedding; True if that was so."""
        other = self.table("vectors").where(F.size("embedding") != dimensions).limit(1)
        if other.isEmpty() and (self.value("schema_version") or "3") == str(SCHEMA_VERSION):
            return False
        self.commit(
            self.version(),
            files=self.table("files").withColumn("embedded", F.lit(False)),
            vectors=self.table("vectors").where(F.size("embedding") == dimensions).limit(0),
        )
        self.set_value("schema_version", str(SCHEMA_VERSION))
        return True

    def import_legacy(self, path: str) -> int:
        """One JSON document with ``chunks`` and a map ``files``, taken only into an index without chunks."""
        if not self.table("chunks").isEmpty():
            return 0
        schema = (
            "chunks array<struct<id:string,filePath:string,content:string,lineStart:int,lineEnd:int,hash:string,indexed:string,tokens:int,vector:array<float>>>,"
            "files map<string,struct<hash:string,chunks:int,indexed:string,size:long,embedded:boolean>>"
        )
        old = self.spark.read.schema(schema).option("multiLine", True).json(path)
        c = old.select(F.explode("chunks").alias("c")).select("c.*")
        files = old.select(F.explode("files").alias("path", "f")).select("path", "f.*", F.lit(None).cast("string").alias("metadata"))
        chunks = c.select(
            "id", F.col("filePath").alias("file_path"), F.col("content").alias("chunk_content"), F.col("lineStart").alias("line_start"),
            F.col("lineEnd").alias("line_end"), F.col("hash").alias("chunk_hash"), F.col("indexed").alias("indexed_at"), "tokens",
            F.lit(None).cast("string").alias("parent_id"),
        )
        vectors = c.where("vector is not null").select("id", F.col("filePath").alias("file_path"), F.col("vector").alias("embedding"))
        self.commit(files=files, chunks=chunks, vectors=vectors)
        return chunks.count()


def bucket(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def _number(folder: str) -> int:
    return int(folder.rsplit("=", 1)[1])


def pruned(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of a table whose file is in ``targets(path)``."""
    own = "path" if "path" in rows.columns else "file_path"
    return rows.join(targets.select(F.col("path").alias(own)).distinct(), own, "left_semi")


def upsert_files(old: DataFrame, new: DataFrame, keep_metadata: bool = True) -> DataFrame:
    """New rows win, but a null metadata keeps the old one, if that is to be kept. ``new`` has one row per path."""
    if not keep_metadata:
        old = old.join(new.select("path"), "path", "left_anti")
        return old.unionByName(new, allowMissingColumns=True)
    tags = old.groupBy("path").agg(F.max("metadata").alias("_old"))
    if "metadata" not in new.columns:
        new = new.withColumn("metadata", F.lit(None).cast("string"))
    merged = new.join(tags, "path", "left").withColumn("metadata", F.coalesce("metadata", "_old")).drop("_old")
    return old.join(new.select("path"), "path", "left_anti").unionByName(merged)


def apply_tags(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Files with the metadata of ``tags(path, metadata)``; of repeated paths the greatest counts, unlisted files stay."""
    given = tags.groupBy("path").agg(F.max("metadata").alias("_new"), F.lit(True).alias("_given"))
    rows = files.join(given, "path", "left")
    return rows.withColumn("metadata", F.when(F.col("_given"), F.col("_new")).otherwise(F.col("metadata"))).drop("_new", "_given")
