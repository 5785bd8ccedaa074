"""Processing only new or changed records.

:class:`Manifest` keeps the processed inputs of a pipeline. A listing is anti-joined
against it; the inputs of a batch are written under its identifier, then its output,
then one commit marker. Only committed batches count, so a run that dies between any
two of these steps is repeated as a whole and overwrites its own leavings.

:func:`next_batch` takes the append-only index state (``files``) and the log of runs
(``index_runs``) as the history of such a manifest and the sightings of the walk
(``scans``) as the listing. :func:`pending_paths` says why a path is pending.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HASH_DIGITS = 12


def hash_key(c: Column) -> Column:
    """What of a content hash counts: its first 12 hex digits in lower case; blank is null."""
    key = F.lower(F.substring(F.trim(c), 1, HASH_DIGITS))
    return F.when(F.length(key) > 0, key)


def instant(c: Column) -> Column:
    """ISO-8601 text to a timestamp; text without an offset is UTC; unreadable text is null."""
    zoned = c.rlike(r"(Z|z|[+-]\d{2}:?\d{2})\s*$")
    return F.when(zoned, c).otherwise(F.concat(c, F.lit("Z"))).try_cast("timestamp")


def run_intervals(runs: DataFrame) -> DataFrame:
    """``run_id, status, begins, ends, open``: a run without finish lasts until the next one starts.

    ``index_runs`` has one row per run of the indexer, so the one-partition window
    over start times is over a log, not over data. ``open`` marks an end that is
    the start of the next run and so not part of the interval.
    """
    from pyspark.sql import Window

    following = F.lead("started_at").over(Window.orderBy("started_at", "run_id"))
    return runs.where("started_at is not null").select(
        "run_id",
        "status",
        F.col("started_at").alias("begins"),
        F.coalesce("finished_at", following).alias("ends"),
        F.col("finished_at").isNull().alias("open"),
    )


def committed_rows(files: DataFrame, runs: DataFrame) -> DataFrame:
    """``path, at, hash_key, embedded`` of the rows of ``files`` not written inside a run that is not ok.

    The range test is an anti-join on the day a run touches, so it needs neither a
    cross join nor a collected list of runs. A status of null is not ok.
    """
    rows = files.where("path is not null").select(
        "path", instant(F.col("indexed")).alias("at"), hash_key(F.col("hash")).alias("hash_key"), "embedded"
    )
    rows = rows.where("at is not null").withColumn("day", F.to_date("at"))
    newest = rows.agg(F.max("at").alias("newest"))
    bad = (
        run_intervals(runs)
        .where(~F.col("status").eqNullSafe("ok"))
        .crossJoin(newest)  # one row
        .withColumn("last", F.coalesce(F.least("ends", "newest"), F.col("newest")))
        .where("last >= begins")
        .withColumn("day", F.explode(F.sequence(F.to_date("begins"), F.to_date("last"))))
    )
    inside = (
        (rows.day == bad.day)
        & (rows["at"] >= bad.begins)
        & (bad.ends.isNull() | (rows["at"] < bad.ends) | (~bad.open & (rows["at"] == bad.ends)))
    )
    return rows.join(bad, inside, "left_anti").drop("day")


def states(files: DataFrame, runs: DataFrame) -> DataFrame:
    """``path, state(at, embedded, hash_key)``: the newest committed row of each path."""
    newest = F.max(F.struct("at", F.coalesce("embedded", F.lit(False)).alias("embedded"), "hash_key"))
    return committed_rows(files, runs).groupBy("path").agg(newest.alias("state"))


def sightings(scans: DataFrame) -> DataFrame:
    """``path, size, checksum`` of the newest row of ``scans`` with a hash; of equal instants the greater ``scan_id`` counts."""
    return (
        scans.where("path is not null and seen_at is not null")
        .select("path", "seen_at", "scan_id", hash_key(F.col("hash")).alias("checksum"))
        .where("checksum is not null")
        .groupBy("path")
        .agg(F.max(F.struct("seen_at", "scan_id", "checksum")).alias("seen"))
        .select("path", F.lit(None).cast("long").alias("size"), "seen.checksum")
    )


def next_batch(files: DataFrame, scans: DataFrame, runs: DataFrame, root: str) -> DataFrame:
    """``path`` of what the next index run has to process, each once, as a batch of a manifest in ``root``.

    The manifest adopts the history first: the inputs that the runs that ended well
    have indexed and embedded, by path and checksum (the sizes of index and sightings
    are counted differently and take no part). The newest sightings are the listing
    that is anti-joined against it; the batch is written under its identifier and
    committed, and its rows are read back. With a ``root`` that is used again, a
    batch that was committed before is not processed anew, but comes out as it was.
    What is defined for ties, nulls and empty tables in :func:`pending_paths` holds.
    """
    manifest = Manifest(files.sparkSession, root)
    done = states(files, runs).where("state.embedded")
    manifest.adopt("history", done.select("path", F.lit(None).cast("long").alias("size"), F.col("state.hash_key").alias("checksum")))
    manifest.run("next", sightings(scans), lambda inputs: inputs.select("path"))
    return manifest.output("next")


def pending_paths(files: DataFrame, scans: DataFrame, runs: DataFrame) -> DataFrame:
    """``path, reason``: what the next index run has to process and why, each path once.

    The state of a path is its newest committed row, its sighting the newest row of
    ``scans`` with a hash. Reasons: ``new`` (no state), ``changed`` (the hashes
    differ, or the state has none), ``not embedded``. Both newest rows come from
    ``max(struct)``, which combines before the shuffle, so repeated sightings of
    one hot path cost nothing extra. Ties: of rows at one instant the embedded one
    and then the greater hash, of sightings the greater ``scan_id`` counts. Null
    paths, unreadable instants and sightings without a hash are left out; empty
    tables give no rows; further columns are ignored.
    """
    reason = (
        F.when(F.col("state").isNull(), "new")
        .when(~F.col("state.hash_key").eqNullSafe(F.col("checksum")), "changed")
        .when(~F.col("state.embedded"), "not embedded")
    )
    rows = sightings(scans).join(states(files, runs), "path", "left")
    return rows.select("path", reason.alias("reason")).where("reason is not null")


class Manifest:
    """Inputs processed so far, by path, size and checksum, in a folder of any Hadoop file system.

    ``root/data/batch=<id>`` holds output, ``root/inputs/batch=<id>`` the inputs of
    the batch, ``root/commits/<id>.json`` the marker that makes both count. A marker
    has the place of its batch in the order of commits; what a path's newest batch
    says of it is its state. :meth:`compact` writes all that counts as one batch, so
    that neither markers nor folders to read grow with the number of runs.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _markers(self) -> list[dict]:
        """Contents of the markers in the order of commits: one a batch since the last compaction."""
        at = f"{self.root}/commits"
        if not self._fs.exists(self._path(at)):
            return []
        rows = self.spark.read.option("pathGlobFilter", "*.json").text(at, wholetext=True).collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda m: (m["order"], m["batch"]))

    def batches(self) -> list[str]:
        """Identifiers of the committed batches, compacted ones too."""
        return sorted({b for m in self._markers() for b in (m["batch"], *m["holds"])})

    def _committed(self, kind: str) -> DataFrame | None:
        """Committed rows of the batches that count, with ``_order``, the place of their commit."""
        markers = self._markers()
        compacted = {b for m in markers for b in m["holds"]}
        parts = [
            (m["order"], f"{self.root}/{kind}/batch={m['batch']}")
            for m in markers
            if m["batch"] not in compacted and self._fs.exists(self._path(f"{self.root}/{kind}/batch={m['batch']}"))
        ]
        if not parts:
            return None
        rows = self.spark.read.parquet(*(at for _, at in parts))
        named = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=([^/]*)/[^/]*$", 1)
        orders = F.create_map(*(F.lit(x) for order, at in parts for x in (self._path(at).toUri().getRawPath().rsplit("=", 1)[1], order)))
        return rows.withColumn("_order", orders[named])

    def inputs(self) -> DataFrame | None:
        """``path, size, checksum, _order``: the state of each path, from the newest batch that has it."""
        rows = self._committed("inputs")
        if rows is None:
            return None
        newest = rows.groupBy("path").agg(F.max(F.struct("_order", "size", "checksum")).alias("s"))
        return newest.select("path", "s.size", "s.checksum", "s._order")

    def output(self, batch: str | None = None) -> DataFrame | None:
        """Committed output, of one batch or of all; leavings of runs that died are not part of it.

        Of all batches, rows with a ``path`` count only if they are of the newest
        batch that has this path: what an input gave before it changed is
        superseded. Output without a ``path`` is taken as it is.
        """
        if batch is not None:
            return self.spark.read.parquet(f"{self.root}/data/batch={batch}") if batch in self.batches() else None
        rows = self._committed("data")
        if rows is None or "path" not in rows.columns:
            return rows and rows.drop("_order")
        newest = self.inputs().select(F.col("path").alias("_path"), F.col("_order").alias("_newest"))
        kept = rows.path.eqNullSafe(F.col("_path")) & (rows["_order"] == F.col("_newest"))
        return rows.join(newest, kept, "left_semi").drop("_order")

    def pending(self, listing: DataFrame) -> DataFrame:
        """``path, size, checksum`` of ``listing`` where the state of the path is not the same.

        Equality is null-safe. A path comes once: of several rows the greatest.
        """
        one = F.max(F.struct("size", "checksum")).alias("s")
        listing = listing.groupBy("path").agg(one).select("path", "s.size", "s.checksum")
        done = self.inputs()
        if done is None:
            return listing
        done = done.select(*(F.col(c).alias(f"_{c}") for c in ("path", "size", "checksum")))
        same = (
            listing.path.eqNullSafe(F.col("_path"))
            & listing["size"].eqNullSafe(F.col("_size"))
            & listing.checksum.eqNullSafe(F.col("_checksum"))
        )
        return listing.join(done, same, "left_anti")

    def run(self, batch: str, listing: DataFrame, process: Callable[[DataFrame], DataFrame]) -> bool:
        """Process what is pending as ``batch``; False if that batch was committed before.

        The inputs are fixed in the manifest first and read back, so ``process``
        and the manifest see the same rows even if the listing changes meanwhile.
        """
        if batch in self.batches():
            return False
        inputs = f"{self.root}/inputs/batch={batch}"
        self.pending(listing).write.mode("overwrite").parquet(inputs)
        process(self.spark.read.parquet(inputs)).write.mode("overwrite").parquet(f"{self.root}/data/batch={batch}")
        self._commit(batch)
        return True

    def adopt(self, batch: str, processed: DataFrame) -> bool:
        """Take ``processed(path, size, checksum)``, done elsewhere, as a batch without output; False if committed before."""
        if batch in self.batches():
            return False
        processed.select("path", "size", "checksum").write.mode("overwrite").parquet(f"{self.root}/inputs/batch={batch}")
        self._commit(batch)
        return True

    def compact(self) -> None:
        """All that counts as one batch. Not to be called while a run is at work."""
        markers = self._markers()
        if len(markers) < 2:
            return
        batch = f"compacted-{uuid.uuid4().hex}"
        rows, out = self.inputs(), self.output()
        rows.select("path", "size", "checksum").write.mode("overwrite").parquet(f"{self.root}/inputs/batch={batch}")
        if out is not None:
            out.write.mode("overwrite").parquet(f"{self.root}/data/batch={batch}")
        self._commit(batch, sorted({b for m in markers for b in (m["batch"], *m["holds"])}))
        for m in markers:  # the new marker counts already: what is deleted or left here counts no more
            self._fs.delete(self._path(f"{self.root}/commits/{m['batch']}.json"), False)
            for kind in ("inputs", "data"):
                self._fs.delete(self._path(f"{self.root}/{kind}/batch={m['batch']}"), True)

    def _commit(self, batch: str, holds: list[str] = ()) -> None:
        markers = self._markers()
        marker = {"batch": batch, "order": max((m["order"] for m in markers), default=0) + 1, "holds": list(holds)}
        staged, final = (self._path(f"{self.root}/commits/{n}") for n in (f".{batch}.staged", f"{batch}.json"))
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(marker).encode()))
        out.close()
        if not self._fs.rename(staged, final):
            raise RuntimeError(f"batch {batch} could not be committed")
