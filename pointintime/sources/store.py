"""A store of tables in buckets, changed in commits: a reader sees all of a commit or nothing of it.

Data files are never changed. A commit writes the buckets that it replaces or adds to, for one table or several, and then one manifest,
a small JSON file named by the next number, which lists the folders of all buckets. Two writers can't take one number: the file is made
under a name of its own and then renamed to a name that must not exist. Readers take the manifest with the highest number when they
begin and keep it; whatever a failed commit left behind is in no manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer committed in between."""


class Store:
    """Tables below ``root``, on any file system that Spark's session reaches."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(f"{self.root}/x").getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self, keys: list[str]) -> Column:
        """The bucket of a row: whole numbers and texts alike, nulls too."""
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(self.buckets)).cast("int")

    # -- manifests --------------------------------------------------------------------------------

    def number(self) -> int:
        """The newest manifest, 0 before the first commit."""
        place = self._fs_path(f"{self.root}/_manifests")
        if not self._fs.exists(place):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(place)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_")), default=0)

    def manifest(self, number: int | None = None) -> dict:
        """tables: folders and schema of each bucket; done: batches by the run that they belong to."""
        number = self.number() if number is None else number
        if not number:
            return {"tables": {}, "done": {}}
        stream = self._fs.open(self._fs_path(f"{self.root}/_manifests/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> None:
        own = self._fs_path(f"{self.root}/_manifests/_{uuid.uuid4().hex}")
        stream = self._fs.create(own, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        final = self._fs_path(f"{self.root}/_manifests/{number:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(own, final):
            self._fs.delete(own, False)
            raise Conflict(f"commit {number} is taken")

    # -- reading ----------------------------------------------------------------------------------

    def read(self, table: str, only: list[int] | None = None, number: int | None = None) -> DataFrame | None:
        """A table as of a manifest, or some of its buckets; None where there is none. Only the buckets' files are listed."""
        known = self.manifest(number)["tables"].get(table)
        if known is None:
            return None
        folders = [f for b, fs in known["buckets"].items() if only is None or int(b) in only for f in fs]
        schema = T.StructType.fromJson(json.loads(known["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    # -- writing ----------------------------------------------------------------------------------

    def commit(self, changes: dict[str, tuple[str, DataFrame, list[str], list[int] | None]], run: str | None = None, batch: int | None = None) -> int:
        """Applies ``changes``, by table: ("append" or "replace", rows, keys of the bucket, the buckets that are replaced), at once.

        ``replace`` swaps the named buckets for the rows (None: all buckets); rows of other buckets mustn't be among them. With
        ``run`` and ``batch`` a batch that the run committed already changes nothing. Returns the manifest's number.
        """
        number = self.number()
        manifest = self.manifest(number)
        if run is not None and batch is not None and manifest["done"].get(run, -1) >= batch:
            return number
        for table, (how, rows, keys, replaced) in changes.items():
            folder = f"data/{table}/{uuid.uuid4().hex}"
            rows.withColumn("__bucket", self.bucket(keys)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{folder}")
            place = self._fs_path(f"{self.root}/{folder}")
            written = [f.getPath().getName() for f in self._fs.listStatus(place)]
            fresh = {n.split("=")[1]: f"{folder}/{n}" for n in written if n.startswith("__bucket=")}
            known = manifest["tables"].setdefault(table, {"schema": rows._jdf.schema().json(), "buckets": {}})
            if how == "replace":
                for b in list(known["buckets"]) if replaced is None else map(str, replaced):
                    known["buckets"].pop(b, None)
            for b, path in fresh.items():
                known["buckets"].setdefault(b, []).append(path)
        if run is not None and batch is not None:
            manifest["done"][run] = batch
        self._publish(number + 1, manifest)
        return number + 1

    def touched(self, rows: DataFrame, keys: list[str]) -> list[int]:
        """The buckets of some rows, at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket(keys)).distinct().collect())
