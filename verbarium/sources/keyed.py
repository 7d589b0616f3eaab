"""A table of Parquet files dealt by hashed key, in which a batch rewrites only the
buckets that it touches (survey K01, K02, K12, R02, S04).

A version of the table is a manifest: a small JSON file that names each bucket's folder,
so it has as many entries as there are buckets, whatever the number of rows. A batch is
staged (its latest row of each key), merged with the buckets that it touches, written
beside the old files and committed by the next manifest, which only one writer can
place. Who comes second merges anew if one of their buckets changed meanwhile, and else
commits what they have. Readers keep the version that they began with.

Null keys are keys, ties go to the newer batch, an empty batch changes no bucket, and a
batch with further columns adds them (null before). Columns named ``key_bucket``, ``_new``
or ``_row`` are refused. A bucket should hold some hundred MB, so 100 TB need about a
million of them; a batch that touches all of them rewrites the table.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verbarium.operators import corpus

BUCKET = "key_bucket"
TAKEN = {BUCKET, "_new", "_row"}


class Folder:
    """Small files in a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.gateway = spark.sparkContext._gateway
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)
        self.links = self.fs.getUri().getScheme() == "file"

    def _at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def get(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """False if the file is there. It appears whole, by a rename that doesn't
        overwrite; on a local disk, where renames are no barrier, by a link."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        stream = self.fs.create(self._at(part), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.links:
                os.link(self._at(part).toUri().getPath(), self._at(name).toUri().getPath())
            else:
                options = self.gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
                context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf)
                context.rename(self._at(part), self._at(name), options)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.fs.delete(self._at(part), False)

    def drop(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class KeyedTable:
    """One row a key, the one with the largest ``order``. ``buckets`` counts when the
    table is made; later the manifest's number holds."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 64):
        self.spark, self.keys, self.order = spark, keys, order
        self.folder = Folder(spark, path)
        self.buckets = buckets

    def version(self) -> int:
        """0 before the first batch."""
        return max((int(n[:-5]) for n in self.folder.names("manifest") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": self.buckets, "folders": {}, "done": {}, "schema": None}
        return json.loads(self.folder.get(f"manifest/{version:012d}.json")) | {"version": version}

    def read(self, version: int | None = None) -> DataFrame:
        """The table, or an older version of it that wasn't cleared away."""
        m = self.manifest(version)
        if not m["version"]:
            raise FileNotFoundError(f"no table at {self.folder.path}")
        return self._read(m, list(m["folders"]))

    def lookup(self, *key) -> DataFrame:
        """The row of one key, from the one folder that may have it."""
        m = self.manifest()
        types = {f.name: f.dataType for f in StructType.fromJson(m["schema"])}
        values = [F.lit(v).cast(types[k]) for k, v in zip(self.keys, key, strict=True)]
        number = self.spark.range(1).select(self._bucket(m["buckets"], values)).first()[0]
        rows = self._read(m, [b for b in [str(number)] if b in m["folders"]])
        for name, value in zip(self.keys, values):
            rows = rows.where(F.col(name).eqNullSafe(value))
        return rows

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None, at: int | None = None) -> int | None:
        """The version with these rows. ``batch`` is a writer's name and a rising number:
        one that was committed before changes nothing. With ``at`` the batch counts only
        on top of that version; None tells that another came first."""
        if TAKEN & set(rows.columns):
            raise ValueError(f"columns {sorted(TAKEN & set(rows.columns))} are the table's own")
        staged, merged, before = None, None, None
        while True:
            m = self.manifest()
            if batch and m["done"].get(batch[0], -1) >= batch[1]:
                return m["version"]
            if at is not None and m["version"] != at:
                return None
            if staged is None:
                staged = self._stage(rows, m["buckets"])
            held = {b: m["folders"].get(b) for b in staged[1]}
            if merged is None or (held, m["schema"]) != before:
                merged, before = self._merge(m, *staged), (held, m["schema"])
            new = {
                "buckets": m["buckets"],
                "folders": m["folders"] | merged[0],
                "done": m["done"] | ({batch[0]: batch[1]} if batch else {}),
                "schema": merged[1],
            }
            if self.folder.put_new(f"manifest/{m['version'] + 1:012d}.json", json.dumps(new)):
                self.folder.drop(staged[0])
                return m["version"] + 1

    def clear(self, keep: int = 2) -> int:
        """Drop the versions before the last ``keep`` and the folders that only they name;
        only while nobody writes or reads them. The number of folders dropped."""
        last = self.version()
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        named = {f for m in kept for f in m["folders"].values()}
        for n in self.folder.names("manifest"):
            if not n.endswith(".json") or int(n[:-5]) <= last - keep:
                self.folder.drop(f"manifest/{n}")
        gone = [f"data/{w}/{b}" for w in self.folder.names("data") for b in self.folder.names(f"data/{w}") if b.startswith(BUCKET) and f"data/{w}/{b}" not in named]
        for f in gone + [f"staged/{n}" for n in self.folder.names("staged")]:
            self.folder.drop(f)
        return len(gone)

    def _bucket(self, buckets: int, values: list[Column] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(values or [F.col(k) for k in self.keys])), F.lit(buckets)).cast("int").alias(BUCKET)

    def _read(self, m: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        if not buckets:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder.path}/{m['folders'][b]}" for b in buckets])

    def _stage(self, rows: DataFrame, buckets: int) -> tuple[str, list[str], StructType]:
        """A batch is read once. The first aggregation takes hot keys apart in the tasks
        that read them."""
        name = f"staged/{uuid.uuid4().hex}"
        latest = corpus.upsert(rows.limit(0), rows, self.keys, self.order)
        latest.withColumn(BUCKET, self._bucket(buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder.path}/{name}")
        return name, [n.split("=")[1] for n in self.folder.names(name) if n.startswith(BUCKET)], rows.schema

    def _merge(self, m: dict, staged: str, touched: list[str], schema: StructType) -> tuple[dict, dict]:
        """Old and new rows meet by bucket, in one shuffle."""
        if m["schema"]:
            known = StructType.fromJson(m["schema"])
            schema = StructType(known.fields + [f for f in schema.fields if f.name not in known.names])
        nullable = json.loads(schema.json().replace('"nullable":false', '"nullable":true'))
        if not touched:
            return {}, nullable
        schema = StructType.fromJson(nullable)
        new = self.spark.read.schema(schema).parquet(*[f"{self.folder.path}/{staged}/{BUCKET}={b}" for b in touched])
        old = self._read({**m, "schema": nullable}, [b for b in touched if b in m["folders"]])
        place = self._bucket(m["buckets"])
        both = [df.withColumn(BUCKET, place) for df in (old, new)]
        both = both[0].withColumn("_new", F.lit(0)).unionByName(both[1].withColumn("_new", F.lit(1))).repartition(BUCKET)
        rest = [c for c in schema.names if c not in self.keys]
        best = both.groupBy(BUCKET, *self.keys).agg(F.max_by(F.struct(*rest), F.struct(self.order, "_new")).alias("_row"))
        to = f"data/{uuid.uuid4().hex}"
        best.select(BUCKET, *self.keys, *[F.col("_row").getField(c).alias(c) for c in rest]).write.partitionBy(BUCKET).parquet(f"{self.folder.path}/{to}")
        return {b: f"{to}/{BUCKET}={b}" for b in touched}, nullable
