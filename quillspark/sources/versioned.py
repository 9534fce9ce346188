"""Tables with versions: immutable data folders, and numbered manifests that say which of them are in force.

A writer adds its folders first and then publishes the manifest after the one it has read. Only one writer can publish a
number; another one reads the new manifest and does its change anew. Readers keep to the manifest they have resolved, so
that they see a whole version, whatever is written meanwhile.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How often a change is tried anew when other writers come first.
TRIES = 100


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the warehouse where that isn't set. In local
    mode, where they are one process, it is a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = sc.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir")


class Conflict(Exception):
    """Other writers came first, again and again."""


class Manifests:
    """The numbered manifests of a folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(path, "manifests")
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, name)

    def latest(self) -> int:
        """The number of the last manifest, 0 if there is none."""
        if not self._fs.exists(self._folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def at(self, number: int) -> dict:
        if not number:
            return {}
        stream = self._fs.open(self._file(f"{number:020d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> bool:
        """Make content the manifest of this number, whole and at once; False if the number is taken."""
        self._fs.mkdirs(self._folder)
        draft, final = self._file(f".{uuid.uuid4()}"), self._file(f"{number:020d}")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(content).encode())
        stream.close()
        try:
            if self._fs.getScheme() == "file":  # a local rename would replace what is there, a link fails
                paths = [self._jvm.java.io.File(f.toUri().getPath()).toPath() for f in (final, draft)]
                self._jvm.java.nio.file.Files.createLink(*paths)
            else:
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._folder.toUri()).rename(draft, final, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            return False
        finally:
            self._fs.delete(draft, False)

    def commit(self, change: Callable[[dict], dict | None], tries: int = TRIES) -> int:
        """Publish change(the last manifest) behind it, working it out anew whenever another writer was first. A change to
        None publishes nothing. Returns the number in force."""
        for _ in range(tries):
            number = self.latest()
            content = change(self.at(number))
            if content is None:
                return number
            if self.publish(number + 1, content):
                return number + 1
        raise Conflict(self.path)


class VersionedTable:
    """A Parquet table with versions. Writers: append, replace, delete, rewrite. Readers: read, at any version."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.manifests = Manifests(spark, path)

    def version(self) -> int:
        return self.manifests.latest()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is given; version 0 is empty."""
        return self._of(self.manifests.at(self.version() if version is None else version).get("parts", []))

    def _of(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{p}" for p in parts])

    def _written(self, rows: DataFrame) -> str:
        name = str(uuid.uuid4())
        wanted = self.spark.createDataFrame([], self.schema).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in wanted]).write.parquet(f"{self.path}/data/{name}")
        return name

    def _appended(self, parts: list[str], rows: DataFrame) -> list[str]:
        return [*parts, self._written(rows)]

    def _without(self, parts: list[str], keys: DataFrame, by: list[str]) -> list[str]:
        """Parts that hold none of the keys as they are, and what is left of the others as a new one."""
        if not parts:
            return []
        held = self._of(parts).withColumn("_part", F.regexp_extract(F.col("_metadata.file_path"), "/data/([^/]+)/[^/]+$", 1))
        named = keys.select(*by).distinct()
        touched = {r[0] for r in held.join(named, by, "left_semi").select("_part").distinct().collect()}  # parts of the manifest
        if not touched:
            return parts
        rest = self._of([p for p in parts if p in touched]).join(named, by, "left_anti")
        return [*(p for p in parts if p not in touched), self._written(rest)]

    def _replaced(self, parts: list[str], rows: DataFrame, by: list[str]) -> list[str]:
        part = self._written(rows)
        return [*self._without(parts, self._of([part]), by), part]

    def append(self, rows: DataFrame | Callable[[DataFrame], DataFrame]) -> int:
        """Add rows. A function gets the rows there are and gives those to add; it is asked anew when another writer was
        first, so that what it has checked holds in the version that it makes."""
        if not callable(rows):
            part = self._written(rows)
            return self.manifests.commit(lambda now: {"parts": [*now.get("parts", []), part]})
        return self.manifests.commit(lambda now: {"parts": self._appended(now.get("parts", []), rows(self._of(now.get("parts", []))))})

    def replace(self, rows: DataFrame, by: list[str], keys: DataFrame | None = None) -> int:
        """Rows take the place of those with the same key, or of those with one of `keys`. A null is no key: rows with one are
        only added."""
        part = self._written(rows)
        gone = self._of([part]) if keys is None else keys
        return self.manifests.commit(lambda now: {"parts": [*self._without(now.get("parts", []), gone, by), part]})

    def delete(self, keys: DataFrame, by: list[str]) -> int:
        return self.manifests.commit(lambda now: {"parts": self._without(now.get("parts", []), keys, by)})

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """All rows anew, from those there are; also puts many small parts together."""
        return self.manifests.commit(lambda now: {"parts": [self._written(change(self._of(now.get("parts", []))))]})


    def vacuum(self, keep: int = 1, seconds: float = 86_400.0) -> int:
        """Delete data that none of the last `keep` versions names and that is as old as `seconds`, which spares what writers
        are about to publish; returns how many folders went. Readers of older versions fail from then on."""
        last, fs = self.version(), self.manifests._fs
        named = {p for n in range(max(1, last - keep + 1), last + 1) for p in self.manifests.at(n).get("parts", [])}
        folder = self.manifests._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        old = [f for f in (fs.listStatus(folder) if fs.exists(folder) else []) if f.getPath().getName() not in named and time.time() - f.getModificationTime() / 1000 >= seconds]
        for f in old:
            fs.delete(f.getPath(), True)
        return len(old)


class Store:
    """Several tables under one manifest: a transaction changes any of them, and all or nothing of it is seen."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]) -> None:
        self.manifests = Manifests(spark, path)
        self.tables = {name: VersionedTable(spark, f"{path}/{name}", schema) for name, schema in schemas.items()}

    def version(self) -> int:
        return self.manifests.latest()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._at(self.manifests.at(self.version() if version is None else version))[name]

    def _at(self, manifest: dict) -> dict[str, DataFrame]:
        return {name: table._of(manifest.get(name, [])) for name, table in self.tables.items()}

    def transact(self, change: Callable[[dict[str, DataFrame]], list[tuple]]) -> int:
        """Commit what change gives for the tables as they are: ("append", table, rows), ("replace", table, rows, by) and
        ("delete", table, keys, by), one after another. It is asked anew when another writer was first, so that its guards
        hold in the version it makes; with nothing to do nothing is committed. Returns the version in force."""
        kinds = {"append": VersionedTable._appended, "replace": VersionedTable._replaced, "delete": VersionedTable._without}

        def once(now: dict) -> dict | None:
            new = dict(now)
            for kind, name, *given in change(self._at(now)):
                new[name] = kinds[kind](self.tables[name], new.get(name, []), *given)
            return None if new == now else new

        return self.manifests.commit(once)
