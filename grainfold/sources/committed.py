"""A table of Parquet files that several writers append to at once.

A writer stages its rows in a folder of their own and then makes the next manifest, a numbered file that names the folder.
Making it is atomic and fails if the number is taken; the writer then looks at what came between, leaves out rows whose keys
are there now, and tries the next number. Readers see the folders of manifests only, so nothing half written and nothing
twice. Local file systems make a manifest by a hard link, others by a rename that must fail where the target exists, as
HDFS does; an object store without such a rename can have one writer at a time.
"""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as t

from grainfold.session import delete
from grainfold.sources.tables import pending


class Committed:
    def __init__(self, spark: SparkSession, path: str, schema: t.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifests(self) -> list[str]:
        """Paths of the manifests, 1, 2, ..., without a gap."""
        found = self.files.globStatus(self.at(f"{self.path}/commits/*.json")) or []
        return sorted((f.getPath().toString() for f in found), key=lambda p: int(os.path.basename(p)[: -len(".json")]))

    def folders(self, since: int = 0) -> list[str]:
        """The data folders of all manifests behind the first `since`."""
        named = []
        for path in self.manifests()[since:]:
            stream = self.files.open(self.at(path))
            try:
                named.append(f"{self.path}/data/{bytes(stream.readAllBytes()).decode()}")
            finally:
                stream.close()
        return named

    def read(self, since: int = 0) -> DataFrame:
        folders = self.folders(since)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def claim(self, number: int, folder: str) -> bool:
        """Make manifest `number`; False if there is one."""
        final, draft = self.at(f"{self.path}/commits/{number}.json"), self.at(f"{self.path}/drafts/{folder}")
        self.files.mkdirs(final.getParent())
        stream = self.files.create(draft, True)
        stream.write(bytearray(folder.encode()))
        stream.close()
        try:
            if self.files.getScheme() == "file":
                try:
                    os.link(draft.toUri().getPath(), final.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return bool(self.files.rename(draft, final))
        finally:
            with contextlib.suppress(Exception):
                self.files.delete(draft, False)

    def append(self, rows: DataFrame, key: list[str]) -> int:
        """Add the rows whose key is not there yet; rows of one key in `rows` itself are the caller's. How many were added."""
        rows = rows.select(*[rows[f.name].cast(f.dataType) for f in self.schema])
        seen = len(self.manifests())
        rows = pending(rows, self.read() if seen else None, *key)
        while True:
            folder = uuid.uuid4().hex
            staged = f"{self.path}/data/{folder}"
            rows.write.parquet(staged)
            kept = self.spark.read.schema(self.schema).parquet(staged)
            added = kept.count()
            if not added:
                delete(self.spark, staged)
                return 0
            while not self.claim(seen + 1, folder):
                came, seen = self.read(seen), len(self.manifests())
                fewer = pending(kept, came, *key)
                if fewer.count() < added:
                    rows = fewer
                    break
            else:
                return added
