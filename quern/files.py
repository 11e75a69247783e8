"""Small files beside the data, through Hadoop's file systems."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """JSON files and markers in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root, spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def has(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def put(self, name: str, data: dict, overwrite: bool = True) -> bool:
        """Written beside and renamed in one step, so a reader sees all of it or what was there before; False if it may not overwrite what another has put there."""
        part = self.path(f".{uuid.uuid4().hex}" if "/" not in name else f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        stream = self.fs.create(part)
        stream.write(bytearray(json.dumps(data).encode()))
        stream.close()
        scheme = self.path("").toUri()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(scheme if scheme.getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, int(overwrite))
        if overwrite:
            options[0] = kind.OVERWRITE
        try:
            context.rename(part, self.path(name), options)
            return True
        except Exception:
            self.fs.delete(part, False)
            if not overwrite and self.has(name):
                return False
            raise

    def get(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def bytes(self, name: str = "") -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)
