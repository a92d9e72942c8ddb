"""Versioned Parquet folders behind Hadoop's file systems, so any path that Spark reads will do.

Tables are written whole under names of their own. Then a small file with the
next number, which says what tables there are, is renamed into place, which
fails if another writer took that number first; readers take the file with the
highest number, or an older one.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Store:
    """Files of one index under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(""))) if self.exists() else []

    @staticmethod
    def state_name(number: int) -> str:
        return f"state-{number:010d}.json"

    def states(self) -> list[int]:
        """Numbers of the states that are there, in order."""
        return [int(n[6:-5]) for n in self.names() if n.startswith("state-") and n.endswith(".json")]

    def state(self, number: int | None = None) -> dict:
        return self.get(self.state_name(self.states()[-1] if number is None else number))

    def commit(self, number: int, value: dict) -> bool:
        """Puts a state in place under its number; False if that number is taken."""
        temporary = self._path(f".{uuid.uuid4().hex}.new")
        out = self.fs.create(temporary, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: do not overwrite
        try:
            context.rename(temporary, self._path(self.state_name(number)), options)
        except Py4JJavaError:
            self.fs.delete(temporary, False)
            if not self.exists(self.state_name(number)):
                raise
            return False
        return True

    def get(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def write(self, name: str, df: DataFrame, mode: str = "errorifexists") -> None:
        df.write.mode(mode).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")
