"""Result sinks (S6): every result table written as an ordinary dataset."""
from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: The file that names the current set of published tables, and the file that lists a set's tables.
CURRENT, MANIFEST = "CURRENT", "MANIFEST.json"


def write_results(tables: Mapping[str, DataFrame], out_dir: str, fmt: str = "parquet",
                  mode: str = "overwrite") -> DataFrame:
    """Write each table to ``out_dir/<name>`` and return (table, rows) read back."""
    spark = None
    summary = []
    for name, df in tables.items():
        spark = df.sparkSession
        path = f"{out_dir.rstrip('/')}/{name}"
        writer = df.write.mode(mode)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(path)
        back = spark.read.format(fmt).option("header", True).load(path) if fmt == "csv" \
            else spark.read.format(fmt).load(path)
        summary.append((name, path, back.count()))
    return spark.createDataFrame(summary, "table string, path string, rows bigint")


class PublishedSet:
    """A set of result tables that readers see as a whole or not at all.

    Every set has a folder of its own under ``root``. Its tables are written first, then its
    manifest (tables, rows, columns), and at last one renamed file names it as the current set.
    A run that stops anywhere before that leaves the set before it as it was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self._conf)

    def _put(self, name: str, text: str) -> None:
        """Write a small file beside its place and rename it onto it, in one step."""
        path, fs = self._path(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(path)
        out.write(bytearray(text, "utf-8"))
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self._conf)
        context.rename(path, self._path(name)[0], over)

    def _get(self, name: str) -> str | None:
        path, fs = self._path(name)
        if not fs.exists(path):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(path.toString()).collect())  # a few hundred bytes

    def publish(self, tables: Mapping[str, DataFrame], keep: int = 2) -> str:
        """Write ``tables`` as a new set, make it the current one and return its name. Of older
        sets the last ``keep`` stay, for readers that have begun on them."""
        before, name = self.current(), f"set-{uuid.uuid4().hex}"
        listed = []
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{table}")
            back = self.spark.read.parquet(f"{self.root}/{name}/{table}")
            listed.append({"table": table, "rows": back.count(), "columns": [[f.name, f.dataType.simpleString()] for f in back.schema.fields]})
        older = ([before, *self.manifest(before)["before"]] if before else [])[:keep + 1]
        self._put(f"{name}/{MANIFEST}", json.dumps({"tables": listed, "before": older[:keep]}))
        self._put(CURRENT, name)
        for old in older[keep:]:
            path, fs = self._path(old)
            fs.delete(path, True)
        return name

    def current(self) -> str | None:
        return self._get(CURRENT)

    def manifest(self, name: str | None = None) -> dict:
        return json.loads(self._get(f"{name or self.current()}/{MANIFEST}"))

    def read(self, table: str, name: str | None = None) -> DataFrame:
        """A table of the current set, or of the set that a reader has begun on."""
        return self.spark.read.parquet(f"{self.root}/{name or self.current()}/{table}")
