"""Price curves (V1, A13) kept up to date while answers arrive.

The state of the curves is their histogram: at most 4 x (grid + 1) rows a group, additive
over any parts of the survey. Every micro-batch writes its own histogram into a folder named
by the batch's number, so a replayed batch replaces its folder and is never counted twice.
``compact`` folds the batches up to a number into one folder; a reader takes the newest
finished one and the finished batches after it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.pricing import curves_of_histogram, price_histogram
from ..spec import DEFAULT_SPEC, GRID_HI, GRID_LO, GRID_N, SurveySpec


class CurveState:
    """The curves' histograms under a shared folder.

    All batches of a state have one grid and one grouping. Null prices count in the
    denominator only; a batch without rows adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str, spec: SurveySpec = DEFAULT_SPEC, lo: float = GRID_LO,
                 hi: float = GRID_HI, n: int = GRID_N, by: Sequence[str] = ()):
        self.spark, self.path, self.spec, self.by = spark, path.rstrip("/"), spec, list(by)
        self.grid = (lo, hi, n)

    def _fs(self, name: str = ""):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def _finished(self, kind: str) -> list[int]:
        """The numbers of the folders of a kind whose write has ended."""
        fs, root = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
        return sorted(int(x.rpartition("-")[2]) for x in names
                      if x.startswith(f"{kind}-") and fs.exists(self._fs(f"{x}/_SUCCESS")[1]))

    def _merged_to(self) -> int:
        return max(self._finished("merged"), default=-1)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch; one that came before is replaced, one that is folded in already is left as it is."""
        if batch_id > self._merged_to():
            hist = price_histogram(batch, self.spec, *self.grid, by=self.by)
            hist.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")

    def histogram(self, upto: int | None = None) -> DataFrame:
        merged = self._merged_to()
        paths = [f"{self.path}/merged-{merged}"] if merged >= 0 else []
        paths += [f"{self.path}/batch-{i}" for i in self._finished("batch") if i > merged and (upto is None or i <= upto)]
        if not paths:
            raise ValueError(f"no finished batch under {self.path}")
        return self.spark.read.parquet(*paths).groupBy(*self.by, "series", "key").agg(F.sum("cnt").alias("cnt"))

    def curves(self) -> DataFrame:
        """The curves of all answers so far, as ``vw_curves`` of the whole gives them."""
        return curves_of_histogram(self.histogram(), *self.grid, by=self.by)

    def compact(self, upto: int) -> None:
        """Fold the batches up to a number, which no later replay may change, into one folder."""
        before = self._merged_to()
        if upto <= before:
            return
        self.histogram(upto).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/merged-{upto}")
        for name in [f"batch-{i}" for i in self._finished("batch") if i <= upto] + ([f"merged-{before}"] if before >= 0 else []):
            fs, folder = self._fs(name)
            fs.delete(folder, True)


def maintain_curves(stream: DataFrame, state: CurveState, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps ``state`` up to date with a stream of answers."""
    return (stream.writeStream.foreachBatch(lambda batch, batch_id: state.update(batch, batch_id))
            .option("checkpointLocation", checkpoint))
