"""Fitted models kept under a key of what they were fitted on (M13's load path).

The key is a digest of the training rows, in any order and however they are partitioned, and of
everything else that decides the fit: the model's kind, its parameters, the columns. One pass
over the rows gives it, as sums that merge. A model is saved under a staging name and then
renamed, so a reader finds a whole model or none, and of two writers one wins.
"""
from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path
from .forest import ForestModel

#: Two independent hashes of a row; the second comes with a text before the row's columns.
_SALTS = ("a", "b")


def table_fingerprint(df: DataFrame, cols: Sequence[str]) -> str:
    """Hex digest of the rows' ``cols`` as a multiset: their number, and the sums and exclusive
    ors of two 64-bit hashes of each row, with the columns' names and types.

    Repeated rows count, a null differs from every value, a changed cell, an added or a missing
    row changes the digest (but for a chance of about 2⁻¹²⁸).
    """
    cols = list(cols)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [F.struct(*[F.col(f"`{c}`").isNull().alias(f"n{i}") for i, c in enumerate(cols)],
                     *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(cols)])]
    hashes = [F.xxhash64(F.lit(s), *rows) for s in _SALTS]
    sums = df.agg(F.count("*").alias("n"), *[F.sum(h.cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i, h in enumerate(hashes)],
                  *[F.bit_xor(h).alias(f"x{i}") for i, h in enumerate(hashes)]).first()
    return hashlib.sha256(json.dumps([[(c, kinds[c]) for c in cols], list(sums)]).encode()).hexdigest()


def model_key(kind: str, params: Mapping, fingerprint: str) -> str:
    return hashlib.sha256(json.dumps([kind, sorted((k, repr(v)) for k, v in params.items()), fingerprint]).encode()).hexdigest()


class ModelStore:
    """Models in a folder that driver and executors share.

    Without ``root`` it lies in the checkpoint folder and goes when the application ends; a
    folder of one's own keeps models for later applications.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        if root is None:
            application = f"models-{spark.sparkContext.applicationId}"
            root = scratch_path(spark, application)
        ensure_checkpoint_dir(spark)
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, key: str) -> bool:
        path, fs = self._path(key)
        return fs.exists(path)

    def publish(self, key: str, model) -> bool:
        """Save ``model`` under ``key`` in one step; False if another writer was first."""
        staging, fs = self._path(f".staging-{uuid.uuid4().hex}")
        target, _ = self._path(key)
        (model.save_trees if isinstance(model, ForestModel) else model.write().save)(staging.toString())
        # a rename onto a folder that exists would move the model inside it: look first, and
        # where another writer came between, take that nested copy away again
        won = not fs.exists(target) and fs.rename(staging, target)
        nested, _ = self._path(f"{key}/{staging.getName()}")
        for left in (staging, nested):
            if fs.exists(left):
                won = False
                fs.delete(left, True)
        return won

    def load(self, key: str, reader):
        """The model under ``key``, read by its class (``ForestModel``, ``DecisionTreeRegressionModel``, ...)."""
        return reader.load(f"{self.root}/{key}")

    def fit_or_load(self, train: DataFrame, kind: str, params: Mapping, cols: Sequence[str],
                    fit: Callable[[DataFrame], object], reader):
        """The model that ``fit`` makes of ``train``: fitted once for these rows and parameters,
        loaded from then on. What is returned is always the stored model."""
        key = model_key(kind, params, table_fingerprint(train, cols))
        if not self.has(key):
            self.publish(key, fit(train))
        return self.load(key, reader)
