"""Tables in versions: a manifest names the complete one, and logs of deltas are folded into a base.

A manifest is a small file that is replaced by one rename, so a reader sees the version before or the version after, and
what a failed writer left behind is never named by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFEST = "_current"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> str | None:
    """The version that the manifest of ``folder`` names."""
    files, manifest = _file_system(spark, folder), f"{folder.rstrip('/')}/{MANIFEST}"
    if not files.exists(_path(spark, manifest)):
        return None
    stream = files.open(_path(spark, manifest))
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).strip()
    finally:
        stream.close()


def point_to(spark: SparkSession, folder: str, version: str) -> None:
    """Let the manifest name ``version``, which has to be complete."""
    folder, hadoop = folder.rstrip("/"), spark._jvm.org.apache.hadoop.fs
    files, draft = _file_system(spark, folder), _path(spark, f"{folder}/{MANIFEST}-{uuid.uuid4().hex}")
    stream = files.create(draft)
    stream.write(bytearray(version, "utf-8"))
    stream.close()
    kind = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = hadoop.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(draft), files.makeQualified(_path(spark, f"{folder}/{MANIFEST}")), options)


class FoldedLog:
    """Keyed deltas by batch, folded into a base at intervals; readers merge the base with what came after.

    ``merge`` turns rows of several deltas into one row a key; it has to be associative. A batch that is written again
    replaces itself, or is left out where the base holds it already, so a replay changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, merge: Callable[[DataFrame], DataFrame], every: int = 16):
        self.spark, self.folder, self.schema, self.merge, self.every = spark, folder.rstrip("/"), schema, merge, every

    def _folded(self) -> int:
        """The last batch that the base holds; -1 before the first fold."""
        base = current(self.spark, self.folder)
        return int(base.rsplit("=", 1)[1]) if base else -1

    def _deltas(self, after: int) -> dict[int, str]:
        """Complete deltas of later batches."""
        files = _file_system(self.spark, self.folder)
        done = files.globStatus(_path(self.spark, f"{self.folder}/delta/batch=*/_SUCCESS")) or []
        paths = [str(status.getPath().getParent().toString()) for status in done]
        batches = {int(path.rsplit("=", 1)[1]): path for path in paths}
        return {batch: path for batch, path in sorted(batches.items()) if batch > after}

    def _rows(self, upto: int | None = None) -> DataFrame:
        folded = self._folded()
        paths = [p for b, p in self._deltas(folded).items() if upto is None or b <= upto]
        if folded >= 0:
            paths.append(current(self.spark, self.folder))
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self.spark.read.schema(self.schema).parquet(*paths))

    def read(self) -> DataFrame:
        """One row a key over all complete batches."""
        return self._rows()

    def append(self, delta: DataFrame, batch: int) -> None:
        """Add the delta of a batch; every so many batches the base is written anew."""
        if batch <= self._folded():
            return
        delta.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/delta/batch={batch}")
        if len(self._deltas(self._folded())) >= self.every:
            self.fold(batch)

    def fold(self, upto: int) -> None:
        """Write a base of all batches up to one. The manifest names it once it is complete."""
        base = f"{self.folder}/base/upto={upto}"
        self._rows(upto).write.mode("overwrite").parquet(base)
        point_to(self.spark, self.folder, base)

    def drop_folded(self) -> None:
        """Remove deltas that the base holds, and bases before it; not while a reader of an older version runs."""
        folded, files = self._folded(), _file_system(self.spark, self.folder)
        for pattern in ("delta/batch=*", "base/upto=*"):
            for status in files.globStatus(_path(self.spark, f"{self.folder}/{pattern}")) or []:
                number = int(str(status.getPath().getName()).rsplit("=", 1)[1])
                if number < folded or (number == folded and pattern.startswith("delta")):
                    files.delete(status.getPath(), True)
