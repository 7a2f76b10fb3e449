"""Tables between the jobs of one operator, in the shared folder, dropped once superseded."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelgraph.session import shared_folder

#: What the contracts call a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


class Tables:
    """Writes tables in the shared folder and drops them by name.

    A table that a returned DataFrame still reads must stay; operators drop the rest. Parts are
    committed by Spark's writer, so a lost executor leaves no half table.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{len(self._paths)}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` under ``name`` (an earlier table of that name goes) and read it back."""
        old, path = self._paths.get(name), f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.mode("error").parquet(path)
        self._paths[name] = path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to the table ``name``, which ``read`` gives."""
        path = self._paths.setdefault(name, f"{self.root}/{name}-{uuid.uuid4().hex[:8]}")
        df.write.mode("append").parquet(path)

    def read(self, name: str, schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self._paths.pop(name, None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, so a long array is not built again per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; an empty array if it has none."""

    def inner(parts: Column) -> Column:
        first = (F.element_at(parts, 1) == "").cast("int")
        last = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
        return F.slice(parts, first + 1, F.size(parts) - first - last)

    return let(F.split(whole(text), SPACE), inner)
