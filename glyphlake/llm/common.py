"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from glyphlake.sources.scratch import shared_dir


class Workspace:
    """Intermediate tables of one operator call, written as Parquet under the shared folder.

    A written table cuts lineage, is computed once, and survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/glyphlake/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._glyphlake_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that no later plan reads."""
        path = getattr(df, "_glyphlake_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def map_texts(
    df: DataFrame, text_col: str, keep: dict[str, str], fields: str, function: Callable[..., tuple], text_as: str | None = None, given: tuple[str, ...] = ()
) -> DataFrame:
    """``function(text)`` of every row as columns ``fields`` (DDL), beside the columns ``keep`` (new name: old name).

    Columns pass as Arrow arrays, so nulls and large integers stay what they are. ``text_as`` also keeps the text. Columns in
    ``given`` are further arguments of the function, and go.
    """
    made = StructType.fromDDL(fields)
    names = [*keep, *([text_as] if text_as else [])]
    small = df.select(
        *[F.col(f"`{old}`").alias(new) for new, old in keep.items()], F.col(f"`{text_col}`").alias(text_as or "_text_"), *[F.col(f"`{c}`").alias(f"_given_{c}") for c in given]
    )
    types = [to_arrow_type(f.dataType) for f in made]
    schema = StructType([small.schema[n] for n in names] + list(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(k).to_pylist() for k in range(len(keep), batch.num_columns)]
            rows = [function(*x) for x in zip(*texts, strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(names))), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))], names=schema.names
            )

    return small.mapInArrow(run, schema)
