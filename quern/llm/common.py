"""What the operators of this subpackage share: word rules, tables in the shared folder, table reading."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these characters.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: a lambda that names a column runs what the column is made of each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Without it, a temporary one, but only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quern-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quern-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def noted() -> Iterator[list[str]]:
    """Yields a list that then holds the paths of the tables which written() made inside."""
    before, paths = len(_written), []
    try:
        yield paths
    finally:
        paths += _written[before:]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes such tables. Call it once what was built on them is stored."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_texts(docs: DataFrame, derive: Callable[[], Callable[[list[str | None]], dict[str, list]]], derived: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` as they are, and those that derive()'s function makes from each Arrow batch of whole texts.

    derive is called once a task, to build what the function needs. derived: the new columns in DDL.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([docs.schema[c] for c in keep] + StructType.fromDDL(derived).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = derive()
        for b in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):  # bounds the Python objects at one time
            made = function(b.column(text).to_pylist())
            columns = [b.column(f.name) if f.name in keep else pa.array(made[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], names=arrow.names)

    return docs.select(*dict.fromkeys((*keep, text))).mapInArrow(run, schema)
