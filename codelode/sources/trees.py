"""Directory trees as file rows (SRC-2)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def relative_files(files: DataFrame, root: str) -> DataFrame:
    """Paths relative to ``root``, with forward slashes."""
    tail = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    return files.select(tail.alias("path"), "length", "content")


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """SRC-2: every file below ``root`` with its size and bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return relative_files(files, root)


def write_source_tree(files: DataFrame, root: str) -> None:
    """Write ``files(path, content)`` as files below ``root``, through the file system that ``root`` names.

    Each task writes its own files; a repeated task writes the same ones again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pa_fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{base}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content or b"")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["written"])

    files.select("path", "content").mapInArrow(run, "written bigint").write.format("noop").mode("overwrite").save()
