"""Archives as file rows (SRC-1, SRC-4).

An archive is the unit of parallelism: it is at most 50 MB packed and is
checked and unpacked inside one task, member by member.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from itertools import accumulate
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from codelode import fixed
from codelode.session import is_small, maybe_broadcast, store

_ROW = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("is_file", T.BooleanType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("error_class", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
_ARROW = pa.schema(
    [
        ("archive", pa.string()), ("member", pa.string()), ("is_dir", pa.bool_()),
        ("is_file", pa.bool_()),
        ("length", pa.int64()), ("content", pa.binary()), ("error_class", pa.string()),
        ("message", pa.string()),
    ]
)
_FLUSH_BYTES = 16 * 1024 * 1024
# Archives whose root or fault may be copied to every task; most take under 100 bytes.
ARCHIVE_ROWS = 500_000


class Rejected(Exception):
    def __init__(self, error_class: str, message: str):
        super().__init__(message)
        self.error_class = error_class


def _path(name: str) -> PurePosixPath:
    return PurePosixPath(name.replace("\\", "/"))


def _outside(name: str) -> bool:
    """Whether a name has no place below the folder it is unpacked to."""
    path = _path(name)
    return path.is_absolute() or ".." in path.parts or "\x00" in name


def _faults(member: tarfile.TarInfo) -> Iterator[Rejected]:
    """All reasons against one member, in the order in which they are reported."""
    name, link = member.name, member.linkname
    if member.isdev():
        yield Rejected("special_file", f"Special file '{name}' is not allowed.")
    if _outside(name):
        yield Rejected("path_traversal", f"Entry '{name}' leaves the archive.")
    if (member.issym() or member.islnk()) and _outside(link):
        yield Rejected("unsafe_link", f"Entry '{name}' links to '{link}'.")


def _check(members: list[tarfile.TarInfo], max_bytes: int, max_files: int) -> None:
    sizes = accumulate(m.size for m in members)
    counts = accumulate(int(m.isfile()) for m in members)
    for member, size, count in zip(members, sizes, counts):
        for fault in _faults(member):
            raise fault
        if size > max_bytes:
            raise Rejected("size_limit", f"Archive exceeds {max_bytes} uncompressed bytes.")
        if count > max_files:
            raise Rejected("file_limit", f"Archive exceeds {max_files} files.")


def _members(archive: str, payload: bytes, max_bytes: int, max_files: int) -> Iterator[tuple]:
    """Rows of one archive; any bad member rejects all of it before the first row."""
    try:
        if not payload:
            raise Rejected("empty", "Archive is empty.")
        with tarfile.open(fileobj=io.BytesIO(payload), mode="r:*") as tar:
            members = tar.getmembers()
            _check(members, max_bytes, max_files)
            # Unpacking writes a name twice over; the last of its members stays.
            last = {_path(m.name): m for m in members}
            for m in last.values():
                body = tar.extractfile(m).read() if m.isfile() else None
                # Links take part in finding the root but give no file.
                yield archive, m.name, m.isdir(), m.isfile(), m.size, body, None, None
    except Rejected as bad:
        yield archive, None, None, None, None, None, bad.error_class, str(bad)
    except (tarfile.TarError, EOFError, OSError) as bad:
        yield archive, None, None, None, None, None, "corrupt", f"Unreadable archive: {bad}"


def _expand(max_bytes: int, max_files: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if carried:
                yield _listed(batch, carried)
            for archive, content in zip(batch.column("archive"), batch.column("content")):
                rows: list[tuple] = []
                size = 0
                for row in _members(
                    archive.as_py(), content.as_py() or b"", max_bytes, max_files
                ):
                    # A member damaged halfway rejects the rows read before it too,
                    # see ``expand_archives``.
                    rows.append(row)
                    size += row[4] or 0
                    if size > _FLUSH_BYTES:
                        yield _batch(rows, batch, carried)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, batch, carried)

    return run


def _batch(rows: list[tuple], source: pa.RecordBatch, carried: list[str]) -> pa.RecordBatch:
    members = [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)]
    empty = [pa.nulls(len(rows), source.column(c).type) for c in carried]
    return pa.RecordBatch.from_arrays([*members, *empty], names=[*_ARROW.names, *carried])


def _listed(batch: pa.RecordBatch, carried: list[str]) -> pa.RecordBatch:
    """A row per archive, with neither member nor error, that holds the carried columns."""
    n = batch.num_rows
    empty = [pa.nulls(n, f.type) for f in _ARROW if f.name != "archive"]
    return pa.RecordBatch.from_arrays(
        [batch.column("archive"), *empty, *[batch.column(c) for c in carried]], names=[*_ARROW.names, *carried]
    )


def commit_sha(root: Column) -> Column:
    """SRC-4: the last dash part of a root folder name, if 7 to 40 hex digits."""
    return F.nullif(F.lower(F.regexp_extract(root, r"-([0-9a-fA-F]{7,40})[/\\]*\z", 1)), F.lit(""))


def archive_root(members: DataFrame) -> DataFrame:
    """SRC-4: ``(archive, root, commit_sha)`` of archives with a single top folder."""
    unix = F.replace(F.col("member"), F.lit("\\"), F.lit("/"))
    top = F.substring_index(unix, "/", 1)
    folder = F.col("is_dir") | F.contains(F.rtrim(unix, F.lit("/")), F.lit("/"))
    tops = members.where(top != "").groupBy("archive").agg(
        F.min(top).alias("root"),
        F.max(top).alias("_last"),
        F.bool_or(folder).alias("_folder"),
    )
    single = (F.col("root") == F.col("_last")) & F.col("_folder")
    return tops.where(single).select("archive", "root", commit_sha(F.col("root")).alias("commit_sha"))


def expand_archives(
    archives: DataFrame,
    max_bytes: int = fixed.MAX_REPOSITORY_BYTES,
    max_files: int = fixed.MAX_REPOSITORY_FILES,
) -> tuple[DataFrame, DataFrame]:
    """SRC-1 on ``archives(archive, content)``: (files, errors).

    ``files(archive, path, length, content, commit_sha)`` has the single root
    folder removed; ``errors(archive, error_class, message)`` has one row per
    rejected archive.
    """
    files, errors, _listing = unpack(archives, [], max_bytes, max_files)
    return files, errors


def unpack(
    archives: DataFrame, carried: list[str], max_bytes: int, max_files: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-1 with the listing ``(archive, *carried)`` of all archives; ``archives`` is read once."""
    extra = [archives.schema[c] for c in carried]
    schema = T.StructType([*_ROW.fields, *[T.StructField(f.name, f.dataType) for f in extra]])
    rows = archives.select("archive", "content", *carried).mapInArrow(_expand(max_bytes, max_files, carried), schema)
    # All outputs read the unpacked rows, so unpack once.
    rows = store(rows, "archive-members")
    errors = rows.where(F.col("error_class").isNotNull()).select("archive", "error_class", "message")
    members = rows.where(F.col("error_class").isNull() & F.col("member").isNotNull())
    listing = rows.where(F.col("error_class").isNull() & F.col("member").isNull()).select("archive", *carried)
    # What is known of an archive goes to its files; the contents stay where they are.
    few = is_small(errors.select("archive"), ARCHIVE_ROWS)
    members = members.join(maybe_broadcast(errors.select("archive"), few), "archive", "left_anti")
    roots = archive_root(members)
    few = is_small(roots, ARCHIVE_ROWS)
    files = members.where("is_file").join(maybe_broadcast(roots, few), "archive", "left")
    inner = F.when(
        F.col("root").isNotNull() & F.col("member").startswith(F.concat("root", F.lit("/"))),
        F.substring(F.col("member"), F.length("root") + 2, F.length("member")),
    ).otherwise(F.col("member"))
    return (
        files.select("archive", inner.alias("path"), "length", "content", "commit_sha"),
        errors,
        listing,
    )


def read_archives(spark: SparkSession, glob: str, **limits: int) -> tuple[DataFrame, DataFrame]:
    """SRC-1 on files: archives named by their path."""
    source = spark.read.format("binaryFile").load(glob)
    return expand_archives(source.select(F.col("path").alias("archive"), "content"), **limits)
