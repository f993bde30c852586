"""Captures as a format of Spark's own: `spark.read.format("capture")`.

The plain form, `.load(path)`, reads a file in one task, which does for rotated captures. Large files
come as proven ranges: `read_captures` has Spark find them (`index_captures`), and the table of
ranges in the shared folder, named by the option `splits`, makes a task of each. Filters on
`file` are pushed down: files and ranges that they rule out become no task.

Options: `splits` (folder of ranges), `head` (bytes of a frame to carry, `all` for everything).

The driver holds one entry per task, as for any Spark scan, and never a frame.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from flowkeel.schema import HEADS_SCHEMA
from flowkeel.session import fresh_path, ship_package
from flowkeel.sources.captures import HEAD_BYTES, PCAP_HEADER, PCAP_MAGIC, SECTION_BYTES, SPLIT_BYTES, Cursor, _frames, index_captures

FORMAT = "capture"


@dataclass
class Range(InputPartition):
    """Whole records of one file, or with no kind the file as a whole."""

    file: str
    kind: str = ""
    start: int = 0
    stop: int = 0
    byte_order: str = "<"
    ticks: list[int] = field(default_factory=list)


def _system(uri: str):
    from pyarrow import fs

    if uri.startswith("/"):
        uri = "file://" + uri
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return system, path, uri[:len(uri) - len(path)].replace("file://", "file:")


def listed(path: str) -> list[str]:
    """URIs of the files that a file, folder or glob names, in name order; hidden and empty ones are left out."""
    from pyarrow import fs

    system, inner, head = _system(path)
    if any(c in inner for c in "*?["):
        at = min(inner.index(c) for c in "*?[" if c in inner)
        base = inner[:at].rpartition("/")[0]
        found = [i for i in system.get_file_info(fs.FileSelector(base or "/", recursive=True))
                 if i.path.count("/") == inner.count("/") and fnmatch.fnmatchcase(i.path, inner)]
    else:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    return sorted(head + i.path for i in found
                  if i.type == fs.FileType.File and i.size > 0 and not i.base_name.startswith((".", "_")))


def stored_ranges(folder: str) -> list[Range]:
    """The ranges of a table that `index_captures` gave."""
    import pyarrow.dataset as ds

    system, inner, _ = _system(folder)
    table = ds.dataset(inner, filesystem=system, format="parquet").to_table(["file", "kind", "start", "stop", "byte_order", "ticks"])
    return [Range(**row) for row in table.sort_by([("file", "ascending"), ("start", "ascending")]).to_pylist()]


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.splits = options.get("path"), options.get("splits")
        head = options.get("head", str(HEAD_BYTES))
        self.head = None if head == "all" else int(head)
        self.only: set[str] | None = None
        if not (self.path or self.splits):
            raise ValueError("a capture needs a path or splits")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the filters that name files; Spark applies the others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                names = {f.value}
            elif isinstance(f, In) and f.attribute == ("file",):
                names = set(f.value)
            else:
                yield f
                continue
            self.only = names if self.only is None else self.only & names

    def partitions(self) -> list[Range]:
        ranges = stored_ranges(self.splits) if self.splits else [Range(f) for f in listed(self.path)]
        return [r for r in ranges if self.only is None or r.file in self.only]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        with Cursor(partition.file) as cur:
            split = asdict(partition) if partition.kind else whole(cur, partition.file)
            yield from _frames(cur, split, self.head)


def whole(cur: Cursor, file: str) -> dict:
    """A file as one range, which needs no walk ahead."""
    magic = cur.take(0, 4)
    if magic in PCAP_MAGIC:
        order, ticks = PCAP_MAGIC[magic]
        return asdict(Range(file, "pcap", PCAP_HEADER, cur.length, order, [ticks]))
    if magic != SECTION_BYTES:
        raise ValueError(f"not a capture file: {file}")
    return asdict(Range(file, "pcapng", 0, cur.length))


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return HEADS_SCHEMA

    def reader(self, schema: StructType) -> CaptureReader:
        if schema != HEADS_SCHEMA:
            raise ValueError("the columns of captures are fixed")
        return CaptureReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def read_captures(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES, head: int | None = HEAD_BYTES) -> DataFrame:
    """Frames of all captures a path, list or glob names, a task for each proven range."""
    register(spark)
    splits = fresh_path(spark, "capture-splits")
    index_captures(spark, path, split_bytes).write.parquet(splits)
    return spark.read.format(FORMAT).option("splits", splits).option("head", "all" if head is None else str(head)).load()


def stream_frames(spark: SparkSession, path: str, files: int | None = None, head: int | None = HEAD_BYTES) -> DataFrame:
    """Frames of the captures that arrive in a folder or under a glob, each file by one task.

    Spark's own file stream keeps the log of files seen; their content is read by the same reader.
    """
    ship_package(spark)
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    arrived = (source.option("maxFilesPerTrigger", files) if files else source).load(path).filter(F.col("length") > 0)
    reader = CaptureReader({"path": path, "head": "all" if head is None else str(head)})

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                yield from reader.read(Range(file))

    return arrived.select(F.col("path").alias("file")).mapInArrow(frames, HEADS_SCHEMA)
