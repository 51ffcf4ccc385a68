"""A Spark data source for folders of reports: ``<root>/<pair>/<side>/<name>.txt|.md|.html`` as rows of lines.

Files are planned as partitions of about ``maxPartitionBytes`` (an option, 16 MB), a larger file alone.  Filters on pair_id, side, kind and name reach the listing, so files that they rule out are
neither opened nor planned.  Side folders are A and H; other folders and other suffixes are no reports.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

KINDS = {"txt": "text", "md": "text", "html": "html", "htm": "html"}
SIDES = ("A", "H")
SCHEMA = "pair_id string, side string, name string, kind string, line int, text string"


class ReportFiles(InputPartition):
    """Files that one task reads: (path, pair_id, side, name, kind)."""

    def __init__(self, files: list[tuple]):
        self.files = files


class ReportReader(DataSourceReader):
    def __init__(self, root: str, most: int):
        self.root, self.most, self.wanted = root, most, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and membership of what a path tells; gives the rest back to Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("pair_id", "side", "name", "kind"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[ReportFiles]:
        store, root = pafs.FileSystem.from_uri(self.root)
        found = []
        for f in store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = f.path[len(root.rstrip("/")) + 1 :].split("/")
            kind = KINDS.get(f.path.rpartition(".")[2].lower())
            if f.type != pafs.FileType.File or len(parts) != 3 or parts[1] not in SIDES or kind is None:
                continue
            told = {"pair_id": parts[0], "side": parts[1], "name": parts[2], "kind": kind}
            if all(told[k] in v for k, v in self.wanted.items()):
                found.append(((f.path, *told.values()), f.size or 0))
        out, room = [], 0
        for file, size in sorted(found):
            if not out or size > room:
                out.append([])
                room = self.most
            out[-1].append(file)
            room -= size
        return [ReportFiles(files) for files in out]

    def read(self, part: ReportFiles) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.root)
        for path, *told in part.files if part else []:  # without any file Spark asks once with none
            with store.open_input_stream(path) as stream:
                number = 0
                for lines in _lines(stream):
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.string()) for v in told] + [pa.array(range(number, number + n), pa.int32()), pa.array(lines, pa.string())], ["pair_id", "side", "name", "kind", "line", "text"])
                    number += n


def _lines(stream) -> Iterator[list[str]]:
    """Lines of a file in lists, a block at a time, without line ends; the last line may lack one."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        if whole:
            yield [x.removesuffix(b"\r").decode("utf-8", "replace") for x in whole]
    if rest:
        yield [rest.removesuffix(b"\r").decode("utf-8", "replace")]


class Reports(DataSource):
    """spark.read.format("reports").load(root): root is a path or URI of a store that pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        root = self.options["path"]
        return ReportReader(root if "://" in root or root.startswith("file:") else f"file://{root}", int(self.options.get("maxPartitionBytes", 16 << 20)))


def load(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all reports under root."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Reports)
    return spark.read.format("reports").load(root)


def write(rows: DataFrame, root: str, pair: str, side: str, name: str, text: str, suffix: str = "txt") -> None:
    """Each row as a report file of its own, written where the row lies; a file that is there is replaced, so a task may run again."""
    target = root if "://" in root or root.startswith("file:") else f"file://{root}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(target)
        for b in batches:
            for p, s, n, t in zip(*(b.column(c).to_pylist() for c in ("p", "s", "n", "t"))):
                store.create_dir(f"{top}/{p}/{s}")
                with store.open_output_stream(f"{top}/{p}/{s}/{n}.{suffix}") as out:
                    out.write((t or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["files"])

    columns = [F.col(c).cast("string").alias(k) for c, k in ((pair, "p"), (side, "s"), (name, "n"), (text, "t"))]
    rows.select(*columns).mapInArrow(put, "files long").write.format("noop").mode("overwrite").save()
