"""Parquet footers as a table: which files can be read, without reading them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint, rows bigint, row_groups int, error string"
#: Files that one task looks at.
FILES_PER_TASK = 200


def local_store(path: str):
    """(file system, path in it) of a local path or a URI that pyarrow knows; tasks and driver may call it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def look(store, path: str, length: int) -> tuple[int | None, int | None, str | None]:
    """(rows, row groups, what is wrong) from the two ends of a file and its footer."""
    import pyarrow.parquet as pq

    if length < 12:
        return None, None, "too short"
    try:
        with store.open_input_file(path) as file:
            if file.read_at(4, 0) != b"PAR1":
                return None, None, "no magic number at the beginning"
            end = file.read_at(8, length - 8)
            if end[4:] != b"PAR1":
                return None, None, "no magic number at the end"
            if int.from_bytes(end[:4], "little") + 12 > length:
                return None, None, "the footer is longer than the file"
            footer = pq.read_metadata(file)
        return footer.num_rows, footer.num_row_groups, None
    except Exception as error:
        return None, None, f"{type(error).__name__}: {error}"[:300]


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class FooterReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[Files]:
        """The listing, dealt out: names and lengths, no contents."""
        from pyarrow import fs

        store, root = local_store(self.root)
        if store.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda path: any(p[:1] in "._" and "=" not in p for p in path[len(root):].split("/") if p)
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not hidden(f.path))
        return [Files(files[i:i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = local_store(self.root)
        for path, length in partition.files:
            yield path, length, *look(store, path, length)


class FooterSource(DataSource):
    """`spark.read.format("parquet_footers").load(root)`."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FooterReader(self.options["path"])


def read_footers(spark: SparkSession, root: str) -> DataFrame:
    """path, length, rows, row_groups and error of every Parquet file below `root` (hidden ones left out).

    A task reads the first 4 bytes, the last 8 and the footer of each of its files, whatever their size.
    """
    spark.dataSource.register(FooterSource)
    return spark.read.format("parquet_footers").load(root)
