"""A data source that writes rows of 8-bit images as files, all or none.

Each task writes its files, and a table of them, to a folder of its own under ``_temporary``. When all tasks are done the
driver moves the files into place, folder by folder; if the job fails the folders are deleted. Only the name of a task's
folder reaches the driver, whatever the number of files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .encoders import jpeg, png

KINDS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg"}
EXPORTED = "image_id long, file string, bytes long"
MADE = "_exported"  # tables of the files that each job has written; Spark's readers pass over such folders
TABLE = "_files.parquet"


def checked_extension(extension: str) -> str:
    if not isinstance(extension, str):
        raise TypeError(f"extension must be a str, got {type(extension).__name__}")
    if extension.lower() not in KINDS:
        raise ValueError(f"cannot write .{extension} files; {', '.join(KINDS)}")
    return KINDS[extension.lower()]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a path or URI."""
    if "://" in path or path.startswith("file:"):
        store, folder = fs.FileSystem.from_uri(path)
        return store, folder.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Done(WriterCommitMessage):
    part: str


class ImageFiles(DataSource):
    """``df.write.format("image_files")``: rows (image_id, height, width, channels, data) with values of 0 to 255."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("image files are only added; use mode append")
        return ImageWriter(dict(self.options))


class ImageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.extension, self.kind = options["path"], options["extension"], options["kind"]
        self.quality, self.job = int(options["quality"]), options["job"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        store, folder = opened(self.path)
        part = f"{folder}/_temporary/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(part, recursive=True)
        schema = pa.schema([("image_id", pa.int64()), ("file", pa.string()), ("bytes", pa.int64())])
        with store.open_output_stream(f"{part}/{TABLE}") as sink, pq.ParquetWriter(sink, schema) as table:
            for batch in iterator:
                files, sizes = [], []
                ids, *shape = (batch.column(c).to_pylist() for c in ("image_id", "height", "width", "channels"))
                for i, (h, w, c) in enumerate(zip(*shape)):
                    data = batch.column("data")[i].values.to_numpy(zero_copy_only=False).astype("u1").tobytes()
                    body = png(h, w, c, data) if self.kind == "png" else jpeg(h, w, c, data, self.quality)
                    files.append(f"{folder}/{ids[i]}.{self.extension}")
                    sizes.append(len(body))
                    with store.open_output_stream(f"{part}/{ids[i]}.{self.extension}") as f:
                        f.write(body)
                table.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(files, pa.string()), pa.array(sizes, pa.int64())], schema=schema))
        return Done(part)

    def commit(self, messages: list) -> None:
        store, folder = opened(self.path)
        made = f"{folder}/{MADE}/{self.job}"
        store.create_dir(made, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            for k, done in enumerate(m for m in messages if m is not None):
                names = [f.base_name for f in store.get_file_info(fs.FileSelector(done.part))]
                list(pool.map(lambda n, part=done.part: store.move(f"{part}/{n}", f"{folder}/{n}"), [n for n in names if n != TABLE]))
                store.move(f"{done.part}/{TABLE}", f"{made}/part-{k:05}.parquet")
        self._cleared()

    def abort(self, messages: list) -> None:
        self._cleared()

    def _cleared(self) -> None:
        store, folder = opened(self.path)
        store.delete_dir_contents(f"{folder}/_temporary/{self.job}", missing_dir_ok=True)
        for name in (f"{folder}/_temporary/{self.job}", f"{folder}/_temporary"):
            if store.get_file_info(name).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(name)):
                store.delete_dir(name)
