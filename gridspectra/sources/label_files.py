"""Label maps as folders of PNG files: a data source to read and write them.

    register(spark)
    spark.read.format("label_maps").load(folder)            # id, r, c, label
    write_label_maps(maps, folder)

Files are reached by Arrow's file systems, so `folder` may be a path or an address of any store that they know. It must be one that all executors share.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from gridspectra.sources.files import CELLS, map_cells, map_file

SCHEMA = "id string, r int, c int, label int"
#: Files of a task when reading, unless the option `files` says otherwise.
FILES = 64
#: Files below it are not yet, or never will be, part of the folder's maps.
PENDING = "_pending"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    store, at = fs.FileSystem.from_uri(path)
    return store, at.rstrip("/")


def _name(path: str) -> str:
    return posixpath.basename(path).removesuffix(".png")


@dataclass
class FileGroup(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    """Folder of a task's files, null if it had none. The driver is told of folders, never of files."""

    folder: str | None


class LabelMapReader(DataSourceReader):
    """Cells of the PNG files below a folder, a group of files to a task; equality and `in` on id choose files before any is read."""

    def __init__(self, options):
        self.path, self.size, self.wanted = options["path"], int(options.get("files", FILES)), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self):
        store, at = _open(self.path)
        found = store.get_file_info(fs.FileSelector(at, recursive=True))
        pending = f"{at}/{PENDING}/"
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".png") and not f.path.startswith(pending))
        if self.wanted is not None:
            paths = [p for p in paths if _name(p) in self.wanted]
        return [FileGroup(paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [FileGroup([])]

    def read(self, partition):
        store, _ = _open(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                data = f.read()
            for r, c, label in map_cells(data, CELLS):
                columns = {"id": pa.array([_name(path)] * len(r), pa.string()), "r": pa.array(r), "c": pa.array(c), "label": pa.array(label)}
                yield pa.RecordBatch.from_pydict(columns)


class LabelMapWriter(DataSourceArrowWriter):
    """One file for each run of rows of one id. Tasks write below PENDING; a commit moves a folder for each task, an abort deletes all.

    What a lost driver leaves below PENDING is never read. An id that comes back in the same task is an error.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _open(self.path)
        folder = f"{at}/{PENDING}/{self.run}/{uuid.uuid4().hex}"
        parts, own, seen = [], None, set()

        def finish():
            if own is None:
                return
            if own in seen or own in ("", ".", "..") or "/" in own:
                raise ValueError(f"an id names no file of its own: {own!r}")
            if not seen:
                store.create_dir(folder, recursive=True)
            seen.add(own)
            r, c, label = (np.concatenate([p[k] for p in parts]) for k in range(3))
            with store.open_output_stream(f"{folder}/{own}.png") as f:
                f.write(map_file(r, c, label))

        for batch in iterator:
            if any(batch.column(n).null_count for n in ("id", "r", "c", "label")):
                raise ValueError("label maps hold no nulls")
            ids = batch.column("id").to_pylist()
            r, c, label = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("r", "c", "label"))
            cuts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]] + [len(ids)]
            for i, j in zip(cuts, cuts[1:]):
                if ids[i] != own:
                    finish()
                    parts, own = [], ids[i]
                parts.append((r[i:j], c[i:j], label[i:j]))
        finish()
        return Written(folder if seen else None)

    def commit(self, messages):
        store, at = _open(self.path)
        if self.overwrite:
            old = [f for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if posixpath.basename(f.path) != PENDING]
            for f in old:
                (store.delete_dir if f.type == fs.FileType.Directory else store.delete_file)(f.path)
        for k, message in enumerate(m for m in messages if m is not None and m.folder):
            store.move(message.folder, f"{at}/part-{k:05d}-{self.run}")
        self._clear(store, at)

    def abort(self, messages):
        self._clear(*_open(self.path))

    def _clear(self, store, at):
        """Delete what this run left pending, other runs' files stay."""
        if store.get_file_info(f"{at}/{PENDING}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{PENDING}/{self.run}")


class LabelMaps(DataSource):
    """Label maps of 8-bit gray or palette PNG files; `path` is a folder, ids are file names without extension."""

    @classmethod
    def name(cls) -> str:
        return "label_maps"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LabelMapReader(self.options)

    def writer(self, schema, overwrite: bool) -> LabelMapWriter:
        return LabelMapWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let sources in Python take filters, without which Spark does not read by one that can."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LabelMaps)


def read_label_maps(spark: SparkSession, path: str, files: int = FILES) -> DataFrame:
    """Cells (id, r, c, label) of the PNG files below `path`; equality and `in` on id choose files."""
    register(spark)
    return spark.read.format("label_maps").option("files", files).load(path)


def write_label_maps(maps: DataFrame, path: str, overwrite: bool = False) -> None:
    """Label maps (id, r, c, label) as PNG files below `path`, one an image; cells that are missing are 0 to other readers and are not read again here, labels outside 0..255 and nulls are an error.

    Rows of an image are brought together by one shuffle on id; a task holds one image at a time.
    """
    register(maps.sparkSession)
    of = maps.selectExpr("cast(id as string) id", "cast(r as int) r", "cast(c as int) c", "cast(label as int) label")
    of.repartition("id").sortWithinPartitions("id").write.format("label_maps").mode("overwrite" if overwrite else "append").save(path)
