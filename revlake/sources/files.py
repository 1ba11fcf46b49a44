"""Small driver-side files (manifests, locks) through Hadoop's file systems, so that any store path works."""

from __future__ import annotations

import uuid

from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from revlake.errors import CorruptionError


#: Bytes that a copy holds at once.
PIECE = 8 << 20


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def sizes(self, path: str) -> dict[str, int]:
        """Name and length of every entry of a folder, by one listing; none if there is no such folder."""
        fs, p = self._at(path)
        return {s.getPath().getName(): s.getLen() for s in fs.listStatus(p)} if fs.exists(p) else {}

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        except Py4JJavaError as e:
            if "ChecksumException" in str(e.java_exception):
                raise CorruptionError(f"{path} does not match its checksum") from None
            raise
        finally:
            stream.close()

    def create(self, path: str, content: str) -> bool:
        """Writes a new file; False if there is one already."""
        fs, p = self._at(path)
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        return True

    def publish(self, path: str, content: str) -> bool:
        """Writes beside and renames: readers see the whole file or none. False if there is one already."""
        fs, p = self._at(path)
        beside = f"{p.getParent().toString()}/.{p.getName()}.{uuid.uuid4().hex}"
        self.create(beside, content)
        if not fs.exists(p) and fs.rename(self.jvm.org.apache.hadoop.fs.Path(beside), p):
            return True
        self.delete(beside)
        return False

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def portable(self, path: str) -> str | None:
        """The path as a URI that pyarrow's file systems take, as executors have no Hadoop client; None if they have none for it."""
        system, p = self._at(path)
        uri = system.makeQualified(p).toString()
        uri = f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri
        try:
            fs.FileSystem.from_uri(uri)
        except Exception:  # noqa: BLE001  unknown scheme, or a client library is missing
            return None
        return uri

    def copy(self, pairs: list[tuple[str, str]]) -> dict[str, int] | None:
        """Copies files on executors, and gives the length of each target; None if their file system cannot be reached there.

        A file is written under a name of its task's attempt and renamed: a task that is run again after a loss replaces it
        by an equal one.
        """
        uris = [(self.portable(a), self.portable(b), b) for a, b in pairs]
        if any(a is None or b is None for a, b, _ in uris):
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for source, target, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    (from_fs, a), (to_fs, b) = fs.FileSystem.from_uri(source), fs.FileSystem.from_uri(target)
                    folder, _, file = b.rpartition("/")
                    beside, size = f"{folder}/_{file}.{TaskContext.get().taskAttemptId()}", 0
                    to_fs.create_dir(folder, recursive=True)
                    with from_fs.open_input_stream(a) as read, to_fs.open_output_stream(beside) as write:
                        while piece := read.read(PIECE):
                            write.write(piece)
                            size += len(piece)
                    to_fs.move(beside, b)
                    out.append((name, size))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([s for _, s in out], pa.int64())], ["name", "size"])

        rows = self.spark.createDataFrame(uris, "source string, target string, name string").repartition(max(1, min(len(uris), 1000)))
        return {r.name: r["size"] for r in rows.mapInArrow(run, "name string, size bigint").collect()}  # one row a file, as in the manifest
