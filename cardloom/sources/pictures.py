"""Data sources: pictures from files, folders and patterns; records to JSON documents.

``register(spark)`` makes both known. Reading gives a row for each input, also for one that is
missing, not a file, empty or undecodable, with its own ``error``:

    spark.read.format("cardloom_pictures").option("paths", json.dumps(["in/", "more/*.png"])).load()

Writing gives a folder of JSON documents, one for each task that had records: a record alone is an
object, several are an array. Files appear only when the whole job is committed:

    records.write.format("cardloom_json").mode("append").save("out/")
"""

from __future__ import annotations

import datetime
import decimal
import fnmatch
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cardloom.sources.decoding import EXTENSIONS, IMAGE, as_row, runs

#: Bytes of files of one task, on average.
PARTITION_BYTES = 64 << 20
_WILD = "*?["


def _place(uri: str):
    """A file system, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), posixpath.abspath(uri.removeprefix("file:")))


@dataclass(frozen=True)
class Input:
    """A file to be read, or an input that is known not to be one."""

    path: str
    size: int
    error: str | None = None


def expand(paths: list[str]) -> list[Input]:
    """The pictures in folders (by their extensions, in order), the files named, and what patterns match; of nothing found, a row that says so."""
    from pyarrow import fs

    out: list[Input] = []
    for uri in paths:
        system, path = _place(uri)
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = [f for f in system.get_file_info(fs.FileSelector(path)) if f.type != fs.FileType.Directory and posixpath.splitext(f.path)[1].lower() in EXTENSIONS]
        elif info.type != fs.FileType.NotFound:
            found = [info]
        elif any(c in path for c in _WILD):
            base = posixpath.dirname(path[: min(path.index(c) for c in _WILD if c in path)])
            known = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
            depth = path.count("/")
            found = [f for f in known if f.path.count("/") == depth and all(map(fnmatch.fnmatchcase, f.path.split("/"), path.split("/")))]
        else:
            found = []
        scheme = uri.split("://")[0] + "://" if "://" in uri else ""
        if not found and info.type != fs.FileType.Directory:
            out.append(Input(uri, 0, f"File not found: {uri}"))
        out += [Input(scheme + f.path, f.size or 0, f"Not a file: {f.path}" if f.type == fs.FileType.Directory else None) for f in sorted(found, key=lambda f: f.path)]
    return out


class _Files(InputPartition):
    def __init__(self, files: list[Input]):
        self.files = files


class PictureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        named = options.get("paths") or options.get("path")
        if not named:
            raise ValueError("name the pictures in the option paths (a JSON list) or path")
        self.paths = json.loads(named) if named.startswith("[") else [named]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        files = expand(self.paths)
        # an empty file still costs a look
        return [_Files(files[a:b]) for a, b in runs([max(f.size, 4096) for f in files], self.most)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for f in partition.files:
            image, error, size = None, f.error, f.size
            if error is None:
                try:
                    system, path = _place(f.path)
                    with system.open_input_file(path) as stream:
                        data = stream.read()
                    size = len(data)
                    image, error = as_row(f.path, data)
                except OSError as e:
                    error = f"Could not read {f.path}: {e}"
            yield f.path, posixpath.basename(f.path.rstrip("/")), size, image, error


class PictureSource(DataSource):
    """Rows of ``path``, ``source`` (its last part), ``length``, ``image`` and ``error``."""

    @classmethod
    def name(cls) -> str:
        return "cardloom_pictures"

    def schema(self) -> str:
        return f"path string, source string, length bigint, image {IMAGE}, error string"

    def reader(self, schema) -> DataSourceReader:
        return PictureReader({k.lower(): v for k, v in self.options.items()})


# -------------------------------------------------------------------------------- records
def plain(value):
    """A value as JSON has it."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value.hex() if isinstance(value, (bytes, bytearray)) else value


@dataclass
class _Part(WriterCommitMessage):
    aside: str | None


class DocumentWriter(DataSourceWriter):
    """Each task writes aside, under a name of its own; the commit of the job moves what succeeded into place.

    A job that is given up removes what its tasks wrote; tasks that are still at work then may leave
    files in its ``_temporary-`` folder, which readers pass over.
    """

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder.rstrip("/"), overwrite, uuid.uuid4().hex

    def _aside(self) -> str:
        return f"{self.folder}/_temporary-{self.job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        first = next(iterator, None)
        if first is None:
            return _Part(None)
        system, folder = _place(self._aside())
        system.create_dir(folder, recursive=True)
        path = f"{folder}/{uuid.uuid4().hex}.json"
        with system.open_output_stream(path) as out:
            text, second = self._text(first), next(iterator, None)
            if second is None:
                out.write(text.encode())
            else:
                out.write(("[\n" + text + ",\n" + self._text(second)).encode())
                for row in iterator:
                    out.write((",\n" + self._text(row)).encode())
                out.write(b"\n]")
        return _Part(path)

    @staticmethod
    def _text(row: Row) -> str:
        return json.dumps(plain(row), ensure_ascii=False, indent=2)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, folder = _place(self.folder)
        system.create_dir(folder, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and f.path.endswith(".json")] if self.overwrite else []
        for k, part in enumerate(m for m in messages if m is not None and m.aside):
            system.move(part.aside, f"{folder}/part-{k:05d}-{self.job}.json")
        for path in old:
            system.delete_file(path)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, aside = _place(self._aside())
        if system.get_file_info(aside).type != fs.FileType.NotFound:
            system.delete_dir(aside)


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cardloom_json"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make both data sources known to a session."""
    spark.dataSource.register(PictureSource)
    spark.dataSource.register(DocumentSink)
