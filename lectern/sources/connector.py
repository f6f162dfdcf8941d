"""Folders of papers, and files of documents, as data sources of Spark: read, followed as a stream, and written.

    register(spark)
    spark.read.format("papers").load(root)                    # what papers.papers(spark, root) gives
    spark.readStream.format("papers").load(root)              # papers as their folders appear or change
    rows.write.format("paper_files").option("ending", "json").mode("append").save(folder)    # a file a row (name, body)

Reading is planned by paper folder: a task has some folders (a few files each), lists and reads them itself, and holds one
paper at a time. A stream's offset is the time of the newest change so far; a trigger takes the folders whose newest file
is later than the last offset, each whole.

A writer's tasks write below a folder of their own, aside of the target; only when all are done the driver moves the files
into place, and when one has failed it deletes that folder. So no half-written export is seen, and a task that Spark runs
twice leaves what the one that counts has written. Files of the same name are replaced (append), or all others go first
(overwrite).

Any file system that pyarrow opens by its URI can be used. Defined cases: folders without a .tex file right below them give
no row; a file that can't be read gives its paper a row with error; a null name or body is no file; names are to be unique: of
rows with one name one stays; names are made safe as export's are.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import fixed
from . import papers

SCHEMA = "doc_id string, main string, text string, error string"


def opened(path: str):
    """(file system, path there) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), posixpath.abspath(path))


def declared(content: bytes) -> str:
    """papers.declared_encoding for one file."""
    for line in content.decode("latin-1").split("\n")[:50]:
        for pattern in fixed.ENCODINGS:
            found = re.search(pattern, line)
            if found and (name := re.sub(r"\s", "", found[1])):
                return name
    return "UTF-8"


def paper_of(folder: str, files: dict[str, bytes], strict: bool = False) -> tuple[str, str, str | None, str | None] | None:
    """(doc_id, main, text, error) of a folder's files by path; None if none can be its main file."""
    own = sorted(p for p in files if p.endswith(".tex") and posixpath.dirname(p) == folder)
    if not own:
        return None
    named = [p for p in own if posixpath.basename(p) in ("main.tex", "mainfile.tex")]
    begin = [p for p in own if b"\\begin{document}" in files[p]]
    main, doc = (named or begin or own)[0], posixpath.basename(folder)
    try:
        texts = {p: papers.read_text(data, declared(data))[1] for p, data in files.items()}
        return doc, main, papers.inlined(texts, main, strict), None
    except RecursionError as error:
        return doc, main, None, str(error)


@dataclass
class Folders(InputPartition):
    paths: list[str]


class _Reading:
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.strict = options["path"], options.get("strict", "false") == "true"
        self.together = int(options.get("folders_a_task", "16"))

    def folders(self) -> list[str]:
        from pyarrow import fs

        system, top = opened(self.root)
        return sorted(i.path for i in system.get_file_info(fs.FileSelector(top)) if i.type == fs.FileType.Directory and not i.base_name.startswith(("_", ".")))

    def shared(self, folders: list[str]) -> list[Folders]:
        return [Folders(folders[k : k + self.together]) for k in range(0, len(folders), self.together)]

    def rows(self, part: Folders) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = opened(self.root)
        prefix = self.root.partition(":")[0] + ":" if ":" in self.root.split("/")[0] else "file:"
        for folder in part.paths:
            try:
                infos = [i for i in system.get_file_info(fs.FileSelector(folder, recursive=True)) if i.type == fs.FileType.File]
                files = {}
                for info in infos:
                    with system.open_input_stream(info.path) as stream:
                        files[info.path] = stream.read()
            except OSError as error:
                yield posixpath.basename(folder), folder, None, str(error)
                continue
            row = paper_of(folder, files, self.strict)
            if row:
                yield row[0], f"{prefix}{row[1]}", *row[2:]


class PapersReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.reading = _Reading(options)

    def partitions(self) -> list[Folders]:
        return self.reading.shared(self.reading.folders())

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.reading.rows(partition)


class PapersStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.reading = _Reading(options)

    def _changed(self) -> dict[str, int]:
        """The time of the newest file of each folder, in nanoseconds."""
        from pyarrow import fs

        system, _ = opened(self.reading.root)
        newest = lambda folder: max((i.mtime_ns for i in system.get_file_info(fs.FileSelector(folder, recursive=True)) if i.type == fs.FileType.File), default=0)
        return {folder: newest(folder) for folder in self.reading.folders()}

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        return {"changed": max(self._changed().values(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        return self.reading.shared([f for f, at in sorted(self._changed().items()) if start["changed"] < at <= end["changed"]])

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.reading.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: folders stay."""


class PapersSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PapersReader:
        return PapersReader(self.options)

    def streamReader(self, schema: StructType) -> PapersStreamReader:
        return PapersStreamReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    folder: str


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.target, self.overwrite, self.ending = options["path"], overwrite, options.get("ending", "json")
        if self.ending not in ("json", "dot", "txt"):
            raise ValueError("the ending must be json, dot or txt")
        self.aside = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, target = opened(self.target)
        own = f"{target}/{self.aside}/{uuid.uuid4().hex}"  # of this attempt
        system.create_dir(own, recursive=True)
        latest: dict[str, str] = {}
        for row in iterator:
            if row["name"] is None or row["body"] is None:
                continue
            name, body = re.sub(r"[/\\]", "_", row["name"]), row["body"]
            if self.ending == "json":
                json.loads(body)  # what isn't JSON fails the write
            if name in latest and latest[name] >= body:
                continue
            latest[name] = body
            with system.open_output_stream(f"{own}/{name}.{self.ending}") as out:
                out.write(body.encode("utf-8"))
        return Written(sorted(latest), own)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, target = opened(self.target)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(target)):
                if info.base_name != self.aside:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        for message in sorted((m for m in messages if m), key=lambda m: m.folder):
            for name in message.names:
                system.move(f"{message.folder}/{name}.{self.ending}", f"{target}/{name}.{self.ending}")
        self._clear(system, target)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.target))

    def _clear(self, system, target: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{target}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{target}/{self.aside}")


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paper_files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PapersSource)
    spark.dataSource.register(FilesSource)
