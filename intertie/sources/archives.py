"""Lines of (nested) zip archives as a Spark data source, for tables and for streams of landed files.

The directory of every archive is read from its end; its members are dealt to
input partitions by their size, so one large archive is read by many tasks and
many small ones share a task. A member is read as a stream, archives inside
included: nothing is held but a batch of lines. Files are opened through
``pyarrow.fs``, so local, S3, GCS and HDFS paths work.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import with_package

#: Archives by name, in either case.
ARCHIVES = "*.[zZ][iI][pP]"
BATCH_LINES = 20_000
#: Compressed bytes of a task: some ten times as many of text, and enough tasks for an even load.
PART_BYTES = 4 << 20
# A file too short to be an archive makes a stream seek before its start.
FAULTS = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError, pa.ArrowInvalid)

LINES = pa.schema([("value", pa.string()), ("source_file", pa.string()), ("source_path", pa.string())])
OUTCOMES = pa.schema(
    [("source_file", pa.string()), ("source_path", pa.string()), ("member", pa.string()), ("n_lines", pa.int64()),
     ("fault", pa.string())]
)


def glob_expression(pattern: str) -> re.Pattern:
    """A file-name glob as a regular expression: ``* ? [..] {a,b}`` and backslash escapes."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]"
            i = end
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return re.compile(out + ")" * depth, re.DOTALL)


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    local = re.match(r"(?:file:)?/*(/.*)", path)
    if local:
        return pyarrow.fs.LocalFileSystem(), unquote(local[1]) if path.startswith("file:") else local[1]
    return pyarrow.fs.FileSystem.from_uri(path)


def archive_files(path: str, pattern: str) -> list[pyarrow.fs.FileInfo]:
    """Files below ``path`` whose name the glob matches; names that begin with ``_`` or ``.`` are not landed yet."""
    system, root = file_system(path)
    info = system.get_file_info(root)
    found = [info]
    if info.type == pyarrow.fs.FileType.Directory:
        found = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    matches = glob_expression(pattern).fullmatch
    files = [f for f in found if f.type == pyarrow.fs.FileType.File and f.base_name[0] not in "_." and matches(f.base_name)]
    return sorted(files, key=lambda f: f.path)


@dataclass
class Members(InputPartition):
    """Members of archives: (path, member names, fault of the archive itself) each."""

    archives: list[tuple[str, list[str], str | None]]


def _is_wanted(name: str) -> bool:
    return name.lower().endswith((".zip", ".csv"))


def _directory(path: str, name: str) -> tuple[str, list[tuple[str, int]], str | None]:
    """Wanted members of an archive with their compressed sizes."""
    system, _ = file_system(path)
    try:
        with system.open_input_file(name) as stream, zipfile.ZipFile(stream) as archive:
            return name, [(m.filename, m.compress_size) for m in archive.infolist() if _is_wanted(m.filename)], None
    except FAULTS as error:
        return name, [], str(error)


def dealt(path: str, files: Sequence[str], part_bytes: int) -> list[Members]:
    """Partitions of about ``part_bytes`` compressed bytes, members never cut."""
    parts: list[Members] = []
    size = part_bytes
    with ThreadPoolExecutor(32) as pool:
        for name, members, fault in pool.map(lambda f: _directory(path, f), files):
            if not members:
                members = [("", 0)]
            for member, length in members:
                if size + length > part_bytes and size:
                    parts.append(Members([]))
                    size = 0
                own = parts[-1].archives
                if not own or own[-1][0] != name:
                    own.append((name, [], fault))
                if member:
                    own[-1][1].append(member)
                # Opening a member costs about as much as reading this many bytes.
                size += length + 4096
    return parts


def wanted_lines(stream, prefixes: tuple[str, ...], faults: list[str]) -> Iterator[str]:
    """Wanted lines of the CSV members of an archive, archives inside included; what cannot be read is a fault.

    ``stream`` is seekable. An archive inside is read through its own
    decompressing stream, which goes back by starting over.
    """
    try:
        archive = zipfile.ZipFile(stream)
    except FAULTS as error:
        faults.append(str(error))
        return
    with archive:
        for name in archive.namelist():
            yield from member_lines(archive, name, prefixes, faults)


def member_lines(archive: zipfile.ZipFile, name: str, prefixes: tuple[str, ...], faults: list[str]) -> Iterator[str]:
    """Wanted lines of one member, up to its fault if it has one."""
    if not _is_wanted(name):
        return
    try:
        with archive.open(name) as handle:
            if name.lower().endswith(".zip"):
                inner: list[str] = []
                yield from wanted_lines(handle, prefixes, inner)
                faults += [f"{name}: {fault}" for fault in inner]
            else:
                for raw in io.TextIOWrapper(handle, encoding="utf-8", errors="ignore"):
                    line = raw.strip()
                    if line.startswith(prefixes):
                        yield line
    except FAULTS as error:
        faults.append(f"{name}: {error}")


def _read(path: str, part: Members, prefixes: tuple[str, ...], outcomes: bool) -> Iterator[pa.RecordBatch]:
    """Lines of a partition, or what became of each of its members."""
    system, _ = file_system(path)
    for name, members, fault in part.archives:
        base = name.rsplit("/", 1)[-1]
        if fault is not None or not members:
            if outcomes:
                yield pa.RecordBatch.from_pylist(
                    [{"source_file": base, "source_path": name, "n_lines": 0, "fault": fault}], schema=OUTCOMES
                )
            continue
        with system.open_input_file(name) as stream, zipfile.ZipFile(stream) as archive:
            for member in members:
                faults: list[str] = []
                count, batch = 0, []
                for line in member_lines(archive, member, prefixes, faults):
                    count += 1
                    if outcomes:
                        continue
                    batch.append(line)
                    if len(batch) == BATCH_LINES:
                        yield _lines(batch, base, name)
                        batch = []
                if batch:
                    yield _lines(batch, base, name)
                if outcomes:
                    row = {"source_file": base, "source_path": name, "member": member, "n_lines": count,
                           "fault": "; ".join(faults) or None}
                    yield pa.RecordBatch.from_pylist([row], schema=OUTCOMES)


def _lines(batch: list[str], base: str, name: str) -> pa.RecordBatch:
    n = len(batch)
    return pa.RecordBatch.from_arrays(
        [pa.array(batch, pa.string()), pa.array([base] * n, pa.string()), pa.array([name] * n, pa.string())], schema=LINES
    )


class _Options:
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.pattern = options.get("pattern", ARCHIVES)
        self.prefixes = tuple(json.loads(options.get("prefixes", '[""]')))
        self.outcomes = options.get("report", "lines") == "outcomes"
        self.part_bytes = int(options.get("partitionBytes", PART_BYTES))


class ArchiveReader(_Options, DataSourceReader):
    def partitions(self) -> list[Members]:
        files = [f.path for f in archive_files(self.path, self.pattern)]
        return dealt(self.path, files, self.part_bytes) or [Members([])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition, self.prefixes, self.outcomes)


class ArchiveStream(_Options, DataSourceStreamReader):
    """Archives in the order in which they landed (time of change, then path); an offset is the last one read.

    Archives are complete when they get a name the pattern matches; one that
    is put there with an older time than the last one read is not seen.
    """

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def _after(self, start: dict) -> list[tuple[int, str]]:
        landed = sorted((f.mtime_ns, f.path) for f in archive_files(self.path, self.pattern))
        return [x for x in landed if x > (start["time"], start["path"])]

    def latestOffset(self) -> dict:
        landed = self._after(self.initialOffset())
        return dict(zip(("time", "path"), landed[-1])) if landed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Members]:
        files = [path for time, path in self._after(start) if (time, path) <= (end["time"], end["path"])]
        return dealt(self.path, files, self.part_bytes) or [Members([])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition, self.prefixes, self.outcomes)

    def commit(self, end: dict) -> None:
        """Archives stay where they are."""


class ReportArchive(DataSource):
    """``spark.read.format("report_archive")``: options ``pattern``, ``prefixes`` (JSON), ``report``, ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "report_archive"

    def schema(self) -> str:
        if _Options(self.options).outcomes:
            return "source_file string, source_path string, member string, n_lines long, fault string"
        return "value string, source_file string, source_path string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(self.options)


def _source(reader, path: str, prefixes: Sequence[str], pattern: str, **options):
    reader = reader.format("report_archive").option("prefixes", json.dumps(list(prefixes))).option("pattern", pattern)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def read_archive_lines(
    spark: SparkSession, path: str, prefixes: Sequence[str], pattern: str = ARCHIVES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Lines starting with one of ``prefixes`` from (nested) zip archives, members dealt to tasks by size.

    An archive or member that cannot be read gives the lines before its fault;
    :func:`archive_outcomes` tells which archives have one.
    """
    with_package(spark).dataSource.register(ReportArchive)
    return _source(spark.read, path, prefixes, pattern, partitionBytes=part_bytes)


def stream_archive_lines(
    spark: SparkSession, path: str, prefixes: Sequence[str], pattern: str = ARCHIVES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """The same as a stream over archives as they land; a restarted query goes on after the last one it read."""
    with_package(spark).dataSource.register(ReportArchive)
    return _source(spark.readStream, path, prefixes, pattern, partitionBytes=part_bytes)


def archive_outcomes(spark: SparkSession, path: str, prefixes: Sequence[str], pattern: str = ARCHIVES) -> DataFrame:
    """One row per archive: ``ok``, ``empty`` (no wanted line) or ``corrupt``, the wanted lines read, and its faults."""
    from pyspark.sql import functions as F

    with_package(spark).dataSource.register(ReportArchive)
    members = _source(spark.read, path, prefixes, pattern, report="outcomes")
    found = members.groupBy("source_file", "source_path").agg(
        F.sum("n_lines").alias("n_lines"), F.array_join(F.sort_array(F.collect_list("fault")), "; ").alias("faults")
    )
    outcome = F.when(F.col("faults") != "", "corrupt").when(F.col("n_lines") > 0, "ok").otherwise("empty")
    return found.select("source_file", "source_path", outcome.alias("outcome"), "n_lines", "faults")


def write_archives(lines: DataFrame, path: str, label: str, header: str | None = None, cut: bool = False) -> int:
    """``value`` of ``lines`` as CSV members of archives within one archive for each task; returns the lines written.

    Every member begins with ``header`` if there is one. An archive gets its
    name once it is complete, so a stream never sees half of one; a task that
    runs again writes the same name. With ``cut`` only the first half of each
    archive is left, as after a broken transfer.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = file_system(path)
        name = f"{label}_{TaskContext.get().partitionId():05d}"
        outer, inner_archives, count = io.BytesIO(), 0, 0
        system.create_dir(root, recursive=True)
        unfinished = f"{root}/_{name}"
        with system.open_output_stream(unfinished) as stream:
            with zipfile.ZipFile(outer if cut else stream, "w", zipfile.ZIP_DEFLATED) as archive:
                for batch in batches:
                    values = batch.column(0).to_numpy(zero_copy_only=False).tolist()
                    for first in range(0, len(values), 5000):
                        own = values[first : first + 5000]
                        inner = io.BytesIO()
                        with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as member:
                            member.writestr(f"{name}_{inner_archives}.CSV", "\n".join([*([header] if header else []), *own, ""]))
                            member.writestr("NOTES.TXT", "\n".join(own[:2]))
                        archive.writestr(f"{name}_{inner_archives}.zip", inner.getvalue())
                        inner_archives += 1
                        count += len(own)
            if cut:
                stream.write(outer.getvalue()[: len(outer.getvalue()) // 2])
        if inner_archives:
            system.move(unfinished, f"{root}/{name}.zip")
        else:
            system.delete_file(unfinished)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    with_package(lines.sparkSession)
    written = lines.select("value").mapInArrow(write, "n long").agg({"n": "sum"}).first()[0]
    return written or 0
