"""``fixedbin``: fixed-length binary records as a Spark data source.

Reading splits files into record-aligned byte ranges and yields Arrow batches of
``(rrn, rec)`` whose buffers are the file bytes themselves.  Everything about the
record's content is decoded later by native expressions.

Options: ``path`` (file, folder or glob; local or any URI pyarrow can open),
``reclen``, ``splitbytes``, ``mode`` (``failfast`` or ``permissive``) and
``filecolumn`` (adds the source file's name).  ``rrn`` counts from 1 through all files in
name order; the start of each file follows from the sizes of those before it.

Writing: tasks write files under their final names, and a job commits by one small manifest that lists them.  Readers
see a file of a job only if a manifest of its folder lists it, so a failed job or a lost task leaves nothing that is
read, and nothing is moved.  Files that came from elsewhere need no manifest.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
import sys
import uuid
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

# Workers get this module with the task, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 8 << 20
SPLIT_BYTES = 128 << 20
#: Files that a job writes, with the job's id, and the manifests that make them count.
OWN_FILE = re.compile(r"part-\d{10,}-([0-9a-f]{32})-[0-9a-f]{32}\.bin")
MANIFEST = re.compile(r"_manifest-([0-9a-f]{32})\.json")


def open_filesystem(path: str):
    """pyarrow filesystem and the path inside it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _manifests(system, files) -> dict[str, dict[str, set[str]]]:
    """For each folder the jobs that count there and the files of each; a job can stand in for earlier ones."""
    found: dict[str, dict[str, set[str]]] = {}
    replaced: set[tuple[str, str]] = set()
    for f in files:
        folder, name = posixpath.split(f.path)
        if match := MANIFEST.fullmatch(name):
            with system.open_input_file(f.path) as source:
                content = json.loads(source.read())
            found.setdefault(folder, {})[match[1]] = set(content["files"])
            replaced.update((folder, job) for job in content["replaces"])
    return {folder: {job: names for job, names in jobs.items() if (folder, job) not in replaced}
            for folder, jobs in found.items()}


def list_files(path: str) -> list[tuple[str, int]]:
    """Data files below a path, at any depth, with their sizes, in name order; hidden and uncommitted ones are skipped."""
    from pyarrow import fs

    system, root = open_filesystem(path)
    pattern = None
    if any(c in root for c in "*?["):
        root, pattern = posixpath.split(root)
        everything = [f for f in system.get_file_info(fs.FileSelector(root))]
    else:
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            return [(info.path, info.size)]
        everything = system.get_file_info(fs.FileSelector(root, recursive=True))
    base = root.rstrip("/")
    committed = _manifests(system, everything)

    def shown(file: str) -> bool:
        folder, name = posixpath.split(file)
        if any(p.startswith(("_", ".")) for p in file[len(base):].split("/") if p) or pattern and not fnmatch.fnmatch(name, pattern):
            return False
        own = OWN_FILE.fullmatch(name)
        return not own or name in committed.get(folder, {}).get(own[1], ())

    return sorted((f.path, f.size) for f in everything if f.type == fs.FileType.File and shown(f.path))


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    stop: int
    before: int  # records in earlier files


class FixedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.reclen = int(options["reclen"])
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.failfast = options.get("mode", "failfast") == "failfast"
        self.named = options.get("filecolumn", "false") == "true"
        self.first, self.last, self.wanted = 1, None, None

    def pushFilters(self, filters):
        """Record-number bounds narrow the byte ranges; Spark still applies every filter itself."""
        for f in filters:
            if getattr(f, "attribute", None) == ("rrn",):
                if isinstance(f, EqualTo):
                    self._narrow(f.value, f.value)
                elif isinstance(f, In):
                    numbers = sorted(v for v in f.value if v is not None)
                    self.wanted = numbers if self.wanted is None else sorted(set(numbers) & set(self.wanted))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self._narrow(f.value + isinstance(f, GreaterThan), None)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self._narrow(1, f.value - isinstance(f, LessThan))
            yield f

    def _narrow(self, first, last):
        self.first = max(self.first, first)
        if last is not None:
            self.last = last if self.last is None else min(self.last, last)

    def partitions(self):
        from bisect import bisect_left

        step = max(1, self.split // self.reclen) * self.reclen
        ranges, before = [], 0
        for file, size in list_files(self.path):
            if self.failfast and size % self.reclen:
                raise ValueError(
                    f"incomplete record: {file} ends with {size % self.reclen} of {self.reclen} bytes "
                    f"at offset {size - size % self.reclen}"
                )
            low = max(0, self.first - 1 - before) * self.reclen
            high = size if self.last is None else min(size, (self.last - before) * self.reclen)
            for start in range(low, high, step):
                stop = min(start + step, high)
                if self.wanted is not None:
                    at = bisect_left(self.wanted, before + start // self.reclen + 1)
                    if at == len(self.wanted) or (self.wanted[at] - 1 - before) * self.reclen >= stop:
                        continue
                ranges.append(ByteRange(file, start, stop, before))
            before += -(-size // self.reclen)
        return ranges or [ByteRange("", 0, 0, 0)]

    def read(self, part: ByteRange):
        import numpy as np
        import pyarrow as pa

        if part.stop <= part.start:
            return
        system, _ = open_filesystem(self.path)
        rows = max(1, BATCH_BYTES // self.reclen)
        with system.open_input_file(part.file) as source:
            at = part.start
            while at < part.stop:
                data = source.read_at(min(rows * self.reclen, part.stop - at), at)
                if not data:
                    break
                count = -(-len(data) // self.reclen)
                ends = np.minimum(np.arange(count + 1, dtype=np.int64) * self.reclen, len(data)).astype(np.int32)
                first = part.before + at // self.reclen + 1
                columns = [
                    pa.array(np.arange(first, first + count, dtype=np.int64)),
                    pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(ends), pa.py_buffer(data)]),
                ]
                names = ["rrn", "rec"]
                if self.named:
                    columns.append(pa.repeat(pa.scalar(posixpath.basename(part.file)), count))
                    names.append("file")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(data)


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class FixedWriter(DataSourceArrowWriter):
    """Tasks write files that nobody reads yet; the manifest of the job makes those of the successful ones count."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        self.reclen = int(options["reclen"])
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches):
        from pyspark import TaskContext

        system, root = open_filesystem(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():010d}-{self.job}-{uuid.uuid4().hex}.bin"
        records = 0
        with system.open_output_stream(posixpath.join(root, name)) as sink:
            for batch in batches:
                sink.write(self._payload(batch.column(batch.schema.get_field_index("rec"))))
                records += batch.num_rows
        return Written(name, records)

    def _payload(self, column):
        """The batch's bytes as one buffer, after checking that every record has the right length."""
        import numpy as np

        kind = np.int64 if str(column.type).startswith("large") else np.int32
        offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset: column.offset + len(column) + 1]
        if column.null_count or (np.diff(offsets) != self.reclen).any():
            raise ValueError(f"every record must have {self.reclen} bytes")
        if not len(column):
            return b""
        return column.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))

    def commit(self, messages):
        """One small file; what a job replaces stops counting with it and is deleted afterwards."""
        from pyarrow import fs

        system, root = open_filesystem(self.path)
        system.create_dir(root, recursive=True)
        before = system.get_file_info(fs.FileSelector(root)) if self.overwrite else []
        old = [file for file, _ in list_files(self.path)] if self.overwrite else []
        jobs = [m[1] for f in before if (m := MANIFEST.fullmatch(posixpath.basename(f.path)))]
        content = {"files": [m.name for m in messages if m is not None and m.records], "replaces": jobs}
        final = posixpath.join(root, f"_manifest-{self.job}.json")
        with system.open_output_stream(final + ".part") as sink:
            sink.write(json.dumps(content).encode())
        system.move(final + ".part", final)
        self._clear(system, root, old, jobs, {m.name for m in messages if m is not None and m.records})
        with system.open_output_stream(posixpath.join(root, "_SUCCESS")):
            pass

    def _clear(self, system, root, old, jobs, kept):
        """Delete what no longer counts: replaced files, then their manifests, and what failed attempts left behind."""
        for file in old:
            system.delete_file(file)
        for job in jobs:
            system.delete_file(posixpath.join(root, f"_manifest-{job}.json"))
        self._drop_own(system, root, kept)

    def abort(self, messages):
        system, root = open_filesystem(self.path)
        self._drop_own(system, root, set())

    def _drop_own(self, system, root, kept):
        from pyarrow import fs

        if system.get_file_info(root).type != fs.FileType.Directory:
            return
        for f in system.get_file_info(fs.FileSelector(root)):
            own = OWN_FILE.fullmatch(posixpath.basename(f.path))
            if own and own[1] == self.job and posixpath.basename(f.path) not in kept:
                system.delete_file(f.path)


class FixedBinary(DataSource):
    @classmethod
    def name(cls):
        return "fixedbin"

    def schema(self):
        named = self.options.get("filecolumn", "false") == "true"
        return "rrn bigint, rec binary" + (", file string" if named else "")

    def reader(self, schema):
        return FixedReader({k.lower(): v for k, v in dict(self.options).items()})

    def writer(self, schema, overwrite):
        return FixedWriter({k.lower(): v for k, v in dict(self.options).items()}, overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FixedBinary)
