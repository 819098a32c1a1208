"""Log folders as a source, for batches and for streams: spans of bytes become lines, each byte read once.

The built-in file source takes files as immutable. This one reads lines by their place in the file. A
batch cuts large files into spans and puts the spans of small ones together, SPLIT bytes a task; a line belongs to the span in which it begins. A
stream keeps in its offset, for every file, what it is (device and inode, or on stores without them a checksum of its
first line) and how far it was read, and goes on from there up to the last newline. In both, what
stands behind the last newline of a file is held back until its line is finished. A file that was replaced or
cut short is read from its start again. A line longer than LONGEST_LINE is given up: it is reported once
and skipped up to its end. Bytes that are no UTF-8 are reported as well, as rows without a line.

Besides lines, a stream gives events, rows without a line whose problem is one of EVENTS: a file was
replaced, a file is gone, and how many files wait for a later batch (in `offset`).

Columns: path, place (order of arrival: newest file first, then path, then offset; unique in a batch), offset of the
line in its file, line, problem, modified (of the file, epoch seconds). Conditions on `modified` and `path` leave
out files before they are opened.

Files are listed, sought and read through Arrow's file systems (local, HDFS and object stores by URI), in tasks
with no more than a chunk and a line in memory.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

CHUNK = 4 << 20
#: Bytes of a task, at most; with few bytes a task has fewer, down to LEAST, so that all cores have some.
SPLIT, LEAST = 64 << 20, 4 << 20
LONGEST_LINE = 16 << 20
#: Bytes of a first line by which a file is known on a store without inodes.
HEAD = 256
ROTATED, REMOVED, BACKLOG = EVENTS = ("rotated", "removed", "backlog")
SCHEMA = "path string, place bigint, offset bigint, line string, problem string, modified bigint"
_ARROW = pa.schema([("path", pa.string()), ("place", pa.int64()), ("offset", pa.int64()), ("line", pa.string()), ("problem", pa.string()), ("modified", pa.int64())])


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def found(root: str, globs: list[str]) -> tuple[dict[str, fs.FileInfo], list[str]]:
    """(files below root that match a glob, by path; folders that can't be listed)."""
    store, base = opened(root)
    seen: dict[str, list[fs.FileInfo]] = {}
    files, closed = {}, []

    def entries(folder: str) -> list[fs.FileInfo]:
        if folder not in seen:
            try:
                seen[folder] = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            except OSError:
                seen[folder] = []
                closed.append(folder)
        return seen[folder]

    for glob in globs:
        *folders, last = glob.split("/")
        level = [base.rstrip("/")]
        for part in folders:
            level = [e.path for at in level for e in entries(at) if e.type == fs.FileType.Directory and fnmatchcase(e.base_name, part)]
        for at in level:
            files |= {e.path: e for e in entries(at) if e.type == fs.FileType.File and fnmatchcase(e.base_name, last)}
    return files, closed


def access(root: str) -> str:
    """readable, denied or missing: what can't be listed is never taken for absent."""
    store, base = opened(root)
    try:
        if store.get_file_info(base).type == fs.FileType.NotFound:
            return "missing"
        store.get_file_info(fs.FileSelector(base))
        return "readable"
    except FileNotFoundError:
        return "missing"
    except OSError:
        return "denied"


def _seconds(info: fs.FileInfo) -> int:
    return int((info.mtime_ns or 0) // 1_000_000_000)


class Span(InputPartition):
    """Lines that begin in begin .. end of a file and end before `last`; place = offset + shift.

    after: begin may be inside a line, which then belongs to the span before. skip: begin is inside a line that was
    given up. held: what stands behind the last newline is not finished yet. event: nothing but that row.
    """

    def __init__(self, root: str, path: str, begin: int, end: int, last: int, shift: int, modified: int, after=False, skip=False, held=False, event: str | None = None):
        self.root, self.path, self.begin, self.end, self.last, self.shift = root, path, begin, end, last, shift
        self.modified, self.after, self.skip, self.held, self.event = modified, after, skip, held, event


def split(span: Span, size: int) -> list[Span]:
    """A span in parts of `size` bytes; an event is one part."""
    if span.event:
        return [span]
    cuts = list(range(span.begin, max(span.end, span.begin + 1), size))
    common = (span.root, span.path)
    return [
        Span(*common, a, min(a + size, span.end), span.last, span.shift, span.modified, k > 0 or span.after, span.skip and k == 0, span.held)
        for k, a in enumerate(cuts)
    ]


class Group(InputPartition):
    """Spans that a task reads one after the other."""

    def __init__(self, spans: list[Span]):
        self.spans = spans


def grouped(spans: list[Span], parallelism: int) -> list[Group]:
    """Spans cut and put together to about as many bytes a task, two tasks a core or SPLIT bytes."""
    size = min(SPLIT, max(LEAST, sum(s.end - s.begin for s in spans) // (2 * parallelism)))
    out, held = [], 0
    for span in (part for s in spans for part in split(s, size)):
        if not out or held >= size:
            out.append(Group([]))
            held = 0
        out[-1].spans.append(span)
        held += span.end - span.begin
    return out


def _batch(span: Span, offsets: list[int] | np.ndarray, lines: pa.Array, problems: pa.Array) -> pa.RecordBatch:
    n, offsets = len(lines), np.asarray(offsets, np.int64)
    columns = [pa.array([span.path] * n, pa.string()), pa.array(offsets + span.shift), pa.array(offsets), lines, problems, pa.array(np.full(n, span.modified))]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _row(span: Span, offset: int, problem: str) -> pa.RecordBatch:
    return _batch(span, [offset], pa.nulls(1, pa.string()), pa.array([problem], pa.string()))


def _decoded(span: Span, at: int, raw: bytes) -> pa.RecordBatch | None:
    """The lines that begin in the span, of bytes that begin and end with whole lines; empty ones go."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    ends, starts = ends[at + starts < span.end], starts[at + starts < span.end]
    stops = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 13))
    some = stops > starts
    starts, stops = starts[some], stops[some]
    if not len(starts):
        return None
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] = 1
    edges[stops] = -1  # a newline or what stands before it, so no line begins there
    text = data[np.cumsum(edges[:-1], dtype=np.int8) > 0]
    bounds = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    lines = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(text.tobytes())])
    try:
        return _batch(span, at + starts, lines.cast(pa.string()), pa.nulls(len(lines), pa.string()))
    except pa.ArrowInvalid:
        shown = []
        for line in lines.to_pylist():
            try:
                shown.append(line.decode())
            except UnicodeDecodeError:
                shown.append(None)
        return _batch(span, at + starts, pa.array(shown, pa.string()), pa.array([None if x is not None else "invalid UTF-8" for x in shown], pa.string()))


def read_span(span: Span) -> Iterator[pa.RecordBatch]:
    """The rows of a span, a chunk at a time."""
    if span.event:
        yield _row(span, span.begin, span.event)
        return
    store, _ = opened(span.root)
    with store.open_input_file(span.path) as f:
        begin = span.begin - 1 if span.after else span.begin
        f.seek(begin)
        # Bytes up to the next newline are not ours, if `lost`: of the span before, or of a line that was given up.
        at, kept, lost = begin, b"", span.after or span.skip
        while at + len(kept) < span.last:
            raw = f.read(min(CHUNK, span.last - at - len(kept)))
            if not raw:
                break
            kept += raw
            if lost:
                cut = kept.find(b"\n") + 1
                at, kept, lost = (at + cut, kept[cut:], False) if cut else (at + len(kept), b"", True)
            if at >= span.end:
                return
            cut = kept.rfind(b"\n") + 1
            if cut:
                batch = _decoded(span, at, kept[:cut])
                if batch:
                    yield batch
                at, kept = at + cut, kept[cut:]
            if at >= span.end:
                return
            if len(kept) > LONGEST_LINE:
                yield _row(span, at, "oversize line")
                at, kept, lost = at + len(kept), b"", True
        if kept and not span.held and at < span.end:
            yield _row(span, at, "oversize line")


def last_lines(span: Span, max_bytes: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of a file's finished lines, newest first, from its last max_bytes, read backwards chunk by chunk.

    A fragment of a line at the far end is left out, what stands behind the last newline too, and what is no UTF-8.
    Whoever stops asking stops the reading.
    """
    store, _ = opened(span.root)
    floor = max(0, span.last - max_bytes)
    with store.open_input_file(span.path) as f:
        at, held, finished = span.last, b"", False
        while True:
            if not finished:
                cut = held.rfind(b"\n") + 1
                held, finished = (held[:cut], True) if cut else (held, False)
            while finished and held:
                cut = held.rfind(b"\n", 0, len(held) - 1) + 1
                if not cut and at:
                    break  # where this line begins is further ahead
                line, held = held[cut:-1].removesuffix(b"\r"), held[:cut]
                try:
                    if line:
                        yield at + cut, line.decode()
                except UnicodeDecodeError:
                    continue
            if at <= floor:
                return
            low = max(floor, at - min(CHUNK, max_bytes))
            f.seek(low)
            held, at = f.read(at - low) + held, low


def _places(options: dict) -> list[tuple[str, list[str]]]:
    """(root, globs) pairs: of `places`, a JSON list, or of `root` and `globs`."""
    if "places" in options:
        return [(root, list(globs)) for root, globs in json.loads(options["places"])]
    return [(options["root"], options.get("globs", "*.jsonl").split(","))]


def _listing(places: list[tuple[str, list[str]]]) -> list[tuple[str, str, fs.FileInfo]]:
    """(root, path, info) of all files, newest first, each once."""
    every = {}
    for root, globs in places:
        for path, info in found(root, globs)[0].items():
            every.setdefault(path, (root, path, info))
    return sorted(every.values(), key=lambda x: (-_seconds(x[2]), x[1]))


class LogReader(DataSourceReader):
    """The finished lines of all files as they are now; tailBytes: only those of the last bytes of each."""

    def __init__(self, options: dict):
        self.places, self.tail_bytes, self.parallelism = _places(options), int(options.get("tailBytes", 0)), int(options.get("parallelism", 8))
        self.least, self.only = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("modified",):
                bound = f.value + isinstance(f, GreaterThan)
                self.least = bound if self.least is None else max(self.least, bound)
            elif isinstance(f, EqualTo) and f.attribute == ("path",):
                self.only = f.value if self.only in (None, f.value) else ""
            else:
                yield f

    def partitions(self) -> list[Group]:
        out, place = [], 0
        for root, path, info in _listing(self.places):
            if (self.only is None or path == self.only) and (self.least is None or _seconds(info) >= self.least):
                out.append(Span(root, path, 0, info.size, info.size, place, _seconds(info), held=True))
            place += info.size
        if self.tail_bytes:
            return [Group([span]) for span in out] or [Group([])]
        return grouped(out, self.parallelism) or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        for span in partition.spans:
            if self.tail_bytes:
                rows = list(last_lines(span, self.tail_bytes))
                yield _batch(span, [at for at, _ in rows], pa.array([x for _, x in rows], pa.string()), pa.nulls(len(rows), pa.string()))
            else:
                yield from read_span(span)


def complete_end(store: fs.FileSystem, path: str, begin: int, size: int, chunk: int | None = None) -> int:
    """Where the last whole line before `size` ends; `begin` if there is none."""
    with store.open_input_file(path) as f:
        at = size
        while at > begin:
            low = max(begin, at - (chunk or CHUNK))
            f.seek(low)
            cut = f.read(at - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
    # A line that never ends is dropped rather than kept for ever.
    return size if size - begin > LONGEST_LINE else begin


def _identity(store: fs.FileSystem, path: str) -> str:
    if isinstance(store, fs.LocalFileSystem):
        st = os.stat(path)
        return f"{st.st_dev}:{st.st_ino}"
    with store.open_input_file(path) as f:
        return str(zlib.crc32(f.read(HEAD).split(b"\n")[0]))


def _ends_line(store: fs.FileSystem, path: str, end: int) -> bool:
    with store.open_input_file(path) as f:
        f.seek(end - 1)
        return f.read(1) == b"\n"


def resumed(checkpoint: str) -> dict:
    """The files of the newest offset in a query's checkpoint; none where it hasn't begun."""
    store, base = opened(checkpoint)
    logged = [x for x in store.get_file_info(fs.FileSelector(f"{base}/offsets", allow_not_found=True)) if x.base_name.isdigit()]
    if not logged:
        return {}
    with store.open_input_file(max(logged, key=lambda x: int(x.base_name)).path) as f:
        return json.loads(json.loads(f.read().decode().splitlines()[-1])["files"])


class TailReader(DataSourceStreamReader):
    """Offsets map a path to [root, identity, read up to, begun at (-1: not known), inside a line that was given up, size seen, modified].

    maxFilesPerBatch: files that move in a batch, the newest first; firstFiles: in the very first batch, if another
    number. checkpoint: the query's, from which a restarted reader knows how far it was.
    """

    def __init__(self, options: dict):
        self.places = _places(options)
        self.parallelism, self.most = int(options.get("parallelism", 8)), int(options.get("maxFilesPerBatch", 1 << 30))
        self.first = int(options.get("firstFiles", self.most))
        #: Of the offset before; None where no checkpoint tells, until Spark has handed one in.
        self.known: dict | None = resumed(options["checkpoint"]) if "checkpoint" in options else None

    def initialOffset(self) -> dict:
        self.known = self.known or {}
        return {"files": "{}", "backlog": 0}

    def latestOffset(self) -> dict:
        """Positions after this batch, and how many files wait.

        After a restart without a checkpoint the offset before is not known here, so the first batch takes
        every file: one that were left out would be missing from the offset and be read again from its start.
        """
        most = 1 << 30 if self.known is None else self.most if self.known else self.first
        files, there = dict(self.known or {}), _listing(self.places)
        moved = waiting = 0
        for root, p, info in there:
            old, seen = files.get(p), (info.size, _seconds(info))
            if old and (old[5], old[6]) == seen:
                continue  # unchanged: not opened
            if moved >= most:
                waiting += 1
                continue
            store, _ = opened(root)
            try:
                identity = _identity(store, p)
                same = old and old[1] == identity and old[2] <= info.size
                begin = old[2] if same else 0
                end = complete_end(store, p, begin, info.size)
                skip = bool(same and old[4]) if end == begin else not _ends_line(store, p, end)
            except OSError:
                continue  # gone meanwhile, or closed: as it was until it can be read
            moved += end > begin
            files[p] = [root, identity, end, -1 if self.known is None else begin, skip, *seen]
        names = {p for _, p, _ in there}
        self.known = {p: x for p, x in files.items() if p in names}
        return {"files": json.dumps(self.known, sort_keys=True), "backlog": waiting}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = after
        out, place = [], 0

        def event(root: str, path: str, what: str, at: int = 0) -> None:
            nonlocal place
            out.append(Span(root, path, at, at, at, place - at, 0, event=what))
            place += 1

        for p, (root, *_) in before.items():
            if p not in after:
                event(root, p, REMOVED)
        for p, (root, identity, to, begun, _, _, modified) in sorted(after.items(), key=lambda x: (-x[1][6], x[0])):
            old = before.get(p)
            if old == after[p]:
                continue
            at = old[2] if old else 0
            if old and (old[1] != identity or (to if begun < 0 else begun) < old[2]):
                event(root, p, ROTATED)
                at = 0
            if to > at:
                out.append(Span(root, p, at, to, to, place - at, modified, skip=bool(at and old and old[4])))
                place += to - at
        if start.get("backlog", 0) != end["backlog"]:
            event(self.places[0][0], "", BACKLOG, end["backlog"])
        return grouped(out, self.parallelism)

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        for span in partition.spans:
            yield from read_span(span)


class LogSource(DataSource):
    """spark.read or spark.readStream, format("log_lines"), once register(spark) has run."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
