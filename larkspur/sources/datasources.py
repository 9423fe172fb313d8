"""Files of the stores as Spark data sources: ledger segments by byte ranges, vector frames by their index.

Tasks open files through pyarrow's file systems, which read ranges of local files and of the usual object stores and HDFS, so a
path is an absolute one or a URI.  `register()` makes both formats known to a session:

    larkspur_segments   lines of ledger segments, batch and streaming
    larkspur_frames     big-endian float32 vectors with an index of offsets, read and written
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import ship

#: Bytes that a task is given of a file, and that it holds at once.
RANGE, CHUNK = 64 << 20, 1 << 20
#: Bytes of a segment's line at most, its line feed included: a payload of 1 MiB and its frame.
MAX_LINE = (1 << 20) + 512

SEGMENT_SCHEMA = "path string, offset long, length long, line binary, torn boolean, oversized boolean"
FRAME_SCHEMA = "atom_id string, vec array<float>, version string, place long"


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SegmentSource, FrameSource):
        spark.dataSource.register(source)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there."""
    return pafs.FileSystem.from_uri(path)


def _files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of those below a folder whose names don't begin with '_' or '.', in the order of their paths."""
    at, name = _open(path)
    info = at.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else at.get_file_info(pafs.FileSelector(name, recursive=True))
    prefix = path[: len(path) - len(name)] if path.endswith(name) else path.split("://")[0] + "://"
    return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix) and f.base_name[0] not in "._")


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of a file; *size* is as far as the file counts."""

    path: str
    start: int
    end: int
    size: int


def _ranges(files: Sequence[tuple[str, int, int]], step: int) -> list[Range]:
    return [Range(path, at, min(at + step, size), size) for path, start, size in files for at in range(start, size, step)]


def _lines(part: Range, limit: int) -> Iterator[tuple[int, int, bytes, bool]]:
    """(offset, length, the first *limit* bytes, whether it lacks its line feed) of the lines of a range.

    A range begins in the middle of a line unless the byte before it is a line feed; that line is the range's before.  A line
    that begins in the range is read to its end, wherever that is.  No more than a chunk and *limit* bytes are held."""
    fs, name = _open(part.path)
    with fs.open_input_file(name) as f:
        at = part.start
        if at:
            f.seek(at - 1)
            while at < part.size:
                piece = f.read(min(CHUNK, part.size - at + 1))
                cut = piece.find(b"\n")
                if cut >= 0:
                    at += cut
                    break
                at += len(piece)
            else:
                return
        kept, begin = bytearray(), at
        while begin < part.end and at < part.size:
            f.seek(at)
            piece = f.read(min(CHUNK, part.size - at))
            done = 0
            while begin < part.end:
                cut = piece.find(b"\n", done)
                stop = len(piece) if cut < 0 else cut
                kept += piece[done : min(stop, done + max(0, limit - len(kept)))]
                if cut < 0:
                    break
                yield begin, at + cut - begin, bytes(kept), False
                done, begin = cut + 1, at + cut + 1
                kept.clear()
            at += len(piece)
        if begin < part.end and begin < part.size:
            yield begin, part.size - begin, bytes(kept), True


def _segment_batches(part: Range) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        offset, length, line, torn = zip(*rows, strict=True)
        over = [n + 1 > MAX_LINE for n in length]
        return pa.record_batch([pa.array([part.path] * len(rows)), pa.array(offset), pa.array(length), pa.array(line, pa.binary()), pa.array(torn), pa.array(over)], ["path", "offset", "length", "line", "torn", "oversized"])

    for row in _lines(part, MAX_LINE):
        rows.append(row)
        held += len(row[2])
        if held > CHUNK or len(rows) >= 10_000:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("range", RANGE))

    def partitions(self) -> list[Range]:
        return _ranges([(p, 0, n) for p, n in _files(self.path)], self.step) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _segment_batches(partition) if partition.path else iter(())


class SegmentStream(DataSourceStreamReader):
    """Segments that grow: an offset is how far each file was read, which is the end of its last whole line then."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("range", RANGE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: end for p, n in _files(self.path) if (end := self._whole(p, n))}

    @staticmethod
    def _whole(path: str, size: int) -> int:
        """Where the last line feed of a file ends."""
        fs, name = _open(path)
        with fs.open_input_file(name) as f:
            end = size
            while end > 0:
                begin = max(0, end - CHUNK)
                f.seek(begin)
                cut = f.read(end - begin).rfind(b"\n")
                if cut >= 0:
                    return begin + cut + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges([(p, start.get(p, 0), n) for p, n in sorted(end.items())], self.step)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _segment_batches(partition)


class SegmentSource(DataSource):
    """SEGMENT_SCHEMA: the lines of ledger segments, unread.  length is a line's bytes without its line feed; of a line that is
    oversized only its beginning is kept.  torn: the last line, without its line feed; a stream waits for it.

    Options: path (a file or folder) and range, the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "larkspur_segments"

    def schema(self) -> str:
        return SEGMENT_SCHEMA

    def reader(self, schema: StructType) -> SegmentReader:
        return SegmentReader(self.options)

    def streamReader(self, schema: StructType) -> SegmentStream:
        return SegmentStream(self.options)


# -- vectors ------------------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


@dataclass
class IndexRange(InputPartition):
    """A range of an index, with its commit's number and the bytes of its vector file."""

    index: Range
    commit: str
    vector_bytes: int


class FrameWriter(DataSourceArrowWriter):
    """Each task writes a vector file and its index under a new name; a commit is one file that names them all, so that readers
    see all parts of a write or none.  An abort removes them; what a lost task leaves is never named."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.dimensions, self.prefixed = options["path"].rstrip("/"), int(options["dimensions"]), options.get("prefixed", "false").lower() == "true"
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, name = _open(self.path)
        fs.create_dir(name)
        part, offset, rows = f"part-{uuid.uuid4().hex}", 0, 0
        head = np.array([self.dimensions], ">i4").view(np.uint8)
        try:
            with fs.open_output_stream(f"{name}/{part}.vec") as frames, fs.open_output_stream(f"{name}/{part}.map") as index:
                for batch in iterator:
                    ids, vec = batch.column("atom_id"), batch.column("vec")
                    if ids.null_count or vec.null_count or vec.flatten().null_count:
                        raise ValueError("an id, vector or component is null")
                    names = ids.cast(pa.string()).to_pylist()
                    if any(not i.strip() or "\t" in i or "\n" in i for i in names):
                        raise ValueError("an id is blank or has a tab or line feed")
                    if (np.diff(vec.offsets.to_numpy()) != self.dimensions).any():
                        raise ValueError(f"a vector doesn't have {self.dimensions} dimensions")
                    x = vec.flatten().to_numpy(zero_copy_only=False).astype(">f4").reshape(-1, self.dimensions)
                    raw = x.view(np.uint8)
                    if self.prefixed:
                        raw = np.concatenate([np.broadcast_to(head, (len(x), 4)), raw], axis=1)
                    frames.write(raw.tobytes())
                    index.write("".join(f"{i}\t{offset + k * raw.shape[1]}\n" for k, i in enumerate(names)).encode())
                    offset += raw.size
                    rows += len(x)
        except BaseException:
            self._remove([part])
            raise
        return Written(part, rows)

    def _remove(self, parts: Sequence[str]) -> None:
        fs, name = _open(self.path)
        for p in parts:
            for end in ("vec", "map"):
                if fs.get_file_info(f"{name}/{p}.{end}").type == pafs.FileType.File:
                    fs.delete_file(f"{name}/{p}.{end}")

    def commit(self, messages: list) -> None:
        fs, name = _open(self.path)
        fs.create_dir(name)
        before = _commits(self.path)
        parts = [m.name for m in messages if m is not None and m.rows]
        self._remove([m.name for m in messages if m is not None and not m.rows])
        number = f"{int(before[-1][0]) + 1 if before else 1:012d}"
        said = json.dumps({"overwrite": self.overwrite, "dimensions": self.dimensions, "prefixed": self.prefixed, "parts": sorted(parts)}) + "\n"
        with fs.open_output_stream(f"{name}/{number}.tmp") as out:
            out.write(said.encode())
        fs.move(f"{name}/{number}.tmp", f"{name}/{number}.commit")

    def abort(self, messages: list) -> None:
        self._remove([m.name for m in messages if m is not None])


def _commits(path: str) -> list[tuple[str, dict]]:
    """(number, what it says) of the commits that count: those from the last overwrite on."""
    fs, name = _open(path)
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        return []
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(name)) if f.path.endswith(".commit"))
    out: list[tuple[str, dict]] = []
    for p in found:
        with fs.open_input_stream(p) as f:
            said = json.loads(f.read())
        out = [] if said["overwrite"] else out
        out.append((p.rsplit("/", 1)[1].removesuffix(".commit"), said))
    return out


class FrameReader(DataSourceReader):
    """Reads an index and seeks to the frames it names; an equality on atom_id leaves all other frames unread."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"].rstrip("/"), int(options.get("range", RANGE))
        self.dimensions = int(options["dimensions"])
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("atom_id",):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = ids if self.wanted is None else self.wanted & ids
            yield f  # Spark still checks them all

    def partitions(self) -> list[IndexRange]:
        fs, name = _open(self.path)
        prefix = self.path[: len(self.path) - len(name)]
        out = []
        for number, said in _commits(self.path):
            if said["dimensions"] != self.dimensions:
                raise ValueError(f"commit {number} has {said['dimensions']} dimensions, not {self.dimensions}")
            for part in said["parts"]:
                vec, index = fs.get_file_info([f"{name}/{part}.vec", f"{name}/{part}.map"])
                if pafs.FileType.NotFound in (vec.type, index.type):
                    raise ValueError(f"{part}: vector file or index is missing")
                frame = 4 * self.dimensions + (4 if said["prefixed"] else 0)
                if vec.size % frame:
                    raise ValueError(f"{part}: {vec.size} bytes are no whole number of frames of {frame}")
                out += [IndexRange(r, f"{number}{'p' if said['prefixed'] else ''}", vec.size) for r in _ranges([(prefix + index.path, 0, index.size)], self.step)]
        return out or [IndexRange(Range("", 0, 0, 0), "", 0)]

    def read(self, partition: IndexRange) -> Iterator[pa.RecordBatch]:
        if not partition.index.path:
            return
        prefixed = partition.commit.endswith("p")
        frame, body = 4 * self.dimensions + 4 * prefixed, 4 * self.dimensions
        fs, name = _open(partition.index.path.removesuffix(".map") + ".vec")
        version = f"{partition.commit.removesuffix('p')}/{name.rsplit('/', 1)[1].removesuffix('.vec')}"

        def checked(line: bytes) -> tuple[str, int]:
            atom, tab, at = line.decode("utf-8").partition("\t")
            if not tab or not atom.strip():
                raise ValueError(f"malformed vector index entry: {line[:80]!r}")
            offset = int(at)
            if offset < 0 or offset + frame > partition.vector_bytes:
                raise ValueError(f"offset {offset} of {atom} is outside of the vector file ({partition.vector_bytes} bytes)")
            if offset % frame:
                raise ValueError(f"offset {offset} of {atom} is not aligned to frames of {frame} bytes")
            return atom, offset

        with fs.open_input_file(name) as f:

            def batch(run: list[tuple[str, int]]) -> pa.RecordBatch:
                """Frames that lie one after the other, by one read."""
                f.seek(run[0][1])
                raw = np.frombuffer(f.read(frame * len(run)), np.uint8).reshape(len(run), frame)
                if prefixed and (raw[:, :4].copy().view(">i4") != self.dimensions).any():
                    raise ValueError(f"{name}: a frame has another length")
                x = raw[:, frame - body :].copy().view(">f4").astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(run) + 1) * self.dimensions, pa.int32()), pa.array(x.ravel()))
                return pa.record_batch([pa.array([a for a, _ in run]), lists, pa.array([version] * len(run)), pa.array([o for _, o in run])], ["atom_id", "vec", "version", "place"])

            run: list[tuple[str, int]] = []
            most = max(1, CHUNK // frame)
            for _, _, line, _ in _lines(partition.index, 1 << 16):
                if not line.strip():
                    continue
                atom, offset = checked(line)
                if self.wanted is not None and atom not in self.wanted:
                    continue
                if run and (offset != run[-1][1] + frame or len(run) >= most):
                    yield batch(run)
                    run = []
                run.append((atom, offset))
            if run:
                yield batch(run)


class FrameSource(DataSource):
    """FRAME_SCHEMA: vectors of a folder, all versions of an atom; version and place order them.  Written rows need atom_id and vec.

    Options: path, dimensions, prefixed (frames begin with their length as int32; written into the commit) and range."""

    @classmethod
    def name(cls) -> str:
        return "larkspur_frames"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, overwrite)
