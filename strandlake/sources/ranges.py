"""A Python data source that reads sequence files by byte ranges.

Every range finds the records that begin in it by itself, so a file of any size is read in parallel
without numbering its lines and without a shuffle:

* ``fastq``: a line that starts with ``@`` is a title if the next line but one starts with ``+``.
  A quality line may start with ``@`` too, but the next line but one is then a line of bases.
* ``segments`` and ``pieces``: FASTA. A range has segments: what continues the record before, and a
  segment for each title in it. Pieces are their bases, with the k - 1 bases that follow, from the
  next range if need be; segments tell where they belong, so that a record is put together
  from ranges by small rows.
* ``fai``: indexed FASTA. The index gives the bytes of any range of bases.

Files are opened through ``pyarrow.fs``, on executors; ranges are planned from names and sizes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "strandlake_sequences"
#: Bytes that are read on at a time where a record goes beyond its range; also the longest title that is recognised at a range's start.
MORE = 1 << 16
#: Bytes of a range whose records are split at a time.
STEP = 4 << 20
#: Tasks among which short ranges are dealt; and the bytes of several ranges that one task reads at most.
TASKS, MOST = 256, 32 << 20
#: Bases of a piece.
PIECE = 1 << 20
_BLANK = b"\n\r \t"
SCHEMAS = {
    "fastq": "title string, header string, location bigint, nucleotides string",
    "fai": "title string, header string, location bigint, nucleotides string",
    "segments": "file string, range bigint, ordinal bigint, title string, start bigint, line_bases bigint, line_bytes bigint, bases bigint",
    "pieces": "file string, range bigint, title string, at bigint, nucleotides string",
}


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class Part(InputPartition):
    def __init__(self, uri: str, number: int, start: int, end: int, size: int):
        self.uri, self.number, self.start, self.end, self.size = uri, number, start, end, size


class Parts(InputPartition):
    """Neighbouring ranges that one task reads one after another, each by itself."""

    def __init__(self, parts: list[Part] | list[BaseRanges]):
        self.parts = parts


class BaseRanges(InputPartition):
    """Stretches of bases of an indexed file: ``id, first base, end, offset of the sequence, bases and bytes of a line, its length``."""

    def __init__(self, uri: str, stretches: list[tuple[str, int, int, int, int, int, int]]):
        self.uri, self.stretches = uri, stretches


class Bytes:
    """A file whose bytes from ``start`` on are read as they are asked for."""

    def __init__(self, uri: str, start: int, size: int):
        system, path = open_fs(uri)
        self.file, self.at, self.size = system.open_input_file(path), start, size

    def upto(self, end: int) -> bytes:
        data = self.file.read_at(max(0, min(end, self.size) - self.at), self.at) if self.at < self.size else b""
        self.at += len(data)
        return data

    def before(self, end: int, n: int) -> bytes:
        return self.file.read_at(min(n, end), max(0, end - n))


def fastq_records(source: Bytes, start: int, end: int) -> tuple[list[bytes], list[bytes]]:
    """Titles (without @) and bases of the records whose titles start in the range; ``source`` is at ``start - 1``, or at 0."""
    data, at = source.upto(end), max(0, start - 1)
    if start:
        # the line that holds the byte before the range isn't of this range
        skip = data.find(b"\n") + 1
        if not skip:
            return [], []
        data, at = data[skip:], at + skip
    if at >= end or not data:
        return [], []

    def lines_of(data: bytes) -> list[bytes]:
        return data.split(b"\n")

    # on to the end of the record that the range's last title starts, four lines at most
    lines = lines_of(data)
    wanted = len(lines) + 4
    while len(lines) < wanted and (more := source.upto(source.at + MORE)):
        data += more
        lines = lines_of(data)
    offsets = at + np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines[:-1]])])
    first = next((i for i in range(len(lines) - 2) if lines[i].startswith(b"@") and lines[i + 2].startswith(b"+")), None)
    if first is None:
        if any(x.strip() for x in lines) and not start:
            raise ValueError("no FASTQ record")
        return [], []
    last = int(np.searchsorted(offsets, end))
    heads = lines[first:last:4]
    while heads and not heads[-1].strip():
        heads.pop()
    bases = lines[first + 1 : first + 4 * len(heads) : 4]
    marks = lines[first + 2 : first + 4 * len(heads) : 4]
    if len(bases) < len(heads) or not all(h.startswith(b"@") for h in heads) or not all(m.startswith(b"+") for m in marks):
        raise ValueError("a FASTQ record must have four lines")
    return [h[1:].strip() for h in heads], [b.strip() for b in bases]


def fasta_segments(source: Bytes, part: Part) -> list[tuple[bytes | None, int, bytes]]:
    """``title`` (none: the record before goes on), place of the first byte after the title, and bytes of lines; ``source`` is at the range's start."""
    data = source.upto(part.end)
    at = part.start
    out: list[tuple[bytes | None, int, bytes]] = []
    fresh = True  # whether the range starts a line
    if part.start:
        back = source.before(part.start, MORE)
        fresh = back.endswith(b"\n")
        if not fresh and back[back.rfind(b"\n") + 1 :].startswith(b">") and (b"\n" in back or len(back) == part.start):
            # the range begins within a title, which is the range's before
            skip = data.find(b"\n") + 1
            if not skip:
                return []
            data, at, fresh = data[skip:], at + skip, True
    pos = 0 if fresh and data.startswith(b">") else data.find(b"\n>") + 1
    if pos < 0 or (pos == 0 and not (fresh and data.startswith(b">"))):
        return [(None, at, data)] if data else []
    if pos:
        out.append((None, at, data[:pos]))
    while pos >= 0:
        stop = data.find(b"\n", pos)
        while stop < 0 and (more := source.upto(source.at + MORE)):
            # the title's rest, which the next range leaves out
            stop = more.find(b"\n")
            data = data + (more if stop < 0 else more[: stop + 1])
            stop = data.find(b"\n", pos)
        if stop < 0:
            out.append((data[pos + 1 :].strip(), at + len(data), b""))
            break
        after = data.find(b"\n>", stop)
        body = data[stop + 1 : after + 1] if after >= 0 else data[stop + 1 :]
        out.append((data[pos + 1 : stop].strip(), at + stop + 1, body))
        pos = after + 1 if after >= 0 else -1
    return out


def following(source: Bytes, start: int, n: int) -> bytes:
    """The ``n`` bases from byte ``start`` on, fewer where the record ends."""
    found, line_start = b"", source.before(start, 1) in (b"\n", b"") if start else True
    source.at = start
    while len(found) < n and (data := source.upto(source.at + MORE)):
        stop = 0 if line_start and data.startswith(b">") else data.find(b"\n>")
        found += (data if stop < 0 else data[:stop]).translate(None, _BLANK)
        if stop >= 0:
            break
        line_start = data.endswith(b"\n")
    return found[:n]


def _text(uri: str) -> str:
    """A small file's text, or that of all files of a folder."""
    system, path = open_fs(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.Directory:
        names = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", ".")))
    else:
        names = [path]
    return "".join(system.open_input_file(p).readall().decode() for p in names)


def fai_stretches(text: str, split: int) -> list[list[tuple[str, int, int, int, int, int, int]]]:
    """The index's sequences as stretches of ``split`` bases at most, short ones together."""
    out: list[list[tuple[str, int, int, int, int, int, int]]] = []
    room = 0
    for line in text.splitlines():
        if not line.strip():
            continue
        name, *numbers = line.split("\t")
        length, start, bases, width = map(int, numbers[:4])
        for a in range(0, length, split):
            b = min(a + split, length)
            if b - a > room:
                out.append([])
                room = split
            out[-1].append((name, a, b, start, bases, width, length))
            room -= b - a
    return out


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.mode, self.k = options["mode"], int(options.get("k", "31"))
        self.files, self.split = json.loads(options["files"]), int(options["split"])

    def partitions(self) -> list[InputPartition]:
        if self.mode == "fai":
            each = [BaseRanges(uri, s) for uri, _, index in self.files for s in fai_stretches(_text(index), self.split)]
        else:
            each = [Part(uri, i, a, min(a + self.split, size), size) for uri, size, *_ in self.files for i, a in enumerate(range(0, size, self.split))]
        # a task costs more than a short range
        n = max(1, min(-(-len(each) // TASKS), MOST // self.split))
        return each if n == 1 else [Parts(each[i : i + n]) for i in range(0, len(each), n)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        # Spark asks for one part even where there is none
        if partition is not None:
            for p in partition.parts if isinstance(partition, Parts) else [partition]:
                yield from getattr(self, f"_{self.mode}")(p)

    def _fastq(self, p: Part) -> Iterator[pa.RecordBatch]:
        for start in range(p.start, p.end, STEP):
            titles, bases = fastq_records(Bytes(p.uri, max(0, start - 1), p.size), start, min(start + STEP, p.end))
            heads = [t.split(b" ", 1)[0] for t in titles]
            for a in range(0, len(titles), 50_000):
                b = a + 50_000
                text = [pa.array(x[a:b], pa.binary()).cast(pa.string()) for x in (titles, heads, bases)]
                yield pa.RecordBatch.from_arrays([text[0], text[1], pa.array([1] * len(text[0]), pa.int64()), text[2]], ["title", "header", "location", "nucleotides"])

    def _fai(self, p: BaseRanges) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(p.uri)
        file = system.open_input_file(path)
        for name, a, b, start, bases, width, length in p.stretches:
            place = lambda x: start + x // bases * width + x % bases  # noqa: E731, B023
            for x in range(a, b, PIECE):
                y = min(min(x + PIECE, b) + self.k - 1, length)
                text = file.read_at(place(y - 1) + 1 - place(x), place(x)).translate(None, _BLANK)
                if len(text) != y - x:
                    raise ValueError(f"the index doesn't fit the file at {name}:{x + 1}")
                yield pa.RecordBatch.from_pylist([{"title": name, "header": name, "location": x + 1, "nucleotides": text.decode()}], schema=pa.schema([("title", pa.string()), ("header", pa.string()), ("location", pa.int64()), ("nucleotides", pa.string())]))

    def _segments(self, p: Part) -> Iterator[pa.RecordBatch]:
        source = Bytes(p.uri, p.start, p.size)
        rows = []
        for i, (title, start, body) in enumerate(fasta_segments(source, p)):
            bases = width = None
            if title is not None:
                line, _, rest = body.partition(b"\n")
                if not rest and start + len(body) >= p.end:
                    # the first line may go on in the next range
                    at = start
                    line = b""
                    while at < p.size and b"\n" not in line:
                        line += source.file.read_at(min(MORE, p.size - at), at)
                        at = start + len(line)
                    ended = b"\n" in line
                    line = line.partition(b"\n")[0]
                else:
                    ended = b"\n" in body
                if line.startswith(b">"):
                    line, ended = b"", False
                bases, width = len(line.translate(None, _BLANK)), len(line) + ended
            rows.append((p.uri, p.number, i, None if title is None else title.decode(), start, bases, width, len(body.translate(None, _BLANK))))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["file", "range", "ordinal", "title", "start", "line_bases", "line_bytes", "bases"]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    def _pieces(self, p: Part) -> Iterator[pa.RecordBatch]:
        source = Bytes(p.uri, p.start, p.size)
        found = fasta_segments(source, p)
        for i, (title, start, body) in enumerate(found):
            text = body.translate(None, _BLANK)
            n = len(text)
            if i == len(found) - 1:
                text += following(source, start + len(body), self.k - 1)
            if title is None and not n:
                continue
            name = None if title is None else title.decode()
            for a in range(0, max(n, 1), PIECE):
                part = text[a : min(a + PIECE, n) + self.k - 1]
                columns = [pa.array([p.uri]), pa.array([p.number], pa.int64()), pa.array([name], pa.string()), pa.array([a], pa.int64()), pa.array([part.decode()])]
                yield pa.RecordBatch.from_arrays(columns, ["file", "range", "title", "at", "nucleotides"])


class SequenceRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[self.options["mode"]]

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(dict(self.options))
