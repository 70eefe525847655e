"""Audio files as Spark data sources: samples of WAV files by byte ranges, and fingerprints that read both ends only.

    audio.register(spark)
    spark.read.format("cadenza_wav").load(folder)

Files are listed once, on the driver, by name and size; everything else is read in
tasks, through any filesystem that pyarrow knows by the folder's address. A filter
on ``path`` leaves other files unopened.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from cadenza.sources.views import AUDIO

MIB = 1 << 20
#: Bytes of a WAV file that one task decodes, frames of a batch, small files that one task fingerprints.
RANGE, BATCH, TOGETHER = 16 * MIB, 1 << 16, 64


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int]]
    first: int = 0
    until: int = 0


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a folder's address, and the folder there; a plain path is local."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


class Files(DataSourceReader):
    """Files below ``path`` with one of ``suffixes``, in the order of their paths; empty ones are left out."""

    def __init__(self, options: dict, suffixes: tuple[str, ...]) -> None:
        self.folder, self.suffixes, self.only = options["path"], suffixes, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("path",):
                asked = {f.value} if isinstance(f, EqualTo) else {*f.value}
                self.only = asked if self.only is None else self.only & asked
            else:
                yield f

    def listed(self) -> list[tuple[str, int]]:
        system, folder = opened(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        named = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.size and x.extension.lower() in self.suffixes)
        return [x for x in named if self.only is None or x[0] in self.only]


def header(source) -> tuple[int, int, int, int] | None:
    """(rate, channels, first byte, bytes) of 16-bit PCM sound, from the chunks at a file's start; None for other files."""
    head = source.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    rate = channels = 0
    while len(chunk := source.read(8)) == 8:
        name, n = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        if name == b"data":
            # A stream that was never closed has no length.
            return (rate, channels, source.tell(), min(n, source.size() - source.tell())) if channels else None
        body = source.read(n + n % 2) if name == b"fmt " else b""
        if name == b"fmt ":
            if len(body) < 16:
                return None
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind not in (1, 0xFFFE) or bits != 16 or not channels:
                return None
        else:
            source.seek(source.tell() + n + n % 2)
    return None


class WavReader(Files):
    def __init__(self, options: dict) -> None:
        super().__init__(options, ("wav",))
        self.range = int(options.get("range", RANGE))

    def partitions(self) -> list[Part]:
        return [Part([x], a, a + self.range) for x in self.listed() for a in range(0, x[1], self.range)]

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        """The frames that begin in the part's range of the file; Spark asks for no part where there is none."""
        if part is None:
            return
        (path, _), = part.files
        system, _ = opened(self.folder)
        try:
            source = system.open_input_file(path)
        except FileNotFoundError:
            return
        with source:
            told = header(source)
            if told is None:
                return
            rate, channels, data, n = told
            wide = 2 * channels
            begin, end = max(0, -(-(part.first - data) // wide)), min(n // wide, max(0, -(-(part.until - data) // wide)))
            for a in range(begin, end, BATCH):
                source.seek(data + a * wide)
                raw = source.read((min(a + BATCH, end) - a) * wide)
                x = np.frombuffer(raw[: len(raw) // wide * wide], "<i2").reshape(-1, channels)
                m = len(x)
                i = np.repeat(np.arange(a, a + m), channels)
                yield pa.record_batch({"path": pa.array([path] * (m * channels)), "rate": np.full(m * channels, rate, np.int32), "ch": np.tile(np.arange(channels, dtype=np.int32), m), "i": i, "v": x.ravel() / 32767.0})


class WavSource(DataSource):
    """``path, rate, ch, i, v``; option ``range``: bytes of a file for each task. Files that are no 16-bit PCM give no rows."""

    @classmethod
    def name(cls) -> str:
        return "cadenza_wav"

    def schema(self) -> str:
        return "path string, rate int, ch int, i long, v double"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


class FingerprintReader(Files):
    def __init__(self, options: dict) -> None:
        super().__init__(options, AUDIO)

    def partitions(self) -> list[Part]:
        found = self.listed()
        return [Part(found[a : a + TOGETHER]) for a in range(0, len(found), TOGETHER)]

    def read(self, part: Part | None) -> Iterator[tuple]:
        system, _ = opened(self.folder)
        for path, size in part.files if part else ():
            try:
                with system.open_input_file(path) as source:
                    ends = str(size).encode() + source.read(min(size, MIB))
                    if size > 2 * MIB:
                        source.seek(size - MIB)
                        ends += source.read(MIB)
            except OSError:
                continue
            yield hashlib.sha256(path.encode()).hexdigest()[:16], path, hashlib.sha256(ends).hexdigest()[:32], size


class FingerprintSource(DataSource):
    """``id, path, file_hash, length``: what ``scan_audio`` tells, from at most two MiB of each file. Files that go meanwhile are skipped."""

    @classmethod
    def name(cls) -> str:
        return "cadenza_fingerprint"

    def schema(self) -> str:
        return "id string, path string, file_hash string, length long"

    def reader(self, schema) -> FingerprintReader:
        return FingerprintReader(self.options)


def register(spark) -> None:
    """Makes both known to the session, with the pushdown of filters that they take part in."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (WavSource, FingerprintSource):
        spark.dataSource.register(source)
