"""Frames of uncompressed media as rows: what pictures show and how loud tracks are.

Read with the standard library: PNG (8 bits, not interlaced), QuickTime movies of
raw RGB pictures, and WAV. Headers are read first; then each file is parted into
ranges of frames, a row each, which are dealt out and read on their own, so a
long film is spread over many tasks, none of which holds more than three pictures.
Other formats, and files that are cut short or broken, give no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import IO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions import pixels
from spindle.sources.ingest import opened, suffix

#: Frames of a picture range and of a loudness range.
PICTURES, BLOCKS = 64, 4096
# The rate to which loudness frames refer, their length and step in samples, corners and quality for pairs of a shot.
RATE, LENGTH, HOP = 22_050, 2048, 512
PAIR_CORNERS, PAIR_QUALITY = 50, 0.3
#: A header's boxes are small; a larger one is not read.
HEADER = 64 << 20
RANGES = "path string, first bigint, last bigint, total bigint, fps double"
FRAMES = "path string, frame_idx int, fps double, ts_sec double, end_sec double, hist array<double>, flow_mag double, luma_mean double, laplacian_var double, face_ratio double, n_faces int, flow_next double, diff_next double"
RMS = "path string, frame int, t double, value double"


class Unreadable(Exception):
    """A file of another format, or a broken one."""


def exactly(file: IO[bytes], n: int) -> bytes:
    data = file.read(n)
    if len(data) < n:
        raise Unreadable("cut short")
    return data


def png(file: IO[bytes]) -> np.ndarray:
    """A PNG as rows x columns x (blue, green, red), or grey."""
    if exactly(file, 8) != b"\x89PNG\r\n\x1a\n":
        raise Unreadable("no PNG")
    head, body = b"", []
    while True:
        size, kind = struct.unpack(">I4s", exactly(file, 8))
        data = exactly(file, size + 4)[:-4]
        if kind == b"IHDR":
            head = data
        elif kind == b"IDAT":
            body.append(data)
        elif kind == b"IEND":
            break
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if bits != 8 or interlaced or channels is None or not width * height:
        raise Unreadable("a PNG of another kind")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * channels)
    except (zlib.error, ValueError) as e:
        raise Unreadable(str(e)) from e
    out = np.zeros((height + 1, width + 1, channels), np.uint8)  # with a row and a column of zeros before
    for y, row in enumerate(raw, 1):
        line, above = row[1:].reshape(width, channels), out[y - 1, 1:]
        if row[0] == 0:
            out[y, 1:] = line
        elif row[0] == 1:
            out[y, 1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif row[0] == 2:
            out[y, 1:] = line + above
        else:  # each pixel needs the one before it
            own, up = out[y].astype(int), out[y - 1].astype(int)
            for x, value in enumerate(line.astype(int), 1):
                a, b, c = own[x - 1], up[x], up[x - 1]
                p = a + b - c
                near = (a + b) // 2 if row[0] == 3 else np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
                own[x] = (value + near) & 255
            out[y] = own
    picture = out[1:, 1:]
    return picture[..., 0] if channels < 3 else picture[..., 2::-1]


@dataclass
class Movie:
    """Where the raw pictures of a QuickTime movie are."""

    width: int
    height: int
    fps: float
    places: list[int]

    def picture(self, file: IO[bytes], i: int) -> np.ndarray:
        file.seek(self.places[i])
        return np.frombuffer(exactly(file, self.width * self.height * 3), np.uint8).reshape(self.height, self.width, 3)[..., ::-1]


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte, end) of the boxes that follow one another."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        if size < 8 or at + size > end:
            raise Unreadable("a box beyond its parent")
        yield kind, at + 8, at + size
        at += size


def within(data: bytes, path: list[bytes], at: int = 0, end: int | None = None) -> tuple[int, int]:
    for kind, first, last in boxes(data, at, end):
        if kind == path[0]:
            return (first, last) if len(path) == 1 else within(data, path[1:], first, last)
    raise Unreadable(f"no {path[0]!r}")


def movie(file: IO[bytes]) -> Movie:
    """The header of a QuickTime movie whose first video track has raw 24-bit pictures."""
    while True:
        head = file.read(8)
        if len(head) < 8:
            raise Unreadable("no header")
        size, kind = struct.unpack(">I4s", head)
        body = struct.unpack(">Q", exactly(file, 8))[0] - 16 if size == 1 else size - 8
        if kind == b"moov":
            if not 0 <= body <= HEADER:
                raise Unreadable("a header too large")
            data = exactly(file, body)
            break
        if body < 0 or kind not in (b"ftyp", b"mdat", b"wide", b"free", b"skip", b"uuid"):
            raise Unreadable("no movie")
        file.seek(body, 1)
    for kind, first, last in boxes(data):
        if kind != b"trak":
            continue
        at, _ = within(data, [b"mdia", b"hdlr"], first, last)
        if data[at + 8 : at + 12] != b"vide":
            continue
        clock, _ = within(data, [b"mdia", b"mdhd"], first, last)
        ticks = struct.unpack_from(">I", data, clock + (20 if data[clock] else 12))[0]
        table = lambda name: within(data, [b"mdia", b"minf", b"stbl", name], first, last)[0]
        described = table(b"stsd") + 8
        form, width, height, depth = data[described + 4 : described + 8], *struct.unpack_from(">HH", data, described + 32), struct.unpack_from(">H", data, described + 82)[0]
        if form != b"raw " or depth != 24:
            raise Unreadable("a movie of another codec")
        each = struct.unpack_from(">I", data, table(b"stts") + 12)[0]
        same, n = struct.unpack_from(">II", data, table(b"stsz") + 4)
        sizes = [same] * n if same else list(struct.unpack_from(f">{n}I", data, table(b"stsz") + 12))
        m = struct.unpack_from(">I", data, table(b"stco") + 4)[0]
        chunks = struct.unpack_from(f">{m}I", data, table(b"stco") + 8)
        k = struct.unpack_from(">I", data, table(b"stsc") + 4)[0]
        runs = [struct.unpack_from(">III", data, table(b"stsc") + 8 + 12 * i)[:2] for i in range(k)]
        places, sample = [], 0
        for c, at in enumerate(chunks, 1):
            for _ in range(next(count for since, count in reversed(runs) if since <= c)):
                if sample < n:
                    places.append(at)
                    at += sizes[sample]
                    sample += 1
        if width * height * 3 > min(sizes, default=0) or not ticks or not each:
            raise Unreadable("pictures of another size")
        return Movie(width, height, ticks / each, places)
    raise Unreadable("no pictures")


@dataclass
class Sound:
    rate: int
    channels: int
    width: int
    start: int
    samples: int

    @property
    def frames(self) -> int:
        """Loudness frames, the first around the first sample."""
        return 1 + int(self.samples * RATE / self.rate) // HOP

    def part(self, file: IO[bytes], first: int, last: int) -> np.ndarray:
        """The mean of all channels, -1 to 1, of samples first to last; silence beyond the ends."""
        a, b = max(0, first), min(self.samples, last)
        file.seek(self.start + a * self.channels * self.width)
        raw = exactly(file, max(0, b - a) * self.channels * self.width)
        if self.width == 1:
            values = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
        else:
            values = np.frombuffer(raw, f"<i{self.width}").astype(float) / 2.0 ** (8 * self.width - 1)
        out = np.zeros(last - first)
        if b > a:
            out[a - first : b - first] = values.reshape(-1, self.channels).mean(axis=1)
        return out


def wav(file: IO[bytes]) -> Sound:
    head = exactly(file, 12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise Unreadable("no WAV")
    form = None
    while True:
        kind, size = struct.unpack("<4sI", exactly(file, 8))
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", exactly(file, size + size % 2))
        elif kind == b"data":
            break
        else:
            file.seek(size + size % 2, 1)
    if form is None or form[0] not in (1, 0xFFFE) or form[5] not in (8, 16, 32) or not form[1] or not form[2]:
        raise Unreadable("a WAV of another kind")
    start, width = file.tell(), form[5] // 8
    file.seek(0, 2)
    there = min(size, file.tell() - start)
    return Sound(form[2], form[1], width, start, there // (width * form[1]))


def tried(run: Callable[[str], Iterator[tuple]], path: str) -> Iterator[tuple]:
    """The rows that ``run`` gives for a file; none more once it can't be read."""
    try:
        yield from run(path)
    except (Unreadable, OSError, struct.error, StopIteration):
        return


def _read(files: DataFrame, headers: Callable[[str], Iterator[tuple]], rows: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Ranges of each file by its header, dealt out one by one, and the rows of each range."""
    names = [c.split()[0] for c in schema.split(", ")]

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                found = [(path, *r) for r in tried(headers, path)]
                if found:
                    yield pd.DataFrame(found, columns=[c.split()[0] for c in RANGES.split(", ")])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                found = list(tried(lambda path, r=r: rows(path, r), r["path"]))
                if found:
                    yield pd.DataFrame(found, columns=names)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = files.repartition(parts, "path").mapInPandas(ranges, RANGES).repartition(parts, "path", "first")
    return spread.mapInPandas(read, schema)


def _pictures(path: str) -> tuple[int, float, Callable[[int], np.ndarray], IO[bytes]]:
    file = opened(path)
    if path.lower().endswith(".png"):
        picture = png(file)
        return 1, 1.0, lambda i: picture, file
    found = movie(file)
    return len(found.places), found.fps, lambda i: found.picture(file, i), file


def frame_rows(files: DataFrame, back: int = 1, size: int = PICTURES) -> DataFrame:
    """FRAMES of movies and PNG pictures (a column ``path``); faces are not looked for.

    ``flow_mag`` compares a frame with the one ``back`` frames before it, ``flow_next`` and ``diff_next`` with the next one.
    """

    def headers(path: str) -> Iterator[tuple]:
        total, fps, _, file = _pictures(path)
        file.close()
        for first in range(0, total, size):
            yield first, min(total, first + size), total, fps

    def rows(path: str, r: dict) -> Iterator[tuple]:
        total, fps, picture, file = _pictures(path)
        with file:
            own, still = picture(int(r["first"])), path.lower().endswith(".png")
            for i in range(int(r["first"]), int(r["last"])):
                after = picture(i + 1) if i + 1 < total else None
                flow = pixels.flow(picture(i - back), own) if i >= back else None
                onward = pixels.flow(own, after, PAIR_CORNERS, PAIR_QUALITY) if after is not None else None
                yield (path, i, fps, 0.0 if still else i / fps, 0.0 if still else total / fps, pixels.histogram(own).tolist(), flow or 0.0, float(pixels.grey(own).mean()), pixels.laplacian_variance(own), 0.0, 0, onward, pixels.difference(own, after) if after is not None else 0.0)
                own = after

    return _read(files.filter(suffix(F.col("path")).isin("png", "mov", "mp4", "m4v")).select("path"), headers, rows, FRAMES)


def rms_rows(files: DataFrame, size: int = BLOCKS) -> DataFrame:
    """RMS of WAV files (a column ``path``): the loudness of LENGTH samples around every HOP-th one, at RATE; other rates keep these times."""

    def headers(path: str) -> Iterator[tuple]:
        with opened(path) as file:
            total = wav(file).frames
        for first in range(0, total, size):
            yield first, min(total, first + size), total, RATE / HOP

    def rows(path: str, r: dict) -> Iterator[tuple]:
        with opened(path) as file:
            sound = wav(file)
            scale = sound.rate / RATE
            long = max(1, round(LENGTH * scale))
            at = [round(i * HOP * scale) - long // 2 for i in range(int(r["first"]), int(r["last"]))]
            part = sound.part(file, at[0], at[-1] + long)
            power = np.r_[0.0, np.cumsum(part**2)]
            for i, a in enumerate(at, int(r["first"])):
                yield path, i, i * HOP / RATE, float(np.sqrt(max(0.0, power[a - at[0] + long] - power[a - at[0]]) / long))

    return _read(files.filter(suffix(F.col("path")) == "wav").select("path"), headers, rows, RMS)
