"""Whether an image file is whole, from its structure and without decoding pixels."""

from __future__ import annotations

import sys
import zlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The signature of PNG files; JPEG markers that stand without a length (TEM, RST0 to RST7); JPEG frame headers.
PNG_START = bytes.fromhex("89504E470D0A1A0A")
JPEG_ALONE = {0x01, *range(0xD0, 0xD8)}
JPEG_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def _png(data: bytes) -> str | None:
    at, number, pixels = len(PNG_START), 0, False
    while at + 12 <= len(data):
        end = at + 8 + int.from_bytes(data[at:at + 4], "big")
        kind = data[at + 4:at + 8]
        if end + 4 > len(data):
            return "cut off"
        if zlib.crc32(data[at + 4:end]) != int.from_bytes(data[end:end + 4], "big"):
            return "checksum"
        if (kind == b"IHDR") != (number == 0):
            return "header"
        pixels |= kind == b"IDAT"
        if kind == b"IEND":
            return None if pixels else "no pixels"
        at, number = end + 4, number + 1
    return "cut off"


def _jpeg(data: bytes) -> str | None:
    at, frame, scan = 2, False, False
    while at + 1 < len(data):
        if data[at] != 0xFF:
            return "marker"
        mark = data[at + 1]
        if mark == 0xFF:  # a fill byte
            at += 1
            continue
        if mark == 0xD9:
            return None if frame and scan else "no pixels"
        at += 2
        if mark in JPEG_ALONE:
            continue
        size = int.from_bytes(data[at:at + 2], "big")
        if mark in (0x00, 0xD8) or size < 2:
            return "marker"
        at += size
        if at > len(data):
            return "cut off"
        frame |= mark in JPEG_FRAMES
        if mark == 0xDA:  # coded pixels follow, up to a marker that is neither an escaped byte nor a restart
            scan = True
            while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data) and (
                    data[at + 1] == 0 or data[at + 1] in JPEG_ALONE):
                at += 2
            if at < 0:
                return "cut off"
    return "cut off"


def _gif(data: bytes) -> str | None:
    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    if len(data) < 13:
        return "cut off"
    at, pixels = 13 + table(data[10]), False
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return None if pixels else "no pixels"
        if kind == 0x2C and at + 9 < len(data):
            at, pixels = at + 11 + table(data[at + 9]), True
        elif kind == 0x21:
            at += 2
        else:
            return "marker"
        while at < len(data) and data[at]:
            at += data[at] + 1
        at += 1
    return "cut off"


def _bmp(data: bytes) -> str | None:
    if len(data) < 26:
        return "cut off"
    size, pixels = (int.from_bytes(data[i:i + 4], "little") for i in (2, 10))
    if size > len(data):
        return "cut off"
    return None if 26 <= pixels < len(data) else "header"


WALKERS = ((PNG_START, _png), (b"\xff\xd8\xff", _jpeg), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"BM", _bmp))


def fault_of(data: bytes | None) -> str | None:
    """What is wrong with a file, None if nothing."""
    if not data:
        return "empty"
    return next((walk(data) for start, walk in WALKERS if data.startswith(start)), "not an image")


def image_fault(content: Column | str) -> Column:
    """NULL for a whole JPEG, PNG, GIF or BMP file, else ``empty`` (also for NULL), ``not an image``, ``cut off``, ``header``,
    ``marker``, ``checksum`` or ``no pixels``.

    PNG chunks carry checksums, so any changed byte before the end mark is found. The other formats have none: there a change
    is found if it breaks the structure, not if it only alters pixels. Bytes after the end are ignored, as by most readers.
    """

    @F.arrow_udf("string")
    def faults(batch: pa.Array) -> pa.Array:
        return pa.array([fault_of(value.as_py()) for value in batch], pa.string())

    return faults(content)


# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
