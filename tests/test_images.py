import random
import zlib

import pytest

from riskweave.sources import files, images


def chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


HEAD = chunk(b"IHDR", (2).to_bytes(4, "big") * 2 + bytes([8, 0, 0, 0, 0]))
PNG = images.PNG_START + HEAD + chunk(b"IDAT", zlib.compress(bytes(6))) + chunk(b"IEND", b"")


def segment(mark: int, body: bytes) -> bytes:
    return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body


# Entropy-coded bytes with an escaped 0xFF, a restart marker and a fill byte before the end.
JPEG = (b"\xff\xd8" + segment(0xE0, b"JFIF\0\xff\xd9") + segment(0xC0, bytes(9)) + segment(0xDA, bytes(6))
        + b"\x12\xff\x00\x34\xff\xd0\x56" + segment(0xDA, bytes(6)) + b"\x78\xff" + b"\xff\xd9")
GIF = b"GIF89a" + bytes(4) + bytes([0x80, 0, 0]) + bytes(6) + b"\x21\xf9\x01\x00\x00" + b"\x2c" + bytes(9) + b"\x02\x02ab\x00" + b"\x3b"
BMP = b"BM" + (30).to_bytes(4, "little") + bytes(4) + (26).to_bytes(4, "little") + bytes(16)
WHOLE = {"png": PNG, "jpeg": JPEG, "gif": GIF, "bmp": BMP}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_files_and_every_cut(name):
    data = WHOLE[name]
    assert images.fault_of(data) is None
    assert images.fault_of(data + b"trailing") is None
    for n in range(len(data)):
        assert images.fault_of(data[:n]) is not None, n


def test_every_flipped_bit_of_a_png_is_found():
    for at in range(len(PNG)):
        for bit in range(8):
            wrong = bytearray(PNG)
            wrong[at] ^= 1 << bit
            assert images.fault_of(bytes(wrong)) is not None, (at, bit)


def test_broken_structure():
    assert images.fault_of(images.PNG_START + HEAD + chunk(b"IEND", b"")) == "no pixels"
    assert images.fault_of(images.PNG_START + chunk(b"IDAT", b"") + chunk(b"IEND", b"")) == "header"
    assert images.fault_of(b"\xff\xd8" + segment(0xE0, b"JFIF") + b"\xff\xd9") == "no pixels"
    assert images.fault_of(JPEG.replace(b"\xff\xc0", b"\xfe\xc0")) == "marker"
    rng = random.Random(3)
    for start, _ in images.WALKERS:  # any bytes end the walk
        for _ in range(300):
            images.fault_of(start + rng.randbytes(rng.randrange(200)))


def test_quarantine_by_structure(spark):
    rows = [(1, PNG), (2, JPEG[:-2]), (3, b"text"), (4, b""), (5, None), (6, GIF), (7, PNG[:40] + b"\0" + PNG[41:])]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r.id: r.fault for r in df.select("id", images.image_fault("content").alias("fault")).collect()}
    assert (got[1], got[6]) == (None, None) and [got[i] for i in (2, 3, 4, 5, 7)] == [
        "cut off", "not an image", "empty", "empty", "checksum"]
    good, bad = files.quarantine_invalid(df, images.image_fault("content").isNull())
    assert sorted(r.id for r in good.collect()) == [1, 6] and bad.count() == 5
