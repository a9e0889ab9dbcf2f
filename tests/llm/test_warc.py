"""Archives written, normalised and read back."""

import gzip
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskweave.llm import warc

LONG, SHORT = "<p>ü</p>" * 20, "<p>x</p>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def round_trip(spark, df, folder):
    warc.write_monolithic(df, "page_id", "url", "html", f"{folder}/whole")
    manifest = warc.normalise(spark, f"{folder}/whole", f"{folder}/members")
    index = warc.read_index(spark, f"{folder}/members")
    return manifest, index, warc.read_records(index)


ROWS = [(3, "http://a", LONG), (1, "http://b", LONG), (2, None, LONG), (4, "http://c\r\nX: y", SHORT), (5, "http://d", SHORT), (6, "e", None), (7, "f", ""),
        (8, "g", "WARC/1.1\r\n\r\n" * 50_000), (None, "h", LONG), (9, "i", "line\r\n\r\nline"), (1, "http://b", LONG), (10, "j", "漢" * 34)]


def test_round_trip(spark, tmp_path):
    manifest, index, found = round_trip(spark, pages(spark, ROWS).repartition(3), tmp_path)
    rows = found.select(warc.key_of("record_id").alias("page_id"), "record_type", warc.key_of("refers_to").alias("ref"), "payload_bytes",
                        "payload_digest", "payload", "url").collect()
    assert len(rows) == len(ROWS) == manifest.agg(F.sum("records")).first()[0] == index.count()
    html = {k: (h or "").encode() for k, _, h in ROWS}
    for r in rows:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest()
        assert (r.record_type, r.ref) == (("revisit", 1) if r.page_id in (2, 3) else ("response", None))
        assert r.payload == (None if r.record_type == "revisit" else html[r.page_id])
    assert {r.url for r in rows if r.page_id in (2, 4)} == {None, "http://c%0AX: y"}


def test_members_and_sidecars(spark, tmp_path):
    round_trip(spark, pages(spark, ROWS), tmp_path)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path, "whole").glob("*.gz")))
    members = b""
    for archive in sorted(Path(tmp_path, "members").glob("*.warc.gz")):
        data = archive.read_bytes()
        for line in Path(f"{archive}.idx").read_text().splitlines():
            entry = json.loads(line)
            record = gzip.decompress(data[entry["offset"] : entry["offset"] + entry["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and entry["record_id"].encode() in record
            members += record
    assert sorted(members) == sorted(whole) and len(members) == len(whole)


def test_hot_payload(spark, tmp_path, monkeypatch):
    """A payload that many pages share is settled by broadcast; results are as without."""
    rows = [(i, "u", LONG if i % 3 else f"{LONG}{i % 7}") for i in range(60)]
    want = sorted(map(tuple, warc.with_revisits(pages(spark, rows), "page_id", "html").collect()))
    monkeypatch.setattr("riskweave.llm.common.HOT_ROWS", 5)
    assert sorted(map(tuple, warc.with_revisits(pages(spark, rows), "page_id", "html").collect())) == want
    assert sum(r[-1] is not None for r in want) == 60 - 8


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, pages(spark, []), tmp_path)[2].count() == 0


def test_damage_is_noticed(tmp_path):
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"))
    with pytest.raises(ValueError, match="within a record"):
        warc.normalise_file(str(path), str(tmp_path / "y.warc.gz"))
    path.write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")[:-9])
    with pytest.raises(ValueError, match="within a gzip member"):
        warc.normalise_file(str(path), str(tmp_path / "y.warc.gz"))
