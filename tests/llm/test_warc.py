"""Web archives in ZIP packages: round trips, ZIP64, parts of the format, odd rows."""

import base64
import hashlib
import io
import zipfile
from collections import defaultdict

import pytest

from quillon.llm import warc
from quillon.llm.common import Scratch

PAGES = "page_id long, url string, html string"


def plain(rows, least=0):
    last = defaultdict(lambda: None)
    for page, _, html in rows:
        if page is not None:
            last[html or ""] = max(page, last[html or ""] if last[html or ""] is not None else page)
    out = []
    for page, url, html in rows:
        body = (html or "").encode()
        top = last[html or ""]
        revisit = len(body) >= least and page != top
        out.append((page, url, "revisit" if revisit else "response", len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), top if revisit else None, None if revisit else body))
    return sorted(out, key=repr)


def back(spark, rows, least=0, schema=PAGES, **options):
    scratch = Scratch(spark)
    path = f"{scratch.root}/archives"
    made = warc.write_archives(spark.createDataFrame(rows, schema).repartition(3), path, scratch, least, **options)
    got = warc.read_archives(made, path, run_bytes=3000)
    return sorted(((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got.collect()), key=repr), made


ROWS = [(k, f"http://a/{k}", "<p>" + "é\r\n\r\nWARC/1.1\r\n" * (k % 7)) for k in range(60)]
ROWS += [(100, None, None), (101, "http://a/b", ""), (102, "x", None), (200, "u", "twice"), (200, "u", "twice"), (201, "v", "big" * 200_000), (None, "n", "big" * 200_000), (None, "n", "alone"), (None, "n", "alone")]


@pytest.mark.parametrize("least", [0, 30])
def test_round_trip(spark, least):
    got, _ = back(spark, ROWS, least)
    assert got == plain(ROWS, least)


def test_several_packages_of_a_task(spark):
    got, made = back(spark, ROWS, archive_bytes=400)
    assert got == plain(ROWS) and made.count() > 6
    assert sum(r.records for r in made.collect()) == len(ROWS)


def test_empty_table_and_other_columns(spark):
    got, made = back(spark, [])
    assert got == [] and made.count() == 0
    rows = [(k, u, h, "x", "y") for k, u, h in ROWS[:9]]
    got, _ = back(spark, rows, schema=PAGES + ", sha string, body string")
    assert got == plain(ROWS[:9])


def test_a_third_of_all_pages_are_equal(spark):
    rows = [(k, "u", "same" if k % 3 == 0 else f"own {k}") for k in range(900)]
    got, _ = back(spark, rows)
    assert got == plain(rows) and sum(r[5] == 897 for r in got) == 299


def reader(data):
    return (lambda start, n: data[start : start + n]), len(data)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 and more"])
def test_directory(monkeypatch, wide, comment):
    if wide:  # as if files of 10 bytes and packages of 2 members needed ZIP64
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    members = {"first.txt": b"a" * 50, "ö/second": b"", "third": b"PK\x05\x06" * 9}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            z.writestr(name, data)
        z.comment = comment
    read, size = reader(out.getvalue())
    assert (b"PK\x06\x06" in out.getvalue()) == wide
    found = warc.directory(read, size)
    assert list(found) == list(members)
    for name, data in members.items():
        start, n = warc.stored_range(read, found[name])
        assert read(start, n) == data


def test_what_cannot_be_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    read, size = reader(out.getvalue())
    with pytest.raises(ValueError, match="compressed"):
        warc.stored_range(read, warc.directory(read, size)["a"])
    with pytest.raises(ValueError, match="no end"):
        warc.directory(*reader(b"no package" * 10))
    raw = warc.record(7, "http://a/\r\nX: y z", b"payload")
    assert b"\r\nX: y" not in raw and warc.parsed(raw)["url"] == "http://a/%0D%0AX:%20y%20z"
    with pytest.raises(ValueError, match="payload"):
        warc.parsed(raw.replace(b"payload", b"paylord"))


def test_packages_are_zip_files_of_gzip_members(spark):
    import gzip

    _, made = back(spark, ROWS[:5])
    for r in made.collect():
        with zipfile.ZipFile(r.file) as z:
            assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]
            assert gzip.decompress(z.read(warc.DATA)).count(b"WARC-Type: ") == r.records == z.read(warc.INDEX).count(b"\n")
