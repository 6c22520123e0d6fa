import hashlib
import io
import struct
import zipfile

import pytest
from helpers import rows

from basketry.llm import warc_zip


@pytest.mark.parametrize("wide", [False, True])
def test_directory_of_own_and_foreign_archives(tmp_path, wide):
    out = io.BytesIO()
    archive = warc_zip.ZipWriter(out, force64=wide)
    archive.member("a/é.txt", [b"hello ", b"world"])
    archive.member("b", [b""])
    archive.close()
    path = tmp_path / "own.zip"
    path.write_bytes(out.getvalue())
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.read("a/é.txt") == b"hello world"
    with warc_zip.Ranged(f"file://{path}") as file:
        found = warc_zip.members(file)
        assert file.read(*found["a/é.txt"]) == b"hello world" and found["b"][1] == 0
    # A comment that holds the end signature, and a member that is not stored.
    other = tmp_path / "other.zip"
    with zipfile.ZipFile(other, "w") as z:
        z.writestr(zipfile.ZipInfo("kept"), b"x" * 50)
        z.writestr("packed", b"y" * 5000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06" + bytes(30)
    with warc_zip.Ranged(f"file://{other}") as file:
        found = warc_zip.members(file)
        assert list(found) == ["kept"] and file.read(*found["kept"]) == b"x" * 50


def test_damaged_archives_are_errors(tmp_path):
    path = tmp_path / "bad.zip"
    path.write_bytes(b"no archive at all, only text")
    with warc_zip.Ranged(f"file://{path}") as file, pytest.raises(ValueError, match="central directory"):
        warc_zip.members(file)
    path.write_bytes(struct.pack("<4sHHHHIIH", warc_zip.END, 0, 0, 1, 1, 46, 0, 0) + bytes(0))
    with warc_zip.Ranged(f"file://{path}") as file, pytest.raises(ValueError):
        warc_zip.members(file)


def test_round_trip(spark, tmp_path, monkeypatch):
    long, short = "long payload é " * 20, "short"
    table = [(9, "u", long), (4, "v", long), (6, None, long), (1, "w\n\"q", short), (2, "w", short), (3, "x", None),
             (5, "", ""), (None, "n", "only null " * 20), (None, "n", long), (4, "again", long), (7, "é", "\r\n\r\nWARC/1.1" * 40)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as digest")
    monkeypatch.setattr(warc_zip, "ARCHIVE", 500)
    monkeypatch.setattr(warc_zip, "RANGE", 300)
    archives = warc_zip.write(pages, str(tmp_path / "out"), rows_per_task=4)
    assert archives.count() > 2
    read = warc_zip.read(archives)
    want = []
    for i, _, html in table:
        raw = (html or "").encode()
        again = html == long and i != 4
        kind = "revisit" if again else "response"
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), kind, 4 if again else None))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(read, *columns) == sorted(want, key=repr)
    payloads = rows(warc_zip.resolved(read), "page_id", "payload")
    assert payloads == sorted(((i, bytearray((h or "").encode())) for i, _, h in table), key=repr)
    assert {r.url for r in read.where("page_id = 1").collect()} == {'w\n"q'}
    assert warc_zip.report(pages.limit(0)).count() == 0
