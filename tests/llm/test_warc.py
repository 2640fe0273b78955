"""op11: packages written and read back, against hashlib, zipfile and gzip."""

import base64
import gzip
import hashlib
import io
import json
import os
import zipfile

import pytest

from postlens.llm import warc
from postlens.llm.common import read

SF = "/root/testdata/sf0.001"
COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute(rows, least=0):
    """Expected result rows of (page_id, html)."""
    groups = {}
    for page_id, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for page_id, html in rows:
        payload = (html or "").encode()
        ids = [i for i in groups[payload] if i is not None]
        response = max(ids) if ids and len(payload) >= least else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        role = ("response", None) if response is None or page_id == response else ("revisit", response)
        out.append((page_id, len(payload), digest, *role))
    return sorted(out, key=str)


def got(df):
    assert df.where("NOT intact").count() == 0
    return sorted([tuple(r) for r in df.select(*COLS).collect()], key=str)


ROWS = [(1, "<html>a</html>"), (2, "<html>a</html>"), (3, "<html>a</html>"), (4, None), (5, ""), (6, "é" * 40_000),
        (7, "one"), (7, "one"), (8, "one"), (8, "one"), (None, "one"), (None, "alone"), (None, "alone"),
        (9, "WARC/1.1\r\n\r\nWARC-Type: revisit\r\n\r\n"), (10, "<html>" + "x y " * 300_000), (-4, "neg"), (-9, "neg")]


def frame(spark):
    rows = [(i, None if k % 5 == 0 else f"http://h{k}.example.org/päth {k}?q=a\r\nb", h, "clash", 7, "p") for k, (i, h) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string, size int, path string")


@pytest.mark.parametrize("least,member_bytes,package_bytes", [(0, 1 << 26, 1 << 28), (4, 1, 1), (0, 700, 3000)])
def test_round_trip(spark, tmp_dir, least, member_bytes, package_bytes):
    packages = warc.write_packages(frame(spark), f"file://{tmp_dir}/a", least, member_bytes=member_bytes, package_bytes=package_bytes)
    records = warc.read_packages(packages)
    assert got(records) == brute(ROWS, least)
    assert packages.groupBy().sum("n_records").first()[0] == len(ROWS)
    payloads = sorted((r.page_id, bytes(r.payload)) for r in records.where("record_type = 'response' AND page_id IS NOT NULL").collect())
    assert payloads == sorted((i, (dict((a, b) for a, b in ROWS)[i] or "").encode())
                              for i, _, _, kind, _ in brute(ROWS, least) if kind == "response" and i is not None)


def test_packages_are_zip_and_gzip_files(spark, tmp_dir):
    packages = warc.write_packages(frame(spark), tmp_dir).collect()
    n = 0
    for p in packages:
        assert os.path.getsize(p.path.removeprefix("file://")) == p.bytes
        with zipfile.ZipFile(p.path) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            lines = z.read("indexes/index.cdxj").decode().splitlines()
            assert lines == sorted(lines)
            for line in lines:
                entry = json.loads(line.split(" ", 2)[2])
                data = z.read("archive/" + entry["filename"])[int(entry["offset"]):][:int(entry["length"])]
                text = gzip.decompress(data)
                assert text.startswith(b"WARC/1.1\r\n") and entry["digest"].encode() in text
                assert b"\r\nb" not in text.split(b"\r\n\r\n")[0]
                n += 1
    assert n == len(ROWS)


def record(k, payload):
    return warc.warc_record(k, f"http://x/{k}", payload, warc.bare_digest(payload), True, None, "", "2020-01-01T00:00:00Z")


def package(n=30, index=True, packed=True, comment=b"", before=b"", method=zipfile.ZIP_STORED, name="archive/a.warc"):
    """A package written by other means than the library's."""
    body, lines = b"", []
    for k in range(n):
        r = record(k, b"p" * k * 50)
        r = gzip.compress(r) if packed else r
        lines.append(f"key{k} 2020 " + json.dumps({"filename": "a.warc", "offset": len(body), "length": len(r)}))
        body += r
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("other/näme.txt", "nothing")
        z.writestr(name, body)
        if index:
            z.writestr("indexes/index.cdxj", "\n".join(lines))
        z.comment = comment
    return before + out.getvalue()


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("how", [{}, {"index": False}, {"packed": False}, {"index": False, "packed": False},
                                 {"comment": b"PK\5\6 not the end"}, {"before": b"#!stub\n" * 9}])
def test_foreign_packages(spark, tmp_dir, monkeypatch, wide, how):
    if wide:  # numbers over 50 go to ZIP64 fields
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    data = package(**how)
    assert (b"PK\6\6" in data) == wide
    path = f"{tmp_dir}/p.zip"
    open(path, "wb").write(data)
    records = warc.read_packages(spark.createDataFrame([(path,), (None,)], "path string"))
    assert got(records) == brute([(k, "p" * k * 50) for k in range(30)])
    assert len({(r.member, r.start) for r in records.select("member", "start").collect()}) == 30


def test_large_directory(tmp_dir):
    """More members than the plain end record can count."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(66_000):
            z.writestr(f"archive/m{k}.warc", b"")
    path = f"{tmp_dir}/many.zip"
    open(path, "wb").write(out.getvalue())
    with warc.opened(path) as file:
        directory = warc.Directory(file, file.size())
        assert directory.n == 66_000 and [m[0] for m in directory][-1] == "archive/m65999.warc"
        assert sum(1 for _ in warc.ranges_in(file, file.size())) == 66_000


def test_what_cannot_be_read(tmp_dir):
    for name, data in (("a", b"no package"), ("b", package(method=zipfile.ZIP_DEFLATED)), ("c", b"")):
        open(f"{tmp_dir}/{name}", "wb").write(data)
        with warc.opened(f"{tmp_dir}/{name}") as file, pytest.raises(ValueError):
            list(warc.ranges_in(file, file.size()))


def test_damage_is_seen(spark, tmp_dir):
    data = bytearray(package(packed=False))
    at = data.find(b"ppppp")
    data[at] = ord("q")
    open(f"{tmp_dir}/p.zip", "wb").write(data)
    records = warc.read_packages(spark.createDataFrame([(f"{tmp_dir}/p.zip",)], "path string"))
    assert records.where("NOT intact").count() == 1


def test_query(spark, tmp_dir):
    rows = [(r.page_id, r.html) for r in read(spark, SF, "pages").collect()]
    assert got(warc.op11_warc(spark, SF)) == brute(rows)
    frame(spark).write.parquet(f"{tmp_dir}/pages.parquet")
    assert got(warc.op11_warc(spark, tmp_dir)) == brute(ROWS)


def test_nothing(spark, tmp_dir):
    packages = warc.write_packages(frame(spark).limit(0), tmp_dir)
    assert packages.count() == 0 and warc.read_packages(packages).count() == 0
