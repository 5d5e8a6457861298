"""Damaged and foreign packages: what is beside the damage is read, and the damage is told."""

from __future__ import annotations

import gzip
import io
import json
import zipfile

import pytest

from panelforge.llm import warc_zip


def members(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def lines(records, filename="data.warc.gz"):
    out, at = [], 0
    for r in records:
        out.append(f"key 2000 {json.dumps({'offset': str(at), 'length': len(r), 'filename': filename})}")
        at += len(r)
    return "\n".join(out).encode()


def record(i, refers_to=None, was=None, now=None):
    data = warc_zip.record(str(i), "http://u", b"p" * i, refers_to)
    return gzip.compress(data.replace(was, now) if was else data)


def read(spark, tmp_path, *packages):
    for i, data in enumerate(packages):
        (tmp_path / f"{i}.wacz").write_bytes(data)
    rows = warc_zip.read_packages(warc_zip.packages_at(spark, f"{tmp_path}/*.wacz")).collect()
    return sorted(int(r.page_id) for r in rows if r.page_id), sorted(r.error for r in rows if r.error)


def test_a_bad_record_ends_nothing(spark, tmp_path):
    bad = [record(2, "1", b"Content-Length: 2\r", b"Content-Length: two\r"), record(2, None, b"Content-Length: ", b"Content-Length: x"), gzip.compress(b"WARC/1.1\r\nno end"), b"no gzip", record(3)[:-9], record(3, None, b"urn", b"\xff\xfe")]
    for one in bad:
        records = [record(1), one, record(3), record(4), record(5)]
        got, errors = read(spark, tmp_path, members([("archive/data.warc.gz", b"".join(records)), ("indexes/index.cdxj", lines(records))]))
        assert got == [1, 3, 4, 5] and len(errors) == 1, (one, got, errors)


@pytest.mark.parametrize("step", [7, 1 << 20])
def test_gzipped_and_columned_indexes(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(warc_zip, "STEP", step)
    records = [record(i) for i in range(1, 40)]
    data, index = b"".join(records), lines(records)
    several = b"".join(gzip.compress(x + b"\n") for x in index.split(b"\n"))
    at, cdx = 0, [" CDX N b a m s k r M S V g"]
    for r in records:
        cdx.append(f"u)/ 2000 http://u text/html 200 - - - {len(r)} {at} data.warc.gz")
        at += len(r)
    for name, body in (("index.cdx.gz", gzip.compress(index)), ("index.cdxj.gz", several), ("index.cdx", "\n".join(cdx).encode()), ("i.cdx.gz", gzip.compress("\n".join(cdx).encode())), ("index.cdxj", index + b"\n\n")):
        package = warc_zip.Package(lambda a, n, whole=members([("archive/data.warc.gz", data), (f"indexes/{name}", body)]): whole[a : a + n], len(members([("archive/data.warc.gz", data), (f"indexes/{name}", body)])))
        assert [r[0]["warc-record-id"] for r in package.records()] == [f"<urn:page:{i}>" for i in range(1, 40)], name


def test_indexes_that_are_missing_or_break_off(spark, tmp_path):
    records = [record(i) for i in range(1, 200)]
    data = b"".join(records)
    none = members([("archive/data.warc.gz", data)])
    cut = members([("archive/data.warc.gz", data), ("indexes/index.cdxj.gz", gzip.compress(lines(records))[:-200])])
    odd = members([("archive/data.warc.gz", data), ("indexes/index.cdxj", b"no json\nkey 1 {\"offset\": null, \"length\": 3}\nkey 1 [3] {}\n" + lines(records[:1]))])
    got, errors = read(spark, tmp_path, none)
    assert got == [] and errors == ["no index"]
    got, errors = read(spark, tmp_path, cut)
    assert errors and 0 < len(got) < 199
    got, errors = read(spark, tmp_path, odd)
    assert got == [1] and len(errors) == 3


def test_members_of_one_name(spark, tmp_path):
    one, two = [record(1), record(2)], [record(3), record(4)]
    files = [("archive/a/data.warc.gz", b"".join(one)), ("archive/b/data.warc.gz", b"".join(two))]
    whole = [("indexes/a.cdxj", lines(one, "a/data.warc.gz")), ("indexes/b.cdxj", lines(two, "archive/b/data.warc.gz"))]
    assert read(spark, tmp_path, members(files + whole)) == ([1, 2, 3, 4], [])
    got, errors = read(spark, tmp_path, members(files + [("indexes/a.cdxj", lines(one))]))
    assert got == [] and len(errors) == 2
