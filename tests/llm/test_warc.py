import base64
import hashlib
import random

import pytest
from pyarrow import fs

from wirebook.llm import warc
from wirebook.sources.tables import shared_dir

PAGES = "page_id long, url string, html string, refers_to string, sha string"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pages():
    random.seed(2)
    noise = ["".join(chr(random.randint(32, 0x2FF)) for _ in range(random.randint(0, 3000))) for _ in range(60)]
    rows = [(i, f"http://h/{i}", noise[i % 60] if i % 3 else noise[0]) for i in range(200)]
    rows += [(500, None, None), (501, "http://a b\r\nX: y", ""), (502, "u", "\x1f\x8b\x08WARC/1.0\r\n\r\n" * 50), (503, "u", "é" * 200_000)]
    return rows + [(None, "n", noise[0]), (None, "n", "only"), (700, "t", "twice"), (700, "t", "twice")]


def expected(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        one = first.get(html or "")
        later = len(payload) >= least and one is not None and (i is None or i > one)
        out.append((i, len(payload), digest(payload), "revisit" if later else "response", one if later else None))
    return sorted(out, key=repr)


def test_round_trip_in_ranges(spark):
    table = spark.createDataFrame([(*r, "x", "y") for r in pages()], PAGES).repartition(3)
    for least in (0, 100):
        path = f"{shared_dir(spark)}/warc"
        warc.write_archives(table, path, min_revisit_bytes=least)
        for size in (1 << 20, 777):
            got = warc.read_archives(spark, path, split_bytes=size, payload=True).collect()
            rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
            assert sorted(rows, key=repr) == expected(pages(), least)
            text = {i: h for i, _, h in pages()}
            assert all(r.payload.decode() == (text[r.page_id] or "") for r in got if r.payload is not None and r.page_id is not None)


def test_ranges_own_what_starts_inside(tmp_path):
    random.seed(4)
    records = [warc.record(i, "u", random.randbytes(random.randint(0, 500)), None, "d") for i in range(40)]
    junk = b"\x1f\x8b\x08\x00 not a member " + b"\x1f\x8b"
    data = junk + b"".join(records[:20]) + junk + b"".join(records[20:])
    (tmp_path / "a").write_bytes(data)
    for size in (97, 5000, 1 << 20):
        seen = []
        for start in range(0, len(data), size):
            with fs.LocalFileSystem().open_input_file(str(tmp_path / "a")) as file:
                seen += [warc.parse(b)[0]["warc-record-id"] for b in warc.members(file, start, start + size)]
        assert seen == [f"<{warc.URN}{i}>" for i in range(40)]


def test_magic_across_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 64)
    random.seed(6)
    big, small = (warc.record(i, "u", random.randbytes(n), None, "d") for i, n in ((0, 5000), (1, 10)))
    (tmp_path / "a").write_bytes(big + small)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a")) as file:
        for start in range(len(big) - 300, len(big) + 1):
            found = list(warc.members(file, start, start + 400))
            assert [warc.parse(b)[0]["warc-record-id"] for b in found] == [f"<{warc.URN}1>"]


def test_lost_record_fails(spark):
    path = f"{shared_dir(spark)}/warc"
    warc.write_archives(spark.createDataFrame([(*r, "x", "y") for r in pages()], PAGES).coalesce(1), path)
    name = spark.read.parquet(f"{path}/manifest").first()["file"]
    store, at = warc._store(name)
    with store.open_input_file(at) as file:
        data = bytearray(file.read())
    second = next(i for i in range(1, len(data)) if data.startswith(warc.MAGIC, i))
    data[second] = 0
    with store.open_output_stream(at, compression=None) as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="records listed, found"):
        warc.read_archives(spark, path).collect()


def test_no_pages(spark):
    path = f"{shared_dir(spark)}/warc"
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).collect() == []
