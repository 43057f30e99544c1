import base64
import gzip
import hashlib
import io
import os

import pytest

from lodequery.llm import warc

PAGES = [
    (1, "http://a/\r\nX: y", "<p>same</p>", "x"), (2, "http://b", "<p>same</p>", "x"), (3, None, None, "x"), (4, "u", "", "x"), (5, "u", "é𝄞" * 100_000, "x"),
    (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n", "x"), (2, "http://b", "<p>same</p>", "x"), (None, "n", "only here", "x"), (None, "n", "<p>same</p>", "x"), (1, "http://a", "<p>same</p>", "x"),
]
NAMES = "page_id long, url string, html string, record_type string"


def plain(pages):
    firsts = {}
    for p, _, h, _ in pages:
        if p is not None:
            firsts[h or ""] = min(firsts.get(h or "", p), p)
    for p, _, h, _ in pages:
        data, first = (h or "").encode(), firsts.get(h or "")
        again = first is not None and p != first
        yield p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, NAMES)
    assert order(warc.round_trip(spark, pages, str(tmp_path / "w")).collect()) == order(plain(PAGES))
    files = os.listdir(tmp_path / "w")
    assert files and all(f.endswith(".warc.gz") or f.startswith("..") for f in files)


def test_archives_are_plain_gzip_and_roll_over(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"page {i}", "") for i in range(50)], NAMES).coalesce(1)
    done = warc.write_archives(pages, str(tmp_path)).collect()
    assert sum(r.records for r in done) == 50
    text = gzip.open(done[0].path.removeprefix("file://")).read()
    assert text.count(b"WARC/1.1\r\n") == done[0].records and b"page 0" in b"".join(gzip.open(r.path.removeprefix("file://")).read() for r in done)
    assert warc.read_archives(warc.write_archives(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_damage_is_noticed():
    good = warc.record(1, "u", b"payload", None) + warc.record(2, "u", b"payload", 1)
    assert [h["warc-type"] for h, _ in warc.records(io.BytesIO(good))] == ["response", "revisit"]
    for bad in (good[:-3], gzip.compress(gzip.decompress(warc.record(1, "u", b"payload", None)).replace(b"payload", b"pAyload")), gzip.compress(b"nothing\r\n\r\n")):
        with pytest.raises(warc.BadArchive):
            list(warc.records(io.BytesIO(bad)))
