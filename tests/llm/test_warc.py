"""Archives read back through the two-level index, against plain grouping of payloads."""

import base64
import hashlib

import pytest

from reviewloom.llm.common import table
from reviewloom.llm.queries import page_records
from reviewloom.llm.warc import lookup, read_archives, url_key, write_archives, write_collection, write_index

SCHEMA = "page_id long, url string, html string"


def plain(rows, least=0):
    payloads = [(r[2] or "").encode() for r in rows]
    first = {}
    for r, p in zip(rows, payloads):
        if r[0] is not None:
            first[p] = min(r[0], first.get(p, r[0]))
    out = []
    for r, p in zip(rows, payloads):
        refers = first.get(p) if len(p) >= least and first.get(p) not in (None, r[0]) and payloads.count(p) > 1 else None
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((r[0], len(p), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def got(df, **settings):
    return sorted((tuple(r)[:5] for r in page_records(df, **settings).collect()), key=repr)


ROWS = [
    (5, "http://b.example.com/x?y=1", "<p>one</p>"), (3, "http://a.example.com/", "<p>one</p>"), (3, "http://a.example.com/", "<p>one</p>"),
    (9, "https://A.example.com:8080/z z", None), (8, None, ""), (None, "http://b.example.com/x?y=1", "<p>one</p>"), (None, "://bad[", "only é here"),
    (11, "http://a.example.com/line\nbreak", "x" * 400_000), (12, "http://c.org", "1\r\n\r\n2"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_equal_to_grouping(spark, least):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA + ", first string").repartition(3)
    assert got(df, least_bytes=least) == plain(ROWS, least)


def test_table_and_empty(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    assert got(pages) == plain([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert page_records(pages.limit(0)).count() == 0


def test_lookup_by_url_over_many_blocks(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 40}", f"page {i}") for i in range(300)]
    folder = str(tmp_path)
    captures = write_archives(spark.createDataFrame(rows, SCHEMA).repartition(4), folder)
    directory = sorted(tuple(r) for r in write_index(captures, folder, block_lines=6).collect())
    assert len(directory) >= 50
    for url in {r[1] for r in rows}:
        found = sorted(payload.decode() for _, payload in lookup(directory, folder, url))
        assert found == sorted(r[2] for r in rows if r[1] == url)
    assert lookup(directory, folder, "http://nowhere.example.com/") == [] and lookup([], folder, "http://a/") == []


def test_payloads_survive(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    folder, directory = write_collection(spark, df)
    back = read_archives(directory, folder, "bigint").where("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in back} == {r[2] or "" for r in ROWS}


def test_keys():
    assert url_key("http://www.Example.com/a?b=c") == "com,example,www)/a?b=c"
    assert url_key("http://x.org:81") == "org,x:81)/" and url_key(None) == "-" and " " not in url_key("http://x.org/a b")
