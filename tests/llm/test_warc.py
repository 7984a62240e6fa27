"""Archives: records against plain decisions, gzip members, merging and order, edge cases."""

import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import warc
from tallyforge.llm.common import new_path
from tallyforge.llm.warc import LoserTree, merge_index, op4_warc, parse, read, record, url_key, write


def expected(pages):
    groups = defaultdict(list)
    for i, h in pages:
        groups[h or ""].append(i)
    out = []
    for i, h in pages:
        b = (h or "").encode()
        known = [x for x in groups[h or ""] if x is not None]
        last = max(known) if known and len(groups[h or ""]) > 1 and len(b) >= 1000 else None
        again = last is not None and i != last
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def test_query(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, op4_warc(spark, sf).collect()), key=str) == expected(pages)


def test_odd_pages_and_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 3)  # several passes
    monkeypatch.setattr(warc, "RANGE", 10)
    r = random.Random(1)
    big = "ä" * 600
    pages = [(k, r.choice(["http://a.com/x", "https://www.B.com:8080/q?z=1", "http://a.com/é y", None, "http://[bad", "http://c.d.org/\r\nX: y"]), r.choice([None, "", "small", big, big + "!", "\r\n\r\nWARC/1.1\r\n" * 90])) for k in range(80)]
    pages += [(None, None, big), (None, "http://a.com/x", "only one" * 200), pages[7], pages[7]]
    rows = [(*p, 1_600_000_000 + (p[0] or 0) % 9, "clash") for p in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, captured long, sha1 string").repartition(11)
    df = df.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), "captured")
    folder = new_path(spark, "archives")
    runs = write(df, folder)
    index = merge_index(runs)
    rows = read(index, folder).collect()
    assert sorted((tuple(x)[2:] for x in rows), key=str) == expected([(p[0], p[2]) for p in pages])
    listed = {(x.part, x.n): x.page_id for x in index.collect()}
    assert {(x.part, x.n): x.page_id for x in rows} == listed
    order: dict = {}
    for x in rows:  # each range comes whole and in order
        assert order.get(x.part, -1) + 1 == x.n
        order[x.part] = x.n
    assert len(order) > 1
    with pytest.raises(Exception, match="out of order"):
        read(index.withColumn("n", -F.col("n")), folder).collect()
    keys = [warc._key((x.url_key, x.captured, x.archive, x.place)) for x in index.orderBy("part", "n").collect()]
    assert keys == sorted(keys) and len(keys) == len(pages) == len(set(keys)) and index.select("part").distinct().count() > 1
    empty = write(df.filter("page_id = -5"), new_path(spark, "archives"))
    assert read(merge_index(empty), folder).count() == 0


def test_archives_are_plain_gzip(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.com/", "x" * 2000, 5), (2, "http://a.com/", "x" * 2000, 6)], "page_id long, url string, payload string, captured long").coalesce(1)
    write(df, "file://" + str(tmp_path)).count()
    (f,) = tmp_path.glob("*.warc.gz")
    text = gzip.decompress(f.read_bytes()).decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.count("x" * 2000) == 1 and "WARC-Refers-To: <urn:page:2>" in text


def test_records():
    fields, block = parse(record(5, "http://a/\nb", b"pay", hashlib.sha1(b"pay").hexdigest(), 0, None))
    assert fields["warc-target-uri"] == "http://a/%0Ab" and block.endswith(b"\r\n\r\npay") and fields["warc-date"] == "1970-01-01T00:00:00Z"


def test_url_keys():
    assert url_key("https://www.Example.com/A/b?c=D#frag") == "com,example)/a/b?c=d"
    assert url_key("http://x.org:8080") == "org,x:8080)/" and url_key(None) == "" and url_key("http://[") == "http://["


def test_loser_tree():
    r = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(30))) for _ in range(k)]
        assert list(LoserTree([iter(x) for x in runs], lambda x: x)) == sorted(y for x in runs for y in x)
