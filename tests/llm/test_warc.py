import base64
import hashlib

from finquarry.llm.common import new_path
from finquarry.llm.warc import MAGIC, read_warc, warc_query, write_warc


def digest(s):
    return base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()


def test_magic_in_payloads_revisits_and_many_splits(spark):
    fake = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, f"http://x/{i}", f"<p>é{i}</p>" * (1 + i % 50)) for i in range(300)]
    rows += [(1000, None, fake + fake), (1001, "a\r\nb", "x" + fake * 200), (1002, "u", fake * 200 + "y\r\n\r\n"), (1003, "u", MAGIC), (1004, "u", "a" + MAGIC + "b" + MAGIC)]
    rows += [(2000 + i, "u", "<p>é7</p>" * 8) for i in range(5)] + [(3000, "u", None), (3001, "u", ""), (None, "u", "none"), (50_000, "u", "\r\n\r\n" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = new_path(spark, "warc-test")
    write_warc(pages, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {r.page_id: r for r in read_warc(spark, path).collect()}
        assert read_warc(spark, path).count() == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for i, _, h in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        r, h = got[i], h or ""
        assert (r.payload_bytes, r.payload_digest, r.stated_digest) == (len(h.encode()), digest(h), digest(h)), i
        again = i is not None and first[h] != i
        assert r.record_type == ("revisit" if again else "response") and r.refers_to == (first[h] if again else None)
    assert 999 not in got and all(r.intact is (None if r.record_type == "revisit" else True) for r in got.values())


def test_damaged_and_cut_archives(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} text " * 20) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "warc-cut")
    write_warc(pages, path)
    whole = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    cut = new_path(spark, "warc-cut")
    spark.createDataFrame([(whole.replace("page 2", "Page 2", 1)[:-60],)], "value string").coalesce(1).write.option("lineSep", "\n").text(cut)
    got = {r.page_id: r for r in read_warc(spark, cut).collect()}
    assert len(got) == 6 and [got[i].intact for i in range(5)] == [True, True, False, True, True] and got[5].payload_bytes is None and got[5].intact is None


def test_empty_table_repeated_rows_and_extra_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_query(none).count() == 0
    twice = spark.createDataFrame([(1, "u", "a", "x"), (1, "u", "a", "x")], "page_id long, url string, html string, digest string")
    assert [r.record_type for r in warc_query(twice).collect()] == ["response"] * 2


def test_one_payload_of_most_pages_is_dealt_out(spark, monkeypatch):
    from finquarry.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)  # as if the payloads that recur were many
    rows = [(k, f"u{k}", "" if k % 3 else f"<p>{k % 7}</p>", 0) for k in range(400)] + [(None, "n", "", 0), (1, "again", "", 0)]
    got = {r.page_id: r for r in warc_query(spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(5)).collect() if r.page_id is not None}
    assert got[1].record_type == "response" and all(got[k].refers_to == 1 for k in got if k > 1 and k % 3)
    assert sum(r.record_type == "response" for r in got.values()) == 1 + 7
