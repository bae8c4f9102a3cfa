import hashlib

from lexspan.llm.warc import capture_key, look_up, reversed_host, write_archives


def test_keys():
    assert reversed_host("http://www.Example.org/a?b=c") == "org,example,www)/a?b=c"
    assert reversed_host("https://example.org:8443") == "org,example:8443)/"
    assert reversed_host(None) == "" and reversed_host("not a url") == "not a url"
    assert reversed_host("http://[bad/") == "http://[bad/"
    assert "\t" not in capture_key("http://a.b/\t\n", 1, "x")


def test_round_trip(spark):
    big = "<p>" + "x" * 2000 + "</p>"
    rows = [(i, f"http://h{i % 7}.example.org/p{i}", f"<html>{i}" + "ü" * i) for i in range(1200)]
    rows += [(5000 + i, "http://same.example.org/", big) for i in range(9)]
    rows += [(6000, None, None), (6001, "", ""), (6002, "http://x.y/\r\nz", "a\r\n\r\nb"), (6003, "http://small.org/", "tiny"), (6004, "http://small.org/", "tiny"), (6005, "ü://é/\t", "z" * 200000), (6006, "http://[bad/", "q")]
    rows += [rows[0]]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(5)
    got = look_up(pages, *write_archives(pages), with_payload=True).collect()
    assert len(got) == len(rows)
    want = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(want[r.page_id]), hashlib.sha1(want[r.page_id]).hexdigest())
        revisit = 5000 <= r.page_id < 5008
        assert (r.record_type, r.refers_to) == (("revisit", 5008) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == want[r.page_id]


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert look_up(pages, *write_archives(pages)).count() == 0
