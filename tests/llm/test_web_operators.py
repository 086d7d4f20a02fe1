import io
import struct
import zipfile

import pytest

from spanveil.llm import url_filter as uf
from spanveil.llm import warc

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
URLS = ["http://www.Example.com/en/x", "https://example.com/en/", "http://a.example.com/en", "http://x.net/es/a?b", "http://x.net/ES/", "http://xnet/es/", "http://notexample.com/en/", "ftp://com", "example.com/en/", None, "http://", "http://com?x/", "http://u@com:80/", "://net/es/#", "http://net/es//"]


def brute(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, "allow"
    rest = url[at + 3 :]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(r), r, v) for v, r in RULES if (h := r.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.mark.parametrize("most_bits", [uf.MOST_BITS, 12])
def test_judgements(spark, most_bits):
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, rule string")
    rules = RULES if most_bits > 12 else spark.createDataFrame(RULES, "verdict string, rule string")
    got = uf.judge(pages.drop("rule"), rules, ["page_id"], most_bits=most_bits).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u) for i, u in enumerate(URLS + URLS[:2])}
    assert uf.judge(pages.limit(0), RULES, ["page_id"]).count() == 0
    assert {r.verdict for r in uf.judge(pages, [], ["page_id"], default="block").collect()} == {"block"}


def test_cascade_is_exact(spark):
    wanted = spark.createDataFrame([(f"k{i}",) for i in range(0, 6000, 3)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(6000)], "key string")
    levels = uf.build(wanted, universe)
    assert len(levels) > 1
    assert uf.listed(levels, [f"k{i}" for i in range(6000)]).tolist() == [i % 3 == 0 for i in range(6000)]


def test_rule_conflicts(spark):
    with pytest.raises(ValueError):
        uf.judge(spark.createDataFrame([], "url string"), [("allow", "a/"), ("block", "a/")], [])


def test_round_trip(spark):
    rows = [(1, "http://a/1", "same"), (5, "http://a/5\r\nX: y", "same"), (3, None, "same"), (2, "u", None), (4, "u", ""), (6, "u", "é" * 5000), (6, "u", "é" * 5000), (None, "u", "same"), (-7, "u", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for least in (0, 100):
        got = warc.round_trip(pages, least_bytes=least, package_bytes=200).collect()
        assert len(got) == len(rows)
        for r in got:
            payload = next((h or "").encode() for i, _, h in rows if i == r.page_id)
            owner = max(i for i, _, h in rows if i is not None and (h or "").encode() == payload)
            revisits = r.page_id is not None and r.page_id != owner and len(payload) >= least
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), warc.digest_of(payload), *(("revisit", owner) if revisits else ("response", None)))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_zip64_directory_and_range_reads():
    raw = io.BytesIO()
    package = warc.Package()
    for i in range(3):
        package.add(i, f"http://a/{i}", b"x" * i, warc.digest_of(b"x" * i), None)
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(warc.ARCHIVE), "w", force_zip64=True) as f:
            f.write(package.data.getvalue())
        z.writestr(warc.INDEX, "".join(package.index))
        z.comment = b"PK\x05\x06 no end"[:0] + b"note"
    data = raw.getvalue()
    # give the package a ZIP64 end record and locator, and a plain one that points nowhere
    end = data.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack("<H2I", data[end + 10 : end + 20])
    wide = b"PK\x06\x06" + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, count, count, size, start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    short = b"PK\x05\x06" + struct.pack("<4H2IH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for whole in (data, data[:end] + wide + locator + short):
        read = warc.range_reader(io.BytesIO(whole))
        assert [len(r.payload) for r in warc.read_package(read, len(whole))] == [0, 1, 2]
    with pytest.raises(ValueError):
        list(warc.read_package(warc.range_reader(io.BytesIO(b"no")), 2))


def test_urls_that_begin_like_a_header_line(spark):
    rows = [(1, "!a/1", "x"), (2, "!meta 1", "y"), (3, "a\u2028!b", "z"), (4, "http://a/4", "x")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.url) for r in got) == [(1, "!a/1"), (2, "!meta%201"), (3, "a\u2028!b"), (4, "http://a/4")]
    assert warc.about_of("!meta 1.0 {}") is None and warc.about_of('!OpenWayback-CDXJ 1.0 {"a": 1}') is None and warc.about_of("") is None
