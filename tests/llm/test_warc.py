import gzip
import random
import zlib
from collections import Counter

from drawgraph.llm import warc

HTML = (
    '<!DOCTYPE html><html><head><title>A  &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<nav><a href="/x?a=1&amp;b=2">X</a></nav><!-- no --><p>One <b>two</b><br>three &copy;</p><script>bad()</script><p>four</p></body></html>'
)


def test_plain_text():
    assert warc.plain_text(HTML) == ("X\nOne two\nthree ©\nfour", "A & B", ["/x?a=1&b=2"])
    assert warc.plain_text("") == ("", "", []) and warc.plain_text("just < text > & more")[0].startswith("just")
    assert warc.plain_text("<p>open <b>never closed")[0] == "open never closed"


def test_derived_records_link_to_their_response_and_digests_hold(spark):
    rows = [(1, "http://a/", HTML, 5), (2, None, None, 5), (None, "http://b/\r\nX: y", "<p>é</p>", 5), (1, "http://a/", HTML, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record int")
    responses = warc.responses_from_pages(pages)
    got = warc.derive(responses).collect()
    assert Counter(r.warc_type for r in got) == {"metadata": 4, "conversion": 4}
    source = {r.key: warc.split_http(bytes(r.block))[2] for r in responses.collect()}
    for r in got:
        (headers, block), = warc.parse(bytes(r.record))
        assert headers["warc-record-id"] == r.record_id and headers["warc-refers-to"] == r.refers_to != r.record_id
        assert headers["warc-block-digest"] == warc.digest(block) == r.block_digest and int(headers["content-length"]) == len(block)
        assert r.source_digest == warc.digest(source[r.key]) and "x" not in headers
        assert {x.name: x.value for x in r.source_headers}["Content-Type"] == "text/html; charset=utf-8"
        if r.warc_type == "conversion":
            assert block.decode() == r.text == warc.plain_text(source[r.key].decode())[0]
        else:
            assert f"payloadDigest: {r.source_digest}".encode() in block and b"http-content-type: text/html" in block
    pairs = Counter((r.key, r.refers_to) for r in got)
    assert pairs[1, next(r.refers_to for r in got if r.key == 1)] == 4


def test_given_ids_dates_and_charsets_are_kept(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>caf\xe9</p>"
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", "http://c/")]
    other = warc.serialize([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:2>")], b"GET /")
    whole = warc.serialize(fields, block)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (other, whole, whole)))
    (tmp_path / "in" / "b.warc").write_bytes(whole + other + whole[:-30])
    responses = warc.read(spark, str(tmp_path / "in"))
    assert responses.count() == 3
    got = warc.derive(responses)
    assert {(r.refers_to, r.date, r.target_uri) for r in got.collect()} == {("<urn:uuid:1>", "2020-01-01T00:00:00Z", "http://c/")}
    assert {r.text for r in got.collect() if r.warc_type == "conversion"} == {"café"}
    warc.write(got, str(tmp_path / "out"))
    back = warc.read(spark, str(tmp_path / "out"), ("metadata", "conversion")).collect()
    assert sorted(bytes(r.block) for r in back) == sorted(warc_block for r in got.collect() for _, warc_block in warc.parse(bytes(r.record)))


def test_round_trip_of_random_blocks():
    rng = random.Random(4)
    blocks = [rng.randbytes(rng.randint(0, 300)) for _ in range(50)]
    data = b"".join(warc.serialize([("WARC-Type", "resource"), ("N", str(i))], b) for i, b in enumerate(blocks))
    assert [b for _, b in warc.parse(data)] == blocks == [b for _, b in warc.parse(gzip.compress(data))]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses_from_pages(pages)).collect() == []


def test_what_the_source_carries_is_kept(spark):
    """Headers in order and repeated, digests of the source, chunks and codings, types that are no text."""
    html = "<head><title>T</title></head><p>" + "word " * 40_000 + "end</p>"  # a very long page
    raw = html.encode()
    packed = gzip.compress(raw)
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(packed[i : i + 100]), packed[i : i + 100]) for i in range(0, len(packed), 100)) + b"0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n"
    cases = {
        "chunked": head + b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked,
        "deflate": head + b"Content-Encoding: deflate\r\nContent-Type: text/html\r\n\r\n" + zlib.compress(raw),
        "brotli": head + b"Content-Encoding: br\r\n\r\n" + raw,
        "broken": head + b"Content-Encoding: gzip\r\n\r\n" + raw,
        "image": head + b"Content-Type: image/png\r\n\r\n\x89PNG",
        "plain": head + b"Content-Type: text/plain\r\n\r\n<p>as it stands</p>",
        "bare": b"<p>no status line</p>",
        "null": None,
    }
    given = {"WARC-Payload-Digest": "sha1:GIVEN", "WARC-IP-Address": "10.0.0.1"}
    rows = [(k, given, None if v is None else bytearray(v), "extra") for k, v in cases.items()]
    got = warc.derive(spark.createDataFrame(rows, "key string, headers map<string,string>, block binary, text string")).collect()
    texts = {r.key: r.text for r in got if r.warc_type == "conversion"}
    long = "word " * 40_000 + "end"
    assert texts == {"chunked": long, "deflate": long, "plain": "<p>as it stands</p>", "bare": "no status line", "null": ""}
    meta = {r.key: bytes(r.record).decode() for r in got if r.warc_type == "metadata"}
    assert set(meta) == set(cases)
    assert all("warc-payload-digest: sha1:GIVEN" in m and "warc-ip-address: 10.0.0.1" in m for m in meta.values())
    assert meta["image"].count("http-set-cookie: ") == 2
    for r in got:
        assert r.warc_headers["warc-payload-digest"] == "sha1:GIVEN" and r.source_block_digest == warc.digest(cases[r.key] or b"")
        assert [x.value for x in r.source_headers if x.name == "Set-Cookie"] == ([] if r.key in ("bare", "null") else ["a=1", "b=2"])


def test_odd_markup():
    assert warc.plain_text("a<script>x<p>y") == ("a", "", []) and warc.plain_text("a<!-- b")[0] == "a"
    assert warc.plain_text('<a title="x > y" href=/z?a&amp;b>k</a> 1 < 2 <pre>m</pre><prefix>n')[:3:2] == ("k 1 < 2\nm\nn", ["/z?a&b"])
    assert warc.plain_text("<head><title>t<body><p>u")[0] in ("", "u")
    assert warc.plain_text("&lt;b&gt; &amp;amp;")[0] == "<b> &amp;"
