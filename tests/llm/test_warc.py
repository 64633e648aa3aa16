import hashlib
import time
from html.parser import HTMLParser

from quarry.llm import warc


class _Plain(HTMLParser):
    """An independent extractor to compare with."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.quiet, self.title, self.links, self.lang = [], 0, None, [], ""

    def handle_starttag(self, tag, attrs):
        if tag in warc._BLOCK:
            self.out.append("\n")
        if tag in warc._SILENT:
            self.quiet += 1
            if tag == "title" and self.title is None:
                self.title = []
        a = dict(attrs)
        if tag in ("a", "area") and a.get("href"):
            self.links.append(a["href"].strip())
        if tag == "html":
            self.lang = self.lang or a.get("lang") or ""

    def handle_endtag(self, tag):
        if tag in warc._BLOCK:
            self.out.append("\n")
        if tag in warc._SILENT:
            self.quiet = max(0, self.quiet - 1)

    def handle_data(self, data):
        if not self.quiet:
            self.out.append(data)
        elif self.lasttag == "title":
            self.title.append(data)


def test_extraction_equals_a_parser(spark, sf):
    for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect():
        p = _Plain()
        p.feed(r["html"])
        p.close()
        lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
        text, title, lang, links = warc.extract(r["html"])
        assert text == "\n".join(x for x in lines if x)
        assert title == " ".join("".join(p.title or []).split()) and lang == p.lang and links == p.links


def test_records_read_back_and_link(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r["record_id"]: r for r in warc.responses(pages).collect()}
    rows = warc.derivatives(warc.responses(pages), ("page_id",)).collect()
    assert len(rows) == 2 * len(source) == 2 * pages.count()
    whole = b"".join(bytes(r["record"]) for r in rows)
    parsed = list(warc.parse(whole))
    assert len(parsed) == len(rows) and len({f["WARC-Record-ID"] for f, _ in parsed}) == len(rows)
    by_id = {f["WARC-Record-ID"]: (f, b) for f, b in parsed}
    for r in rows:
        f, block = by_id[r["record_id"]]
        s = source[f["WARC-Refers-To"]]
        assert f["WARC-Type"] == r["warc_type"] and f["WARC-Target-URI"] == s["target_uri"] and f["WARC-Refers-To-Date"] == s["date"]
        assert f["Source-Payload-Digest"] == "sha1:" + hashlib.sha1(bytes(s["payload"])).hexdigest()
        assert f["WARC-Block-Digest"] == "sha1:" + hashlib.sha1(block).hexdigest() and block.decode() == r["block"]
        if r["warc_type"] == "metadata":
            assert by_id[f["WARC-Concurrent-To"]][0]["WARC-Type"] == "conversion"
            assert b"sourceHeader: Content-Type: text/html; charset=utf-8\r\n" in block


def test_edges(spark):
    rows = [(1, None, None, "x"), (2, "http://a", "", "x"), (2, "http://a", "", "x"), (None, "u", "<p>a &amp; b<script>if (a<b) '</p>'</script>c<p>d<!-- x <p> -->", "x"), (4, "v", "plain < text &eacute;", "x"), (5, "w", "<title>t" + "y" * 200_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    got = warc.derivatives(warc.responses(pages), ("page_id",)).where("warc_type = 'conversion'").collect()
    assert sorted((r["page_id"] or 0, r["block"]) for r in got) == [(0, "a & bc\nd"), (1, ""), (2, ""), (2, ""), (4, "plain < text é"), (5, "")]
    assert warc.page_derivatives(pages.limit(0)).count() == 0
    bare = spark.createDataFrame([(None, None, None, None, bytearray(b"<p>\xe9"), None, None)], "record_id string, date string, target_uri string, http string, payload binary, payload_digest string, block_digest string")
    (a, b) = warc.derivatives(bare).collect()
    assert a["refers_to"] == b["refers_to"] and b["block"] == "�" and "None" not in bytes(b["record"]).decode()


def test_hostile_pages_take_linear_time():
    for part in ("<a ", "<a '>' ", '<a "', "<!x ", "<script", "<a href='x", "a=", "<a b "):
        began = time.perf_counter()
        warc.extract(part * (1_000_000 // len(part)))
        warc.extract("<a " + part.strip("<") * (1_000_000 // len(part)) + ">")
        assert time.perf_counter() - began < 5, part  # quadratic work takes over an hour
    assert warc.extract("<p>x <a href='y' z <b") [0] == "x <a href='y' z <b"
    assert warc.extract("<p title=it's>x</p>")[0] == "x"
