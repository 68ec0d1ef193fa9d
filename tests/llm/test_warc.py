import html
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from wattline.llm import warc as W
from wattline.llm.queries import QUERIES


class Reader(HTMLParser):
    """A plain second reading of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.hidden, self.links = [""], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in W.BLOCKS:
            self.lines.append("")
        if tag in W.HIDDEN:
            self.hidden += 1
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if tag in W.BLOCKS:
            self.lines.append("")
        if tag in W.HIDDEN:
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data):
        if not self.hidden:
            self.lines[-1] += data


def test_pages_against_a_second_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    records = {(r["page_id"], r["warc_type"]): r for r in QUERIES["op4_warc_derivatives"](spark, sf).collect()}
    assert len(records) == 2 * len(pages)
    for p in pages:
        reader = Reader()
        reader.feed(p["html"])
        reader.close()
        text = "\n".join(x for x in (" ".join(line.split()) for line in reader.lines) if x)
        conversion, metadata = records[p["page_id"], "conversion"], records[p["page_id"], "metadata"]
        assert conversion["block"] == text
        assert metadata["block"].count("outlink: ") == len(reader.links)
        assert conversion["refers_to"] == metadata["refers_to"] and conversion["concurrent_to"] == metadata["record_id"]
        for r in (conversion, metadata):
            assert r["content_length"] == len(r["block"].encode()) and r["block_digest"] == W.digest(r["block"].encode())
            assert r["payload_digest"] == W.digest(p["html"].encode())
            assert f"WARC-Refers-To: {r['refers_to']}\r\n" in r["headers"] and f"WARC-Target-URI: {p['url']}\r\n" in r["headers"]


def test_source_fields_stay(spark):
    df = spark.createDataFrame([(1, "http://a/b", "<p>x", "<urn:uuid:1>", {"WARC-IP-Address": "1.2.3.4", "Server": "s"}, "sha1:AA")], "page_id long, url string, html string, id string, h map<string,string>, d string")
    out = W.derive(df, source_id=F.col("id"), source=F.col("h"), payload_digest=F.col("d"), date=F.lit("2026-01-01T00:00:00Z")).collect()
    assert {r["refers_to"] for r in out} == {"<urn:uuid:1>"} and {r["payload_digest"] for r in out} == {"sha1:AA"}
    assert all("WARC-IP-Address: 1.2.3.4\r\n" in r["headers"] and "WARC-Date: 2026-01-01T00:00:00Z" in r["headers"] for r in out)
    assert "source-server: s\r\n" in next(r["block"] for r in out if r["warc_type"] == "metadata")


def test_odd_rows(spark):
    odd = [None, "", "<" * 50_000, '<a "' * 20_000, "<a href='http://[x'>y", "<script>never ends", "a < b &lt; c", "<!-- open", '<p title=">">q</p>', "x" * 100_000]
    df = spark.createDataFrame([(k, None if k == 2 else "http://h/", p, "c") for k, p in enumerate(odd)] + [(0, "http://h/", None, "c")], "page_id long, url string, html string, block string")
    out = W.derive(df).collect()
    assert len(out) == 2 * (len(odd) + 1)
    text = {r["page_id"]: r["block"] for r in out if r["warc_type"] == "conversion"}
    assert text[6] == html.unescape("a < b < c") and text[8] == "q" and text[5] == "" and text[4] == "y" and len(text[9]) == 100_000
    assert W.derive(df.limit(0)).count() == 0


def test_long_attributes_are_read_once():
    for inside in ("a" * 300_000, "a " * 150_000, "a" * 100_000 + " " * 100_000, "= " * 100_000, "x='1' " * 50_000):
        begun = time.process_time()
        text, _, links = W.read_page(f"<a {inside} href='http://h/'>t</a>")
        assert time.process_time() - begun < 2 and text == "t" and links == ["http://h/"]
    assert W.read_page("<a download href=x.html hidden>t</a>")[2] == ["x.html"]
    assert W.read_page("<html lang = 'de' class><meta charset=utf-8>")[1] == {"language": "de", "charset": "utf-8"}


def test_an_unknown_date_is_left_out(spark):
    out = W.derive(spark.createDataFrame([(1, "http://a/", "<p>x")], "page_id long, url string, html string")).collect()
    assert not any("WARC-Date" in r["headers"] for r in out)
