import pytest

from newsloom.sources import envelopes, feeds, pages, payloads, robots

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel><title>Paper</title><item><title>One</title><link>https://a.example/1</link><description>d</description><content:encoded><![CDATA[<p>c</p>]]></content:encoded>
<dc:creator>Jo Do</dc:creator><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate><guid isPermaLink="false">g1</guid><category>tech</category><enclosure url="https://a.example/i.jpg" type="image/jpeg"/></item>
<item><title>Two</title><guid>https://a.example/2</guid></item><item><title>No link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>E</title><link rel="self" href="https://a.example/s"/><link rel="alternate" href="https://a.example/e"/>
<author><name>Ann</name></author><published>2026-01-05T10:00:00Z</published><updated>2026-01-06T10:00:00Z</updated><category term="x"/></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel><title>R</title></channel><item><title>I</title><link>https://a.example/r</link></item></rdf:RDF>"""
EVIL = """<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><rss><channel><item><title>&e;</title><link>https://a.example</link></item></channel></rss>"""


def test_feeds(spark):
    df = spark.createDataFrame(list(enumerate([RSS, ATOM, RDF, EVIL, "<rss><channel>", "", None, "<html/>"])), "id long, payload string")
    parsed = {r.id: r for r in feeds.parse_feeds(df).collect()}
    assert [parsed[k].format for k in range(3)] == ["rss", "atom", "rdf"] and all(parsed[k].error for k in range(3, 8))
    rows = {(r.id, r.link): r for r in feeds.feed_items(df).collect()}
    one = rows[0, "https://a.example/1"]
    assert (one.content, one.author, one.image, one.categories, one.guid) == ("<p>c</p>", "Jo Do", "https://a.example/i.jpg", ["tech"], "g1")
    assert (0, "https://a.example/2") in rows and (1, "https://a.example/e") in rows and rows[1, "https://a.example/e"].author == "Ann" and len(rows) == 4


def test_envelopes(spark):
    bodies = ['{"status":"ok","articles":[{"title":"A","url":"u1","publishedAt":"d","source":{"name":"S"},"author":{"name":"N"}},{"title":""},{"title":"no url"}]}', '[{"headline":"B","link":"u2","id":7}]', "not json", None, '{"data":{"list":[{"title":"C","url":"u3"}]}}']
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, payload string")
    rows = {r.title: r for r in envelopes.items(df).collect()}
    assert set(rows) == {"A", "B"} and rows["A"].source_name == "S" and rows["A"].author == "N" and rows["B"].external_id == "7"
    assert [r.title for r in envelopes.items(df, envelopes.Mapping(items_path="data.list")).collect()] == ["C"]


def test_pages(spark):
    html = """<html lang="en"><head><title>T</title><meta property="og:description" content="D"><meta property="og:image" content="/i.png"><link rel="canonical" href="/c">
<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","headline":"H","author":[{"name":"Al"}]}]}</script></head><body><nav>menu</nav><h1>Heading</h1><p>One&amp;two</p><script>x()</script>
<a href="/a">a</a><a href="#x">b</a><a href="javascript:1">c</a><a href="https://b.example/d">d</a><a href="/a">again</a></body></html>"""
    df = spark.createDataFrame([(1, "https://a.example/p", html), (2, None, None), (3, "x", "<p>broken <b>tags")], "id long, url string, html string")
    rows = {r.id: r for r in pages.parse_pages(df).collect()}
    assert (rows[1].title, rows[1].author, rows[1].image_url, rows[1].canonical, rows[1].language) == ("H", "Al", "https://a.example/i.png", "https://a.example/c", "en")
    assert rows[1].links == ["https://a.example/a", "https://b.example/d"] and "menu" not in rows[1].content and "One&two" in rows[1].content and "x()" not in rows[1].content
    assert rows[2].content is None and rows[3].content == "broken tags"


@pytest.mark.parametrize(("path", "allowed"), [("/", True), ("/private", False), ("/private/open", True), ("/x.pdf", False), ("/x.pdf?a", True), ("", True)])
def test_robots(path, allowed):
    text = "User-agent: *\nDisallow: /private # no\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 999\n\nUser-agent: other\nDisallow: /"
    found = robots.parse_robots(text, "newsloom/1.0")
    assert found.allows(path) is allowed and found.delay == 300 and not robots.parse_robots(text, "other/2").allows("/a")


def test_payload_source(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.json").write_text("{}")
    payloads.register(spark)
    df = spark.read.format("payloads").option("pattern", "*.xml").load(str(tmp_path))
    assert feeds.feed_items(df).count() == 2
