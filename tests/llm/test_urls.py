"""Links of pages against the standard library's HTML parser."""

import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from fluxmode.llm import queries, urls

BAD = "http://s.com/de/7"
FORMS = [
    f'<link rel="alternate canonical" href="{BAD}">',
    f'<link title="a > b" rel="canonical" href="{BAD}">',
    f'<link rel=canonical title="x>y" href=\'{BAD}\'>',
    f'<base href="http://s.com/de/"><link rel="canonical" href="9">',
    f'<link data-href="http://other.net/" rel="canonical" href="{BAD}">',
    f'<link title=it\'s rel=canonical href={BAD}>',
    f'<LINK\nREL = "Canonical"\nHREF = "{BAD}"/>',
    f'<meta http-equiv="refresh" content="0; url=\'{BAD}\'">',
    f'<meta content="5;URL={BAD}" http-equiv=Refresh>',
    f'<meta http-equiv="refresh" content="0;{BAD}">',
    f'<title>a</title><!-- x --><link href="{BAD}" rel="canonical">',
    f'<a title=\'<link rel=icon>\'></a><link rel=canonical href="{BAD}">',
]
NONE = [
    f'<!-- <link rel="canonical" href="{BAD}"> -->',
    f'<script>var s = \'<link rel="canonical" href="{BAD}">\';</script>',
    f'<SCRIPT type="a>b"> <link rel=canonical href={BAD}> </SCRIPT >',
    f'<style><link rel=canonical href={BAD}></style>',
    f'<p title=\'<link rel="canonical" href="{BAD}">\'>canonical</p>',
    f'<link rel="canonical-not" href="{BAD}">',
    f'<link xrel="canonical" href="{BAD}">',
    f'<link rel="canonical" data-href="{BAD}">',
    f'<linker rel="canonical" href="{BAD}">',
    f'<meta http-equiv="refresh" content="5">',
    f'<link rel="canonical" href="{BAD}',
]


class Reader(HTMLParser):
    """What the parser finds, by its own reading of tags."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found, self.base = [], None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, (v or "").strip())
        if tag == "base" and self.base is None and "href" in first:
            self.base = first["href"]
        if tag == "link" and "canonical" in first.get("rel", "").lower().split() and first.get("href"):
            self.found.append(first["href"])
        if tag == "meta" and first.get("http-equiv", "").lower() == "refresh":
            m = re.match(r"""(?is)\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?["']?([^"']+)""", first.get("content", ""))
            if m:
                self.found.append(m[1].strip())


def parsed(url, html):
    r = Reader()
    r.feed(html)
    against = urljoin(url, r.base) if r.base else url
    return sorted({urljoin(against, t).split("#")[0] for t in r.found})


def test_each_form(spark):
    data = [(i, f"http://page.net/{i}/", h) for i, h in enumerate(FORMS + NONE)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got == {i: "block" if i < len(FORMS) else "allow" for i in range(len(data))}


def test_pages_equal_parser(spark):
    r = random.Random(7)
    noise = ["<p class='a'>text > more</p>", "<br/>", "<!-- -- > -->", "<!---->", "<script>if (a < b) { x = '<p>'; }</script>", "<div title=\"<!-- \">", "canonical http-equiv", "<img alt='=\">'>", "a < b", "<textarea></textarea>"]
    links = FORMS + NONE[:-1] + ["<link rel=canonical href=../up/x.html>", "<link rel=canonical href='?q=1&r=2'>", "<link rel='canonical' href='//h.net/p'>", "<base href='/root/'>", "<link href=one.html rel=canonical rel=icon href=two.html>"]
    data = [(i, f"http://page.net/dir/{i}.html", "".join(r.choice(links if r.random() < 0.5 else noise) for _ in range(r.randrange(9)))) for i in range(600)]
    made = urls.links(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    got = {}
    for x in made:
        got.setdefault(x["url"], set()).add(x["target"].split("#")[0])
    want = {u: set(parsed(u, h)) - {u} for _, u, h in data}
    assert got == {u: t for u, t in want.items() if t}
    told = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", data)
    by_sql = con.execute(queries.ORACLES["op6_url_filter"])
    at = [c[0] for c in by_sql.description]
    assert {r[at.index("page_id")]: r[at.index("verdict")] for r in by_sql.fetchall()} == told and {"allow", "block"} == set(told.values())


def test_megabyte_pages(spark):
    link = f'<link rel=canonical href="{BAD}">'
    data = [(1, "http://a.net/1", "<link " * 200_000 + link), (2, "http://a.net/2", "<" * 1_000_000 + link), (3, "http://a.net/3", "<!--" * 300_000 + link), (4, "http://a.net/4", f"<p x={'y' * 2_000_000}>{link}"), (5, "http://a.net/5", "<p a='1' " + "b='2>' " * 200_000 + ">" + link), (6, "http://a.net/6", "<script " * 100_000 + link), (7, "http://a.net/7", "canonical=\"" * 200_000)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow"}
