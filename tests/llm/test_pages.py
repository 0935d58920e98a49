"""Pages whose tags are written in odd ways, against the standard library's parser."""

from html.parser import HTMLParser

import pytest

from cuewise.llm import warc


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := next((v for k, v in attrs if k == "href" and v is not None), None)):
            self.found.append(href.strip())


LINKED = [
    '<a data-href="/no" href="/yes">x</a>', "<a class=b href='/u?a=1&amp;b=2' title='>'>x</a>", '<a title="a > b" href="/x">y</a>', '<a href="/a b">z</a>', "<a href=/bare>1</a><A HREF = '/upper' >2</A>",
    '<a href>none</a><a href="">empty</a><a name=x>no</a>', '<a x=1 href="/first" href="/second">', "<a title=don't href=/u>", '<a class="x"href="/near">', "<abbr href='/no'>", '<a\nhref="/line"\n>', "<a / href=/slash>",
    '<!-- <a href="/no"> --><a href="/c">', '<a xhref="/n" hrefx="/n" data-href=/n>', '<a href=" /blank ">', "<a href='/it\"s'>q</a>", '<a title="one\ntwo" href="/two-lines">',
]


def bodies(spark, pages):
    rows = warc.derivatives(warc.responses(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html"))).collect()
    return {(r.page_id, r.warc_type): r.body for r in rows}


def test_links_are_those_of_a_parser(spark):
    got = bodies(spark, LINKED)
    for k, page in enumerate(LINKED):
        parser = Links()
        parser.feed(page)
        assert [line.removeprefix("outlink: ") for line in got[k, "metadata"].split("\r\n") if line.startswith("outlink: ")] == parser.found, page


@pytest.fixture(scope="module")
def shown(spark):
    pages = {
        "<p>one</p><svg width=3/><p>two</p>": "one\ntwo", "<p>one</p><svg width='3' /><p>two</p>": "one\ntwo", "<p>one</p><svg><text>no</text></svg><p>two</p>": "one\ntwo",
        "<p>one</p><svg><path d='M'><p>two</p>": "one\ntwo", "one<svg><text>no": "one", '<p title="a > b">one</p>': "one", "<p title='<b>'>one</p>": "one", '<a title=">" href="/x">go</a> on': "go on",
        "<p class=don't>one</p><p>it's two</p>": "one\nit's two", '<p title="never closed>one</p>': "one", "<script>if (a < b) '</p>'</script>one": "one", "<script src='x'/>hidden": "", "a < b and b > c": "a < b and b > c",
        "<svg><desc>a</desc></svg>x<svg/>y": "xy", '<img alt="x > y">one': "one", "<p\n>one</p\n>": "one",
    }
    got = bodies(spark, list(pages))
    return {page: (got[k, "conversion"], want) for k, (page, want) in enumerate(pages.items())}


def test_shown_text(shown):
    assert {page: got for page, (got, _) in shown.items()} == {page: want for page, (_, want) in shown.items()}


def test_language_is_that_attribute(spark):
    got = bodies(spark, ['<html data-lang="x" lang="de-AT">', "<html xml:lang=no lang=fr>", "<html lang='en' >", "<html><p lang=no>", "<htmlx lang=no>"])
    assert [got[k, "metadata"] for k in range(5)] == ["language: de-AT\r\n", "language: fr\r\n", "language: en\r\n", "", ""]


@pytest.mark.parametrize("piece", ["<svg ", "<svg>", "<svg/>", '<a x="', "<a x='\"", "<a href=", '<a href="', "<p =", "<a a a a ", "<a " + '" ' * 50, "<html lang", "='", "<svg><"])
def test_broken_pages_are_read_in_linear_time(spark, piece):
    """Half a million characters of one broken piece."""
    page = piece * (500_000 // len(piece))
    assert len(bodies(spark, [page, page + ">"])) == 4
