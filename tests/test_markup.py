"""Parsed documents: each case against what it should give, and a table against its documents one by one."""

import pytest

from loomgraph.operators import links as D
from loomgraph.operators import markup as M

CASES = [
    ("", None, "", [], []),
    ("\ufeff---\ntitle: 'It''s'  # note\ndescription: \"a \\\"b\\\"\"\ntags: [x]\n---\n# Other\n\ntext", "It's", 'a "b"', [(1, "Other")], []),
    ("---\r\ntitle: null\r\n...\r\nTitle `x`\r\n===\r\nbody\r\nmore", "Title x", "body more", [(1, "Title x")], []),
    ("---\ntitle: a", None, None, [], []),
    ("---\na: 1\na: 2\n---\n[x](y)", None, None, [], []),
    ("--- \ntitle: a\n---\n", None, "", [(2, "title: a")], []),
    ("## A ##\n[a](b) [c](<d e> 'T') ![i](j) [![k](l)](m) [n](o(p)q \"r\")", None, "a c i k n", [(2, "A")], [("b", "a", "inline"), ("d e", "c", "inline"), ("m", "k", "inline"), ("o(p)q", "n", "inline")]),
    ("[One][x] [x][] [X] [y] [z]: no\n\n[x]: /1 'T'\n[X]: /2\n[ y ]: <3 4>", None, "One x X y [z]: no", [], [("/1", "One", "reference"), ("/1", "x", "reference"), ("/1", "X", "reference"), ("3 4", "y", "reference")]),
    ("```md\n[a](b)\n``\n[c](d)\n```\n`[e](f)` ``[g`](h)`` \\[i](j) <kk:l> <!-- [m](n) --> <b title='[o](p)'>[[q|r]]</b> [[s]]\n~~~\n[t](u)", None, "[e](f) [g`](h) [i](j) kk:l r s", [], [("kk:l", "kk:l", "autolink"), ("q", "r", "wiki"), ("s", "s", "wiki")]),
    ("<div>\n[a](b)\n</div>\n\n    [c](d)\n\n- [e](f)\n- > [g](h)\n1. i [j\nk](l)\n\n***\n", None, "e", [], [("f", "e", "inline"), ("h", "g", "inline"), ("l", "j k", "inline")]),
    ("| a | [b](c) |\n|---|---|\n| d | e |\n\nprose", None, "prose", [], [("c", "b", "inline")]),
    ("[a [b](c) d](e) [f](g", None, "[a b d](e) [f](g", [], [("c", "b", "inline")]),
    ("`a [b](c) ``", None, "`a b ``", [], [("c", "b", "inline")]),
]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_markdown(case):
    text, title, summary, headings, links = case
    got = M.markdown(text)
    assert (got["title"], got["summary"], got["headings"], got["links"]) == (title, summary, headings, links)
    assert (got["error"] is not None) == (summary is None)


def test_html():
    got = M.html("""<html><head><title>A &amp;
 B</title><base href="/x/"><meta name=description content=" d "><script>var t='<a href="no">';</script><style>a{}</style></head>
 <body><!-- <a href="no2">x</a> --><h1>H <i>1</i></h1><a href=" one ">O<b>n</b>e</a><a name=z>not</a><a href='two' href='three'>Two<a href="">Three</a><p>first""")
    assert (got["title"], got["summary"], got["base"], got["headings"]) == ("A & B", "d", "/x/", [(1, "H 1")])
    assert got["links"] == [("one", "One", "html"), ("two", "Two", "html"), ("", "Three", "html")]


def test_paragraphs_end_with_their_block():
    assert M.html("<div><p>a <b>b</b><div>c</div></div>d")["summary"] == "a b"
    assert M.html("<article><p>a</article>b<p>c")["summary"] == "a"


def test_long_documents_take_time_in_proportion():
    for text in ("[" * 100_000, "`" + "a` ``" * 50_000, "[a](b" * 50_000, "<" * 100_000, "<!--" * 50_000, "![" * 50_000 + "]" * 50_000, "[a](b) " * 50_000, "x " * 500_000):
        M.markdown(text)


def test_table_of_documents(spark):
    rows = [
        ("a", "https://Site.example/d/a?x=1#y", "[b](b) [up](../c?q) [m](mailto:x@y) [abs](//other.example/p#f) [self](#top) [bad](http://[)"),
        ("b", "https://site.example/d/b", None),
        ("c", None, "[b](b) [a](https://site.example/d/a)"),
        ("c", None, "[b](b)"),
    ]
    got = M.parsed(spark.createDataFrame(rows, "k string, page string, body string"), "k", "body", "page", "markdown")
    one = got.where("k = 'a'").first()
    assert one["page"] == "https://site.example/d/a"
    assert [x["page"] for x in one["links"]] == ["https://site.example/d/b", "https://site.example/c", None, "https://other.example/p", "https://site.example/d/a", None]
    assert got.where("k = 'c'").count() == 2 and got.where("k = 'c'").first()["page"] is None
    assert sorted(map(tuple, D.link_graph(M.page_links(got)).collect())) == [("https://site.example/d/a", "https://other.example/p"), ("https://site.example/d/a", "https://site.example/c"), ("https://site.example/d/a", "https://site.example/d/b")]
    assert M.parsed(spark.createDataFrame([], "k long, page string, body string"), "k", "body", "page", "html").count() == 0
