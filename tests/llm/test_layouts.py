"""Lists, tables and code of an article, with weights learned from pages whose lists are menus only."""

import pytest

from pulsefleet.llm.htmltext import main_text, page_weights

MENU = "<nav><ul>" + "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(8)) + "</ul></nav>"
BARE = "<ul>" + "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(8)) + "</ul>"
FIRST, LAST = "first " * 19 + "one", "last " * 19 + "one"


def words(n, k):
    return " ".join(f"w{n}x{i}" for i in range(k))


def around(middle, tag="article"):
    return f"<html><body>{MENU}<{tag}><p>{FIRST}</p>{middle}<p>{LAST}</p></{tag}><footer>foot of the page</footer></body></html>"


@pytest.fixture(scope="module")
def weights(spark):
    page = f"<html><body>{BARE}<table><tr><td><a href='/'>home</a></td></tr></table><article><h1>head line</h1><p>{FIRST}</p><p>{LAST}</p></article><footer>foot of it</footer></body></html>"
    return page_weights(spark.createDataFrame([(page,)] * 40, "html string"))


LAYOUTS = {
    "long items": ("<ul>" + "".join(f"<li>{words(i, 8)}</li>" for i in range(30)) + "</ul>", 240),
    "short items": ("<ol>" + "".join(f"<li>{words(i, 3)}</li>" for i in range(30)) + "</ol>", 90),
    "one word each": ("<ul>" + "".join(f"<li>{words(i, 1)}</li>" for i in range(30)) + "</ul>", 30),
    "table": ("<table>" + "".join("<tr>" + "".join(f"<td>{words(f'{i}c{j}', 2)}</td>" for j in range(3)) + "</tr>" for i in range(20)) + "</table>", 120),
    "definitions": ("<dl>" + "".join(f"<dt>{words(i, 1)}</dt><dd>{words(i, 6)}</dd>" for i in range(20)) + "</dl>", 140),
    "code": (f"<pre><code>{words('c', 60)}</code></pre>", 60),
    "links": ("<ul>" + "".join(f"<li><a href='/s'>{words(i, 4)}</a></li>" for i in range(10)) + "</ul>", 40),
    "lead": (f"<p class='teaser'>{words('t', 30)}</p>", 30),
}


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("name", LAYOUTS)
def test_an_article_keeps_all_its_words(weights, name, tag):
    middle, n = LAYOUTS[name]
    got = main_text(around(middle, tag), weights).split()
    assert len(got) == n + 40 and got[0] == "first" and got[-2] == "last"


def test_an_article_that_is_one_table_and_a_list_without_an_article(weights):
    assert len(main_text(f"<html><body>{MENU}<article>{LAYOUTS['table'][0]}</article></body></html>", weights).split()) == 120
    bare = f"<html><body>{BARE}<div><p>{FIRST}</p><ul>{''.join(f'<li>{words(i, 4)}</li>' for i in range(30))}</ul><p>{LAST}</p></div></body></html>"
    assert len(main_text(bare, weights).split()) == 160
