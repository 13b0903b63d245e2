"""Main texts: a plain style tree beside the operator's, pages of many shapes, and the tables' own pages."""

import html as H
import random
import re
from collections import Counter, defaultdict
from math import log

import pytest

from quarrylake.llm import markup, site_tree as S

SCHEMA = "page_id long, url string, html string"


def plain_trees(pages):
    """Importances by counting in plain dictionaries, from their definition."""
    shown, texts, where = defaultdict(Counter), defaultdict(Counter), {}
    for _, url, page in pages:
        name = re.sub(r"^[^:]+://([^/?#]*).*", r"\1", url or "").lower() if "://" in (url or "") else ""
        nodes, blocks = markup.read(page or "")
        path = [(name,)]
        for n in nodes[1:]:
            path.append((*path[n.parent], n.label))
        children = [["#"] for _ in nodes]
        for n in nodes[1:]:
            if children[n.parent][-1] != n.label:
                children[n.parent].append(n.label)
        own = defaultdict(set)
        for p, c in zip(path, children, strict=True):
            own[p].add(" ".join(c))
        for p, c in own.items():
            shown[p][tuple(sorted(c))] += 1
        for key in {(path[b.node], b.text) for b in blocks}:
            texts[key[0]][key[1]] += 1
        for p, k in zip(path, S.keys(name, nodes), strict=True):
            where[p] = k
    tree = {}
    for p, c in shown.items():
        m = sum(c.values())
        if m >= S.MIN_PAGES:
            tree[where[p]] = -sum(n / m * log(n / m) for n in c.values()) / log(m)
            for text, k in texts[p].items():
                if k >= S.MIN_SHARED and 1 - log(k) / log(m) < S.LEAST:
                    tree[S._hash(where[p], "text", text)] = 1 - log(k) / log(m)
    return tree


def soup(draw, k):
    """A page without any telling element or name: menu, notice, article, foot."""
    words = lambda n: " ".join(draw.choice("alpha beta gamma delta omega sigma kappa".split()) for _ in range(n))
    body = [f"{words(9)} {k}-{j}." for j in range(draw.randint(1, 6))]
    menu = "".join(f'<div class="i">Go {j}</div>' for j in range(draw.randint(3, 4)))
    return f'<body><div class="x1">{menu}</div><div class="x2">Our shop is open. Mind the step.</div><div class="x3">' + "".join(f"<p>{b}</p>" for b in body) + '</div><div class="x4">Made by us</div></body>', "\n\n".join(body)


@pytest.fixture(scope="module")
def site():
    draw = random.Random(3)
    made = [soup(draw, k) for k in range(40)]
    return [(k, f"http://Soup.example/{k}", page) for k, (page, _) in enumerate(made)], [text for _, text in made]


def texts(df):
    return [r["text"] for r in sorted(df.collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))]


def test_site_without_names(spark, site, monkeypatch):
    pages, want = site
    given = spark.createDataFrame([(*p, 1) for p in pages], SCHEMA + ", TEXT int")
    assert texts(S.main_texts(given)) == want
    tree = {r["key"]: r["value"] for r in S.site_trees(given.select("page_id", "url", "html", S.host(given["url"]).alias("host"))).collect()}
    expected = plain_trees(pages)
    assert tree.keys() == expected.keys() and all(abs(tree[k] - expected[k]) < 1e-9 for k in tree)
    monkeypatch.setattr(S, "HOST_PAGES", 7)  # the host's pages are dealt out, with copies of its tree
    assert texts(S.main_texts(given)) == want
    few = given.where("page_id < 3")  # too few pages to tell
    assert texts(S.main_texts(few))[0].startswith("Go 0\n\nGo 1")


def test_same_text_on_another_host_stays(spark, site):
    pages, want = site
    other = [(100 + k, f"http://b.example/{k}", f"<body><div class=x2>Our shop is open. Mind the step.</div><div class=x3><p>{k} b.</p></div>") for k in range(2)]
    got = texts(S.main_texts(spark.createDataFrame(pages + other, SCHEMA)))
    assert got[:40] == want and got[40] == "Our shop is open. Mind the step.\n\n0 b."


PAGES = [
    ("<article><h1>T&eacute;</h1><p>a\n  b<br>c &amp; d<p>e</article>", "Té\n\na b c & d\n\ne"),
    ("<nav>n</nav><header>h</header><article><header><h1>T</h1></header><p>x</p><aside>s</aside><footer>f</footer></article><footer>f</footer>", "T\n\nx"),
    ("<body><main><p>m</p></main><p>out</p>", "m"),
    ("<body><p>one<div class='sidebar'>s</div><div id=cookie-notice>c</div><p>two", "one\n\ntwo"),
    ('<script>var t="</p>";</script><style>p{}</style><p>x<!-- <p>c</p> -->y</p><noscript><p>n</p></noscript>', "xy"),
    ("<article><p>x</p><section class='comments'><article class=comment><p>nice</p></article></section></article>", "x"),
    ("<section id=comments><article><p>reader</p></article></section><div><p>body</p></div>", "body"),
    ("<form><p>f</p><input></form><p>x <span class=ad>buy</span> y</p><p hidden>z</p>", "x y"),
    ("<form id=page><article><p>in a form</p></article></form>", "in a form"),
    ("<ul><li>a<li>b <b>c</ul><dl><dt>t<dd>d</dl><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb c\n\nt\n\nd\n\n1\n\n2\n\n3"),
    ("<ul><li><a href=/1>Home</a><li><a href=/2>News</a></ul><div><p>see <a href=/3>this</a> for more</p></div>", "see this for more"),
    ("<div itemprop=articleBody>x</div><div>y</div>", "x"),
    ("no markup &lt;at&gt; all &#233;&nbsp;&nbsp;x 1 < 2", "no markup <at> all é x 1 < 2"),
    ("<p>cut off<a href='x", "cut off"),
    ("", ""),
    (None, ""),
    ("<nav>only</nav>", ""),
    ("<article></article><p>x</p>", "x"),
    ("<div>" * 3000 + "deep", "deep"),
    ("<article>" + "<p>wörd </p>" * 50_000 + "</article>", "\n\n".join(["wörd"] * 50_000)),
]


def test_pages_of_many_shapes(spark):
    rows = [(k, f"http://h{k}.example/", page) for k, (page, _) in enumerate(PAGES)]
    rows += [(None, None, "<p>x</p>"), (None, None, "<p>x</p>"), (50, "nonsense", "<p>y</p>")]
    got = S.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] is not None} == {k: w for k, (_, w) in enumerate(PAGES)} | {50: "y"}
    assert [r["text"] for r in got if r["page_id"] is None] == ["x", "x"] and all(r["n_chars"] == len(r["text"]) for r in got)
    assert S.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_prose_of_a_declared_article_stays(spark):
    page = "<body><div class=bar>Share this</div><article><h1>Same</h1><p>The same on all.</p><div><p>Follow us here</p></div><p>{}</p></article>"
    rows = [(k, f"http://a.example/{k}", page.format(k)) for k in range(20)]
    assert texts(S.main_texts(spark.createDataFrame(rows, SCHEMA))) == [f"Same\n\nThe same on all.\n\n{k}" for k in range(20)]


def test_query(spark, small):
    from quarrylake.llm.queries import op11_html_text

    got = {r["page_id"]: r for r in op11_html_text(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        parts = re.split("</?(?:p|h1)>", re.search("(?s)<article>(.*)</article>", r["html"])[1])
        want = "\n\n".join(x for x in (" ".join(H.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in parts) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]
