"""HTML extraction: hand-made pages of many shapes, the best region against all regions, held-out pages against their markup."""

import html
import random

import duckdb
import pytest

from docsieve.llm.html_text import counts, extract, fit, main_text, page_text, read, weights

PLAIN = weights({})
HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>"
ARTICLE = "<h1>A title</h1><p>First words here.</p><p>Second <b>bold</b> words.</p>"
TEXT = "A title\nFirst words here.\nSecond bold words."

SHAPES = {
    "around": f"{HEAD}<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{ARTICLE}</article>"
    "<aside><p>Side text that is rather long and says much.</p></aside><footer>&copy; us</footer></body></html>",
    "inside": f"{HEAD}<article><h1>A title</h1><div class='share-bar'>Share</div><p>First words here.</p><form><label>Mail</label>"
    "<input name=m><button>Send it now</button></form><div class=\"ad slot\">Buy</div><aside>Also</aside><script>x<p>y</script>"
    "<!-- <p>no</p> --><p>Second <b>bold</b> words.</p></article></body></html>",
    "comments": f"{HEAD}<main><article>{ARTICLE}</article><section id='comments'><h2>Comments</h2><article class='comment'><p>I say "
    "something long about all of this and more.</p></article></section></main></body></html>",
    "no article": f"{HEAD}<div id='topNav'><a href='/a'>Go</a> <a href='/b'>There</a></div><div class='content'>{ARTICLE}</div>"
    "<div class='cookie-notice'>We use cookies on this site.</div><div class=sidebar><ul><li><a href=x>More</a></li></ul></div></body></html>",
    "wrapped": f"{HEAD}<form id='page'><div class='has-sidebar'><div role=main>{ARTICLE}</div></div></form></body></html>",
    "unclosed": f"{HEAD}<nav><ul><li>Menu<article><h1>A title</h1><p>First words here.<p>Second <b>bold</b> words.</article><footer>Foot",
    "header kept": f"{HEAD}<article><header><h1>A title</h1><nav>Jump</nav></header><p>First words here.</p><p>Second <b>bold</b> words.</p>"
    "<footer>Tags</footer></article></body></html>",
    "form around all": f"{HEAD}<form><div>{ARTICLE}</div></form></body></html>",
    "hidden": f"{HEAD}<article>{ARTICLE}<p style='display: none'>secret</p><p hidden>more</p><div aria-hidden=true>x</div></article>",
    "upper case": f"{HEAD}<ARTICLE><H1>A title</H1><P CLASS=lead>First words here.</P><P>Second <B>bold</B> words.</P></ARTICLE>",
    "white space": f"{HEAD}<article><h1>\n A \t title</h1>\n\n<p>First&nbsp;words\n here.</p><p>\n</p><p>Second <i></i>bold\r\nwords. </p></article>",
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    assert page_text(SHAPES[name], PLAIN) == TEXT


def test_references_lists_and_tables():
    page = "<article><p>a &lt;b&gt; &amp;amp; &eacute;&#x41;&#65; 1 < 2</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table>z<br>w</article>"
    assert page_text(page, PLAIN) == "a <b> &amp; éAA 1 < 2\none\ntwo\nx\ny\nz\nw"


def test_odd_pages():
    for page in (None, "", "   ", "<p", "<!--", "<!-- x", "<script>", "</p>", "<nav>Menu</nav>", "<p></p>", "<a href='"):
        assert page_text(page, PLAIN) == ""
    assert page_text("no tags at all", PLAIN) == "no tags at all" and page_text("<", PLAIN) == "<"
    long = "word " * 400_000
    assert page_text(f"<article><p>{long}</p></article>", PLAIN) == long.strip()
    assert page_text("<div>" * 3_000 + "<p>deep text</p>" + "</div>" * 3_000, PLAIN) == "deep text"


def test_best_region_against_all_regions():
    rng = random.Random(3)
    names = ["p", "a", "div", "zone", "li", "nav"]
    for _ in range(300):
        parts = []
        for n in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.5:
                parts.append((f"word:{rng.choice(['block', 'link', 'other', 'beside'])}", f" w{n}" * rng.randint(1, 4), 0))
            else:
                parts.append(("" if kind < 0.75 else rng.choice(names), "", 0))
        weight = {f: (rng.choice([-2, -1, 1, 2]) if f.startswith("word") else -rng.choice([0.5, 1, 3])) for f in PLAIN} | {n: -1.5 for n in names}

        def total(a, b):
            return sum(weight[f] * len(t.split()) if t else (weight[f] if f else 0) for f, t, _ in parts[a:b])  # noqa: B023

        regions = [(total(a, b), -a, b, a) for a in range(len(parts)) for b in range(a + 1, len(parts) + 1)]
        best = max(r[0] for r in regions)
        texts = set()
        for score, _, b, a in regions:
            if abs(score - best) < 1e-9 and best > 0:
                blocks = "".join(t if t else ("\n" if not f else "") for f, t, _ in parts[a:b]).split("\n")
                texts.add("\n".join(" ".join(x.split()) for x in blocks if x.strip()))
        assert extract(parts, weight) in (texts or {""})


def test_weights_have_their_signs():
    made = weights(counts(read(SHAPES["around"])))
    assert made["word:block"] > 0 > made["word:beside"]
    assert all(w < 0 for f, w in made.items() if not f.startswith("word:"))


def test_pages_without_their_marks(spark, small):
    """Weights from marked pages find the same text on held-out pages whose article elements are plain ones."""
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{small}/pages.parquet' ORDER BY page_id").fetchall()
    learned = fit(spark.createDataFrame(rows[::2], "page_id long, url string, html string"))
    for _, _, page in rows[1::2]:
        assert page_text(page.replace("<article>", "<div>").replace("</article>", "</div>"), learned) == page_text(page, learned)


def test_tables(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    out = {r["page_id"]: r for r in main_text(pages).collect()}
    for r in pages.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        for tag in ("h1", "p", "br"):
            inner = inner.replace(f"<{tag}>", "\n").replace(f"</{tag}>", "\n")
        blocks = [" ".join(html.unescape(b).split()) for b in inner.replace("<b>", "").split("\n")]
        # Line feeds inside a block were cut too: compare without the difference of blocks and blanks.
        assert out[r["page_id"]]["text"].split() == "\n".join(blocks).split()
        assert (out[r["page_id"]]["n_chars"], out[r["page_id"]]["url"]) == (len(out[r["page_id"]]["text"]), r["url"])
    odd = spark.createDataFrame(
        [(None, None, None, 1, "x"), (1, "u", "", 2, "x"), (1, "u", "", 2, "x"), (2, None, "<p>é 漢字</p>", 3, "x")],
        "page_id long, url string, html string, n_chars int, text string",
    )
    rows = sorted((tuple(r) for r in main_text(odd).collect()), key=repr)
    assert rows == sorted([(None, None, "", 0), (1, "u", "", 0), (1, "u", "", 0), (2, None, "é 漢字", 4)], key=repr)
    assert main_text(odd.filter("false")).count() == 0 and main_text(odd).columns == ["page_id", "url", "text", "n_chars"]
