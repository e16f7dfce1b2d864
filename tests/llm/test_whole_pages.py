"""Pages whose prose lies in several containers are read whole."""

import time

from riskbridge.llm import html_text

LONG = "A sentence of the article that is long enough to be prose. " * 4
NAV = "<div><a href=a>Home</a> <a href=b>About us</a></div>"


def page(body: str) -> str:
    return f"<html><body><nav>menu</nav>{NAV}{body}<footer>foot</footer></body></html>"


def test_lists_tables_sections_and_mixed_hosts(spark):
    inner = {
        "list": f"<p>{LONG}</p><ul><li>{LONG}{LONG}</li><li>short</li></ul><p>end</p>",
        "table": f"<p>{LONG}</p><table><tr><td>{LONG * 9}</td></tr></table>",
        "sections": f"<section class=a><p>{LONG}</p></section><section class=body><p>{LONG * 9}</p></section>",
        "divs": f"<p>{LONG}</p><div class=body><p>{LONG * 9}</p></div>",
    }
    rows, want = [], {}
    for kind, body in inner.items():
        for frame in ("article", "div class=post"):
            for i in range(3):
                rows.append((len(rows), f"http://{kind}-{frame[0]}.example/{i}", page(f"<{frame}><h1>Title {i}</h1>{body}</{frame.split()[0]}>")))
                want[len(rows) - 1] = [f"Title {i}", LONG.strip(), *(["short", "end"] if kind == "list" else [])]
    teaser = len(rows)
    rows += [(teaser + i, f"http://mixed.example/{i}", page(f"<article><p>{LONG}</p></article>")) for i in range(5)]
    rows.append((teaser + 5, "http://mixed.example/5", page(f"<article><p>teaser</p></article><div class=story><h1>Story</h1><p>{LONG * 5}</p></div>")))
    want[teaser + 5] = ["Story", (LONG * 5).strip()]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    text = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for i, parts in want.items():
        assert all(p in text[i].split("\n\n") for p in parts), (rows[i][1], text[i])
        assert "foot" not in text[i] and "menu" not in text[i] and ("Home" not in text[i] or i == teaser + 5)


def test_names_must_say_it_whole():
    kept = ['<div class="share-price"><p>{}</p></div>', '<div id="social-sharing-history"><p>{}</p></div>', '<article><p>a</p><div class="related-work" id="search-engines"><p>{}</p></div></article>']
    for body in kept:
        assert LONG.strip() in html_text.main_text(body.format(LONG), None)
    assert html_text.main_text(f'<article><p>{LONG}</p><p class="comment-on-law">law</p></article>', None).endswith("\n\nlaw")
    for name in ("related-posts", "article__share", "sidebar-right", "comment-list", "site-footer", "newsletter box"):
        assert html_text.main_text(f'<div class=post><p>{LONG}</p></div><div class="{name}"><p>{LONG} other</p></div>', None) == LONG.strip()


def test_short_sentences_beside_the_container_stay():
    for before, after in (("<p class=lead>Rain fell all day.</p>", ""), ("", "<p>It closed on Monday.</p>")):
        text = html_text.main_text(page(f"{before}<div class=post><p>{LONG}</p></div>{after}"), None)
        assert LONG.strip() in text and ("Rain fell all day." in text or "It closed on Monday." in text) and "foot" not in text


def test_time_does_not_grow_with_depth():
    n = 20_000
    for body in ("<div>" * n + LONG, "<div class=a><p>x y." * n, "<b>" * n + "<p>hello</p>" * n, "<td><p>" * n):
        start = time.process_time()
        html_text.main_text(body, None)
        assert time.process_time() - start < 5
    deep, found = html_text.read("<div>" * n + LONG)
    assert sum(map(len, deep.name)) < 1100 * n and len(html_text.shares(deep, found)) == n + 1


def test_deep_pages_agree_on_a_host_path(spark):
    df = spark.createDataFrame([(i, "http://d.example/", "<div>" * 900 + f"<p>{LONG}</p>") for i in range(3)], "page_id bigint, url string, html string")
    assert [r.text for r in html_text.extract(df).collect()] == [LONG.strip()] * 3
