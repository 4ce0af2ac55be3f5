"""HTML extraction on pages whose main text is known."""

import pytest

from rolltally.llm import html_extract

PARAGRAPH = "The river had been high for most of the week and nobody in the village could say when it would be safe to cross the old bridge to the other side again, or who had seen the boats. "


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


CASES = {
    "article": (page("<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>One &amp; two&nbsp;three.<p>Four<br>five</article><footer>&copy; x</footer>"), "Title One & two three. Four five"),
    "parts": (
        page(
            "<header>Site</header><div class='cookie-notice'>We use cookies on this site.</div><main><p>Kept.</p><aside>Side</aside><form><label>Mail</label><input></form>"
            "<div class=\"ad\">Buy</div><script>var a='<p>no</p>';</script><style>p{}</style><p>Also kept.</p></main><section id='comments'><p>First!</p></section>"
        ),
        "Kept. Also kept.",
    ),
    "comments inside": (page("<article><p>Text.</p><div class='comments'><article><p>A reply</p></article></div></article>"), "Text."),
    "unclosed": ("<body><nav><a href='/'>x</a><article><p>One<p><b>Two<p>Thr", "One Two Thr"),
    "entities": ("<article><p>&lt;b&gt; &#65;&#x42; &amp;amp; 1 < 2 &copy 3</p></article>", "<b> AB &amp; 1 < 2 © 3"),
    "comment node": ("<article><!-- <p>no</p> -> --><p>yes</p><!-- open", "yes"),
    "quoted bracket": ("<article><p title='a > b'>x</p><p data-x=\"</p>\">y</p></article>", "x y"),
    "upper case": ("<ARTICLE><P>a<P>b</ARTICLE><FOOTER>c</FOOTER>", "a b"),
    "no markup words": (page(f"<div><a href='/'>Home</a> <a href='/a'>About</a></div><div><p>{PARAGRAPH * 2}</p><h2>Short head</h2><p>{PARAGRAPH * 2}</p></div><div><a href='/t'>Terms</a></div>"), " ".join([(PARAGRAPH * 2).strip(), "Short head", (PARAGRAPH * 2).strip()])),
    "only menus": (page("<nav><a href='/'>Home</a></nav>"), ""),
    "text only": ("", ""),
    "null": (None, ""),
}


LONG_TEXT = (PARAGRAPH * 2).strip()
WRAPPED = {
    "modifiers": (f"<div class='layout has-sidebar nav-open with-comments no-banner'><p>{LONG_TEXT}</p></div>", LONG_TEXT),
    "wrapper of the article": (f"<div id='sidebar'><article><p>{LONG_TEXT}</p><p>Short.</p></article><div class='widget'>Buy this</div></div>", f"{LONG_TEXT} Short."),
    "wrapper of a short main": ("<div class='banner'><main><p>Short.</p></main></div>", "Short."),
    "wrapper of most long blocks": (f"<div class='widget'><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div><div class='sidebar'><p>{LONG_TEXT}</p></div>", f"{LONG_TEXT} {LONG_TEXT}"),
    "article that names a part": (f"<article class='post sponsored'><p>{LONG_TEXT}</p></article>", LONG_TEXT),
    "comments stay out": (f"<article><p>Text.</p></article><div class='comments'><article><p>{LONG_TEXT}</p></article><p>{LONG_TEXT}</p></div>", "Text."),
    "related cards stay out": ("<article><p>Text.</p></article><div class='related'><article><p>Card</p></article></div>", "Text."),
    "sidebar stays out": (f"<div><p>{LONG_TEXT}</p></div><div class='site-sidebar'><p>{PARAGRAPH}</p></div>", LONG_TEXT),
}


@pytest.mark.parametrize("name", WRAPPED)
def test_container_that_a_class_names_a_part(name):
    html, want = WRAPPED[name]
    assert html_extract.main_text(page(html)) == want


PROSE = {
    "ru": "Река стояла высоко почти всю неделю, и никто в деревне не знал, когда можно будет перейти старый мост. ",
    "pl": "Rzeka przez cały tydzień stała wysoko, dlatego nikt we wsi nie wiedział, kiedy będzie można przejść stary most. ",
    "tr": "Nehir bütün hafta boyunca yüksek kaldı, köyde kimse eski köprüden karşıya ne zaman geçilebileceğini bilmiyordu. ",
    "zh": "整整一个星期河水都很高村里没有人知道什么时候才能安全地走过那座古老的石桥回到对岸。",
    "ja": "一週間ずっと川の水が高く、村の誰もいつ古い橋を渡って向こう岸へ帰れるのか分からなかった。",
    "ar": "ظل النهر مرتفعا طوال الأسبوع ولم يعرف أحد في القرية متى يمكن عبور الجسر القديم إلى الضفة الأخرى بأمان. ",
    "el": "Το ποτάμι ήταν ψηλά όλη την εβδομάδα και κανείς στο χωριό δεν ήξερε πότε θα περάσει την παλιά γέφυρα. ",
}


@pytest.mark.parametrize("language", PROSE)
@pytest.mark.parametrize("english", [False, True])
def test_page_without_article_in_other_languages(language, english):
    text = (PROSE[language] * 6).strip()
    lead = f"<p>{LONG_TEXT}</p>" if english else ""
    menu = "<div><a href='/'>" + text + "</a></div>"
    got = html_extract.main_text(page(f"{menu}{lead}<p>{text}</p><p>{text[:30].strip()}</p><p>{text}</p>{menu}"))
    assert got == " ".join([LONG_TEXT] * english + [text, text[:30].strip(), text])


def test_code_and_tables_among_english_prose():
    code, cell = "x = frobnicate(y) ; " * 20, "alpha 12 beta 34 gamma 56 " * 12
    keywords = "cheap flights hotels cars insurance loans " * 3
    got = html_extract.main_text(page(f"<p>{LONG_TEXT}</p><pre>{code}</pre><table><tr><td>{cell}</td></tr></table><p>{LONG_TEXT}</p><div>{keywords}</div>"))
    assert got == " ".join([LONG_TEXT, code.strip(), cell.strip(), LONG_TEXT])


def test_stop_words_decide(monkeypatch):
    """Neither markup nor length tells the row of key words from a paragraph, with or without an article."""
    keywords = "cheap flights hotels cars insurance loans " * 3
    html = page(f"<p>{LONG_TEXT}</p><div>{keywords}</div><p>{LONG_TEXT}</p>")
    assert html_extract.main_text(html) == f"{LONG_TEXT} {LONG_TEXT}"
    monkeypatch.setattr(html_extract, "STOP_WORDS", frozenset())
    assert html_extract.main_text(html) == f"{LONG_TEXT} {keywords.strip()} {LONG_TEXT}"


def test_neighbours_decide(monkeypatch):
    """A short line belongs to what stands nearest to it."""
    menu = "<div><a href='/'>" + "Home and news and more of it " * 4 + "</a></div>"
    html = page(f"{menu}<p>Near the menu</p>{menu}<p>{LONG_TEXT}</p><p>Near the text</p><p>{LONG_TEXT}</p>{menu}")
    assert html_extract.main_text(html) == f"{LONG_TEXT} Near the text {LONG_TEXT}"
    monkeypatch.setattr(html_extract, "_inherited", lambda decided, *_: [[] for _ in decided])
    assert html_extract.main_text(html) != f"{LONG_TEXT} Near the text {LONG_TEXT}"


def test_short_pages_links_and_formulas_are_kept():
    short = "The river stood high for a week and nobody in the village knew when the old bridge would be safe to cross again, so they waited."
    assert len(short) < html_extract.LONG
    menu = "<div><a href='/'>Home</a> <a href='/a'>About the village</a></div>"
    assert html_extract.main_text(page(f"<p>{short}</p>")) == short
    assert html_extract.main_text(page(f"{menu}<p>{short}</p>{menu}")) == short
    assert html_extract.main_text(page(f"{menu}<p>Closed today.</p>")) == "Closed today."
    linked = f"<p>See <a href='/x'>{short}</a></p>"
    assert html_extract.main_text(page(f"<article><p>{LONG_TEXT}</p>{linked}<p>{LONG_TEXT}</p></article>")) == f"{LONG_TEXT} See {short} {LONG_TEXT}"
    assert html_extract.main_text(page(f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><p>{LONG_TEXT}</p></article>")).startswith("Let x=2 be.")


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    html, want = CASES[name]
    assert html_extract.main_text(html) == want


def test_query(spark):
    rows = [(i, f"u{i}", html, "x") for i, (html, _) in enumerate(CASES.values())]
    rows += [rows[0]]
    got = html_extract.op10_html(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [t for _, t in CASES.values()]
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got) == sorted((i, u, want[i], len(want[i])) for i, u, *_ in rows)
    assert html_extract.op10_html(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_tables_match_their_article(spark, sf_dir):
    import re
    from html import unescape

    got = html_extract.op10_html(spark.read.parquet(f"{sf_dir}/pages.parquet")).toPandas().set_index("page_id")
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html or "", re.DOTALL)
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", inner[1])).split()) if inner else ""
        assert got.text[r.page_id] == want


def test_long_page_is_read_whole():
    body = "".join(f"<p>{i} {PARAGRAPH}</p>" for i in range(5000))
    text = html_extract.main_text(f"<article>{body}</article>")
    assert text.count("river") == 5000 and text.startswith("0 The") and " 4999 The" in text
