"""Labelled pages: layouts whose main text is marked, put together from parts.

The elements with the attribute MARK hold the main text. Words are made of
syllables, since the model reads structure and not words. A caller with pages
of his own passes those instead.
"""

from __future__ import annotations

import random

MARK = "data-main"

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()

#: {s}: a few words, {S}: a sentence, {P}: a paragraph, {L}: list items of links, {I}: list items of sentences.
_TOP = [
    '<header class="site-header"><a href="/">{s}</a><p>{s}</p></header>',
    '<div id="header"><div class="logo"><a href="/">{s}</a></div><div class="tagline">{S}</div></div>',
    '<div class="topbar">{s} <a href="/login">{s}</a></div>',
    '<header><h1><a href="/">{s}</a></h1><nav><ul>{L}</ul></nav></header>',
    '<div role="banner"><h2>{s}</h2><p>{S}</p></div>',
    "",
]
_MENU = [
    "<nav><ul>{L}</ul></nav>",
    '<div class="menu"><ul>{L}</ul></div>',
    '<ul id="main-nav">{L}</ul>',
    '<div class="breadcrumbs"><a href="/">{s}</a> &gt; <a href="/a">{s}</a> &gt; {s}</div>',
    '<table class="navbar"><tr><td><a href="/a">{s}</a></td><td><a href="/b">{s}</a></td></tr></table>',
    '<nav class="toc"><p>{s}</p><ol>{L}</ol></nav>',
    "",
]
_NOISE = [
    '<div class="ad">{S}</div>',
    '<div class="ad">{P}</div>',
    '<div class="advertisement"><a href="/x">{S}</a></div>',
    '<aside class="sponsored"><h3>{s}</h3><p>{S}</p></aside>',
    '<div class="cookie-notice"><p>{S}</p><button>{s}</button></div>',
    '<div id="gdpr-consent" role="dialog">{P} <a href="/p">{s}</a></div>',
    '<div class="notice">{S}</div>',
    '<div class="alert alert-info"><p>{P}</p></div>',
    '<div class="newsletter"><h4>{s}</h4><p>{S}</p><form><label>{s}</label><input name="m"><button>{s}</button></form></div>',
    '<form class="search" action="/s"><label>{s}</label><input><button>{s}</button></form>',
    "<form><p>{S}</p><select><option>{s}</option></select></form>",
    '<div class="share"><ul>{L}</ul></div>',
    '<p class="social"><a href="/f">{s}</a> <a href="/t">{s}</a></p>',
    "<script>var t = '{S}';</script>",
    "<!-- {P} -->",
    '<div class="related"><h3>{s}</h3><ul>{L}</ul></div>',
    '<div class="promo"><p>{S}</p></div>',
    '<div style="display:none">{P}</div>',
]
_SIDE = [
    '<aside><h3>{s}</h3><ul>{L}</ul></aside>',
    '<div id="sidebar"><h3>{s}</h3><p>{S}</p><ul>{L}</ul></div>',
    '<div class="sidebar"><div class="widget"><h4>{s}</h4><p>{P}</p></div></div>',
    '<aside class="related"><p>{P}</p></aside>',
    '<div class="right-rail"><div class="popular"><ol>{L}</ol></div></div>',
    "",
]
_READERS = [
    '<section id="comments"><h3>{s}</h3><div class="comment"><p>{P}</p></div><div class="comment"><p>{S}</p></div></section>',
    '<div class="comments"><ol class="commentlist"><li class="comment"><cite>{s}</cite><p>{P}</p></li><li><p>{P}</p></li></ol></div>',
    '<div class="comment"><b>{s}</b>: {P}</div><div class="comment"><b>{s}</b>: {S}</div>',
    '<div id="disqus_thread"><p>{P}</p></div>',
    '<section class="comments"><article class="comment"><p>{P}</p></article><article class="comment"><p>{S}</p></article></section>',
    '<div class="replies"><p>{P}</p><div class="reply"><p>{P}</p></div></div>',
    "",
    "",
]
_FOOT = [
    "<footer>&copy; {s} &middot; {S}</footer>",
    "<footer><p>{P}</p></footer>",
    '<div id="footer"><p>&copy; 2020 {s}. {S}</p><ul>{L}</ul></div>',
    '<div class="footer-links"><a href="/a">{s}</a> | <a href="/b">{s}</a></div>',
    '<p class="copyright">&copy; {s} {S}</p>',
    '<footer role="contentinfo"><nav><ul>{L}</ul></nav><small>{S}</small></footer>',
    "",
]
#: Around the main text; {B} takes its parts.
_BODY = [
    "<article>{B}</article>",
    "<article>{B}</article>",
    "<article>{B}</article>",
    "<main><article>{B}</article></main>",
    "<main>{B}</main>",
    '<div id="content">{B}</div>',
    '<div class="container"><div class="post-body">{B}</div></div>',
    '<div class="entry-content">{B}</div>',
    '<div class="post">{B}</div>',
    '<section class="story">{B}</section>',
    '<section class="article"><div class="text">{B}</div></section>',
    "<div><div>{B}</div></div>",
    "<div>{B}</div>",
    '<div class="page-wrapper"><div class="row"><div class="col-8">{B}</div></div></div>',
    '<table><tr><td>{B}</td></tr></table>',
    '<div id="main" role="main">{B}</div>',
    '<form id="page">{B}</form>',
]
_TITLE = ["<h1 data-main>{s}</h1>", "<header><h1 data-main>{S}</h1></header>", "<h2 data-main>{s}</h2>", "<h1 data-main>{S}</h1>", ""]
_TEXT = [
    "<p data-main>{P}</p>",
    "<p data-main>{P}</p>",
    "<p data-main>{P}</p>",
    "<p data-main>{S}</p>",
    "<p data-main>{s}</p>",
    "<p data-main><b>{S}<br><p data-main>{P}</p>",
    "<p data-main>{P} <a href='/z'>{s}</a> {S}</p>",
    "<h2 data-main>{s}</h2><p data-main>{P}</p>",
    "<ul data-main>{I}</ul>",
    "<ul data-main><li>{s}</li><li>{s}</li><li>{s}</li></ul>",
    "<blockquote data-main><p>{P}</p></blockquote>",
    "<table data-main><tr><th>{s}</th><td>{s}</td></tr><tr><th>{s}</th><td>{S}</td></tr></table>",
    "<div data-main>{P}</div>",
    "<pre data-main>{P}</pre>",
    "<span data-main>{P}</span>",
    "<span data-main>{P}</span><br><br>",
    "<figure data-main><img src='/i.png'><figcaption>{S}</figcaption></figure>",
    "<section data-main><h3>{s}</h3><p>{P}</p><p>{P}</p></section>",
]


def pages(n: int = 400, seed: int = 11) -> list[str]:
    """n labelled pages, the same in every run."""
    draw = random.Random(seed)

    def words(least: int, most: int) -> list[str]:
        return ["".join(draw.choices(_SYLLABLES, k=draw.randint(1, 4))) for _ in range(draw.randint(least, most))]

    def sentence() -> str:
        some = words(4, 16)
        if draw.random() < 0.1:  # lists, tables set in a line, lines without marks
            return draw.choice([", ", " | ", " ", ". "]).join(some)
        if draw.random() < 0.5:
            some[len(some) // 2] += ","
        return " ".join(some).capitalize() + draw.choice(".....!?")

    def links() -> str:
        return "".join(f'<li><a href="/{i}">{" ".join(words(1, 3))}</a></li>' for i in range(draw.randint(2, 8)))

    fill = {
        "{s}": lambda: " ".join(words(1, 5)),
        "{S}": sentence,
        "{P}": lambda: " ".join(sentence() for _ in range(draw.randint(2, 8))),
        "{L}": links,
        "{I}": lambda: "".join(f"<li>{sentence()}</li>" for _ in range(draw.randint(2, 5))),
    }

    def filled(layout: str) -> str:
        for slot, value in fill.items():
            while slot in layout:
                layout = layout.replace(slot, value(), 1)
        return layout

    def page() -> str:
        short = draw.random() < 0.2  # little more than a title
        body = [draw.choice(_TITLE)]
        for _ in range(draw.choice([1, 1, 2, 4, 7, 12]) if not short else 0):
            body.append(draw.choice(_TEXT))
            if draw.random() < 0.12:
                body.append(draw.choice(_NOISE))
        if short:
            body.append(draw.choice(["<p data-main>{S}</p>", "<p data-main>{s}</p>", "<p data-main>{s}.</p>"]))
        readers = draw.choice(_READERS)
        if draw.random() < 0.3:
            body.append(readers)
            readers = ""
        around = [draw.choice(_TOP), draw.choice(_MENU), *draw.sample(_NOISE, draw.choice([0, 1, 2]))]
        draw.shuffle(around)
        after = [draw.choice(_SIDE), readers, *draw.sample(_NOISE, draw.choice([0, 1, 2]))]
        draw.shuffle(after)
        whole = [*around, draw.choice(_BODY[:7] if short else _BODY).replace("{B}", "".join(body)), *after, draw.choice(_FOOT)]
        head = "<!DOCTYPE html><html><head><title>{s}</title><style>p{margin:0}</style></head><body>"
        return filled(head + "".join(whole) + draw.choice(["</body></html>", ""]))

    return [page() for _ in range(n)]
