"""Labelled pages for the extraction model: seeded layouts in which data-y marks content (1) and the rest (0).

Any other pages marked the same way can take their place; an element without data-y has its parent's.
"""

from __future__ import annotations

import random

#: Names that page authors give to the parts of a page.
MAIN = [("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("section", "article-text"), ("div", "main-content"), ("div", "story"), ("div", "post"), ("div", "text"), ("div", "")]
NAV = ["menu", "nav", "navbar", "breadcrumb", "breadcrumbs", "toc", "pagination", "links", "tabs", "topbar"]
AD = ["ad", "ads", "advert", "advertisement", "ad-banner", "sponsor", "sponsored", "promo", "promotion", "banner"]
NOTICE = ["cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "banner-notice", "gdpr", "disclaimer", "paywall"]
SIDE = ["sidebar", "side", "widget", "related", "recommended", "trending", "popular", "more-stories", "tags"]
SOCIAL = ["share", "social", "share-buttons", "follow", "meta", "byline", "author-box"]
FORM = ["search", "newsletter", "subscribe", "login", "signup", "contact-form"]
COMMENT = ["comments", "comment-list", "responses", "discussion", "replies", "disqus"]
FOOT = ["footer", "copyright", "bottom", "legal", "site-footer", "colophon"]
HEAD = ["header", "masthead", "site-header", "logo", "branding", "top"]


def _page(r: random.Random) -> str:
    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choice("bdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentence(low: int = 4, high: int = 25) -> str:
        return words(low, high).capitalize() + r.choice(".....!?")

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence() for _ in range(r.randint(low, high)))

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/{words(1, 1)}">{words(low, high)}</a>'

    def named(tag: str, name: str, body: str, y: int | None = None) -> str:
        mark = "" if y is None else f' data-y="{y}"'
        key = r.choice(["class", "class", "id"])
        return f'<{tag}{mark}{f" {key}={chr(34)}{name}{chr(34)}" if name else ""}>{body}</{tag}>'

    def items(n: int, deep: int = 3) -> str:
        return "<ul>" + "".join(f"<li>{link(1, deep)}</li>" for _ in range(n)) + "</ul>"

    def nav() -> str:
        body = r.choice([items(r.randint(2, 9)), " ".join(link() for _ in range(r.randint(2, 8)))])
        return r.choice([named("nav", r.choice(["", *NAV]), body, 0), named(r.choice(["div", "ul"]), r.choice(NAV), body, 0)])

    def ad() -> str:
        return named(r.choice(["div", "div", "aside", "section", "p"]), r.choice(AD), r.choice([sentence(), prose(1, 3), link(2, 8)]), 0)

    def notice() -> str:
        return named(r.choice(["div", "section", "aside"]), r.choice(NOTICE), r.choice([f"<p>{prose(1, 3)}</p>", prose(1, 2)]) + r.choice(["", "<button>ok</button>", link()]), 0)

    def side() -> str:
        body = r.choice([f"<h3>{words(1, 3)}</h3>{items(r.randint(2, 7), 9)}", f"<h4>{words(1, 3)}</h4><p>{prose(1, 3)}</p>", f"<p>{prose(1, 4)}</p>"])
        return r.choice([named("aside", r.choice(["", *SIDE]), body, 0), named(r.choice(["div", "section"]), r.choice(SIDE), body, 0)])

    def form() -> str:
        body = f'<label>{words(1, 3)}</label><input type="text"><button>{words(1, 2)}</button>'
        return named("form", r.choice(["", *FORM]), r.choice([body, f"<p>{sentence()}</p>{body}"]), 0)

    def social() -> str:
        return named(r.choice(["div", "ul", "p"]), r.choice(SOCIAL), r.choice([" ".join(link() for _ in range(3)), words(2, 6)]), 0)

    def comments() -> str:
        one = lambda: named(r.choice(["div", "li", "article"]), r.choice(["comment", "reply", "comment-body"]), f"<p>{prose(1, 4)}</p>")
        body = f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 5)))
        return named(r.choice(["section", "div", "ol"]), r.choice(COMMENT), body, 0)

    def foot() -> str:
        body = r.choice([f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>&copy; {words(1, 4)}</p>{items(3)}", f"<p>{prose(1, 3)}</p>", words(2, 6)])
        return r.choice([named("footer", r.choice(["", *FOOT]), body, 0), named("div", r.choice(FOOT), body, 0)])

    def head() -> str:
        body = r.choice([f"<p>{words(2, 6)}</p>", f"<h2>{words(1, 3)}</h2>", link(1, 2)]) + r.choice(["", items(4)])
        return r.choice([named("header", r.choice(["", *HEAD]), body, 0), named("div", r.choice(HEAD), body, 0)])

    def paragraph() -> str:
        inner = r.choice([prose, prose, prose, prose, lambda: words(3, 90), lambda: words(1, 4)])()
        if r.random() < 0.25:
            inner = f"{r.choice(['<b>', '<em>'])}{inner}"
        if r.random() < 0.25:
            inner += f" {link()} {sentence()}"
        if r.random() < 0.12:
            inner = f'<a href="/x">{r.choice([sentence, prose])()}</a>'
        return f"<p>{inner}" + r.choice(["</p>", "</p>", "</p>", "<br>", ""])

    def inside() -> str:
        parts = [f"<h1>{r.choice([words(3, 14), sentence()])}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            k = r.random()
            if k < 0.7:
                parts.append(paragraph())
            elif k < 0.76:
                parts.append(f"<h2>{words(1, 8)}</h2>")
            elif k < 0.82:
                parts.append("<ul>" + "".join(f"<li>{sentence(2, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.86:
                parts.append(f"<blockquote>{r.choice([prose(1, 2), f'<p>{prose(1, 2)}</p>'])}</blockquote>")
            elif k < 0.89:
                parts.append(f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>")
            elif k < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif k < 0.95:
                parts.append(f"<pre>{words(3, 20)}</pre>")
            else:
                parts.append(f"<div>{prose()}</div>")
        parts.append(paragraph())
        for extra in r.sample([ad, side, social, form, nav, notice, comments], r.choice([0, 0, 0, 1, 1, 2])):
            parts.insert(r.randint(0, len(parts)), extra())
        return "".join(parts)

    def broken() -> str:
        """Text parted by line breaks, straight in what holds it."""
        heading = r.choice(["", f"<h1>{r.choice([words(1, 10), sentence()])}</h1>", f"<b>{words(2, 8)}</b><br>"])
        return heading + r.choice(["<br><br>", "<br>", "<br /><br />\n"]).join(r.choice([sentence, prose])() for _ in range(r.randint(1, 9)))

    def menu() -> str:
        return r.choice([lambda: words(1, 5), lambda: items(r.randint(2, 6)), lambda: "<br>".join(link() for _ in range(r.randint(2, 7))), lambda: " | ".join(link() for _ in range(r.randint(2, 6)))])()

    def table() -> str:
        """A page laid out by a table: a menu cell beside the article, maybe rows above and below."""
        rows = [f'<td data-y="0">{menu()}</td><td data-y="1">{r.choice([inside, inside, broken])()}</td>']
        if r.random() < 0.3:
            rows[0] += f'<td data-y="0">{r.choice([menu, ad, side])()}</td>'
        if r.random() < 0.5:
            rows.insert(0, f'<td colspan="2" data-y="0">{r.choice([words(1, 4), menu()])}</td>')
        if r.random() < 0.5:
            rows.append(f'<td colspan="2" data-y="0">{r.choice([f"&copy; {words(1, 4)}", menu(), sentence()])}</td>')
        return '<table data-y="0">' + "".join(f"<tr>{x}</tr>" for x in rows) + "</table>"

    layout = r.random()
    before = [f() for f in r.sample([nav, head, ad, notice, form, side, nav], r.randint(0, 4))]
    after = [f() for f in r.sample([side, ad, comments, form, social, notice, foot], r.randint(0, 4))]
    if r.random() < 0.6:
        after.append(foot())
    mark = ""
    if layout < 0.6:  # the article has an element of its own
        tag, name = r.choice(MAIN)
        body = inside() if r.random() < 0.95 else broken()
        if r.random() < 0.2:
            body = named("div", r.choice(["", "body", "article-body", "inner"]), body)
        main = named(tag, name, body, 1)
    elif layout < 0.85:  # it stands in the body, or in a wrapper, beside everything else
        mark, main = ' data-y="1"', r.choice([inside, inside, broken])()
        if r.random() < 0.4:
            before = []
        if r.random() < 0.4:
            after = []
    else:
        main = table()
    whole = "".join([*before, main, *after])
    if r.random() < 0.4:
        tag = r.choice(["div", "div", "div", "center"])
        name = r.choice(["", "wrapper", "container", "page", "layout"]) if tag == "div" else ""
        whole = named(tag, name, whole, 1 if mark else None)
        mark = ""
    return f'<!DOCTYPE html><html lang="en"><head><title>{words(2, 9)}</title><style>p{{margin:0}}</style></head><body{mark}>{whole}' + r.choice(["</body></html>", ""])


def labelled_pages(n: int = 1200, seed: int = 11) -> list[str]:
    r = random.Random(seed)
    return [_page(r) for _ in range(n)]
