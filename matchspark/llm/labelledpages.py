"""Labelled pages to train the content model from: drawn from layouts, every block's part known.

``data-y`` says whether a block's text belongs to the article. The parser reads it as the label; the
model never sees it.
"""

from __future__ import annotations

import random

N_PAGES = 700


def _pick(rng: random.Random, *options: str) -> str:
    return rng.choice(options)


class _Draw:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = self.r.choice(["plain"] * 5 + ["marks", "shout", "again", "bars"])

    def words(self, lo: int, hi: int, end: str = "") -> str:
        text = " ".join("".join(self.r.choice("aeioustrnlmd") for _ in range(self.r.randint(2, 9)))
                        for _ in range(self.r.randint(lo, hi)))
        if self.style == "plain":
            return text.capitalize() + end
        if self.style == "again":
            return " ".join([text.split()[0]] * len(text.split()))
        sign = {"marks": self.r.choice(["$$$", "%%%", "&amp;&amp;"]), "shout": "!!", "bars": " |"}[self.style]
        return " ".join(w + sign for w in (text.upper() if self.style == "shout" else text).split()) + end

    def prose(self, longest: int = 60) -> str:
        if self.r.random() < 0.2:
            return self.words(1, 6, self.r.choice([".", "", "!"]))
        return " ".join(self.words(3, max(4, longest // 3), ".") for _ in range(self.r.randint(1, 4)))

    def attr(self, *names: str, chance: float = 0.85) -> str:
        if self.r.random() > chance:
            return self.r.choice(["", f' class="c{self.r.randint(1, 99)}"', ' class="box"', ' id="x1"'])
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'

    def links(self, n: int, inside: str = "li") -> str:
        items = "".join(f"<{inside}><a href=#>{self.words(1, 4)}</a></{inside}>" if inside else
                        f"<a href=#>{self.words(1, 3)}</a> " for _ in range(n))
        return f"<ul>{items}</ul>" if inside == "li" else items

    def wrap(self, tag: str, attr: str, inner: str) -> str:
        if tag == "p" and "<" in inner:  # a paragraph holds no blocks
            tag = "div"
        return f"<{tag}{attr} data-y=0>{inner}</{tag}>"

    def nav(self) -> str:
        self.style, style = "plain", self.style
        out = self._nav()
        self.style = style
        return out

    def _nav(self) -> str:
        tag = _pick(self.r, "nav", "div", "ul", "nav")
        if tag == "ul":
            return self.wrap("ul", self.attr("menu", "nav", "main-menu"), "".join(
                f"<li><a href=#>{self.words(1, 2)}</a></li>" for _ in range(self.r.randint(3, 9))))
        return self.wrap(tag, self.attr("nav", "menu", "navbar", "breadcrumbs", "topnav", chance=0.6),
                         self.links(self.r.randint(3, 9), _pick(self.r, "li", "", "li")))

    def header(self) -> str:
        return self.wrap(_pick(self.r, "header", "div"), self.attr("header", "masthead", "site-header", "banner", "top", chance=0.9),
                         _pick(self.r, f"<h1>{self.words(1, 4)}</h1>", f"<a href=#>{self.words(1, 3)}</a>",
                               f"<p>{self.words(2, 9)}</p>", f"<div>{self.words(1, 3)}</div><p>{self.words(3, 9, '.')}</p>")
                         + (self.links(4) if self.r.random() < 0.4 else ""))

    def footer(self) -> str:
        text = _pick(self.r, f"&copy; {self.words(1, 3)} &middot; {self.prose()}", f"<p>&copy; 2020 {self.words(1, 9)}</p>",
                     f"<p>{self.prose()}</p>{self.links(3)}", f"{self.words(2, 9)} {self.links(3, '')}")
        return self.wrap(_pick(self.r, "footer", "footer", "div"), self.attr("footer", "site-footer", "copyright", "bottom", chance=0.9), text)

    def advert(self) -> str:
        return self.wrap(_pick(self.r, "div", "div", "aside", "p", "section"), " " + _pick(
            self.r, 'class="ad"', 'class="ads"', 'class="advert"', 'id="ad-1"', 'class="sponsored"', 'class="promo box"',
            'class="ad-slot"', 'class="advertisement"'), _pick(self.r, self.prose(), f"<p>{self.prose()}</p>", f"<a href=#>{self.words(2, 8)}</a>"))

    def aside(self) -> str:
        inner = _pick(self.r, f"<h3>{self.words(1, 3)}</h3>{self.links(5)}", f"<h2>{self.words(1, 3)}</h2><p>{self.prose()}</p>",
                      f"<p>{self.prose()}</p><p>{self.prose()}</p>{self.links(3)}", self.links(6), self.prose())
        return self.wrap(_pick(self.r, "aside", "aside", "div", "section"), self.attr(
            "sidebar", "side", "related", "widget", "aside", "recommended", "right-rail", "popular", chance=0.95), inner)

    def notice(self) -> str:
        return self.wrap(_pick(self.r, "div", "section", "p", "dialog", "aside"), " " + _pick(
            self.r, 'class="cookie-notice"', 'id="cookies"', 'class="notice"', 'class="consent banner"', 'class="alert"',
            'role="alert"', 'class="popup"', 'class="gdpr"'), _pick(self.r, f"<p>{self.prose()}</p><button>{self.words(1, 2)}</button>", self.prose()))

    def form(self) -> str:
        return self.wrap("form", self.attr("search", "newsletter", "login", "subscribe", chance=0.5), _pick(
            self.r, f"<label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button>",
            f"<p>{self.prose()}</p><input type=text><button>{self.words(1, 2)}</button>",
            f"<fieldset><legend>{self.words(1, 3)}</legend>{self.words(1, 5)} <input></fieldset>"))

    def comments(self) -> str:
        one = lambda: _pick(self.r, f"<li><b>{self.words(1, 2)}</b> <p>{self.prose()}</p></li>",
                            f'<div class="comment"><p>{self.prose()}</p></div>', f"<p>{self.words(1, 2)}: {self.prose()}</p>",
                            f"<div><h4>{self.words(1, 2)}</h4><p>{self.prose()}</p></div>")
        return self.wrap(_pick(self.r, "section", "div", "ol", "div"), " " + _pick(
            self.r, 'class="comments"', 'id="comments"', 'class="comment-list"', 'id="disqus_thread"', 'class="responses"',
            'class="replies"', 'class="discussion"', 'class="reader-comments"'),
            (f"<h3>{self.words(1, 3)}</h3>" if self.r.random() < 0.6 else "") + "".join(one() for _ in range(self.r.randint(1, 6))))

    def share(self) -> str:
        return self.wrap("div", " " + _pick(self.r, 'class="share"', 'class="social"', 'class="share-buttons"'), self.links(3, ""))

    def block(self) -> str:
        r = self.r.random()
        if r < 0.62:
            return _pick(self.r, f"<p>{self.prose()}</p>", f"<p>{self.prose()}", f"<p>{self.prose()} <a href=#>{self.words(1, 3)}</a> {self.prose()}</p>",
                         f"<p><b>{self.prose()}<br>", f"<p>{self.prose()}<br>{self.prose()}</p>", f"<div>{self.prose()}</div>")
        if r < 0.74:
            return f"<h{(k := self.r.randint(2, 4))}>{self.words(1, 7)}</h{k}>"
        if r < 0.84:
            tag = _pick(self.r, "ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{self.prose(24)}</li>" for _ in range(self.r.randint(2, 5))) + f"</{tag}>"
        if r < 0.90:
            return f"<blockquote><p>{self.prose()}</p></blockquote>"
        if r < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr>"
                                       for _ in range(self.r.randint(2, 4))) + "</table>"
        if r < 0.97:
            return f"<pre>{self.words(3, 20)}</pre>"
        return f"<section><h3>{self.words(1, 5)}</h3><p>{self.prose()}</p></section>"

    def article(self, inserted: list[str]) -> str:
        blocks = [self.block() for _ in range(max(1, int(self.r.expovariate(1 / 7))))]
        if self.r.random() < 0.7:
            title = f"<h1>{self.words(1, 14)}</h1>"
            blocks.insert(0, _pick(self.r, title, title, title, f"<header>{title}</header>"))
        for extra in inserted:
            blocks.insert(self.r.randint(1, len(blocks)), extra)
        tag = _pick(self.r, "article", "article", "div", "main", "section")
        attr = self.attr("post", "entry-content", "article-body", "content", "story", "main-content", "post-body",
                         chance=0.15 if tag == "article" else 0.7)
        inner = "".join(blocks)
        if self.r.random() < 0.25:
            inner = f"<div{self.attr('text', 'body', 'inner')}>{inner}</div>"
        return f"<{tag}{attr} data-y=1>{inner}</{tag}>"

    def page(self) -> str:
        r = self.r.random
        inserted = [f() for f, c in ((self.advert, 0.15), (self.aside, 0.1), (self.share, 0.1), (self.form, 0.08),
                                     (self.comments, 0.08), (self.nav, 0.04)) if r() < c]
        before = [f() for f, c in ((self.notice, 0.25), (self.header, 0.4), (self.nav, 0.7), (self.form, 0.15),
                                   (self.advert, 0.4), (self.aside, 0.2)) if r() < c]
        after = [f() for f, c in ((self.comments, 0.35), (self.aside, 0.35), (self.advert, 0.25), (self.form, 0.2),
                                  (self.share, 0.15), (self.footer, 0.8), (self.notice, 0.15)) if r() < c]
        self.r.shuffle(after) if r() < 0.3 else None
        article = self.article(inserted)
        kind = r()
        if kind < 0.08:  # no boilerplate at all
            body = f"<div data-y=1>{article}</div>" if r() < 0.5 else article
        elif kind < 0.18:  # layout table
            body = (f"{''.join(before[:2])}<table><tr><td data-y=0>{self.links(5)}</td><td>{article}</td></tr></table>{''.join(after)}")
        elif kind < 0.6:
            body = "".join(before) + article + "".join(after)
        else:
            tag = _pick(self.r, "div", "main", "section")
            cut = self.r.randint(0, len(after))
            body = "".join(before) + f"<{tag}{self.attr('wrapper', 'container', 'page', 'main', 'content', chance=0.6)}>" \
                   f"{article}{''.join(after[:cut])}</{tag}>" + "".join(after[cut:])
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>"


def labelled_pages(n: int = N_PAGES, seed: int = 21) -> list[str]:
    return [_Draw(seed * 100_003 + i).page() for i in range(n)]
