"""Labelled pages that the content model is trained on: written by rule, with every node's label known."""
from __future__ import annotations

import random

#: Class or id names that page authors give to parts, by the part.
NAMES = {
    "nav": ("nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "top-nav", "site-nav", "navigation", "pagination", "pager", "toc"),
    "header": ("header", "site-header", "masthead", "topbar", "branding", "page-head", "banner-top", "logo"),
    "footer": ("footer", "site-footer", "copyright", "legal", "bottom", "colophon", "foot"),
    "sidebar": ("sidebar", "side", "widget", "related", "related-posts", "recommended", "trending", "most-read", "rail", "tags", "tag-cloud", "popular"),
    "notice": ("cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "paywall", "overlay"),
    "ad": ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "sponsor", "promo", "promotion", "banner", "adsbox", "doubleclick"),
    "share": ("share", "social", "sharing", "share-buttons", "follow", "byline-tools", "print-tools"),
    "comment": ("comments", "comment", "comment-list", "replies", "reply", "disqus", "discussion", "user-comments", "respond", "responses"),
    "form": ("form", "search", "search-form", "login", "contact-form", "feedback", "survey", "poll"),
    "article": ("article", "post", "content", "entry", "entry-content", "post-body", "story", "story-body", "main-content", "article-body", "text", "body-text", "page-content"),
    "wrap": ("wrap", "wrapper", "container", "row", "col", "col-8", "layout", "page", "site", "inner", "grid", "section"),
}
TAGS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "dialog"), "ad": ("div", "aside", "section", "ins"), "share": ("div", "ul"), "comment": ("section", "div", "ol"), "form": ("form",), "article": ("article", "main", "div", "section")}
INSIDE = ("ad", "share", "notice", "sidebar", "form", "comment")  # parts found inside articles too

_SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "é", "ç", "ü", "ß", "ñ", "ó")


class Writer:
    """Writes one page; each text goes in with its label, 1 for main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[int] = []  # of the page's texts, in order

    def words(self, n: int) -> str:
        r = self.r
        mark = r.choice(("", "", "", "!", "*** ###"))
        text = " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randrange(1, 5))) + ("," if r.random() < 0.08 else "." if r.random() < 0.06 else "") for _ in range(n))
        return text.capitalize() + mark

    def text(self, n: int, label: int) -> None:
        self.out.append(self.words(n))
        self.labels.append(label)

    def open(self, part: str, named: float = 0.8) -> str:
        r, tag = self.r, self.r.choice(TAGS.get(part, ("div",)))
        plain = tag in ("div", "section", "ul", "ol", "ins")
        attr = ""
        if r.random() < (1 if plain and part != "wrap" else named * 0.6):
            attr = f' {r.choice(("class", "class", "id"))}="{r.choice(NAMES[part])}{r.choice(("", "", " " + r.choice(NAMES["wrap"])))}"'
        self.out.append(f"<{tag}{attr}>")
        return f"</{tag}>"

    def links(self, n: int, label: int = 0) -> None:
        for _ in range(n):
            self.out.append('<li><a href="/x">')
            self.text(self.r.randrange(1, 4), label)
            self.out.append("</a></li>")

    def boiler(self, part: str) -> None:
        r, end = self.r, self.open(part)
        kind = {"nav": 0, "sidebar": r.choice((0, 1)), "share": 0, "form": 2, "comment": 3}.get(part, r.choice((1, 4)))
        if kind == 0:
            bare = end in ("</ul>",)
            self.out.append("" if bare else "<ul>")
            self.links(r.randrange(2, 9))
            self.out.append("" if bare else "</ul>")
        elif kind == 1:
            for _ in range(r.randrange(1, 3)):
                tag = r.choice(("p", "h3", "div"))
                self.out.append(f"<{tag}>")
                self.text(r.randrange(2, 25), 0)
                self.out.append("" if tag == "p" and r.random() < 0.3 else f"</{tag}>")
        elif kind == 2:
            self.out.append("<label>")
            self.text(r.randrange(1, 5), 0)
            self.out.append('</label><input type="text"><button>')
            self.text(1, 0)
            self.out.append("</button>")
        elif kind == 3:
            for _ in range(r.randrange(1, 4)):
                before, after = r.choice((('<div class="comment">', "</div>"), ("<article>", "</article>"), ('<li class="reply">', "</li>"), ("", "")))
                self.out.append(before + "<p>")
                self.text(r.randrange(3, 60), 0)
                self.out.append("</p>" + after)
        else:
            self.text(r.randrange(2, 40), 0)
        self.out.append(end)

    def blocks(self, n: int) -> None:
        r = self.r
        for _ in range(n):
            kind = r.random()
            if kind < 0.08:
                tag = r.choice(("h2", "h3", "h4"))
                self.out.append(f"<{tag}>")
                self.text(r.randrange(1, 9), 1)
                self.out.append(f"</{tag}>")
            elif kind < 0.16:
                self.out.append(r.choice(("<ul>", "<ol>")))
                for _ in range(r.randrange(1, 5)):
                    self.out.append("<li>")
                    self.text(r.randrange(1, 25), 1)
                self.out.append(r.choice(("</ul>", "</ol>")))
            elif kind < 0.22:
                self.out.append("<blockquote><p>")
                self.text(r.randrange(3, 50), 1)
                self.out.append("</p></blockquote>")
            elif kind < 0.26:
                self.out.append("<table><tr><td>")
                self.text(r.randrange(1, 6), 1)
                self.out.append("</td><td>")
                self.text(r.randrange(1, 6), 1)
                self.out.append("</td></tr></table>")
            elif kind < 0.30:
                self.out.append("<figure><img src='i.png'><figcaption>")
                self.text(r.randrange(2, 15), 1)
                self.out.append("</figcaption></figure>")
            elif kind < 0.38:
                self.boiler(r.choice(INSIDE))
            elif kind < 0.5:
                before, after = r.choice((("<p><b>", "<br>"), ("<div>", "</div>"), ("<p><a href='/y'>", "</a>"), ("<section><p>", "</p></section>")))
                self.out.append(before)
                self.text(r.randrange(1, 120), 1)
                self.out.append(after)
            else:
                self.out.append("<p>")
                self.text(r.choice((1, 3, 8, 20, 60, 150)), 1)
                self.out.append("</p>")

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.out.append("<!DOCTYPE html><html><head><title>t</title></head><body>")
        wraps = []
        for part in r.sample(["header", "nav", "ad", "notice", "form", "sidebar"], r.randrange(1, 5)):
            if r.random() < 0.3:
                wraps.append(self.open("wrap"))
            self.boiler(part)
        if r.random() < 0.95:
            end = self.open("article")
            if r.random() < 0.3:
                wraps.append(self.open("wrap"))
            if r.random() < 0.7:
                head = r.random() < 0.3
                self.out.append("<header><h1>" if head else "<h1>")
                self.text(r.randrange(1, 14), 1)
                self.out.append("</h1></header>" if head else "</h1>")
            self.blocks(r.randrange(1, 14))
            self.out.append(end)
        for part in r.sample(["footer", "comment", "ad", "sidebar", "notice", "nav"], r.randrange(1, 5)):
            self.boiler(part)
        self.out.append("</body></html>")
        return "".join(self.out), self.labels


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, list[int]]]:
    """n pages as (html, the label of each of its texts in order)."""
    return [Writer(seed * 1_000_003 + i).page() for i in range(n)]
