"""Labelled pages for fitting the extractor, made from a grammar of page parts.

Every part says whether it is content; the mark is the attribute ``data-label`` (1 content, 0 other), which holds for
all elements inside. The wording is noise on purpose: labels have to be learned from structure.
"""
from __future__ import annotations

import random

SYLLABLES = "ba con de er fi go ha in ja ko lu mer no or pa qui ra sto tu un ver wi xe yo zu".split()
# Names that sites give to parts of a page
CONTENT_NAMES = """content article article-body post post-content post-body entry entry-content main main-content story story-body text body-text page-content
 blog-post single-post article__content articleBody content-area rich-text prose markdown""".split()
OTHER_NAMES = {
    "menu": "menu nav navbar navigation main-menu breadcrumb breadcrumbs topbar toc-links pagination pager site-nav skip-link".split(),
    "header": "header site-header masthead banner logo branding top-header page-header".split(),
    "footer": "footer site-footer copyright colophon bottom legal".split(),
    "side": "sidebar side widget related related-posts recommended recommendations trending popular archive tag-cloud author-box".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay newsletter subscribe paywall promo-bar disclaimer".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo banner-ad adsense teaser-ad outbrain".split(),
    "share": "share social social-links share-buttons follow print-links".split(),
    "comment": "comments comment comment-list commentlist respond reply disqus discussion reader-comments comments-area user-comments".split(),
    "form": "search search-form login signup contact-form form subscribe-form".split(),
}
TAGS = {"menu": ["nav", "ul", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "notice": ["div", "section", "aside", "dialog"],
        "advert": ["div", "aside", "section", "ins"], "share": ["div", "ul"], "comment": ["section", "div", "ol", "ul"], "form": ["form", "div"]}


class Grammar:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r, out = self.r, []
        style = r.random()
        for _ in range(r.randint(low, high)):
            w = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
            if style > 0.9:
                w = w.upper() + "!!"
            elif style > 0.8:
                w += r.choice(["***", "%%%", "&amp;&amp;", "###", " |"])
            elif r.random() < 0.12:
                w += r.choice([".", ",", ".", ";"])
            out.append(w)
        return " ".join(out)

    def inline(self, text: str) -> str:
        r, out = self.r, []
        for w in text.split(" "):
            if r.random() < 0.03:
                tag = r.choice(["b", "i", "a", "em", "strong", "span", "code", "sup"])
                out.append(f'<a href="/x">{w}</a>' if tag == "a" else f"<{tag}>{w}</{tag}>")
            else:
                out.append(w)
        return " ".join(out)

    def name(self, names: list[str]) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        return f' {r.choice(["class", "class", "id"])}="{" ".join(r.sample(names, r.randint(1, 2)))}"'

    def paragraphs(self, most: int = 9) -> str:
        r, out = self.r, []
        for _ in range(r.randint(1, most)):
            text = self.inline(self.words(1, r.choice([6, 40, 120])))
            kind = r.random()
            if kind < 0.7:
                out.append(f"<p>{text}</p>")
            elif kind < 0.76:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.8:
                out.append(f"<h{r.randint(2, 4)}>{self.words(1, 8)}</h2>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{self.inline(self.words(1, 15))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<div>{text}</div>")
            elif kind < 0.94:
                out.append(f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>")
            elif kind < 0.97:
                out.append(f'<figure><img src="a.png"><figcaption>{self.words(2, 12)}</figcaption></figure>')
            else:
                out.append(f"{text}<br>{self.words(1, 9)}")
        return "".join(out)

    def other(self, kind: str) -> str:
        r = self.r
        tag = r.choice(TAGS[kind])
        link = lambda: f'<a href="/p">{self.words(1, 4)}</a>'
        if kind in ("menu", "share"):
            items = "".join(f"<li>{link()}</li>" if tag == "ul" or r.random() < 0.6 else link() for _ in range(r.randint(2, 8)))
            body = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "header":
            body = r.choice([f"<h1>{self.words(1, 4)}</h1>", f'<div class="logo">{link()}</div>', f"<p>{self.words(2, 9)}</p>"]) + (self.other("menu") if r.random() < 0.4 else "")
        elif kind == "footer":
            body = r.choice([f"&copy; {self.words(2, 20)}", f"<p>&copy; {self.words(2, 30)}</p>", f"<p>{self.words(3, 40)}</p><ul><li>{link()}</li><li>{link()}</li></ul>"])
        elif kind == "side":
            body = f"<h3>{self.words(1, 4)}</h3>" + r.choice([f"<ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{self.words(4, 50)}</p>", f"<div>{link()} {self.words(3, 20)}</div>"])
        elif kind == "form":
            body = f'<label>{self.words(1, 4)}</label><input type="text"><button>{self.words(1, 2)}</button>' + (f"<p>{self.words(2, 12)}</p>" if r.random() < 0.4 else "")
        elif kind == "comment":
            one = lambda: r.choice([f"<li><p>{self.words(3, 60)}</p></li>", f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.words(3, 60)}</p></div>', f"<p>{self.words(3, 60)}</p>"])
            body = (f"<h3>{self.words(1, 3)}</h3>" if tag in ("div", "section") else "") + "".join(one() for _ in range(r.randint(1, 5)))
        else:
            body = r.choice([self.words(3, 25), f"<p>{self.words(3, 40)}</p>", f"<p>{self.words(3, 25)}</p><button>{self.words(1, 2)}</button>", f"{self.words(2, 12)} {link()}"])
        named = self.name(OTHER_NAMES[kind])
        if tag in ("div", "section", "ul", "ol") and not named:
            named = f' class="{r.choice(OTHER_NAMES[kind])}"'
        return f'<{tag}{named} data-label="0">{body}</{tag}>'

    def content(self) -> str:
        r = self.r
        tag = r.choice(["article", "article", "main", "div", "div", "section", "td"])
        named = self.name(CONTENT_NAMES)
        if tag in ("div", "section", "td") and not named:
            named = f' class="{r.choice(CONTENT_NAMES)}"'
        title = f"<h1>{self.words(1, 10)}</h1>" if r.random() < 0.8 else ""
        inside = [self.paragraphs()]
        for kind, chance in (("advert", 0.15), ("share", 0.15), ("side", 0.1), ("comment", 0.1), ("form", 0.06), ("notice", 0.06)):
            if r.random() < chance:
                inside += [self.other(kind), self.paragraphs(3)] if kind == "advert" else [self.other(kind)]
        body = title + "".join(inside)
        if r.random() < 0.25:
            body = f"<div{self.name(CONTENT_NAMES)}>{body}</div>"
        out = f'<{tag}{named} data-label="1">{body}</{tag}>'
        return f"<table><tr>{out}</tr></table>" if tag == "td" else out

    def page(self) -> str:
        r = self.r
        before = [k for k, c in (("notice", 0.3), ("header", 0.5), ("menu", 0.7), ("advert", 0.4), ("form", 0.2)) if r.random() < c]
        after = [k for k, c in (("share", 0.3), ("side", 0.4), ("comment", 0.4), ("advert", 0.3), ("form", 0.15), ("menu", 0.1), ("notice", 0.15), ("footer", 0.8)) if r.random() < c]
        r.shuffle(before)
        inner = "".join(map(self.other, before)) + self.content() + "".join(map(self.other, after))
        if r.random() < 0.35:
            inner = f'<div class="{r.choice(["wrapper", "container", "page", "site", "row", "layout"])}">{inner}</div>'
        return f'<!DOCTYPE html><html data-label="0"><head><title>{self.words(1, 8)}</title></head><body>{inner}</body></html>'


def labelled_page(number: int) -> str:
    """The labelled page of this number; the same on every run."""
    return Grammar(number).page()
