"""Made-up pages with known main text, from which the block labeller learns.

No page of the corpus is labelled, so the labeller is taught on generated ones: many layouts,
element and attribute names, languages of invented words, and slips such as unclosed tags. Main
text is marked with a private character, which is taken away before anything is learned.
"""

from __future__ import annotations

import random

MARK = ""

_SYLLABLES = ("the er in on ti es an re at ha", "le que ou on ai é eau tion la re", "der en ung sch ei ä st ver be ich", "la os ción de ar ie ñ do que es", "wo ni ta ko ru sa mi lo pe du", "ни ко ла на то ре по ва ми ст")
_MENU = "Home About Contact News Sport Blog Login Register Shop Products Services Help FAQ Archive Topics Weather Video".split()
_MAIN = "content article post entry body main story text single prose page-content post-content entry-content article-body story-body post-body rich-text".split()
_SIDE = "sidebar aside widget right-col rail secondary side widgets sidebar-right sidebar-left".split()
_AD = "ad ads advert advertisement banner sponsor sponsored promo ad-slot ad-container adsbygoogle promotion commercial".split()
_NOTICE = "cookie cookie-notice consent notice gdpr popup modal alert banner-notice cookie-banner disclaimer paywall overlay info-bar".split()
_COMMENTS = "comments comment-list discussion responses reader-comments commentlist disqus user-comments replies".split()
_COMMENT = "comment comment-body reply comment-text response comment-content user-comment".split()
_NAV = "nav menu navbar navigation main-menu topnav site-nav menu-bar links".split()
_HEADER = "header masthead site-header top topbar page-header branding".split()
_FOOTER = "footer site-footer bottom copyright legal colophon page-footer credits".split()
_FORM = "newsletter subscribe signup search login form search-form contact-form newsletter-signup".split()
_SHARE = "share social share-buttons social-links sharing".split()
_RELATED = "related recommended more more-stories read-next related-posts also-read teasers".split()
_CRUMBS = "breadcrumb breadcrumbs crumbs pagination pager tags tag-list".split()


class _Page:
    def __init__(self, r: random.Random):
        self.r = r
        self.syllables = r.choice(_SYLLABLES).split()
        self.named = r.random() < 0.8  # elements have telling names
        self.marked = False

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, lo: int, hi: int) -> str:
        w = [self.word() for _ in range(self.r.randint(lo, hi))]
        if len(w) > 4 and self.r.random() < 0.4:
            w[self.r.randrange(len(w) - 1)] += ","
        if self.r.random() < 0.08:
            w = [x + self.r.choice(("***", "&&&", "!!", "%%%", " |")) for x in w]
        text = " ".join(w)
        return text[:1].upper() + text[1:] + self.r.choice((".", ".", ".", "!", "?", ""))

    def text(self, lo: int, hi: int) -> str:
        out = " ".join(self.sentence(3, 18) for _ in range(self.r.randint(lo, hi)))
        if self.r.random() < 0.15:
            out = out.replace(" ", self.r.choice(("\n  ", "&nbsp;", " &amp; ", " <em>", "</b> ", "<br>")), 1)
        if self.r.random() < 0.15:
            out += f' <a href="/x">{self.sentence(1, 4)}</a>'
        return (MARK if self.marked else "") + out

    def attr(self, options: list[str]) -> str:
        if not self.named or self.r.random() < 0.1:
            return self.r.choice(("", "", ' class="c1"', ' class="row"', ' id="x7"'))
        name = self.r.choice(options)
        if self.r.random() < 0.3:
            name = self.r.choice((name + " clearfix", "site " + name, name + "-" + str(self.r.randint(1, 9)), "block-" + name))
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def boxed(self, tags: str, options: list[str], inside: str, sure: bool = False) -> str:
        tag = self.r.choice(tags.split())
        attr = self.attr(options) if not sure or self.named else f' class="{self.r.choice(options)}"'
        if sure and "=" not in attr:
            attr = f' class="{self.r.choice(options)}"'
        return f"<{tag}{attr}>{inside}</{tag}>"

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.r.choice(_MENU) if self.r.random() < 0.4 else self.sentence(1, 3)}</a></li>' for k in range(n))

    def menu(self) -> str:
        items = self.links(self.r.randint(3, 9))
        inside = f"<ul>{items}</ul>" if self.r.random() < 0.8 else items.replace("<li>", "").replace("</li>", " ")
        return self.boxed("nav nav div", _NAV, inside, sure=True)

    def header(self) -> str:
        inside = f"<a href='/'>{self.sentence(1, 3)}</a>" + (f"<p>{self.sentence(2, 8)}</p>" if self.r.random() < 0.5 else "") + (self.menu() if self.r.random() < 0.4 else "") + (self.form() if self.r.random() < 0.3 else "")
        return self.boxed("header header div", _HEADER, inside, sure=True)

    def footer(self) -> str:
        inside = self.r.choice(("&copy; ", "Copyright 2024 ", "")) + self.sentence(1, 4) + self.r.choice((" &middot; ", " | ", "<br>")) + self.sentence(3, 15)
        if self.r.random() < 0.4:
            inside = f"<p>{inside}</p><ul>{self.links(3)}</ul>" + (f"<p>{self.text(1, 2)}</p>" if self.r.random() < 0.4 else "")
        return self.boxed("footer footer div", _FOOTER, inside, sure=True)

    def ad(self) -> str:
        inside = self.text(1, 3) if self.r.random() < 0.6 else f"<p>{self.text(1, 2)}</p>" + self.r.choice(("", "<span>Advertisement</span>", "<a href='#'>Buy now</a>"))
        return self.boxed("div div aside section", _AD, inside, sure=True)

    def notice(self) -> str:
        inside = f"<p>{self.r.choice(('', 'We use cookies. ', 'Notice: '))}{self.text(1, 3)}</p>" + self.r.choice(("", "<button>OK</button>", "<a href='#'>Accept</a>"))
        if self.r.random() < 0.3:
            inside = self.text(1, 2)
        return self.boxed("div div section dialog aside", _NOTICE, inside, sure=True)

    def form(self) -> str:
        inside = self.r.choice(("", f"<p>{self.text(1, 2)}</p>", f"<h3>{self.sentence(1, 4)}</h3>")) + f"<label>{self.sentence(1, 3)}</label><input name=q><button>Go</button>"
        return f"<form{self.attr(_FORM)}>{inside}</form>" if self.r.random() < 0.7 else self.boxed("div section", _FORM, f"<form>{inside}</form>" + f"<p>{self.text(1, 1)}</p>", sure=True)

    def share(self) -> str:
        return self.boxed("div ul", _SHARE, "".join(f"<li><a href=#>{x}</a></li>" for x in ("Share", "Tweet", "E-mail", self.word())), sure=True)

    def related(self) -> str:
        inside = f"<h3>{self.sentence(1, 3)}</h3>" + "".join(f"<div><a href=/r><h4>{self.sentence(3, 9)}</h4></a><p>{self.text(1, 1)}</p></div>" if self.r.random() < 0.5 else f"<li><a href=/r>{self.sentence(3, 9)}</a></li>" for _ in range(self.r.randint(2, 4)))
        return self.boxed("div section aside", _RELATED, inside, sure=True)

    def sidebar(self) -> str:
        inside = "".join(self.r.choice((f"<h3>{self.sentence(1, 3)}</h3><ul>{self.links(4)}</ul>", f"<h4>{self.sentence(1, 3)}</h4><p>{self.text(1, 3)}</p>", f"<div>{self.text(1, 2)}</div>", self.ad(), self.form())) for _ in range(self.r.randint(1, 4)))
        return self.boxed("aside aside div", _SIDE, inside, sure=True)

    def comments(self) -> str:
        def one() -> str:
            body = f"<p>{self.text(1, 3)}</p>" if self.r.random() < 0.7 else self.text(1, 3)
            who = self.r.choice(("", f"<cite>{self.word()}</cite>", f"<span class=author>{self.word()}</span>", f"<h4>{self.word()}</h4>"))
            reply = self.r.choice(("", "<a href=#>Reply</a>"))
            return self.boxed("li div div article", _COMMENT, who + body + reply, sure=self.r.random() < 0.8)

        inside = self.r.choice(("", f"<h2>{self.sentence(1, 3)}</h2>", "<h3>Comments</h3>")) + "".join(one() for _ in range(self.r.randint(1, 6))) + self.r.choice(("", self.form()))
        return self.boxed("section div ol ul", _COMMENTS, inside, sure=True)

    def article(self) -> str:
        self.marked = True
        parts = []
        if self.r.random() < 0.8:
            head = f"<h1>{MARK}{self.sentence(1, 12)}</h1>"
            parts.append(f"<header>{head}</header>" if self.r.random() < 0.1 else head)
        for _ in range(self.r.choice((1, 2, 3, 5, 8, 13, 20))):
            kind = self.r.random()
            if kind < 0.68:
                tail = self.r.choice(("</p>", "</p>", "</p>", ""))
                parts.append(f"<p>{self.text(1, 6) if self.r.random() < 0.85 else MARK + self.sentence(1, 2)}{tail}")
            elif kind < 0.74:
                parts.append(f"<p><b>{MARK}{self.sentence(1, 12)}<br>")
            elif kind < 0.82:
                parts.append(f"<h{k}>{MARK}{self.sentence(1, 7)}</h{k}>" if (k := self.r.choice((2, 2, 3, 4))) else "")
            elif kind < 0.88:
                items = "".join(f"<li>{self.text(1, 1)}</li>" for _ in range(self.r.randint(2, 6)))
                parts.append(f"<ul>{items}</ul>" if self.r.random() < 0.6 else f"<ol>{items}</ol>")
            elif kind < 0.92:
                parts.append(f"<blockquote><p>{self.text(1, 3)}</p></blockquote>" if self.r.random() < 0.5 else f"<blockquote>{self.text(1, 3)}</blockquote>")
            elif kind < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{MARK}{self.sentence(1, 3)}</td><td>{MARK}{self.sentence(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.96:
                parts.append(f"<figure><img src=a.png><figcaption>{MARK}{self.sentence(3, 12)}</figcaption></figure>")
            elif kind < 0.98:
                parts.append(f"<div>{self.text(1, 4)}</div>")
            else:
                parts.append(f"<pre>{self.text(1, 2)}</pre>")
            if self.r.random() < 0.15:
                self.marked = False
                parts.append(self.r.choice((self.ad, self.ad, self.notice, self.form, self.share, self.related, self.sidebar))())
                self.marked = True
        self.marked = False
        if self.r.random() < 0.15:
            parts.append(self.share())
        if self.r.random() < 0.12:
            parts.append(self.comments())
        inside = "".join(parts)
        kind = self.r.random()
        if kind < 0.5:
            inside = f"<article{self.attr(_MAIN) if self.r.random() < 0.4 else ''}>{inside}</article>"
        elif kind < 0.65:
            inside = f"<main><article>{inside}</article></main>"
        elif kind < 0.75:
            inside = f"<main>{inside}</main>"
        else:
            inside = self.boxed("div div section td", _MAIN, inside, sure=kind < 0.95)
        return f'<div class="container">{inside}</div>' if self.r.random() < 0.25 else inside

    def html(self) -> str:
        r = self.r
        head = f'<head><meta charset="utf-8"><title>{self.sentence(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        before = [f for f, p in ((self.notice, 0.2), (self.header, 0.45), (self.menu, 0.75), (lambda: self.boxed("div nav ol", _CRUMBS, self.links(3), sure=True), 0.2), (self.ad, 0.5), (self.notice, 0.1), (self.sidebar, 0.2), (self.form, 0.1)) if r.random() < p]
        after = [f for f, p in ((self.share, 0.15), (self.ad, 0.25), (self.related, 0.3), (self.comments, 0.4), (self.sidebar, 0.3), (self.form, 0.2), (lambda: self.boxed("div nav", _CRUMBS, self.links(4), sure=True), 0.15), (self.footer, 0.85), (self.notice, 0.2)) if r.random() < p]
        if r.random() < 0.2:
            r.shuffle(after)
        parts = [f() for f in before] + [self.article()] + [f() for f in after]
        gap = r.choice(("", "\n", "<!-- x -->", "<script>track(1);</script>"))
        body = gap.join(parts)
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>" if r.random() < 0.9 else body


def page(seed: int) -> str:
    """A page whose main text is marked."""
    return _Page(random.Random(seed)).html()
