"""Generated pages that the extraction trees are fitted on.

Layouts, element names, attribute tokens and texts are drawn at random, so that
no single hint decides: main text may sit in an article, in a named or a bare
division or in a table cell; menus, adverts, sidebars, comments, notices, forms
and footers may have their own elements, tokens on a division, or just the links
in them.  Main text carries a mark that the labels are read from.
"""

from __future__ import annotations

import numpy as np

from salesengine.llm.html_extract import MARK

_SYLLABLES = "an be cor da el fi gu har is jo ka lum me nor ou pre qui ro sta ti ur ve wo xi yr za ção lé ñi über ть ма ".split()
_ENDS = (".", ".", ".", "!", "?", ",", "", "***", "!!", "###")


class _Page:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, *options):
        return options[self.rng.integers(len(options))]

    def words(self, low: int, high: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high + 1))))
        out = []
        for _ in range(n):
            w = "".join(self.pick(*_SYLLABLES) for _ in range(self.rng.integers(1, 4)))
            out.append((w.capitalize() if self.chance(0.12) else w) + (self.pick(*_ENDS) if self.chance(0.18) else ""))
        return " ".join(out) + ("" if self.chance(0.25) else ".")

    def attrs(self, *tokens: str) -> str:
        """class or id with one of the tokens, often with something beside it."""
        t = self.pick(*tokens)
        t = self.pick(t, t, f"{t}-{self.pick('box', 'wrap', 'area', 'inner', 'list', '1')}", f"{self.pick('js', 'c', 'x', 'block', 'page')}-{t}", f"{t} {self.pick('clearfix', 'col', 'row', 'large', 'left')}")
        return f' {self.pick("class", "class", "id")}="{t}"'

    # ---------------------------------------------------------- main text

    def inline(self, text: str) -> str:
        words = text.split(" ")
        if self.chance(0.25):
            k = self.rng.integers(len(words))
            tag = self.pick("b", "i", "em", "strong", "a href='/x'", "span", "code")
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
        return " ".join(words)

    def paragraph(self) -> str:
        text = MARK + self.inline(self.words(1, self.pick(3, 12, 60, 150)))
        kind = self.rng.random()
        if kind < 0.62:
            return f"<p>{text}</p>"
        if kind < 0.78:
            return f"<p><b>{text}<br>" if self.chance(0.6) else f"<p>{text}"
        if kind < 0.84:
            return f"<{self.pick('h2', 'h3', 'h4')}>{MARK}{self.words(1, 8)}</{self.pick('h2', 'h3')}>"
        if kind < 0.89:
            tag = self.pick("ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{MARK}{self.inline(self.words(1, 15))}" + self.pick("</li>", "") for _ in range(self.rng.integers(1, 6))) + f"</{tag}>"
        if kind < 0.92:
            return f"<blockquote>{self.pick('<p>', '')}{text}</blockquote>"
        if kind < 0.94:
            return f"<pre>{text}</pre>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{self.words(1, 4)}</td></tr>" for _ in range(self.rng.integers(1, 5))) + "</table>"
        return f"<div>{text}</div>"

    def main(self) -> str:
        parts = []
        if self.chance(0.8):
            title = f"<h1>{MARK}{self.words(1, 12)}</h1>"
            parts.append(f"<header>{title}</header>" if self.chance(0.15) else title)
        body = [self.paragraph() for _ in range(int(np.exp(self.rng.uniform(0, 3))))]
        while self.chance(0.3):
            body.insert(int(self.rng.integers(len(body) + 1)), self.noise_within())
        parts += body
        inner = self.pick("", "\n").join(parts)
        if self.chance(0.25):
            inner = f"<div{self.attrs('content', 'text', 'body', 'entry') if self.chance(0.5) else ''}>{inner}</div>"
        kind = self.rng.random()
        if kind < 0.45:
            inner = f"<article{self.attrs('post', 'article', 'entry', 'story') if self.chance(0.3) else ''}>{inner}</article>"
        elif kind < 0.55:
            inner = f"<main>{inner}</main>"
        elif kind < 0.82:
            inner = f"<{self.pick('div', 'section')}{self.attrs('content', 'post', 'article', 'entry', 'story', 'text', 'main')}>{inner}</div>"
        elif kind < 0.95:
            inner = f"<div>{inner}</div>"
        else:
            inner = f"<table><tr><td>{inner}</td></tr></table>"
        return f"<main>{inner}</main>" if self.chance(0.15) else inner

    # ---------------------------------------------------------- the rest

    def links(self, tag: str = "li", low: int = 2, high: int = 12) -> str:
        return "".join(f"<{tag}><a href='/{k}'>{self.words(1, 4)}</a></{tag}>" for k in range(self.rng.integers(low, high)))

    def prose(self) -> str:
        """Text that reads like any other."""
        return "".join(self.pick(f"<p>{self.words(1, 40)}</p>", self.words(1, 30), f"<p>{self.words(2, 15)} <a href='/x'>{self.words(1, 4)}</a></p>") for _ in range(self.rng.integers(1, 4)))

    def advert(self) -> str:
        tag = self.pick("div", "div", "section", "aside", "p", "ins")
        return f"<{tag}{self.attrs('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'sponsor')}>{self.words(1, 30) if tag in ('p', 'ins') else self.prose()}</{tag}>"

    def comments(self) -> str:
        item = self.pick("li", "div", "article")
        one = lambda: f"<{item}{self.attrs('comment', 'reply') if self.chance(0.7) else ''}>{self.pick('', f'<b>{self.words(1, 2)}</b>')}{self.prose()}</{item}>"
        inner = (f"<h3>{self.words(1, 3)}</h3>" if self.chance(0.6) else "") + "".join(one() for _ in range(self.rng.integers(1, 7)))
        return f"<{self.pick('section', 'div', 'div', 'ol')}{self.attrs('comments', 'comment', 'discussion', 'replies', 'reader comments')}>{inner}</div>"

    def sidebar(self) -> str:
        part = lambda: self.pick(f"<h4>{self.words(1, 4)}</h4><ul>{self.links()}</ul>", f"<div{self.attrs('widget', 'related', 'popular', 'teaser')}>{self.prose()}</div>", self.prose(), f"<ul>{self.links()}</ul>")
        inner = "".join(part() for _ in range(self.rng.integers(1, 4)))
        return self.pick(f"<aside>{inner}</aside>", f"<aside{self.attrs('sidebar', 'related')}>{inner}</aside>", f"<div{self.attrs('sidebar', 'side', 'widget', 'related', 'rail', 'recommended')}>{inner}</div>")

    def menu(self) -> str:
        inner = self.pick(f"<ul>{self.links()}</ul>", self.links("div"), "".join(f"<a href='/{k}'>{self.words(1, 3)}</a> " for k in range(self.rng.integers(2, 9))))
        return self.pick(f"<nav>{inner}</nav>", f"<nav{self.attrs('nav', 'menu')}>{inner}</nav>", f"<div{self.attrs('nav', 'menu', 'breadcrumb', 'pagination')}>{inner}</div>", f"<div>{inner}</div>")

    def header(self) -> str:
        inner = self.pick(f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(1, 12)}</p>", f"<div{self.attrs('logo', 'branding')}>{self.words(1, 3)}</div>", self.prose()) + (self.menu() if self.chance(0.5) else "")
        return self.pick(f"<header>{inner}</header>", f"<header{self.attrs('header', 'masthead', 'site')}>{inner}</header>", f"<div{self.attrs('header', 'masthead', 'topbar')}>{inner}</div>")

    def footer(self) -> str:
        inner = self.pick(f"&copy; {self.words(1, 30)}", self.prose(), f"<ul>{self.links()}</ul>", f"<p>&copy; {self.words(1, 10)}</p><ul>{self.links()}</ul>")
        return self.pick(f"<footer>{inner}</footer>", f"<footer{self.attrs('footer', 'legal')}>{inner}</footer>", f"<div{self.attrs('footer', 'copyright', 'legal', 'foot')}>{inner}</div>")

    def notice(self) -> str:
        return f"<{self.pick('div', 'div', 'section', 'dialog', 'aside')}{self.attrs('cookie', 'consent', 'notice', 'banner', 'popup', 'modal', 'alert', 'privacy')}>{self.prose()}{self.pick('', '<button>ok</button>', '<a href=x>ok</a>')}</div>"

    def form(self) -> str:
        inner = "".join(self.pick(f"<label>{self.words(1, 5)}</label><input>", f"<p>{self.words(1, 25)}</p>", f"<input><button>{self.words(1, 2)}</button>", f"<select><option>{self.words(1, 2)}</select>") for _ in range(self.rng.integers(1, 5)))
        form = f"<form{self.attrs('form', 'search', 'newsletter', 'subscribe', 'login') if self.chance(0.4) else ''}>{inner}</form>"
        return f"<div{self.attrs('newsletter', 'subscribe', 'signup', 'search')}>{self.words(1, 20)}{form}</div>" if self.chance(0.3) else form

    def share(self) -> str:
        return f"<{self.pick('div', 'ul', 'p')}{self.attrs('share', 'social', 'tags', 'tools')}>{self.pick(self.links('span', 1, 5), self.words(1, 6))}</div>"

    def noise_within(self) -> str:
        return self.pick(self.advert, self.advert, self.share, self.sidebar, self.form, self.comments, self.menu, self.notice)()

    def page(self) -> str:
        before = [f() for f in (self.notice, self.header, self.menu, self.advert, self.form, self.sidebar) if self.chance(0.4)]
        after = [f() for f in (self.comments, self.sidebar, self.advert, self.menu, self.form, self.notice, self.share) if self.chance(0.3)]
        self.rng.shuffle(before)
        self.rng.shuffle(after)
        if self.chance(0.8):
            after.append(self.footer())
        main = self.main() if self.chance(0.97) else ""
        middle = "".join([*before, main, *after])
        if self.chance(0.3):
            middle = f"<div{self.pick('', ' id=page', ' class=wrapper', ' class=container')}>{middle}</div>"
        comment = "<!-- x -->" if self.chance(0.5) else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{comment}{middle}</body></html>"


def training_page(rng: np.random.Generator) -> str:
    return _Page(rng).page()
