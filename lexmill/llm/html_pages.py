"""Made-up pages with known main text, by rule, to train the block labeller on.

A page draws its layout (semantic tags, classed boxes, or tables), its order of parts, its words
(from invented syllables in several scripts) and its flaws (unclosed tags, missing ends) at random
from a seed. Every text run is written with its label, so no labelled page needs to be stored.
"""

from __future__ import annotations

import random

#: What boxes of each kind are called; a page uses a few of them.
CALLED = {
    "content": "content article post entry story main text body article-body post-content entry-content page-content main-content hentry blog-post prose",
    "nav": "nav menu navbar navigation main-nav breadcrumb breadcrumbs topnav site-nav toc pagination pager",
    "header": "header masthead banner topbar site-header page-header logo branding",
    "footer": "footer site-footer copyright legal bottom colophon page-footer",
    "side": "sidebar side widget related recommended popular trending aside rail more-stories tags secondary",
    "ad": "ad ads advert advertisement sponsor sponsored promo ad-slot adbox banner-ad",
    "notice": "cookie cookie-notice notice consent gdpr alert popup modal banner-message paywall",
    "comments": "comments comment-list comment disqus responses replies reactions discussion",
    "form": "form newsletter subscribe signup search login contact-form",
}
CALLED = {k: v.split() for k, v in CALLED.items()}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "content": "article"}
SAYS = {
    "notice": ["We use cookies to improve your experience.", "This site uses cookies.", "Accept all cookies", "Your privacy matters to us.", "Read our privacy policy"],
    "footer": ["Copyright {y} {w}", "&copy; {y} {w}. All rights reserved.", "&copy; {w}.example.com &middot; {w} {w}", "Terms of use", "Privacy policy", "Imprint", "Contact us"],
    "ad": ["Advertisement", "Sponsored", "Buy now and save {n}%", "Special offer: {w} {w}", "{w} {w} {w}."],
    "comments": ["{n} comments", "Reply", "{w} says:", "Posted by {w} {n} hours ago", "Leave a comment"],
    "form": ["Subscribe to our newsletter", "Your email", "Sign up", "Search", "Log in", "Send"],
    "side": ["Related", "Most read", "Popular posts", "Tags", "Follow us", "Share this"],
    "header": ["Skip to content", "{w} {w}", "Home", "Log in", "Welcome to {w}"],
}
SYLLABLES = [
    "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "é è ê eau eux tion ment que ou ai oi an en ch re pa vi le aux ier ç tre elle on".split(),
    "sch ein ung heit keit ü ö ä ß ver ge be er en lich te zu ach tz pf au st ie".split(),
    "ción os as ado ar er ie ue que ll rr ñ mente ez ja do ta ra co bo mi ci ga ó í".split(),
    "ст но то на ен ов ни ра во ко ер ал ка по ть".split(),
]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        w = "".join(self.r.choice(self.script) for _ in range(self.r.randint(1, 4)))
        return w + self.r.choice(self.noise) if self.noise else w

    def words(self, n: int) -> str:
        out = [self.word() for _ in range(n)]
        style = self.r.random()
        if style < 0.05:  # junk that a page may hold: words over and over, shouting, rows of bars
            out = [w for w in out[: 1 + n // 8] for _ in range(self.r.randint(4, 20))]
            n = len(out)
        elif style < 0.08:
            return " ".join(w.upper() + "!!" for w in out)
        elif style < 0.11:
            return " | ".join(out)
        for i in range(n):
            if i == 0 or self.r.random() < 0.12:
                out[i] = out[i].capitalize()
                if i:
                    out[i - 1] += self.r.choice(".,.")
        return " ".join(out) + self.r.choice([".", ".", ".", ""])

    def say(self, kind: str) -> str:
        return self.r.choice(SAYS[kind]).format(w=self.word(), n=self.r.randint(2, 90), y=self.r.randint(1999, 2026))

    def put(self, text: str, label: int) -> None:
        """A text run; the label stands in a mark that the reader of training pages takes out again."""
        self.out.append(f"\x01{label}{text}")

    def open(self, kind: str, semantic: bool) -> str:
        r = self.r
        if semantic and kind in TAGS:
            tag = "main" if kind == "content" and r.random() < 0.3 else TAGS[kind]
        else:
            tag = r.choice(["div", "div", "div", "section", "td"])
        if tag in ("div", "section", "td") or r.random() < 0.3:
            name = r.choice(CALLED[kind]) + r.choice(["", "", "", f"-{r.randint(1, 9)}", " box", " col-md-8", " clearfix"])
            tag_attr = f' {r.choice(["class", "class", "id"])}="{name}"'
        else:
            tag_attr = ""
        self.out.append(f"<{tag}{tag_attr}>")
        return tag

    def links(self, lo: int, hi: int, bare: bool = False) -> None:
        self.out.append("" if bare else "<ul>")
        for _ in range(self.r.randint(lo, hi)):
            self.out.append(("" if bare else "<li>") + f'<a href="/{self.r.randint(1, 999)}">')
            self.put(self.word() if self.r.random() < 0.7 else self.words(self.r.randint(2, 7)), 0)
            self.out.append("</a>" + (" " if bare else "</li>" if self.r.random() < 0.9 else ""))
        self.out.append("" if bare else "</ul>")

    def box(self, kind: str, semantic: bool) -> None:
        r = self.r
        tag = self.open(kind, semantic)
        if kind in ("nav", "header", "side") and r.random() < 0.85:
            if kind != "nav" and r.random() < 0.6:
                self.out.append(t := r.choice(["<h2>", "<h3>", "<p>", "<div>"]))
                self.put(self.say(kind), 0)
                self.out.append(t.replace("<", "</"))
            self.links(2, 9, r.random() < 0.25)
        elif kind == "form":
            self.out.append("<form><label>")
            self.put(self.say(kind), 0)
            self.out.append('</label><input name="q"><button>')
            self.put(self.say(kind), 0)
            self.out.append("</button></form>")
        else:
            if kind == "comments" and r.random() < 0.7:
                self.out.append("<h3>")
                self.put(self.say(kind), 0)
                self.out.append("</h3>")
            for _ in range(r.randint(1, 6 if kind == "comments" else 2)):
                t = r.choice(["p", "p", "div", "li", ""])
                self.out.append(f"<{t}>" if t else " ")
                self.put(self.say(kind) if kind in SAYS and r.random() < 0.55 else self.words(r.randint(2, 40 if kind == "comments" else 14)), 0)
                self.out.append(f"</{t}>" if t else "<hr>")
        self.out.append(f"</{tag}>" if r.random() < 0.97 or tag == "td" else "")

    def article(self, semantic: bool) -> None:
        r = self.r
        tag = self.open("content", semantic)
        inner = self.open("content", False) if r.random() < 0.25 else ""
        if r.random() < 0.85:
            self.out.append("<h1>")
            self.put(self.words(r.randint(1, 12)), 1)
            self.out.append("</h1>")
        loose = r.random() < 0.3
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 10, 20])):
            kind = r.random()
            if kind < 0.8:
                self.out.append("<p>" + r.choice(["", "", "", "<b>", "<em>"]))
                self.put(self.words(r.choice([1, 1, 2, 3, 8, 20, 40, 80, 150])), 1)
                if r.random() < 0.15:
                    self.out.append(r.choice(["<br>", "<br/>"]))
                    r.random() < 0.5 and self.put(self.words(r.randint(1, 20)), 1)
                if r.random() < 0.2:
                    self.out.append('<a href="/x">')
                    self.put(self.word(), 1)
                    self.out.append("</a> ")
                self.out.append("" if loose and r.random() < 0.6 else "</p>")
            elif kind < 0.87:
                self.out.append(h := r.choice(["<h2>", "<h3>", "<h4>"]))
                self.put(self.words(r.randint(1, 6)), 1)
                self.out.append(h.replace("<", "</"))
            elif kind < 0.93:
                self.out.append("<ul>" if r.random() < 0.7 else "<ol>")
                for _ in range(r.randint(2, 5)):
                    self.out.append("<li>")
                    self.put(self.words(r.randint(3, 18)), 1)
                    self.out.append("</li>")
                self.out.append("</ul>")
            elif kind < 0.96:
                self.out.append("<blockquote>")
                self.put(self.words(r.randint(5, 30)), 1)
                self.out.append("</blockquote>")
            else:
                self.box(r.choice(["ad", "side", "form", "notice"]), semantic)
        if r.random() < 0.12:
            self.box("comments", semantic)
        if r.random() < 0.1:
            self.box("side", semantic)
        self.out.append((f"</{inner}>" if inner else "") + f"</{tag}>")

    def page(self) -> str:
        r = self.r
        self.script, self.noise = r.choice(SYLLABLES), r.choice([None, None, None, None, ["***", "###", "%%%", "$$$", "&amp;&amp;&amp;"]])
        self.out = ['<!DOCTYPE html><html lang="xx"><head><meta charset="utf-8"><title>']
        self.put(self.words(r.randint(1, 10)), 0)
        self.out.append('</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>')
        semantic = r.random() < 0.6
        before = [k for k in ("header", "nav", "notice", "ad", "side", "form") if r.random() < {"nav": 0.85, "header": 0.5, "ad": 0.5}.get(k, 0.2)]
        after = [k for k in ("comments", "side", "ad", "form", "nav", "notice", "footer") if r.random() < {"footer": 0.9, "comments": 0.3, "side": 0.3}.get(k, 0.15)]
        table = not semantic and r.random() < 0.2
        wrap = [f'<div class="{r.choice(["wrapper", "container", "page", "row", "layout"])}">' for _ in range(r.choice([0, 0, 0, 1, 2]))]
        self.out += wrap + ["<table><tr>"] * table
        for k in before:
            self.box(k, semantic and r.random() < 0.9)
        self.article(semantic)
        for k in after:
            self.box(k, semantic and r.random() < 0.9)
        self.out.append("</tr></table>" * table + "</div>" * len(wrap) + ("</body></html>" if r.random() < 0.9 else ""))
        return "".join(self.out)


def pages(n: int, seed: int) -> list[str]:
    """Marked pages; in a block's text each run begins with a mark and its label."""
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
