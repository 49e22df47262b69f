"""Pages as sequences of leaf blocks, and made-up pages whose blocks are labelled."""

from __future__ import annotations

import functools
import html
import random
import re
from bisect import bisect_left
from dataclasses import dataclass

# Elements by the way in which they cut text.
HIDDEN = frozenset("title script style noscript template svg iframe object canvas audio video datalist".split())
#: What a head can hold; any other tag or text ends it.
IN_HEAD = frozenset("title meta link base basefont bgsound noframes script style noscript template head html".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(
    "html body main article section aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption form fieldset legend label button select option textarea address details summary dialog hr center menu".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDS = BREAKS - {"label", "button", "select", "option", "textarea", "html", "body"}
SCOPES = frozenset("html body main article section aside nav header footer div ul ol dl table blockquote figure form fieldset td th details".split())

#: Elements deeper than this stand beside the one at this depth, as in browsers, whose bound is 512; and what is read of an element's attributes for its marks.
DEEPEST, ATTRIBUTES, MARKS = 100, 4096, 32

OPENS = re.compile(r"</?[a-zA-Z]")
SPECIAL, NAME_END = re.compile("[>\"']"), re.compile(r"[\s/>]")
BROKEN = re.compile(r"</?[a-zA-Z][^<>]*+>?")
NUMBER = re.compile(r"&#([0-9]{8,})")
NAMED = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Tags that end an svg, unless they stand in a part of it that holds HTML.
LEAVES_SVG = re.compile(r"<(?:(foreignobject|desc|title)|" + "|".join(sorted(P_ENDS | {"body", "br", "img", "span"})) + r")(?=[\s/>])", re.I)


class Scanner:
    """Pieces of a page, in time that grows with its length whatever it holds: what a search found or missed is kept for the searches that start before that place."""

    def __init__(self, page: str):
        self.page, self.kept = page, {}
        self.special = [m.start() for m in SPECIAL.finditer(page)]
        # Where a tag ends whose attributes go on at each of these: quotes are passed over as pairs; -1 if it doesn't end.
        n, ends, later = len(self.special), [-1] * len(self.special), {}
        for k in range(n - 1, -1, -1):
            c = page[self.special[k]]
            if c == ">":
                ends[k] = self.special[k]
            else:
                pair = later.get(c, n) + 1
                ends[k] = ends[pair] if pair < n else -1
                later[c] = k
        self.ends = ends

    def found(self, what: str, pattern: re.Pattern, at: int) -> re.Match | None:
        """The first match from ``at``, which only grows."""
        start, m = self.kept.get(what, (None, None))
        if start is None or m is not None and m.start() < at:
            m = pattern.search(self.page, at)
            self.kept[what] = (at, m)
        return m

    def place(self, text: str, at: int) -> int:
        """The first place of a text from ``at``, which only grows; -1 if there is none."""
        start = self.kept.get(text, -2)
        if start != -1 and start < at:
            self.kept[text] = start = self.page.find(text, at)
        return start

    def piece(self, at: int) -> tuple[int, str, str | None, bool, str]:
        """Where the piece at ``at`` ends, and its text; or a tag's name, whether it closes, and its attributes."""
        page = self.page
        if page[at] != "<":
            end = self.place("<", at)
            end = len(page) if end < 0 else end
            return end, page[at:end], None, False, ""
        if page.startswith("<!--", at):
            end = self.place("-->", at + 4)
            return (len(page) if end < 0 else end + 3), "", None, False, ""
        if page.startswith("<![CDATA[", at) and (end := self.place("]]>", at + 9)) >= 0:
            return end + 3, page[at + 9 : end], None, False, ""
        if OPENS.match(page, at):
            closing = page[at + 1] == "/"
            name = at + 1 + closing
            m = self.found("a name's end", NAME_END, name + 1)
            if m:
                k = bisect_left(self.special, m.start())
                end = self.ends[k] if k < len(self.special) else -1
                if end >= 0:
                    return end + 1, "", page[name : m.start()], closing, page[m.start() : end]
            return BROKEN.match(page, at).end(), "", None, False, ""
        if page.startswith(("<!", "<?"), at) and (end := self.place(">", at + 2)) >= 0:
            return end + 1, "", None, False, ""
        return at + 1, "<", None, False, ""

    def hidden_end(self, tag: str, at: int) -> int:
        """Where a hidden element that opened before ``at`` ends. Without an end tag only scripts and styles go on to the end of the page."""
        end = self.found(f"the end of {tag}", re.compile(rf"</{re.escape(tag)}\s*+>", re.I), at)
        if tag == "svg":
            out = self.found("what leaves svg", LEAVES_SVG, at)
            if out and (not end or out.end() < end.start()) and (not out[1] or not end):
                return out.start() if not out[1] else at
        if end:
            return end.end()
        if tag in ("script", "style"):
            return len(self.page)
        more = self.place("<", at) if tag in ("title", "svg") else at
        return len(self.page) if more < 0 else more


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


@functools.lru_cache(1 << 14)
def marks_of(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's tag and the words of its class, id and role."""
    out = [tag]
    for m in NAMED.finditer(attributes):
        for word in PARTS.findall(m[2] or m[3] or m[4] or ""):
            out.append(f".{word.lower()}")
    return tuple(dict.fromkeys(out))[:MARKS]


def unescaped(text: str) -> str:
    """Character references decoded; numbers of many digits are cut first, as they stand for no character."""
    return html.unescape(NUMBER.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or '0'}", text))


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; scripts, styles, comments and the head have none. Unclosed elements end with their parent."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    words: list[str] = []
    linked = link = at = 0
    head = False
    path: tuple[str, ...] | None = None

    def flush() -> None:
        nonlocal words, linked
        text = " ".join(unescaped("".join(words)).split())
        if text:
            out.append(Block(path if path is not None else where(), text, linked))
        words, linked = [], 0

    def where() -> tuple[str, ...]:
        return tuple(m for _, marks in stack for m in marks)

    scan = Scanner(page)
    while at < len(page):
        at, raw, tag, closing, attributes = scan.piece(at)
        if tag is None:
            if head and not raw.strip():
                continue
            if raw:
                head = False
                if path is None:
                    path = where()
                words.append(raw)
                linked += len(raw) if link else 0
            continue
        tag = tag.lower()
        if tag == "head":
            head = not closing
            continue
        head = head and tag in IN_HEAD
        if tag in HIDDEN and not closing:
            if not attributes.rstrip().endswith("/"):
                at = scan.hidden_end(tag, at)
            words.append(" ")
        elif tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            words.append(" ")
        elif tag in BREAKS:
            flush()
            path = None
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag not in VOID:
                ends = CLOSES.get(tag, set()) | ({"p"} if tag in P_ENDS else set())
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPES and not (tag in ("td", "th", "tr") and stack[k][0] in ("td", "th")):
                        break
                if len(stack) == DEEPEST:
                    stack.pop()
                stack.append((tag, marks_of(tag, attributes[:ATTRIBUTES])))
                link = 0
    flush()
    return out


# --- made-up pages -----------------------------------------------------------------------------

# Names that sites give to what is and what isn't their text, and what stands in the latter.
CHROME = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs site-menu main-nav tabs pagination pager toc",
    "header": "header masthead site-header topbar banner branding logo",
    "footer": "footer site-footer colophon bottom copyright legal",
    "aside": "sidebar widget related recommended trending popular rail side more-stories tags tagcloud",
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted banner-ad adsense dfp",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay subscribe newsletter signup paywall",
    "form": "form search login register contact subscribe-form searchbox",
    "comments": "comments comment comment-list replies discussion respond disqus reader-comments",
    "share": "share social sharing follow buttons toolbar",
}
CONTENT = "content post entry article story body main text post-content entry-content article-body story-body page-content page prose markdown"
PHRASES = {
    "nav": "Home|About|Contact|News|Products|Sign in|Shop|Blog|Help|Next|Previous|Start|Accueil|Inicio|Kontakt",
    "header": "Daily News|Skip to content|Menu|Search|Welcome|My account|Subscribe now",
    "footer": "© 2024 Example|All rights reserved.|Privacy policy|Terms of use|Imprint|Sitemap|Powered by Example|© example.com",
    "aside": "Related articles|Most read|You may also like|Trending now|Latest posts|Archives|Categories|Read more",
    "ad": "Advertisement|Sponsored|Buy now and save|Limited offer|Shop today|Anzeige|Publicité",
    "notice": "We use cookies to improve your experience.|Accept all|Subscribe to our newsletter|Manage preferences|Your session will expire|Please enable JavaScript",
    "form": "Email address|Password|Submit|Search|Your name|Log in|Send|Choose an option",
    "comments": "Reply|Report|3 comments|Leave a comment|Posted by anna at 10:12|Great article, thanks!|I disagree with this.|Like",
    "share": "Share on Facebook|Tweet|Print|Email this|Copy link|Follow us",
}


class PageMaker:
    """Makes pages of many layouts; each leaf's label comes with its text."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        r = self.rng
        parts = "an be co du er fi ga ho in jo ka le mi no ou pa qui re st th un vi wo xe ya zu é ü ción ment ing tion heit".split()
        return "".join(r.choice(parts) for _ in range(r.choice([1, 1, 2, 2, 3, 4]))) + (r.choice(["***", "&&&", "###", "$$$"]) if self.noisy and r.random() < 0.9 else "")

    def sentence(self, n: int) -> str:
        words = [self.word() for _ in range(n)]
        return " ".join(words).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ""])

    def text(self) -> str:
        r = self.rng
        return " ".join(self.sentence(r.choice([1, 3, 8, 14])) for _ in range(r.choice([1, 1, 2, 3, 6, 12])))

    def leaf(self, tag: str, text: str, label: int, link: bool = False) -> str:
        self.leaves.append((" ".join(text.split()), label))
        r = self.rng
        body = html.escape(text, quote=r.random() < 0.3)
        if link:
            body = f'<a href="/{r.randrange(999)}">{body}</a>'
        elif r.random() < 0.15:
            body = f"<b>{body}</b>" if r.random() < 0.7 else f"<b>{body}<br>"
        return f"<{tag}>{body}" + ("" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>")

    def opened(self, tag: str, names: str, always: bool = False) -> tuple[str, str]:
        r = self.rng
        kind = ""
        if always or r.random() < 0.7:
            name = r.choice(names.split())
            kind = f' {r.choice(["class", "class", "id"])}="{name}{r.choice(["", "", "-1", " box", " wrapper"])}"'
        return f"<{tag}{kind}>", f"</{tag}>"

    def chrome(self, kind: str) -> str:
        r = self.rng
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = semantic if semantic and r.random() < 0.6 else r.choice(["div", "div", "section", "ul" if kind in ("nav", "share") else "div"])
        a, b = self.opened(tag, CHROME[kind], always=tag not in ("nav", "header", "footer", "aside", "form"))
        listed = kind in ("nav", "share") and r.random() < 0.8 or kind in ("aside", "footer") and r.random() < 0.4
        inner = []
        for _ in range(r.choice([1, 2, 4, 7]) if listed or kind in ("comments", "aside") else r.choice([1, 1, 2])):
            text = r.choice(PHRASES[kind].split("|")) if r.random() < 0.45 else self.sentence(r.choice([1, 1, 2, 4, 9])) if kind != "comments" else self.text()
            if kind == "footer" and r.random() < 0.4:
                text = f"© {self.word()}.example.com · {self.sentence(r.choice([3, 8, 12]))}"
            if listed:
                inner.append(self.leaf("li", text, 0, link=r.random() < 0.9))
            else:
                inner.append(self.leaf(r.choice(["p", "div", "p", "h3", "label" if kind == "form" else "div"]), text, 0, link=r.random() < 0.3))
        if listed and tag != "ul":
            inner = ["<ul>", *inner, "</ul>"]
        elif len(inner) == 1 and r.random() < 0.5 and tag != "ul":  # text that stands in the element itself
            text = self.leaves.pop()[0]
            self.leaves.append((text, 0))
            inner = [html.escape(text)]
        return a + "".join(inner) + b

    def article(self) -> str:
        r = self.rng
        tag = r.choice(["article", "article", "main", "div", "section"])
        a, b = self.opened(tag, CONTENT, always=tag not in ("article", "main"))
        out = [self.leaf("h1", self.sentence(r.choice([1, 4, 9, 14])), 1)] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 3, 6, 12, 25])):
            what = r.random()
            if what < 0.78:
                out.append(self.leaf("p" if r.random() < 0.9 else "div", self.text(), 1))
            elif what < 0.84:
                out.append(self.leaf(r.choice(["h2", "h3"]), self.sentence(r.choice([1, 3, 6])), 1))
            elif what < 0.89:
                out += ["<ul>", *(self.leaf("li", self.sentence(r.choice([2, 6, 12])), 1) for _ in range(r.choice([2, 4]))), "</ul>"]
            elif what < 0.92:
                out.append(self.leaf(r.choice(["blockquote", "figcaption", "pre"]), self.text(), 1))
            elif what < 0.95:
                out += ["<table><tr>", *(self.leaf("td", self.sentence(2), 1) for _ in range(3)), "</tr></table>"]
            else:
                out.append(self.chrome(r.choice(["ad", "share", "aside", "notice"])))
        return a + "".join(out) + b

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        r = self.rng
        self.leaves: list[tuple[str, int]] = []
        self.noisy = r.random() < 0.15
        pick = lambda kinds, p: [self.chrome(k) for k in kinds if r.random() < p]
        out = ["<!DOCTYPE html><html><head><meta charset='utf-8'><title>", html.escape(self.sentence(4)), '</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>']
        out += pick(["notice"], 0.25) + pick(["header"], 0.4) + pick(["nav"], 0.8) + ["<!-- ad -->"] + pick(["ad"], 0.5) + pick(["form"], 0.2)
        sides = pick(["aside"], 0.35)
        wrap = self.opened("div", "wrapper container page row layout") if r.random() < 0.5 else ("", "")
        out += [wrap[0]] + (sides if r.random() < 0.3 else [])
        out.append(self.article())
        out += pick(["share"], 0.25) + pick(["comments"], 0.3) + pick(["aside"], 0.3) + pick(["ad"], 0.25) + [wrap[1]]
        out += pick(["form", "notice"], 0.15) + pick(["footer"], 0.85)
        if r.random() < 0.8:
            out.append("</body></html>")
        return "".join(out), self.leaves
