"""One page's HTML as a flat list of typed blocks: the small helper inside the ``html_blocks`` hop.

Three passes over a tree of elements: what they hold is summed up from the
leaves, noise is cut off, and the rest is read in order.  Text is read as
spans that carry the marks of all elements around them.  Pictures, videos,
code and tables inside running text wait until its block is written and come
right after it.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlsplit

# fixed values
DROP = {"script", "style", "noscript", "template", "form", "button", "input", "select", "textarea", "nav", "aside", "footer", "svg", "canvas"}
DROP_ROLES = {"navigation", "banner", "complementary"}
NOISE_NAME = re.compile(r"(^|[-_])(ad|ads|adv|advert\w*|sponsor\w*|promo\w*|newsletter\w*|subscribe\w*|cookie\w*|popup\w*|banner\w*|paywall\w*|outbrain|taboola)([-_]|$)", re.I)
SHARE_RELATED_COMMENT = re.compile(r"(^|[-_])(share|sharing|sharedaddy|related(?![-_]work)|relatedposts|comments?)([-_]|$)", re.I)
MODAL_NAME = re.compile(r"^modal(-\w*)?$", re.I)
AD_DATA_ATTR = re.compile(r"^data-ads?(-|$)", re.I)
CONTENT_CLASSES = {"entry-content", "post-content", "article-body", "article-content", "post-body", "story-body", "markdown-body"}
NOISE_IDS = {"comments", "respond", "disqus_thread", "related-posts", "jp-relatedposts"}
SMALLEST_IMAGE = 64

#: White space of scripts in pages.
SPACE = re.compile(r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
RUNNING = {"a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "data", "del", "dfn", "em", "i", "ins", "kbd", "label", "mark", "math", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr"}
LEVELS = {"h1": 2, "h2": 2, "h3": 3, "h4": 4, "h5": 4, "h6": 4}
#: A running element around one of these is read as a block.
PARTING = {*LEVELS, "p", "ul", "ol", "pre", "table", "blockquote", "figure"}
MARKS = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic"}
VERBATIM = {"code", "kbd", "samp"}
LANGUAGE = re.compile(r"(?:language|lang|highlight-source)-([\w+#-]+)")
YOUTUBE_HOST, YOUTUBE_PATH, YOUTUBE_ID = re.compile(r"^(www|m|music)\."), re.compile(r"^/(?:shorts|embed|live)/([\w-]+)"), re.compile(r"[A-Za-z0-9_-]{11}")
VIMEO_HOST, VIMEO_PATH = re.compile(r"(^|\.)player\.vimeo\.com$"), re.compile(r"^/video/(\d+)")

#: What stands outside the page's text.
HEAD = {"head", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"}
#: HTML's rules for end tags that may be left out: which innermost open elements a start tag ends.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", *LEVELS}
ENDS = {**{t: {"p"} for t in ENDS_P}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS |= {t: {"thead", "tbody", "tfoot", "tr", "td", "th", "p"} for t in ("thead", "tbody", "tfoot")}
#: Elements nest this deep; deeper ones stand beside each other, as in browsers.
DEEPEST = 2000


def dropped(tag: str, attrs: dict) -> bool:
    return tag in DROP or tag in HEAD or attrs.get("role") in DROP_ROLES or attrs.get("aria-hidden") == "true"


def holds_content(tag: str, attrs: dict) -> bool:
    return tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody" or bool(CONTENT_CLASSES & set((attrs.get("class") or "").split()))


def named(names: list[str]) -> bool:
    return any(rule.search(x) for x in names for rule in (NOISE_NAME, SHARE_RELATED_COMMENT, MODAL_NAME))


def is_noise(tag: str, attrs: dict, heading: bool, guarded: bool) -> bool:
    """Whether names make an element noise. heading: it has one inside; guarded: it has content inside, or half of the page's text."""
    own, classes = attrs.get("id") or "", (attrs.get("class") or "").split()
    section = "section" in classes and any(re.fullmatch(r"level\d+", c) for c in classes)
    if own.lower() in NOISE_IDS and tag not in LEVELS and not section:
        return True
    by_class = named([c for c in classes if not c.startswith(("tag-", "category-"))])
    by_id = bool(own) and named([own]) and not (tag in LEVELS or tag == "section" or heading)
    return (by_class or by_id or any(AD_DATA_ATTR.search(a) for a in attrs)) and not guarded


def candidates(srcset: str) -> list[str]:
    """Links of a srcset, greatest width or density first. A link runs to white space and may hold commas; one that ends in a comma has no size."""
    found = []
    for m in re.finditer(r"[\s,]*(\S*[^\s,])(?:,+(?=\s|$)|\s+([^,(]*(?:\([^)]*\)[^,(]*)*)|$)", srcset):
        size = re.fullmatch(r"(\d+(?:\.\d+)?)[wx]", (m[2] or "").strip())
        found.append((-(float(size[1]) if size else 0.0) or -1.0, len(found), m[1]))
    return [link for *_, link in sorted(found)]


def image_link(attrs: dict, page: str) -> str:
    """The best link of an image on its page; '' if it has none over HTTP."""
    get = lambda *names: next((attrs[n] for n in names if attrs.get(n)), "")
    for link in [*candidates(get("srcset", "data-srcset", "data-lazy-srcset")), *(attrs.get(n) for n in ("data-src", "data-lazy-src", "data-original", "src"))]:
        if link and not link.startswith("data:"):
            try:
                full = urljoin(page, link.strip())
            except ValueError:
                continue
            if full.startswith(("http://", "https://")) or not page and ":" not in full.split("/")[0]:
                return full
    return ""


def single(text: str) -> str:
    """Runs of white space as one blank. No white space but the blank is printable: most texts are as they are."""
    return text if text.isprintable() and "  " not in text else SPACE.sub(" ", text)


def collapse(text: str | None) -> str:
    return single(text or "").strip(" ")


#: A plain path from a site's root, and a plain site.
_PATH, _SITE = re.compile(r"(?:/[A-Za-z0-9_-]+)+"), re.compile(r"https?://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?=/|$)")


def whole_link(raw: str | None, page: str) -> str | None:
    """A link over HTTP, made whole by the page's; any other is none."""
    if raw and _PATH.fullmatch(raw) and (site := _SITE.match(page)):
        return site[0] + raw
    try:
        full = urljoin(page, (raw or "").strip())
        return full if raw and full.startswith(("http://", "https://")) and urlsplit(full).netloc else None
    except ValueError:
        return None


def video(raw: str | None, page: str) -> tuple[str, str] | None:
    """Provider and id of the single video that a frame plays."""
    try:
        link = urlsplit(urljoin(page, raw or ""))
        host = (link.hostname or "").lower()
    except ValueError:
        return None
    plain = YOUTUBE_HOST.sub("", host)
    found = None
    if plain == "youtu.be":
        found = link.path[1:].split("/")[0]
    elif plain in ("youtube.com", "youtube-nocookie.com"):
        found = parse_qs(link.query).get("v", [None])[0] or (YOUTUBE_PATH.match(link.path) or [None, None])[1]
    if found and found != "videoseries" and YOUTUBE_ID.fullmatch(found):
        return "youtube", found
    played = VIMEO_HOST.search(host) and VIMEO_PATH.match(link.path)
    return ("vimeo", played[1]) if played else None


class Element:
    """An element with its parent, its children (elements and texts), and what it holds: characters, a heading, content."""

    __slots__ = ("tag", "attrs", "parent", "kids", "depth", "chars", "heading", "content", "parts")

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Element | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.chars, self.heading, self.content, self.parts = 0, False, False, False

    def elements(self) -> list[Element]:
        return [k for k in self.kids if isinstance(k, Element)]

    def all(self, *tags: str) -> Iterator[Element]:
        """Elements below with one of the tags, in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            if node.tag in tags:
                yield node
            stack += node.elements()[::-1]

    def text(self, line: str = "") -> str:
        """All text below; ``line`` for a line break."""
        out, stack = [], self.kids[::-1]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag == "br":
                out.append(line)
            else:
                stack += node.kids[::-1]
        return "".join(out)

    def within(self, *tags: str) -> Element | None:
        """The nearest element around (itself included) with one of the tags."""
        node = self
        while node and node.tag not in tags:
            node = node.parent
        return node

    def cut(self) -> None:
        if self.parent:
            self.parent.kids = [k for k in self.parent.kids if k is not self]


class Tree(HTMLParser):
    """Builds the elements; ``order`` has them by their start tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Element("", {}, None)
        self.order: list[Element] = []

    def handle_starttag(self, tag, attrs):
        while self.top.tag and self.top.tag in ENDS.get(tag, ()):
            self.top = self.top.parent
        node = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.top if self.top.depth < DEEPEST else self.top.parent)
        node.parent.kids.append(node)
        self.order.append(node)
        if tag not in VOID:
            self.top = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.top.within(tag)
        if node and node.tag:
            self.top = node.parent

    def handle_data(self, data):
        self.top.kids.append(data)


def summed(order: list[Element], root: Element) -> None:
    """What each element holds, from the last to the first."""
    for node in [*reversed(order), root]:
        kids = node.elements()
        node.chars = sum(k.chars for k in kids) + sum(len(k) for k in node.kids if isinstance(k, str))
        node.heading = any(k.heading or k.tag in LEVELS for k in kids)
        node.content = any(k.content or holds_content(k.tag, k.attrs) for k in kids)
        node.parts = any(k.parts or k.tag in PARTING for k in kids)


def cleaned(html: str, page: str) -> Element:
    """The page's tree without what isn't its text."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    for node in tree.order:
        if node.tag == "noscript" and (shown := next(node.all("img"), None)):  # what a page without scripts shows
            beside = node.parent.elements()
            before = beside[beside.index(node) - 1] if beside[0] is not node else None
            if before and before.tag == "img" and (not before.attrs.get("src") or before.attrs["src"].startswith("data:")):
                before.cut()
            node.parent.kids[node.parent.kids.index(node)] = shown
            shown.parent = node.parent
    for node in tree.order:
        if dropped(node.tag, node.attrs) or node.tag == "iframe" and not video(node.attrs.get("src"), page):
            node.cut()
    summed(tree.order, tree.root)
    half = tree.root.chars * 0.5
    gone: set[int] = set()
    for node in tree.order:
        guarded = node.content or holds_content(node.tag, node.attrs) or half > 0 and node.chars >= half
        if id(node.parent) in gone:
            gone.add(id(node))
        elif is_noise(node.tag, node.attrs, node.heading, guarded) and not node.within("pre", "code"):
            gone.add(id(node))
            node.cut()
    summed(tree.order, tree.root)
    return tree.root


def joined(spans: list[dict]) -> list[dict]:
    """Spans with like neighbours put together and blanks single, none at either end; code keeps its own."""
    out: list[dict] = []
    for span in spans:
        if out and {**out[-1], "text": ""} == {**span, "text": ""}:
            out[-1]["text"] += span["text"]
        else:
            out.append(dict(span))
    return trimmed(out)


def trimmed(out: list[dict]) -> list[dict]:
    """Spans, no two neighbours alike, with blanks single and none at either end."""
    blank = True
    for span in out:
        if not span.get("code"):
            text = single(span["text"])
            span["text"] = text[1:] if blank and text.startswith(" ") else text
        blank = span["text"].endswith(" ") if span["text"] else blank
    out = [s for s in out if s["text"]]
    if out and not out[-1].get("code"):
        out[-1]["text"] = out[-1]["text"].removesuffix(" ")
    return [s for s in out if s["text"]]


def said(spans: list[dict]) -> str:
    return "".join(s["text"] for s in spans)


class Reader:
    """Reads a tree into blocks; ``late`` are elements of running text that wait for the end of their block."""

    def __init__(self, page: str, images: str):
        self.page, self.images = page, images
        self.out: list[dict] = []
        self.late: list[Element] = []

    def put(self, kind: str, text: str, same: str | None = None, **more) -> None:
        same = collapse(unicodedata.normalize("NFKC", text).lower()) if same is None else same
        self.out.append({"type": kind, "text": text, "identity": same, **more})

    def put_late(self) -> None:
        waiting, self.late = self.late, []
        for node in waiting:
            self.block(node)

    def put_spans(self, kind: str, spans: list[dict], **more) -> None:
        if collapse(said(spans)):
            self.put(kind, said(spans), content=spans, **more)
        self.put_late()

    def spans(self, nodes: list[Element | str], **marks) -> list[dict]:
        return joined([s for n in nodes for s in self.span(n, marks)])

    def span(self, node: Element | str, marks: dict) -> Iterator[dict]:
        if isinstance(node, str):
            yield {"text": single(node), **marks}
            return
        tag = node.tag
        if tag in ("img", "iframe", "pre", "table"):
            self.late.append(node)
        elif tag == "picture":
            self.late += list(node.all("img"))[:1]
        elif tag == "br":
            yield {"text": " ", **marks}
        elif tag in VERBATIM or tag == "math":
            yield {"text": collapse(node.attrs.get("alttext", node.text()) if tag == "math" else node.text()), **marks, "code": True}
        else:
            if tag in MARKS:
                marks = {**marks, MARKS[tag]: True}
            elif tag == "a":  # a link that isn't one hides the one around it
                link = whole_link(node.attrs.get("href"), self.page)
                marks = {**{k: v for k, v in marks.items() if k != "href"}, **({"href": link} if link else {})}
            around = [] if tag in RUNNING else [{"text": " ", **marks}]
            yield from around
            for kid in node.kids:
                yield from self.span(kid, marks)
            yield from around

    def children(self, node: Element) -> None:
        """Blocks of what stands in an element; texts and running elements in a row are a paragraph."""
        run: list[Element | str] = []
        for kid in [*node.kids, None]:
            if isinstance(kid, str) or kid is not None and kid.tag in RUNNING and not kid.parts:
                run.append(kid)
                continue
            if run:
                self.put_spans("paragraph", self.spans(run))
                run = []
            if kid is not None:
                self.block(kid)

    def block(self, node: Element) -> None:
        tag = node.tag
        if tag in LEVELS:
            if text := collapse(node.text()):
                self.put("heading", text, level=LEVELS[tag])
        elif tag == "p" and not any(k.tag in RUNNING and k.parts for k in node.elements()):
            self.put_spans("paragraph", self.spans(node.kids))
        elif tag == "blockquote":
            self.put_spans("quote", self.spans(node.kids), cite=whole_link(node.attrs.get("cite"), self.page))
        elif tag == "hr":
            self.put("divider", "")
        elif tag in ("img", "picture"):
            self.picture(node if tag == "img" else next(node.all("img"), None))
        elif tag == "iframe":
            if played := video(node.attrs.get("src"), self.page):
                self.put("video", "", ":".join(played), provider=played[0], video_id=played[1])
        elif own := {"ul": self.items, "ol": self.items, "pre": self.code, "table": self.rows, "figure": self.figure}.get(tag):
            own(node)
        else:
            self.children(node)

    def picture(self, node: Element | None, caption: str | None = None) -> None:
        link = image_link(node.attrs, self.images) if node else ""
        size = [float(x) for x in (node.attrs.get("width", ""), node.attrs.get("height", "")) if re.fullmatch(r"\d+(\.\d+)?", x)] if node else []
        if link and not any(0 < x < SMALLEST_IMAGE for x in size):
            alt = collapse(node.attrs.get("alt"))
            self.put("image", " ".join(x for x in (alt, caption) if x), link, url=link, alt=alt, caption=caption or None)

    def code(self, node: Element) -> None:
        text = node.text("\n").removeprefix("\n").rstrip("\n")
        if text.strip():
            around = [node, *list(node.all("code"))[:1], node.parent]
            found = LANGUAGE.search(" ".join(n.attrs.get("class", "") for n in around if n))
            self.put("code", text, language=found[1] if found else None)

    def put_list(self, items: list[list[dict]], ordered: bool) -> None:
        if items := [x for x in items if collapse(said(x))]:
            self.put("list", "\n".join(map(said, items)), items=items, ordered=ordered)
        self.put_late()

    def items(self, node: Element) -> None:
        """Items of a list; lists inside them follow it, each as a list of its own."""
        items, inner = [], []
        for li in (k for k in node.elements() if k.tag == "li"):
            own, todo = [], li.kids[::-1]
            while todo:
                kid = todo.pop()
                if isinstance(kid, Element) and kid.tag in ("ul", "ol"):
                    inner.append(kid)
                elif isinstance(kid, Element) and kid.tag in RUNNING and kid.parts:
                    todo += kid.kids[::-1]
                else:
                    own.append(kid)
            items.append(self.spans(own))
        self.put_list(items, node.tag == "ol")
        for kid in inner:
            self.items(kid)

    def rows(self, node: Element) -> None:
        """A table's rows as items of one list; a numbered equation as its formula."""
        if "ltx_equation" in re.findall(r"\w+", node.attrs.get("class", "")):
            formula = next(node.all("math"), None)
            if formula and (text := collapse(formula.attrs.get("alttext", formula.text()))):
                self.put("paragraph", text, content=[{"text": text, "code": True}])
            return
        rows = []
        for tr in node.all("tr"):
            cells = [collapse(said(self.spans(cell.kids))) for cell in tr.elements()]
            rows.append([{"text": " · ".join(c for c in cells if c)}])
        self.put_list(rows, False)

    def figure(self, node: Element) -> None:
        """A picture with its caption; or figures inside, each with its own, and what else the figure owns; or pictures and a table. A caption of several comes last."""
        caption = collapse(next((k.text() for k in node.elements() if k.tag == "figcaption"), ""))
        own = list(_owned(node))
        if not any(part.tag == "figure" for part in own):
            table = next(node.all("table"), None)
            pictures = [p for p in node.all("img") if not _inside(p, table)]
            if not table and len(pictures) < 2:
                return self.picture(pictures[0], caption) if pictures else self.children(node)
            own = [*pictures, *([table] if table else [])]
        for part in own:
            self.block(part)
        if caption:
            self.put("paragraph", caption, content=[{"text": caption}])


def _inside(node: Element, around: Element | None) -> bool:
    while node and node is not around:
        node = node.parent
    return node is not None and around is not None


def _owned(figure: Element) -> Iterator[Element]:
    """Figures right inside a figure, and the pictures and tables that no other figure owns; a table around figures only places them."""
    for kid in figure.elements():
        if kid.tag in ("figure", "img") or kid.tag == "table" and not any(kid.all("figure")):
            yield kid
        else:
            yield from _owned(kid)


#: A link that has an address alone.
_LINK = re.compile(r'a href="([^"&]*)"')


def paragraph(html: str, page: str) -> list[dict] | None:
    """Spans of a page that is one paragraph of marked text, read without a tree; null for any other page.

    Its tags are bare, links have an address alone, code has text alone, and
    each element ends where HTML says that it does.
    """
    if not html.startswith("<p>") or not html.endswith("</p>"):
        return None
    out: list[dict] = []
    open_tags: list[tuple[str, dict]] = []
    links: dict[str, str | None] = {}
    marks: dict = {}
    last = code = None
    pieces: list[str] = []
    for chunk in html[3:-4].split("<"):
        if last is None:  # the text before the first tag
            tag, text, last = "", chunk, {"": ""}
        else:
            tag, closed, text = chunk.partition(">")
            if not closed:
                return None
        if code is not None:
            if tag != code:
                return None
            code = None
        elif tag[:1] == "/":
            if not open_tags or open_tags[-1][0] != tag:
                return None
            marks = open_tags.pop()[1]
        elif tag in MARKS:
            open_tags.append((f"/{tag}", marks))
            marks = {**marks, MARKS[tag]: True}
        elif tag in VERBATIM:
            code, own = f"/{tag}", {**marks, "code": True}
            text = collapse(unescape(text) if "&" in text else text)
            if own == last:
                pieces.append(text)
            else:
                if pieces:
                    out.append({"text": "".join(pieces), **last})
                last, pieces = own, [text]
            continue
        elif tag:
            found = _LINK.fullmatch(tag)
            if not found:
                return None
            raw = found[1]
            if raw not in links:
                links[raw] = whole_link(raw, page)
            open_tags.append(("/a", marks))
            marks = {k: v for k, v in marks.items() if k != "href"}
            if links[raw]:
                marks["href"] = links[raw]
        if len(open_tags) > 100:
            return None
        if text:
            if "&" in text:
                text = unescape(text)
            if marks == last:
                pieces.append(text)
            else:
                if pieces:
                    out.append({"text": "".join(pieces), **last})
                last, pieces = marks, [text]
    if open_tags or code is not None:
        return None
    if pieces:
        out.append({"text": "".join(pieces), **last})
    return trimmed(out)


def blocks(html: str | None, page: str | None = None, images: str | None = None) -> list[dict]:
    """Blocks of a page; links are made whole by the page's own, those of pictures by ``images`` if they are relative to another address."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 12 * DEEPEST))  # some calls a level
    try:
        reader = Reader(page or "", images or page or "")
        if (spans := paragraph(html or "", page or "")) is not None:
            reader.put_spans("paragraph", spans)
        else:
            reader.children(cleaned(html or "", page or ""))
        return reader.out
    finally:
        sys.setrecursionlimit(before)
