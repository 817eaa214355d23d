"""The blocks of an HTML page, and what their markup says of them."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"class|id|role|style|hidden", re.I)
UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
SPLIT = re.compile(r"[^0-9a-z]+")

RAW = {"script", "style", "textarea", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
SKIPPED = {
    "head", "nav", "footer", "aside", "form", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video",
    "button", "select", "datalist", "menu", "dialog", "map",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Classes, ids and roles that name something other than the article.
SKIPPED_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "popup", "promo", "related", "reply", "respond", "share", "sharing",
    "sidebar", "sponsor", "sponsored", "social", "subscribe", "widget",
}
HEADERS = {"header", "masthead", "topbar"}
#: Names that articles are written about too: in a name of several words they need one of ``BOXES`` (or of the names) beside them.
TOPICS = {
    "banner", "consent", "cookie", "cookies", "menu", "notice", "notices", "related", "reply", "respond", "share", "sharing",
    "social", "sponsor", "subscribe",
}
BOXES = {
    "area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "group", "icon", "icons",
    "inner", "item", "items", "link", "links", "list", "panel", "post", "posts", "section", "site", "slot", "stories", "story", "top",
    "wrap", "wrapper",
}
#: Words of names that tell a state of the page or a layout.
STATES = {"has", "hide", "is", "no", "not", "show", "with", "without"}
#: Names of what readers wrote, however long it is.
READERS = {"comments", "disqus"}
ARTICLE_NAMES = {"article", "entry", "post", "story"}
#: What may stand beside such a word in a hyphenated name.
PLACES = {"main", "site"}
ARTICLE_PARTS = {
    "blog", "body", "content", "full", "headline", "intro", "lead", "main", "news", "single", "subtitle", "summary", "text", "title",
}
MAIN_PARTS = {"area", "body", "column", "container", "content", "text", "wrapper"}

ARTICLE, MAIN, OPEN, MARKED = range(4)
# Kinds while a page is read: marked by a name only, and a part of an article whose id is such a name.
NAMED, THREAD = 4, 5
REPORTED = {NAMED: MARKED, THREAD: ARTICLE}
# Added to the kind around it: marked by a part of a name, which counts unless most of the paragraphs are so marked.
LIKELY = 8
HEADING, ITEM, PARAGRAPH = range(3)


def attributes_of(attributes: str) -> dict[str, str]:
    """Names in lower case to values, of which the first counts."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def made_of(name: str, wanted: set[str], others: set[str]) -> bool:
    """Whether a name has a wanted word, and none that is neither wanted nor one of the others."""
    words = {word for word in SPLIT.split(name) if word}
    return bool(words & wanted) and words <= wanted | others


def part_marks(name: str) -> int:
    """Whether a name of several words says that something is no article: 0 no, 1 likely, 2 surely, since readers wrote it."""
    words = [word for word in SPLIT.split(name) if word]
    if len(words) < 2 or STATES & set(words):
        return 0
    ends = {words[0], words[-1]}
    if words[0] == "comment" or READERS & set(words):
        return 2
    if "".join(words) in SKIPPED_NAMES or ends & (SKIPPED_NAMES - TOPICS - {"comment"}):
        return 1
    return int(bool(ends & TOPICS) and set(words) <= SKIPPED_NAMES | BOXES)


def kind_of(tag: str, given: dict[str, str], inside: int) -> int:
    """The kind of what an element holds, which stands inside another kind.

    Names never mark html, body, main or an article, and a main part undoes the names around it. Inside an article or main part
    only classes and roles mark, since ids are made from headings there. A class of several words is judged by its first and
    last one, and not on headings and parts of a line. An article in a part of an article whose id is such a name (comments) is
    a reply.
    """
    if inside >= LIKELY:
        if tag == "main" and inside == LIKELY + OPEN:
            return MAIN
        own = inside if tag == "article" else kind_of(tag, given, inside - LIKELY)
        return own if own in (MARKED, NAMED) else inside
    if inside == MARKED:
        return MARKED
    if tag in ("html", "body"):
        return inside
    shown = given.get("hidden", "until-found").lower() == "until-found" and not UNSHOWN.search(given.get("style", ""))
    if tag in SKIPPED or not shown:
        return MARKED
    classes, roles = given.get("class", "").lower().split(), given.get("role", "").lower().split()
    name = given.get("id", "").strip().lower()
    if tag == "main" or "main" in roles:
        return MAIN if inside in (OPEN, NAMED) else inside
    if inside == NAMED:
        return NAMED
    if tag == "article":
        return NAMED if inside == THREAD else ARTICLE
    if any(token in SKIPPED_NAMES for token in classes + roles) or given.get("aria-hidden", "").strip().lower() == "true":
        return NAMED
    if tag == "header" and inside not in (ARTICLE, THREAD):
        return MARKED
    if any(token in HEADERS for token in classes + roles) and inside not in (ARTICLE, THREAD):
        return NAMED
    names = [*classes, name]
    if inside == OPEN:
        own = classes if tag in HEADINGS or tag in ("section", "p") else names
        if any(made_of(token, SKIPPED_NAMES | HEADERS, PLACES) for token in own):
            return NAMED
    if tag not in HEADINGS and tag not in INLINE:
        sure = max(map(part_marks, classes), default=0)
        if sure:
            return NAMED if sure == 2 else LIKELY + REPORTED.get(inside, inside)
    if inside in (ARTICLE, THREAD):
        return THREAD if name in SKIPPED_NAMES else inside
    if tag not in INLINE:
        if "article" in roles or any(made_of(token, ARTICLE_NAMES, ARTICLE_PARTS) for token in classes) or (
            tag not in HEADINGS and tag not in ("section", "p") and made_of(name, ARTICLE_NAMES, ARTICLE_PARTS)
        ):
            return ARTICLE
        if inside == OPEN and any(made_of(token, {"main"}, MAIN_PARTS) for token in names):
            return MAIN
    return inside


def blocks(page: str) -> list[tuple[int, str, int]]:
    """The blocks in page order: (kind, text, shape), white space being one space.

    Kinds: in an article, in the main part but no article, said to be something else, or open: nothing is said. ``LIKELY`` is
    added to a kind if a part of a name says that the block is something else.
    Shapes: a heading, a list item, or else a paragraph.
    """
    out: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements that matter, and the kind inside them
    text: list[str] = []

    def kind() -> int:
        return stack[-1][1] if stack else OPEN

    def close_block() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            last = stack[-1][0] if stack else ""
            shape = HEADING if last in HEADINGS else ITEM if last == "li" else PARAGRAPH
            out.append((REPORTED.get(kind(), kind()), line, shape))

    at, end = 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            text.append(page[at:])
            break
        text.append(page[at:found.start()])
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag not in INLINE:
                close_block()
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if place is not None:
                if tag in INLINE:
                    close_block()
                del stack[place:]
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            at = close.start() if close else end
            if tag in ("textarea", "title"):
                close_block()
            continue
        given = attributes_of(attributes) if attributes and TELLING.search(attributes) else {}
        if tag in INLINE:
            marked = (MARKED, NAMED)
            if given and kind() not in marked and (own := kind_of(tag, given, kind())) in marked:  # others need not be tracked
                close_block()
                stack.append((tag, own))
            continue
        close_block()
        while stack and (stack[-1][0] == "p" or tag == stack[-1][0] == "li"):
            stack.pop()  # the end of a paragraph or list item may be left out
        stack.append((tag, kind_of(tag, given, kind())))
    close_block()
    return out


def judged_by_markup(page: str | None) -> tuple[bool, list[tuple[str, int]], list[str]]:
    """Whether the markup tells an article, its blocks and their shapes (else all that are open), and those said to be something else.

    The markup tells an article if what it names as such holds at least half of the text in paragraphs (or, on pages without
    any, of all text); a named title alone doesn't. Blocks that a part of a name marks are something else, unless they hold most
    of the text in paragraphs.
    """
    found = blocks(page or "")
    shown = [block for block in found if block[0] != MARKED]
    weighed = [block for block in shown if block[2] == PARAGRAPH] or shown
    likely = sum(len(text) for kind, text, _ in weighed if kind >= LIKELY)
    if 2 * likely > sum(len(text) for _, text, _ in weighed):
        found = [(kind % LIKELY, text, shape) for kind, text, shape in found]
    else:
        found = [(MARKED if kind >= LIKELY else kind, text, shape) for kind, text, shape in found]
    marked = [text for kind, text, _ in found if kind == MARKED]
    rest = [block for block in found if block[0] != MARKED]
    weighed = [block for block in rest if block[2] == PARAGRAPH] or rest
    whole = sum(len(text) for _, text, _ in weighed)
    for wanted in ({ARTICLE}, {ARTICLE, MAIN}):
        own = [(text, shape) for kind, text, shape in rest if kind in wanted]
        if own and 2 * sum(len(text) for kind, text, _ in weighed if kind in wanted) >= whole:
            return True, own, marked
    return False, [(text, shape) for _, text, shape in rest], marked


def sorted_out(page: str | None) -> tuple[list[str] | None, list[str], list[str]]:
    """The article if the markup tells it (else None), the other blocks if it doesn't, and the blocks said to be something else."""
    told, own, marked = judged_by_markup(page)
    texts = [text for text, _ in own]
    return (texts, [], marked) if told else (None, texts, marked)
