"""A page as a tree of block elements: the token stream (opening and closing tags, texts between them) in nested form.

A node is a list. A text is ["#", value, optional, repeated, pages, chars, links] and an element [label, children, optional,
repeated]; value is the text itself, and links counts its characters inside anchors. A label is a mark and the element's
name with its first class or id (digits as 0). Inline elements belong to the text around them, elements without text are
left out, and elements nested deeper than DEEPEST add no level of their own (their texts stay), but for those that are never
content."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

#: A comment, a declaration, or a tag with attributes in which quoted values may hold ">"; a quote that never ends is a character.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"\s+")
LABEL = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
DIGITS = re.compile(r"[0-9]+")
DEEPEST = 64

# Element names.
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output picture progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
OUTSIDE = frozenset("nav header footer aside form script style head select button dialog menu option svg canvas audio video object noscript template iframe".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that end where another of the same kind, or their parent, goes on.
SELF_CLOSING = {"p": frozenset("p".split()), "li": frozenset("li".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split()), "tr": frozenset("tr td th".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "option": frozenset(("option",))}
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# Words that name what is not the article, where a class, id or role begins or ends with them.
TALK = frozenset("comment comments commentlist disqus replies reply respond".split())
HEADS = frozenset("header masthead".split())
LABELS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs consent "
    "contentinfo cookie cookies dialog footer form gdpr menu menubar modal nav navbar navigation newsletter notice "
    "notification overlay pager pagination popup promo promoted promotion recommended related search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe toolbar topbar widget widgets complementary".split()
)
# Words that make a class the state of an element, not its name.
STATES = frozenset("has with without no not is are hide show open closed enabled disabled allowed none on off active fixed sticky".split())

#: Marks: never content; an article; named like a page's furniture, like its header, like readers' comments.
OUT, IN, FURNITURE, HEAD, COMMENTS, PLAIN = "!@?^~ "


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)} if "=" in text or "hidden" in text else {}


def mark_of(name: str, attributes: dict[str, str], inside: bool) -> str:
    """inside: within an article, whose own header is content."""
    if name in OUTSIDE and not (name == "header" and inside):
        return OUT
    if attributes and ("hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()):
        return OUT
    if name in ARTICLE or attributes.get("role") == "main":
        return IN
    if not attributes or name in ("body", "html"):
        return PLAIN
    mark = PLAIN
    for said in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split():
        words = [w.lower() for w in LABEL.findall(said)]
        if not words or not STATES.isdisjoint(words):
            continue
        ends = {words[0], words[-1]}
        if ends & TALK:
            return COMMENTS
        if ends & LABELS:
            mark = FURNITURE
        elif ends & HEADS and mark == PLAIN and not inside:
            mark = HEAD
    return mark


def parse(page: str) -> list[list]:
    """The children of the page's root; texts are settled (references decoded, white space joined and trimmed)."""
    root: list = ["", [], False, False]
    stack: list[tuple[str, list, bool]] = [("", root, False)]  # name, node, inside an article
    names: Counter = Counter()
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                stack[-1][1][1].append(["#", text, False, False, 1, len(text), min(links, len(text))])
            parts.clear()
        links = 0

    def push(name: str, node: list, inside: bool) -> None:
        names[name] += 1
        above = stack[-1][1]
        if len(stack) < DEEPEST or (node[0][:1] in (OUT, COMMENTS) and above[0][:1] not in (OUT, COMMENTS)):
            above[1].append(node)
        else:
            node = above
        stack.append((name, node, inside))

    def pop() -> str:
        name, node, _ = stack.pop()
        names[name] -= 1
        if not node[1] and stack[-1][1] is not node:
            stack[-1][1][1].pop()  # no text inside
        return name

    at = 0
    while at < len(page):
        tag = TOKEN.search(page, at)
        upto = tag.start() if tag else len(page)
        if upto > at:
            said = entities.unescape(page[at:upto])
            parts.append(said)
            if linked:
                links += len(said.strip())
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        inside = stack[-1][2]
        if name in INLINE:
            if name == "a":
                linked = max(0, linked + (-1 if tag[1] else 1))
            elif name == "br":
                parts.append(" ")
            elif tag[1]:
                if names[name]:  # one that was taken for a block
                    flush()
                    while pop() != name:
                        pass
            elif tag[3] and (mark := mark_of(name, _attributes(tag[3]), inside)) != PLAIN:
                flush()
                push(name, [mark + name, [], False, False], inside)
            continue
        flush()
        linked = 0
        if tag[1]:
            if names[name]:
                while pop() != name:
                    pass
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in CLOSES_P and stack[-1][0] == "p":
            pop()
        while stack[-1][0] in SELF_CLOSING.get(name, ()):
            pop()
        if name in VOID:
            continue
        inside = stack[-1][2]
        attributes = _attributes(tag[3])
        mark = mark_of(name, attributes, inside)
        first = attributes.get("class", attributes.get("id", "")).split()
        push(name, [mark + name + (f".{DIGITS.sub('0', first[0])}" if first else ""), [], False, False], inside or mark == IN)
    flush()
    while len(stack) > 1:
        pop()
    return root[1]
