"""Union-free regular expressions over token streams, inferred by alignment. A wrapper has the form of a page tree
(html_tree): its nodes are elements, texts and groups of nodes, each of which can be optional or repeated, and a text is a
constant (the hash of what all pages say there) or a slot (None).

Two wrappers, or a wrapper and a page, are aligned level by level on a longest common subsequence of their nodes. Texts
that differ become a slot. Nodes that one side lacks become optional; where they repeat what stands beside them they become
a repeated group with it. The result accepts all that either side accepts."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import numpy as np

from quarry.llm.html_tree import COMMENTS, FURNITURE, HEAD, IN, OUT

TEXT, GROUP, BARE = "#", "(", "*"
HEADING = re.compile(r"h[1-6]\b")
#: Lists with more nodes name their elements without classes, so that a wrapper does not grow with the number of pages.
WIDEST = 200


def key(node: list) -> str:
    return node[0] if node[0] != GROUP else "(" + " ".join(map(key, node[1])) + ")"


def merged(a: list, b: list) -> list:
    """Two nodes of one key."""
    loose = [a[2] or b[2], a[3] or b[3]]
    if a[0] == TEXT:
        return [TEXT, a[1] if a[1] == b[1] else None, *loose, *(x + y for x, y in zip(a[4:], b[4:], strict=True))]
    if a[0] == GROUP:
        return [GROUP, [merged(x, y) for x, y in zip(a[1], b[1], strict=True)], *loose]
    return [a[0], aligned(a[1], b[1]), *loose]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """The least general common form of two lists of nodes."""
    if _bare(a) or _bare(b):
        a, b = _made_bare(a), _made_bare(b)
    if [key(n) for n in a] != [key(n) for n in b]:
        a, b = _reduced(a, b), _reduced(b, a)
    x, y = [key(n) for n in a], [key(n) for n in b]
    out: list[list] = []
    m = n = 0
    for s, t in [*common(x, y), (len(x), len(y))]:
        out += [[*v[:2], True, *v[3:]] for v in [*a[m:s], *b[n:t]]]
        if s < len(x):
            out.append(merged(a[s], b[t]))
        m, n = s + 1, t + 1
    out = collapsed(out)
    return collapsed(_made_bare(out)) if len(out) > WIDEST and not _bare(out) else out


def _bare(nodes: list[list]) -> bool:
    return any(n[0].endswith(BARE) for n in nodes)


def bare(label: str) -> str:
    return label if label in (TEXT, GROUP) or label.endswith(BARE) else label.split(".", 1)[0] + BARE


def _made_bare(nodes: list[list]) -> list[list]:
    return [[bare(n[0]), _made_bare(n[1]) if n[0] == GROUP else n[1], *n[2:]] for n in nodes]


def _unit(nodes: list[list]) -> list:
    """One or more nodes as one that repeats."""
    return [*nodes[0][:3], True, *nodes[0][4:]] if len(nodes) == 1 else [GROUP, nodes, False, True]


def _body(unit: list) -> list[list]:
    return unit[1] if unit[0] == GROUP else [unit]


def _reduced(nodes: list[list], other: list[list]) -> list[list]:
    """Sequences of nodes that a repeated node of the other list accepts, each as that node."""
    units = {key(v): v for v in other if v[3]}
    if not units:
        return nodes
    first: dict[str, list[list]] = {}
    for unit in units.values():
        body = _body(unit)
        for v in body:
            first.setdefault(key(v), []).append(body)
            if not v[2]:
                break
    out, i = [], 0
    while i < len(nodes):
        for body in first.get(key(nodes[i]), ()):
            whole, j = None, i
            while (once := _once(body, nodes, j)) and once[1] > j:
                whole = once[0] if whole is None else [merged(p, q) for p, q in zip(whole, once[0], strict=True)]
                j = once[1]
            if whole is not None:
                out.append(_unit(whole))
                i = j
                break
        else:
            out.append(nodes[i])
            i += 1
    return out


def _once(body: list[list], nodes: list[list], at: int) -> tuple[list[list], int] | None:
    """The body with what nodes[at:] has for it, and where that ends; None if a node that is not optional lacks."""
    got = []
    for v in body:
        if at < len(nodes) and key(nodes[at]) == key(v):
            got.append(nodes[at])
            at += 1
        elif v[2]:
            got.append(_emptied(v))
        else:
            return None
    return got, at


def _emptied(v: list) -> list:
    """A node without its counts, for a page that does not fill it."""
    return [*v[:4], 0, 0, 0] if v[0] == TEXT else [v[0], [_emptied(x) for x in v[1]], *v[2:]]


def collapsed(nodes: list[list]) -> list[list]:
    """Equal sequences side by side as one repeated node, where one of them is optional or repeated already."""
    out: list[list] = []
    places: dict[str, list[int]] = {}
    keys: list[str] = []
    run: list[int] = []  # optional nodes in a row up to here
    longest = 1  # sequence that can be optional as a whole
    sizes: set[int] = set()  # of groups

    def push(node: list) -> None:
        nonlocal longest
        if node[0] == GROUP:
            sizes.add(len(node[1]))
        places.setdefault(key(node), []).append(len(out))
        keys.append(key(node))
        run.append((run[-1] if run else 0) + 1 if node[2] else 0)
        longest = max(longest, run[-1])
        out.append(node)

    def pop(n: int) -> None:
        for _ in range(n):
            places[keys.pop()].pop()
            run.pop()
            out.pop()

    for node in nodes:
        push(node)
        again = True
        while again:
            again = False
            end, same = len(out), places[keys[-1]]
            for d in sizes:  # one more round of the group before
                g = end - 1 - d
                if g >= 0 and run[-1] >= d and out[g][0] == GROUP and [key(v) for v in out[g][1]] == keys[g + 1 :]:
                    unit = [GROUP, [merged(u, v) for u, v in zip(out[g][1], [[*v[:2], w[2], *v[3:]] for v, w in zip(out[g + 1 :], out[g][1], strict=True)], strict=True)], *out[g][2:]]
                    pop(d + 1)
                    push(unit)
                    again = True
                    break
            if again:
                continue
            for i in range(len(same) - 2, -1, -1):
                p = same[i]
                d = end - 1 - p
                if d > min(p + 1, longest):
                    break
                loose = run[-1] >= d or run[p] >= d or (d == 1 and (out[-1][3] or out[p][3]))
                if loose and keys[end - d :] == keys[end - 2 * d : end - d]:
                    before, tail = out[end - 2 * d : end - d], out[end - d :]
                    both = [merged(u, v) for u, v in zip(before, tail, strict=True)]
                    whole = run[p] >= d and run[-1] >= d
                    if not whole:  # one of them is always there: its nodes are as optional as they were
                        sure = before if run[-1] >= d else tail
                        for v, s in zip(both, sure, strict=True):
                            v[2] = s[2]
                    elif d > 1:
                        for v in both:
                            v[2] = False
                    unit = _unit(both)
                    unit[2] = whole or unit[2] and d == 1
                    pop(2 * d)
                    push(unit)
                    again = True
                    break
    return out


def common(x: list[str], y: list[str], most_bits: int = 1 << 28) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, by rows of bits; past most_bits the rows are halved at the best cut."""
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    j = 0
    while j < min(len(x), len(y)) - i and x[-1 - j] == y[-1 - j]:
        j += 1
    n, m = len(x) - j, len(y) - j
    head, tail = [(k, k) for k in range(i)], [(n + k, m + k) for k in range(j)]
    return head + [(i + s, i + t) for s, t in _middle(x[i:n], y[i:m], most_bits)] + tail


def _rows(x: list[str], y: list[str]):
    """For each prefix of x a number whose zero bits are the places of y where the common length steps up."""
    places: dict[str, int] = {}
    for j, k in enumerate(y):
        places[k] = places.get(k, 0) | 1 << j
    full = (1 << len(y)) - 1
    v = full
    for k in x:
        u = v & places.get(k, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _middle(x: list[str], y: list[str], most_bits: int) -> list[tuple[int, int]]:
    if not x or not y:
        return []
    if len(x) > 1 and len(x) * len(y) > most_bits:
        half = len(x) // 2

        def steps(p: list[str], q: list[str]) -> np.ndarray:
            for last in _rows(p, q):
                pass
            bits = np.unpackbits(np.frombuffer(last.to_bytes(len(q) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(q)]
            return np.append(0, np.cumsum(bits == 0))

        cut = int(np.argmax(steps(x[:half], y) + steps(x[half:][::-1], y[::-1])[::-1]))
        return _middle(x[:half], y[:cut], most_bits) + [(half + s, cut + t) for s, t in _middle(x[half:], y[cut:], most_bits)]
    rows = list(_rows(x, y))
    out, i, j = [], len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - 1] >> (j - 1) & 1:
            continue
        j -= 1
        out.append((i, j))
    return out[::-1]


def expression(nodes: list[list]) -> str:
    """A wrapper as a regular expression: <label ...>, #text for a slot, 'text' for a constant."""

    def one(n: list) -> str:
        times = "*" if n[2] and n[3] else "?" if n[2] else "+" if n[3] else ""
        inner = ("#text" if n[1] is None else "'text'") if n[0] == TEXT else "(" + expression(n[1]) + ")" if n[0] == GROUP else f"<{n[0].strip()} {expression(n[1])}>"
        return inner + times

    return " ".join(map(one, nodes))


# A wrapper's fields.


#: Classes of texts, the better the higher: template or furniture; a field; a field of the article.
NEVER, FIELD, ARTICLE = range(3)


class Level(NamedTuple):
    """A list of nodes to match with: places of a label, the place up to which one may go back after a node, what a node
    holds (a Level, or the class of a text)."""

    places: dict[str, list[int]]
    back: list[int]
    held: list


def fields(wrapper: list[list], least: int = 3, least_inside: int = 10, linked: float = 0.6, main: int = 200) -> Level:
    """The wrapper with the class of each text.

    A constant that `least` pages (within an article `least_inside`) have at a place that is never empty is template, as
    long as most characters of the wrapper are in slots. Outside of an article, a text of which over `linked` of the
    characters are links is template. The name of an element (sidebar, advert, ...) makes it furniture, unless it holds
    over half of the characters of all slots and `main` a page; that of comments always does; a header by name is content
    if it has a heading that differs from page to page. Outside of an article, what stands beside an element that holds
    nearly all of the host's running text is furniture as well (_beside). Paragraphs that stand among others that differ from page to page
    are content, also constant ones and those that are a link."""
    slots, constants = _weights(wrapper)
    whole, varied, of = slots or constants, slots > constants, 0 if slots else 1
    enough = max(whole / 2, main * _pages(wrapper))

    def level(nodes: list[list], rank: int, sure: bool, back: int | None, out: Level, kept: bool = False, among: bool = False) -> Level:
        """kept: of a paragraph among others; among: in a group beside such."""
        among = among or _told(nodes) > 1
        beside = _beside(nodes, of) if rank == FIELD else ()
        for n in nodes:
            at = len(out.held)
            if n[0] == GROUP:
                level(n[1], rank, sure and not n[2], at if back is None else back, out, kept, among)
                continue
            out.places.setdefault(n[0], []).append(at)
            out.back.append(back if back is not None else at if n[3] else at + 1)
            always = sure and not n[2]
            if n[0] != TEXT:
                mark, below = n[0][0], rank
                if mark == OUT or mark == COMMENTS or (mark == HEAD and not _headline(n)) or (mark == FURNITURE and _weights([n])[of] <= enough):
                    below = NEVER
                elif mark == IN and rank > NEVER:
                    below = ARTICLE
                elif id(n) in beside:
                    below = NEVER
                out.held.append(level(n[1], below, always, None, Level({}, [], []), among and _is_paragraph(n)))
                continue
            _, value, _, _, pages, chars, links = n
            template = value is not None and always and varied and pages >= (least_inside if rank == ARTICLE else least)
            out.held.append(NEVER if not kept and (template or (rank < ARTICLE and links > linked * chars)) else rank)
        return out

    return level(wrapper, FIELD, True, None, Level({}, [], []))


def _beside(nodes: list[list], of: int, most: float = 0.9, least: float = 0.1) -> set[int]:
    """The elements beside one that holds over `most` of a list's running text (over all pages of the host), each under `least`
    of it: what stands next to the article. Paragraphs, headings and what has one are not among them."""
    held = [(_weights([n])[of], n) for n in nodes if n[0] not in (TEXT, GROUP)]
    top, all_of = max((w for w, _ in held), default=0), sum(w for w, _ in held) + _weights([n for n in nodes if n[0] in (TEXT, GROUP)])[of]
    if not top or top < most * all_of:
        return set()
    return {id(n) for w, n in held if w < least * top and n[0][0] != IN and not _is_paragraph(n) and not _headed([n])}


def _headed(nodes: list[list]) -> bool:
    return any(n[0] != TEXT and (HEADING.match(n[0][1:]) is not None or _headed(n[1])) for n in nodes)


def _is_paragraph(n: list) -> bool:
    return n[0][1:].split(".", 1)[0].rstrip(BARE) == "p"


def _told(nodes: list[list]) -> int:
    """0 if no paragraph of a list differs from page to page (or from the next); else how many paragraphs it has, at least."""
    ps = [n for n in nodes if n[0] not in (TEXT, GROUP) and _is_paragraph(n)]
    inside = [n for v in nodes if v[0] == GROUP for n in v[1] if n[0] not in (TEXT, GROUP) and _is_paragraph(n)]
    differs = any(t[1] is None and t[5] > 2 * t[6] for n in ps + inside for t in n[1] if t[0] == TEXT)
    return sum(2 if n[3] else 1 for n in ps) + 2 * len(inside) if differs else 0


def _pages(nodes: list[list]) -> int:
    """Pages that the most common text is on, at least."""
    return max((n[4] if n[0] == TEXT and not n[3] else _pages(n[1]) if n[0] != TEXT and not n[3] else 1 for n in nodes), default=1)


def _weights(nodes: list[list]) -> tuple[int, int]:
    """Characters outside of links in slots and in constants, of what can be content."""
    slots = constants = 0
    for n in nodes:
        if n[0] == TEXT:
            if n[1] is None:
                slots += n[5] - n[6]
            else:
                constants += n[5] - n[6]
        elif n[0][0] not in (OUT, COMMENTS):
            s, c = _weights(n[1])
            slots, constants = slots + s, constants + c
    return slots, constants


def _headline(node: list) -> bool:
    """Whether there is a heading of first or second rank that differs from page to page."""
    inside = any(_headline(n) for n in node[1] if n[0] != TEXT)
    return inside or (node[0][1:3] in ("h1", "h2") and any(n[0] == TEXT and n[1] is None for n in node[1]))


def match(page: list[list], level: Level) -> list[tuple[str, int]]:
    """The page's texts and their classes, in order. As any node can be skipped and a repeated one entered again from its
    beginning, going to the nearest place that takes all of a node matches all of a page that the wrapper accepts; where
    none does, the place that takes most of it. What fits nowhere is in no field."""
    return _match(page, level, {})[0]


def _match(page: list[list], level: Level, known: dict) -> tuple[list[tuple[str, int]], int]:
    """Texts with classes, and how many texts have no place. known: what was found for a list of nodes at a level."""
    out: list[tuple[str, int]] = []
    lost = at = 0
    for n in page:
        places = level.places.get(n[0]) or level.places.get(bare(n[0]), ())
        i = bisect_left(places, at)
        if n[0] == TEXT:
            if i < len(places):
                out.append((n[1], level.held[places[i]]))
                at = level.back[places[i]]
            else:
                lost += 1
            continue
        best, here = None, at
        for q in places[i:]:
            pair = id(n), id(level.held[q])
            if pair not in known:
                known[pair] = _match(n[1], level.held[q], known)
            if best is None or known[pair][1] < best[1]:
                best, at = known[pair], level.back[q]
            if not best[1]:
                break
        if best is None or (best[1] and not best[0]):
            at = here
            lost += sum(1 for _ in _texts(n))
        else:
            out += best[0]
            lost += best[1]
    return out, lost


def _texts(node: list):
    for n in node[1]:
        if n[0] == TEXT:
            yield n
        else:
            yield from _texts(n)


def main_text(page: list[list], level: Level) -> str:
    """The page's texts on fields of the article, and those on other fields where they are most of the text (what is marked
    as the article is then a teaser)."""
    found = match(page, level)
    chars = {c: sum(len(t) for t, k in found if k == c) for c in (FIELD, ARTICLE)}
    least = ARTICLE if chars[FIELD] < 2 * chars[ARTICLE] else FIELD
    return "\n".join(t for t, c in found if c >= least)
