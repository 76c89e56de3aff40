"""From HTML to text lines, each with what the markup says about it.

A line is the text of a block, with character references decoded and white space turned into single
spaces. Its kind is BOILERPLATE (inside elements that are navigation, page header, footer, sidebar, form,
notice, advert or reader comments by tag, role, class or id), PROSE (a paragraph, heading, list item and the
like inside an article or main element), INSIDE (other text of such an element) or OPEN (all else).

Class and id words, and forms, are hints only: an element that holds the page's largest article or main element, or
where there is none most of the page's text, is not boilerplate, whatever its class says. An element named after
comments, adverts or related pages must hold all of the text for that.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

PROSE, INSIDE, OPEN, BOILERPLATE = "p", "i", "o", "b"

# Element and class names of HTML pages.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())  # their content is no markup
_TO_THE_END = frozenset("script style title textarea".split())  # without an end tag the rest of the page is theirs
_UNSEEN = frozenset("svg noscript template object canvas iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody tfoot thead tr ul".split()
)
_SPACED = frozenset(("td", "th", "br"))  # white space inside their block
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre figcaption caption td th dd dt summary".split())
_LANDMARK = frozenset(("article", "main"))
_FRAME = frozenset("head nav footer aside button select menu dialog search".split())
_MAYBE_FRAME = frozenset(("form", "fieldset"))  # some pages are one form
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead header topbar footer sidebar aside widget related ad ads "
    "advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe subscription signup signin login share sharing social comment comments disqus reply "
    "replies respond pagination pager toolbar skip hidden".split()
)
_STRONG = frozenset(
    "related ad ads advert adverts advertisement sponsor sponsored promo comment comments disqus reply replies respond".split()
)
_NOT_THE_THING = frozenset("no has with without is not".split())  # "no-sidebar" is no sidebar
_OF_CONTENT = frozenset("article entry post story content section".split())  # "entry-header" heads the text
_CLOSES_P = _BLOCK - {"option", "optgroup"}
_SCOPE = frozenset("article aside blockquote body div dl footer form header html li main nav ol section table td th ul".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in _RAW}


WEAK, STRONG, SURE = 1, 2, 3  # how much an element says that it is boilerplate


def _says_boilerplate(name: str, attributes: str) -> int:
    """WEAK or STRONG by class and id, SURE by role and hiding, else 0."""
    if not attributes or attributes.isspace():
        return 0
    values = {}
    for found in _ATTRIBUTE.finditer(attributes):
        values.setdefault(found[1].lower(), found[2] or found[3] or found[4] or "")
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return SURE
    if values.get("role", "").lower() in _ROLES:
        return SURE
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return SURE
    said = 0
    for label in f"{values.get('class', '')} {values.get('id', '')}".split():
        parts = [p.lower() for p in _NAME.findall(label)]
        hits = _NAMES.intersection(parts)
        if not hits or parts[0] in _NOT_THE_THING or (hits == {"header"} and _OF_CONTENT.intersection(parts)):
            continue
        if hits & _STRONG:
            return STRONG
        if name not in _LANDMARK:
            said = WEAK
    return said


class _Page:
    """The lines found so far, the open elements, and the ranges of lines of elements that may be boilerplate."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.kinds: list[str] = []
        self.stack: list[tuple[str, int, list[int] | None, list[int] | None]] = []
        self.open: Counter[str] = Counter()
        self.counts = {SURE: 0, STRONG: 0, "landmark": 0, "prose": 0, "unseen": 0}
        self.hints: list[list[int]] = []  # first line, line after the last, WEAK or STRONG
        self.landmarks: list[list[int]] = []  # first line, line after the last, whether in what is STRONG
        self.run: list[str] = []

    def end_line(self) -> None:
        if self.run:
            text = " ".join(html.unescape("".join(self.run)).split())
            self.run.clear()
            if text:
                self.texts.append(text)
                if self.counts[SURE]:
                    self.kinds.append(BOILERPLATE)
                elif not self.counts["landmark"]:
                    self.kinds.append(OPEN)
                else:
                    self.kinds.append(PROSE if self.counts["prose"] else INSIDE)

    def begin(self, name: str, said: int) -> None:
        at, hint, landmark = len(self.texts), None, None
        if said in (WEAK, STRONG):
            hint = [at, at, said]
            self.hints.append(hint)
        if said in (SURE, STRONG):
            self.counts[said] += 1
        if name in _LANDMARK:
            self.counts["landmark"] += 1
            if not self.counts[SURE]:
                landmark = [at, at, self.counts[STRONG] > 0]
                self.landmarks.append(landmark)
        self.counts["prose"] += name in _PROSE
        self.counts["unseen"] += name in _UNSEEN
        self.open[name] += 1
        self.stack.append((name, said, hint, landmark))

    def close(self, down_to: int) -> None:
        if any(hint and name in _SPACED for name, _, hint, _ in self.stack[down_to:]):
            self.end_line()  # the rest of the row is not in this cell
        while len(self.stack) > down_to:
            name, said, hint, landmark = self.stack.pop()
            for held in (hint, landmark):
                if held:
                    held[1] = len(self.texts)
            if said in (SURE, STRONG):
                self.counts[said] -= 1
            self.counts["landmark"] -= name in _LANDMARK
            self.counts["prose"] -= name in _PROSE
            self.counts["unseen"] -= name in _UNSEEN
            self.open[name] -= 1

    def settle(self) -> str:
        """The kinds, once it is known which hints hold what the page is about."""
        ends = [0, *accumulate(len(t) if k != BOILERPLATE else 0 for t, k in zip(self.texts, self.kinds))]
        size = lambda held: ends[held[1]] - ends[held[0]]
        best = max((m for m in self.landmarks if not m[2] and size(m)), key=size, default=None)
        best = best or max((m for m in self.landmarks if size(m)), key=size, default=None)
        covered = [0] * (len(self.texts) + 1)
        for hint in self.hints:
            if best:
                keeps = hint[0] <= best[0] and best[1] <= hint[1]
            else:
                keeps = size(hint) * 2 > ends[-1] if hint[2] == WEAK else size(hint) == ends[-1]
            if not keeps:
                covered[hint[0]] += 1
                covered[hint[1]] -= 1
        return "".join(BOILERPLATE if n else kind for n, kind in zip(accumulate(covered), self.kinds))


def lines(page: str) -> tuple[list[str], str]:
    """The page's lines and their kinds, one letter per line."""
    state = _Page()
    stack, run = state.stack, state.run
    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        text = page[at : found.start() if found else size]
        if text and not state.counts["unseen"]:
            run.append(text)
        if found is None:
            break
        at = found.end()
        name = found[2] or found[5]
        if name is None:
            continue
        name = name.lower()
        if found[1] or found[4]:  # an end tag closes what is open inside its element; strays are ignored
            place = None
            if state.open[name]:
                place = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
            if name in _BLOCK or (place is not None and any(element[0] in _BLOCK for element in stack[place:])):
                state.end_line()
            elif name in _SPACED:
                run.append(" ")
            if place is not None:
                state.close(place)
            continue
        attributes = found[3] if found[2] else found[6]
        if name in _RAW:
            end = None if attributes.endswith("/") else _ENDS[name].search(page, at)
            if end:
                at = end.end()
                continue
            if name in _TO_THE_END:
                at = at if attributes.endswith("/") else size
                continue
        if name == "svg" and attributes.endswith("/"):
            continue
        if name in _BLOCK:
            state.end_line()
            for ended in ("svg", "head"):  # a block ends a drawing, and what comes before the body
                if state.open[ended]:
                    state.close(next(i for i, element in enumerate(stack) if element[0] == ended))
        elif name in _SPACED:
            run.append(" ")
        if name in _VOID:
            continue
        if name in _CLOSES_P or name in ("li", "dd", "dt", "tr", "td", "th"):
            _imply(name, state)
        said = 0
        if name in _FRAME or (name == "header" and not state.counts["landmark"]):
            said = SURE
        elif name not in ("html", "body"):
            said = max(_says_boilerplate(name, attributes), WEAK if name in _MAYBE_FRAME else 0)
        if said and name in _SPACED:
            state.end_line()
        state.begin(name, said)
    state.end_line()
    state.close(0)
    return state.texts, state.settle()


def _imply(name: str, state: _Page) -> None:
    """Close what the start of ``name`` ends without an end tag: an open paragraph, or the last item of its kind."""
    same = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
    ends, stack = same.get(name, {"p"}) | {"p"}, state.stack
    if not any(state.open[e] for e in ends):
        return
    for place in range(len(stack) - 1, -1, -1):
        if stack[place][0] in ends:
            state.close(place)
            if stack[place - 1 : place] and name in same:
                _imply(name, state)
            return
        if stack[place][0] in _SCOPE - same.get(name, set()):
            return
