"""A single pass over one HTML text that collects the elements a few CSS selectors name.

Elements are matched when their start tag is read, against the stack of open elements, and their text
is gathered until they are closed; no tree is kept. ``<p>`` and the like are not closed implicitly, so an
unclosed element holds the text of those that follow inside it. ``repeat=False`` gives such text to the inner
element only, which keeps the output no longer than the page.
"""

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser

# Elements without content, and elements whose text is not page text.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
SILENT_TAGS = frozenset(("script", "style", "template", "rt", "rp"))

_SIMPLE = re.compile(
    r"""\#(?P<id>[\w-]+) | \.(?P<cls>[\w-]+) | (?P<tag>\*|[A-Za-z][\w-]*)
      | :(?P<pseudo>first-child|nth-child|not)(?:\((?P<argument>[^)]*)\))?
      | \[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?P<quote>["']?)(?P<value>.*?)(?P=quote)\s*)?\]""",
    re.VERBOSE,
)

_PART = re.compile(r"(?P<step>[>+~])|(?P<compound>(?:\[[^\]]*\]|\([^)]*\)|[^\s\[(>+~])+)")
_EVERY = re.compile(r"(?P<step>[+-]?\d*)n\s*(?P<first>[+-]\s*\d+)?|(?P<only>\d+)")


class Element:
    """A start tag with its place: the element around it and the ones before it."""

    __slots__ = ("tag", "attrs", "parent", "children", "place")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.place = len(parent.children) if parent else 0

    def reached(self, step: str) -> Iterator["Element"]:
        """The elements a selector step may lead from, to this one."""
        if step == " ":
            above = self.parent
            while above and above.parent:  # the page itself is no element
                yield above
                above = above.parent
        elif step == ">":
            if self.parent and self.parent.parent:
                yield self.parent
        elif self.parent and self.place:
            yield from self.parent.children[self.place - 1 : self.place] if step == "+" else self.parent.children[: self.place]


def _nth(argument: str):
    """``2``, ``odd``, ``2n+1`` and the like as a test of a place counted from 1."""
    found = _EVERY.fullmatch({"odd": "2n+1", "even": "2n"}.get(argument.strip(), argument.strip()))
    if not found:
        raise ValueError(f"unsupported place: {argument!r}")
    if found["only"]:
        return lambda place: place == int(found["only"])
    step = int(f"{found['step']}1" if found["step"] in ("", "+", "-") else found["step"])
    first = int((found["first"] or "0").replace(" ", ""))
    return lambda place: place == first if step == 0 else (place - first) % step == 0 and (place - first) // step >= 0


def _test(part: re.Match[str]):
    """One simple selector as a predicate over an element."""
    name, value = part["attr"], part["value"]
    if part["id"]:
        return lambda e: e.attrs.get("id") == part["id"]
    if part["cls"]:
        return lambda e: part["cls"] in e.attrs.get("class", "").split()
    if part["tag"]:
        return lambda e: part["tag"] in ("*", e.tag)
    if part["pseudo"] == "not":
        inner = _tests(part["argument"] or "")
        return lambda e: not all(test(e) for test in inner)
    if part["pseudo"]:
        fits = _nth("1" if part["pseudo"] == "first-child" else part["argument"] or "")
        return lambda e: e.parent is not None and fits(e.place + 1)
    compare = {
        None: lambda have: True,
        "=": lambda have: have == value,
        "*=": lambda have: value != "" and value in have,
        "^=": lambda have: value != "" and have.startswith(value),
        "$=": lambda have: value != "" and have.endswith(value),
        "~=": lambda have: value in have.split(),
        "|=": lambda have: have == value or have.startswith(f"{value}-"),
    }[part["op"]]
    return lambda e: name in e.attrs and compare(e.attrs[name])


def _tests(compound: str) -> list:
    tests, at = [], 0
    while at < len(compound):
        part = _SIMPLE.match(compound, at)
        if not part or part.end() == at:
            raise ValueError(f"unsupported selector: {compound!r}")
        tests.append(_test(part))
        at = part.end()
    if not tests:
        raise ValueError("empty selector")
    return tests


@lru_cache(maxsize=4096)
def parse_selector(selector: str) -> tuple:
    """Alternatives of chains: ``h1#a, .b > p`` gives, for each compound, the step before it and its tests.

    Knows tag, ``#id``, ``.class``, attribute tests, ``:first-child``, ``:nth-child()`` and ``:not()`` of one compound, the
    steps space, ``>``, ``+`` and ``~``, and the comma; anything else is refused rather than ignored.
    """
    chains = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        chain, step = [], " "
        if _PART.sub("", alternative).strip():
            raise ValueError(f"unsupported selector: {selector!r}")
        for part in _PART.finditer(alternative):
            if part["step"]:
                if not chain or step != " ":
                    raise ValueError(f"unsupported selector: {selector!r}")
                step = part["step"]
            else:
                chain.append((step, _tests(part["compound"])))
                step = " "
        if not chain or step != " ":
            raise ValueError(f"empty selector: {selector!r}")
        chains.append(chain)
    return tuple(chains)


def _matches(chain: list, element: Element, at: int) -> bool:
    step, tests = chain[at]
    if not all(test(element) for test in tests):
        return False
    return at == 0 or any(_matches(chain, earlier, at - 1) for earlier in element.reached(step))


class Collector(HTMLParser):
    """Gathers, per named selector, the attributes and the text pieces of every matching element."""

    def __init__(self, selectors: dict[str, str], repeat: bool = True):
        super().__init__(convert_charrefs=False)
        self._selectors = {name: parse_selector(selector) for name, selector in selectors.items()}
        self.found: dict[str, list[tuple[dict, list[str]]]] = {name: [] for name in selectors}
        self._root = Element("", {}, None)
        self._opened: list[Element] = [self._root]
        self._catching: list[dict[str, list[str]]] = []
        self._repeat = repeat
        self._silent = 0
        self._run: list[str] = []

    def _end_run(self) -> None:
        text = "".join(self._run).strip()
        self._run.clear()
        if text and not self._silent:
            served: set[str] = set()
            for catchers in reversed(self._catching):
                for name, pieces in catchers.items():
                    if self._repeat or name not in served:
                        pieces.append(text)
                served.update(catchers)

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs)
        if tag in VOID_TAGS:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)
        self._close()

    def _open(self, tag, attrs) -> None:
        self._end_run()
        parent = self._opened[-1]
        element = Element(tag, {name: value or "" for name, value in attrs}, parent)
        parent.children.append(element)
        catchers: dict[str, list[str]] = {}
        for name, chains in self._selectors.items():
            if any(_matches(chain, element, len(chain) - 1) for chain in chains):
                pieces: list[str] = []
                self.found[name].append((element.attrs, pieces))
                catchers[name] = pieces
        self._opened.append(element)
        self._catching.append(catchers)
        self._silent += tag in SILENT_TAGS

    def _close(self) -> None:
        tag = self._opened.pop().tag
        self._catching.pop()
        self._silent -= tag in SILENT_TAGS

    def handle_endtag(self, tag):
        self._end_run()
        if any(tag == element.tag for element in self._opened):
            while self._opened[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self._run.append(data)

    def handle_charref(self, name):
        self._run.append(html.unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self._run.append(html5.get(f"{name};", f"&{name}"))

    def handle_comment(self, data):
        self._end_run()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._end_run()
        if data.upper().startswith("CDATA["):
            self._run.append(data[6:])
            self._end_run()


class PageFault(ValueError):
    """A page or a selector that cannot be read."""


def collect(markup: str, selectors: dict[str, str], repeat: bool = True) -> dict[str, list[tuple[dict, list[str]]]]:
    try:
        collector = Collector(selectors, repeat)
        collector.feed(markup)
        collector.close()
    except (AssertionError, ValueError, RecursionError) as problem:
        raise PageFault(f"HTML 파싱 실패: {problem}") from None
    collector._end_run()
    return collector.found
