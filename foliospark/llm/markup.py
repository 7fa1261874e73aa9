"""Shown text and tags of HTML in one linear pass, for the operators that read pages.

Attribute values in quotes may hold any character. Comments, raw text elements and declarations are left out, unclosed ones to the
end of the page, and so is a tag that the page ends in. Elements whose content isn't shown (`hidden`) are left out up to their end
tag; one without an end tag hides nothing, and a head also ends where its page's body begins.

Defined cases: null counts as empty; stray end tags are reported like others; `<` before anything but a name, `/`, `!` or `?` is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Fixed values of HTML: elements whose content is raw text, and those that a head may hold.
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title noframes".split())

TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(?:[!?]|/(?![A-Za-z]))[^>]*+(?:>|\Z)"
    r"|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z))",
    re.S,
)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.S)


def attributes(rest: str) -> Iterator[tuple[str, str]]:
    """Names in lower case and raw values of a tag's attributes; those without a value are left out."""
    for name, double, single, bare in ATTRIBUTE.findall(rest):
        yield name.lower(), double or single or bare


def shown(page: str | None, hidden: tuple[str, ...] = ()) -> Iterator[tuple[str, str, str]]:
    """(text, name, rest) in page order: the text before a tag, the tag's name in lower case (with a slash for an end tag, empty
    where nothing but text was left out) and what follows the name. The last item has the text after all tags."""
    page = page or ""
    at, inside = 0, ""
    last: dict[str, int] = {}
    while (m := TOKEN.search(page, at)) is not None:
        text = "" if inside else page[at : m.start()]
        at = m.end()
        name, closing = (m["name"] or "").lower(), m["close"]
        if inside:
            if name == inside and closing:
                inside = ""
                continue
            if inside == "head" and name and not closing and name not in IN_HEAD:
                inside = ""
            elif name in _ENDS and not closing:
                at = _after(page, at, name)
                continue
            else:
                continue
        if name in _ENDS:
            at = at if closing else _after(page, at, name)
            yield text, "", ""
        elif name in hidden and not closing and not m["rest"].endswith("/"):
            if name not in last:
                last[name] = page.lower().rfind(f"</{name}")
            if name == "head" or last[name] >= at:
                inside = name
            yield text, "", ""
        elif name:
            yield text, ("/" if closing else "") + name, m["rest"]
        else:
            yield text, "", ""
    yield "" if inside else page[at:], "", ""


def _after(page: str, at: int, name: str) -> int:
    """Where the end tag of a raw element begins; the end of the page without one."""
    end = _ENDS[name].search(page, at)
    return end.start() if end else len(page)
