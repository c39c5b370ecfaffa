"""The text nodes of a page and the elements they hang in."""

from __future__ import annotations

from html import unescape

from gossamer.functions.html import TAG, TOKEN, body_part

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd label mark q s samp small span strong sub sup time tt u var".split())
BOXES = frozenset("article aside body div footer form header main nav section td".split())
CHROME_TAGS = frozenset("aside button dialog footer form nav select option menu".split())
SELF_CLOSING = frozenset(("p", "li", "td", "tr", "option", "dd", "dt"))
CODE_TAGS = frozenset(("pre", "code", "kbd", "samp", "tt", "textarea"))
HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Page:
    """Text nodes of a body in document order, with what the operators need of the DOM."""

    __slots__ = ("text", "elem", "tag", "parent", "label")

    def __init__(self, page: str):
        text: list[str] = []
        elem: list[int] = []
        tag, parent, at = ["body"], [-1], 0
        match = TAG.match
        odd = False
        for token in TOKEN.split(body_part(page)):
            if not odd:
                odd = True
                if token and not token.isspace():
                    if "&" in token:
                        token = unescape(token)
                    token = token.strip()
                    if token:
                        text.append(token)
                        elem.append(at)
                continue
            odd = False
            m = match(token)
            if m is None:
                continue
            name = m[2].lower()
            if m[1]:
                e = at
                while e > 0 and tag[e] != name:
                    e = parent[e]
                if e > 0:
                    at = parent[e]
            elif name not in VOID and name not in ("script", "style", "noscript", "template") and token[-2] != "/":
                if name in SELF_CLOSING and tag[at] == name:
                    at = parent[at]
                tag.append(name)
                parent.append(at)
                at = len(tag) - 1
        self.text, self.elem, self.tag, self.parent = text, elem, tag, parent
        self.label: list[bool] = []
