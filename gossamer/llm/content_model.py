"""What a text node of a page looks like, and the classifier that gives it a cost.

No labelled pages are needed. A prior over the structure alone labels a bounded sample of pages through the minimum cut; a log-linear
model of structure and words is fitted to those labels and labels the sample again, for ``ROUNDS`` rounds. Words that mark menus,
notices, prompts or bylines are thus learned from the corpus, in whatever languages it has.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

import numpy as np

from gossamer.llm.page import BOXES, CHROME_TAGS, CODE_TAGS, HEADS, INLINE, Page

#: Pages that the model is fitted on, by the hash of their names, and rounds of fitting. Both bound the driver's work.
SAMPLE_PAGES, ROUNDS = 600, 3
#: A word counts as a feature if it stands in so many different nodes of the sample; nodes of more words are told by structure.
LEAST_NODES, MOST_WORDS = 4, 24
#: Costs are log-odds within this range, so that no single node outvotes its surroundings.
MOST_COST = 2.5
#: A label that stands on less than this isn't learned from.
LEAST_COST = 0.25
#: Short texts whose odds a process remembers.
MOST_HELD = 1 << 15
SENTENCE_END = (".", "!", "?", "…", ".”", '."', "。")
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


class Layout:
    """Where the nodes of a page lie relative to its main box."""

    __slots__ = ("page", "words", "sentence", "chrome", "link", "block", "box", "buttons", "main", "branch", "groups", "bare")

    def __init__(self, page: Page, odds: Sequence[float] | None = None):
        """``odds``: per node the log-odds by its words alone, which discount what a box is credited with."""
        self.page = page
        text, elem, tag, parent = page.text, page.elem, page.tag, page.parent
        n, m = len(text), len(tag)
        self.chrome, self.link, self.block, self.box = [False] * m, [False] * m, [0] * m, [0] * m
        chrome, link, block, box = self.chrome, self.link, self.block, self.box
        self.buttons = set()
        for e in range(1, m):
            p, t = parent[e], tag[e]
            chrome[e] = chrome[p] or t in CHROME_TAGS
            link[e] = link[p] or t == "a"
            block[e] = block[p] if t in INLINE else e
            box[e] = e if t in BOXES else box[p]
            if t in ("button", "form", "select"):
                self.buttons.add(p)
        self.words = [t.count(" ") + 1 for t in text]
        self.sentence = [self.words[i] >= 4 and text[i].endswith(SENTENCE_END) for i in range(n)]
        self.main = self._main_box(odds)
        # The branch of each element: the child of the main box that it hangs in (the main box for text right in it), -1 outside.
        main = self.main
        self.branch = branch = [-1] * m
        branch[main] = main
        for e in range(main + 1, m):
            p = parent[e]
            branch[e] = (main if tag[e] in INLINE else e) if p == main else branch[p]
        self.groups: dict[int, list[int]] = {}
        for i in range(n):
            self.groups.setdefault(branch[elem[i]], []).append(i)
        # A main box that hardly says anything in sentences is a page of nothing but lists, keywords or cells.
        inside = [i for i in range(n) if branch[elem[i]] != -1]
        self.bare = 3 * sum(self.words[i] for i in inside if self.sentence[i]) < sum(self.words[i] for i in inside)

    def _main_box(self, odds: Sequence[float] | None) -> int:
        """The box in which most running text hangs directly; a headline weighs as much as a paragraph or three."""
        text, elem, tag, parent, block, box = self.page.text, self.page.elem, self.page.tag, self.page.parent, self.block, self.box
        score: dict[int, float] = {}
        closed: set[int] = set()
        for i in range(len(text)):
            e = elem[i]
            if self.chrome[e]:
                continue
            b = block[e]
            home = box[b]
            trust = 1.0 if odds is None else 1.0 / (1.0 + math.exp(-odds[i]))
            if tag[b] in HEADS and tag[b] != "h1" and trust < 0.2 and home not in score:
                closed.add(home)  # a box that opens with a heading over other pages or readers' words
            if tag[b] == "h1":
                score[home] = score.get(home, 0.0) + 150 * max(trust, 0.5)
                continue
            if home in self.buttons:
                continue
            gain = float(self.words[i]) * trust
            if self.link[e] or not self.sentence[i]:
                gain *= 0.25
            if tag[b] == "td" and not self.sentence[i] and self.words[i] <= 8:
                home = box[parent[home]]
            score[home] = score.get(home, 0.0) + (gain if home else 0.5 * gain)
            if home == b and tag[b] == "div":
                # A div with text of its own may be a mere paragraph of the box around it.
                outer = box[parent[b]]
                score[outer] = score.get(outer, 0.0) + gain * (0.9 if outer else 0.5)
        for k in closed:
            for j in list(score):
                if j and _inside(j, k, parent):
                    score[j] = 0.0
        best = max(score, key=lambda k: (score[k], -k)) if score else 0
        return best if score and score[best] > 0 else 0


def _inside(e: int, box: int, parent: list[int]) -> bool:
    while e > box:
        e = parent[e]
    return e == box


def structure_features(at: Layout) -> list[list[str]]:
    """Per node the names of what holds of its place: zone, block, link and position. What its neighbours are is left to the cut."""
    page, words, sentence = at.page, at.words, at.sentence
    elem, tag, block = page.elem, page.tag, at.block
    out: list[list[str]] = [[] for _ in words]
    running = [i for i in range(len(words)) if sentence[i] and at.branch[elem[i]] != -1]
    first, last = (running[0], running[-1]) if running else (0, len(words))
    for b, members in at.groups.items():
        zone = "out" if b == -1 else "main" if b == at.main else tag[b]
        if at.bare and b != -1:
            zone = f"bare {zone}"
        for i in members:
            e = elem[i]
            kind = "s" if sentence[i] else "m" if words[i] >= 4 else "n"
            block_tag = tag[block[e]]
            f = out[i]
            f.append(f"{zone}|{kind}")
            f.append(f"{zone}|<{block_tag}>")
            if b == -1:
                f.append(f"out|home:{tag[at.box[block[e]]]}|{kind}")
            if at.chrome[e]:
                f.append("chrome")
            if at.link[e]:
                f.append(f"{zone}|link")
            f.append(f"{zone}|{'before' if i < first else 'after' if i > last else 'amid'}")
    return out


def page_words(page: Page) -> list[list[str]]:
    """``word_features`` of each node; the words of code tell nothing."""
    return [[] if page.tag[e] in CODE_TAGS else word_features(t, t.count(" ") + 1) for t, e in zip(page.text, page.elem)]


def word_features(text: str, n_words: int) -> list[str]:
    """Words of a short node, digits as one number word, the first and last marked; of a long one only that it is long."""
    if n_words > MOST_WORDS:
        return ["w:long"]
    found = ["0" if w[0].isdigit() else w for w in _WORD.findall(text.lower())]
    out = {f"w:{w}" for w in found}
    if found:
        out.add(f"w^{found[0]}")
        out.add(f"w${found[-1]}|{min(n_words, 6)}")
    if n_words <= 3:
        out.add("w=" + " ".join(found))
    return sorted(out)


def prior_costs(at: Layout) -> list[float]:
    """Costs by structure alone: what a page of sound markup would be."""
    page, words, sentence, elem, tag = at.page, at.words, at.sentence, at.page.elem, at.page.tag
    costs = [0.0] * len(words)
    for b, members in at.groups.items():
        pressed = b not in (-1, at.main) and any(_inside(e, b, page.parent) for e in at.buttons)
        total = sum(words[i] for i in members)
        linked = sum(words[i] for i in members if at.link[elem[i]])
        for i in members:
            e = elem[i]
            block_tag = tag[at.block[e]]
            if at.chrome[e]:
                u = -4.0
            elif b == -1:
                u = -2.0 if sentence[i] else -3.0
            elif b == at.main:
                u = 2.0
            elif pressed:
                u = -2.5
            elif tag[b] in ("div", "section", "span"):
                u = 0.4 if sentence[i] else 1.0 if page.text[i][0] == "#" else 0.2 if at.bare else -1.0
            elif tag[b] in ("ul", "ol") and linked * 2 > total:
                u = 0.2 if at.bare else -0.3
            elif block_tag in HEADS:
                u = 3.0 if block_tag == "h1" else 0.3
            else:
                u = 2.5 if sentence[i] else 1.0
            costs[i] = u
    return costs


class ContentModel:
    """Weights of words and of structure; together a node's log-odds of being the page's own content.

    Words are fitted first and without a bias, structure on what they leave open: a node of unknown words has weak odds, and its
    surroundings decide.
    """

    def __init__(self, words: dict[str, float] | None = None, structure: dict[str, float] | None = None):
        self.words, self.structure = words or {}, structure or {}
        self._odds: dict[str, float] = {}

    def word_odds(self, page: Page) -> list[float] | None:
        """Per node the log-odds by its words alone; null before any fitting."""
        if not self.words:
            return None
        return [0.0 if page.tag[e] in CODE_TAGS else self._odds_of(t) for t, e in zip(page.text, page.elem)]

    def _odds_of(self, text: str) -> float:
        # Menus and prompts repeat from page to page.
        found = self._odds.get(text)
        if found is None:
            found = _within(sum(self.words.get(f, 0.0) for f in word_features(text, text.count(" ") + 1)))
            if len(text) <= 60:
                if len(self._odds) >= MOST_HELD:
                    self._odds.clear()
                self._odds[text] = found
        return found

    def layout(self, page: Page) -> tuple[Layout, list[float]]:
        """The page's layout and its nodes' costs."""
        odds = self.word_odds(page)
        at = Layout(page, odds)
        if odds is None:
            return at, prior_costs(at)
        get = self.structure.get
        costs = prior_costs(at)
        return at, [_within(costs[i] + odds[i] + get("", 0.0) + sum(get(f, 0.0) for f in names)) for i, names in enumerate(structure_features(at))]


def _within(cost: float) -> float:
    return max(-MOST_COST, min(MOST_COST, cost))


def fit_weights(rows: list[list[str]], labels: np.ndarray, offset: np.ndarray | None = None, penalty: float = 0.5, steps: int = 100) -> dict[str, float]:
    """Logistic regression over named features ("" is the bias, given an ``offset``), by full-batch steps of AdaGrad.

    The same rows give the same weights.
    """
    count = Counter(f for row in rows for f in row)
    names = sorted(f for f, k in count.items() if k >= LEAST_NODES)
    index = {f: j for j, f in enumerate(names)}
    bias = [] if offset is None else [len(names)]
    cols = [bias + [index[f] for f in row if f in index] for row in rows]
    at = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    cols = np.fromiter((c for row in cols for c in row), dtype=np.int64, count=len(at))
    base = np.zeros(len(rows)) if offset is None else offset
    w, squares = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-6)
    for _ in range(steps):
        z = base + np.bincount(at, weights=w[cols], minlength=len(rows))
        error = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = np.bincount(cols, weights=error[at], minlength=len(w)) + penalty * w
        squares += grad * grad
        w -= 0.5 * grad / np.sqrt(squares)
    return {"": float(w[-1]), **{f: float(w[j]) for f, j in index.items()}}


def fit(pages: Iterable[Page], cut: Callable[[Layout, list[float]], list[bool]], rounds: int = ROUNDS) -> ContentModel:
    """The model after ``rounds`` of labelling the pages by ``cut`` and fitting the labels. No page gives the prior."""
    held = [p for p in pages if p.text]
    words = [page_words(p) for p in held]
    model = ContentModel()
    for _ in range(rounds if held else 0):
        said: list[list[str]] = []
        placed: list[list[str]] = []
        labels: list[bool] = []
        before: list[float] = []
        for page, found in zip(held, words):
            at, costs = model.layout(page)
            told, prior = structure_features(at), prior_costs(at)
            for i, label in enumerate(cut(at, costs)):
                if abs(costs[i]) >= LEAST_COST:
                    said.append(found[i])
                    placed.append(told[i])
                    labels.append(label)
                    before.append(prior[i])
        y = np.asarray(labels, dtype=float)
        by_words = fit_weights(said, y)
        offset = np.array([_within(sum(by_words.get(f, 0.0) for f in row)) for row in said]) + np.array(before)
        model = ContentModel(by_words, fit_weights(placed, y, offset))
    return model
