"""A tree-structured graphical model of content and boilerplate, with exact sum-product inference.

Every node of a page's tree is content (its subtree holds article text) or not. Node potentials are sums
of feature weights, edge potentials join a node's label with its parent's. Messages pass from the
leaves to the root and back, one depth of all pages at a time; the result is every node's marginal.
Training raises the likelihood of labelled pages: observed minus expected counts of features.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from matchspark.llm.domtree import Page

# fixed values: element names that have a feature of their own
TAGS = ("#root #text html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th caption "
        "pre blockquote figure figcaption hr header footer nav aside form fieldset button address details summary center "
        "input menu dialog").split()
_TAG = {t: i for i, t in enumerate(TAGS)}
# fixed values: words in class, id and role that tell what a block is for
HINTS = [r"nav|menu|breadcrumb|crumb|toc|pag(?:er|ination)|tabs?\b|skip", r"header|banner|masthead|topbar|branding|logo|toolbar",
         r"foot|copyright|legal|colophon|bottom", r"side|aside|rail|widget|related|recommend|popular|trending|more-|complementary",
         r"notice|cookie|consent|gdpr|alert|popup|modal|overlay|warning|announce|paywall",
         r"(?:^|[\s_-])ads?(?:$|[\s_-])|advert|sponsor|promo|banner-ad|adsense|outbrain|taboola|affiliate",
         r"form|search|login|signup|sign-up|subscribe|newsletter|contact|input",
         r"comment|repl(?:y|ies)|discuss|disqus|respon[sd]|feedback|review|guestbook",
         r"share|social|follow|tweet|like-",
         r"article|post|entry|story|content|main|body|text|prose|blog",
         r"byline|meta|author|date|tags?\b|category"]
_HINT = [re.compile(h) for h in HINTS]
_ENDS_SENTENCE = (".", "!", "?", ":", "…", "\"", "”", "»", ")")
_OWN = np.array([1, 4, 10, 25, 60])
_SUB = np.array([1, 10, 40, 120, 400])
_SHARE = np.array([0.01, 0.3, 0.7])
_PLACE = np.array([0.02, 0.15, 0.85, 0.98])
# fixed values: element names by the part they play; an edge's potentials depend on its lower end (the last kind:
# other elements, and those whose class, id or role names a part that is no article)
_EDGE_KIND = {"#text": 0, **dict.fromkeys("p h1 h2 h3 h4 h5 h6 pre blockquote td th tr tbody table li ul ol dl dt dd hr".split(), 1),
              **dict.fromkeys("div section center html body main article #root".split(), 2)}
N_EDGES = 4
#: Number of values of each feature slot.
SLOTS = [len(TAGS) + 1, *[2] * len(HINTS), 6, 4, 2, 2, 6, 4, 5, len(TAGS) + 1, 6]
_BASE = np.concatenate([[0], np.cumsum(SLOTS)])
N_FEATURES = int(_BASE[-1])
_hints: dict[str, tuple[int, ...]] = {}


def hints_of(attrs: str) -> tuple[int, ...]:
    found = _hints.get(attrs)
    if found is None:
        if len(_hints) > 50_000:
            _hints.clear()
        found = _hints[attrs] = tuple(int(bool(h.search(attrs))) for h in _HINT)
    return found


@dataclass
class Forest:
    """Several pages as one: feature indices, parents and the nodes of each depth."""

    features: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]
    page: np.ndarray
    kind: np.ndarray  # which edge potentials join a node to its parent


def forest(pages: list[Page]) -> Forest:
    sizes = [len(p.tag) for p in pages]
    base = np.cumsum([0, *sizes])
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + b) for p, b in zip(pages, base)])
    depth = np.concatenate([p.depth for p in pages]).astype(np.int64)
    page = np.repeat(np.arange(len(pages)), sizes)
    tags = np.array([_TAG.get(t, len(TAGS)) for p in pages for t in p.tag])
    texts = [t for p in pages for t in p.text]
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts], np.float64)
    size = np.array([len(t) for t in texts], np.float64)
    linked = np.minimum(np.array([x for p in pages for x in p.linked], np.float64), size)
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    levels = np.split(order, cuts)
    sub_words, sub_size, sub_linked = words.copy(), size.copy(), linked.copy()
    for level in levels[:0:-1]:
        for a in (sub_words, sub_size, sub_linked):
            np.add.at(a, parent[level], a[level])
    before = np.cumsum(words) - words
    first = before[base[:-1]][page]
    total = np.maximum(sub_words[base[:-1]][page], 1)
    middle = (before - first + sub_words / 2) / total
    share = lambda a, b: np.digitize(a / np.maximum(b, 1), _SHARE)
    up = np.where(parent >= 0, parent, 0)
    columns = [tags, *np.array([hints_of(a) for p in pages for a in p.attrs]).T,
               np.digitize(words, _OWN), share(linked, size),
               np.array([t.endswith(_ENDS_SENTENCE) for t in texts], np.int64),
               np.array(["©" in t or "(c)" in t for t in texts], np.int64),
               np.digitize(sub_words, _SUB), share(sub_linked, sub_size), np.digitize(middle, _PLACE), tags[up],
               np.digitize(sub_words[up], _SUB)]
    kind = np.array([N_EDGES - 1 if any(hints_of(a)[:9]) else _EDGE_KIND.get(t, N_EDGES - 1)
                     for p in pages for t, a in zip(p.tag, p.attrs)])
    return Forest(np.stack(columns, axis=1) + _BASE[:-1], parent, levels, page, kind)


@dataclass
class TreeModel:
    weight: np.ndarray  # (features,): log odds of content
    edge: np.ndarray  # (edge kind, parent label, own label)

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content of every node, and the joint of (parent, own) labels of every edge."""
        n = len(f.parent)
        up = np.zeros((n, 2))  # potential and messages from below
        up[:, 1] = self.weight[f.features].sum(axis=1)
        message = np.zeros((n, 2))  # to the parent
        for level in f.levels[:0:-1]:
            edge = self.edge[f.kind[level]]
            message[level] = np.logaddexp(up[level, :1] + edge[:, :, 0], up[level, 1:] + edge[:, :, 1])
            np.add.at(up, f.parent[level], message[level])
        down = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            above = f.parent[level]
            rest = up[above] + down[above] - message[level]
            table = rest[:, :, None] + self.edge[f.kind[level]]
            down[level] = np.logaddexp(table[:, 0], table[:, 1])
            both = table + up[level][:, None, :]
            both -= both.max(axis=(1, 2), keepdims=True)
            e = np.exp(both)
            joint[level] = e / e.sum(axis=(1, 2), keepdims=True)
        total = up + down
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60))), joint


def labels_of(page: Page) -> np.ndarray:
    """1 for runs of article text and for every element above one."""
    y = np.array([l if t == "#text" else 0 for l, t in zip(page.label, page.tag)])
    for i in range(len(y) - 1, 0, -1):
        if y[i]:
            y[page.parent[i]] = 1
    return y


def train(pages: list[Page], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-4) -> TreeModel:
    """Fit to labelled pages by Adam on the likelihood of whole trees."""
    f = forest(pages)
    y = np.concatenate([labels_of(p) for p in pages])
    model = TreeModel(np.zeros(N_FEATURES), np.zeros((N_EDGES, 2, 2)))
    has_parent = f.parent >= 0
    kind = f.kind[has_parent]
    seen = np.zeros(model.edge.shape)
    np.add.at(seen, (kind, y[f.parent[has_parent]], y[has_parent]), 1)
    n = len(y)
    state = [np.zeros(N_FEATURES + seen.size), np.zeros(N_FEATURES + seen.size)]
    for step in range(1, rounds + 1):
        p, joint = model.marginals(f)
        expected = np.zeros_like(seen)
        np.add.at(expected, kind, joint[has_parent])
        grad = np.bincount(f.features.ravel(), np.repeat(y - p, f.features.shape[1]), N_FEATURES)
        both = np.concatenate([grad, (seen - expected).ravel()]) / n
        both -= ridge * np.concatenate([model.weight, model.edge.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * both
        state[1] = 0.99 * state[1] + 0.01 * both * both
        move = rate * (state[0] / (1 - 0.9 ** step)) / (np.sqrt(state[1] / (1 - 0.99 ** step)) + 1e-8)
        model.weight += move[:N_FEATURES]
        model.edge += move[N_FEATURES:].reshape(seen.shape)
    return model
