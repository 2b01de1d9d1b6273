"""Main text of web pages by tag-path ratios.

Every text node has a path of tags from the root. Paths that carry prose collect much text and much
punctuation per node; menus, notices and footers collect little. Per page, both ratios are aggregated
by path, laid along the node sequence, smoothed, fused, and cut at their spread. Every node above the cut
(before and after smoothing) is returned, unless it is in a part marked as something else (navigation, forms, adverts, comments and the
like). So are the other blocks around them that are not marked so: those of the element that holds most of the
chosen text (of its <article> or <main>, where there is one), those of the closest element of a chosen node
outside of it, on pages without <article> and <main> also those between the first and the last chosen node,
and the headings in front.

Defined results: null, empty and text-free pages give an empty text. Mark-up may be cut off anywhere. Every
row gives a row, repeated or not. An empty table gives an empty table. Further columns play no part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|textarea|noscript|template|svg|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？：；]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var img wbr br input".split())
_OTHER_PARTS = frozenset("head nav footer aside form button select option menu dialog object canvas map audio video".split())
_HOLDERS = frozenset("html body article main section div td center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# What an opening tag closes when it is still open, up to the element named last.
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
           "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
           "tbody": ("tr td th thead tbody", "table")}
_OTHER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|comment-?list|disqus|replies|respond|cookies?|"
    r"consent|gdpr|footer|masthead|menu|nav|navbar|navigation|newsletter|notice|notification|alert|popup|modal|promo\w*|"
    r"related|recommend\w*|shar(?:e|ing)|social|sidebar|sponsor\w*|subscribe|toolbar|widgets?|login|signup|search)(?:$|[\s_-])",
    re.I)
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())


class _Page:
    """The elements of a page and its text nodes, in page order."""

    def __init__(self, text: str):
        self.tag, self.parent, self.other, self.path = ["#"], [-1], [False], ["#"]
        self.nodes: list[tuple[int, int, str]] = []  # (element, block, text)
        self._open = [0]
        self._block = 0
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if m["text"] is not None:
                self.nodes.append((self._open[-1], self._block, html.unescape(m["text"])))
            elif m["tag"]:
                if m["close"]:
                    self._end(m["tag"].lower())
                else:
                    self._start(m["tag"].lower(), m["attrs"])
            elif kind == "raw" and m["raw"].lower() in ("svg", "iframe", "textarea"):
                continue

    def _start(self, tag: str, attrs: str) -> None:
        if tag not in _INLINE:
            self._block += 1
            if "p" in map(self.tag.__getitem__, self._open[-4:]):
                self._close_to(("p",), ("div", "td", "article", "section", "li", "blockquote"))
        elif tag == "br":
            self.nodes.append((self._open[-1], self._block, " "))
        if tag in _CLOSES:
            self._close_to(tuple(_CLOSES[tag][0].split()), tuple(_CLOSES[tag][1].split()))
        if tag in _VOID or attrs.rstrip().endswith("/"):
            return
        up = self._open[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.other.append(self.other[up] or self._is_other(tag, attrs))
        self.path.append(f"{self.path[up]}/{tag}")
        self._open.append(len(self.tag) - 1)

    def _close_to(self, names: tuple[str, ...], until: tuple[str, ...]) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in until:
                return
            if tag in names:
                lower = depth
                while lower > 1 and self.tag[self._open[lower - 1]] in names:
                    lower -= 1
                del self._open[lower:]
                return

    def _end(self, tag: str) -> None:
        if tag not in _INLINE:
            self._block += 1
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tag[self._open[depth]] == tag:
                del self._open[depth:]
                return

    def _is_other(self, tag: str, attrs: str) -> bool:
        if tag in _OTHER_PARTS:
            return True
        inside = any(self.tag[i] in ("article", "main") for i in self._open)
        if tag == "header" and not inside:
            return True
        if not attrs.strip() or tag in ("html", "body", "article", "main"):
            return False
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id") and _OTHER_NAMES.search(value):
                return True
            if name == "role" and value.lower() in _OTHER_ROLES or name == "aria-hidden" and value.lower() == "true":
                return True
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True
        return False


def path_scores(paths: list[str], texts: list[str], radius: int = 2) -> np.ndarray:
    """Fused, smoothed ratios of text length and punctuation per path, along the nodes."""
    code = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    at = np.array([code[p] for p in paths])
    nodes = np.bincount(at)
    length = np.bincount(at, [len(t) for t in texts]) / nodes
    points = np.bincount(at, [len(_PUNCTUATION.findall(t)) for t in texts]) / nodes
    weights = np.exp(-0.5 * np.arange(-radius, radius + 1) ** 2)
    smooth = [np.convolve(np.pad(v[at], radius, mode="edge"), weights / weights.sum(), mode="valid") for v in (length, points)]
    return np.sqrt(smooth[0] * (smooth[1] + 0.05))


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by two line breaks."""
    tree = _Page(page or "")
    use = [(e, b, " ".join(t.split())) for e, b, t in tree.nodes]
    filled = [i for i, (e, _, t) in enumerate(use) if t and not tree.other[e]]
    if not filled:
        return ""
    paths, texts = [tree.path[use[i][0]] for i in filled], [use[i][2] for i in filled]
    score = path_scores(paths, texts)
    cut = min(score.std() or score.max(), 0.5 * score.max())
    chosen = [i for i, s in zip(filled, score, strict=True) if s >= cut]
    # Smoothing lifts what stands beside the article; elsewhere a path must reach the cut by itself.
    prose = [i for i, s, own in zip(filled, score, path_scores(paths, texts, 0), strict=True) if min(s, own) >= cut]
    # The deepest element that can hold an article and holds most of the chosen text.
    weight = [0] * len(tree.tag)
    for i in chosen:
        e = use[i][0]
        while e >= 0:
            weight[e] += len(use[i][2])
            e = tree.parent[e]
    root = max((e for e in range(len(tree.tag)) if weight[e] >= 0.75 * weight[0] and (e == 0 or tree.tag[e] in _HOLDERS)))
    marked = False
    e = root
    while e > 0:
        if tree.tag[e] in ("article", "main"):
            root, marked = e, True
            break
        e = tree.parent[e]
    above = set()
    e = root
    while e >= 0:
        above.add(e)
        e = tree.parent[e]

    # Chosen text elsewhere stays, with what is in its own element.
    held = {root}
    for i in prose:
        e = use[i][0]
        while e not in above and tree.tag[e] not in _HOLDERS:
            e = tree.parent[e]
        if e not in above:
            held.add(e)
    inside = [False] * len(tree.tag)
    for e in range(len(tree.tag)):  # parents come before children
        inside[e] = e in held or e > 0 and inside[tree.parent[e]]
    stays = {i for i, (e, _, _) in enumerate(use) if inside[e]}.union(prose)
    if prose and not marked:
        stays.update(range(prose[0], prose[-1] + 1))
    titles = _headings_before(tree, filled, min(stays.intersection(filled)))
    picked = {use[i][1] for i in titles.union(prose)}  # whole blocks, with white space and inline parts
    blocks: dict[int, list[str]] = {}
    for i, (e, block, text) in enumerate(tree.nodes):
        if not tree.other[e] and (block in picked or i in stays and _kept_in_header(tree, e)):
            blocks.setdefault(block, []).append(text)
    cleaned = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(t for t in cleaned if t)


def _in_heading(tree: _Page, e: int, tags: frozenset[str] = _HEADINGS) -> bool:
    while e > 0:
        if tree.tag[e] in tags:
            return True
        e = tree.parent[e]
    return False


def _headings_before(tree: _Page, filled: list[int], first: int) -> set[int]:
    """Nodes of titles (<h1>) before the first node that stays, and of other headings right before it."""
    out, near = set(), True
    for i in reversed([i for i in filled if i < first]):
        heading = _in_heading(tree, tree.nodes[i][0])
        near &= heading
        if near or heading and _in_heading(tree, tree.nodes[i][0], frozenset(["h1"])):
            out.add(i)
    return out


def _kept_in_header(tree: _Page, e: int) -> bool:
    """Of a header inside the article only headings belong to the text."""
    heading = False
    while e > 0:
        heading |= tree.tag[e] in _HEADINGS
        if tree.tag[e] == "header":
            return heading
        e = tree.parent[e]
    return True


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The other columns of ``pages``, the text, and n_chars."""
    others = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{html_col}`").cast("string").alias(html_col))
    fields = [f"`{n}` {source.schema[n].dataType.simpleString()}" for n in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t) for t in batch.column(html_col).to_pylist()]
            arrays = [batch.column(n) for n in others]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*others, text_col, "n_chars"])

    return source.mapInArrow(run, ", ".join([*fields, f"`{text_col}` string", "n_chars long"]))
