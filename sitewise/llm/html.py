"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path: the tags of its
block elements, containers with their class and id names. Per path, the text length
(without links) and the punctuation of its blocks are summed and divided by their number.
Every block takes its path's two ratios; they are smoothed over neighbouring blocks with a
Gaussian window and fused, length times (1 + punctuation). Two weak features of a path go
into the fused ratio: a path under ``article`` or ``main`` counts ``ARTICLE`` times, with a
short sentence more; one under an element whose class or id has a word that usually names
a page's frame counts ``FRAME`` times. Paths whose best block reaches ``share`` of the best
path's are content (blocks of links only have no score).

The article is the innermost ``article`` or ``main`` that holds all content or, without one,
the smallest element that holds every block of content and every heading and paragraph that is
neither mostly links nor under such a frame name. All its blocks, short ones too, are the
main text in page order, but for

- elements named as frames of which no path reaches the ratio of a short sentence (of reader
  comments: five times that) or half of whose text is links, unless they hold a heading of the
  first two levels;
- lists and tables of links only that follow neither a heading nor a block of content of
  their own parent, in pages without ``article`` or ``main``.

Left out before, by what their elements or roles say: scripts, styles, head, forms,
navigation, footers, asides, page headers (not those of an article), hidden elements, comments.

Time and memory are linear in a page, however deep: paths are numbers, and open elements are
found by their tag.

Edge cases: a null html is empty, and the text of a page without content is
empty. An unfinished tag at the end is dropped, a tag that never closes is closed
by its parent, and text of a page that breaks off is kept up to there. ``<br>`` is white
space. Every row gives a row, repeated rows too; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import emit

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>)""", re.S)
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
    "th thead tr ul".split())
RAW = frozenset("script style noscript template iframe object svg canvas title textarea select xmp noembed noframes".split())
OUT = frozenset("head nav footer aside form button menu dialog search fieldset audio video map".split())
ROLES = frozenset("banner navigation contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes if it is open inside the given scope.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
          "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Parts of class and id names that usually name the frame of a page.
WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disclaimer discussion disqus feedback footer gdpr login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply "
    "respond responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond responses".split())
#: Parts of names that say nothing about what an element is.
NEUTRAL = frozenset("area bar block bottom box button buttons container content group inner item left link links list main outer panel right row section site text top wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = frozenset("article aside body center details div figure header main ol section table ul".split())
LISTS = frozenset("ul ol dl table".split())
#: Elements that are part of an article, not its frame.
ENDS = HEADINGS | frozenset("p ul ol table tbody tr li td blockquote dl pre".split())
ARTICLE, FRAME = 4.0, 0.2
SHORT = 40  # characters of a short sentence
SENTENCE = 100.0  # the ratio of 50 characters with a full stop


def _read_names(attributes: str) -> tuple[bool, str, int]:
    """Of an element's attributes: whether they hide it or name it as frame by its role; its class and id
    names; 0 without a frame word, 1 with one among others, 2 with nothing else, 3 if that names reader comments."""
    gone, names, level = False, [], 0
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for token in value.split():
                parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower())
                names.append("-".join(parts))
                if not WORDS.isdisjoint(parts):
                    whole = all(p in WORDS or p in NEUTRAL for p in parts)
                    level = max(level, (3 if not COMMENTS.isdisjoint(parts) else 2) if whole else 1)
        elif name == "role":
            gone |= not ROLES.isdisjoint(value.lower().split())
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            gone = True
        elif name == "style":
            gone |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return gone, ".".join(sorted(set(names))), level


class _Page:
    """Elements in page order (tag, parent, path, gone, frame level, whether in an article), the paths' weak
    features, and blocks of text (element, text, characters in links)."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.gone, self.level, self.within, self.path = ["#root"], [-1], [False], [0], [False], [0]
        self.known: dict[tuple, int] = {}
        self.framed, self.favoured = [False], [False]  # per path
        self.blocks: list[tuple[int, str, int]] = []
        self.open = [(0, "#root")]  # open elements, inline ones with their block's number
        self.at: dict[str, list[int]] = {}  # places of each tag in ``open``
        self.block_at = [0]
        self.text: list[str] = []
        self.linked = 0
        self._read(html)

    def _flush(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            if text:
                self.blocks.append((self.open[-1][0], text, min(self.linked, len(text))))
            self.text, self.linked = [], 0

    def _add(self, piece: str) -> None:
        self.text.append(piece)
        if self.at.get("a"):
            self.linked += len(piece.strip())

    def _push(self, element: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS or tag in OUT:
            self.block_at.append(len(self.open))
        self.open.append((element, tag))

    def _close(self, at: int) -> None:
        if self.block_at[-1] >= at:
            self._flush()
        while len(self.open) > at:
            tag = self.open.pop()[1]
            self.at[tag].pop()
            if self.block_at[-1] == len(self.open):
                self.block_at.pop()

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in BLOCKS and tag not in OUT:
            if tag in ("br", "img", "wbr", "input"):
                self.text.append("" if tag == "wbr" else " ")
            elif tag not in VOID:
                self._push(self.open[-1][0], tag)
            return
        self._flush()
        if tag in BLOCKS and self.open[self.block_at[-1]][1] == "p":  # an open paragraph ends where a block starts
            self._close(self.block_at[-1])
        if tag in CLOSES:
            which, scope = CLOSES[tag]
            if (at := self._last(which)) > self._last(scope):
                self._close(at)
        if tag in VOID:
            return
        parent = self.open[-1][0]
        inside = bool(self.at.get("article") or self.at.get("main"))
        gone, names, level = _read_names(attributes) if attributes else (False, "", 0)
        if tag in ("body", "html", "article", "main") or tag == "header" and inside:
            level = 0  # they say what they are
        step = (self.path[parent], tag, names if tag in NAMES else "", level > 0)
        path = self.known.setdefault(step, len(self.framed))
        if path == len(self.framed):
            self.framed.append(self.framed[step[0]] or level > 0)
            self.favoured.append(self.favoured[step[0]] or tag in ("article", "main"))
        self.tags.append(tag)
        self.parents.append(parent)
        self.path.append(path)
        self.gone.append(self.gone[parent] or gone or tag in OUT or tag == "header" and not inside)
        self.level.append(level)
        self.within.append(inside or tag in ("article", "main"))
        self._push(len(self.tags) - 1, tag)

    def _end(self, tag: str) -> None:
        at = self._last((tag,))
        if at > 0 and (tag in BLOCKS or tag in OUT or self.block_at[-1] < at):  # an inline end tag closes nothing outside its block
            self._close(at)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            next_ = html.find("<", at)
            if next_ < 0:
                self._add(html[at:])
                break
            if next_ > at:
                self._add(html[at:next_])
            m = TAG.match(html, next_) or BROKEN.match(html, next_)
            if m is None:
                if re.match(r"</?[a-zA-Z]", html[next_ : next_ + 3]):
                    break  # an unfinished tag
                self._add("<")
                at = next_ + 1
                continue
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?:\s[^>]*)?>", re.I).search(html, at)
                    at = end.end() if end else n
                self.text.append(" ") if self.text else None
            else:
                self._start(tag, m[3])
        self._flush()


def path_ratios(paths: np.ndarray, length: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per block, its path's text length and punctuation per block."""
    n = np.bincount(paths)
    return (np.bincount(paths, length) / np.maximum(n, 1))[paths], (np.bincount(paths, marks) / np.maximum(n, 1))[paths]


def smooth(x: np.ndarray) -> np.ndarray:
    window = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    return np.convolve(np.pad(x, 2, mode="edge"), window / window.sum(), "valid")


def fused_ratios(length: np.ndarray, marks: np.ndarray, favoured: np.ndarray, framed: np.ndarray) -> np.ndarray:
    """The smoothed ratios of each block in one, with the weak features of its path."""
    own = (smooth(length) + np.where(favoured, SHORT, 0)) * (1 + smooth(marks))
    return own * np.where(favoured, ARTICLE, 1.0) * np.where(framed, FRAME, 1.0)


def _below(page: _Page, per_element: np.ndarray) -> list:
    """Sums over each element and all within it."""
    out = per_element.tolist()
    for e in range(len(out) - 1, 0, -1):
        out[page.parents[e]] += out[e]
    return out


def main_text(html: str, share: float = 0.25) -> str:
    page = _Page(html)
    n = len(page.tags)
    blocks = [b for b in page.blocks if not page.gone[b[0]]]
    if not blocks:
        return ""
    owner = np.array([b[0] for b in blocks])
    paths = np.array([page.path[e] for e in owner])
    chars, linked = np.array([len(b[1]) for b in blocks]), np.array([b[2] for b in blocks])
    length, marks = path_ratios(paths, chars - linked, np.array([len(PUNCTUATION.findall(b[1])) for b in blocks]))
    framed = np.array(page.framed)[paths]
    score = fused_ratios(length, marks, np.array(page.favoured)[paths], framed) * (chars > linked)
    best = np.zeros(len(page.framed))
    np.maximum.at(best, paths, score)
    content = (best >= share * best.max())[paths] & (chars > linked)
    if not content.any():
        return ""

    tag = [page.tags[e] for e in owner]
    kept = content | np.array([t in HEADINGS or t == "p" for t in tag]) & ~framed & (2 * linked < chars)
    everywhere = _below(page, np.bincount(owner, content, n))
    article = max((e for e in range(1, n) if page.tags[e] in ("article", "main") and everywhere[e] == everywhere[0]), default=0)
    if not article:
        needed = _below(page, np.bincount(owner, kept, n))
        children: dict[int, list[int]] = {}
        for e in range(1, n):
            children.setdefault(page.parents[e], []).append(e)
        while page.tags[article] not in ("article", "main"):
            inner = next((e for e in children.get(article, []) if needed[e] == needed[article]), None)
            if inner is None or page.tags[inner] in ENDS:
                break
            article = inner

    # frames within the article: named as such, and without an article's ratios
    plain = length * (1 + marks)
    sentence = min(SENTENCE, share * float(plain.max()))
    size, in_links = _below(page, np.bincount(owner, chars, n)), _below(page, np.bincount(owner, linked, n))
    titles = _below(page, np.bincount(owner, [t in ("h1", "h2") for t in tag], n))
    some, much = (_below(page, np.bincount(owner, plain >= k * sentence, n)) for k in (1, 1 / FRAME))
    dropped, inside = [False] * n, [False] * n
    inside[article] = True
    for e in range(article + 1, n):
        up = page.parents[e]
        inside[e] = inside[up]
        frame = page.level[e] >= 2 and not titles[e] and (2 * in_links[e] >= size[e] or not (much if page.level[e] == 3 else some)[e])
        dropped[e] = dropped[up] or frame and inside[e]

    # lists of links
    list_of = [0] * n
    for e in range(1, n):
        list_of[e] = e if page.tags[e] in LISTS else list_of[page.parents[e]]
    before = None  # the last block that is no such list
    menus: dict[int, bool] = {}
    out = []
    for i, (e, text, _) in enumerate(blocks):
        if not inside[e] or dropped[e]:
            continue
        top = list_of[e]
        if top and not page.within[e] and 5 * in_links[top] >= 4 * size[top]:
            if top not in menus:
                follows = before is not None and (tag[before] in HEADINGS or content[before]) and page.parents[owner[before]] == page.parents[top]
                menus[top] = not follows
            if menus[top]:
                continue
        else:
            before = i
        out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for page, url, html in zip(ids, urls, batch.column(2), strict=True):
                    text = main_text(html.as_py() or "")
                    yield page, url, text, len(text)

        yield from emit(rows(), schema, lambda r: len(r[2]))

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages)
