"""HTML extraction: flat text blocks, word counts and link densities of neighbours, a learned decision tree.

A page is read as one run of tags and text. Every block-level tag ends a text
block, so blocks are flat. A block's features are its own and its neighbours'
word counts and link densities and what the tags around it are called (a
navigation, a notice, comments, an article). A decision tree trained on a small
labelled table of blocks says which ones are main text; they are joined in page
order.

Defined cases: null html counts as empty and gives an empty text; character
references are decoded once, white space inside a block becomes one space, empty
blocks vanish; unclosed and misnested tags are tolerated; an unclosed script,
style or comment hides the rest; a self-closed icon or frame hides nothing; a
quote that never closes makes its tag text; what is left out inside a word or line puts no space
there; ``<br>`` ends a block; a form around an article or main part is no boilerplate for what follows; a link
around blocks counts as links until the part that it began in ends, an anchor without href is none; pages of any length are read whole, in time that grows with their length; repeated
rows are extracted each.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# possessive and never across a new tag's bracket outside quotes: bad markup is read once
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)"
    r"|<(script|style|noscript|template|svg|iframe|object|textarea|title|select|button|canvas|math)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+(?<!/)>.*?(?:</\1\s*>|$)"
    r"|<[!?][^<>]*>|<(/?)([a-zA-Z][\w:-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S | re.I)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|aria-label|hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Tags and name parts that stand around boilerplate and around main text.
BAD_TAGS = set("nav header footer aside form menu dialog fieldset".split())
GOOD_TAGS = set("article main".split())
WHOLE = set("html body article main".split())  # names on these describe the page, not a part to leave out
BAD_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disclaimer "
    "footer foot form gdpr header hidden links login menu modal nav navbar navigation newsletter notice notices pager pagination popup privacy "
    "promo promoted promotion recommended related reply replies respond share sharing shop sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags teaser toolbar topbar tracking warning widget".split())
GOOD_NAMES = set("article articlebody body content entry main maincontent post story text".split())
#: Parts that say nothing by themselves: "site-footer" is a footer, "has-sidebar" or "overflow-hidden" is none.
PLAIN_PARTS = set("area bar block box btn button container content group inner item items js left list main new outer page post right section site text top bottom user widget wrap wrapper".split())
#: "related-article" is another article, "article-related" or "privacy-article" may be this one.
OTHERS = set("ad ads advert adverts comment comments promo promoted recommended related reply replies sidebar sponsor sponsored teaser".split())
MANY = set("articles entries posts stories".split())
ARTICLE_NAMES = set("article articlebody entry main maincontent post story".split())
HREF = re.compile(r"(?<![\w-])href\b", re.I)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
EMBEDDED = set("svg iframe object canvas math".split())  # self-closed ones hold no text
WHITE = re.compile(r"\s+")
FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "bad", "good", "heading")


def is_boilerplate(value: str) -> bool:
    """Whether some whole name of a class or id attribute is made of boilerplate and plain parts only."""
    for token in value.split():
        listed = [x.lower() for x in NAME_PARTS(token)]
        parts = set(listed)
        if not parts.isdisjoint(BAD_NAMES) and parts <= BAD_NAMES | PLAIN_PARTS:
            return True
        if len(listed) > 1 and listed[0] in OTHERS and parts <= BAD_NAMES | PLAIN_PARTS | GOOD_NAMES | MANY:
            return True
    return False


def is_article(token: str) -> bool:
    """Whether a whole name of a class or id attribute says that this is the article."""
    parts = {x.lower() for x in NAME_PARTS(token)}
    return parts <= GOOD_NAMES and not parts.isdisjoint(ARTICLE_NAMES)


def blocks(page: str) -> list[tuple[str, int, int, int, int, bool]]:
    """(text, words, words in links, boilerplate around it, main text around it, heading) of each block with text."""
    out: list[tuple[str, int, int, int, int, bool]] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, boilerplate, main text, boilerplate as a form only
    text: list[str] = []
    linked: list[str] = []
    forms: list[int] = []  # places of forms on the stack, since the last article
    in_link, link_depth = False, 0
    heading = False

    def close():
        nonlocal heading
        joined = WHITE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            link_words = len(html.unescape(" ".join(linked)).split())
            out.append((joined, len(joined.split()), link_words, sum(s[1] for s in stack), sum(s[2] for s in stack), heading))
        text.clear()
        linked.clear()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            text.append(piece)
            if in_link:
                linked.append(piece)
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if name == "a":
            in_link, link_depth = not m[2] and HREF.search(m[4]) is not None, len(stack)
            continue
        if name in INLINE or name in EMBEDDED and m[4].rstrip().endswith("/"):
            continue
        close()
        if m[2]:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
                in_link &= len(stack) >= link_depth  # a link goes around blocks, but ends with the part that it began in
            heading = False
        else:
            heading = len(name) == 2 and name[0] == "h" and name[1] in "123456"
            if name in VOID or m[4].rstrip().endswith("/"):
                continue
            if name == "p":  # a new paragraph closes an open one
                while stack and stack[-1][0] == "p":
                    stack.pop()
                in_link &= len(stack) >= link_depth
            bad, good, whole, named = name in BAD_TAGS, name in GOOD_TAGS, name in GOOD_TAGS, False
            for a in ATTRIBUTE.finditer(m[4]) if m[4] else ():
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "hidden":
                    bad = named = True
                if name not in WHOLE and name not in HEADINGS and is_boilerplate(value):
                    bad = named = True
                good |= not {x.lower() for x in NAME_PARTS(value)}.isdisjoint(GOOD_NAMES)
                whole |= any(is_article(token) for token in value.split())
            if whole and not bad:  # a form around an article is the page's frame
                for i in forms:
                    if i < len(stack):
                        stack[i] = (stack[i][0], stack[i][1] - stack[i][3], stack[i][2], 0)
                forms.clear()
            if name == "form" and not named:
                forms.append(len(stack))
            stack.append((name, int(bad), int(good and not bad), int(name == "form" and not named)))
    rest = page[at:]
    if rest:
        text.append(rest)
    close()
    return out


def block_features(found: list[tuple]) -> np.ndarray:
    """One row of FEATURES for each block; a page's edges count as empty neighbours."""
    if not found:
        return np.empty((0, len(FEATURES)))
    words = np.array([b[1] for b in found], float)
    links = np.array([b[2] for b in found], float) / words
    zero = np.zeros(1)
    before = lambda x: np.concatenate([zero, x[:-1]])
    after = lambda x: np.concatenate([x[1:], zero])
    return np.stack([words, links.clip(0, 1), before(words), before(links), after(words), after(links),
                     np.array([b[3] for b in found], float), np.array([b[4] for b in found], float), np.array([b[5] for b in found], float)], 1)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """The small training table, by rule: what main text and boilerplate look like at a few sizes, in and out of named parts."""
    rows, labels = [], []

    def add(label, words, links, around, bad, good, heading=0):
        rows.append((words, links, around[0], around[1], around[2], around[3], bad, good, heading))
        labels.append(label)

    text, thin, linky = (40, 0.0, 55, 0.0), (40, 0.0, 6, 0.2), (2, 1.0, 2, 1.0)
    for words in (1, 3, 8, 20, 60, 150):
        for around in (text, thin, linky, (0, 0.0, 40, 0.0), (60, 0.0, 0, 0.0)):
            for good in (1, 2):
                add(1, words, 0.0, around, 0, good)
                add(1, words, 0.2, around, 0, good, int(words < 20))
                add(0, words, 0.1, around, 1, good)
            add(0, words, 0.0, around, 1, 0)
            add(0, words, 0.9, around, 1, 0)
            add(0, words, 1.0, around, 2, 0, int(words < 20))
    for words in (12, 20, 60, 150):  # without named parts the classic rule: long blocks with few links
        for around in (text, (8, 0.0, 40, 0.0), (60, 0.1, 3, 0.0), (0, 0.0, 40, 0.0)):
            add(1, words, 0.0, around, 0, 0)
            add(1, words, 0.2, around, 0, 0)
        add(0, words, 0.8, text, 0, 0)
    for words in (1, 3, 6):
        for around in (linky, (3, 0.0, 4, 0.3), (0, 0.0, 3, 0.8), (3, 0.5, 0, 0.0)):
            add(0, words, 0.0, around, 0, 0)
            add(0, words, 1.0, around, 0, 0)
        add(1, words, 0.0, text, 0, 0)
        add(1, words, 0.0, (0, 0.0, 55, 0.0), 0, 0, 1)
    return np.array(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2):
    """A decision tree by Gini impurity: a leaf's class, or (feature, cut, left, right)."""
    if depth == 0 or len(np.unique(y)) < 2 or len(y) < 2 * least:
        return int(y.mean() >= 0.5)
    best = (1e-9, None, None)
    base = y.mean() * (1 - y.mean()) * len(y)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = y[x[:, f] <= cut]
            right = y[x[:, f] > cut]
            if min(len(left), len(right)) < least:
                continue
            gain = base - left.mean() * (1 - left.mean()) * len(left) - right.mean() * (1 - right.mean()) * len(right)
            if gain > best[0]:
                best = (gain, f, cut)
    if best[1] is None:
        return int(y.mean() >= 0.5)
    side = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[side], y[side], depth - 1, least), grow(x[~side], y[~side], depth - 1, least)


def classify(tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, int):
            out[rows] = bool(node)
        else:
            side = x[rows, node[0]] <= node[1]
            todo += [(node[2], rows[side]), (node[3], rows[~side])]
    return out


def main_text(page: str, tree) -> str:
    found = blocks(page)
    keep = classify(tree, block_features(found))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract_text(pages: DataFrame, training: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages(page_id, url, html)``: one narrow pass over whole pages.

    The tree is grown on the driver from the small table and travels with the task."""
    tree = grow(*(training or labelled_blocks()))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [main_text(p or "", tree) for p in some["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([some["page_id"], some["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
