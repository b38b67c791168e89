"""Main text of web pages: flat blocks, described by themselves and their neighbours, kept or dropped by a decision tree.

Rules for edge cases: null or empty html has an empty text; broken markup (open tags, stray ends) is read as far as it
goes; a page of any length is read whole; repeated rows are extracted alike; an empty table gives an empty result; other
columns are ignored. A line break tag is white space inside its block. Headings of the article belong to it.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, table

# Element names with a meaning fixed by HTML.
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section
    select summary table tbody td tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED_TAGS = "script style noscript template svg textarea iframe object head title select"
FURNITURE_TAGS = frozenset("nav footer aside menu dialog button".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id or role that name page furniture, those that name the article, and parts of names that tell a state
# of the whole element and not what it is (fixed values).
FURNITURE_WORDS = frozenset("""ad ads advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent
    cookie cookies disqus discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager
    pagination paywall popup promo related reply replies respond search share sharing sidebar signup skip social sponsor sponsored
    subscribe tags toolbar widget""".split())
CONTENT_WORDS = frozenset("article content post entry story main body text".split())
STATE_PARTS = frozenset("has with without no is not enabled disabled on off open closed visible hidden active left right".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
                   rf"|<(?P<skip>{SKIPPED_TAGS.replace(' ', '|')})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</(?P=skip)\s*>|.*\Z)"
                   r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "furniture",
            "content")
NOTHING, MAYBE_FURNITURE, CONTENT, FURNITURE = range(4)


def mark(tag: str, rest: str, inside: int) -> int:
    """What an element and those around it (``inside``) say of its text.

    Elements made for furniture and whole names of it are sure, and nothing inside them is content. A part of a name
    (``article-share``) or a form only suggests it, so content inside counts again. Names of states (``has-sidebar``,
    ``share-enabled``) and of the page's own elements say nothing.
    """
    if inside == FURNITURE or tag in FURNITURE_TAGS:
        return FURNITURE
    if tag in ("html", "body"):
        return inside
    names = [w for m in NAMES.finditer(rest) for w in (m[1] or m[2] or m[3] or "").lower().split()]
    own = FURNITURE_WORDS - {"header"} if inside == CONTENT or tag in CONTENT_TAGS or tag in HEADINGS else FURNITURE_WORDS
    if any(w in own for w in names) or tag == "header" and inside != CONTENT:
        return FURNITURE
    if tag in CONTENT_TAGS:
        return CONTENT
    parts = [p for p in (re.split(r"[-_]+", w) for w in names) if len(p) > 1 and not STATE_PARTS & set(p)]
    if any(own & set(p) for p in parts) or tag == "form":
        return MAYBE_FURNITURE
    if any(w in CONTENT_WORDS for w in names) or any(CONTENT_WORDS & set(p) for p in parts):
        return CONTENT
    return inside


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """(texts, features) of the text blocks of a page in order."""
    texts: list[str] = []
    own: list[list[float]] = []
    stack: list[tuple[str, int]] = []     # open block elements, with what they and those around them say
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            said = stack[-1][1] if stack else NOTHING
            words = len(text.split())
            own.append([words, min(1.0, len(" ".join(linked).split()) / words), {FURNITURE: 2, MAYBE_FURNITURE: 1}.get(said, 0), said == CONTENT])
            texts.append(text)
        parts.clear()
        linked.clear()

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            piece = page[at:token.start()]
            parts.append(piece)
            if in_link:
                linked.append(piece)
        at = token.end()
        if token["skip"]:
            flush()
        if not token["tag"]:
            continue
        tag = token["tag"].lower()
        if tag == "a":
            in_link = 0 if token["end"] else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            if token["end"]:
                if any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                in_link = 0
            elif tag not in VOID_TAGS:
                # A paragraph or item ends where the next begins.
                if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                    stack.pop()
                stack.append((tag, mark(tag, token["rest"], stack[-1][1] if stack else NOTHING)))
    if at < len(page):
        parts.append(page[at:])
    flush()
    if not own:
        return texts, np.empty((0, len(FEATURES)))
    x = np.array(own, dtype=np.float64)
    before, after = np.vstack([[[0, 1]], x[:-1, :2]]), np.vstack([x[1:, :2], [[0, 1]]])
    return texts, np.hstack([x[:, :2], before, after, x[:, 2:]])


# The labelled table: pages of common layouts. In a layout, {..} stands for a text made of so many words at least and at most,
# or one of the phrases; a block that belongs to the article is marked by a leading "+".
LAYOUTS = [
    # Marked by elements or names.
    "<nav><ul><li>{link}</li><li>{link}</li></ul></nav><div class='ad'>{3-80}</div><article><h1>+{2-8}</h1><p>+{30-300}</p><p>+{1-9}</p><p>+{20-150}</p></article><footer>{3-60}</footer>",
    "<header>{link} {3-9}</header><main><h1>+{2-7}</h1><p>+{15-300}</p><ul><li>+{2-6}</li><li>+{2-6}</li></ul><aside>{3-120}</aside><p>+{1-5}</p></main><form>{3-8}</form><footer>{phrase} {3-20}</footer>",
    "<div id='menu'>{link} {link}</div><div class='post'><h2>+{2-6}</h2><p>+{30-300}</p><p>+{2-8}</p><div class='comments'><p>{5-40}</p><p>{1-5}</p></div></div><div class='sidebar'><p>{4-120}</p><p>{1-9}</p></div>",
    "<div class='cookie-notice'>{10-90}</div><div class='page-content'><p>+{20-150}</p><p>+{1-4}</p><p>+{20-300}</p></div><div class='related'>{links}</div>",
    "<body class='has-sidebar'><article class='post share-enabled'><header><h1>+{2-8}</h1></header><p>+{20-300}</p><div class='post-share'>{2-6}</div><p>+{10-150}</p></article><div class='newsletter-box'>{2-60}</div><footer>{1-9}</footer></body>",
    "<form><div class='site-nav'>{link} {link}</div><div class='story'><p>+{1-4}</p><p>+{20-50}</p><p>+{link}</p></div><div class='comments'><p>{3-150}</p><p>{1-9}</p></div></form><div class='copyright'>{phrase}</div>",
    "<article><p>+{link}</p><p>+{10-40}</p><p>+{1-3}</p></article><p>{phrase}</p>",
    "<main><p>+{2-6}</p></main>", "<article><h2>+{2-6}</h2><p>+{5-40}</p></article>",
    # Unmarked: length, links and neighbours have to tell.
    "<div>{links}</div><div>+{12-300}</div><div>+{25-300}</div><div>+{12-150}</div><div>{links}</div><div>{phrase}</div>",
    "<div>{link}</div><div>{link}</div><h1>+{3-8}</h1><p>+{15-150}</p><p>+{2-7}</p><p>+{30-300}</p><p>{links}</p><p>{phrase}</p>",
    "<table><tr><td>{links}</td></tr><tr><td>+{15-300}</td></tr><tr><td>+{4-9}</td></tr><tr><td>+{12-300}</td></tr></table><div>{link}</div><div>{phrase}</div>",
    "<div><div><div>{link}</div></div></div><div><div><p>+{15-150}</p><div><p>+{12-150}</p></div></div></div><div>{phrase}</div><div>{link}</div>",
    "<p>{longlink}</p><p>{longlink}</p><h1>+{2-6}</h1><p>+{15-150}</p><p>+{12-300}</p><p>{link}</p><p>{longlink}</p><p>{longlink}</p>",
    "<div>{3-6}</div><div>{links}</div><p>+{15-150}</p><blockquote>+{5-15}</blockquote><p>+{15-150}</p><ul><li>{link}</li><li>{longlink}</li><li>{longlink}</li></ul><div>{phrase}</div>",
    "<div>{link}</div><div>{phrase}</div><div>{link}</div><div>+{20-300}</div><div>{link}</div><div>{phrase}</div><div>{link}</div>",
    "<div>{longlink}</div><div>{8-18}</div><div>{longlink}</div><div>{8-18}</div><div>{longlink}</div><h2>+{3-6}</h2><div>+{12-300}</div><div>+{3-18}</div><div>+{12-300}</div><div>{longlink}</div><div>{8-18}</div><div>{longlink}</div>",
    "<div>{1-5}</div><div>{1-5}</div><div>{1-5}</div><h1>+{3-7}</h1><p>+{20-150}</p><p>+{1-5}</p><p>+{20-150}</p><div>{1-5}</div><div>{1-5}</div><div>{1-5}</div>",
    "<div>{1-6}</div><div>{1-6}</div><p>+{20-300}</p><p>+{3-8}</p><p>+{3-8}</p><p>+{20-150}</p><p>+{3-8}</p><p>+{20-150}</p><div>{1-6}</div><div>{1-6}</div><div>{1-6}</div>",
    "<p>+{15-150}</p><p>+{15-150}, see {link}</p><p>+{3-9}</p><p>+{15-150}</p><p>{links}</p><p>{8-18}</p><p>{links}</p>",
    "<div>{links}</div><p>+{15-60}</p><p>+{1-8}</p><p>+{15-60}</p><p>+{1-8}</p><p>+{15-150}</p><div>{links}</div><div>{phrase}</div><div>{1-9}</div>",
    "<div>{link}</div><div>{2-8}</div><div>{link}</div><div>+{15-60}</div><div>+{1-8}</div><div>+{15-60}</div><div>{link}</div><div>{2-8}</div><div>{longlink}</div>",
]
PHRASES = ["all rights reserved", "copyright of the owners", "terms and privacy", "contact us", "page 3 of 9", "back to top", "log in", "menu",
           "no part of this may be used without the written leave of those who own it"]
VARIANTS = 8
LEAST_ROWS = 3       # of a leaf


def labelled_pages() -> list[str]:
    """The layouts, each filled in several ways."""
    rng = random.Random(1)

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))

    def fill(m: re.Match) -> str:
        if m[1] == "phrase":
            return rng.choice(PHRASES)
        if m[1] in ("link", "longlink"):
            return f"<a href='#'>{words(rng.randint(1, 3) if m[1] == 'link' else rng.randint(8, 45))}</a>"
        if m[1] == "links":
            return " | ".join(f"<a href='#'>{words(rng.randint(1, 2))}</a>" for _ in range(rng.randint(2, 6)))
        return words(rng.randint(*map(int, m[1].split("-"))))

    return [re.sub(r"\{([^}]*)\}", fill, page) for page in LAYOUTS for _ in range(VARIANTS)]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page in labelled_pages():
        texts, features = blocks(page)
        x.append(features)
        y += [t.startswith("+") for t in texts]
    return np.vstack(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: a probability, or (feature, threshold, tree at or below, tree above)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (2 * share * (1 - share) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) < LEAST_ROWS:
                continue
            p, q, w = y[low].mean(), y[~low].mean(), low.mean()
            impurity = w * 2 * p * (1 - p) + (1 - w) * 2 * q * (1 - q)
            if impurity < best[0]:
                best = (impurity, f, float(cut))
    if best[1] is None:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def judge(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    feature, cut, low, high = tree
    return np.where(x[:, feature] <= cut, judge(low, x), judge(high, x))


def main_text(page: str | None, tree) -> str:
    texts, x = blocks(page or "")
    return "\n".join(t for t, keep in zip(texts, judge(tree, x)) if keep)


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page; ``tree`` is grown from the labelled table by default."""
    tree = tree if tree is not None else grow(*labelled_table())
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h, tree) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3(spark, folder):
    return extract(table(spark, folder, "pages"))
