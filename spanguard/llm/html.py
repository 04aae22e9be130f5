"""Main text of web pages: flat text blocks, classified by a small decision tree."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_column, map_arrow, table

#: Elements that end a text block, elements whose content is never text, and elements without an end tag.
BLOCK_TAGS = frozenset("address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT_TAGS = frozenset("script style noscript template iframe object svg select textarea button canvas audio video head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold the main text; those beside it for certain; those that can also wrap a whole page.
MAIN_TAGS = frozenset("article main".split())
HARD_TAGS = frozenset("nav aside footer menu".split())
SOFT_TAGS = frozenset("form dialog header".split())
#: Words of classes, ids and roles that name what stands beside the text; of those, words that name readers'
#: comments, also for an element that else holds the text; words before which such a name says the contrary.
SIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs byline consent cookie cookies disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets search complementary contentinfo alert".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion guestbook replies reply respond".split())
READER_WORDS = frozenset("guest member reader user visitor".split())
CONTRARY_WORDS = frozenset("has hide no not with without".split())
#: Words that can stand after such a word in the name of something beside the text; others make it a name of its own.
PLACE_WORDS = frozenset("a aera area articles b bar block body bottom box button buttons center col column container content desktop form frame group header headline holder icons inner item items large leaderboard left line link links list main message mobile module outer overlay page panel placeholder policy pos post posts primary right row s secondary section sign site slot small sticky stories story strip tag tags text tile title top unit up wrap wrapper zone".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Tags whose quotes don't end before the page does; after so many, quotes in tags no longer count.
MOST_UNENDED = 16
#: Blocks that an element with the name of something beside the text has at least if it is the page itself.
SEVERAL = 3
_BLOCK_START = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK_TAGS))})\b", re.I)


def _names_side(words: list[str]) -> bool:
    """Whether a name's last word, or one before words of place only, names something beside the text: not share-price."""
    rest = [w for w in words if not w.isdigit()]
    while rest and rest[-1] not in SIDE_WORDS and rest[-1] in PLACE_WORDS:
        rest.pop()
    return bool(rest) and rest[-1] in SIDE_WORDS


@lru_cache(maxsize=4096)
def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """Whether classes, ids and roles name something beside the text, comments, and readers."""
    side = comment = reader = False
    for groups in _NAMED.findall(attributes):
        for name in next(filter(None, groups), "").lower().split():
            words = re.split("[-_]+", name)
            if not CONTRARY_WORDS.isdisjoint(words):
                continue
            side = side or _names_side(words)
            comment = comment or not COMMENT_WORDS.isdisjoint(words)
            reader = reader or not READER_WORDS.isdisjoint(words)
    return side, comment, reader


@dataclass
class Block:
    """A run of text without a block boundary: its words, those in links, whether it lies in a main element, and
    beside the text by its elements (2), by names of classes or by elements that can wrap a page (1), and the
    number of the innermost of these last."""

    text: str
    words: int
    linked: int
    main: int
    side: int
    soft: int = 0


class _Open:
    """The open elements that matter, each with the (main, side) of what it holds and its innermost soft element.

    around, firm: for each element beside the text but for certain ones, by number from 1, the one around it, or 0,
    and whether it can't be the page itself.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int, int]] = []
        self.names: Counter[str] = Counter()
        self.around, self.firm = [0], [False]

    @property
    def state(self) -> tuple[int, int]:
        return self.stack[-1][1:3] if self.stack else (0, 0)

    @property
    def soft(self) -> int:
        return self.stack[-1][3] if self.stack else 0

    def push(self, name: str, main: int, side: int, firm: bool | None = None) -> None:
        at = self.soft
        if firm is not None:
            self.around.append(at)
            self.firm.append(firm)
            at = len(self.around) - 1
        self.stack.append((name, main, side, at if side else 0))
        self.names[name] += 1

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.names[name] -= 1
        return name

    def close(self, name: str) -> None:
        """Close the innermost open element of that name, and what is open in it; nothing if there is none."""
        if self.names[name]:
            while self.pop() != name:
                pass


def _within(name: str, attributes: str, main: int, side: int) -> tuple[int, int, bool | None]:
    """(main, side) of what a new element holds, from those around it; for one beside the text, if it can't be the page."""
    beside, comment, reader = _marks(attributes) if attributes else (False, False, False)
    if name in MAIN_TAGS:
        if comment or reader:
            return main, 2, None
        if name == "article" and main == 2:  # an article in an article is a comment on it, if it isn't most of the page
            return main, max(side, 1), False
        return 2 if name == "article" else max(main, 1), 0 if side < 2 else 2, None
    if name in HARD_TAGS or comment:
        return main, 2, None
    if name in SOFT_TAGS and not (name == "header" and main):
        return main, max(side, 1), True
    if beside and name != "body":
        return main, max(side, 1), False
    return main, side, None


def _without_wrappers(found: list[Block], around: list[int], firm: list[bool]) -> list[Block]:
    """The blocks; those in soft elements of several blocks with most of the page's words outside links lie beside nothing.

    Such an element is the page, whatever its name; soft elements in it still count.
    """
    held, several = [0] * len(around), [0] * len(around)
    for b in found:
        if b.side < 2 and b.words > b.linked:
            held[b.soft] += b.words - b.linked
            several[b.soft] += 1
    total = sum(held)
    for k in range(len(around) - 1, 0, -1):  # those around have smaller numbers
        held[around[k]] += held[k]
        several[around[k]] += several[k]
    beside = [False] * len(around)
    for k in range(1, len(around)):
        beside[k] = beside[around[k]] or firm[k] or 2 * held[k] <= total or several[k] < SEVERAL
    for b in found:
        if b.side == 1 and not beside[b.soft]:
            b.side = 0
    return found


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, white space made single, empty ones left out; in linear time."""
    out: list[Block] = []
    opened = _Open()
    held: list[str] = []
    linked: list[str] = []
    unclosed: set[str] = set()  # silent elements without an end tag from here on, and "body" without a start tag
    links, at, end, unended = 0, 0, len(page), 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                main, side = opened.state
                out.append(Block(text, text.count(" ") + 1, len(entities.unescape(" ".join(linked)).split()), int(main > 0), side, opened.soft))
            held.clear()
            linked.clear()

    def after_silent(name: str, attributes: str) -> int:
        """Where the content of a silent element ends that begins here."""
        if attributes.rstrip().endswith("/"):
            return at
        if name not in unclosed:
            found = re.compile(rf"<(/?){name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            while found and not found[1] and name in ("script", "style", "svg", "object", "noscript", "template"):
                found = re.compile(rf"<(/){name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, found.end())
            if found and found[1]:
                return found.end()
            if not found:
                unclosed.add(name)
        if name in ("script", "style"):  # without an end they take the rest of the page
            return end
        if name == "head":
            found = None if "body" in unclosed else re.compile(r"<body\b", re.I).search(page, at)
            if not found:
                unclosed.add("body")
            return found.start() if found else at
        found = _BLOCK_START.search(page, at)
        return found.start() if found else end

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            piece = page[at:lt]
            held.append(piece)
            if links:
                linked.append(piece)
            at = lt
            continue
        m = _MARKUP.match(page, at)
        if m is not None:
            at = m.end()
            continue
        m = _TAG.match(page, at) if unended < MOST_UNENDED else None
        if m is None and (m := _LOOSE.match(page, at)) is not None:
            unended += 1
        if m is None:  # a lone "<" is text
            held.append("<")
            at += 1
            continue
        at = m.end()
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if name == "a":
            links = max(0, links - 1) if closing else 1
        elif name == "br":
            held.append(" ")
        elif name in SILENT_TAGS and not closing:
            if name in BLOCK_TAGS:
                flush()
            at = after_silent(name, attributes)
        elif name in BLOCK_TAGS:
            flush()
            links = 0 if name != "li" else links
            if closing:
                opened.close(name)
            elif name not in VOID_TAGS:
                top = opened.stack[-1][0] if opened.stack else ""
                if top == "p" or name == top and name in ("li", "dd", "dt", "tr", "td", "th"):
                    opened.pop()
                opened.push(name, *_within(name, attributes, *opened.state))
        elif closing:
            if opened.names[name]:
                flush()
                opened.close(name)
        elif attributes and name not in VOID_TAGS and (now := _within(name, attributes, *opened.state))[:2] != opened.state:
            flush()
            opened.push(name, *now)
    flush()
    return _without_wrappers(out, opened.around, opened.firm)


# ---------------------------------------------------------------- decision tree
FEATURES = ("words", "link_share", "words_before", "link_share_before", "words_after", "link_share_after", "main", "side", "page_main")


def features(found: list[Block]) -> np.ndarray:
    """blocks x FEATURES; before the first and after the last block there are no words."""
    words = np.array([b.words for b in found], float)
    share = np.array([min(b.linked, b.words) for b in found], float) / np.maximum(words, 1)
    main, side = np.array([b.main for b in found], float), np.array([b.side for b in found], float)
    whole = np.full(len(found), float((main * (side == 0)).any()))
    before, after = (lambda x: np.concatenate([[0], x[:-1]])), (lambda x: np.concatenate([x[1:], [0]]))
    return np.column_stack([words, share, before(words), before(share), after(words), after(share), main, side, whole])


#: The labelled table: pages drawn by hand after common layouts, and a label for each of their blocks, 1 for main
#: text. {n} stands for n words; links are the words in <a>.
LABELLED = (
    # A newspaper article with navigation, related links, a newsletter form and comments.
    ("<header><a>{2}</a></header><nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav><article><h1>{9}</h1><p>{45}<p>{80}<p>{7}<h2>{4}</h2><p>{62} <a>{3}</a> {20}<ul><li>{12}<li>{9}</ul><p>{3}</article><aside><h3>{2}</h3><a>{8}</a></aside><section class='comments'><p>{25}<p>{60}</section><footer><p>{14} <a>{2}</a></footer>", "0000" + "111111111" + "00000"),
    # The same kind with an advert before the article and a short text.
    ("<nav><a>{1}</a> <a>{2}</a></nav><div class='ad'>{8}</div><article><h1>{6}</h1><p>{2}<p>{30}<p>{5}<p>{1}</article><footer>{10}</footer>", "00" + "11111" + "0"),
    ("<nav><ul><li><a>{1}</a><li><a>{1}</a></ul></nav><div class='promo'>{20}</div><main><h1>{4}</h1><p>{3}<p>{120}<table><tr><th>{1}<th>{2}<tr><td>{1}<td>{3}</table></main><div class='notice'>{35}</div><footer>{7}</footer>", "000" + "1111111" + "00"),
    # Adverts, share links and comments inside the article element.
    ("<article><h1>{5}</h1><div class='share'><a>{1}</a> <a>{1}</a></div><p>{70}<div class='ads'>{15}</div><p>{50}<p>{2}<div class='related'><a>{7}</a></div><article><p>{30}</article></article><footer>{9}</footer>", "10101100" + "0"),
    ("<header><h1>{3}</h1><p>{12}</header><article><header><h1>{8}</h1><p>{4}</header><p>{33}<blockquote>{18}</blockquote><p>{64}<aside>{40}</aside><p>{11}<footer>{6}</footer></article>", "00" + "11111" + "0" + "1" + "0"),
    # A list of links that is the text itself, in a main element.
    ("<nav><a>{2}</a></nav><main><h2>{3}</h2><ul><li><a>{4}</a><li><a>{6}</a> {3}<li>{5} <a>{2}</a></ul><p>{25}</main><div class='cookie'>{28}</div><footer><a>{3}</a></footer>", "0" + "11111" + "00"),
    ("<form class='login'>{4}<p>{9}</form><main><article><p>{90}<p><a>{6}</a><p>{14}</article></main><p>{3}<p><a>{4}</a>", "00" + "111" + "00"),
    # Pages that begin or end with the text, short texts, lists, definitions, dialogues, poems, and link pages.
    ("<main><h1>{2}</h1><p>{12}<p>{1}<p>{10}</main>", "1111"), ("<article><p>{50}<p>{14}</article>", "11"), ("<article>{7}</article><div>{4}</div>", "10"),
    ("<nav><a>{1}</a></nav><article><h1>{4}</h1><p>{2}<p>{3}<p>{5}<p>{2}<p>{8}<p>{4}<p>{6}</article>", "0" + "11111111"),
    ("<article><h2>{5}</h2><dl><dt>{1}<dd>{11}<dt>{2}<dd>{6}<dt>{1}<dd>{15}</dl></article><nav><a>{4}</a></nav>", "1111111" + "0"),
    ("<div>{3}</div><article><ol><li>{4}<li><a>{3}</a><li><a>{2}</a> {1}<li>{9}<li><a>{5}</a></ol><p><a>{4}</a></article><div>{5}</div>", "0" + "111111" + "0"),
    ("<div><a>{6}</a></div><main><p><a>{8}</a><p>{16}<p><a>{2}</a><p>{6}</main><div><a>{5}</a></div>", "0" + "1111" + "0"),
    ("<div>{12}</div><main><h1>{8}</h1><figure><figcaption>{10}</figcaption></figure><p>{28}<p>{13}</main><div>{18}</div>", "0" + "1111" + "0"),
    ("<article><h1>{3}</h1><p>{40}<p>{60}</article>", "111"), ("<main><h1>{1}</h1><p>{9}</main><footer>{5}</footer>", "110"), ("<article><p>{4}</article>", "1"),
    ("<article><h1>{6}</h1><p>{130}</article><footer>{9}</footer>", "110"), ("<main><p>{95}<p>{160}</main><footer>{6} <a>{2}</a></footer><div>{5}</div>", "1100"),
    ("<div class='ad'>{10}</div><article><p>{210}</article><footer>{15}</footer>", "010"), ("<article><p>{100}</article><div class='share'>{3}</div><footer>{12}</footer>", "100"),
    # Pages without a main element: a weblog, a forum, a manual, a shop, old table layouts.
    ("<div><a>{1}</a> | <a>{1}</a> | <a>{2}</a></div><div><h1>{7}</h1><p>{55}<p>{38}<p>{90}<p>{12}</div><div><h3>{2}</h3><ul><li><a>{4}</a><li><a>{6}</a><li><a>{5}</a></ul></div><div>{6} <a>{2}</a></div>", "0" + "11111" + "00000"),
    ("<table><tr><td><a>{2}</a><td><a>{1}</a><td><a>{1}</a></table><table><tr><td><a>{3}</a><br><a>{4}</a><td><p>{40}<p>{75} <a>{2}</a> {10}<p>{28}</table><p>{5}<p><a>{6}</a>", "0000" + "111" + "00"),
    ("<div id='top'>{3}</div><div><h2>{5}</h2><p>{22}<p>{48}<pre>{30}</pre><p>{26}</div><div class='sidebar'><p>{31}<p>{24}</div><p>{8}", "0" + "11111" + "000"),
    ("<div class='menu'><a>{1}</a> <a>{1}</a></div><div><p>{34}<p>{9}<p>{51}<p>{17}</div><div class='banner'>{26}</div><div class='footer'>{19}</div>", "0" + "1111" + "00"),
    ("<ul><li><a>{2}</a><li><a>{2}</a><li><a>{1}</a></ul><h1>{8}</h1><p>{66}<p>{41}<p><a>{5}</a> <a>{4}</a><p>{4} <a>{1}</a>", "000" + "111" + "00"),
    ("<p><a>{3}</a><p><a>{2}</a> {1}<p>{150}<p>{80}<p><a>{3}</a>", "00" + "11" + "0"),
    ("<div><p>{110}<p>{130}</div><div class='footer'>{11}</div>", "110"), ("<div class='notice'>{12}</div><div><p>{140}<p>{6}<p>{90}</div><div class='footer'>{16}</div>", "01110"),
    ("<p>{35}<p>{20}<p>{60}", "111"), ("<div>{140}</div>", "1"), ("<h1>{6}</h1><p>{25}", "11"),
    ("<div><a>{2}</a></div><div><a>{1}</a></div><div><a>{3}</a></div>", "000"), ("<p>{3}<p><a>{2}</a>", "00"), ("<div class='consent'>{60}</div>", "0"),
    # Pages without a main element on which the neighbours of a block tell its kind: teasers and captions stand beside
    # links, short lines of the text beside long ones.
    ("<p><a>{5}</a><p>{14}<p><a>{7}</a><p>{18}<p><a>{4}</a><p>{12}<p><a>{6}</a><p>{16}<p><a>{3}</a>", "000000000"),
    ("<h2>{3}</h2><p>{14}<p>{18}<p>{12}<p>{16}<p>{15}", "111111"), ("<div>{16}</div><div><a>{4}</a></div><div>{13}</div><div><a>{6}</a></div>", "0000"),
    ("<div>{4}</div><div><a>{3}</a></div><div><a>{2}</a></div><div>{70}</div><div>{4}</div><div>{55}</div><div>{4}</div><div><a>{5}</a></div>", "00011100"),
    ("<div><a>{2}</a></div><div>{9}</div><div><a>{3}</a></div><div>{48}</div><div>{9}</div><div>{62}</div><div><a>{3}</a></div><div>{9}</div><div><a>{4}</a></div>", "000111000"),
    ("<td><a>{4}</a><td>{22}<td><a>{5}</a><td>{19}<td><a>{3}</a><td>{24}<td><a>{4}</a>", "0000000"), ("<p>{20}<p>{22}<p>{19}<p>{24}", "1111"),
    ("<div><a>{9}</a></div><div>{26}</div><div><a>{8}</a></div><div>{30}</div><div><a>{7}</a></div>", "00000"), ("<div>{26}</div><div>{30}</div><div>{5}</div><div>{28}</div>", "1111"),
    # Elements named like something beside the text that hold it, and articles in articles.
    ("<div id='content-related'><h1>{4}</h1><p>{60}<p>{35}<div class='related'><a>{5}</a></div><p>{20}</div><div>{6}</div>", "111010"),
    ("<article><h1>{5}</h1><p>{40}<div class='share-price'><p>{25}</div><p>{30}</article>", "1111"),
    ("<article><h1>{5}</h1><article><p>{60}<p>{45}<p>{50}</article></article><footer>{4}</footer>", "11110"),
    ("<article><p>{80}<p>{60}<article><p>{9}</article><article><p>{22}</article></article>", "1100"),
    ("<nav><a>{30}</a></nav><footer>{50}</footer>", "00"), ("<form>{12}<p>{40}</form>", "00"), ("<div class='search'>{2}</div><p>{45}<p>{6}<p>{70}<p>{2} <a>{2}</a>", "01110"),
)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED."""
    x, y = [], []
    for layout, labels in LABELLED:
        found = blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), layout))
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {layout[:60]}")
        x.append(features(found))
        y += map(int, labels)
    return np.concatenate(x), np.array(y, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """CART by Gini impurity: (share of ones,) or (feature, threshold, below, above)."""
    p = y.mean()
    if depth == 0 or p in (0.0, 1.0):
        return (float(p),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < t
            a, b = y[low].mean(), y[~low].mean()
            cost = low.sum() * a * (1 - a) + (~low).sum() * b * (1 - b)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), low)
    if best is None:
        return (float(p),)
    _, f, t, low = best
    return (f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    """True for main text."""
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    f, t, below, above = tree
    low = x[:, f] < t
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(below, x[low]), classify(above, x[~low])
    return out


def trained_tree() -> tuple:
    return grow(*labelled_table())


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, classify(tree, features(found))) if keep)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """keep, text (main text, empty if there is none); null pages count as empty, repeated rows are kept."""
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType())])
    tree = trained_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                batch = whole.slice(s, 256)
                texts = [main_text(x.as_py(), tree) for x in as_column(batch, "__html")]
                yield pa.RecordBatch.from_arrays([*(as_column(batch, c) for c in keep), pa.array(texts, pa.string())], schema.fieldNames())

    return map_arrow(pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("__html")), run, schema)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
