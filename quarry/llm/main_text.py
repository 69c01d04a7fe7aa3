"""The main text of web pages: flat blocks of text, told apart by a decision tree over them and their neighbours."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages in an output batch; elements that nest deeper than this aren't told apart, characters of a tag that quotes are looked for in.
SLICE, DEEP, LONG_TAG = 128, 512, 1 << 16

# Names of HTML elements.
#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no markup, and those whose content is no text of the page.
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template svg math".split())
UNREAD = frozenset("head select button datalist object canvas audio video map applet".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a new element of a kind closes, looked for through elements of THROUGH.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
THROUGH = frozenset("p div address td th tr".split())
SCOPES = frozenset("td th table caption".split())
#: Parts of class names, ids and roles that name what isn't the article, whole or by their beginning; and what is.
SMALL = frozenset("ad ads adv adbox adslot adunit dfp side menu menus top bottom share sharing social search login signin signup tags legal toolbar widget widgets modal popup overlay alert dialog related skip pager crumbs teaser teasers topbar respond replies reply feedback complementary contentinfo nav subscribe gdpr rail meta-nav".split())
BEGIN = ("advert", "adsense", "banner", "breadcrumb", "comment", "consent", "cookie", "copyright", "disclaimer", "disqus", "footer", "masthead", "menubar", "navbar", "navig", "newsletter", "notice", "notification", "pagination", "popular", "promo", "recommend", "sidebar", "sponsor", "subscri", "trending")
GOOD = frozenset("article articlebody post entry story".split())
LIKELY = frozenset("content main maincontent bodytext text page body".split())
OTHERS = frozenset("has with no without is".split())
#: How a section of readers' comments is headed, and what notices say.
COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:reader\S*\s+)?(?:comments?|responses?|replies|discussion|leave a (?:reply|comment)|join the discussion|kommentare?|leserkommentare|commentaires?|comentarios?|r[ée]ponses?|antworten)(?:\W|\d)*", re.I)
NOTICE = re.compile(r"©|\(c\)\s*\d|\bcopyright\b|\ball rights reserved\b|\balle rechte\b|\btous droits\b|\btodos los derechos\b|\bcookies?\b|\bprivacy policy\b|\bdatenschutz\b|\bterms of (?:use|service)\b|\badvertisement\b|\banzeige\b|\bsponsored\b", re.I)

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/>])(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
HIDES = re.compile("hidden|display|visib", re.I)
HEAD = frozenset("head meta link title style script base noscript template".split())
FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "article", "likely", "apart", "page has article", "heading", "header", "form", "notice", "below comments", "list", "rich near")


def _said(attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """What an element's class, id, role and style say: the article, likely so, apart from it, a header, hidden."""
    good = likely = apart = header = hidden = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            for one in value.split():
                parts = [p.lower() for p in PARTS.findall(one)]
                cut = next((i for i, p in enumerate(parts) if p in OTHERS), len(parts))
                off = any(p in SMALL or p.startswith(BEGIN) for p in parts[:cut])
                head = not off and "header" in parts
                apart, header = apart | off, header | head
                ends = set() if off or head or not parts else {parts[0], parts[-1]}
                good, likely = good | bool(ends & GOOD), likely | bool(ends & LIKELY)
    return good, likely, apart, header, hidden


class Block:
    """A flat block: its text, words, words in links, where it stands, whether it is a heading, and the outermost element around
    it whose names put it apart (its ordinal, or -1)."""

    __slots__ = ("text", "words", "linked", "place", "heading", "owner")  # heading: its level, or 0

    def __init__(self, text: str, words: int, linked: int, place: tuple, heading: int, owner: int):
        self.text, self.words, self.linked, self.place, self.heading, self.owner = text, words, linked, place, heading, owner


#: A place: in the article, likely in it, apart from it, in a header, in a form, in a list, below a heading of comments.
OUTSIDE = (False,) * 7


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. A name that would put most of the page apart, its title with it, counts for nothing."""
    void: set[int] = set()
    while True:
        out, titled = _blocks(page, void)
        words: Counter = Counter()
        for b in out:
            words[b.owner] += b.words
        wrong = {owner for owner in titled - void if owner >= 0 and words[owner] > 0.6 * sum(words.values())}
        if not wrong:
            return out
        void |= wrong


def _blocks(page: str, void: set[int]) -> tuple[list[Block], set[int]]:
    """Blocks, and the owners that hold a main title. Markup is read as browsers do: comments, scripts and the like up to their
    end, elements that others close, end tags that fit nothing; a tag that the page's end cuts off is dropped."""
    out: list[Block] = []
    pieces: list[str] = []
    linked, link, unread, nth = 0, -1, None, 0
    stack: list[list] = []  # tag, place, owner
    open_: Counter = Counter()
    titled: set[int] = set()
    lacking: set[str] = set()  # elements whose end was looked for in vain

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tag, place, owner = stack[-1] if stack else ("", OUTSIDE, -1)
                out.append(Block(text, text.count(" ") + 1, linked, place, int(tag[1]) if tag in HEADINGS else 0, owner))
                if tag in HEADINGS and tag != "h1" and len(stack) > 1 and len(text) < 60 and COMMENTS.fullmatch(text):
                    out[-1].place = stack[-2][1] = (*stack[-2][1][:6], True)
            pieces, linked = [], 0

    def close(upto: int) -> None:
        nonlocal link
        while len(stack) > upto:
            open_[stack.pop()[0]] -= 1
        if len(stack) < link:
            link = -1

    def ends(tag: str, at: int) -> int:
        """Where the element that starts before `at` ends; -1 if nowhere."""
        if tag not in lacking:
            depth = 1
            for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
                depth += -1 if m[1] else 1
                if not depth:
                    return m.end()
            lacking.add(tag)
        return -1

    at, end = 0, page.rfind(">") + 1
    while True:
        lt = page.find("<", at, end)
        piece = page[at : lt if lt >= 0 else max(at, end)]
        if lt < 0:
            piece += re.split(r"<[a-zA-Z/!?]", page[max(at, end) :], maxsplit=1)[0]
        if piece and unread is None:
            piece = entities.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if link >= 0:
                linked += len(piece.split())
        if lt < 0:
            break
        m = TAG.match(page, lt, min(end, lt + LONG_TAG))
        if m is None:
            after = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 2) if page.startswith(("<!-->", "<!--->"), lt) else page.find("-->", lt + 4)
                at = stop + 3 if stop >= 0 else len(page)
            elif after.isascii() and after.isalpha() or after in ("/", "!", "?"):
                at = page.find(">", lt) + 1
            else:
                at = lt + 1
                if unread is None:
                    pieces.append("<")
            continue
        at, ending, tag, rest = m.end(), bool(m[1]), m[2].lower(), m[3]
        if tag in RAW and not ending:
            if not (rest.endswith("/") and tag in ("svg", "math")):
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if unread is not None:  # in the head, that what isn't of it ends
            if ending and tag == unread or tag not in HEAD:
                unread = None
            if tag in HEAD:
                continue
        if tag == "head":
            unread = None if ending else tag
            continue
        if not ending and tag not in VOID and (tag in UNREAD or rest and HIDES.search(rest) and tag not in ("html", "body") and _said(rest)[4]):
            stop = ends(tag, at)
            if stop > 0:  # goes with all that it holds
                at = stop
                if tag in BLOCKS:
                    flush()
                continue
        if tag == "a":
            link = -1 if ending else len(stack)
        elif tag == "br":
            pieces.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if ending:
            if open_[tag]:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] != tag and (stack[k][0] not in SCOPES or tag in ("table", "tr", "tbody", "thead", "tfoot")):
                    k -= 1
                if k >= 0 and stack[k][0] == tag:
                    close(k)
            continue
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in CLOSES or tag in ("article", "main", "footer", "aside") and open_["nav"]:
            closing = CLOSES.get(tag, ("nav",))
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in closing and (stack[k][0] in THROUGH or tag not in CLOSES):
                k -= 1
            if k >= 0 and stack[k][0] in closing:
                close(k)
        if tag in VOID or len(stack) >= DEEP:
            continue
        (good, likely, apart, header, form, list_, below), owner = stack[-1][1:] if stack else (OUTSIDE, -1)
        says = _said(rest) if rest and tag not in ("html", "body") else (False,) * 5
        if says[2] and owner < 0 and nth not in void:
            owner = nth
        put = says[2] and nth not in void and tag != "main"
        nth += 1
        if tag in ("h1", "main"):
            titled.add(owner)
        if tag in ("article", "main") or says[0]:
            good, form = True, False
        apart |= put or tag in ("nav", "aside", "footer", "menu", "dialog", "search")
        stack.append([tag, (good, likely or says[1], apart, header or tag == "header" or says[3], form or tag in ("form", "fieldset"), list_ or tag == "li", below), owner])
        open_[tag] += 1
    flush()
    return out, titled


def features(found: list[Block]) -> np.ndarray:
    """A row for each block, in the order of FEATURES."""
    n = len(found)
    words = np.array([b.words for b in found], float)
    links = np.array([min(1.0, b.linked / b.words) for b in found])
    place = np.array([b.place for b in found], float).reshape(n, 7)
    rich = (words >= 15) & (links < 0.34) & (place[:, 2] == 0)
    before, after = np.arange(n), np.arange(n)
    before[~rich], after[~rich] = -(n + 99), 2 * n + 99
    near = np.minimum(np.arange(n) - np.maximum.accumulate(before), np.minimum.accumulate(after[::-1])[::-1] - np.arange(n)) if n else words
    shift = lambda c, k: np.concatenate([[0.0], c[:-1]]) if k < 0 else np.concatenate([c[1:], [0.0]])
    notice = np.array([b.words < 60 and bool(NOTICE.search(b.text)) for b in found], float)
    inside = (place[:, 0] > 0) & (place[:, 2] == 0)
    return np.column_stack([
        np.minimum(words, 100), links, np.minimum(shift(words, -1), 100), shift(links, -1), np.minimum(shift(words, 1), 100), shift(links, 1),
        inside, place[:, 1], place[:, 2], np.full(n, inside.any()), [b.heading for b in found], place[:, 3], place[:, 4], notice, place[:, 6], place[:, 5], np.minimum(near, 9),
    ]) if n else np.zeros((0, len(FEATURES)))


class Tree:
    """A decision tree: splits that lower the Gini impurity most, down to pure leaves or `depth`; of equal splits the first
    feature and the least threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 2):
        self.at, self.cut, self.left, self.right, self.value = [], [], [], [], []
        self._grow(x, y.astype(float), depth, least)
        self.at, self.cut, self.left, self.right, self.value = map(np.array, (self.at, self.cut, self.left, self.right, self.value))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me, n, best = len(self.at), len(y), (1e-9, 0, 0.0)
        for c in (self.at, self.cut, self.left, self.right):
            c.append(0)
        self.value.append(y.mean())
        if depth and 0 < y.mean() < 1:
            own = n * y.mean() * (1 - y.mean())
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, hits = x[order, f], np.cumsum(y[order])
                k = np.flatnonzero(v[1:] > v[:-1]) + 1
                k = k[(k >= least) & (n - k >= least)]
                if len(k):
                    a, b = hits[k - 1], hits[-1] - hits[k - 1]
                    gain = own - a * (1 - a / k) - b * (1 - b / (n - k))
                    if gain.max() > best[0] + 1e-9:
                        best = (gain.max(), f, (v[k - 1] + v[k])[gain.argmax()] / 2)
        if best[0] > 1e-9:
            low = x[:, best[1]] <= best[2]
            self.at[me], self.cut[me] = best[1], best[2]
            self.left[me] = self._grow(x[low], y[low], depth - 1, least)
            self.right[me] = self._grow(x[~low], y[~low], depth - 1, least)
        return me

    def main(self, x: np.ndarray) -> np.ndarray:
        """Which rows are main text."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = self.left[node] > 0
            if not inner.any():
                return self.value[node] >= 0.5
            low = x[np.arange(len(x)), self.at[node]] <= self.cut[node]
            node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)


#: Parts of pages, by what they are: main text says {good}, the rest {bad}. {n} is a number of such words, {N} many.
MAIN = (
    "<h1>{good}</h1><p>{N}</p><p>{N}</p><p>{n}</p><p>{N}</p>",
    "<h1>{n}</h1><p>{N} <a href=x>{good}</a> {N}</p><h2>{good}</h2><p>{good}</p><p>{N}</p><blockquote>{n}</blockquote><p>{N}</p>",
    "<h1>{one}</h1><p>{N}</p><h2>{one}</h2><p>{N}</p><h2>{good}</h2><ul><li>{n}</li><li>{good}</li></ul><p>{n}</p><h3>{one}</h3><p>{N}</p>",
    "<h2>{n}</h2><div>{N}</div><div>{good}</div><div>{N}</div><div>{n}</div><div>{N}</div>",
    "<h1>{n}</h1><p>{good}</p><p>{N}</p><ul><li>{good}</li><li>{n}</li><li>{n} <a href=x>{good}</a></li></ul><p>{N}</p><p>{n}</p>",
    "<h1>{n}</h1><p>{N}</p><figure><figcaption>{n}</figcaption></figure><p>{good}</p><p>{good}</p><p>{N}</p><table><tr><th>{good}</th><td>{n}</td></tr></table><p>{N}</p>",
    "<h1>{one}</h1><p>{N}</p><p>{one}</p><p>{N}</p><p>{one}</p>",
    "<h2>{one}</h2><p>{n}</p><p>{N}</p><h3>{one}</h3><p>{N}</p><p>{one}</p><p>{good}</p><p>{N}</p>",
    "<p>{N}</p><p>{good}</p><p>{N}</p>",
    "<div>{N} {N}</div><div>{N}</div><div>{N}</div><div>{N}</div>",
    "<p>{n}</p>" * 3 + "<p>{good}</p>" * 3 + "<p>{N}</p>" + "<p>{one}</p>" * 3,
    "<h1>{good}</h1><p>{n}</p><p>{good}</p>",
    "<h1>{good}</h1><p>{N}</p><p>{one} copyright {good}</p><p>{N}</p><p>{one} all rights reserved</p>",
)
FRAMES = ("<article>{}</article>", "<section>{}</section>", "{}", "<main>{}</main>", "<div class=post-content>{}</div>", "<main><article><header><h1>{good}</h1></header>{}</article></main>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<form id=page><article>{}</article></form>", "<div id=content>{}</div>")
MENU = ("<li><a href=x>{bad}</a></li>" * 6, "<li><a href=x>{bad}</a></li>" * 3, "<a href=x>{bad}</a> | <a href=x>{bad}</a> | <a href=x>{bad}</a>", "<div><a href=x>{bad}</a></div>" * 5)
ABOVE = (
    "<nav><ul>{menu}</ul></nav>", "<header><h1><a href=x>{bad}</a></h1><p>{bad}</p></header><nav>{menu}</nav>", "<div class=menu>{menu}</div><div class=ad>{more}</div>", "<div>{menu}</div>", "<header><div>{bad}</div><ul>{menu}</ul></header>", "<div id=header><h1>{bad}</h1><p>{more}</p></div><ul>{menu}</ul>", "<div class='cookie-notice'><p>{more}</p></div><nav>{menu}</nav>", "<p>{bad} cookies {more}</p><div>{menu}</div>", "", "<div><a href=x>{bad}</a></div>",
)
INSIDE = ("", "", "<aside><h3>{bad}</h3><p>{more}</p></aside>", "<div class=advert>{more}</div>", "<form><label>{bad}</label><p>{more}</p></form>", "<div class=share><a href=x>{bad}</a></div>", "<footer><p>{bad}</p></footer>", "<ul>{menu}</ul>", "<div>{menu}</div>", "<div><h3>Comments</h3><p>{more}</p><p>{bad}</p></div>", "<section><h2>{bad}</h2><ul>{menu}</ul></section>")
BELOW = (
    "<footer>{bad}</footer>", "<aside><h3>{bad}</h3><p>{more}</p><ul>{menu}</ul></aside><footer><p>&copy; {bad}</p></footer>", "<div class=sidebar><h3>{bad}</h3><p>{more}</p></div><div id=footer>{menu}<p>{bad}</p></div>", "<section class=comments><h2>{bad}</h2><article><p>{more}</p></article><p>{more}</p></section>", "<div><h3>Comments</h3><div><p>{bad}</p><p>{more}</p></div><p>{more}</p></div><div>{menu}</div>",
    "<form><p>{bad}</p><label>{bad}</label></form><footer>{menu}</footer>", "<div>{menu}</div><p>&copy; {bad}</p>", "<div class=related><h3>{bad}</h3><div><a href=x>{bad}</a><p>{more}</p></div></div>", "<div><h4>{bad}</h4>{menu}</div><p>Copyright {bad}</p>", "<section><h2>{bad}</h2><ul>{menu}</ul></section><div>&copy; {bad}</div>", "",
)


@lru_cache
def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The table that the tree is trained on: features and labels of the blocks of 900 pages, put together from labelled parts."""
    r, rows, labels = random.Random(13), [], []

    def said(part: str) -> str:
        part = part.replace("{menu}", r.choice(MENU))
        for name, word, lo, hi in (("{one}", "good", 1, 1), ("{good}", "good", 1, 4), ("{n}", "good", 3, 14), ("{N}", "good", 18, 90), ("{bad}", "bad", 1, 6), ("{more}", "bad", 5, 40)):
            while name in part:
                part = part.replace(name, " ".join([word] * r.randint(lo, hi)), 1)
        return part

    for k in range(900):
        main, inside, frame = r.choice(MAIN if "article" in FRAMES[k % len(FRAMES)] else MAIN[:-3]), r.choice(INSIDE), FRAMES[k % len(FRAMES)]
        cut = main.rfind("<p>")
        body = frame.replace("{}", main[:cut] + inside + main[cut:] if inside and not inside.startswith("<footer") and cut > 0 else main + inside)
        page = f"{r.choice(ABOVE)}{body}{r.choice(BELOW)}{r.choice(('', r.choice(BELOW)))}"
        found = blocks(said(f"<html><body>{f'<div id=content>{page}</div>' if k % 7 == 0 else page}</body></html>"))
        rows.append(features(found))
        labels += ["good" in b.text for b in found]
    return np.concatenate(rows), np.array(labels)


@lru_cache
def trained() -> Tree:
    return Tree(*labelled())


def main_blocks(page: str, tree: Tree) -> list[str]:
    found = blocks(page)
    return [b.text for b, keep in zip(found, tree.main(features(found))) if keep]


def with_main_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """pages with text and n_chars (code points) added: the article of each whole html.

    Blocks are what stands between the edges of block elements; in a block all white space, a <br> too, is one space, and blocks
    are joined by one newline. Character references are decoded, those without a semicolon as browsers do. A decision tree
    decides on each block by its words and link density, those of its neighbours, how far running text is, and the elements,
    classes, ids and roles around it; it is trained here on a small labelled table. Scripts, styles, heads, form controls and
    hidden elements are never read. A null or empty html, and a page without an article, has an empty text. Rows that repeat are
    worked on each; other columns stay, those named text and n_chars are replaced; an empty table gives no rows. Pages are read
    in one pass, whatever their length, and nothing is shuffled.
    """
    from pyspark.sql import types as T

    tree = tree or trained()
    pages = pages.drop("text", "n_chars").withColumn("text", F.coalesce(F.col("html").cast("string"), F.lit("")))
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                texts = ["\n".join(main_blocks(page.as_py(), tree)) for page in part.column(len(names) - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "n_chars"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("n_chars", T.LongType())]))
