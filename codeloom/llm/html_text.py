"""Operator 5: main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by
their own measures: characters, the share of them inside links, and the share of
stop words. Blocks under menus, headers, footers, sidebars, notices, adverts, forms
or reader comments (by element, role, or clear class and id words) are boilerplate at once.
The article and main elements that hold most of a page's decided prose are its frame, and
blocks outside it are boilerplate; where more prose stands outside all of them (cards of
other stories are often ``article`` elements), the small ones are boilerplate. Class words
that frameworks also give to content (``form-group``, ``alert``) only raise the bar: a run
of such blocks is content if it is long prose as a whole, else boilerplate. A form around
the whole article is a page's frame and no form. Short
blocks, long ones with few stop words, and paragraphs of the frame that are mostly links
stay open. The second pass gives each
open block the label of its nearest decided neighbours: good if both are, or the
nearer one is; with none decided, whether it stands in the frame.

Cases: null and empty html give an empty text; unclosed elements end with the page;
an unfinished tag at the end is dropped; a lone ``<`` is text; character references
are decoded once; white space is Unicode's; rows are independent, so null or repeated
ids, ties and extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, prepare, slices, table, texts_of

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
a an and are as at be been but by for from had has have he her his i if in is it its me my not of on or our she so
than that the their them then there these they this those to was we were what when which who will with would you your
aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich
im ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wie wird wir zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou où
par pas plus pour qu que qui sa se ses son sont sur un une vous
al como con cuando de del desde donde el ella en entre era es esa ese esta este ha hay la las le lo los más me mi muy
no o para pero por que se sea ser si sin sobre son su sus también te tiene todo un una uno y ya
""".split()
)
# Elements that end a block, elements whose content is no text, elements that are boilerplate.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style title noscript template iframe svg math object audio video canvas textarea noframes noembed xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog select button fieldset head".split())
HOLDERS = frozenset("article main nav header footer aside form menu dialog select button fieldset head body html div section ul ol dl table figure details center td".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
# Words of class and id attributes that mark boilerplate, and words that mark a layout around the content.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
    "sidebar sidebars aside widget widgets rail menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar header masthead footer copyright comment comments commentlist disqus respond reply replies discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager form search searchbox disclaimer skip".split()
)
# Those of them that content has too
SOFT_WORDS = frozenset("alert alerts aside discussion form header masthead overlay rail related respond search share sharing skip social toolbar topbar widget widgets".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies discussion".split())
LAYOUT_WORDS = frozenset("content main article body wrapper container page layout with has no entry".split())

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)""", re.S)
_attribute = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")  # in order, so that values aren't read as names
_word = re.compile(r"[^\W\d_]+")

SHORT, LONG, LINKS, STOPS = 70, 200, 0.5, 0.18
#: of the article with the most prose, what share another one needs to belong to the page's text
PART = 0.2
HARD, SOFT, FRAME = 1, 2, 3


def _marked(name: str, attributes: str) -> int:
    """``HARD`` if an element is boilerplate by its own name or attributes, ``SOFT`` if its class words hint at it, else 0."""
    if name in BOILER_TAGS:
        return HARD
    if not attributes or name in ("body", "html"):
        return 0
    soft = False
    marks = COMMENT_WORDS if name in ("article", "main") else BOILER_WORDS
    for key, *values in _attribute.findall(attributes):
        key = key.lower()
        if key not in ("class", "id", "role", "hidden"):
            continue
        value = (values[0] or values[1] or values[2]).lower()
        if key == "hidden" or key == "role" and value in BOILER_ROLES:
            return HARD
        words = set(re.split(r"[^a-z]+", value))
        if key != "role" and words & marks and not words & LAYOUT_WORDS:
            if words & marks - SOFT_WORDS or marks is COMMENT_WORDS:
                return HARD
            soft = True
    return SOFT if soft else 0


Block = tuple[str, int, int, int, bool]


def blocks(page: str) -> list[Block]:
    """(text, characters in links, mark by place, number of the outermost article or 0, is a paragraph) of each block that has text."""
    out: list[Block] = []
    holders: list[tuple[str, int]] = []  # open elements that matter, with their mark
    still_open: Counter[str] = Counter()
    marks = [0, 0, 0, 0]  # how many open elements have each mark
    inside = own_mark = articles = 0
    link = heading = paragraph = False
    text: list[str] = []
    linked: list[str] = []

    def close() -> None:
        nonlocal text, linked
        if text:
            whole = " ".join(_html.unescape("".join(text)).split())
            if whole:
                in_links = len(" ".join(_html.unescape("".join(linked)).split())) if linked else 0
                title = heading and inside and not own_mark and marks[HARD] == 1 and not marks[SOFT] and still_open["header"] > 0
                hard = marks[HARD] or own_mark == HARD or marks[FRAME] and not inside
                soft = marks[SOFT] or own_mark == SOFT
                out.append((whole, in_links, 0 if title else HARD if hard else SOFT if soft else 0, articles if inside else 0, paragraph))
            text, linked = [], []

    at, n = 0, len(page)
    while at < n:
        m = _token.search(page, at)
        end = m.start() if m else n
        if end > at:
            text.append(page[at:end])
            if link:
                linked.append(page[at:end])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if not closing and name in RAW_TAGS:
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            after = page.find(">", stop.start()) if stop else -1
            at = after + 1 if after >= 0 else n
            continue
        if name == "a":
            link = not closing
        if name in BLOCK_TAGS or name in HOLDERS:
            close()
            link = False
            own_mark, heading, paragraph = 0, False, False
        if closing:
            if still_open[name] > 0:
                while holders:
                    h, mark = holders.pop()
                    still_open[h] -= 1
                    marks[mark] -= 1
                    inside -= h in ("article", "main")
                    if h == name:
                        break
        elif name not in VOID_TAGS and not (m[3] or "").endswith("/"):
            mark = _marked(name, m[3] or "")
            if name in HOLDERS:
                if name == "form" and not inside:
                    mark = FRAME
                holders.append((name, mark))
                still_open[name] += 1
                marks[mark] += 1
                if name in ("article", "main"):
                    articles += not inside
                    inside += 1
            elif name in BLOCK_TAGS:
                own_mark, heading, paragraph = mark, name in ("h1", "h2", "h3"), name == "p"
    close()
    return out


def _stops(text: str) -> float:
    words = _word.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _softened(found: list[Block]) -> list[tuple[str, int, bool, int, bool]]:
    """Blocks with a plain mark: a run of softly marked ones is boilerplate unless it is long prose."""
    out: list[tuple[str, int, bool, int, bool]] = []
    for mark, run in groupby(found, key=lambda x: x[2]):
        some = list(run)
        if mark == SOFT:
            whole = " ".join(x[0] for x in some)
            mark = len(whole) < LONG or sum(x[1] for x in some) > len(whole) / 5 or _stops(whole) < STOPS
        out += [(text, in_links, bool(mark), *rest) for text, in_links, _, *rest in some]
    return out


def _frame(found: list[tuple[str, int, bool, int, bool]], stops: list[float]) -> set[int]:
    """The articles that make up the page's text, with 0, for what stands outside of all, if more of the prose does."""
    prose: Counter[int] = Counter()
    size: Counter[int] = Counter()
    for (text, in_links, bad, article, _), share in zip(found, stops, strict=True):
        if not bad:
            size[article] += len(text)
            if len(text) >= SHORT and in_links <= LINKS * len(text) and share >= STOPS:
                prose[article] += len(text)
    counts = prose or size  # no language of the word list: length alone
    own = {k: n for k, n in counts.items() if k}
    outside = not own or counts[0] > sum(own.values())
    most = counts[0] if outside else max(own.values())
    return {k for k, n in own.items() if n >= PART * most} | ({0} if outside else set())


def main_text(page: str) -> str:
    found = _softened(blocks(page))
    stops = [0.0 if bad else _stops(text) for text, _, bad, *_ in found]
    frame = _frame(found, stops)
    within = [article in frame and article > 0 for *_, article, _ in found]
    labels: list[bool | None] = []
    for (text, in_links, bad, article, paragraph), inside, share in zip(found, within, stops, strict=True):
        density = in_links / len(text)
        if bad or article not in frame or density > LINKS and not (inside and paragraph):
            labels.append(False)
            continue
        if len(text) < SHORT or density > LINKS:
            labels.append(False if density > 0 and not inside else None)
            continue
        labels.append(True if share >= STOPS and (inside or len(text) >= LONG or share >= 1.5 * STOPS) else None)
    if True not in labels:  # no language of the word list: length alone decides
        labels = [True if label is None and len(x[0]) >= LONG else label for x, label in zip(found, labels, strict=True)]
    before: list[tuple[bool, int] | None] = []
    last = None
    for k, label in enumerate(labels):
        before.append(last)
        last = (label, k) if label is not None else last
    keep, after = [], None
    for k in range(len(labels) - 1, -1, -1):
        label = labels[k]
        if label is None:
            near = [x for x in (before[k], after) if x is not None]
            if within[k]:  # in the frame, boilerplate next to it tells nothing
                near = [x for x in near if x[0]]
            if not near:
                good = within[k]
            elif len(near) == 2 and near[0][0] != near[1][0]:
                good = min(near, key=lambda x: abs(x[1] - k))[0]
            else:
                good = near[0][0]
        else:
            good, after = label, (label, k)
        keep.append(good)
    return " ".join(x[0] for x, good in zip(found, keep[::-1], strict=True) if good)


def _run(batches):
    for batch in batches:
        for some in slices(batch, "html", 1 << 20):
            got = [main_text(x) for x in texts_of(some, "html")]
            rest = [some.column(k) for k in range(some.num_columns) if some.schema.names[k] != "html"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], [*(x for x in some.schema.names if x != "html"), "text", "n_chars"])


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(lean(_run), f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLE_SQL: dict[str, str] = {}
