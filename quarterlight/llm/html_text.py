"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' word count and link density.

Python cuts a page into blocks and counts; the tree is fitted by Spark ML on a
small labelled table and applied as a column expression to the array of blocks,
so a page stays one row and nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarterlight.llm.common import table

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "aside", "inside", "heading")

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: Their content isn't text of the page.
SKIPPED = frozenset("script style title noscript template textarea svg math iframe object select option canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements that stand beside the text; a form does unless it is around it.
ASIDE_TAGS = frozenset("nav footer aside menu dialog button".split())
FORM_TAGS = frozenset("form fieldset".split())
#: What a class, id or role calls such a thing, and what may be added to its name; any other word in the name makes it another thing.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promotion recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
ASIDE_NAMES |= frozenset("commentaires comentarios discussion discussions feedback kommentar kommentare onetrust rail reactions responses respond sidecolumn tagcloud taglist tags".split())
#: Of these the readers' own words, which are the page's text only where nothing else is prose.
READER_NAMES = frozenset("comment comments commentaires comentarios discussion discussions disqus feedback kommentar kommentare reactions replies reply respond responses".split())
ADDED_NAMES = frozenset("area bar block body box button center container content field group holder inner item items left line link links list main message messages page panel policy right row sdk section side site slot small sticky text thread top bottom unit user wrap wrapper".split())
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: A short block outside of an article that reads so is a notice of ownership.
_OWNED = re.compile(r"(?:\u00a9|\(c\)\s|copyright\b)|.*\ball rights reserved\b", re.I)
OWNED_WORDS = 30
#: Their class, id or role says nothing of what is inside; that of an article does if another one came before.
WRAPPERS = frozenset("html body main article".split())
#: Part of a page's words beyond which an element is the page's text, whatever it is called, if there is no article or main elsewhere.
MOST_WORDS = 0.6
#: Words from which a block may be prose.
PROSE = 12
#: Skipped elements whose content is plain characters, and elements without content.
RAW = frozenset("script style title textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open svg or math.
_OUTSIDE = frozenset("body blockquote div dl dd dt h1 h2 h3 h4 h5 h6 li ol p pre table ul".split())
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in SKIPPED}


@lru_cache(4096)
def names_aside(name: str) -> bool:
    """Whether a class, id or role is made of ASIDE_NAMES and ADDED_NAMES alone (parted by case or signs, or written in one), one of the first among them."""

    def cut(part: str, found: bool) -> bool | None:
        """Whether there is an aside name among the words of the best cut; None if it can't be cut."""
        if not part:
            return found
        ways = [cut(part[n:], found or part[:n] in ASIDE_NAMES) for n in range(len(part), 1, -1) if part[:n] in ASIDE_NAMES or part[:n] in ADDED_NAMES]
        return None if all(x is None for x in ways) else any(ways)

    parts = _NAME_PARTS.findall(name[:60])
    cuts = [cut(x.lower(), False) for x in parts if not x.isdigit()]
    if any(x is None for x in cuts):
        whole = cut("".join(parts).lower(), False)  # sideBar, side-bar
        return bool(whole)
    return any(cuts) or bool(cut("".join(x for x in parts if not x.isdigit()).lower(), False))


@lru_cache(4096)
def names_readers(name: str) -> bool:
    """Whether a name of names_aside speaks of readers' words."""
    parts = [x.lower() for x in _NAME_PARTS.findall(name[:60])]
    return any(x in READER_NAMES for x in parts) or any("".join(parts).startswith(x) for x in READER_NAMES)


def _is_aside(tag: str, attrs: str, inside: bool, another: bool = False) -> tuple[bool, int]:
    """Whether the element is beside the text, or hidden, and whether it says so by what doesn't hold around the text (1: class, id, role or being a form; 2: they speak of readers' words). another: an article that isn't the page's first."""
    if tag in ASIDE_TAGS or tag == "header" and not inside:
        return True, 0
    named = int(tag in FORM_TAGS)
    for name, *values in _ATTRIBUTE.findall(attrs) if attrs else ():
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True, 0
        if name in ("class", "id", "role") and (tag not in WRAPPERS or another):
            said = [x for x in value.split() if names_aside(x) and not (inside and x.lower() in ("header", "banner"))]
            named = max(named, 2 if any(map(names_readers, said)) else int(bool(said)))
    return False, named


def _skip(page: str, at: int, tag: str, outer: set[str]) -> int:
    """Where the skipped element that begins before `at` ends: behind its end tag, or before what shows that it was left open."""
    if tag in RAW:
        over = _CLOSE[tag].search(page, at)
        return over.end() if over else len(page)
    inner = [tag]
    while m := _MARKUP.search(page, at):
        at = m.end()
        met = (m["tag"] or m["tag2"] or "").lower()
        if not met:
            continue
        if m["end"] or m["end2"]:
            if met in inner:
                while inner.pop() != met:
                    pass
                if not inner:
                    return at
            elif met in outer:
                return m.start()
        elif tag == "option" and met in ("option", "optgroup") or tag in ("svg", "math") and met in _OUTSIDE and "foreignobject" not in inner:
            return m.start()
        elif not (m["attrs"] or "").endswith("/") and met not in VOID:
            if met in RAW:
                at = _skip(page, at, met, outer)
            else:
                inner.append(met)
    return len(page)


def blocks(page: str | None) -> list[tuple]:
    """(text, words, link words, aside, inside, heading) of each block with text, in page order."""
    found: list[tuple] = []
    stack: list[tuple[str, bool, bool, int]] = []
    # elements that are aside by their words: whether they are around the text; and what of each block
    around: list[bool] = []
    readers: list[bool] = []
    by_words: list[list[int]] = []
    seen: set[str] = set()
    parts: list[str] = []
    aside = inside = heading = False
    in_link, link_words, at = 0, 0, 0
    page = page or ""

    def flush() -> None:
        nonlocal link_words
        if parts:
            words = "".join(parts).split()
            if words:
                text = " ".join(words)
                owned = len(words) <= OWNED_WORDS and _OWNED.match(text) is not None
                found.append((text, len(words), min(link_words, len(words)), aside or owned and not inside, inside, heading))
                by_words.append([x[3] for x in stack if x[3] >= 0])
            parts.clear()
        link_words = 0

    def add(text: str) -> None:
        nonlocal link_words
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                link_words += len(text.split())

    while m := _MARKUP.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m["data"]:
            parts.append(m["data"])
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), bool(m["end"] or m["end2"]), m["attrs"] or ""
        if tag in SKIPPED:
            if tag not in INLINE:
                flush()
            if not closing and not attrs.endswith("/"):
                at = _skip(page, at, tag, {x[0] for x in stack})
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        marked = not closing and tag in INLINE and attrs and any(_is_aside(tag, attrs, inside))
        if tag in INLINE and not marked and not (closing and any(x[0] == tag for x in stack)):
            continue
        flush()
        in_link = 0
        # a new block ends a paragraph or heading that is still open
        if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and not (closing and stack[-1][0] == tag):
            if not (closing and tag in INLINE):
                stack.pop()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif not attrs.endswith("/") and tag not in ("hr", "meta", "link", "base", "col", "source", "input", "img"):
            another = False
            if tag in ("article", "main"):
                # the page's first article, or first one inside main, is its text: no word of what is around it holds
                within = any(x[0] == "main" for x in stack)
                another = tag == "article" and ("article in main" in seen or "article" in seen and not within or any(x[0] == "article" for x in stack))
                if tag not in seen or within and "article in main" not in seen:
                    for x in stack:
                        if x[3] >= 0:
                            around[x[3]] = True
                seen.add(tag)
                if within:
                    seen.add("article in main")
            sure, by_word = _is_aside(tag, attrs, inside, another)
            stack.append((tag, sure, tag in ("article", "main"), len(around) if by_word else -1))
            if by_word:
                around.append(False)
                readers.append(by_word == 2)
        aside, inside = any(x[1] for x in stack), any(x[2] for x in stack)
        heading = bool(stack) and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")
    add(page[at:])
    flush()
    # an element that has most of the page's words is its text, if no article or main stands elsewhere
    held, every = [0] * len(around), sum(b[1] for b in found)
    within = [0] * len(around)
    for b, own in zip(found, by_words):
        for i in own:
            held[i] += b[1]
            within[i] += b[1] * b[4]
    texts = sum(b[1] for b in found if b[4])
    for i in range(len(around)):
        if not around[i] and held[i] > MOST_WORDS * every and texts == within[i]:
            around[i] = not readers[i] or all(b[1] < PROSE for b, own in zip(found, by_words) if i not in own)
    return [(*b[:3], b[3] or not all(around[i] for i in own), *b[4:]) for b, own in zip(found, by_words)]


def features(found: list[tuple]) -> list[tuple]:
    """FEATURES of each block."""
    counted = [(float(w), link / w) for _, w, link, *_ in found]
    edge = (0.0, 0.0)
    return [
        (*counted[i], *(counted[i - 1] if i else edge), *(counted[i + 1] if i + 1 < len(found) else edge), *map(float, block[3:]))
        for i, block in enumerate(found)
    ]


_LONG = "keep this is a paragraph of the story with quite a number of words in it and it goes on for a while so that it reads as prose"
_OTHER = _LONG.replace("keep", "drop")
_MENU = "".join(f"<li><a href='/{w}'>drop {w}</a></li>" for w in ("home", "news", "about us"))
#: The labelled table: pages of which each block's first word is its label.
LABELLED = (
    f"<nav><ul>{_MENU}</ul></nav><div class=ad>drop buy now</div><article><h1>keep title</h1><p>{_LONG}<p>keep.<p>{_LONG} {_LONG}</article><footer>drop all rights reserved by the owner</footer>",
    f"<header>drop the site</header><main><h1>keep a title of more words</h1><p>{_LONG}<p><a href=/x>keep linked</a> words in the text<p>keep so<aside>drop see also <a href=/y>drop this</a></aside><p>keep the end</main><form>drop your name</form>",
    f"<div class=sidebar><p>{_OTHER}</div><article><p>keep<p>keep it<p>{_LONG}</article><div class=comments><p>{_OTHER}<p>drop nice</div>",
    f"<ul>{_MENU}</ul><h1>keep heading</h1><p>{_LONG}</p><p>{_LONG}</p><p>keep short one</p><p>{_LONG}</p><ul>{_MENU}</ul><p>drop contact</p>",
    f"<div><ul>{_MENU}</ul></div><div><p>{_LONG} {_LONG}</p><p>keep a few words here</p><p>{_LONG}</p></div><div><a href=/a>drop more</a> <a href=/b>drop stories</a></div><div>drop legal</div>",
    f"<article><div class=ad>drop an advert within</div><p>{_LONG}<div class=notice>drop we use cookies on this site to give you more of them and you may agree to it</div><p>keep after it<ul><li>keep one<li>keep two</ul><p><a href=/z>keep all of it is a link</a></article><div class=cookie>drop accept</div>",
    f"<nav><a href=/>drop home</a></nav><article><h1>keep</h1><p>keep word</article><footer>drop</footer><footer><p>{_OTHER}</footer>",
    "<article>keep only words", f"<article><p>{_LONG}", f"<p>{_LONG} {_LONG}", "<main><p>keep <a href=/m>more of it</a></main>", "<article><h1>keep a title</h1></article>",
    f"<article><h1>keep</h1><p>keep it</p></article><article><p>keep that<p>{_LONG}</article>",
    f"<nav><ul>{_MENU}</ul></nav><article><p>keep alone</article>", f"<nav><ul>{_MENU}</ul></nav><article><p>{_LONG}</article>", f"<nav><ul>{_MENU}</ul></nav><article><h1>keep</h1><p><a href=/n>keep a link</a><p>keep last</article>",
    f"<nav><ul>{_MENU}</ul></nav><article><p><a href=/n>keep a link of some words</a></article><div class=ad>drop buy</div>", f"<article><p>{_LONG}<p><a href=/n>keep it</a><p>keep the last one</article>",
    f"<body class='has-sidebar'><div class='layout no-ads'><article class='post share'><h1>keep title</h1><p>{_LONG}<p>keep short<div class=share>drop send it on</div></article></div><div class=sidebar><p>{_OTHER}</div></body>",
    f"<div class=commentlist><p>{_OTHER}<p>drop nice</div><div><h2>keep the title</h2><p>{_LONG}<p>{_LONG} {_LONG}</div><div class=side-bar><p>{_OTHER}</div>",
    f"<div id=cookiebar><p>{_OTHER}</div><div class=social-science><h1>keep title</h1><p>{_LONG}<p>keep short</p><p>{_LONG}</div><div class=pageFooter>drop all rights</div>",
    f"<article><p>{_LONG}<blockquote>keep a quote</blockquote><p>{_LONG}<ul class=share-links><li><a href=/s>drop send</a><li><a href=/t>drop post</a></ul></article><section class=comment-thread><p>{_OTHER}<p>{_OTHER}</section>",
    f"<div><a href=/>drop home</a> <a href=/n>drop news</a></div><div><p>{_LONG}<p>{_LONG}<p>{_LONG}</div><div><a href=/p>drop previous</a></div><div>drop terms</div><div><a href=/c>drop contact us</a></div>",
    f"<article><header><h1>keep title</h1><p>keep by the writer</header><p>{_LONG}<footer>drop filed under news</footer></article><div role=complementary><p>{_OTHER}</div>",
    f"<div class=header>drop top line of it</div><article><h2>keep second</h2><p>keep tiny<p>keep tiny too</article><div class=related><a href=/r>drop read this</a><p>{_OTHER}</div>",
)


#: More of it: pages whose elements have no names, so that words and links of a block and its neighbours tell.
_MID = "keep a block of some ten words or so in it"
_LINE = "drop a line of few words"
LABELLED += (
    f"<div>{_LINE}</div><div><a href=/a>drop one</a> <a href=/b>drop two</a></div><div><p>{_LONG}<p>{_MID}<p>{_LONG} {_LONG}</div><div><a href=/c>drop three</a></div><div>{_LINE}</div>",
    f"<div><a href=/a>drop one more</a></div><div>{_LINE}</div><div><a href=/b>drop two more</a></div><div><p>{_LONG} {_LONG}<p>{_LONG}</div>",
    f"<div>drop menu</div><div>drop search</div><p>{_LONG}</p><p>keep two words</p><p>{_LONG}</p><p>{_MID}</p><p>{_LONG}</p><div>drop top of page</div><div><a href=/t>drop top</a></div>",
    f"<div><a href=/x>drop a longer link to another story of this paper which is told at some length there</a></div><div><a href=/y>drop and a further one of as many words about quite another thing that took place</a></div><p>{_LONG}</p><p>{_LONG}</p>",
    f"<p>{_LONG}</p><p>{_MID}</p><p>{_LONG}</p><div>{_LINE}</div><div><a href=/u>drop next story</a></div><div>{_LINE}</div><div><a href=/v>drop last story</a></div>",
    f"<div>{_LINE} <a href=/q>drop more of it here</a></div><div><h1>keep a heading over it</h1><p>{_MID}<p>{_LONG}<p>{_MID} {_MID}<p>{_LONG}</div><div>{_LINE} <a href=/r>drop all of them there</a></div>",
    f"<div>drop en</div><div>drop de</div><div>drop fr</div><div><p>{_LONG} {_LONG} {_LONG}</div><div>drop imprint</div><div>drop privacy</div>",
    f"<table><tr><td><a href=/1>drop one</a></td><td><a href=/2>drop two</a></td></tr></table><p>{_LONG}</p><ul><li>keep a point of the list</li><li>keep another point of it</li></ul><p>{_LONG}</p>",
    f"<form><div>drop search here</div><h1>keep heading</h1><p>{_LONG}<p>{_LONG}<p>{_MID}<p>{_LONG}</form>",
    f"<article><p>{_LONG}</article><article class=comment-body><p>{_OTHER}</article><article class=comment><p>drop short</article>",
)


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = [(Vectors.dense(x), float(b[0].startswith("keep"))) for found in map(blocks, LABELLED) for b, x in zip(found, features(found))]
    return spark.createDataFrame(rows, ["features", "label"])


def tree_column(spark: SparkSession, block: Column) -> Column:
    """Whether a block (a struct with FEATURES) is main text, by a tree fitted on the labelled table."""
    model = DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=1, maxBins=64, seed=1).fit(labelled_table(spark).coalesce(1))

    def walk(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(node.prediction() == 1.0)
        split = node.split()
        left = block[FEATURES[split.featureIndex()]] <= float(split.threshold())
        return F.when(left, walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return walk(model._call_java("rootNode"))


BLOCK_TYPE = pa.list_(pa.struct([("text", pa.string()), *((name, pa.float64()) for name in FEATURES)]))


def cut_blocks(pages: DataFrame, column: str = "html", name: str = "blocks") -> DataFrame:
    """pages with the column `name`, an array of structs of text and FEATURES, in place of the html column."""
    place, rest = pages.columns.index(column), [c for c in pages.columns if c not in (column, name)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cut_pages = [blocks(page.as_py()) for page in part.column(place)]
                texts = [b[0] for found in cut_pages for b in found]
                numbers = list(zip(*(x for found in cut_pages for x in features(found)))) or [()] * len(FEATURES)
                offsets = [0]
                for found in cut_pages:
                    offsets.append(offsets[-1] + len(found))
                values = pa.StructArray.from_arrays([pa.array(texts, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)], fields=list(BLOCK_TYPE.value_type))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=[*rest, name])

    ddl = f"`{name}` array<struct<text:string," + ",".join(f"{x}:double" for x in FEATURES) + ">>"
    return pages.mapInArrow(cut, StructType([pages.schema[c] for c in rest] + StructType.fromDDL(ddl).fields))


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text, the kept blocks in page order joined by line ends, in place of the html column.

    Null and empty pages have empty text, as have pages of which no block is
    kept. Character references are decoded once and white space in a block
    becomes one space. A page is read whole; unclosed comments and
    scripts end with it, other skipped elements with their parent. Other columns stay; one named text is replaced.
    """
    spark, name = pages.sparkSession, "_blocks"
    while name in pages.columns:
        name = f"_{name}"
    kept = F.filter(name, lambda b: tree_column(spark, b))
    return cut_blocks(pages.drop("text"), column, name).withColumn("text", F.array_join(F.transform(kept, lambda b: b["text"]), "\n")).drop(name)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
