"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. The first pass labels each block from its length, link density and
stop-word density, and from where it stands (menus, headers, footers, asides, forms, adverts, notices and
reader comments are bad; inside an article or main element only these are). Roles, hidden elements and names that
are wholly those of adverts, notices or reader comments condemn what stands in them; other words of class and id
do so only if most of the text there fails the density rules, and never for html, body, main or article (but an
article named a comment after another article is one). Blocks too short to judge stay
ambiguous; the second pass gives them the label of the nearest decided block, within the article if they stand
in one. The good blocks in page order are the text.

A page with hardly any stop word is in another language: there length and links alone decide. In an article links
speak against lists and short blocks without a tag of their own only.

Defined results: a null or empty html gives an empty text; so does a page without a good block; a comment or script
that is never closed ends with the page, a button with the next block, other elements hold nothing, and an unclosed
container ends where an article begins; equal pages give equal
texts; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the supported languages.
STOP_WORDS = frozenset(
    # English
    "the of and to in is that it for as was with be by on not he his but at are this have from or had an they which "
    "one you were all her she there would their we him been has when who will no more if out so a i "
    # French
    "le la les de des du un une et est en que qui dans pour par sur pas au aux avec ce se il elle ne plus ou son sa "
    "ses nous vous ils cette mais "
    # German
    "der die das und den dem des ein eine einer von zu zur im in mit auf für ist nicht sich auch als an es er sie "
    "wird bei aus dass nach wie oder aber "
    # Spanish
    "el los las y del al con por para una uno como más pero sus lo le se su es no ya o si ".split()
)

#: Elements whose content is never text. Those of the first kind end with their end tag or the page; those of the second
#: with their end tag, and where there is none they hold nothing; those of the third also with the next block.
RAW_TEXT = frozenset("script style iframe title textarea".split())
RAW_PARTS = frozenset("noscript template svg canvas object".split())
RAW_INLINE = frozenset("select button".split())
#: Elements that hold other blocks.
CONTAINERS = frozenset("div section article main nav header footer aside form ul ol dl table tbody tr body html figure details dialog fieldset blockquote".split())
#: Elements that start a block.
BLOCKS = CONTAINERS | frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th pre address figcaption hr center summary caption legend".split())
BAD_ELEMENTS = frozenset("nav footer aside form dialog fieldset menu".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id attributes that mark what isn't the article.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "alert popup modal overlay sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "topbar toolbar share sharing social related recommended widget newsletter subscribe signup login search pagination "
    "pager tags comment comments disqus replies reply respond".split()
)
COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
#: Those that need no look at the text, if a whole token is made of them, other bad names and names of mere parts.
HARD_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr newsletter subscribe signup login".split()
)
PART_NAMES = frozenset("area bar block body box container content count form group holder inner item list outer panel section slot thread title unit wrap wrapper".split())
#: Elements that hold the article or the page, whatever their class and id.
OUTER = frozenset("html body main article".split())

# A name ends at white space, a slash or the tag's end: <title-card> is no <title>. A tag without its end stops before
# the next one, so no part of a page is read more than a few times.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+)>?|<[!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
# A name with its value, so that no value is read as a name; or a stray quoted string.
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW_TEXT | RAW_PARTS}
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_WHITE = re.compile(r"\s+")


@dataclass(frozen=True)
class Rules:
    short: int = 70  # characters below which a block isn't judged by its words
    long: int = 200
    links: float = 0.4  # share of characters in links from which a block is bad
    stop_low: float = 0.15
    stop_high: float = 0.25
    stop_none: float = 0.03


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    article: int  # 0: outside; else the article's number
    bad: bool  # by its place
    soft: int  # the innermost element above whose names its text may refute; 0: none
    tag: str = ""  # of a block that holds no others
    label: str = ""


def names_of(attrs: str, ids: bool = True) -> tuple[bool, bool, bool, bool]:
    """Whether attributes mark a bad element by role or hiding, by hard names, one of reader comments, and by names
    that its text may refute. Without `ids` only classes are names."""
    found: dict[str, str] = {}
    for key, a, b, c in _ATTR.findall(attrs):
        found.setdefault(key.lower(), (a or b or c).lower())
    bad = "hidden" in found or found.get("aria-hidden") == "true" or not BAD_ROLES.isdisjoint(found.get("role", "").split())
    hard = comment = soft = False
    for token in found.get("class", "").split() + (found.get("id", "").split() if ids else []):
        words = set(_NAME.findall(token))
        if words.isdisjoint(BAD_NAMES):
            continue
        if words <= BAD_NAMES | PART_NAMES and not words.isdisjoint(HARD_NAMES):
            hard = True
            comment |= not words.isdisjoint(COMMENT_NAMES)
        else:
            soft = True
    return bad, hard, comment, soft


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """Blocks in page order, and of each soft element the next soft one above it."""
    out: list[Block] = []
    above: list[int] = [0]
    stack: list[tuple[str, bool, bool, int, int]] = []  # tag, bad, comment, article, soft
    open_: Counter[str] = Counter()  # containers of the stack
    parts: list[str] = []
    linked = links = articles = 0
    leaf_bad = leaf_heading = False
    leaf_soft = 0
    leaf_tag = skipped = ""  # skipped: the open element of RAW_INLINE
    unended: set[str] = set()  # elements of which the rest of the page has no end tag

    def state() -> tuple[bool, int, int]:
        return (stack[-1][1], stack[-1][3], stack[-1][4]) if stack else (False, 0, 0)

    def close() -> None:
        nonlocal linked
        if parts:
            text = _WHITE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                bad, article, soft = state()
                out.append(Block(text, linked, leaf_heading, article, (bad and not (leaf_heading and article and stack[-1][0] == "header")) or leaf_bad, leaf_soft or soft, leaf_tag))
            parts.clear()
        linked = 0

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at and not skipped:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _RAW_ENDS and not m["end"] and tag not in unended and not m[0].endswith("/>"):
            if end := _RAW_ENDS[tag].search(page, at):
                at = end.end()
            elif tag in RAW_TEXT:
                at = len(page)
            else:
                unended.add(tag)
            continue
        if tag in RAW_INLINE:
            skipped = "" if m["end"] or m[0].endswith("/>") else tag
            continue
        if tag == "a":
            links = max(0, links + (-1 if m["end"] else 1))
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        close()
        skipped = ""
        links, leaf_bad, leaf_heading, leaf_soft, leaf_tag = 0, False, False, 0, ""
        if m["end"]:
            if open_[tag]:
                last = ""
                while last != tag:
                    last = stack.pop()[0]
                    open_[last] -= 1
            continue
        # The id of a heading, or of a section of an article, is an anchor.
        ids = tag not in HEADINGS and not (tag == "section" and state()[1])
        bad, hard, comment, soft = names_of(m["attrs"], ids) if m["attrs"] else (False, False, False, False)
        if tag in OUTER:
            hard = comment = comment and tag == "article" and articles > 0
            soft = False
        above_bad, article, within = state()
        if tag in CONTAINERS:
            above_comment = bool(stack) and stack[-1][2]
            if tag in ("article", "main"):
                if not article:
                    articles += 1
                    article = articles
                above_bad = above_comment
                within = 0
            bad |= hard or tag in BAD_ELEMENTS or tag == "header"
            if soft:
                above.append(within)
                within = len(above) - 1
            stack.append((tag, bad or above_bad, comment or above_comment, article, within))
            open_[tag] += 1
        else:
            leaf_bad, leaf_heading, leaf_tag = bad or hard, tag in HEADINGS, tag
            if soft and not leaf_heading:
                above.append(within)
                leaf_soft = len(above) - 1
    if at < len(page) and not skipped:
        parts.append(page[at:])
    close()
    return out, above


def stopped_of(text: str) -> tuple[int, int]:
    """Stop words, and all words."""
    words = _WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)), len(words)


def stops(text: str) -> float:
    k, n = stopped_of(text)
    return k / max(1, n)


def condemn(blocks: list[Block], above: list[int], rules: Rules) -> None:
    """Marks the blocks of soft elements bad, but for elements with at least half their text outside links in blocks
    that pass the density rules (and outside articles more than a long block's worth)."""
    if len(above) == 1:
        return
    passed, whole, apart = [0] * len(above), [0] * len(above), [0] * len(above)
    for b in blocks:
        if b.soft and not b.bad:
            n = len(b.text)
            whole[b.soft] += max(0, n - b.linked)
            apart[b.soft] |= not b.article
            if not b.heading and n >= rules.short and b.linked <= rules.links * n:
                passed[b.soft] += n if stops(b.text) >= (rules.stop_low if b.article else rules.stop_high) else 0
    keeps = [True] * len(above)
    for i in range(len(above) - 1, 0, -1):  # those within come after those around them
        keeps[i] = passed[i] > (rules.long if apart[i] else 0) and 2 * passed[i] >= whole[i]
        if keeps[i] and above[i]:
            for sums in (passed, whole):
                sums[above[i]] += sums[i]
            apart[above[i]] |= apart[i]
    for i in range(1, len(above)):
        keeps[i] &= keeps[above[i]]
    for b in blocks:
        b.bad |= not keeps[b.soft]


#: Blocks of an article whose links don't speak against them.
PROSE = HEADINGS | {"p", "blockquote", "pre", "figcaption", "caption"}
_DENSE = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def strange(blocks: list[Block], stopped: list[tuple[int, int]], rules: Rules) -> bool:
    """Whether a page's running text has hardly any stop word: it is in none of the supported languages."""
    stop = words = 0
    for b, (k, n) in zip(blocks, stopped, strict=True):
        if not b.bad and b.linked <= rules.links * len(b.text):
            stop, words = stop + k, words + n
    return words > 0 and stop < rules.stop_none * words


def first_pass(blocks: list[Block], rules: Rules) -> None:
    within = any(b.article and not b.bad for b in blocks)
    # Where stop words can't tell, length and links do; a letter of a script without spaces stands for three.
    stopped = [(0, 0) if b.bad or (within and not b.article) else stopped_of(b.text) for b in blocks]
    foreign = strange(blocks, stopped, rules)
    for b, (k, words) in zip(blocks, stopped, strict=True):
        n = len(b.text)
        density = b.linked / n
        linked = density > rules.links and not (b.article and (b.tag in PROSE or (n >= rules.long and b.tag != "li")))
        if b.bad or (within and not b.article) or linked or (not b.article and n < rules.long and b.text.startswith("©")):
            b.label = "bad"
            continue
        stop = k / max(1, words)
        if foreign:
            stop, n = rules.stop_high, n + 2 * len(_DENSE.findall(b.text))
        if b.article:
            b.label = "good" if stop >= rules.stop_low and n >= rules.short else "ambiguous"
        elif n < rules.short or b.heading:
            b.label = "bad" if density > 0 else "ambiguous"
        elif stop >= rules.stop_high:
            b.label = "good" if n > rules.long else "ambiguous"
        else:
            b.label = "ambiguous" if stop >= rules.stop_low else "bad"


def second_pass(blocks: list[Block]) -> list[str]:
    """Labels after ambiguous blocks have taken that of the nearest decided one; of two as near, good wins next to
    an article's other blocks. A block of an article looks within it only, and is good if nothing there is decided."""
    n = len(blocks)
    before, after = [None] * n, [None] * n
    for order, found in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            group = blocks[i].article
            found[i] = last.get(group)
            if blocks[i].label != "ambiguous" and not (group and blocks[i].label == "bad"):
                last[group] = i
    out = []
    for i, b in enumerate(blocks):
        if b.label != "ambiguous":
            out.append(b.label)
            continue
        near = [(abs(i - j), blocks[j].label != "good", blocks[j].label) for j in (before[i], after[i]) if j is not None]
        if b.article:
            out.append(min(near)[2] if near else "good")
        elif not near:
            out.append("good" if len(b.text) >= 70 else "bad")
        else:
            far_good = min(near)
            tie = len(near) == 2 and near[0][0] == near[1][0] and near[0][2] != near[1][2]
            out.append("bad" if tie and not b.heading else far_good[2])
    return out


def main_text(page: str, rules: Rules = Rules()) -> str:
    if not page:
        return ""
    blocks, above = blocks_of(page)
    condemn(blocks, above, rules)
    first_pass(blocks, rules)
    return " ".join(b.text for b, label in zip(blocks, second_pass(blocks), strict=True) if label == "good")


def extract(pages: DataFrame, rules: Rules = Rules(), carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `carry`, text and n_chars. One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p or "", rules) for p in b.column("_html").to_pylist()]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(texts, pa.string()), n], [*carry, "text", "n_chars"])

    source = pages.select(*carry, F.col("html").alias("_html"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{ddl}, text string, n_chars long")
