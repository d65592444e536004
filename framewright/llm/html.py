"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides blocks on their own, by stop-word density, length and link
density, with the containers around them as evidence: blocks made of links are out, and so are those in containers that
say they hold menus, headers, footers, sidebars, notices, adverts, forms or comments; long blocks with stop words are in.
Short blocks and those between stay ambiguous, and pass two gives each the label of its nearest decided neighbours, where
the edge of a container counts as STRIDE blocks more.

An article element is evidence, too: inside one its edges count as decided main text and boilerplate containers are no
neighbours; outside of it, on a page that has one, only the strictest rule makes main text and undecided ends are out.
Evidence of a weak kind, such as a form around the whole page, is dropped if the page would have no main text otherwise.

A null html counts as empty and an empty page has empty text. Unclosed tags, comments and entities at the end of a cut
page are read as browsers do. The work is linear in the page's length; nothing is capped. A tie between neighbours goes
to main text within one container and out otherwise. Repeated rows get equal results, extra columns stay, but for one
named like the result, which raises an error, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import bounded_batches, fresh_columns, table

# Thresholds of the rules, in characters and shares, and how many blocks a container's edge counts as.
LENGTH_SHORT, LENGTH_LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
MAX_LINKS = 0.33
STRIDE = 3

# Stop words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about all an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which who will with you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die ein eine einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von war werden wie wir zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas pour que qui sa se ses son sont sur un une vous "
    "al como con de del desde el ella en entre era es está esta este fue ha hay la las le les lo los más me mi muy no nos o para pero por que qué se si sin sobre su sus también un una y ya".split()
)
# Elements that begin and end a block, and those of them that hold others.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
GROUP_TAGS = BLOCK_TAGS - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr summary figcaption address title".split())
# Elements whose text is never shown as text (the first ones swallow the rest without an end tag), and elements
# without an end tag.
RAW_TAGS = frozenset("script style textarea title xmp".split())
UNSEEN_TAGS = frozenset("noscript template iframe noframes noembed svg math object select datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that hold boilerplate, and last words of a class, id or role that say so.
STRONG_TAGS = frozenset("nav footer menu head".split())
WEAK_TAGS = frozenset("header aside form dialog button fieldset".split())
STRONG_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disqus footer contentinfo menu nav navbar navigation "
    "newsletter pagination popup promo promos promoted promotion promotions replies reply respond sidebar sidebars sponsor sponsors sponsored tagcloud toolbar gdpr".split()
)
WEAK_WORDS = frozenset("alert banner disclaimer form header login masthead modal notice notices notification notifications related search share sharing signup social subscribe subscription widget widgets complementary".split())
# Words behind the one that counts, and words in front that make it say something else.
TRAILING_WORDS = frozenset(
    "area aside bar block body bottom box button buttons container content form footer group header inner item items left links list message nav outer panel parent children posts articles right row section slot space text thread title top unit widget wrap wrapper zone".split()
)
STATE_WORDS = frozenset("has have no not non with without is hide hides show shows toggle js".split())
TITLE_WORDS = frozenset("article content entry main page post story".split())
ARTICLE_WORDS = frozenset("article main".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_WORD_BREAK = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_NO_LETTERS = re.compile(r"[^\w]+|[\d_]+")

#: What the containers around a block say.
NOTHING, ARTICLE, WEAK, STRONG = range(4)


class Block(NamedTuple):
    text: str
    link_chars: int  # characters inside links
    evidence: int  # NOTHING, ARTICLE, WEAK or STRONG
    article: int  # number of the article around, or 0
    group: int  # number of the container around


def name_says(name: str) -> int:
    """What one word of a class or id says about its element: only the word that the others describe counts, so
    ``post-comments`` and ``comment-list`` are about comments, ``has-comments`` and ``related-work`` aren't."""
    words = [w.lower() for w in _WORD_BREAK.split(name) if w]
    if not words or words[0] in STATE_WORDS:
        return NOTHING
    while len(words) > 1 and words[-1] in TRAILING_WORDS and words[-2] not in TITLE_WORDS:
        words.pop()
    last = words[-1]
    if last == "header" and len(words) > 1 and words[-2] in TITLE_WORDS:
        return NOTHING
    return STRONG if last in STRONG_WORDS else WEAK if last in WEAK_WORDS else NOTHING


def _element(tag: str, attributes: str, article: int) -> tuple[int, bool]:
    """What an element says of what it holds, and whether it says that it is an article."""
    says = STRONG if tag in STRONG_TAGS else WEAK if tag in WEAK_TAGS and not (tag == "header" and article) else NOTHING
    opens = tag in ARTICLE_WORDS
    for a in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NONE.search(value):
            says = STRONG
        elif name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            says = max([says, *map(name_says, value.split())])
            opens = opens or tag in ("div", "section") and not ARTICLE_WORDS.isdisjoint(value.lower().split())
    return says, opens


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int, int]] = []  # tag, evidence so far, article, links around, group
    opened: dict[str, int] = {}
    parts: list[str] = []
    evidence, article, links, group, articles, groups, link_chars, breaks = NOTHING, 0, 0, 0, 0, 0, 0, 0

    def close() -> None:
        nonlocal parts, link_chars, breaks
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, link_chars, evidence, article, group))
        parts, link_chars, breaks = [], 0, 0

    def drop(depth: int) -> None:
        for name, *_ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        raw = m[0]
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if raw[0] != "<" or raw == "<":
                text = unescape(raw)
                parts.append(text)
                if links:
                    link_chars += len(_SPACE.sub(" ", text))
                if not text.isspace():
                    breaks = 0
            continue
        if raw[-1] != ">" and at == end:
            break  # the page was cut inside a tag
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if (tag in RAW_TAGS or tag in UNSEEN_TAGS) and not closing:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else end if tag in RAW_TAGS else at
            if tag == "title":
                close()
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                close()
            else:
                parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
        if tag in VOID_TAGS:
            continue
        if closing:
            for depth in range(len(stack) - 1, -1, -1) if opened.get(tag) else ():
                if stack[depth][0] == tag:
                    drop(depth)
                    break
                if tag not in BLOCK_TAGS and stack[depth][0] in BLOCK_TAGS:
                    break  # an inline end tag closes nothing outside its block
        else:
            ends = "p" if tag in BLOCK_TAGS and opened.get("p") else ""
            for depth in range(len(stack) - 1, -1, -1) if ends else ():
                if stack[depth][0] == ends:
                    drop(depth)  # a paragraph ends where a block begins
                    break
                if stack[depth][0] in BLOCK_TAGS:
                    break
            if tag in ("li", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                drop(len(stack) - 1)
            above, number, around, inside = stack[-1][1:] if stack else (NOTHING, 0, 0, 0)
            says, opens = _element(tag, attributes, number)
            if opens and not number and max(above, says) < WEAK:
                articles += 1
                number, says = articles, ARTICLE
            if tag in GROUP_TAGS:
                groups += 1
                inside = groups
            stack.append((tag, max(above, says), number, around + (tag == "a"), inside))
            opened[tag] = opened.get(tag, 0) + 1
        evidence, article, links, group = stack[-1][1:] if stack else (NOTHING, 0, 0, 0)
    close()
    return out


def _is_stop_word(word: str) -> bool:
    word = word.lower()
    return word in STOP_WORDS or _NO_LETTERS.sub("", word) in STOP_WORDS


def decide(block: Block, has_article: bool = False, weak: bool = True) -> tuple[bool | None, str]:
    """Pass one: True is main text, False is not, None is left to the neighbours; and the rule that says so."""
    if block.evidence == STRONG or weak and block.evidence == WEAK:
        return False, "container"
    if block.link_chars > MAX_LINKS * len(block.text):
        return False, "links"
    if len(block.text) < LENGTH_SHORT:
        return None, "short"
    words = block.text.split()
    stop = sum(map(_is_stop_word, words))
    if stop >= STOP_HIGH * len(words) and len(block.text) >= LENGTH_LONG:
        return True, "long text"
    if stop >= STOP_LOW * len(words) and (block.article or not has_article):
        return True, "text"
    return None, "few stop words"


def label_blocks(blocks: list[Block], rules: Counter | None = None) -> list[bool]:
    """Pass two: ambiguous blocks take the label of the nearest decided ones in their part, an article or all else."""
    has_article = any(b.article for b in blocks)
    decided = [decide(b, has_article) for b in blocks]
    if not any(d[0] for d in decided) and not any(b.article for b in blocks):
        decided = [decide(b, has_article, weak=False) for b in blocks]
    out = [False] * len(blocks)
    where, place = [], 0  # blocks counted with STRIDE for each container's edge
    for i, b in enumerate(blocks):
        place += 1 + STRIDE * (i > 0 and b.group != blocks[i - 1].group)
        where.append(place)
    parts: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        parts.setdefault(b.article, []).append(i)
    for article, part in parts.items():
        edge = True if article else False if has_article else None
        heard = [i for i in part if decided[i][0] is not None and not (article and blocks[i].evidence >= WEAK)]
        k = 0
        for i in part:
            out[i], rule = decided[i][0], decided[i][1]
            while k < len(heard) and heard[k] <= i:
                k += 1
            if out[i] is None:
                before = (decided[heard[k - 1]][0], where[i] - where[heard[k - 1]]) if k else (edge, where[i] - where[part[0]] + 1)
                after = (decided[heard[k]][0], where[heard[k]] - where[i]) if k < len(heard) else (edge, where[part[-1]] - where[i] + 1)
                near = sorted((x for x in (before, after) if x[0] is not None), key=lambda x: x[1])
                if not near:
                    out[i] = True  # the page has nothing that says otherwise
                elif len(near) == 1 or near[0][0] == near[1][0] or near[0][1] < near[1][1]:
                    out[i] = near[0][0]
                else:
                    out[i] = min(where[i] - where[i - 1] if i else 9, where[i + 1] - where[i] if i + 1 < len(blocks) else 9) == 1
                rule = f"{rule}, then neighbours"
            if rules is not None:
                rules[rule, out[i]] += 1
    return out


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, main in zip(blocks, label_blocks(blocks), strict=True) if main)


def extract(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the column ``to``, the main text of each."""
    bounded_batches(pages.sparkSession)
    fresh_columns(pages, to)

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        return pa.array([main_text(v) for v in values.to_pylist()], pa.string())

    return pages.withColumn(to, text.asNondeterministic()(html))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
SQL: dict[str, str] = {}
