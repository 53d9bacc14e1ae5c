"""Main text of HTML pages by two-pass block rules.

A page is read once as tags and text.  Raw-text elements, comments and the head are
skipped; containers that by name, role, class or id are menus, headers, footers,
sidebars, notices, adverts, forms or reader comments yield no blocks, wherever they stand.
A container with a doubtful class is overruled by the blocks: if it holds most of the
page's readable text, it is the page.  The first pass judges each block by stop-word
density, length and link density (inside <article> or <main> with more favour).  In the
second pass undecided short blocks take the label of their nearest decided neighbours.

Defined cases: null, empty and markup-only pages give an empty text; an unclosed
element ends where a block that cannot be inside it begins, or with the page, an unclosed
menu at <article> or <main>; broken markup is read as text from a '<' that opens no tag;
repeated pages are read each; a tie of neighbours goes to the one before; very long pages
are read whole, one row at a time; further columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements whose content is no text of the page.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|title|select|audio|video|map"
# Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog button head".split())
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog menu menubar form alert".split())
#: Words of a class or id that a container with most of the text may have.
DOUBTFUL_WORDS = frozenset("sidebar side-bar header masthead banner search related social share sharing toolbar widget menu nav navigation notice notices alert overlay promo promotion sponsor sponsored form skip login register signup subscribe subscription breadcrumb breadcrumbs pagination pager footer".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register comment comments comment-list respond replies disqus "
    "share sharing social related recommended widget toolbar search skip form disclaimer".split()
)
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their if do will each about how up out them then she many some so these would other into has more her two him see could no make than been its now my did get come may "
    "der die das und ist in zu den von mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde "
    "le la les de des du et en un une est que qui dans pour pas au sur avec par plus ce il elle ne se sont ou mais son sa ses aux nous vous leur cette été être ont "
    "el los las del y que en un una por con no su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde".split()
)

_RAW = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
# Frequent function characters of Chinese and Japanese.
STOP_CHARACTERS = frozenset("的了是在不和有我他这中为们个也就要说到一のはをにがでともし")
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff]")

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.2
LINK_MOST = 0.33
GOOD, NEAR, SHORT, BAD = "good", "near", "short", "bad"


NO, MAYBE, YES = 0, 1, 2


def _is_noise(tag: str, attributes: str, in_article: bool) -> int:
    """Whether a container holds no text of the page: by its name, role, hiding or class; MAYBE by a doubtful class."""
    if tag in NOISE_TAGS or (tag == "header" and not in_article):
        return YES
    if not attributes or tag in ("html", "body", "main"):
        return NO
    found = NO
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _NONE.search(value)):
            return YES
        if name == "role" and NOISE_ROLES.intersection(value.split()):
            return YES
        if name in ("class", "id"):
            for word in value.split():
                if word in NOISE_WORDS:
                    parts = {word}
                elif word.startswith(("has-", "with-", "no-")):
                    continue
                else:
                    parts = NOISE_WORDS.intersection(re.split(r"[-_]+", word))
                if parts:
                    found = max(found, MAYBE if parts <= DOUBTFUL_WORDS else YES)
    return found


def blocks(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, heading, inside the article) of each block outside noise containers."""
    out: list[tuple[str, int, bool, bool, int]] = []
    text: list[str] = []
    linked = [0]
    skip: list[str] = []  # open noise element, and elements of the same name inside it
    doubt: list[tuple[str, int]] = []  # open doubtful container and its number, and elements of the same name inside it
    state = {"a": 0, "article": 0, "heading": False, "br": False, "doubts": 0}
    page = _RAW.sub(" ", page)
    low = page.lower()

    def end() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append((whole, linked[0], state["heading"], state["article"] > 0, doubt[0][1] if doubt else 0))
            text.clear()
        linked[0] = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not skip:
            piece = page[at : m.start()]
            text.append(piece)
            if not piece.isspace():
                state["br"] = False
            if state["a"]:
                linked[0] += len(piece.strip())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        attributes = m[3] or m[6] or ""
        whole = tag in ("article", "main")
        if skip:
            if tag == "body" or (whole and not closing and low.find(f"</{skip[0]}", at) < 0) or (skip[0] == "p" and tag in BLOCKS and not (tag == "p" and closing)):
                skip.clear()
            elif tag == skip[0]:
                if closing:
                    skip.pop()
                elif not attributes.endswith("/"):
                    skip.append(tag)
                continue
            else:
                continue
        noise = NO if closing or tag in VOID else _is_noise(tag, attributes, state["article"] > 0)
        if noise == YES:
            if tag in BLOCKS or tag == "button":
                end()
            if not attributes.endswith("/"):
                skip.append(tag)
            continue
        if tag in BLOCKS:
            end()
            state["a"] = 0
            state["heading"] = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() and not closing
        elif tag == "br":
            if state["br"]:
                end()
            text.append(" ")
            state["br"] = True
        elif tag == "a":
            state["a"] = 0 if closing else 1
        if whole:
            state["article"] = max(0, state["article"] + (-1 if closing else 1))
        if doubt and tag == "p" == doubt[0][0] and not closing:
            doubt.clear()
        if doubt and tag == doubt[0][0]:
            if closing:
                doubt.pop()
            elif tag not in VOID:
                doubt.append((tag, doubt[0][1]))
        elif not doubt and noise == MAYBE:
            end()
            state["doubts"] += 1
            doubt.append((tag, state["doubts"]))
    if at < len(page) and not skip:
        text.append(page[at:])
        if state["a"]:
            linked[0] += len(page[at:].strip())
    end()
    # a doubtful container with most of the readable text is none
    readable: dict[int, int] = {}
    for block, links, _, _, number in out:
        if len(block) >= LENGTH_LOW and links <= LINK_MOST * len(block):
            readable[number] = readable.get(number, 0) + len(block)
    return [b[:4] for b in out if not b[4] or 2 * readable.get(b[4], 0) > sum(readable.values())]


def _stop_density(text: str) -> float:
    """Share of function words; in text without spaces between words, four times that of function characters."""
    wide = len(_WIDE.findall(text))
    if 3 * wide > len(text):
        return 4 * sum(c in STOP_CHARACTERS for c in text) / len(text)
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()*#$%&") in STOP_WORDS for w in words) / len(words)


def _first_pass(text: str, linked: int, heading: bool, in_article: bool) -> str:
    density = linked / len(text)
    if density > (0.5 if in_article else LINK_MOST) or ("©" in text and not in_article):
        return BAD
    if len(text) < LENGTH_LOW:
        return SHORT if linked == 0 or in_article else BAD
    stop = _stop_density(text)
    if in_article:
        return GOOD if stop >= STOP_LOW else NEAR
    if stop >= STOP_HIGH:
        return GOOD if len(text) > LENGTH_HIGH else NEAR
    return NEAR if stop >= STOP_LOW else BAD


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    labels = [_first_pass(*b) for b in found]
    # a short heading close above good text belongs to it
    for i, (_, _, heading, _) in enumerate(found):
        if heading and labels[i] == SHORT:
            far = 0
            for j in range(i + 1, len(found)):
                if labels[j] == GOOD:
                    labels[i] = GOOD
                far += len(found[j][0])
                if labels[j] != SHORT or far > LENGTH_HIGH:
                    break
    first = list(labels)

    def sweep(backwards: bool, skip_near: bool) -> list[str]:
        """The nearest decided label before (or after) each block; beyond the ends there is only chrome."""
        near, out = BAD, []
        for label in reversed(first) if backwards else first:
            out.append(near)
            if label in (GOOD, BAD) or (label == NEAR and not skip_near):
                near = label
        return out[::-1] if backwards else out

    sweeps = {(step, skip): sweep(step > 0, skip) for step in (-1, 1) for skip in (False, True)}

    def neighbour(i: int, step: int, skip_near: bool) -> str:
        return sweeps[step, skip_near][i]

    bad, good = BAD in first, GOOD in first
    for i, label in enumerate(first):
        if label == SHORT and found[i][3]:
            # inside the article only links on both sides speak against a short block
            labels[i] = BAD if neighbour(i, -1, False) == neighbour(i, 1, False) == BAD and bad else GOOD
        elif label == SHORT:
            both = {neighbour(i, -1, True), neighbour(i, 1, True)}
            near = NEAR in (neighbour(i, -1, False), neighbour(i, 1, False))
            labels[i] = GOOD if both == {GOOD} or (len(both) == 2 and near) else BAD
        elif label == NEAR:
            labels[i] = BAD if {neighbour(i, -1, True), neighbour(i, 1, True)} == {BAD} and len(found) > 1 and good else GOOD
    return "\n\n".join(b[0] for b, label in zip(found, labels, strict=True) if label == GOOD)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row of pages(page_id, url, html)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                texts = [main_text(h) for h in rows.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", column).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
