"""Web pages: title, main block, plain body text, and trimming of page chrome from text lines."""

from __future__ import annotations

import collections
import dataclasses
import html.parser
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements and class or id tokens that are no content.
NOISE_TAGS = frozenset("script style nav footer header aside form noscript iframe".split())
NOISE_TOKENS = frozenset("ad ads advert sidebar menu nav navbar footer header comment comments share related promo banner cookie popup".split())
# Parts of class and id texts that are no content, classes of article bodies that always are,
# and tokens beside which "sidebar" only names a layout.
NOISE_PARTS = ("advertisement", "accessibility", "lang-switch", "language-switch", "skip-link", "site-nav", "global-nav", "qr-code")
BODY_HINTS = ("entry-content", "post-content", "article-content", "article-body", "post-body", "single-content", "blog-post")
LAYOUT = frozenset(("has", "with", "row"))
# Lines of page chrome, first lines that are menus, and lines after which nothing of the article follows.
CHROME = re.compile("^(跳到内容|跳到导航|跳到页脚|无障碍设置|无障碍|浅色主题|深色主题|高对比度|文字大小|行距|段距|下划线链接|减弱动画|易读字体|大光标|重置|订阅邮件|保持关注|填写\\s*表单|隐私政策|条款|OK|×|news|ZH|IT|EN|FR|ES|DE|TR|RU|PT|JA)$", re.IGNORECASE)
MENU = frozenset(("首页", "关于", "简历", "博客", "工具", "联系方式", "广告"))
ENDINGS = ("相关文章", "订阅邮件", "保持关注", "在寻找计算机工程师", "### 相关文章", "Cerca articoli")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Characters of extracted text that a task holds before it hands them out.
HELD = 1 << 22
MAIN_HINTS = ("content", "article", "post", "entry", "story")


def _tokens(value: str) -> set[str]:
    return {x for x in value.lower().replace("_", "-").replace("-", " ").split() if x}


def is_noise(tag: str, own: dict[str, str | None]) -> bool:
    """Whether an element is page chrome: by its tag, or by class and id unless they name the article's body."""
    if tag in NOISE_TAGS:
        return True
    classes, name = (own.get("class") or "").lower(), own.get("id") or ""
    if any(hint in " ".join(classes.split()) for hint in BODY_HINTS) or own.get("itemprop") == "articleBody":
        return False
    tokens = _tokens(f"{classes} {name}")
    if tokens & NOISE_TOKENS:
        return not ("sidebar" in tokens and tokens & LAYOUT)
    return any(part in f"{classes} {name}".lower() for part in NOISE_PARTS)


@dataclasses.dataclass(slots=True)
class Element:
    tag: str
    classes: str
    main: bool
    in_body: bool
    start: int
    end: int = -1


class Tree(html.parser.HTMLParser):
    """Elements of a page in order, each a range of text pieces; lengths of subtrees are differences of one running sum.

    Noise elements are left out with what they hold, so no block's text is put together before it is chosen.
    """

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.pieces: list[str] = []
        self.sums = [0]
        self.heads: dict[str, list[str] | None] = {"title": None, "h1": None}  # texts of the first of each, noise or not
        self._open: list[tuple[str, Element | None, list[str] | None]] = []
        self._counts: collections.Counter[str] = collections.Counter()  # open elements by tag
        self._reading: list[list[str]] = []  # heads that are open
        self._noise = 0
        self.feed(page)
        self.close()
        while self._open:
            self._end()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        own = dict(attrs)
        noise = is_noise(tag, own)
        element = None
        if not noise and not self._noise:
            element = Element(tag, " ".join((own.get("class") or "").lower().split()), own.get("role") == "main", self._counts["body"] > 0, len(self.pieces))
            self.elements.append(element)
        head = None
        if tag in self.heads and self.heads[tag] is None:
            head = self.heads[tag] = []
            self._reading.append(head)
        self._noise += noise
        self._counts[tag] += 1
        self._open.append((tag + "!" if noise else tag, element, head))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _end(self) -> str:
        tag, element, head = self._open.pop()
        self._noise -= tag.endswith("!")
        tag = tag.removesuffix("!")
        self._counts[tag] -= 1
        if head is not None:
            self._reading.pop()
        if element is not None:
            element.end = len(self.pieces)
        return tag

    def handle_endtag(self, tag):
        if self._counts[tag]:
            while self._end() != tag:
                pass

    def handle_data(self, data):
        bare = data.strip()
        if not bare:
            return
        for head in self._reading:
            head.append(bare)
        if not self._noise and not self._counts["title"]:
            self.pieces.append(data)
            self.sums.append(self.sums[-1] + len(bare))

    def size(self, e: Element) -> int:
        return self.sums[e.end] - self.sums[e.start]

    def title(self) -> str | None:
        """Text of the first title element, else of the first h1; null without either."""
        return next(("".join(x) for x in (self.heads["title"], self.heads["h1"]) if x), None)

    def _largest(self, elements: list[Element]) -> Element | None:
        return max(elements, key=self.size, default=None)

    def main(self) -> Element | None:
        """article, main, role=main, a hinted block over 100 characters, the largest block over 50; under 400 characters the largest block if that is larger."""
        whole = not any(e.tag == "body" for e in self.elements)
        first = lambda test: next((e for e in self.elements if test(e)), None)
        found = first(lambda e: e.tag == "article") or first(lambda e: e.tag == "main") or first(lambda e: e.main)
        for hint in MAIN_HINTS if found is None else ():
            own = self._largest([e for e in self.elements if hint in e.classes])
            if own is not None and self.size(own) > 100:
                found = own
                break
        blocks = [e for e in self.elements if e.tag in ("article", "div", "section") and (whole or e.in_body)]
        if found is None:
            own = self._largest([e for e in blocks if e.tag != "article"])
            found = own if own is not None and self.size(own) > 50 else None
        if found is None or self.size(found) < 400:
            own = self._largest(blocks)
            if own is not None and self.size(own) > (self.size(found) if found is not None else 0):
                return own
        return found

    def text(self) -> str:
        """Lines of the main block, else of the whole page; each text node begins a line."""
        found = self.main()
        pieces = self.pieces if found is None else self.pieces[found.start : found.end]
        lines = [line for piece in pieces for line in (" ".join(x.split()) for x in piece.splitlines()) if line]
        text = "\n".join(lines)
        return trimmed(lines) if len(text) > 50 else text


def trimmed(lines: list[str]) -> str:
    """Lines without chrome, language switches and a menu before the first long line, up to a related-articles block in the last part."""
    kept = [line for line in lines if not CHROME.match(line)]
    start = next((k for k, line in enumerate(kept) if not (len(line) <= 3 and line.isalpha())), len(kept))
    kept = kept[start:]
    at = next((k for k, line in enumerate(kept[:40]) if len(line) >= 12 and line not in MENU), 0)
    if sum(len(line) < 8 for line in kept[:at]) >= 3:
        kept = kept[at:]
    late = int(len(kept) * 0.72)
    stop = next((k for k in range(late, len(kept)) if kept[k].startswith(ENDINGS)), len(kept))
    return "\n".join(kept[:stop] or lines)


def main_block(page: str | None) -> str:
    return Tree(page).text() if page else ""


def text_of(html: str) -> Column:
    """The main block of each page in a column."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(main_block)

    return text(F.coalesce(html, F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, title, text, content_hash of pages(page_id, html); a null or empty page has an empty text and no title."""

    def run(batches):
        for batch in batches:
            yield from _extracted(batch)

    kind = pages.schema["page_id"].dataType.simpleString()
    found = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, f"page_id {kind}, title string, text string")
    return found.withColumn("content_hash", F.sha2("text", 256))


def _extracted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """page_id, title, text of the pages of a batch; one page's tree is held at a time, and HELD characters of text."""
    first, size, titles, texts = 0, 0, [], []
    for k in range(batch.num_rows):
        tree = Tree(batch.column("html")[k].as_py())
        titles.append(tree.title())
        texts.append(tree.text())
        size += len(texts[-1])
        if size > HELD or k + 1 == batch.num_rows:
            ids = batch.column("page_id").slice(first, len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(titles, pa.string()), pa.array(texts, pa.string())], ["page_id", "title", "text"])
            first, size, titles, texts = k + 1, 0, [], []


def _simple(d) -> str:
    bare = "coalesce(html, '')"
    for tag in ("script", "style", "head"):  # a name ends where the word does: <header> is no <head>
        bare = d.rxreplace(bare, f"(?is)<{tag}\\b[^>]*>.*?</{tag}[ \\t\\n\\r]*>", " ")
    bare = d.rxreplace(d.rxreplace(bare, "<[^>]*>", " "), "[ \\t\\n\\r]+", " ")
    return f"SELECT page_id, substring(trim({bare}), 1, 10000) AS text FROM pages"


def _trim(d) -> str:
    marker = "(?i)license|related|read more"
    return f"""
SELECT l.doc_id, count(*) AS kept, CAST(min(l.rn) AS BIGINT) AS first_line, CAST(max(l.rn) AS BIGINT) AS last_line FROM trim_lines l JOIN (
  SELECT doc_id, CASE WHEN shorts >= 3 THEN first_long ELSE start END AS start, stop FROM (
    SELECT l.doc_id, s.start, s.first_long, s.stop, count(CASE WHEN l.rn >= s.start AND l.rn < s.first_long AND length(l.x) < 8 THEN 1 END) AS shorts FROM trim_lines l JOIN (
      SELECT doc_id, coalesce(min(CASE WHEN NOT {d.rx('x', '^[A-Za-z]{1,3}$')} THEN rn END), 1) AS start, min(CASE WHEN length(x) >= 12 AND rn <= 40 THEN rn END) AS first_long, min(CASE WHEN rn > 0.72 * n AND {d.rx('x', marker)} THEN rn END) AS stop FROM trim_lines GROUP BY doc_id) s ON l.doc_id = s.doc_id GROUP BY l.doc_id, s.start, s.first_long, s.stop)) c
ON l.doc_id = c.doc_id WHERE l.rn >= c.start AND (c.stop IS NULL OR l.rn < c.stop) GROUP BY l.doc_id"""


def trim_lines(d) -> str:
    """Lines without page chrome, numbered."""
    lines = d.explode("doc_id", d.split("t", "\\n"), "docs")
    return f"SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM {lines} WHERE NOT {d.rx('x', '(?i)^(share|subscribe|log in|cookie)')}"


BASES = {"trim_lines": trim_lines}
QUERIES = {
    "page_title": lambda d: f"SELECT page_id, coalesce(nullif(trim({d.rxone('html', '(?is)<title[^>]*>(.*?)</title>')}), ''), nullif(trim({d.rxone('html', '(?is)<h1[^>]*>(.*?)</h1>')}), '')) AS title FROM pages",
    "page_extract_simple": _simple,
    "boilerplate_trim": _trim,
}
