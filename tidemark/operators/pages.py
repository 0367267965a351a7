"""Article pages: main text out of HTML, and enrichment of articles with it."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import texts

#: Elements that hold no text, that stand beside the main text, and that end a line.
_SILENT = frozenset(("script", "style", "noscript", "template", "svg", "head"))
_BESIDE = frozenset(("nav", "footer", "header", "aside", "form"))
_BLOCK = frozenset(("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "main", "blockquote", "pre"))
#: Characters from which a block counts as running text.
LEAST_BLOCK = 40
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Reader(HTMLParser):
    """Collects text inside and outside of article elements, without silent parts."""

    def __init__(self, beside: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.open, self.main = _SILENT | beside, [], 0
        self.article: list[str] = []
        self.whole: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self._add("\n")
        if tag in self.skip and tag not in _VOID:
            self.open.append(tag)
        self.main += tag in ("article", "main")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        self.main -= tag in ("article", "main") and self.main > 0
        if tag in _BLOCK:
            self._add("\n")

    def handle_data(self, data: str) -> None:
        self._add(data)

    def _add(self, text: str) -> None:
        if not self.open:
            self.whole.append(text)
            if self.main:
                self.article.append(text)


def _lines(parts: list[str]) -> str | None:
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x) or None


class _Blocks(_Reader):
    """Collects the body's text block by block, with how much of each is link text."""

    def __init__(self) -> None:
        super().__init__(_BESIDE)
        self.links, self.text, self.linked = 0, "", 0
        self.blocks: list[tuple[str, int]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self.flush()
        self.links += tag == "a"
        super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.links -= tag == "a" and self.links > 0
        super().handle_endtag(tag)
        if tag in _BLOCK:
            self.flush()

    def _add(self, text: str) -> None:
        if not self.open:
            self.text += text
            self.linked += len(text.strip()) if self.links else 0

    def flush(self) -> None:
        """End the block."""
        if text := " ".join(self.text.split()):
            self.blocks.append((text, min(len(text), self.linked)))
        self.text, self.linked = "", 0


def article_text(html: str) -> str | None:
    """The first extractor: the text of a page's article or main element; null if there is none."""
    reader = _Reader(_BESIDE)
    reader.feed(html)
    reader.close()
    return _lines(reader.article)


def dense_text(html: str) -> str | None:
    """The second extractor, for pages that mark no article: the stretch of blocks that holds most running text.

    A block of ``LEAST_BLOCK`` characters or more that isn't mostly links speaks for its stretch by its length outside of links, any other speaks against it
    by ``LEAST_BLOCK``; the stretch of the largest sum is the text. Null if no block speaks for one.
    """
    reader = _Blocks()
    reader.feed(html)
    reader.close()
    reader.flush()
    best, total, first = (0, 0, 0), 0, 0
    for i, (text, linked) in enumerate(reader.blocks):
        good = len(text) >= LEAST_BLOCK and 2 * linked < len(text)
        total += len(text) - linked if good else -LEAST_BLOCK
        if total <= 0:
            total, first = 0, i + 1
        elif total > best[0]:
            best = (total, first, i + 1)
    return "\n".join(text for text, _ in reader.blocks[best[1] : best[2]]) or None


def main_text(html: str | None) -> str | None:
    """A page's main text by the first extractor that finds any: its article, else its densest stretch, else its body without navigation, else all of it; null if there is none."""
    if not html:
        return None
    if found := article_text(html) or dense_text(html):
        return found
    reader = _Reader(_BESIDE)
    reader.feed(html)
    reader.close()
    if found := _lines(reader.whole):
        return found
    reader = _Reader(frozenset())
    reader.feed(html)
    reader.close()
    return _lines(reader.whole)


def with_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``body_text``, null where nothing could be read."""

    @F.pandas_udf("string")
    def extract(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in html:
            yield batch.map(main_text)

    return pages.withColumn("body_text", extract(F.col(html_col)))


def enriched(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Articles with the texts of fetched pages ``(url, html)``; those that have text keep it, and a null lede is filled from new text.

    Only pages of articles without text are parsed.
    """
    columns = articles.columns
    wanted = articles.where(~F.coalesce("text_available", F.lit(False))).select("url").distinct()
    found = with_text(pages.join(wanted, "url", "left_semi").dropDuplicates(["url"])).select(F.col("url").alias("_url"), F.col("body_text").alias("_text"))
    joined = articles.join(found, (articles["url"] == F.col("_url")) & ~F.coalesce("text_available", F.lit(False)), "left")
    new = F.col("_text").isNotNull()
    return joined.withColumns({
        "body_text": F.coalesce("_text", "body_text"),
        "lede": F.when(new, F.coalesce("lede", texts.lede(F.col("_text")))).otherwise(F.col("lede")),
        "text_available": F.when(new, True).otherwise(F.coalesce("text_available", F.lit(False))),
    }).select(columns)
