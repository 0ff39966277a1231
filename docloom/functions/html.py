"""HTML and markdown conversions that keep state while they read."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Text(HTMLParser):
    _SKIP = ("script", "style", "template")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skipping = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skipping += tag in self._SKIP

    def handle_endtag(self, tag: str) -> None:
        if tag in self._SKIP and self.skipping:
            self.skipping -= 1

    def handle_data(self, data: str) -> None:
        if not self.skipping and (stripped := data.strip()):
            self.parts.append(stripped)


def text_of_html(document: str | None) -> str | None:
    """Visible text, stripped pieces joined by a blank; no scripts, styles, comments."""
    if document is None:
        return None
    parser = _Text()
    parser.feed(document)
    parser.close()
    return " ".join(parser.parts)


def _mapped(kernel: Callable[[str | None], str | None], column: str | Column) -> Column:
    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(kernel, na_action="ignore")

    return convert(column)


def html_to_text(column: str | Column) -> Column:
    return _mapped(text_of_html, column)


def html_of_markdown(text: str | None) -> str | None:
    """Chat markdown as HTML: fences and code kept, web links only, bold, line ends."""
    if text is None:
        return None
    kept: list[str] = []

    def keep(markup: str) -> str:
        kept.append(markup)
        return f"\x00{len(kept) - 1}\x00"

    def escaped(raw: str) -> str:
        return html.escape(raw, quote=True).replace("&#x27;", "&#039;")

    text = re.sub(r"```[\w+-]*\n?(.*?)```", lambda m: keep(f"<pre><code>{escaped(m[1])}</code></pre>"), text.replace("\x00", ""), flags=re.S)
    text = re.sub(r"`([^`\n]+)`", lambda m: keep(f"<code>{escaped(m[1])}</code>"), text)
    text = re.sub(
        r"\[([^\]]+)\]\((https?://[^\s)]+)\)", lambda m: keep(f'<a href="{escaped(m[2])}" target="_blank" rel="noopener noreferrer">{escaped(m[1])}</a>'), text
    )
    text = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", escaped(text)).replace("\n", "<br>")
    while "\x00" in text:
        text = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)
    return text


def markdown_to_html(column: str | Column) -> Column:
    return _mapped(html_of_markdown, column)


def decoded_content(encoded: Column) -> Column:
    """Base64 file content as text; NULL where it is not UTF-8."""
    raw = F.unbase64(F.regexp_replace(encoded, r"\s", ""))
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8"))
