"""What a captured page says: its name, a link, and whether it holds a phrase, from one pass over its HTML.

The pages of a batch go through one state machine on the events of the standard parser, which also decodes references.
Only the few short findings come back, so neither the page nor its text is moved on.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose text is not shown; one that is not closed hides the rest of the page.
HIDDEN = frozenset(("script", "style", "template"))
# Elements that end a heading or title which is never closed.
BLOCK = frozenset(
    "address article aside blockquote body div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)


class _Element:
    """Text of the first element of its kind: all up to its end, or up to the next block if it has no end."""

    def __init__(self, tag: str):
        self.tag = tag
        self.state = "awaited"
        self.pieces: list[str] = []
        self.before_block: int | None = None

    def start(self, tag: str) -> None:
        if self.state == "open":
            self.block(tag)
            if tag == self.tag:
                self.state = "cut"
        elif self.state == "awaited" and tag == self.tag:
            self.state = "open"

    def end(self, tag: str) -> None:
        if self.state == "open":
            if tag == self.tag:
                self.state = "closed"
            else:
                self.block(tag)

    def block(self, tag: str) -> None:
        if self.before_block is None and tag in BLOCK:
            self.before_block = len(self.pieces)

    def text(self) -> str:
        return "".join(self.pieces if self.state == "closed" else self.pieces[: self.before_block])


class PageReader(HTMLParser):
    """Text pieces, first heading, first title and links of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.hrefs: list[str] = []
        self.elements = [_Element("h1"), _Element("title")]
        self._hidden: list[str] = []
        self._run: list[str] = []

    def read(self, page: str) -> PageReader:
        self.feed(page)
        self.close()
        self._end_run()
        return self

    def name(self) -> str | None:
        """The heading, else the title, else none."""
        return next((text for element in self.elements if (text := element.text())), None)

    def text(self) -> str:
        return " ".join(self.pieces)

    def _end_run(self) -> None:
        """A run of text ends at every tag and comment; its blanks at both ends are dropped."""
        piece = "".join(self._run).strip()
        self._run.clear()
        if piece:
            self.pieces.append(piece)
            for element in self.elements:
                if element.state == "open":
                    element.pieces.append(piece)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end_run()
        if tag in HIDDEN:
            self._hidden.append(tag)
        if self._hidden:
            return
        for element in self.elements:
            element.start(tag)
        if tag == "a":
            self.hrefs += [value for key, value in attrs if key == "href" and value is not None][:1]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._end_run()
        if self._hidden:
            if tag == self._hidden[-1]:
                self._hidden.pop()
            return
        for element in self.elements:
            element.end(tag)

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self._run.append(data)

    def handle_comment(self, data: str) -> None:
        self._end_run()

    handle_decl = handle_pi = unknown_decl = handle_comment


_FACTS = pa.struct([("name", pa.string()), ("href", pa.string()), ("found", pa.bool_())])


def page_facts(html: Column, part: str | None = None, phrase: str | None = None) -> Column:
    """``name, href, found`` of a page; all NULL for a missing one.

    The name is the text of the first heading, else of the title. ``href`` is the first link whose address holds ``part``.
    ``found`` tells whether the text of the page, pieces joined by one blank, holds the phrase in any case.
    """
    sought = None if phrase is None else phrase.lower()

    def facts(page: str) -> dict:
        read = PageReader().read(page)
        href = None if part is None else next((h for h in read.hrefs if part in h), None)
        return {"name": read.name(), "href": href, "found": sought is not None and sought in read.text().lower()}

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([facts(page.as_py()) if page.is_valid else None for page in pages], _FACTS)

    return F.arrow_udf(run, "name string, href string, found boolean")(html)
