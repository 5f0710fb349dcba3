"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams a page's events.  They are laid out in
lines, broken at newlines and at block-level tags; each line has the ratio of its
text characters to its tags.  The ratios are smoothed with a Gaussian along the
page and split into two clusters at a threshold; lines of the upper cluster are
content, in the order of the page.
"""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: A line with this share of the threshold between the clusters is content.
MARGIN = 1.0

_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Their contents are no text that a reader sees.
_HIDDEN = frozenset("script style noscript template textarea svg math iframe object head".split())
#: What a head may hold; any other tag, and text, ends it.
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Hidden to the end of the page where they are never closed: a script has no text, and a head ends by itself.
_TO_THE_END = frozenset("script style head".split())


class _Lines(HTMLParser):
    """Lines of a page: their text, text length and number of tags.

    ``shown``: the numbers of hidden elements that are read as if they were not hidden.
    """

    def __init__(self, shown: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.chars: list[int] = []
        self.tags: list[int] = []
        self._parts: list[str] = []
        self._tags = 0
        self._hidden: list[str] = []
        self._numbers: list[int] = []  # of the elements in _hidden
        self._shown = shown
        self._count = 0
        self._at = 0

    def read(self, html: str) -> None:
        """Parse the whole page; what the parser refuses is text, up to the next tag."""
        self.rawdata = html
        end = False
        while True:
            self._at = 0
            try:
                self.goahead(end)
            except (AssertionError, ValueError):
                k = self.rawdata.find("<", self._at + 1)
                k = k if k >= 0 else len(self.rawdata)
                self.handle_data(self.rawdata[self._at : k])
                self.rawdata = self.rawdata[k:]
                continue
            if end:
                break
            end = True
        self.flush()

    def never_closed(self) -> frozenset[int]:
        """Numbers of the hidden elements that are open at the end of the page."""
        return frozenset(n for tag, n in zip(self._hidden, self._numbers) if tag not in _TO_THE_END)

    def updatepos(self, i, j):
        self._at = j
        return j

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)  # as in HTML, to the next >

    def flush(self) -> None:
        """End the line."""
        text = " ".join("".join(self._parts).split())
        if text or self._tags:
            self.text.append(text)
            self.chars.append(len(text))
            self.tags.append(self._tags)
        self._parts, self._tags = [], 0

    def _leave_head(self, tag: str | None) -> None:
        """End an open head at a tag, or at text, that it cannot hold."""
        if self._hidden and self._hidden[-1] == "head" and tag not in _HEAD:
            del self._hidden[-1], self._numbers[-1]

    def handle_starttag(self, tag, attrs):
        self._leave_head(tag)
        if tag in _HIDDEN or tag == "title":
            self._count += 1
            if self._count not in self._shown and (tag in _HIDDEN or "head" in self._hidden):
                self._hidden.append(tag)
                self._numbers.append(self._count)
        elif tag == "body":
            self._hidden.clear()
            self._numbers.clear()
        if tag in _BLOCK:
            self.flush()
        self._tags += 1

    def handle_startendtag(self, tag, attrs):
        self._leave_head(tag)
        if tag in _BLOCK:
            self.flush()
        self._tags += 1

    def handle_endtag(self, tag):
        if self._hidden and tag in self._hidden:
            at = len(self._hidden) - 1 - self._hidden[::-1].index(tag)
            del self._hidden[at:], self._numbers[at:]
        self._tags += 1
        if tag in _BLOCK:
            self.flush()

    def handle_data(self, data):
        if self._hidden and data.strip():
            self._leave_head(None)
        if self._hidden:
            return
        lines = data.split("\n")
        for line in lines[:-1]:
            self._parts.append(line)
            self.flush()
        self._parts.append(lines[-1])


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean of each value's neighbours, with the weights that are inside renormalised."""
    if sigma <= 0 or not len(x):
        return x
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(x, kernel)[r : r + len(x)]
    return full / np.convolve(np.ones(len(x)), kernel)[r : r + len(x)]


def threshold(x: np.ndarray) -> float:
    """The cut between two clusters of least squared distance (the exact best one in one dimension); 0 where all are alike."""
    s = np.sort(x)
    n = len(s)
    if n < 2 or s[0] == s[-1]:
        return 0.0
    total, k = np.cumsum(s), np.arange(1, n)
    between = total[:-1] ** 2 / k + (total[-1] - total[:-1]) ** 2 / (n - k)
    between[s[1:] == s[:-1]] = -1.0
    i = int(np.argmax(between))
    return float((s[i] + s[i + 1]) / 2)


def extract(html: str | None, sigma: float = SIGMA, margin: float = MARGIN) -> tuple[str, int, int]:
    """Content, number of content lines and of all lines with text."""
    if not html:
        return "", 0, 0
    parser = _Lines()
    parser.read(html)
    shown: frozenset[int] = frozenset()
    while left := parser.never_closed():  # once: what was open at the end closed nothing else
        shown |= left
        parser = _Lines(shown)
        parser.read(html)
    chars = np.array(parser.chars, float)
    if not chars.any():
        return "", 0, 0
    # The logarithm keeps one very long paragraph from being a cluster of its own.
    ratio = smooth(np.log1p(chars / np.maximum(np.array(parser.tags, float), 1.0)), sigma)
    good = (ratio >= margin * threshold(ratio)) & (chars > 0)
    kept = [parser.text[i] for i in np.flatnonzero(good)]
    return "\n".join(kept), len(kept), int(np.count_nonzero(chars))


def extract_text(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sigma: float = SIGMA, margin: float = MARGIN) -> DataFrame:
    """(page_id, text, n_content, n_lines) for every row: content lines joined by newlines, and how many of the lines with text they are.

    Defined cases: a null or empty page, and one without text, has the empty text
    and no lines; where all ratios are alike, all lines with text are content;
    malformed markup is read as the parser reads it, and what it refuses as text
    (an unknown ``<![`` section is a comment up to the next ``>``); a head ends at
    the first tag or text that it cannot hold; a hidden element without an end tag
    hides nothing, but for scripts and styles; repeated rows give repeated
    results; a null id stays null; pages of any length are taken whole; other
    columns are not read.
    """

    def run(batches):
        for batch in batches:
            text, kept, lines = zip(*(extract(h, sigma, margin) for h in batch.column(1).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(kept, pa.int32()), pa.array(lines, pa.int32())], ["page_id", "text", "n_content", "n_lines"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), html_col).mapInArrow(run, "page_id long, text string, n_content int, n_lines int")
