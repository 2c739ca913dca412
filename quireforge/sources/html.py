"""HTML to a title and blocks, by a walk over the parsed document."""

from __future__ import annotations

from html.parser import HTMLParser

# The elements that make blocks, by kind; those whose content is skipped; those that never have content;
# and those whose start ends an open paragraph.
KINDS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "body", "li": "body", "blockquote": "body", "pre": "code", "table": "table"}
SKIPPED = {"script", "style", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
}


class _Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.blocks: list[tuple[str, str, int | None]] = []
        self.title: str | None = None
        self.block: tuple[int, str, list[str]] | None = None  # depth, tag, texts
        self.named: list[str] = []

    def _end_block(self) -> None:
        if self.block:
            _, tag, parts = self.block
            text = " ".join(" ".join(parts).split())
            if text:
                self.blocks.append((KINDS[tag], text, int(tag[1]) if KINDS[tag] == "heading" else None))
            self.block = None

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.open.pop()
        if self.block and self.block[0] >= len(self.open):
            self._end_block()

    def _close_implied(self, tag: str) -> None:
        if tag in ENDS_PARAGRAPH and "p" in self.open:
            self._pop_to(len(self.open) - 1 - self.open[::-1].index("p"))
        if tag == "li":
            for d in range(len(self.open) - 1, -1, -1):
                if self.open[d] in ("ul", "ol", "menu"):
                    break
                if self.open[d] == "li":
                    self._pop_to(d)
                    break
        for mine, stop in ((("td", "th"), "tr"), (("tr",), "table"), (("dt", "dd"), "dl"), (("option",), "select")):
            if tag in mine or tag == "tr" and mine == ("td", "th"):
                for d in range(len(self.open) - 1, -1, -1):
                    if self.open[d] in (stop, "table"):
                        break
                    if self.open[d] in mine:
                        self._pop_to(d)
                        break

    def handle_starttag(self, tag, attrs):
        self._close_implied(tag)
        if tag in VOID:
            return
        if tag in KINDS and self.block is None and not any(t in SKIPPED for t in self.open):
            self.block = (len(self.open), tag, [])
        self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.open:
            self._pop_to(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data):
        if "title" in self.open and self.title is None and "svg" not in self.open:
            self.named.append(data)
            return
        if self.block and not any(t in SKIPPED for t in self.open) and data.strip():
            self.block[2].append(data.strip())

    def close(self):
        super().close()
        self._pop_to(0)
        self._end_block()


def parse(text: str) -> tuple[str | None, list[tuple[str, str, int | None]]]:
    """(title, blocks). The outermost element counts; scripts, styles and noscript are skipped; texts inside a block are
    joined by spaces; empty blocks are left out."""
    w = _Walk()
    w.feed(text)
    w.close()
    title = " ".join("".join(w.named).split())
    return title or None, w.blocks
