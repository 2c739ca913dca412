"""The readers by name: what they support and whether what they need is there."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from . import files, pdf


class Reader(Protocol):
    name: str

    def supports(self, extension: str) -> bool: ...

    def probe(self) -> bool: ...


@dataclass(frozen=True)
class FileReader:
    name: str
    extensions: tuple[str, ...]
    programs: tuple[str, ...] = field(default=())

    def supports(self, extension: str) -> bool:
        return extension.lower().lstrip(".") in self.extensions

    def probe(self) -> bool:
        """True if the programs that the reader runs are installed; most need none."""
        have = pdf.available()
        return all(have.get(p, False) for p in self.programs)


READERS = [
    FileReader("markdown", ("md", "markdown")),
    FileReader("asciidoc", ("adoc",)),
    FileReader("urls", ("url", "urls")),
    FileReader("poppler", ("pdf",), ("pdftotext", "pdfinfo")),
    FileReader("tesseract", ("pdf", *pdf.IMAGES), ("pdftoppm", "tesseract")),
    FileReader("plain", tuple(e for e in files.EXTENSIONS if e != "pdf" and e not in files.STRUCTURED)),
]


def reader_for(extension: str) -> FileReader:
    """The first reader that supports an ending; unknown endings are read as plain text."""
    return next((r for r in READERS if r.supports(extension)), READERS[-1])


def capabilities() -> dict[str, bool]:
    return {r.name: r.probe() for r in READERS}
