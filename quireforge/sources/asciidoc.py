"""A subset of AsciiDoc to blocks: headings, attributes, comments, listings, delimited blocks and paragraphs."""

from __future__ import annotations

import re

_ATTRIBUTE = re.compile(r"^:([^\s:]+):(.*)$")
_HEADING = re.compile(r"^(={1,6}) +(\S.*)$")
_SOURCE = re.compile(r"^\[source(?:,([^,\]]*))?(?:,[^\]]*)?\]$")
_CONTAINERS = ("====", "****", "____")


def parse(text: str) -> tuple[dict[str, str], list[tuple[str, str, int | None]]]:
    """(attributes, blocks). Paragraphs keep their line ends; an open comment or block reaches to the end."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    attributes: dict[str, str] = {}
    blocks: list[tuple[str, str, int | None]] = []
    para: list[str] = []
    language = ""

    def close() -> None:
        body = "\n".join(para).strip()
        para.clear()
        if body:
            blocks.append(("body", body, None))

    def until(start: int, mark: str) -> int:
        return next((j for j in range(start, len(lines)) if lines[j].strip() == mark), len(lines))

    i = 0
    while i < len(lines):
        bare = lines[i].strip()
        step = i + 1
        if bare.startswith("//") and bare != "////":
            i = step
            continue
        if not bare:
            close()
        elif bare == "////":
            close()
            step = until(i + 1, bare) + 1
        elif m := _ATTRIBUTE.match(bare):
            close()
            attributes[m[1]] = m[2].strip()
        elif m := _SOURCE.match(bare):
            close()
            language = (m[1] or "").strip()
        elif m := _HEADING.match(bare):
            close()
            blocks.append(("heading", m[2].strip(), len(m[1])))
        elif bare == "----":
            close()
            end = until(i + 1, bare)
            blocks.append(("code", f"```{language}\n" + "\n".join(lines[i + 1 : end]) + "```", None))
            language, step = "", end + 1
        elif bare in _CONTAINERS:
            close()
            end = until(i + 1, bare)
            if body := "\n".join(lines[i + 1 : end]).strip():
                blocks.append(("body", body, None))
            step = end + 1
        else:
            para.append(lines[i])
        i = step
    close()
    return attributes, blocks


def title(attributes: dict[str, str], blocks: list[tuple[str, str, int | None]], stem: str) -> str:
    first = next((t for k, t, n in blocks if k == "heading" and n == 1), None)
    return first or attributes.get("title") or stem
