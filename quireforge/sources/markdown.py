"""Markdown to blocks: CommonMark's usual subset with tables, task lists, strikethrough and footnotes.

Each paragraph, heading, list item, quote, footnote, code block and table becomes one block; of nested containers the
inner one comes first. Links keep their text and lose their address.
"""

from __future__ import annotations

import html
import re

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^( *)([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*)|$)")
_QUOTE = re.compile(r"^ {0,3}> ?(.*)$")
_NOTE = re.compile(r"^ {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
_TABLE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_LINK_DEFINITION = re.compile(r"^ {0,3}\[[^\]^][^\]]*\]:[ \t]*\S+")


def inline(text: str) -> str:
    """Text without its marks: emphasis, code ticks, links, escapes and entities."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    text = re.sub(r"(`+)(.+?)(?<!`)\1(?!`)", lambda m: keep(re.sub(r"^ (.*[^ ].*) $", r"\1", m[2].replace("\n", " "))), text, flags=re.S)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), text)
    text = re.sub(r"\[\[[^\[\]\n]*\]\]|\[\^[^\]\s]+\]", lambda m: keep(m[0]), text)
    text = re.sub(r"<((?:https?|mailto):[^>\s]+)>", lambda m: keep(m[1]), text)
    for _ in range(2):
        text = re.sub(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\((?:<[^>]*>|[^()\s]*(?:\([^()]*\)[^()\s]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)", r"\1", text)
        text = re.sub(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])+)\]\[[^\]]*\]", r"\1", text)
    for mark in (r"\*\*\*", r"\*\*", r"\*", "~~"):
        text = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", r"\1", text, flags=re.S)
    for mark in ("___", "__", "_"):
        text = re.sub(rf"(?<!\w){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", r"\1", text, flags=re.S)
    text = html.unescape(text)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)


def _paragraph(lines: list[str]) -> str:
    out = ""
    for i, line in enumerate(lines):
        body = line.strip(" \t")
        if i + 1 < len(lines):
            hard = line.endswith("  ") or body.endswith("\\")
            body = (body[:-1] if body.endswith("\\") else body) + ("\n" if hard else " ")
        out += body
    return inline(out)


def _cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [inline(c.replace("\\|", "|").strip()) for c in re.split(r"(?<!\\)\|", line)]


def _starts(line: str) -> bool:
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or _NOTE.match(line) or (m := _ITEM.match(line)) and (m[4] or "").strip())


def _walk(lines: list[str], blocks: list[tuple[str, str, int | None]], tight: bool) -> str:
    """Adds the blocks of the lines; with ``tight`` returns the text of the first paragraph instead of adding it, as the
    text of a tight list item belongs to the item."""
    own: list[str] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if m := _FENCE.match(line):
            body, i = [], i + 1
            close = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            while i < len(lines) and not close.match(lines[i]):
                body.append(lines[i])
                i += 1
            i += 1
            blocks.append(("code", f"```{m[2].strip()}\n" + "".join(x + "\n" for x in body) + "```", None))
            continue
        if m := _HEADING.match(line):
            blocks.append(("heading", inline((m[2] or "").strip()), len(m[1])))
            i += 1
            continue
        if _RULE.match(line):
            i += 1
            continue
        if _QUOTE.match(line):
            body = []
            while i < len(lines) and lines[i].strip() and ((q := _QUOTE.match(lines[i])) or not _starts(lines[i])):
                body.append(q[1] if q else lines[i])
                i += 1
            _walk(body, blocks, False)
            continue
        if (m := _NOTE.match(line)) or (m := _ITEM.match(line)) and (len(m[1]) < 4 or tight):
            note = bool(_NOTE.match(line))
            first = m[2] if note else m[4] or ""
            indent = 4 if note else len(m[1]) + len(m[2]) + min(len(m[3] or " "), 4)
            body, i, blank = [first], i + 1, False
            while i < len(lines):
                x = lines[i]
                if not x.strip():
                    blank = True
                    body.append("")
                elif len(x) - len(x.lstrip(" ")) >= indent:
                    body.append(x[indent:])
                    blank = False
                elif blank or _starts(x):
                    break
                else:
                    body.append(x)
                i += 1
            while body and not body[-1].strip():
                body.pop()
            loose = any(not x.strip() for x in body) and not note
            task = re.match(r"\[([ xX])\][ \t]+(.*)$", body[0]) if body and not note else None
            if task:
                body[0] = task[2]
            text = _walk(body, blocks, not loose and not note)
            mark = ("[x] " if task[1] in "xX" else "[ ] ") if task else ""
            if (mark + text).strip():
                blocks.append(("body", (mark + text).strip(), None))
            continue
        if line.startswith("    ") or line.startswith("\t"):
            body = []
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                body.append(re.sub(r"^(?: {4}|\t)", "", lines[i]))
                i += 1
            while body and not body[-1].strip():
                body.pop()
            blocks.append(("code", "```\n" + "".join(x + "\n" for x in body) + "```", None))
            continue
        if "|" in line and i + 1 < len(lines) and _TABLE.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            rows, width = [_cells(line)], len(_cells(line))
            i += 2
            while i < len(lines) and lines[i].strip() and not _starts(lines[i]):
                cells = _cells(lines[i])[:width]
                rows.append(cells + [""] * (width - len(cells)))
                i += 1
            blocks.append(("table", "\n".join(" | ".join(r) for r in rows), None))
            continue
        if _LINK_DEFINITION.match(line):
            i += 1
            continue
        body, i, level = [line], i + 1, None
        while i < len(lines) and lines[i].strip():
            if re.match(r"^ {0,3}=+[ \t]*$", lines[i]) or re.match(r"^ {0,3}-+[ \t]*$", lines[i]):
                level, i = (1 if "=" in lines[i] else 2), i + 1
                break
            if _starts(lines[i]) and not ((n := _ITEM.match(lines[i])) and n[2][0].isdigit() and n[2][:-1] != "1"):
                break
            body.append(lines[i])
            i += 1
        text = _paragraph(body)
        if level:
            blocks.append(("heading", text, level))
        elif tight:
            own.append(text)
        else:
            blocks.append(("body", text, None))
    return " ".join(own)


def parse(text: str) -> list[tuple[str, str, int | None]]:
    """(kind, text, heading_level) of the blocks in order; empty ones are left out."""
    blocks: list[tuple[str, str, int | None]] = []
    _walk(text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n"), blocks, False)
    return [(k, t.strip() if k != "code" else t, n) for k, t, n in blocks if t.strip()]
