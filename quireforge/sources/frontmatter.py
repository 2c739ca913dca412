"""A subset of YAML before a text: scalars, inline lists and block lists of strings."""

from __future__ import annotations

import json


def _unquote(s: str) -> str:
    s = s.strip()
    return s[1:-1] if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'" else s


def parse_block(block: str) -> dict[str, str | list[str]]:
    """Keys with a scalar, a [list] or following "- " items; comments, nested maps and other lines are skipped."""
    out: dict[str, str | list[str]] = {}
    key: str | None = None
    for line in block.split("\n"):
        line = line.rstrip("\r")
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("- ") or bare == "-":
            if key is not None:
                held = out.setdefault(key, [])
                if isinstance(held, list) and (item := _unquote(bare[1:])):
                    held.append(item)
            continue
        if line[0] in " \t" or ":" not in bare:
            key = None if line[0] not in " \t" else key
            continue
        name, _, value = bare.partition(":")
        name, value, key = name.strip(), value.strip(), None
        if not name:
            continue
        if not value:
            key = name
        elif value.startswith("[") and value.endswith("]"):
            out[name] = [x for x in (_unquote(v) for v in value[1:-1].split(",")) if x]
        elif value not in ("|", ">", "|-", ">-"):
            out[name] = _unquote(value)
    return out


def split(text: str) -> tuple[dict[str, str | list[str]], str]:
    """(values, rest). The fence is a first line ---, closed by a later one; an empty block is none."""
    if not text.startswith(("---\n", "---\r\n")):
        return {}, text
    start = text.index("\n") + 1
    end = text.find("\n---", start)
    if end < 0:
        return {}, text
    after = text.find("\n", end + 4)
    if text[end + 4 : after if after >= 0 else len(text)].strip():
        return {}, text
    return parse_block(text[start:end]), text[after + 1 :] if after >= 0 else ""


def to_json(values: dict) -> str | None:
    return json.dumps(values, ensure_ascii=False) if values else None
