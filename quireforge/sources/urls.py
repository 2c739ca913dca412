"""Lists of addresses: ``///`` names the next address, ``//`` comments, other lines must be http(s) addresses."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable

TIMEOUT_S, MOST_BYTES, SPACING_S = 20, 25 << 20, 0.5


def parse(text: str) -> list[tuple[str, str | None]]:
    """(address, title); a blank line drops a waiting title; any other line fails with its number."""
    out, title = [], None
    for n, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if not bare:
            title = None
        elif bare.startswith("///"):
            title = bare[3:].strip() or None
        elif bare.startswith("//"):
            continue
        elif bare.startswith(("http://", "https://")):
            out.append((bare, title))
            title = None
        else:
            raise ValueError(f"line {n} is no address: {bare[:80]}")
    return out


def http_fetch(url: str) -> str:
    """The text at an address, within the limits of time and size; spaced so that a server is not pressed."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "quireforge"}), timeout=TIMEOUT_S) as r:
        body = r.read(MOST_BYTES + 1)
        if len(body) > MOST_BYTES:
            raise ValueError(f"{url}: more than {MOST_BYTES} bytes")
        time.sleep(SPACING_S)
        return body.decode(r.headers.get_content_charset() or "utf-8", "replace")


def documents(text: str, fetch: Callable[[str], str] = http_fetch):
    """(path, title, blocks, error) of each address; the title is the list's, else the page's, else the address. An
    address that can't be fetched or read has an error, no title and no blocks."""
    from . import html

    for url, given in parse(text):
        try:
            title, blocks = html.parse(fetch(url))
        except Exception as x:  # noqa: BLE001
            yield url, None, [], f"{type(x).__name__}: {x}"
        else:
            yield url, given or title or url, blocks, None
