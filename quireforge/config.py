"""Settings, rule packs and data sources, from TOML."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field


class NotInitialized(Exception):
    pass


@dataclass
class Settings:
    pack: str = "generic"
    ocr: str = "auto"
    min_ocr_confidence: float = 45.0
    thin_text_chars: int = 100


def settings_path(root: str) -> str:
    return os.path.join(root, ".quireforge", "config.toml")


def save_settings(root: str, s: Settings) -> None:
    os.makedirs(os.path.dirname(settings_path(root)), exist_ok=True)
    with open(settings_path(root), "w") as f:
        f.write(f'pack = "{s.pack}"\nocr = "{s.ocr}"\nmin_ocr_confidence = {s.min_ocr_confidence}\nthin_text_chars = {s.thin_text_chars}\n')


def load_settings(root: str) -> Settings:
    try:
        with open(settings_path(root), "rb") as f:
            found = Settings(**tomllib.load(f))
    except FileNotFoundError:
        raise NotInitialized(root) from None
    if found.ocr not in ("auto", "never", "always"):
        raise ValueError(f"ocr: {found.ocr}")
    return found


@dataclass
class Require:
    regex: str
    within_chars: int = 400


@dataclass
class Rule:
    kind: str
    require: list[Require] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    atomic: bool = True


@dataclass
class Pack:
    name: str
    rules: list[Rule]

    def field_labels(self) -> list[str]:
        return sorted({f for r in self.rules for f in r.fields})


GENERIC = Pack("generic", [Rule("topic", atomic=False)])


def parse_pack(name: str, text: str) -> Pack:
    """Rules in order; a pack not called generic gets the generic rules after its own. Bad patterns fail here."""
    rules = []
    for e in tomllib.loads(text).get("entity", []):
        needs = [Require(r["regex"], r.get("within_chars", 400)) for r in e.get("require", [])]
        for r in needs:
            try:
                re.compile(r.regex)
            except re.error as x:
                raise ValueError(f"pack {name}: {r.regex}: {x}") from None
        rules.append(Rule(e["kind"], needs, e.get("fields", []), e.get("atomic", True)))
    return Pack(name, rules if name == "generic" else rules + GENERIC.rules)


def load_pack(path: str) -> Pack:
    with open(path) as f:
        return parse_pack(os.path.splitext(os.path.basename(path))[0], f.read())


@dataclass
class SourceQuery:
    name: str
    sql: str
    heading_column: str | None = None


@dataclass
class Source:
    name: str
    kind: str
    dsn: str
    queries: list[SourceQuery]


def interpolate(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} from the environment; unset or unterminated names fail."""
    env = os.environ if env is None else env
    out, at = [], 0
    while (start := text.find("${", at)) >= 0:
        end = text.find("}", start)
        if end < 0:
            raise ValueError(f"unterminated ${{ in {text!r}")
        name = text[start + 2 : end]
        if name not in env:
            raise ValueError(f"{name} is not set")
        out += [text[at:start], env[name]]
        at = end + 1
    return "".join([*out, text[at:]])


def parse_sources(text: str, env: dict[str, str] | None = None) -> list[Source]:
    return [
        Source(d["name"], d["kind"], interpolate(d["dsn"], env), [SourceQuery(q["name"], q["sql"], q.get("heading_column")) for q in d.get("query", [])])
        for d in tomllib.loads(text).get("datasource", [])
    ]
