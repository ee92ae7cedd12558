"""Configuration in layers: defaults, the server's, and what a repository stores. A stored field replaces its default whole."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

from notegraph.errors import EngineError

#: Characters that no segment of a path holds, and segments that are none.
DISALLOWED = ("\\", "<", ">", ":", "|", "?", '"')
RESERVED = (".", "..", "")


def stored_object(stored: str | None, code: str) -> dict:
    """What a repository stores as JSON; nothing and null change nothing."""
    found = json.loads(stored) if stored is not None else None
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise EngineError(code, "a stored configuration is an object")
    return found


@dataclass(frozen=True)
class PathConfig:
    """``system_sigils`` begin segments that belong to the system, ``hidden_sigils`` such as readers ask for."""

    disallowed_chars: tuple[str, ...] = DISALLOWED
    system_sigils: tuple[str, ...] = (":",)
    hidden_sigils: tuple[str, ...] = (".",)

    def fault(self) -> str | None:
        """What makes this configuration ambiguous or useless, if anything does."""
        sigils = [*self.system_sigils, *self.hidden_sigils]
        entries = [*self.disallowed_chars, *sigils]
        if not all(isinstance(x, str) and x for x in entries):
            return "entries are strings and not empty"
        if any(len(c) != 1 for c in self.disallowed_chars):
            return "a disallowed character is one character"
        if any("/" in x for x in entries):
            return "entries don't hold the separator"
        if any(b.startswith(a) for i, a in enumerate(sigils) for j, b in enumerate(sigils) if i != j):
            return "a sigil begins another"
        if any(c in s for s in self.hidden_sigils for c in self.disallowed_chars):
            return "a hidden sigil holds a disallowed character"
        return None if self.system_sigils and self.hidden_sigils else "sigils of both kinds are needed"

    def layered(self, stored: str | None) -> PathConfig:
        own = stored_object(stored, "path_invalid")
        known = {f.name for f in fields(self)}
        lists = {k: v for k, v in own.items() if k in known and v is not None}
        if any(not isinstance(v, list) for v in lists.values()):
            raise EngineError("path_invalid", "a path configuration holds lists")
        out = replace(self, **{k: tuple(v) for k, v in lists.items()})
        wrong = out.fault()
        if wrong:
            raise EngineError("path_invalid", wrong)
        return out

    def check(self, path: str) -> None:
        for segment in path.split("/"):
            if segment in RESERVED:
                raise EngineError("path_invalid", f"reserved segment {segment!r}", path=path)
            if segment.startswith(self.system_sigils):
                raise EngineError("path_invalid", f"segment {segment!r} is in the system's namespace", path=path)
            bad = next((c for c in self.disallowed_chars if c in segment), None)
            if bad:
                raise EngineError("path_invalid", f"character {bad!r} in {segment!r}", path=path)

    def in_system(self, path: str) -> bool:
        return any(s.startswith(self.system_sigils) for s in path.split("/"))


@dataclass(frozen=True)
class Syntaxes:
    """The ways of writing links that are read. ``autolink`` is stored for other clients; no link comes of it."""

    inline: bool = True
    reference: bool = True
    autolink: bool = True
    wikilink: bool = True
    fullpath: bool = True


@dataclass(frozen=True)
class LinkConfig:
    """Ways of writing in the body and in strings of front matter, and how targets resolve."""

    body: Syntaxes = Syntaxes()
    frontmatter: Syntaxes = Syntaxes(reference=False, autolink=False)
    elision: bool = True
    anchors: bool = True
    index_name: str = "index"

    def layered(self, stored: str | None) -> LinkConfig:
        """Stored: ``body``, ``frontmatter``, ``resolution``; each that is given is given with all its fields."""
        own = stored_object(stored, "link_config_invalid")
        out = self
        for part in ("body", "frontmatter"):
            if own.get(part) is not None:
                out = replace(out, **{part: Syntaxes(**_flags(own[part], [f.name for f in fields(Syntaxes)]))})
        how = own.get("resolution")
        if how is not None:
            flags = _flags(how, ["wikilink_elision", "preserve_anchors"])
            name = how.get("index_basename")
            if not isinstance(name, str) or not name:
                raise EngineError("link_config_invalid", "index_basename is a name")
            out = replace(out, elision=flags["wikilink_elision"], anchors=flags["preserve_anchors"], index_name=name)
        return out


def _flags(given: object, names: Iterable[str]) -> dict[str, bool]:
    found = {n: given.get(n) if isinstance(given, dict) else None for n in names}
    wrong = [n for n, v in found.items() if not isinstance(v, bool)]
    if wrong:
        raise EngineError("link_config_invalid", f"{wrong[0]} is true or false")
    return found
