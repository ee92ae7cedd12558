"""Which paths a reader sees: globs, hidden and system segments, and read scopes, as columns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN, SYSTEM = ".", ":"


#: What the signs of a glob stand for. Any other character stands for itself.
GLOB_SIGNS = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
_GLOB_PARTS = re.compile("|".join([*map(re.escape, GLOB_SIGNS), "[^*?]+"]))


def glob_to_regex(glob: str) -> str:
    """An anchored regular expression. ``**/`` matches any number of segments, ``**`` anything, ``*`` a run within
    a segment and ``?`` one character of it. A leading slash anchors at the root; a pattern without any
    slash matches a name at every depth."""
    body = glob.removeprefix("/")
    depth = "(?:.*/)?" if "/" not in glob else ""
    return f"^{depth}{''.join(GLOB_SIGNS.get(x) or re.escape(x) for x in _GLOB_PARTS.findall(body))}$"


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_to_regex(g))
    return found


def has_sigil(path: Column, sigils: str | Iterable[str]) -> Column:
    """Whether any segment starts with the sigil, or one of several."""
    found = F.lit(False)
    for s in [sigils] if isinstance(sigils, str) else sigils:
        found = found | path.startswith(s) | path.contains("/" + s)
    return found


def slug_matches(slug: str, pattern: str) -> bool:
    return re.fullmatch(re.escape(pattern).replace(r"\*", ".*"), slug) is not None


@dataclass(frozen=True)
class Claim:
    """Repositories by pattern, and globs of which the last that matches a path decides; ``!`` negates."""

    repos: tuple[str, ...] = ("*",)
    globs: tuple[str, ...] = ("**",)


def claim_allows(path: Column, globs: Iterable[str]) -> Column:
    allowed = F.lit(False)
    for g in globs:
        no = g.startswith("!")
        allowed = F.when(path.rlike(glob_to_regex(g[no:])), F.lit(not no)).otherwise(allowed)
    return allowed


def allows(claims: Iterable[Claim], slug: str, path: str) -> bool:
    """Whether one of ``claims`` covers one path, as ``Visibility.scope`` decides it for rows."""
    for c in claims:
        if any(slug_matches(slug, p) for p in c.repos):
            last = next((g for g in reversed(c.globs) if re.search(glob_to_regex(g.removeprefix("!")), path)), "!")
            if not last.startswith("!"):
                return True
    return False


@dataclass(frozen=True)
class Visibility:
    """``claims``: None allows all, an empty tuple denies all. ``sigils``: by repository, the segments
    that hide a path where they differ from the default."""

    claims: tuple[Claim, ...] | None = None
    include_hidden: bool = False
    include_system: bool = False
    sigils: dict[int, tuple[str | tuple[str, ...], str | tuple[str, ...]]] = field(default_factory=dict)
    slugs: dict[int, str] = field(default_factory=dict)

    def scope(self, repo_id: Column, path: Column) -> Column:
        if self.claims is None:
            return F.lit(True)
        out = F.lit(False)
        for c in self.claims:
            own = [i for i, slug in self.slugs.items() if any(slug_matches(slug, p) for p in c.repos)]
            covers = F.lit(True) if "*" in c.repos else repo_id.isin(own) if own else F.lit(False)
            out = out | (covers & claim_allows(path, c.globs))
        return out

    def unhidden(self, repo_id: Column, path: Column) -> Column:
        def seen(hidden: str | tuple[str, ...], system: str | tuple[str, ...]) -> Column:
            out = F.lit(True)
            if not self.include_hidden:
                out = out & ~has_sigil(path, hidden)
            if not self.include_system:
                out = out & ~has_sigil(path, system)
            return out

        out = seen(HIDDEN, SYSTEM)
        for repo, (hidden, system) in self.sigils.items():
            out = F.when(repo_id == repo, seen(hidden, system)).otherwise(out)
        return out

    def visible(self, repo_id: Column | str = "repo_id", path: Column | str = "path") -> Column:
        repo_id = F.col(repo_id) if isinstance(repo_id, str) else repo_id
        path = F.col(path) if isinstance(path, str) else path
        return self.unhidden(repo_id, path) & self.scope(repo_id, path)
