"""What a principal may do: entitlements from a policy, and writes checked against them (SH1)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.config import PathConfig
from notegraph.errors import EngineError
from notegraph.functions import text
from notegraph.operators import writes
from notegraph.plans.visibility import Claim, Visibility, allows, has_sigil

_LISTS = (str, list, tuple)


@dataclass(frozen=True)
class Entitlement:
    """``author`` is stamped on writes. ``maintain``: backfills and repairs; ``destructive``: repositories and
    their configuration; ``impersonate``: authors of the caller's choice."""

    author: str
    read: tuple[Claim, ...] = ()
    write: tuple[Claim, ...] = ()
    maintain: bool = False
    destructive: bool = False
    impersonate: bool = False

    def may(self, act: str) -> None:
        """Refuse ``act`` (maintain or destructive) where it isn't granted."""
        if not getattr(self, act):
            raise EngineError("forbidden", act)

    def visibility(self, seen: Visibility = Visibility()) -> Visibility:
        """``seen`` within what may be read."""
        return replace(seen, claims=self.read)


def _several(value: object, where: str) -> tuple[str, ...]:
    found = (value,) if isinstance(value, str) else tuple(value) if isinstance(value, _LISTS) else ()
    if not found or not all(isinstance(x, str) for x in found):
        raise EngineError("unknown_arg", f"{where} is a string or a list of strings")
    return found


def entitlement(policy: dict | str, principal: str, author: str | None = None) -> Entitlement:
    """What ``principal`` may do under ``policy`` (a map, or its YAML): the grants and powers of all its roles.
    ``author``: the one that its login gave, where the policy names none."""
    known = text.parse(policy) if isinstance(policy, str) else policy
    roles, principals = known.get("roles") or {}, known.get("principals") or {}
    if principal not in principals:
        raise EngineError("unknown_arg", f"no principal {principal!r}")
    own = principals[principal] or {}
    claims: dict[str, list[Claim]] = {"read": [], "write": []}
    powers = dict.fromkeys(("maintain", "destructive", "impersonate"), False)
    for name in own.get("roles") or []:
        if name not in roles:
            raise EngineError("unknown_arg", f"principal {principal!r} has no role {name!r}")
        for power in powers:
            given = roles[name].get(power, False)
            if not isinstance(given, bool):
                raise EngineError("unknown_arg", f"{name}.{power} is true or false")
            powers[power] |= given
        for grant in roles[name].get("grants") or []:
            repos = _several(grant.get("repo"), f"{name}: repo")
            for way, found in claims.items():
                if grant.get(way) is not None:
                    found.append(Claim(repos, _several(grant[way], f"{name}: {way}")))
    powers["maintain"] |= powers["destructive"]
    stamp = own.get("author") or author
    if not stamp:
        raise EngineError("unknown_arg", f"principal {principal!r} has no author")
    return Entitlement(stamp, tuple(claims["read"]), tuple(claims["write"]), **powers)


def writable(own: Entitlement, slugs: dict[int, str], repo_id: Column, path: Column, paths: PathConfig = PathConfig()) -> Column:
    """Whether ``own`` may write a path. Paths in the system's namespace are left to the path rules."""
    return has_sigil(path, paths.system_sigils) | Visibility(claims=own.write, slugs=slugs).scope(repo_id, path)


def apply(
    versions: DataFrame, repo: int, slug: str, ops: Sequence[writes.Op], own: Entitlement, paths: PathConfig = PathConfig(), at: str | None = None
) -> tuple[DataFrame, list[int]]:
    """``writes.apply`` under ``own``: both ends of a move must be writable, where the one it leaves is the path of
    the version it builds on; to write is not to read. Nothing is written if any op is refused."""
    wanted = sorted({o.prev for o in ops if o.prev is not None})
    found = versions.where(F.col("id").isin(wanted)).select("id", "path").collect() if wanted else []
    sources = {r.id: r.path for r in found}
    for o in ops:
        for path in [sources.get(o.prev, o.path), *([o.new_path] if o.new_path else [])]:
            plain = path.removeprefix("/")
            if not paths.in_system(plain) and not allows(own.write, slug, plain):
                raise EngineError("forbidden", plain)
    stamped = [o if own.impersonate and o.author != writes.ANONYMOUS else replace(o, author=own.author) for o in ops]
    return writes.apply(versions, repo, stamped, at, paths)
