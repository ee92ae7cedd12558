"""Pure functions over document text: front matter, hashes, paths, chunks, terms, and diffs.

They are plain Python so that the driver and Arrow workers share them; ``columns`` has the forms for
DataFrames, built in where the engine's own functions can say the same.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import yaml

from notegraph.config import RESERVED, PathConfig
from notegraph.errors import EngineError

FENCE = "---\n"


def fold(text: str) -> str:
    """The identity key of a path: composed, lower-cased, composed again."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower())


# Front matter


def split(text: str) -> tuple[str, str]:
    """(front matter as written, body). A fence opens on the first line and closes on a line of its
    own, the last one perhaps without a line feed; anything else is all body."""
    if not text.startswith(FENCE):
        return "", text
    m = re.compile(r"\n---(?:\n|\Z)").search(text, len(FENCE) - 1)
    while m and not m.group().endswith("\n") and m.end() != len(text):
        m = re.compile(r"\n---(?:\n|\Z)").search(text, m.end())
    if not m:
        return "", text
    return text[len(FENCE) : m.start() + 1], text[m.end() :]


def join(raw: str, body: str) -> str:
    """The canonical file; the inverse of ``split``."""
    if not raw:
        return body
    return f"{FENCE}{raw if raw.endswith(chr(10)) else raw + chr(10)}{FENCE}{body}"


class CoreLoader(yaml.SafeLoader):
    """YAML with the scalars of the 1.2 core schema alone: no yes/no, octal or dates."""


CoreLoader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
    ("bool", r"true|True|TRUE|false|False|FALSE", list("tTfF")),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", list("-+0123456789")),
    ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", list("-+0123456789.")),
):
    CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(f"^(?:{_pattern})$"), _first)


def _int(loader: CoreLoader, node: yaml.ScalarNode) -> int:
    text = loader.construct_scalar(node)
    return int(text[2:], 8) if text.startswith("0o") else int(text, 16) if text.startswith("0x") else int(text)


CoreLoader.add_constructor("tag:yaml.org,2002:int", _int)


def parse(raw: str) -> dict:
    """The map that ``raw`` holds; nothing parses to an empty one."""
    if not raw:
        return {}
    try:
        found = yaml.load(raw, CoreLoader)  # noqa: S506
    except yaml.YAMLError as e:
        raise EngineError("frontmatter_invalid", f"YAML: {e}") from None
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise EngineError("frontmatter_invalid", "front matter must be a map")
    return {str(k): v for k, v in found.items()}


def dump(values: dict) -> str:
    return yaml.safe_dump(values, sort_keys=False, allow_unicode=True, width=10**9) if values else ""


def to_json(values: dict) -> str:
    return json.dumps(values, ensure_ascii=False, default=str)


def with_property(raw: str, key: str, value: object) -> str:
    """``raw`` with the line ``$key: value`` added at its end."""
    return f"{raw}{'' if not raw or raw.endswith(chr(10)) else chr(10)}${key}: {value}\n"


_PROPERTY = re.compile(r"^\$([A-Za-z_][A-Za-z0-9_]*):([^\n]*)(?:\n|\Z)", re.M)


def without_properties(raw: str) -> tuple[str, dict[str, str]]:
    """``raw`` without its ``$key: value`` lines, and what they held."""
    return _PROPERTY.sub("", raw), {m[1]: m[2].strip() for m in _PROPERTY.finditer(raw)}


def content_hash(raw: str, body: str) -> str:
    return hashlib.sha256(join(raw, body).encode()).hexdigest()


def file_hash(text: str) -> str:
    """The hash that the file's stored version has: line ends unified, ``$`` lines left out."""
    raw, body = split(text.replace("\r\n", "\n"))
    return content_hash(without_properties(raw)[0], body)


# Paths

SLUG = 64


def exact_path(path: str, config: PathConfig = PathConfig()) -> str:
    """A document path as written by a caller, one leading slash allowed."""
    if "\\" in path:
        raise EngineError("path_invalid", "backslash in path", path=path)
    if path.startswith("//") or path == "/":
        raise EngineError("path_invalid", "empty segment", path=path)
    path = path.removeprefix("/")
    config.check(path)
    return path


def check_slug(slug: str, config: PathConfig = PathConfig()) -> None:
    """A slug is one segment under the server's configuration, without sigils, control characters or outer space."""
    sigils = (*config.system_sigils, *config.hidden_sigils)
    bad = any(c in config.disallowed_chars or c == "/" or c < " " or c == "\x7f" for c in slug)
    if bad or slug in RESERVED or len(slug) > SLUG or slug != slug.strip() or slug.startswith(sigils):
        raise EngineError("slug_invalid", f"bad slug {slug!r}")


def deleted_path(path: str, version: int, system: str = ":") -> str:
    """Where a deleted document goes: its version before the extension, below the system's folder. A
    leading dot begins no extension."""
    folder, _, name = path.rpartition("/")
    dot = name.rfind(".")
    if dot < 1:
        dot = len(name)
    return f"{system}deleted/{folder + '/' if folder else ''}{name[:dot]}-v{version}{name[dot:]}"


# Chunks

CHUNK = 2000


def units(text: str) -> int:
    """Length in UTF-16 units, which the chunk limit counts."""
    return len(text) + sum(c > "￿" for c in text)


def _cut(text: str, size: int) -> list[str]:
    wide = text.encode("utf-16-le", "surrogatepass")
    return [wide[k : k + 2 * size].decode("utf-16-le", "surrogatepass") for k in range(0, len(wide), 2 * size)]


def chunks(body: str, size: int = CHUNK) -> list[str]:
    """Blocks end at blank lines and before headings. They are packed in order, a blank line between
    them, while they fit; one that is longer than a chunk is cut at its size."""
    blocks: list[list[str]] = [[]]
    for line in re.split(r"\r?\n", body):
        if not line.strip():
            blocks.append([])
        elif re.match(r"\s{0,3}#{1,6}\s", line):
            blocks.append([line])
        else:
            blocks[-1].append(line)
    out: list[str] = []
    held = ""
    for block in filter(None, ("\n".join(b).rstrip() for b in blocks)):
        if held and units(held) + 2 + units(block) <= size:
            held += "\n\n" + block
            continue
        if held:
            out.append(held)
        held = block
        if units(block) > size:
            out += _cut(block, size)
            held = ""
    return [*out, held] if held else out


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# Terms

_TERM = re.compile(r"[^\W_]+")


def terms(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, without marks on letters."""
    plain = text.lower()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    return _TERM.findall(plain)


_VOWEL = "aeiou"


def _form(word: str) -> str:
    """The word as c and v: y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(word):
        vowel = c in _VOWEL or c == "y" and k > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _short(stem: str) -> bool:
    return _form(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _form(stem)[-1] == "c"


# The suffix tables of Porter's algorithm, steps 2 to 4.
_STEP2 = dict(
    pair.split(":")
    for pair in (
        "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize "
        "ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
    ).split()
)
_STEP3 = dict(pair.split(":") for pair in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _swap(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Porter's stem of a lower-cased word."""
    if len(word) < 3 or not word.isascii():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    trimmed = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _form(word[:-2]):
        trimmed = word[:-2]
    elif word.endswith("ing") and "v" in _form(word[:-3]):
        trimmed = word[:-3]
    if trimmed is not None:
        word = trimmed
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short(base):
            word = base
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


# Diffs


def unified_diff(old: str, new: str, old_name: str, new_name: str) -> str:
    lines = difflib.unified_diff(old.split("\n"), new.split("\n"), old_name, new_name, lineterm="", n=4)
    return "\n".join(lines)
