"""Pure functions: front matter, paths, chunks, stems, globs, diffs."""

import re

import pytest

from notegraph.errors import EngineError
from notegraph.functions import text
from notegraph.plans.visibility import glob_to_regex


@pytest.mark.parametrize(
    ("file", "parts"),
    [
        ("---\na: 1\n---\nbody", ("a: 1\n", "body")),
        ("---\n---\nbody", ("", "body")),
        ("---\na: 1\n---", ("a: 1\n", "")),
        ("no fence", ("", "no fence")),
        ("---\nnever closed\n", ("", "---\nnever closed\n")),
        ("---\na: 1\n---x\n---\nb", ("a: 1\n---x\n", "b")),
        ("--- \na\n---\n", ("", "--- \na\n---\n")),
    ],
)
def test_split(file, parts):
    assert text.split(file) == parts


def test_join_inverts_split():
    for raw, body in (("a: 1\n", "x"), ("", "plain"), ("a: 1", "y")):
        got = text.split(text.join(raw, body))
        assert got == (raw if not raw or raw.endswith("\n") else raw + "\n", body)


def test_core_schema():
    got = text.parse("a: yes\nb: 010\nc: 2020-01-01\nd: 1.5\ne: true\nf: null\ng: 0x1f\nh: [1, x]\n")
    assert got == {"a": "yes", "b": 10, "c": "2020-01-01", "d": 1.5, "e": True, "f": None, "g": 31, "h": [1, "x"]}
    assert text.parse("") == {} and text.parse("# only a comment") == {}
    for bad in ("- a", "a: [", "just text"):
        with pytest.raises(EngineError) as e:
            text.parse(bad)
        assert e.value.code == "frontmatter_invalid"


def test_properties():
    raw = text.with_property(text.with_property("a: 1", "version", "v7"), "content_hash", "ff")
    assert raw == "a: 1\n$version: v7\n$content_hash: ff\n"
    assert text.without_properties(raw) == ("a: 1\n", {"version": "v7", "content_hash": "ff"})


def test_hash_ignores_stamps_and_line_ends():
    plain = text.content_hash("a: 1\n", "body\n")
    assert text.file_hash("---\r\na: 1\r\n$version: v3\r\n---\r\nbody\r\n") == plain


def test_paths():
    assert text.exact_path("/a/b.md") == "a/b.md"
    for bad in ("", "/", "//a", "a//b", "a/", "a/../b", "a\\b", ":x/y", "a/:y", "a?b", "a:b", "a|b"):
        with pytest.raises(EngineError) as e:
            text.exact_path(bad)
        assert e.value.code == "path_invalid"
    assert text.deleted_path("notes/foo.md", 45129) == ":deleted/notes/foo-v45129.md"
    assert text.deleted_path(".gitignore", 1) == ":deleted/.gitignore-v1"
    assert text.deleted_path("a.b/c", 2) == ":deleted/a.b/c-v2"
    assert text.fold("É.md") == text.fold("É.md") == "é.md"


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("*.md", ["a.md", "x/y/a.md"], ["a.txt"]),
        ("/a.md", ["a.md"], ["x/a.md"]),
        ("docs/**", ["docs/a", "docs/a/b"], ["docs", "xdocs/a"]),
        ("docs/*", ["docs/a"], ["docs/a/b"]),
        ("**/a.md", ["a.md", "x/y/a.md"], ["ba.md"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["a/xb"]),
        ("a+b.md", ["a+b.md"], ["aab.md"]),
        ("**", ["anything/at/all"], []),
    ],
)
def test_globs(glob, yes, no):
    pattern = re.compile(glob_to_regex(glob))
    assert all(pattern.match(p) for p in yes) and not any(pattern.match(p) for p in no)


def test_chunks():
    assert text.chunks(" \n\n") == []
    assert text.chunks("a\nb\n\nc") == ["a\nb\n\nc"]
    assert text.chunks("x" * 1500 + "\n\n" + "y" * 600) == ["x" * 1500, "y" * 600]
    assert text.chunks("x" * 4500) == ["x" * 2000, "x" * 2000, "x" * 500]
    assert text.chunks("p\n# h\nq", 5) == ["p", "# h\nq"]
    assert [text.units(c) for c in text.chunks("😀" * 1500)] == [2000, 1000]


def test_stems():
    pairs = "foxes:fox running:run relational:relat caresses:caress ponies:poni hopping:hop happy:happi adjustment:adjust conditional:condit falling:fall sky:sky agreed:agre plastered:plaster motoring:motor hopeful:hope controlling:control"
    assert {w: text.stem(w) for w, _ in (p.split(":") for p in pairs.split())} == dict(p.split(":") for p in pairs.split())
    assert text.terms("Über-Größe, É x_1!") == ["uber", "große", "e", "x", "1"]


def test_diff():
    got = text.unified_diff("a\nb", "a\nc", "p@v1", "p@v2")
    assert got.startswith("--- p@v1\n+++ p@v2\n@@") and "\n-b\n+c" in got
