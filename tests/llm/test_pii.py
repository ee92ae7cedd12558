import itertools
import random
import re

import numpy as np
import pytest

from notegraph.llm import pii

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (16 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == 3 and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.mark.parametrize("seed", range(30))
def test_base_spans(seed):
    r = random.Random(seed)
    bits = ["a.b", "@", "x@y.z", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "é", "+", "+1 (269) 555-3296",
            "+49", "--", "..", "1111", "%%", "@@", "😀", "5500000000000004", "\n", "x" * 30]
    text = "".join(r.choice(bits) + r.choice(["", " ", " "]) for _ in range(60))
    assert pii.base_spans(text) == brute(text)


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@" * 100_000, "+1" * 50_000):
        pii.base_spans(text)


def test_model_learns_its_table():
    field = pii.model()
    assert all(list(field.decode([s])[0]) == y for s, y in map(pii._labelled, pii.EXAMPLES))


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    field = pii.Model({}, np.zeros((1, 9)), r.normal(size=(9, 9)) * 2, r.normal(size=9))
    scores = {n: r.normal(size=(n, 9)) for n in (1, 2, 3, 4)}
    field.scores = lambda seq: scores[len(seq)]
    seqs = [[("x", 0, 1)] * n for n in (3, 1, 4, 2)]
    for seq, got in zip(seqs, field.decode(seqs), strict=True):
        e = scores[len(seq)]
        total = lambda p, e=e: field.begin[p[0]] + sum(e[t, k] for t, k in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(9), repeat=len(seq)), key=total)
        assert tuple(got) == best


def test_added_spans():
    field = pii.model()
    texts = ["call (444) 555-1212 or 555-777-8888 now", "mail max.muster (at) web (dot) de ok", "in 2019 there were 12 people", "see 152.143.123.131 ok", "", "plain words only"]
    found = pii.find(texts, field)
    added = [pii.joined(m) for _, m in found]
    assert added == ["phone:5:19,phone:23:35", "email:5:33", "", "", "", ""]
    assert [pii.joined(b) for b, _ in found] == ["", "", "", "ip:4:19", "", ""]


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("write JANE (AT) EXAMPLE (DOT) COM soon", "JANE (AT) EXAMPLE (DOT) COM"),
        ("you can write jane at example dot com today", "jane at example dot com"),
        ("contact: Bob At Example Dot Com.", "Bob At Example Dot Com"),
        ("her mail is x at example dot co dot uk ok", "x at example dot co dot uk"),
        ("please mail tom dot jones at site dot org", "tom dot jones at site dot org"),
        ("she looked at the dot on the wall", None),
        ("aim at center dot then shoot", None),
        ("He arrived at noon. dot dot dot", None),
    ],
)
def test_written_out_addresses(text, span):
    ((_, more),) = pii.find([text], pii.model())
    assert [text[a:b] for _, a, b in more] == ([span] if span else [])


@pytest.mark.parametrize("seed", range(20))
def test_sequences_are_whole_words_in_order(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word", "é" * 70, "x" * 120, "7", " ", " ", "@", "(AT)", "a_b", "."]) for _ in range(120))
    seqs = pii.sequences(text)
    flat = [t for s in seqs for t in s]
    whole = set(pii.tokens(text))
    assert all(t in whole for t in flat) and flat == sorted(set(flat), key=lambda t: t[1])
    assert {t for t in whole if t[0] in "7@"} <= set(flat)


@pytest.mark.parametrize("seed", range(20))
def test_taken_spans_against_all_pairs(seed):
    r = random.Random(seed)
    base = [(0, a, a + r.randint(1, 9)) for a in (r.randint(0, 90) for _ in range(8))]
    starts, ends = pii.covered(base)
    for a in range(100):
        for b in range(a + 1, a + 6):
            k = pii.bisect_left(starts, b)
            assert bool(k and ends[k - 1] > a) == any(a < y and x < b for _, x, y in base)


def test_long_sequences_are_linear():
    for text in ("at-" * 100_000, "at " * 100_000, "at" + " " * 200_000, "x" * 400_000 + "1", "(" * 200_000):
        pii.find([text], pii.model())


def test_query_columns(spark):
    rows = [(1, "é x@y.zz +1 (269) 555-3296"), (2, None), (None, "1.2.3.4")]
    got = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == "email:2:8,phone:9:26" and (got[1].n_email, got[1].n_phone) == (1, 1)
    assert got[2].spans == "" and got[None].n_ip == 1
