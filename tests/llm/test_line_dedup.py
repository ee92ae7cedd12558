import random

import pytest

from notegraph.llm import line_dedup, queries


def norm(line):
    return line.strip(" ").lower()


def plain_patience(a, b, at=0, to=0):
    """Matched positions, written out by the rules: equal ends, the longest chain of lines unique in both, a longest
    common subsequence where there are none."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(at, to), *plain_patience(a[1:], b[1:], at + 1, to + 1)]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1], at, to), (at + len(a) - 1, to + len(b) - 1)]
    once = [(a.index(x), j) for j, x in enumerate(b) if a.count(x) == b.count(x) == 1]
    best = {}
    for n, (i, j) in enumerate(once):
        before = [best[m] for m in range(n) if once[m][0] < i]
        best[n] = max(before, key=len, default=[]) + [(i, j)]
    chain = max(best.values(), key=len, default=[])
    if not chain:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        out, i, j = [], len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1] and table[i][j] == table[i - 1][j - 1] + 1:
                i, j = i - 1, j - 1
                out.append((at + i, to + j))
            elif table[i - 1][j] >= table[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out[::-1]
    out = []
    for (i, j), (x, y) in zip([(-1, -1), *chain], [*chain, (len(a), len(b))], strict=True):
        out += plain_patience(a[i + 1 : x], b[j + 1 : y], at + i + 1, to + j + 1)
        if x < len(a):
            out.append((at + x, to + y))
    return out


def brute(rows, least=5):
    """Every document aligned with every earlier one: the positions in blocks of ``least`` words or more, and those
    whose line some earlier document has."""
    docs = sorted({(i is None, i if i is not None else 0, t or "") for i, t in rows})
    own = {d: [norm(x) for x in d[2].split("\n")] for d in docs}
    out = {}
    for k, d in enumerate(docs):
        gone, seen = set(), set()
        for e in docs[:k]:
            if not set(own[e]) & set(own[d]) - {""}:
                continue
            seen |= {j for j, x in enumerate(own[d]) if x in own[e]}
            run = []
            for j in [*[j for _, j in plain_patience(own[e], own[d])], None]:
                if run and j != run[-1] + 1:
                    if sum(len(own[d][x].split()) for x in run) >= least:
                        gone |= set(run)
                    run = []
                run.append(j)
        out[d] = gone, seen
    return out


def data():
    r = random.Random(8)
    line = lambda: " ".join(f"w{r.randrange(500)}" for _ in range(r.randint(1, 9)))
    common = ["this notice appears in many of the files", "Short one"]
    pool = [line() for _ in range(60)]
    rows = []
    for i in range(150):
        lines = [line() for _ in range(r.randint(1, 8))]
        if r.random() < 0.5:
            lines.insert(r.randrange(len(lines) + 1), common[r.randrange(2)])
        if r.random() < 0.4:
            k = r.randrange(55)
            at = r.randrange(len(lines) + 1)
            lines[at:at] = [x.upper() if r.random() < 0.3 else x for x in pool[k : k + r.randint(1, 4)]]
        rows.append((i, "\n".join(lines)))
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [rows[7], (None, rows[9][1]), (5000, None), (5001, "\n\n"), (5002, "")]
    return rows


def compare(spark, rows):
    """(lines removed, those that aligning all pairs removes, those both do), with no line removed that no earlier document has."""
    want = brute(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    mine = every = both = 0
    for x in got:
        kept = [t for t in texts[x.doc_id] if "\n".join(y for k, y in enumerate(t.split("\n")) if k not in set(x.removed)) == x.text and len(t.split("\n")) == x.n_lines]
        assert kept
        gone, seen = want[(x.doc_id is None, x.doc_id if x.doc_id is not None else 0, kept[0])]
        assert set(x.removed) <= seen
        mine, every, both = mine + len(x.removed), every + len(gone), both + len(gone & set(x.removed))
    return mine, every, both


def test_against_all_pairs(spark):
    mine, every, both = compare(spark, data())
    assert both >= 0.98 * every and both >= 0.98 * mine and every > 200


@pytest.mark.parametrize("seed", range(3))
def test_recall_with_crossed_passages(spark, seed):
    """Passages of short and long lines that documents hold in any order, whole and in part, with blank lines between."""
    r = random.Random(seed)
    line = lambda: " ".join(f"w{r.randrange(200)}" for _ in range(r.choice([1, 2, 3, 8])))
    passages = [[line() for _ in range(r.randint(1, 9))] for _ in range(25)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(passages)
            cut = sorted((r.randint(0, len(p)), r.randint(0, len(p)))) if r.random() < 0.4 else (0, len(p))
            parts += p[cut[0] : cut[1]] + [""] * r.randint(0, 1) + [line() for _ in range(r.randint(0, 3))]
        rows.append((i, "\n".join(parts)))
    mine, every, both = compare(spark, rows)
    print(mine, every, both)
    assert both >= 0.95 * every and both >= 0.95 * mine


def test_lines_first_held_in_another_order(spark):
    lines = [f"line number {w} of the passage here" for w in ("one", "two", "three", "four")]
    rows = [(1, "\n".join(lines[::-1])), (2, "\n".join(["own start of two", *lines])), (3, "\n".join([*lines, "own end of three"]))]
    got = {x.doc_id: x.removed for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [] and got[3] == [0, 1, 2, 3]


def test_blocks_are_those_of_one_pair(spark):
    """Short lines are deleted together where one earlier document has them together."""
    rows = [(1, "a b\nown words of one"), (2, "c d e\nown words of two"), (3, "a b\nc d e\nown words of three"), (4, "x\na b\nc d e\nown words of four")]
    got = {x.doc_id: x.removed for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [1, 2]}


def test_later_copies_lose_all_lines(spark):
    text = "first line of several words here\nsecond line of several words"
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame([(2, text), (1, text), (3, "other words")], "doc_id long, text string")).collect()}
    assert got == {1: text, 2: "", 3: "other words"}


@pytest.mark.parametrize("seed", range(30))
def test_patience_matches_are_an_alignment(seed):
    r = random.Random(seed)
    a = [r.randrange(12) for _ in range(r.randint(0, 15))]
    b = [r.randrange(12) for _ in range(r.randint(0, 15))]
    got = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_patience_of_equal_texts():
    assert line_dedup.patience([1, 1, 2, 3], [1, 1, 2, 3]) == [(i, i) for i in range(4)]
    assert line_dedup.patience([1, 2, 3, 9, 4], [7, 1, 2, 3, 8, 4]) == [(0, 1), (1, 2), (2, 3), (4, 5)]


def test_query_aligns_lines_however_many_hold_them(spark, tmp_path):
    """Lines that cross those of their first holder are not aligned, whatever other documents hold."""
    one, two = "one line that has enough words", "another line that has enough words"
    rows = [(1, f"{one}\nfirst alone here\n{two}"), (2, f"{two}\nsecond alone here\n{one}")]
    others = [(10 + i, f"own text {i}\n{one}") for i in range(40)] + [(60 + i, f"other text {i}\n{two}") for i in range(40)]

    def removed(name, rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return {x.doc_id: x.removed for x in queries.op5_line_dedup(spark, f"{tmp_path}/{name}").collect()}

    few, many = removed("few", rows), removed("many", rows + others)
    assert few[1] == "" and few[2] in ("0", "2") and {1: many[1], 2: many[2]} == few
    assert all(many[i] == "1" for i, _ in others)


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@pytest.mark.parametrize("table", [1 << 27, 20, 0])
@pytest.mark.parametrize("seed", range(20))
def test_stretches_without_unique_lines_are_diffed(monkeypatch, seed, table):
    monkeypatch.setattr(line_dedup, "TABLE", table)
    r = random.Random(seed)
    a, b = ([r.randrange(r.choice((2, 9))) for _ in range(r.randint(0, 40))] for _ in range(2))
    got = line_dedup._lcs(a, b)
    assert all(a[i] == b[j] for i, j in got) and len(got) == lcs_length(a, b)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_passage_repeated_inside_a_document(spark):
    p = "first line of the repeated passage\nsecond line of the repeated passage"
    rows = [(1, f"x one\n{p}\nx two\n{p}\nx three"), (2, f"y one\n{p}\ny two"), (3, f"z one\n{p}\nz two\n{p}\nz three\n{p}\nz four")]
    got = {x.doc_id: x.removed for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [] and got[2] == [1, 2]
    assert len(got[3]) == 4 and set(got[3]) <= {1, 2, 4, 5, 7, 8}


def test_many_repeated_lines_are_diffed_in_time():
    a, b = [1, 2] * 10_000 + [3, 3], [4, 4] + [2, 1] * 10_000
    assert len(line_dedup.patience(a, b)) == 19_999


def pairwise(rows, least=5):
    """Every document aligned with every earlier one by ``patience``: the positions in blocks of ``least`` words or more."""
    docs = sorted({(i is None, i if i is not None else 0, t or "") for i, t in rows})
    own = {d: [norm(x) for x in d[2].split("\n")] for d in docs}
    out = {}
    for k, d in enumerate(docs):
        gone = set()
        for e in docs[:k]:
            run = []
            for j in [*[j for _, j in line_dedup.patience(own[e], own[d])], None]:
                if run and j != run[-1] + 1:
                    if sum(len(own[d][x].split()) for x in run) >= least:
                        gone |= set(run)
                    run = []
                run.append(j)
        out[d] = gone
    return out


def same_as_all_pairs(spark, rows):
    want = pairwise(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t in rows}
    assert len(texts) == len(set(rows))
    mine = {x.doc_id: set(x.removed) for x in got}
    assert mine == {i: want[(i is None, i if i is not None else 0, t)] for i, t in texts.items()}
    return mine


def test_no_holder_is_left_out(spark):
    """Sixty documents hold two lines, a single later one holds them in the other order, and so do those after it: the
    first of each part crosses them, whichever parts there are. Lines between others, blank lines, parts of a passage."""
    one, two = "one line that has enough words", "another line that has enough words"
    rows = [(i, f"{one}\nown text {i}\n{two}") for i in range(1, 61)]
    rows += [(61, f"{two}\nsecond alone here\n{one}"), (62, f"{two}\nthird alone here\n{one}"), (63, f"{two}\nfourth alone\n\n{one}\n\n")]
    rows += [(70 + i, f"short {i % 7}\nand words {i}\nshort {(i + i // 7) % 7}\nand words") for i in range(30)]
    rows += [(200, f"x\n\n{one}\n\ny\n\nz"), (201, f"\n{one}\n\n\t\nw"), (202, f"u\n\n{one}\n\t\n\nv"), (None, "a b\n\nc d e"), (300, "a b\nf\n\nc d e\ng"), (301, "a b\n\nc d e\nlast one")]
    mine = same_as_all_pairs(spark, rows)
    assert mine[2] == {0, 2} and len(mine[61]) == 1 and mine[62] == {0, 2} and {0, 3} <= mine[63]


@pytest.mark.parametrize("seed", range(2))
def test_all_pairs_of_crossed_lines(spark, monkeypatch, seed):
    """A few lines that most documents hold, in random order; batches small enough for several."""
    monkeypatch.setattr(line_dedup, "BATCH", 2)
    monkeypatch.setattr(line_dedup, "GROWTH", 2)
    r = random.Random(seed)
    pool = [" ".join(f"w{r.randrange(200)}" for _ in range(r.choice([1, 2, 3, 8]))) for _ in range(12)] + ["", "\t"]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.8 else f"own {i} {k}" for k in range(r.randint(1, 10)))) for i in range(90)]
    assert sum(map(len, same_as_all_pairs(spark, rows).values())) > 100


@pytest.mark.parametrize("seed", range(40))
def test_passages_of_lines_left(seed):
    """Whatever block holds a line, one of its passages is held in order by the block."""
    r = random.Random(seed)
    least = r.choice((0, 1, 5))
    lines = [r.randrange(9) for _ in range(r.randint(1, 14))]
    count = [r.choice((0, 1, 2, 5)) for _ in range(9)]
    words = [min(count[h], least) for h in lines]
    seen = {h: 1 for h in range(9) if r.random() < 0.8 and (count[h] or least <= 0)}
    gone = {i for i in range(len(lines)) if r.random() < 0.2}
    found = line_dedup.passages(lines, words, seen, gone, least)
    for s in range(len(lines)):
        for t in range(s + 1, len(lines) + 1):
            if all(h in seen or (words[i] == 0 and least > 0) for i, h in enumerate(lines[s:t], s)) and sum(words[s:t]) >= least:
                for j in set(range(s, t)) - gone:
                    assert any(j in at and is_within(v, lines[s:t]) for v, at in found.items())
    for v, at in found.items():
        assert not set(at) & gone and all(lines[j] in v for j in at)


def is_within(v, lines):
    rest = iter(lines)
    return all(h in rest for h in v)


@pytest.mark.parametrize("most", [0, 1, 2, 5, 65])
def test_words_up_to_a_number(spark, most):
    lines = ["", " ", "a", "\ta", "a b", " a b c d ", "a b c d e", "\ta\rb\x0bc\x0cd  e\r", "a b c d  ", "\x1ca b\u00a0b c d", "é b c d e f", "x" * 9999, "y " * 70]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {x.line: x.n for x in rows.select("line", line_dedup._words(rows.line, most).alias("n")).collect()}
    assert got == {x: min(len(x.encode().split()), most) for x in lines}
