"""Personal data by fixed patterns and a linear-chain conditional random field.

Patterns find the base spans. Around digits, at-signs and "at"s that are bracketed or before a "dot" the
text is cut into tokens, whose word shapes are labelled by a conditional random field, trained here from
the table below and decoded by Viterbi for all sequences of a batch at once. Its spans are added where
they overlap no base span and hold what their kind needs.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
# A label of a domain has 63 characters at most.
_AT = r"[(\[{]\s?at\s?[)\]}]|\bat\b(?=[\s)\]}]*[\w-]{1,63}[\s(\[{]*dot\b)"
_TRIGGER = re.compile(rf"[0-9@]|{_AT}", re.I)
_WRITTEN_AT = re.compile(rf"@|{_AT}", re.I)
_WRITTEN_DOT = re.compile(r"(\.|\bdot\b)[\s)\]}]*\w", re.I)
_WORD = re.compile(r"\w*")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|\w")
_SPACE = re.compile(r"\s+")

#: Characters on either side of a trigger that belong to its sequence, besides the rest of a word that they cut.
REACH = 48

#: Labelled examples: a span is [kind text]. Fixed values of the training table.
EXAMPLES = """
please call [phone 555-123-4567] before noon
my phone is [phone (373) 555-7615] and i am home
tel. [phone (258) 555-9170] or by post
tel [phone 0176 12345678] abends
call [phone (444) 555-1212] or [phone 555-777-8888] now
[phone (312) 555-0188] is the office and [phone 312-555-0189] the fax
phone: [phone 030 1234567] from nine to five
fax [phone 0711/123456-78], office hours
mobile [phone 555 867 5309] any time
call us at [phone 1-800-555-0199] today
reach me on [phone 415.555.2671] tonight
ring [phone 020 7946 0958] for details
telefon [phone 0171 5550123] rund um die uhr
téléphone : [phone 01 42 68 53 00] le matin
teléfono [phone 91 555 12 34] por la tarde
the number is [phone 212-555-0147].
cell [phone (212) 555 0101]
write to [email jane.doe (at) example (dot) com] for more
mail [email john [at] example [dot] org] please
contact [email info @ example . net] or visit
e-mail: [email sales(at)shop.example.com] thanks
email [email bob.smith [at] mail.example.com] now
send it to [email anna (at) firma (dot) de] soon
courriel [email marie @ exemple . fr] merci
correo [email luis (at) ejemplo (dot) es] gracias
email [email JANE (AT) EXAMPLE (DOT) COM] now
MAIL [email SALES [AT] SHOP [DOT] ORG] TODAY
write to [email jane at example dot com] please
mail [email bob dot smith at example dot org] today
contact [email anna at mail dot firma dot de] for help
you reach [email max at web dot de] by day
mail is [email eva at example dot co dot uk] now
host [ip 192 . 168 . 0 . 12] is down
server at [ip 10 . 0 . 0 . 1] answered
address [ip 172,16,254,1] was blocked
card [card 4111.1111.1111.1111] expires soon
visa [card 4012/8888/8888/1881] was charged
card number [card 5500_0000_0000_0004] please
paid with [card 3782.8224.6310.0050.1] yesterday
in 1994 there were 12 of them
version 1.2.3 was released on 2020-01-15
the price is 19.99 for 3 pieces
chapter 12, page 345 and page 346
password = e3b3ed3cc8548923d6
token = "24be64439e3e49cf46b2d7c90f3602a3"
order 2024-0001-7781 was shipped on 12.03.2021
room 101 at 10:30 on 5 may
section 4.2.1.7 of the manual
isbn 978-3-16-148410-0 in stock
follow @user on the site
meet @ noon near the gate
see figure 3 (at) the end
he looked at the dot on the map
look at one dot and then the other
it stops at every dot in the text
he ran 100 m in 9.58 s
score 3-2 after 90 minutes
id 4785380592391139 is internal
total 1,234,567.89 in 2019
between 1914 and 1918 it was
9. the first of 10 points
sum of 12 345 678 units
area 51 and route 66
lot 555-12 was sold
10 20 30 40 50 60
sha e1f2 a3b4 c5d6 0718
""".strip().split("\n")

#: Words that announce a span. Fixed values.
CUES = {
    w: k
    for k, ws in {
        "tel": "phone tel telefon téléphone teléfono fax mobile cell call ring reach number",
        "mail": "mail email e courriel correo contact write send",
        "net": "host server address ip",
        "pay": "card visa paid",
    }.items()
    for w in ws.split()
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part of the leftmost match is the whole run before the at-sign, so each at-sign is
    tried once: the work is linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans that the patterns give, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_digits(m.group())) <= 15:
                    out.append((3, *m.span()))
    return out


Token = tuple[str, int, int]

#: Features of a token.
FEATURES = 8


def tokens(text: str, start: int = 0, end: int | None = None) -> list[Token]:
    return [(m.group(), *m.span()) for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def sequences(text: str) -> list[list[Token]]:
    """The tokens within REACH characters of a trigger, whole words; overlapping reaches make one sequence."""
    spans: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    whole: list[list[int]] = []
    for a, b in spans:
        done = whole[-1][1] if whole else 0
        while a > done and _inside_word(text, a):
            a -= 1
        if b > done and _inside_word(text, b):
            b = _WORD.match(text, b).end()
        if whole and a <= done:
            whole[-1][1] = max(b, done)
        else:
            whole.append([a, b])
    return [found for a, b in whole if (found := tokens(text, a, b))]


def _inside_word(text: str, k: int) -> bool:
    return 0 < k < len(text) and _WORD.fullmatch(text, k - 1, k + 1) is not None


def shape(token: str) -> str:
    if token[0].isdigit():
        return f"d{len(token)}" if len(token) < 6 else "dL" if len(token) < 13 else "dX"
    if token[0].isalpha():
        return token.lower() if len(token) <= 3 else "W" if token[0].isupper() else "w"
    return token


def features(seq: list[Token]) -> Iterator[list[str]]:
    s = ["^", "^", *[shape(t) for t, _, _ in seq], "$", "$"]
    cues = [CUES.get(t.lower(), "") for t, _, _ in seq]
    for i, (_, start, _) in enumerate(seq):
        k = i + 2
        glued = "+" if i and seq[i - 1][2] == start else "-"
        near = next((c for c in reversed(cues[max(0, i - 4) : i]) if c), "")
        yield [
            f"0 {s[k]}",
            f"g {glued}{s[k]}",
            f"-1 {s[k - 1]}|{s[k]}",
            f"+1 {s[k]}|{s[k + 1]}",
            f"3 {s[k - 1]}|{s[k]}|{s[k + 1]}",
            f"-2 {s[k - 2]}|{s[k]}",
            f"+2 {s[k]}|{s[k + 2]}",
            f"c {near}|{s[k][0]}",
        ]


def _labelled(line: str) -> tuple[list[Token], list[int]]:
    """Tokens and labels of an example: 0 is outside, 1 + 2 k begins a span of kind k, 2 + 2 k goes on."""
    text, marks, at = "", [], 0
    for m in re.finditer(r"\[(email|ip|card|phone) ", line):
        if m.start() < at:
            continue
        text += line[at : m.start()]
        depth, k = 1, m.end()
        while depth:
            depth += {"[": 1, "]": -1}.get(line[k], 0)
            k += 1
        marks.append((KINDS.index(m[1]), len(text), len(text) + k - 1 - m.end()))
        text += line[m.end() : k - 1]
        at = k
    text += line[at:]
    seq, labels = tokens(text), []
    for _, start, end in seq:
        own = next(((kind, a) for kind, a, b in marks if a <= start and end <= b), None)
        labels.append(0 if own is None else 1 + 2 * own[0] + (start != own[1]))
    return seq, labels


class Model:
    """Emission weights by feature, transitions, and the weights of a sequence's first label."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, begin: np.ndarray) -> None:
        self.index, self.emit, self.move, self.begin = index, emit, move, begin

    def scores(self, seq: list[Token]) -> np.ndarray:
        get = self.index.get
        none = len(self.index)  # the last row is zero
        ids = np.fromiter((get(f, none) for fs in features(seq) for f in fs), np.int32, FEATURES * len(seq))
        out = np.zeros((len(seq), self.emit.shape[1]))
        for column in ids.reshape(-1, FEATURES).T:
            out += self.emit[column]
        return out

    def decode(self, seqs: list[list[Token]]) -> list[np.ndarray]:
        """The best labels of each sequence, in batches of like lengths."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(seqs)
        order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
        k = 0
        while k < len(order):
            # At most about a million labels are held at once, or one sequence.
            own = [i for i in order[k : k + 512] if len(seqs[i]) <= 2 * len(seqs[order[k]]) + 8]
            while len(own) > 1 and len(own) * len(seqs[own[-1]]) > 100_000:
                own = own[: len(own) // 2]
            k += len(own)
            sizes = np.array([len(seqs[i]) for i in own])
            grid = np.zeros((len(own), int(sizes.max()), len(self.begin)))
            for r, i in enumerate(own):
                grid[r, : sizes[r]] = self.scores(seqs[i])
            best, back = grid[:, 0] + self.begin, np.zeros(grid.shape, dtype=np.int8)
            last = np.where((sizes == 1)[:, None], best, -np.inf)
            for t in range(1, grid.shape[1]):
                step = best[:, :, None] + self.move
                back[:, t] = step.argmax(axis=1)
                best = step.max(axis=1) + grid[:, t]
                last = np.where((sizes == t + 1)[:, None], best, last)
            now = last.argmax(axis=1)
            path = np.zeros(grid.shape[:2], dtype=np.int64)
            rows = np.arange(len(own))
            for t in range(grid.shape[1] - 1, -1, -1):
                inside = t < sizes
                path[:, t] = np.where(inside, now, 0)
                if t:
                    now = np.where(inside, back[rows, t, now], now)
            for r, i in enumerate(own):
                out[i] = path[r, : sizes[r]]
        return out


@lru_cache(maxsize=1)
def model(l2: float = 0.02, steps: int = 250, rate: float = 0.1) -> Model:
    """The field fitted to EXAMPLES by gradient steps on the penalised log-likelihood, with forward
    and backward sums over all examples at once. Moves into the inside of a span from anywhere but
    that span are forbidden."""
    data = [_labelled(x) for x in EXAMPLES]
    kinds = 1 + 2 * len(KINDS)
    index: dict[str, int] = {}
    ids = [[[index.setdefault(f, len(index)) for f in fs] for fs in features(seq)] for seq, _ in data]
    width = max(len(x) for x in ids)
    none = len(index)
    x = np.full((len(data), width, FEATURES), none)
    y = np.zeros((len(data), width), dtype=np.int64)
    inside = np.zeros((len(data), width), dtype=bool)
    for r, (own, (_, labels)) in enumerate(zip(ids, data, strict=True)):
        x[r, : len(own)], y[r, : len(own)], inside[r, : len(own)] = own, labels, True
    barred = np.zeros((kinds, kinds))
    for b in range(2, kinds, 2):
        barred[[a for a in range(kinds) if a not in (b - 1, b)], b] = -1e4
    start_barred = np.where(np.arange(kinds) % 2 == 0, -1e4, 0.0)
    start_barred[0] = 0.0
    eye = np.eye(kinds)
    gold = eye[y] * inside[:, :, None]
    pairs = inside[:, 1:] & inside[:, :-1]
    gold_move = np.einsum("rti,rtj->ij", eye[y[:, :-1]] * pairs[:, :, None], eye[y[:, 1:]])
    params = [np.zeros((none + 1, kinds)), np.zeros((kinds, kinds)), np.zeros(kinds)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]

    def total(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)

    for step in range(1, steps + 1):
        emit, move, begin = params
        e, m = emit[x].sum(axis=2), move + barred
        fore, aft = np.zeros_like(e), np.zeros_like(e)
        fore[:, 0] = e[:, 0] + begin + start_barred
        for t in range(1, width):
            now = total(fore[:, t - 1, :, None] + m, 1) + e[:, t]
            fore[:, t] = np.where(inside[:, t, None], now, fore[:, t - 1])
        z = total(fore[:, -1], 1)
        for t in range(width - 2, -1, -1):
            now = total(m + (e[:, t + 1] + aft[:, t + 1])[:, None, :], 2)
            aft[:, t] = np.where(inside[:, t + 1, None], now, 0.0)
        own = np.exp(fore + aft - z[:, None, None]) * inside[:, :, None]
        both = np.exp(
            np.clip(
                fore[:, :-1, :, None] + m + (e[:, 1:] + aft[:, 1:])[:, :, None, :] - z[:, None, None, None], -700, 0
            )
        ) * pairs[:, :, None, None]
        grad_emit = np.zeros_like(emit)
        np.add.at(grad_emit, x, np.broadcast_to((own - gold)[:, :, None, :], (*x.shape, kinds)))
        grads = [grad_emit, both.sum(axis=(0, 1)) - gold_move, (own[:, 0] - gold[:, 0]).sum(axis=0)]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g += l2 * p
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        params[0][none] = 0.0
    return Model(index, params[0], params[1] + barred, params[2] + start_barred)


def fits(kind: int, text: str) -> bool:
    """Whether ``text`` holds what a span of ``kind`` needs."""
    d = _digits(text)
    if kind == 0:
        at = _WRITTEN_AT.search(text)
        return bool(at and at.start() and _WRITTEN_DOT.search(text, at.end()))
    if not re.fullmatch(r"[+(0-9].*[0-9]", text, re.S):
        return False
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15


def covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the parts of a text that ``spans`` cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def added_spans(seq: list[Token], labels: np.ndarray, text: str, taken: tuple[list[int], list[int]]) -> list[tuple[int, int, int]]:
    """The spans that ``labels`` mark, without those that meet what is ``taken`` or don't fit their kind."""
    out, i = [], 0
    starts, ends = taken
    while i < len(seq):
        if not labels[i] or labels[i] % 2 == 0:
            i += 1
            continue
        kind, k = (int(labels[i]) - 1) // 2, i + 1
        while k < len(seq) and labels[k] == labels[i] + 1:
            k += 1
        a, b = seq[i][1], seq[k - 1][2]
        before = bisect_left(starts, b)
        if fits(kind, text[a:b]) and not (before and ends[before - 1] > a):
            out.append((kind, a, b))
        i = k
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(texts: list[str], field: Model) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    owner, seqs = [], []
    for i, t in enumerate(texts):
        for seq in sequences(t):
            owner.append(i)
            seqs.append(seq)
    taken = [covered(b) for b in base]
    more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, seq, labels in zip(owner, seqs, field.decode(seqs), strict=True):
        if labels.any():
            more[i] += added_spans(seq, labels, texts[i], taken[i])
    return list(zip(base, more, strict=True))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``.

    The counts and the digest are those of the base spans; ``spans`` has the added ones too. Offsets
    are code points, ends exclusive. Null and empty texts have no spans. Null identifiers and repeated
    rows are kept; other columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = find([t or "" for t in part.column(1).to_pylist()], field)
                counts = np.zeros((len(KINDS), len(found)), dtype=np.int64)
                for i, (base, _) in enumerate(found):
                    for kind, _, _ in base:
                        counts[kind, i] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *[pa.array(c) for c in counts],
                        pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]),
                        pa.array([joined(b + m) for b, m in found]),
                    ],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)
