"""Personal data by rules and by a semi-Markov conditional random field.

Rules find what they are sure of. The field adds what they miss, such as a number without
its plus sign or an address with its dots written out. It scores whole spans: how many
digits, how they are grouped, checksums, what announces them, how they end. A dynamic
program over the ends of spans of at most ``LONGEST`` tokens chooses boundaries and types
together. Spans that no type admits, by their first and last token or their number of
digits, are not scored; text without a digit or a written-out sign admits none.

The field is fitted to examples written from templates, by gradient steps on its
likelihood, once per driver process and always to the same weights.

Defined results: a null text is an empty one and has no spans; repeated rows each have
theirs; an empty table gives no rows; other columns are never looked at. The search of a very
long text is linear in its tokens, at most ``LONGEST`` ends each. Spans are in code
points, the end exclusive. An added span never overlaps one of the rules.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.shared import in_arrow

# The base rules and the order of their kinds. Runs are matched from their
# first character on and given back never, which leaves the matches as they are.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match holds one sign, so each sign is tried with the letters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules by kind, then start; non-overlapping within a kind."""
    spans = [(a, b, "email") for a, b in _emails(text)]
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                spans.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((*m.span(), "card"))
        if "+" in text:
            spans += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


# --- spans and their features -----------------------------------------------------------------

LONGEST = 20
OUT = 0  # label of a token outside; label k is KINDS[k - 1]
CHUNK = re.compile(r"\S+")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
SIGNED = re.compile(r"(?i)@|[\[({](?:at|dot|\.|@)[\])}]|\bdot\b")
AROUND = 5
SEEN = 20_000
HEXES = frozenset("0123456789abcdefABCDEF")
# Words that announce each kind, and codes that are none of them.
ANNOUNCE = {
    "email": "mail email contact write address".split(),
    "ip": "ip host server address ping".split(),
    "card": "card visa mastercard amex credit debit".split(),
    "phone": "call phone tel telephone mobile cell fax ring dial".split(),
}
OTHER = "order id isbn version serial ticket invoice year page item commit build".split()


def regions(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Stretches that may hold a span: (start, end, the three chunks before).

    A chunk with a digit belongs to one; around a written-out sign so do its neighbours.
    """
    signed = SIGNED.search(text) is not None
    if not signed and not re.search("[0-9]", text):
        return
    chunks = list(CHUNK.finditer(text))
    active = [re.search("[0-9]", m[0]) is not None for m in chunks]
    if signed:
        for i, m in enumerate(chunks):
            if SIGNED.search(m[0]):
                for j in range(max(0, i - AROUND), min(len(chunks), i + AROUND + 1)):
                    active[j] = True
    i = 0
    while i < len(chunks):
        if active[i]:
            j = i
            while j + 1 < len(chunks) and active[j + 1]:
                j += 1
            yield chunks[i].start(), chunks[j].end(), [m[0].lower() for m in chunks[max(0, i - 3) : i]]
            i = j
        i += 1


def _mail_like(whole: str) -> bool:
    return bool(SIGNED.search(whole) and re.search(r"(?i)@|\bat\b", whole))


@lru_cache(maxsize=65_536)
def _around(before: tuple[str, ...], kind: str) -> tuple[str, ...]:
    """Features of the chunks before a span; the same for all spans that begin at a token."""
    words = [w for chunk in before for w in re.findall("[a-z]+", chunk)]
    told = [f"announced:{any(w in ANNOUNCE[kind] for w in words)}"]
    return (*told, "other code") if any(w in OTHER for w in words) else tuple(told)


def span_features(
    label: int, whole: str, tokens: list[str], before: tuple[str, ...], left: str, right: str
) -> list[str]:
    """Features of a whole span: its text and tokens, the chunks before, its neighbours."""
    kind = KINDS[label - 1]
    digits = _digits(whole)
    groups = [len(g) for g in re.findall("[0-9]+", whole)]
    low = whole.lower()
    own = ["always", f"tokens:{min(len(tokens) // 3, 5)}", f"digits:{min(len(digits), 20)}"]
    own += _around(before, kind)
    if left and not left.isspace():
        own.append("stuck left" if left.isalnum() or left in "#$%*_/=" else "sign left")
    if right and not right.isspace():
        own.append("stuck right" if right.isalnum() or right in "#$%*_/=" else "sign right")
    if kind == "email":
        own.append(f"marks:{len(re.findall(r'[\[({](?:at|dot|@|\.)[\])}]', low))}")
        own.append(f"words:{len(re.findall(r'\b(?:at|dot)\b', low)) > 1}")
        own.append(f"end:{2 <= len(tokens[-1]) <= 4}")
        own.append(f"spaces:{min(whole.count(' '), 8)}")
    elif kind == "ip":
        parts = re.split(r"[\[(]?[.][\])]?", whole)
        own.append(f"four:{len(parts) == 4 and all(p.isdigit() and int(p) < 256 for p in parts)}")
        own.append(f"written out:{'[' in whole or '(' in whole}")
        own.append(f"colons:{min(whole.count(':'), 8)}")
        own.append(f"clean:{' ' not in whole}")
    else:
        own.append(f"groups:{'-'.join(map(str, groups[:6]))}")
        own.append(f"signs:{''.join(sorted(set(re.sub('[0-9 ]', '', whole))))}")
        own.append(f"luhn:{luhn(digits)}")
        own.append(f"start:{whole[0] if not whole[0].isdigit() else digits[0] if digits[0] in '01' else 'd'}")
    return [f"{kind} {f}" for f in own]


def spans_of(
    text: str, start: int, stop: int, before: list[str], kept: Callable = list
) -> tuple[list[re.Match], list[tuple[int, int, int, Any]]]:
    """Tokens of a region, and (i, j, label, what ``kept`` makes of the features) of each
    admitted span and of each token outside.
    """
    tokens, of_chunk, words = [], [], list(before)
    for chunk in CHUNK.finditer(text, start, stop):
        inside = list(TOKEN.finditer(text, chunk.start(), chunk.end()))
        tokens += inside
        of_chunk += [len(words)] * len(inside)
        words.append(chunk[0].lower())
    names = [t[0] for t in tokens]
    digit = [t.isdigit() for t in names]
    digits = [sum(map(str.isdigit, t)) for t in names]
    mails = SIGNED.search(text, start, stop) is not None
    seen: dict[tuple, Any] = {}  # equal spans between equal neighbours have equal features
    parts = []
    for i, t in enumerate(tokens):
        kind = "digits" if t[0].isdigit() else "letters" if t[0].isalpha() else "sign"
        kind = "mixed" if kind == "sign" and t[0].isalnum() else kind
        parts.append((i, i + 1, OUT, kept([f"out {kind}", f"out {kind} {min(len(t[0]), 6)}"])))
        if kind == "sign" and t[0] not in "+(":
            continue
        near = tuple(words[max(0, of_chunk[i] - 3) : of_chunk[i]])
        n, dotted, ip, card, phone = 0, False, True, digit[i], digit[i] or t[0] in "+("
        for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
            if j > i + 1 and tokens[j - 1].start() - tokens[j - 2].end() > 1:
                break  # at most one space between the tokens of a span
            last = names[j - 1]
            n += digits[j - 1]
            dotted |= last in ".:"
            ip &= last in ".:[]()" or len(last) <= 4 and HEXES.issuperset(last)
            card &= (digit[j - 1] or last == "-") and n <= 19
            phone &= (digit[j - 1] or last in "+().-/") and n <= 15
            if not (mails or ip or card or phone):
                break  # no longer span has a label either
            labels = []
            if mails and t[0].isalnum() and last.isalpha() and j - i >= 5 and _mail_like(text[t.start() : tokens[j - 1].end()]):
                labels.append(1)
            if ip and dotted and n >= 4 and j - i >= 7 and t[0].isalnum() and last.isalnum():
                labels.append(2)
            if card and n >= 13 and digit[j - 1]:
                labels.append(3)
            if phone and n >= 7 and digit[j - 1]:
                labels.append(4)
            a, b = t.start(), tokens[j - 1].end()
            for y in labels:
                told = (y, text[a:b], near, text[a - 1 : a] if a else "", text[b : b + 1])
                if told not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[told] = kept(span_features(y, text[a:b], names[i:j], near, *told[3:]))
                parts.append((i, j, y, seen[told]))
    return tokens, parts


# --- the field --------------------------------------------------------------------------------


class Field:
    """Weights of span features and of a label after a label."""

    def __init__(self, weight: dict[str, float], move: np.ndarray):
        self.weight, self.move = weight, move

    def score(self, own: list[str]) -> float:
        return sum(self.weight.get(f, 0.0) for f in own)

    def decode(self, length: int, parts: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
        """The segmentation with the largest total: its spans (i, j, label) of all kinds."""
        labels = len(KINDS) + 1
        best = [[-math.inf] * labels for _ in range(length + 1)]
        came: dict[tuple[int, int], tuple[int, int]] = {}
        best[0][OUT] = 0.0
        move = self.move.tolist()
        for i, j, y, score in parts:  # in order of their starts
            total, z = max((best[i][z] + move[z][y], z) for z in range(labels))
            if total + score > best[j][y]:
                best[j][y] = total + score
                came[j, y] = (i, z)
        out, at, y = [], length, max(range(labels), key=best[length].__getitem__)
        while at:
            i, z = came[at, y]
            if y:
                out.append((i, at, y))
            at, y = i, z
        return out[::-1]


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def train(
    examples: list[tuple[int, list, list[tuple[int, int, int]]]], rounds: int = 40, rate: float = 0.3, ridge: float = 0.02
) -> Field:
    """Maximum likelihood by sums over all segmentations, with AdaGrad steps."""
    names = {f: n for n, f in enumerate(sorted({f for _, parts, _ in examples for p in parts for f in p[3]}))}
    labels = len(KINDS) + 1
    ready = []
    for length, parts, gold in examples:
        chosen = {(i, j, y) for i, j, y in gold}
        covered = {t for i, j, _ in gold for t in range(i, j)}
        chosen |= {(t, t + 1, OUT) for t in range(length) if t not in covered}
        x = np.zeros((len(parts), len(names)), np.float32)
        for row, part in enumerate(parts):
            x[row, [names[f] for f in part[3]]] = 1
        ready.append((length, [p[:3] for p in parts], x, np.array([p[:3] in chosen for p in parts], np.float32)))
    w, move = np.zeros(len(names)), np.zeros((labels, labels))
    seen_w, seen_move = np.full_like(w, 1e-8), np.full_like(move, 1e-8)
    for _ in range(rounds):
        d_w, d_move = ridge * w, ridge * move
        for length, parts, x, gold in ready:
            share, pairs = _expected(length, parts, (x @ w).tolist(), move)
            d_w += x.T @ (share - gold)
            last = OUT
            d_move += pairs
            for (_, _, y), is_gold in zip(parts, gold, strict=True):
                if is_gold:
                    d_move[last, y] -= 1
                    last = y
        seen_w += d_w**2
        seen_move += d_move**2
        w -= rate * d_w / np.sqrt(seen_w)
        move -= rate * d_move / np.sqrt(seen_move)
    return Field(dict(zip(names, w.tolist(), strict=True)), move)


def _expected(length: int, parts: list, score: list[float], move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each part, and expected counts of a label after a label."""
    labels, steps = len(KINDS) + 1, move.tolist()
    none = -math.inf
    by_start: dict[int, list[int]] = {}
    for k, part in enumerate(parts):
        by_start.setdefault(part[0], []).append(k)
    ahead = [[none] * labels for _ in range(length + 1)]
    ahead[0][OUT] = 0.0
    into = [[none] * labels for _ in range(length)]
    for at in range(length):
        into[at] = [_logsum([ahead[at][z] + steps[z][y] for z in range(labels)]) for y in range(labels)]
        for k in by_start[at]:
            _, j, y = parts[k]
            ahead[j][y] = _logsum([ahead[j][y], into[at][y] + score[k]])
    behind = [[none] * labels for _ in range(length + 1)]
    behind[length] = [0.0] * labels
    for at in range(length - 1, -1, -1):
        for z in range(labels):
            behind[at][z] = _logsum([steps[z][parts[k][2]] + score[k] + behind[parts[k][1]][parts[k][2]] for k in by_start[at]])
    total = _logsum(ahead[length])
    share, pairs = np.zeros(len(parts)), np.zeros_like(move)
    for k, (i, j, y) in enumerate(parts):
        rest = score[k] + behind[j][y] - total
        share[k] = math.exp(into[i][y] + rest)
        for z in range(labels):
            if ahead[i][z] > none:
                pairs[z, y] += math.exp(ahead[i][z] + steps[z][y] + rest)
    return share, pairs


# --- examples ---------------------------------------------------------------------------------

# Templates of the examples. Braces hold spans: e, i, c and p of the four
# kinds, the other letters codes that are none.
TEMPLATES = (
    "write to {e} today",
    "contact {e} or call {p}",
    "my mail is {e}",
    "phone {p} at home",
    "call {p} now",
    "call {p} {c} now",
    "tel: {p}, fax {p}",
    "{p} is the number to ring",
    "card {c} was declined",
    "visa {c} exp 12/29",
    "credit card number {c} please",
    "the host {i} is down",
    "ping {i} from the server",
    "server at {i} answers",
    "order {n} was sent",
    "the {n} of them",
    "in {y} and {y} there were {k}",
    "version {v} of the build",
    "page {k} of {k}",
    "see {y}-{k}-{k} for it",
    "they met at the dot of nine",
    "it is at {k} of the dot com years",
    "ratio {k}:{k} and {k}/{k}",
    "id {n}",
    "thing{k} and*** other### {n}",
    "a score of {k}-{k} was seen",
    "isbn {b} is the book",
    "price {k}.{k} or {k},{k}",
)


def _number(draw: random.Random, n: int) -> str:
    return "".join(draw.choice("0123456789") for _ in range(n))


def _email(draw: random.Random) -> str:
    name, host = draw.choice("ann bob.lee the.72 info max_m".split()), draw.choice("example mail7 post".split())
    end = draw.choice(("com", "org", "net"))
    at, dot = draw.choice(((" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("[@]", ".")))
    return f"{name}{at}{host}{dot}{end}"


def _ip(draw: random.Random) -> str:
    parts = [str(draw.randint(1, 254)) for _ in range(4)]
    if draw.random() < 0.3:
        return ":".join(f"{draw.randint(16, 65535):x}" for _ in range(8))
    return draw.choice(("[.]", "(.)")).join(parts)


def _card(draw: random.Random) -> str:
    sign = draw.choice(("", "-", " "))
    return sign.join(_number(draw, 4) for _ in range(4))


def _phone(draw: random.Random) -> str:
    a, b, c = _number(draw, 3), _number(draw, 3), _number(draw, 4)
    return draw.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"00{a[:2]} {b} {c}{a[2]}", f"0{a} {b}{c}"))


def examples(count: int = 8, seed: int = 1) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts written from the templates, with (start, end, label) of their spans."""
    draw = random.Random(seed)
    filler = "the and of thing other inner ention orhe with that".split()
    make = {"e": _email, "i": _ip, "c": _card, "p": _phone}
    codes = {
        "n": lambda d: _number(d, d.choice((6, 9, 12, 16))),
        "y": lambda d: str(d.randint(1900, 2030)),
        "k": lambda d: str(d.randint(1, 99)),
        "v": lambda d: f"{d.randint(1, 9)}.{d.randint(0, 20)}.{d.randint(0, 9)}",
        "b": lambda d: "978-" + "-".join(_number(d, n) for n in (1, 4, 4, 1)),
    }
    out = []
    for template in TEMPLATES:
        for _ in range(count):
            text, gold = " ".join(draw.choices(filler, k=draw.randint(0, 3))) + " ", []
            for part in re.split(r"(\{.\})", template):
                name = part[1:2] if part.startswith("{") else ""
                made = make[name](draw) if name in make else codes[name](draw) if name else part
                if name in make:
                    gold.append((len(text), len(text) + len(made), 1 + "eicp".index(name)))
                text += made
            out.append((text + " " + " ".join(draw.choices(filler, k=2)), gold))
    return out


def segmented(text: str, gold: list[tuple[int, int, int]]) -> Iterator[tuple[int, list, list]]:
    """Each region of an example: its length, its parts, its gold spans in tokens."""
    for start, stop, before in regions(text):
        tokens, parts = spans_of(text, start, stop, before)
        at, to = {t.start(): n for n, t in enumerate(tokens)}, {t.end(): n + 1 for n, t in enumerate(tokens)}
        own = [(at[a], to[b], y) for a, b, y in gold if start <= a and b <= stop]
        known = {p[:3] for p in parts}
        yield len(tokens), parts, [g for g in own if g in known]


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train([x for text, gold in examples() for x in segmented(text, gold)])


# --- over texts and tables ----------------------------------------------------------------------


def field_spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    """Spans that the field chooses, by start."""
    out = []
    for start, stop, before in regions(text):
        tokens, parts = spans_of(text, start, stop, before, field.score)
        if any(p[2] for p in parts):
            for i, j, y in field.decode(len(tokens), parts):
                out.append((tokens[i].start(), tokens[j - 1].end(), KINDS[y - 1]))
    return out


def find(text: str | None, field: Field) -> list[tuple[int, int, str]]:
    """All spans by kind, then start."""
    text = text or ""
    base = base_spans(text)
    known = sorted((a, b) for a, b, _ in base)
    added, at, reach = [], 0, -1
    for a, b, kind in field_spans(text, field):
        while at < len(known) and known[at][0] < b:
            reach = max(reach, known[at][1])
            at += 1
        if a >= reach:
            added.append((a, b, kind))
    return sorted([*base, *added], key=lambda s: (KINDS.index(s[2]), s[0]))


def _find_batches(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())])
    )
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base = set(base_spans(text or ""))
            rows.append(
                [{"start": s[0], "end": s[1], "kind": s[2], "base": s in base} for s in find(text, field)]
            )
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["_id", "spans"])


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None
) -> DataFrame:
    """One row per row of ``docs``: id and spans, an array of (start, end, kind, base)."""
    model = field or default_field()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    schema = f"_id {kind}, spans array<struct<start:bigint,end:bigint,kind:string,base:boolean>>"
    return in_arrow(rows, lambda b: _find_batches(b, model), schema).withColumnRenamed("_id", id_col)
