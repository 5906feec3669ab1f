"""Secrets by rules and by a linear-chain conditional random field.

Rules find what they are sure of. The field adds what they miss: it tags the tokens of a
text as B (a secret begins), I (inside) or O (outside) and is decoded by Viterbi. Features
are the shape of a token, its neighbours and words before it, and what the whole text is
like. Only tokens of a candidate may be B or I: a run without white space that has 8
characters or more, and letters and digits or a word like ``password`` shortly before it.
All others are O in every tagging, so each stretch of candidates is decoded by itself with
the result that decoding the whole text would have.

The field is fitted to examples written from templates, by gradient steps on its likelihood;
fitting takes a second or two, once per driver process, and always gives the same weights.

Defined results: a null text is an empty one and has no spans; repeated rows each have
theirs; an empty table gives no rows; other columns are never looked at. Spans are in code
points, the end exclusive. An added span never overlaps one of the rules: where the field's
span does, its parts outside are added. One that the field tags with under 8 characters
needs a letter or digit and a word like ``password`` shortly before it.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm.shared import in_arrow

# The base rules and the order of their kinds.
ASSIGN = re.compile(
    r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so short ones need not be matched
KINDS = ("assign", "access", "hex", "secret")

# Words that announce a secret, words that announce another code, and
# prefixes that issuers of keys use.
ANNOUNCE = "password passwd passphrase pwd pass secret token apikey api_key key bearer auth credential credentials".split()
OTHER_CODE = "commit sha sha256 md5 checksum id uuid order version build image file phone call card tel isbn serial ticket".split()
PREFIXES = ("ghp_", "gho_", "sk_live_", "sk_test_", "sk-", "xoxb-", "xoxp-", "eyJ", "glpat-", "npm_", "AIza")

LABELS = "OBI"
CHUNK = re.compile(r"\S+")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
WORD = re.compile(r"[a-z0-9_]+")
LEAST, REACH = 8, 3
NEVER = -1e9


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules, leftmost and non-overlapping within a kind."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


# --- features -----------------------------------------------------------------------------


def _words(chunk: str) -> list[str]:
    return WORD.findall(chunk.lower())


def _has(chunk: str, listed: list[str]) -> bool:
    return any(w in listed or w.rstrip("s") in listed or w.split("_")[-1] in listed for w in _words(chunk))


def _announces(chunk: str) -> bool:
    return _has(chunk, ANNOUNCE)


def _candidate(chunk: str, before: list[str]) -> bool:
    if len(chunk) < LEAST or not any(c.isalnum() and c.isascii() for c in chunk):
        return False
    digit = any("0" <= c <= "9" for c in chunk)
    letter = any(c.isascii() and c.isalpha() for c in chunk)
    return digit and letter or any(map(_announces, before[-REACH:]))


def _announced(text: str, at: int) -> bool:
    """Whether one of the chunks before the place, or the start of its own, announces."""
    start, chunks = at, 0
    while start and chunks <= REACH:
        start -= 1
        chunks += text[start].isspace() and not text[start + 1].isspace()
    return any(map(_announces, CHUNK.findall(text, start, at)[-REACH - 1 :]))


def _step(value: float, *limits: float) -> int:
    return sum(value >= x for x in limits)


def _entropy(token: str) -> float:
    return -sum(p * math.log2(p) for p in (token.count(c) / len(token) for c in set(token)))


def _shape(token: str) -> list[str]:
    if not token[0].isalnum():
        kind = {"\"": "quote", "'": "quote", "=": "is", ":": "is"}.get(token)
        return [f"sign:{kind or ('join' if token in '_-./+~' else 'other')}"]
    digits = sum(c.isdigit() for c in token)
    upper, lower = any(map(str.isupper, token)), any(map(str.islower, token))
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    vowels = sum(c in "aeiouAEIOU" for c in token)
    out = [f"length:{_step(len(token), 4, 8, 12, 16, 24, 40)}", f"classes:{upper:d}{lower:d}{digits > 0:d}"]
    out.append(f"turns:{_step(turns, 1, 2, 4)}")
    out.append(f"entropy:{_step(_entropy(token), 2, 2.5, 3, 3.5)}")
    if digits == len(token):
        out.append("digits only")
    elif digits and set(token) <= set("0123456789abcdef"):
        out.append("hex")
    if len(token) >= 6 and vowels < 0.2 * (len(token) - digits):
        out.append("few vowels")
    return out


def text_features(text: str) -> list[str]:
    """What the whole text is like."""
    lines = text.split("\n")
    assigns = sum(" = " in x or '="' in x or "export " in x for x in lines)
    out = [f"assignments:{_step(assigns / len(lines), 0.1, 0.4)}"]
    if "PRIVATE KEY" in text or "BEGIN " in text:
        out.append("key block")
    if "{" in text or ";\n" in text:
        out.append("code")
    return out


def chunk_tokens(chunk: str, before: list[str], of_text: list[str]) -> list[tuple[int, int, list[str]]]:
    """(start, end, features) of the tokens of a candidate, positions within the chunk."""
    near = before[-REACH:]
    common = ["always", f"chunk:{_step(len(chunk), 12, 20, 32, 48)}", *[f"text {f}" for f in of_text]]
    common += [f"announced:{min((i for i, c in enumerate(reversed(near), 1) if _announces(c)), default=0)}"]
    if any(_has(c, OTHER_CODE) for c in near):
        common.append("other code")
    if near and near[-1][-1] in ":=":
        common.append("after sign")
    if near and near[-1].lower() in ("is", "was", "are", "with"):
        common.append("after is")
    if "@" in chunk:
        common.append("at")
    if "://" in chunk:
        common.append("link")
    if chunk.lstrip("\"'(").startswith(PREFIXES):
        common.append("prefix")
    joins = sum(chunk.count(c) for c in "-.:/")
    common.append(f"joins:{_step(joins, 1, 2, 3, 5)}")
    if not any(c.isalpha() for c in chunk):
        common.append("no letter")
    if any(c not in string.ascii_letters + string.digits + "_-./+=~\"':,;()@" for c in chunk):
        common.append("odd signs")
    found = list(TOKEN.finditer(chunk))
    out, named = [], False
    for i, m in enumerate(found):
        own = common + [f"own {f}" for f in _shape(m[0])]
        own += [f"last {f}" for f in (_shape(found[i - 1][0]) if i else ["none"])]
        own += [f"next {f}" for f in (_shape(found[i + 1][0]) if i + 1 < len(found) else ["none"])]
        if named:
            own.append("named in chunk")
        if m[0].lower() in ANNOUNCE:
            named = True
            own.append("is name")
        out.append((m.start(), m.end(), own))
    return out


def stretches(text: str, kept: Callable = list) -> Iterator[list[tuple[int, int, Any]]]:
    """Tokens of each stretch of neighbouring candidates: positions within the text, and
    what ``kept`` makes of their features.
    """
    low = text.lower()
    if not re.search("[0-9]", text) and not any(w in low for w in ANNOUNCE):
        return
    of_text: list[str] | None = None
    before: list[str] = []
    run: list[tuple[int, int, Any]] = []
    for m in CHUNK.finditer(text):
        chunk = m[0]
        if _candidate(chunk, before):
            of_text = text_features(text) if of_text is None else of_text
            for a, b, own in chunk_tokens(chunk, before, of_text):
                first = ["chunk start"] if a == 0 else []
                run.append((m.start() + a, m.start() + b, kept(own + first)))
        elif run:
            yield run
            run = []
        before = [*before[-REACH + 1 :], chunk]
    if run:
        yield run


# --- the field ----------------------------------------------------------------------------


class Field:
    """Weights of (feature, label) and (label, next label)."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def score(self, own: list[str]) -> np.ndarray:
        """What the features of a token say for each label."""
        return self.emit[[self.names[f] for f in own if f in self.names]].sum(axis=0)

    def decode(self, emit: list[np.ndarray]) -> list[int]:
        """Viterbi: the labels with the largest total; before the first token stands O."""
        best, back = emit[0] + self.move[0], []
        for row in emit[1:]:
            paths = best[:, None] + self.move
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        at = int(best.argmax())
        out = [at]
        for step in reversed(back):
            at = int(step[at])
            out.append(at)
        return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(
    examples: list[tuple[list[list[str]], list[int]]], rounds: int = 120, ridge: float = 0.02, rate: float = 0.3
) -> Field:
    """Maximum likelihood by forward and backward sums, with AdaGrad steps."""
    names = {f: i for i, f in enumerate(sorted({f for tokens, _ in examples for own in tokens for f in own}))}
    k, longest = len(LABELS), max(len(y) for _, y in examples)
    x = np.zeros((len(examples), longest, len(names)), np.float32)
    y = np.zeros((len(examples), longest), np.int64)
    size = np.array([len(labels) for _, labels in examples])
    for e, (tokens, labels) in enumerate(examples):
        y[e, : len(labels)] = labels
        for t, own in enumerate(tokens):
            x[e, t, [names[f] for f in own]] = 1
    real = np.arange(longest)[None, :] < size[:, None]
    rows = np.arange(len(examples))
    barred = np.zeros((k, k))
    barred[0, 2] = NEVER  # I follows B or I alone
    emit, move = np.zeros((len(names), k)), np.zeros((k, k))
    seen_emit, seen_move = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    gold = np.eye(k)[y] * real[..., None]
    for _ in range(rounds):
        step = move + barred
        score = x @ emit
        ahead = np.zeros((longest, len(examples), k))
        ahead[0] = score[:, 0] + step[0]
        for t in range(1, longest):
            go = _logsum(ahead[t - 1][:, :, None] + step, 1) + score[:, t]
            ahead[t] = np.where(real[:, t, None], go, ahead[t - 1])
        total = _logsum(ahead[size - 1, rows], 1)
        behind = np.zeros((longest, len(examples), k))
        for t in range(longest - 2, -1, -1):
            go = _logsum(step + (score[:, t + 1] + behind[t + 1])[:, None, :], 2)
            behind[t] = np.where(real[:, t + 1, None], go, 0)
        share = np.exp(ahead + behind - total[None, :, None]).transpose(1, 0, 2) * real[..., None]
        d_emit = np.einsum("etf,etk->fk", x, share - gold) + ridge * emit
        d_move = ridge * move
        d_move[0] += (share[:, 0] - gold[:, 0]).sum(axis=0)
        for t in range(1, longest):
            pair = ahead[t - 1][:, :, None] + step + (score[:, t] + behind[t])[:, None, :] - total[:, None, None]
            both = np.exp(pair) * real[:, t, None, None]
            d_move += both.sum(axis=0) - np.einsum("ea,eb->ab", gold[:, t - 1], gold[:, t])
        seen_emit += d_emit**2
        seen_move += d_move**2
        emit -= rate * d_emit / np.sqrt(seen_emit)
        move -= rate * d_move / np.sqrt(seen_move)
    return Field(names, emit, move + barred)


# --- examples -------------------------------------------------------------------------------

# Templates of the examples. {s} is a secret, {n} a code that is none.
WITH_SECRET = (
    "export API_TOKEN={s}",
    "password: {s}",
    "db_password = \"{s}\" # change me",
    "Authorization: Bearer {s}",
    "my password is {s} please keep it",
    "the secret key {s} was shared",
    "login with pass {s} now",
    "key={s};",
    "aws_secret_access_key {s}",
    "use token {s} for the build",
    "credentials admin {s}",
    "pwd={s} host=db1.example.com",
    "client_secret: '{s}'",
    "auth {s}",
    "{p}",
    "curl -u robot:{p} https://ci.example.com/run",
    "see {p} in the log",
)
WITHOUT = (
    "see commit {n} for the fix",
    "sha256 {n} of the file",
    "order id {n} was sent",
    "version {v} is out",
    "mail the.{d}@mail7.example.com about it",
    "call +1 ({d}3) 555-01{d} today",
    "from {d}.7.{d}.19 at noon",
    "card {c} was used",
    "image{d}48x10{d}.png is large",
    "https://example.com/item/{n}?page={d}",
    "on 2024-0{e}-1{e}T10:{d}:00Z it ended",
    "word{d}*** other### thing&&& more$$$",
    "the token ring network of 19{d} was slow",
    "the secret garden in chapter{d}s opening",
    "a password manager like keeper20{d} helps",
    "uuid {u} of the row",
    "in covid19times and b2b2c4u markets",
    "pass the butter2bread please",
    "the key question{d}answers follow",
    "Ont9: the{d}and thing{d}ed",
)


def _drawn(draw: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(draw.choice(alphabet) for _ in range(draw.randint(low, high)))


def _secret(draw: random.Random) -> str:
    alphabet = draw.choice(
        (string.ascii_letters + string.digits, string.hexdigits[:16], string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-!#%")
    )
    while True:
        made = _drawn(draw, alphabet, 10, 40)
        if made[0].isalnum() and made[-1].isalnum() and any(map(str.isdigit, made)) and any(map(str.isalpha, made)):
            return made


def _filled(draw: random.Random, template: str) -> tuple[str, str]:
    secret = draw.choice(PREFIXES) + _drawn(draw, string.ascii_letters + string.digits, 20, 40) if "{p}" in template else _secret(draw)
    digit = str(draw.randint(10, 99))
    return template.format(
        s=secret,
        p=secret,
        n=_drawn(draw, string.hexdigits[:16], 12, 40),
        v=f"{draw.randint(1, 9)}.{digit}.{draw.randint(0, 9)}-rc{draw.randint(1, 9)}",
        d=digit,
        e=str(draw.randint(1, 9)),
        c=_drawn(draw, string.digits, 16, 16),
        u="-".join(_drawn(draw, string.hexdigits[:16], n, n) for n in (8, 4, 4, 4, 12)),
    ), secret


def examples(count: int = 12, seed: int = 1) -> list[tuple[str, str | None]]:
    """Texts written from the templates, each with its secret if it has one."""
    draw = random.Random(seed)
    filler = "the and of thing other inner ention orhe with that".split()
    out = []
    for templates, has in ((WITH_SECRET, True), (WITHOUT, False)):
        for template in templates:
            for _ in range(count):
                text, secret = _filled(draw, template)
                left = " ".join(draw.choices(filler, k=draw.randint(0, 4)))
                out.append((f"{left} {text} " + " ".join(draw.choices(filler, k=3)), secret if has else None))
    return out


def tagged(text: str, secret: str | None) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Each stretch of an example: features and labels of its tokens."""
    start = text.find(secret) if secret else -1
    stop = start + len(secret or "")
    for run in stretches(text):
        labels = [0 if not start <= a < stop else 1 if a == start else 2 for a, _, _ in run]
        yield [own for _, _, own in run], labels


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train([x for text, secret in examples() for x in tagged(text, secret)])


# --- over texts and tables ------------------------------------------------------------------


def field_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """Spans that the field tags as secrets."""
    out: list[tuple[int, int]] = []
    for run in stretches(text, field.score):
        open_ = False
        for (a, b, _), label in zip(run, field.decode([own for _, _, own in run]), strict=True):
            if label == 1 or label == 2 and not open_:
                out.append((a, b))
            elif label == 2:
                out[-1] = (out[-1][0], b)
            open_ = label > 0
    return [
        (a, b)
        for a, b in out
        if b - a >= LEAST or any(map(str.isalnum, text[a:b])) and _announced(text, a)
    ]


def find(text: str | None, field: Field) -> list[tuple[int, int, str]]:
    """All spans by start, then kind; those of the field are of kind ``secret``."""
    text = text or ""
    base = base_spans(text)
    added, at, reach = [], 0, -1
    for a, b in field_spans(text, field):
        while at < len(base) and base[at][0] < b:  # both are in order of their starts
            if max(a, reach) < base[at][0]:
                added.append((max(a, reach), base[at][0], "secret"))
            reach = max(reach, base[at][1])
            at += 1
        if max(a, reach) < b:
            added.append((max(a, reach), b, "secret"))
    return sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))


def _find_batches(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    for batch in batches:
        found = [
            [{"start": a, "end": b, "kind": k} for a, b, k in find(t, field)]
            for t in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["_id", "spans"])


def secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None
) -> DataFrame:
    """One row per row of ``docs``: id and spans, an array of (start, end, kind)."""
    model = field or default_field()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    schema = f"_id {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>"
    return in_arrow(rows, lambda b: _find_batches(b, model), schema).withColumnRenamed("_id", id_col)
