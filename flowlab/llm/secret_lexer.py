"""Secret scans with assignment-aware lexing.

Fixed patterns find assignments to telling names, access keys and long hex strings. The
lexer reads source and configuration syntax as name-literal pairs (``name = "x"``,
``"name": "x"``, ``name := x``, ``name => 'x'``), also with a type or a further name before
the value (``name: str = "x"``, ``a = name = "x"``), carries constants through later names
(``a = "x"`` ... ``password = a``, also joined by ``+``), and scores each literal by the
most telling name it reaches. What scores enough is a span of kind ``literal``. A bare value
is searched for pairs of its own (``INFO: name=x``).

Spans are code points, end exclusive. Base spans are whole matches; a literal span is the
literal's content, and is added where no base span and no other literal span holds it. Cases: a null text is empty;
a text without findings has zero counts and empty spans; rows are scanned one by one, so
repeated rows and null ids need no rule. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "literal"]
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}

#: What a name's parts say about the literals it holds.
NAME_SCORE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "pass": 1.5, "secret": 3.0, "token": 2.5,
    "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "auth": 1.5, "authorization": 2.0, "bearer": 2.5,
    "key": 1.0, "private": 1.0, "access": 0.5, "signing": 1.0, "encryption": 1.0, "salt": 1.5, "dsn": 1.0, "api": 0.5,
}
#: Literals that stand for a secret and are none.
PLACEHOLDERS = {"changeme", "example", "password", "secret", "token", "username", "redacted", "undefined", "default", "required"}
THRESHOLD = 4.0

_HEAD = re.compile(r"""["']?(?<![\w.$-])(?P<name>[A-Za-z_][\w.-]*+)["']?[ \t]*(?P<sign>=>|:=|=(?!=)|:(?!:))[ \t]*""")
_OPERAND = re.compile(r""""(?P<d>[^"\n]*)"|'(?P<s>[^'\n]*)'|(?P<b>[^\s"',;+(){}\[\]<>]+)""")
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_SIGN = re.compile("[:=]")
# Types and further names, each with the "=" after it, that stand between a name and its value.
_ONE = (
    r"""(?:[&*?]|\[\]|'\w+[ \t]+|(?:mut|const|final|readonly|unsigned|dyn)[ \t]+)*+"""
    r"""(?:[A-Za-z_][\w.-]*+(?:::[\w.]++)*+|\[[^\]\n=]{1,100}\]|"[^"\n=]{1,100}"|'[^'\n=]{1,100}')"""
    r"""(?:[ \t]*\[[^\]\n=]{0,100}\]|<[^\n=;]{0,100}>)*[\]>?!*&]*"""
)
_TYPED = re.compile(rf"(?:{_ONE}(?:[ \t]*[|&][ \t]*{_ONE}){{0,8}}[ \t]*=(?![=>])[ \t]*){{1,4}}+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_IDENTIFIER = re.compile(r"[A-Za-z_][\w.-]*")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the fixed patterns, leftmost without overlap in each kind."""
    found = []
    folded = text.lower()
    if any(n in folded for n in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append((m.start(), 0, m.end(), m.start(2)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    """How telling a target name is; parts are split at case, digits and signs."""
    parts = [p.lower() for p in _PART.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return sum(NAME_SCORE.get(p, 0.0) for p in {*parts, *joined})


def literal_score(seen: Counter, word: str, quoted: bool) -> float:
    """How much a literal, by its characters' counts, looks like generated or chosen ones rather than words."""
    n = seen.total()
    if n < 6 or word.lower() in PLACEHOLDERS or len(seen) < 4 or " " in seen:
        return -math.inf
    kinds = sum(any(test(c) for c in seen) for test in (str.islower, str.isupper, str.isdigit))
    if not quoted and not any(c.isdigit() for c in seen):
        return -math.inf
    entropy = -math.fsum(k / n * math.log2(k / n) for k in seen.values())
    return entropy / 2 + 0.5 * (kinds - 1)


def literals(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of every literal that a telling name holds, with its most telling name."""
    # Each pair's score by its name, and what its value is made of: literals and earlier pairs. Name -> its last pair.
    telling: list[float] = []
    made: list[list[tuple[int, int, bool] | int]] = []
    holds: dict[str, int] = {}
    # Where the search is, the bare value it is in, and the end of the joined values it is in.
    at, run, outer = 0, (0, 0), 0

    def joined(start: int, inner: bool) -> tuple[list[tuple[int, int, bool] | int], int, tuple[int, int] | None]:
        """What the operands from ``start`` on are, their end, and the bare one to search for pairs."""
        parts, end, search = [], start, None
        while True:
            if run[0] <= start < run[1]:
                a, b, quoted = start, run[1], False
            elif step := _OPERAND.match(text, start):
                (a, b), quoted = step.span(step.lastgroup), step.lastgroup != "b"
            else:
                return parts, end, search
            signed = not quoted and _SIGN.search(text, a, b) is not None
            if not quoted and not signed and (value := text[a:b]) in holds:
                parts.append(holds[value])
            elif quoted or signed or not _IDENTIFIER.fullmatch(value) or any(c.isdigit() for c in value):
                parts.append((a, b, quoted))
            first, end = end == start, b + quoted
            more = _PLUS.match(text, end)
            # A pair inside a value reads no further than the next operand that holds one.
            last = not more or signed and inner and not first
            if search is None and (signed or last and not quoted):
                search = a, b
            if last:
                return parts, end, search
            start = more.end()

    while m := _HEAD.search(text, at):
        parts, end, search = joined(m.end(), m.start() < outer)
        if end == m.end() and m["sign"] == ":=":  # no value: the "=" is the one of ":"
            parts, end, search = joined(m.start("sign") + 1, m.start() < outer)
        if typed := _TYPED.match(text, m.end()):
            more, stop, _ = joined(typed.end(), True)
            if m["sign"] == ":" and more and isinstance(more[0], tuple) and more[0][2] and not _SIGN.search(text, m.end(), end):
                parts = []  # a type
            parts, outer = parts + more, max(outer, stop)
        outer = max(outer, end)
        at = search[0] if search else end
        run = search or run
        holds[m["name"]] = len(made)
        telling.append(name_score(m["name"]))
        made.append(parts)
    best: dict[tuple[int, int, bool], float] = {}
    for i in reversed(range(len(made))):
        for part in made[i] if telling[i] else ():
            if isinstance(part, int):
                telling[part] = max(telling[part], telling[i])
            else:
                best[part] = max(best.get(part, 0.0), telling[i])
    # Literals with one end lie in each other: their characters are counted once.
    seen, begin, stop = Counter(), 0, -1
    for (a, b, quoted), score in sorted(best.items(), key=lambda x: (x[0][1], -x[0][0])):
        if b != stop:
            seen, begin, stop = Counter(), b, b
        seen.update(text[a:begin])
        begin = a
        yield a, b, score + literal_score(seen, text[a:b] if b - a <= 16 else "", quoted)


def scan(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """All spans, by start, then kind."""
    found = base_spans(text)
    if "=" in text or ":" in text:
        found += [(a, 3, b, a) for a, b, score in literals(text) if score >= threshold]
        # By start, base spans before literals, long before short: a literal in another span ends before that one does.
        kept, reach = [], -1
        for span in sorted(found, key=lambda s: (s[0], s[1] == 3, -s[2])):
            if span[1] < 3 or span[2] > reach:
                kept.append(span)
                reach = max(reach, span[2])
        found = kept
    return sorted(found)


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: counts, a digest of the base spans, and all spans as kind:start:end.

    One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                spans = scan(text.as_py() or "", threshold)
                base = [s for s in spans if s[1] < 3]
                kinds = Counter(s[1] for s in spans)
                digest = hashlib.sha256(_written(base).encode()).hexdigest()
                rows.append((kinds[0], kinds[1], kinds[2], kinds[3], digest, _written(spans)))
            if rows:
                columns = [batch.column("doc_id"), *(pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(zip(*rows, strict=True)))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(run, FOUND)


MASK = "[secret]"


def masked(text: str, threshold: float = THRESHOLD) -> str:
    """``text`` with the secret part of every span replaced; the name before it stays."""
    spans = sorted((s, b) for _, _, b, s in scan(text, threshold))
    out, at = [], 0
    for a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` with secrets masked in ``text``; ``n_chars``, if there, follows a changed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = [t.as_py() for t in batch.column("text")]
            after = [t if t is None else masked(t, threshold) for t in before]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(after, batch.schema.field("text").type)
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                changed = [len(b) if a != b else n for a, b, n in zip(before, after, kept, strict=True)]
                columns["n_chars"] = pa.array(changed, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)
