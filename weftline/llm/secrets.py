"""Secrets by patterns, and by the cost of guessing values in a credential context.

The base patterns find assignments, access keys and long hexadecimal runs. The method then looks at every value that
stands in a credential context (a wider set of names, and separators such as "is" or "=>") and computes what guessing
it would cost: a dynamic programme over all segmentations into common words, dates, repeats, keyboard walks and
brute-force spans takes the least sum of log10 guesses. Values run to their real end: the closing quote of the same line,
with spaces and escaped characters, or, unquoted or where the quote isn't closed, the next space, quote or one of <>;,.
The programme stops as soon as no continuation can cost less than MIN_GUESSES, which is exact. Values that cost at least MIN_GUESSES are spans of kind guess,
unless base spans cover them wholly; a value that a base span covers in part is a span as a whole.

Defined results: null and empty texts have no spans; positions are code points of the whole text, whatever its length;
of segmentations with equal cost the first in order counts, spans with equal starts go by kind; repeated rows give
repeated results; an empty table gives an empty result; extra columns are ignored, or passed through by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship
from .wordlist import RANKED

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value is a secret.
MIN_GUESSES = 10.0
#: Longest unit of a repeat.
UNIT = 16
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CONTEXT = re.compile(
    r"(?<![a-z])(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)[\"']?"
    r"[\x20\t]*(?::=|=>|[:=]|\x20is\x20)[\x20\t]*(?:\"((?:[^\"\\\n]|\\.)++)\"|'((?:[^'\\\n]|\\.)++)'|[\"']?([^\s\"'<>;,]+))",
    re.IGNORECASE | re.ASCII,
)
#: What a text must hold, in lower case, for either pattern of assignments to match.
_NAMES = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access", "private", "credential", "auth")
#: Frequent words of passwords, most frequent first, before those of wordlist.py; the place is the number of guesses.
WORDS = (
    "password 123456 qwerty letmein welcome admin login abc iloveyou monkey dragon master sunshine princess football baseball shadow "
    "superman batman trustno hello freedom whatever secret test user root default changeme guest example sample pass word token key api "
    "the and for you with that this from have not love computer internet server system summer winter spring autumn january february march "
    "april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday"
).split()
_SHORT = "of to in is it on be as at by he we or an my so do if me up no us go am".split()
_RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *_SHORT, *RANKED]))}
_LONGEST_WORD = max(map(len, _RANK))
#: log10 of the guesses of a space between parts of a value.
_SPACE = 0.3
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./", strict=True))
_KEY = {c: (x + y / 2, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)?\d\d)")
_LONGEST_DATE = 10
_LEET = str.maketrans("@4301!$5+7", "aaeoiisstt")


def _adjacent(a: str, b: str) -> bool:
    p, q = _KEY.get(_SHIFTED.get(a, a)), _KEY.get(_SHIFTED.get(b, b))
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _cardinality(part: str) -> int:
    size = 26 * any(c.islower() for c in part) + 26 * any(c.isupper() for c in part) + 10 * any(c.isdigit() for c in part)
    return max(10, size + 33 * any(not c.isalnum() and c.isascii() for c in part) + 100 * (not part.isascii()))


@lru_cache(maxsize=20_000)
def guess_cost(value: str, enough: float = math.inf) -> tuple[float, tuple[tuple[str, int, int], ...]]:
    """log10 of the guesses of the cheapest segmentation, and its spans (kind, start, end).

    Where the cost reaches ``enough`` whatever follows, a bound of at least that and no spans.
    """
    n = len(value)
    lower = value.lower()
    plain = lower.translate(_LEET)
    brute = math.log10(_cardinality(value))
    best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
    walk = [0] * n  # first place of the keyboard walk that ends here
    for i in range(n):
        walk[i] = walk[i - 1] if i and _adjacent(lower[i - 1], lower[i]) else i
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if m := _DATE.match(value, i):
            dates.setdefault(m.end(), []).append(i)
    runs = [0] * (UNIT + 1)  # for each unit, how many characters before ``end`` equal the one a unit before them
    for end in range(1, n + 1):
        # brute force: one character more on any segmentation, a little more where a span begins
        before = best[end - 1]
        options = [(before[0] + brute + (0.0 if before[2] == "brute" else 0.3), end - 1, "brute")]
        for start in range(max(0, end - _LONGEST_WORD), end - 1):
            rank = _RANK.get(lower[start:end])
            turned = 0.0 if rank else 0.6
            if rank := rank or _RANK.get(plain[start:end]):
                case = 0.0 if value[start:end] == lower[start:end] else 0.3 if value[start + 1 : end] == lower[start + 1 : end] else 1.0
                options.append((best[start][0] + math.log10(rank + 1) + turned + case, start, "word"))
        if value[end - 1] == " ":
            options.append((before[0] + _SPACE, end - 1, "space"))
        for start in dates.get(end, ()):
            options.append((best[start][0] + math.log10(365 * (130 if end - start > 4 else 1)), start, "date"))
        if end - walk[end - 1] >= 3:
            start = walk[end - 1]
            options.append((best[start][0] + math.log10(94 * (end - start) * 4), start, "walk"))
        for unit in range(1, min(UNIT, end - 1) + 1):
            runs[unit] = runs[unit] + 1 if value[end - 1] == value[end - 1 - unit] else 0
            times = runs[unit] // unit + 1
            if times >= 2 and times * unit >= 3:
                start, piece = end - times * unit, value[end - unit : end]
                inner = min(unit * math.log10(_cardinality(piece)), math.log10(_RANK[piece.lower()] + 1) if piece.lower() in _RANK else math.inf)
                options.append((best[start][0] + inner + math.log10(times), start, "repeat"))
        best[end] = min(options)
        if best[end][0] >= enough:
            # any segmentation goes on from a place that a word, date, walk or repeat over ``end`` can begin at
            back = max(_LONGEST_WORD, _LONGEST_DATE, UNIT, end - walk[end - 1], *(r + u for u, r in enumerate(runs)))
            if back < 4096 and (least := min(x[0] for x in best[max(0, end - back) : end + 1])) >= enough:
                return least, ()
    spans, end = [], n
    while end > 0:
        _, start, kind = best[end]
        if kind == "brute" and spans and spans[-1][0] == "brute":
            spans[-1] = ("brute", start, spans[-1][2])
        else:
            spans.append((kind, start, end))
        end = start
    return best[n][0], tuple(reversed(spans))


def _covered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether spans, taken together, hold all of start to end."""
    for s, _, e in sorted(x for x in spans if x[0] < end and start < x[2]):
        if s > start:
            return False
        start = max(start, e)
    return start >= end


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(kind's place in KINDS, start, end, kind) as (start, end, kind), sorted by start, then kind."""
    if not text:
        return []
    out = []
    lower = text.lower()
    names = any(map(lower.__contains__, _NAMES))
    if names:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if names:
        base = list(out)
        for m in _CONTEXT.finditer(text):
            group = m.lastindex
            start, end = m.span(group)
            if not _covered(start, end, base) and guess_cost(m[group], MIN_GUESSES)[0] >= MIN_GUESSES:
                out.append((start, 3, end))
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in batch.column("text"):
            spans = find_spans(text.as_py())
            for kind in KINDS[:3]:
                columns[f"n_{kind}"].append(sum(k == kind for _, _, k in spans))
            base = ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k != "guess")
            columns["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            columns["spans"].append(",".join(f"{k}:{s}:{e}" for s, e, k in spans))
        types = {"base_sha256": pa.string(), "spans": pa.string()}
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {c: pa.array(v, types.get(c, pa.int64())) for c, v in columns.items()})


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, their digest and all spans, for every document."""
    ship(docs.sparkSession)
    ddl = f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(_digest_batches, ddl)


def redacted(text: str | None) -> str | None:
    """The text with every span (overlapping ones together) replaced by the name of its first kind."""
    spans = find_spans(text)
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        parts += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in text, and n_chars (where there is one) counted anew for changed texts."""
    ship(docs.sparkSession)
    counted = "n_chars" in docs.columns

    def change(batches):
        for batch in batches:
            texts = [(x := t.as_py(), redacted(x)) for t in batch.column("text")]
            changed = [i for i, (x, y) in enumerate(texts) if x != y]
            if changed:
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, batch.schema.field(at), pa.array([y for _, y in texts], pa.string()).cast(batch.schema.field(at).type))
                if counted:
                    n = batch.column("n_chars").to_pylist()
                    for i in changed:
                        n[i] = len(texts[i][1])
                    at = batch.schema.get_field_index("n_chars")
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(n, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(change, docs.schema)
