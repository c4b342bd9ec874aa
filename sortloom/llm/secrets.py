"""Secret scans: fixed patterns, and a password guess-cost dynamic programme.

The patterns give the base spans. Beside them, each value in a credential context
(a word such as password, then ``:`` or ``=``) is judged by the cheapest way to guess
it: the value is segmented into dictionary words (the words of two public vocabularies,
ranked as these rank them, after a few that guessers try first), dates, repeats, keyboard walks and
brute-force stretches, each with a cost in bits, and dynamic programming finds the
segmentation of least cost. A value of at least ``GUESS_BITS`` bits is a secret and
gives a span of kind ``guess``; base spans stay, whatever their values cost. So of two
assignments that the patterns find alike, only the one whose value is hard to guess has a
guess span.

Edge cases: null and empty texts have no spans; offsets are code points of the text. A
very long text or value is judged whole, in steps in proportion to its length. Equal texts
have equal spans, repeated rows give repeated rows; spans that begin together are in the
order of KINDS. An empty table gives an empty result. Of other columns none is read;
redact_documents gives them back unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidy

GUESS_BITS = 30.0
KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# a keyword may follow letters, as in ASSIGN: dbPassword, CLIENTSECRET
CONTEXT = re.compile(r"(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?)[\"']?[\x20\t]*[:=][\x20\t]*[\"']?([^\s\"']{6,})", re.I | re.A)
HINTS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "credential")

# Words that guessers try first, in order of rank.
WORDS = (
    "password the and you that for with this from have are not your all new one can was welcome admin login secret "
    "letmein monkey dragon master hello shadow sunshine princess football baseball iloveyou trustno superman batman "
    "qwerty abc love test guest user root pass change default temp summer winter spring autumn monday friday january "
    "february march april may june july august september october november december hunter killer pepper cookie flower "
    "orange purple silver golden happy lucky magic angel charlie jordan michael jessica thomas daniel ashley key token "
    "access service server database example sample demo company office home phone computer internet house garden money "
    "correct horse battery staple none null true false value string here text"
).split()
#: Letters that a word of the vocabularies has at least: shorter ones are mostly fragments.
LEAST_LETTERS = 4
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
# Rows of a keyboard and of the alphabet.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0987654321", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")
#: Neighbouring keys: the rows they stand on, and 1 or -1 for the direction.
NEXT = {
    pair: frozenset((k, way) for k, row in enumerate(ROWS) for way, keys in ((1, row), (-1, row[::-1])) if "".join(pair) in keys)
    for row in ROWS for a, b in zip(row, row[1:], strict=False) for pair in ((a, b), (b, a))
}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
YEAR_BITS, DAY_BITS = math.log2(130), math.log2(365)


@lru_cache(1)
def _ranks() -> tuple[dict[str, int], int]:
    """Words by rank, and the length of the longest: WORDS, then whole words (those that
    begin with a space) of the public vocabularies, by the better of their ranks."""
    import base64
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found = {t[1:]: i for t, i in json.load(f)["model"]["vocab"].items() if t[:1] == "\u0120" and t[1:].isascii()}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        for line in f:
            token, i = line.split()
            word = base64.b64decode(token).decode("utf-8", "ignore")
            if word[:1] == " ":
                found[word[1:]] = min(int(i), found.get(word[1:], int(i)))
    words = [w.lower() for w in sorted(found, key=found.__getitem__) if len(w) >= LEAST_LETTERS and w.isalpha()]
    ranks: dict[str, int] = {}
    for w in [*WORDS, *words]:
        ranks.setdefault(w, len(ranks) + 1)
    return ranks, max(map(len, ranks))


def _alphabet(value: str) -> float:
    """Bits of one brute-force character: of the classes that the value has."""
    size = 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 10 * any("0" <= c <= "9" for c in value) + 33 * any(not c.isalnum() for c in value) + 100 * any(c.isalnum() and c > "\x7f" for c in value)
    return math.log2(max(size, 10))


def _steps(a: str, b: str) -> frozenset[tuple[int, int]]:
    """Rows, with the direction, on which b stands next to a."""
    return NEXT.get((a, b), frozenset())


def guess_bits(value: str) -> float:
    """Bits to guess a value by its cheapest segmentation, whatever its length: each kind
    of segment is relaxed in a bounded number of steps a character.

    A repeat of a unit costs the unit and how often it may stand in the value; a walk
    costs its first key, its length, and two bits for each change of direction."""
    n, each, low = len(value), _alphabet(value), value.lower()
    plain = low.translate(LEET)
    if len(low) != n or not n:  # a letter that grows in lower case: no word, date, repeat or walk is looked for
        return each * n
    ranks, longest = _ranks()
    best = [0.0] + [math.inf] * n
    brute = [math.inf] * (n + 1)
    walk = [math.inf] * (n + 1)
    units = [u for u in range(1, 9) if 2 * u <= n]
    again = {u: [math.inf] * (n + 1) for u in units}
    walk_bits = math.log2(47 * max(3, n)) + 1

    def start(i: int) -> float:
        return best[i] + (1.0 if i else 0.0)  # where a segment begins has to be guessed too

    for j in range(1, n + 1):
        # segments that end at j and are told by their last characters
        brute[j] = min(brute[j - 1], start(j - 1)) + each
        found = min(best[j], brute[j])
        for u in units:
            if 2 * u <= j and low[j - u : j] == low[j - 2 * u : j - u]:
                again[u][j] = min(again[u][j - u], start(j - 2 * u) + each * u + math.log2(max(2, n // u)))
                found = min(found, again[u][j])
        if j >= 3:
            step, before = _steps(low[j - 2], low[j - 1]), _steps(low[j - 3], low[j - 2])
            if step and before:
                turn = 0.0 if step & before else 2.0
                walk[j] = min(walk[j - 1], start(j - 3) + walk_bits) + turn
                found = min(found, walk[j])
        best[j] = found
        # segments that begin at j - 1 or, for the first character, at 0
        for i in (j,) if j > 1 else (0, 1):
            at = start(i)
            if value[i : i + 1].isdigit():
                for k in range(i + 4, min(n, i + 10) + 1):
                    if DATE.fullmatch(value, i, k):
                        best[k] = min(best[k], at + YEAR_BITS + (DAY_BITS + 2 if k - i > 4 else 0))
            # dictionary words, upper case and substitutions costing a little more
            for k in range(i + 3, min(n, i + longest) + 1):
                rank = ranks.get(low[i:k]) or ranks.get(plain[i:k])
                if rank:
                    upper = sum(c.isupper() for c in value[i:k])
                    swaps = sum(a != b for a, b in zip(low[i:k], plain[i:k], strict=True)) if low[i:k] not in ranks else 0
                    variants = (1.0 if upper in (1, k - i) else math.log2(math.comb(k - i, upper) + 1)) if upper else 0.0
                    best[k] = min(best[k], at + math.log2(rank) + variants + swaps + 1)
    return best[n]


def scan(text: str, bits: float = GUESS_BITS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, as (start, kind's place in KINDS, end), in order."""
    base: list[tuple[int, int, int]] = []
    low = text.lower()
    context = any(h in low for h in HINTS)
    if context:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    spans = list(base)
    if context:
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:)]}>")
            a, b = m.start(1), m.start(1) + len(value)
            if len(value) >= 6 and guess_bits(value) >= bits:
                spans.append((a, 3, b))
        spans.sort()
    return base, spans


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("n_guess", T.LongType()),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


def find_secrets(docs: DataFrame, bits: float = GUESS_BITS) -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t or "", bits) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in spans) for _, spans in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([written(s) for _, s in found], pa.string())], SCHEMA.names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), SCHEMA)


PLACEHOLDER = "[SECRET]"


def redact(text: str, bits: float = GUESS_BITS) -> str:
    """The text with each stretch that spans cover replaced by PLACEHOLDER."""
    out, at, open_end = [], 0, -1
    for a, _, b in scan(text, bits)[1]:
        if a < open_end:
            if b > open_end:
                at = open_end = b
            continue
        out += [text[at:a], PLACEHOLDER]
        at = open_end = b
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, bits: float = GUESS_BITS) -> DataFrame:
    """docs with secrets replaced in text, and n_chars following it; other columns,
    nulls included, as they are."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            old = cols[at].to_pylist()
            new = [None if t is None else redact(t, bits) for t in old]
            cols[at] = pa.array(new, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, cols[k].to_pylist(), strict=True)], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(tidy(run), docs.schema)
