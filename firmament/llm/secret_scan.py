"""Secret scan: fixed patterns, and values in credential contexts judged by
the cost of guessing them.

Base spans come from three patterns (kinds assign, access, hex).  The method
adds kind ``guess``: the value after a credential word and ``:`` or ``=`` (or
the password in a ``user:password@`` address) is cut into dictionary words,
dates, repeats, sequences, keyboard walks and brute-force runs so that the
product of their guesses is least, by dynamic programming over the positions;
a value whose cost reaches ``MIN_LOG10`` is a secret.  The dictionary is a
ranked word list, e.g. a public tokenizer's vocabulary (its ranks follow
frequency), bounded by ``max_words``.

Each text is one row and independent; the UDF gets a hundred rows at a time.

Defined results: null and empty texts have no spans; repeated rows get equal
rows; null ids are carried; very long values cost time in proportion to their
length; empty tables give no rows; other columns are ignored or, in
``redact``, kept.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.llm.store import unused

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so this is the runs of 32 or more
#: letter to mark what a byte can be part of, for a quick look whether HEX can match
_HEX_BYTE = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_HEX_RUN = b"\x01" * 32

# Words that announce a credential, and their surroundings.
CONTEXT_WORDS = (
    "password passwd passphrase passcode pass pwd pw secret token credential credentials auth authorization bearer "
    "login apikey api_key api-key access_key access-key secret_key secret-key private_key private-key client_secret "
    "client-secret encryption_key signing_key session_key pin otp"
).split()
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:%s)["']?\x20*(?::=|=>|[:=])\x20*["'`]?([^\s"'`<>,;|(){}\[\]]+)""" % "|".join(sorted(map(re.escape, CONTEXT_WORDS), key=len, reverse=True)),
    re.I | re.A,
)
ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://[^\s:/?#@]+:([^\s/?#@]+)@", re.I | re.A)
QUICK = re.compile("pass|pw|secret|token|credential|auth|bearer|login|key|pin|otp|://", re.I | re.A)

# Frequent passwords, in order of frequency.
COMMON = (
    "123456 password 123456789 12345678 12345 qwerty 1234567 111111 123123 abc123 1234567890 password1 iloveyou "
    "000000 1234 monkey dragon letmein sunshine princess admin welcome football master shadow superman michael login "
    "passw0rd trustno1 hello freedom whatever starwars secret changeme default root guest test user example sample "
    "placeholder yourpassword none null true false undefined xxxx todo"
).split()
# Rows of a keyboard, and characters that stand for letters.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
LEET = str.maketrans("@4831!|05$7+2", "aaebiilosstt" + "z")

MIN_LOG10 = 10.0  # guesses from which a value is a secret
MIN_CHARS = 8
LONGEST_WORD = 24
_MONTH, _DAY, _YEAR = r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])", r"(?:19|20)\d\d"
DATES = tuple(
    re.compile(p)
    for p in (rf"{_YEAR}([-/._]?){_MONTH}\1{_DAY}", rf"{_DAY}([-/._]?){_MONTH}\1{_YEAR}", rf"{_MONTH}([-/._]?){_DAY}\1{_YEAR}", _YEAR)
)
DATE_GUESSES = math.log10(365.25 * 120 * 2)
SEGMENT = math.log10(2)  # for where each segment ends


def _neighbours() -> dict[str, str]:
    """Keys next to each key: the row's own and the slanted ones above and below."""
    near: dict[str, str] = {}
    for r, row in enumerate(KEYBOARD):
        for c, key in enumerate(row):
            at = [(r, c - 1), (r, c + 1), (r - 1, c), (r - 1, c + 1), (r + 1, c - 1), (r + 1, c)]
            near[key] = "".join(KEYBOARD[y][x] for y, x in at if 0 <= y < len(KEYBOARD) and 0 <= x < len(KEYBOARD[y]))
    return near


NEAR = _neighbours()


def dictionary(vocabulary: str | None = None, max_words: int = 50_000) -> dict[str, int]:
    """Word to rank: the frequent passwords, then a vocabulary file's words of
    three letters or more by rank (``tiktoken`` format; None: the passwords only).
    A file that is named must be there: costs depend on it."""
    words = list(COMMON)
    if vocabulary is not None:
        for line in Path(vocabulary).read_bytes().splitlines():
            word = base64.b64decode(line.split()[0]).decode("utf-8", "replace").strip().lower()
            if len(word) >= 3 and word.isalpha():
                words.append(word)
    return {w: i + 1 for i, w in enumerate(dict.fromkeys(words[:max_words]))}


def _alphabet(value: str) -> float:
    """log10 of the characters that brute force must try at each place."""
    size = 10 * any("0" <= c <= "9" for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    return math.log10(max(10, size + 33 * any(not c.isalnum() for c in value) + 100 * any(ord(c) > 127 for c in value)))


def segments(value: str, words: dict[str, int]) -> list[list[tuple[int, float, str]]]:
    """For each end, the (start, log10 guesses, kind) of the patterns that end there."""
    # one character for one: some have a longer lower case
    n, low = len(value), "".join(c if len(d := c.lower()) > 1 else d for c in value)
    plain, keys = low.translate(LEET), low.translate(SHIFTED)
    ends: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank, extra = words.get(low[i:j]), 0.0
            if rank is None and (rank := words.get(plain[i:j])) is not None:
                extra = math.log10(4)  # letters written as digits or signs
            if rank is None and (rank := words.get(low[i:j][::-1])) is not None:
                extra = math.log10(2)
            if rank is not None:
                upper = sum(c.isupper() for c in value[i:j])
                case = 0.0 if not upper else math.log10(2) if value[i].isupper() and upper == 1 or upper == j - i else math.log10(math.comb(j - i, upper) + 1)
                ends[j].append((i, math.log10(rank + 1) + extra + case, "word"))
        if low[i].isdigit():
            for date in DATES:
                if m := date.match(low, i):
                    ends[m.end()].append((i, DATE_GUESSES, "date"))
    # runs: each is offered from its start to its end, and for the last characters of every prefix
    for kind, joins, guesses in (
        ("repeat", lambda a, b: value[a] == value[b], lambda k: math.log10(95 * k)),
        ("sequence", lambda a, b: ord(low[b]) - ord(low[a]) in (1, -1) and low[a].isalnum() and low[b].isalnum(), lambda k: math.log10(30 * k)),
        ("walk", lambda a, b: keys[b] in NEAR.get(keys[a], ""), lambda k: math.log10(47) + 0.45 * k),
    ):
        start = 0
        for j in range(1, n + 1):
            if j < n and joins(j - 1, j):
                continue
            if j - start >= 3:
                ends[j].append((start, guesses(j - start), kind))
            start = j
    # a unit of two to eight characters written again and again
    for k in range(2, 9):
        start = 0
        for j in range(k, n + 1):
            if j < n and value[j] == value[j - k]:
                continue
            if j - start >= 2 * k:
                ends[j].append((start, k * _alphabet(value[start : start + k]) + math.log10((j - start) / k), "repeat"))
            start = max(start + 1, j - k + 1)
    return ends


def guess_cost(value: str, words: dict[str, int]) -> tuple[float, list[tuple[int, int, str]]]:
    """Least log10 guesses of a value, and its segments (start, end, kind)."""
    each, ends = _alphabet(value), segments(value, words)
    # least cost of each prefix, and of those that end in a brute-force run; the last segment of both
    best, how = [0.0], [(0, "")]
    brute, begun = math.inf, 0
    for j in range(1, len(value) + 1):
        if best[j - 1] + SEGMENT < brute:
            brute, begun = best[j - 1] + SEGMENT, j - 1
        brute += each
        cost, step = brute, (begun, "brute")
        for i, guesses, kind in ends[j]:
            if best[i] + guesses + SEGMENT < cost:
                cost, step = best[i] + guesses + SEGMENT, (i, kind)
        best.append(cost)
        how.append(step)
    cuts, j = [], len(value)
    while j:
        i, kind = how[j]
        cuts.append((i, j, kind))
        j = i
    return best[-1], cuts[::-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    low, out = text.lower(), []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEX_RUN in text.encode("latin-1", "replace").translate(_HEX_BYTE):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def guess_spans(text: str, words: dict[str, int], min_log10: float, taken: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], float | None]:
    """Values in credential contexts that are hard to guess and lie outside
    ``taken``; and the greatest cost of all such values, ``taken`` or not (None:
    there is none of ``MIN_CHARS`` characters)."""
    if not QUICK.search(text):
        return [], None
    found = {m.span(1) for p in (CONTEXT, ADDRESS) for m in p.finditer(text)}
    out, last, most = [], 0, None
    blocked, at, reach = sorted(taken), 0, 0  # ``reach``: the furthest end of those that start before this value's
    for start, end in sorted(found):
        value = text[start:end].rstrip(".!?:=&")
        end = start + len(value)
        while at < len(blocked) and blocked[at][0] < start:
            reach = max(reach, blocked[at][1])
            at += 1
        clash = reach > start or (at < len(blocked) and blocked[at][0] < end)
        if len(value) < MIN_CHARS or "://" in value:
            continue
        cost = guess_cost(value, words)[0]
        most = cost if most is None else max(most, cost)
        if cost >= min_log10 and start >= last and not clash:
            out.append((start, end, "guess"))
            last = end
    return out, most


def priced(text: str | None, words: dict[str, int], min_log10: float = MIN_LOG10) -> tuple[list[tuple[int, int, str]], float | None]:
    """All spans of a text by start, then kind as listed in KINDS; and the
    greatest guess cost of its credential values."""
    text = text or ""
    spans = base_spans(text)
    guesses, most = guess_spans(text, words, min_log10, spans)
    return sorted(spans + guesses, key=lambda s: (s[0], KINDS.index(s[2]))), most


def scan(text: str | None, words: dict[str, int], min_log10: float = MIN_LOG10) -> list[tuple[int, int, str]]:
    return priced(text, words, min_log10)[0]


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span, overlaps merged, written as [SECRET]."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, words: dict[str, int], id_col: str = "doc_id", text_col: str = "text", min_log10: float = MIN_LOG10) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_guess,
    base_sha256, spans (kind:start:end, code points, end exclusive) and
    max_guess_log10 (of all credential values, those in base spans too)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # max_words entries

    def of(text):
        spans, most = priced(text, shared.value, min_log10)
        base = joined([s for s in spans if s[2] != "guess"])
        n = [sum(s[2] == k for s in spans) for k in KINDS]
        return (*n, hashlib.sha256(base.encode()).hexdigest(), joined(spans), most)

    fields = ", ".join(f"n_{k} bigint" for k in KINDS)
    found = F.udf(of, f"struct<{fields}, base_sha256 string, spans string, max_guess_log10 double>".replace(" bigint", ":bigint").replace(" string", ":string").replace(" double", ":double"))
    return docs.select(F.col(id_col).alias("doc_id"), found(F.col(text_col)).alias("found")).select("doc_id", "found.*")


def redact(docs: DataFrame, words: dict[str, int], text_col: str = "text", chars_col: str | None = "n_chars", min_log10: float = MIN_LOG10) -> DataFrame:
    """The documents, all of them, with secrets written as [SECRET] and the
    character count of changed texts renewed; other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def of(text):
        spans = scan(text, shared.value, min_log10)
        return redacted(text, spans) if spans else None

    new = unused(docs, "redacted")
    out = docs.withColumn(new, F.udf(of, "string")(F.col(text_col)))
    if chars_col and chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(new).isNotNull(), F.char_length(new).cast(kind)).otherwise(F.col(chars_col)))
    return out.withColumn(text_col, F.coalesce(new, F.col(text_col))).select(*docs.columns)
