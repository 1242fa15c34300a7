"""Secret scans: three patterns, and a test of token efficiency that finds further random strings.

The base kinds are assign (a value given to a password, token, key or the like), access (an access key's identifier) and hex
(a long run of lower-case hexadecimal digits). Beyond them, a run of at least `MIN_RUN` characters of the base-64 and URL
alphabets is a span of kind random if it, or a part of it that is as long, has at most `MAX_RATIO` characters per token under a
public byte-level vocabulary: words take few tokens and random strings many. Known digests (hexadecimal runs of a digest's length),
UUIDs, dates, numbers, addresses and dotted, underscored or slashed identifiers of ordinary words are excluded, as
is any run that a base span touches. Base spans always stay.

Defined cases: a null or empty text has no spans, and the digest of an empty string; offsets are code points; rows are
independent; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import public_tokenizers
from pyspark.sql import DataFrame

from fixlake.llm.bpe import VOCABULARY, BytePairs, read_ranks
from fixlake.llm.common import per_row

# Fixed values
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 characters and more, since runs are whole
LEAST = {"assign": 6, "access": 20}
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)

MIN_RUN = 20
MAX_RATIO = 2.2
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_ANY_HEX = re.compile(r"[0-9a-fA-F]+")
_SEPARATORS = re.compile(r"[/_=+-]+")
_WORD_OR_NUMBER = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, kind, end) of the base kinds, in order."""
    found, lower = [], text.lower()
    if any(word in lower for word in ("passw", "secret", "token", "apikey", "api_key")):  # else no match is possible
        found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def digest(run: str) -> bool:
    return bool(_ANY_HEX.fullmatch(run)) and len(run) in DIGEST_LENGTHS


def ordinary(run: str) -> bool:
    """Whether a run is a known digest, a number, or an identifier of words and numbers."""
    if digest(run) or not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
        return True
    return all(_WORD_OR_NUMBER.fullmatch(part) for part in _SEPARATORS.split(run) if part)


def suspects(run: str) -> list[str]:
    """What of a run the ratio is taken over: all but its UUIDs, unless that is ordinary; each stretch of parts between separators
    that are no words or numbers; and each long part that has a letter and is no digest, as random letters look like a word."""
    rest = _UUID.sub("/", run).strip("/_=+-") if _UUID.search(run) else run
    found, stretch = [] if ordinary(rest) else [rest], []
    for part in [*_SEPARATORS.split(rest), ""]:
        if part and not _WORD_OR_NUMBER.fullmatch(part) and not digest(part):
            stretch.append(part)
        else:
            found += ["/".join(stretch)] if stretch and not ordinary("/".join(stretch)) else []
            stretch = []
        if re.search("[A-Za-z]", part) and not digest(part):
            found.append(part)
    return [x for x in found if len(x) >= MIN_RUN]


class Scanner:
    def __init__(self, coder: BytePairs, max_ratio: float):
        self.coder, self.max_ratio = coder, max_ratio

    def random_spans(self, text: str, taken: list[tuple]) -> list[tuple[int, int, str, int]]:
        found, starts, most = [], [start for start, _, _, _ in taken], []
        for _, _, _, end in taken:  # the furthest end of the base spans so far
            most.append(max(end, most[-1]) if most else end)
        for m in _RUN.finditer(text):
            before = bisect.bisect_left(starts, m.end())
            if before and most[before - 1] > m.start():
                continue
            if any(len(x) <= self.max_ratio * len(self.coder.encode(x)) for x in suspects(m[0])):
                found.append((m.start(), 3, "random", m.end()))
        return found

    def scan(self, text: str | None) -> tuple:
        base = base_spans(text or "")
        every = sorted(base + self.random_spans(text or "", base))
        join = lambda spans: ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
        counts = [sum(s[2] == kind for s in every) for kind in ("assign", "access", "hex", "random")]
        return (*counts[:3], hashlib.sha256(join(base).encode()).hexdigest(), join(every), counts[3])


def scan_secrets(
    df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, max_ratio: float = MAX_RATIO
) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_random) of each row."""
    coder = df.sparkSession.sparkContext.broadcast(BytePairs(read_ranks(vocabulary or public_tokenizers.path(VOCABULARY))))
    return per_row(
        df, [key, text], lambda k, t, scanner: (k, *scanner.scan(t)),
        f"{key} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long",
        lambda: {"scanner": Scanner(coder.value, max_ratio)},
    )
