"""The layout of a log: separator, line prefix and line ending, told from a sample of its first bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Bytes of a log that are looked at.
SNIFF_WINDOW = 64 * 1024
SEPARATORS = {"\x01": "soh", "|": "pipe", "^": "caret", ";": "semicolon"}


class SniffError(ValueError):
    """The sample has no layout: code is EmptySample, NoSeparator or NoBeginString."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class LogFormat:
    separator: str = "\x01"
    prefix_len: int = 0
    line_ending: str = "lf"
    encoding: str = "utf8"
    boundary: str = "line"

    @property
    def prefix_kind(self) -> str:
        return "fixed" if self.prefix_len else "none"

    @property
    def separator_name(self) -> str:
        return SEPARATORS.get(self.separator, "other")


def sniff(sample: bytes) -> LogFormat:
    """The separator is the candidate that most often stands before `digits=`, the first of equal ones; the prefix is the place of `8=FIX` in a line, if it is
    the same in all lines that have it."""
    if not sample:
        raise SniffError("EmptySample")
    counts = {s: len(re.findall(re.escape(s.encode()) + rb"[0-9]+=", sample)) for s in SEPARATORS}
    separator = max(counts, key=counts.get)
    if not counts[separator]:
        raise SniffError("NoSeparator")
    places = {line.find(b"8=FIX") for line in sample.split(b"\n")} - {-1}
    if not places:
        raise SniffError("NoBeginString")
    return LogFormat(separator, places.pop() if len(places) == 1 else 0, "crlf" if b"\r\n" in sample else "lf")
