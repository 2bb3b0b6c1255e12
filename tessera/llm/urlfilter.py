"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one bit vector of 64-bit words, a start bit and a bit per literal for each rule.
One Shift-And step per byte simulates all rules at once: shift left by one (with carries between words), keep the
bits whose literal is the byte, and keep bits that a following `*` lets stand still. As many URLs run side by side as
STATE_BYTES of state allow. Time is (URL bytes) x (words of the automaton), whatever the rules look like.

A URL's canonical form is its host, lower-cased, a separator byte that UTF-8 never has, and its path. A rule is a pair
of globs, host and path; `*` in a host glob doesn't cross the separator. Domain rules (`example.net/en/`: this host
and all subdomains, paths with this prefix) become two globs each; of those that fit, the longest rule wins. URLs that
no domain rule fits are blocked if any pattern of the block list fits and allowed otherwise.

Defined cases: a null URL or one without `://` has empty host and path, which no domain rule fits; empty and very long
URLs, repeated rows and empty tables need no special care; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .shared import own_columns, ship

SEPARATOR = 0xFF
#: Bytes of automaton state (its words and its rules, for each URL) held at once.
STATE_BYTES = 64 << 20
#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Host and path globs of what is blocked where no domain rule fits.
BLOCKED = (("ads.*", "*"), ("*.ads.*", "*"), ("*", "*/ads/*"), ("*", "*/track*.gif"), ("*", "*/login*"), ("*", "*/cgi-bin/*"), ("*", "*.exe"), ("*casino*", "*"))
ship(k.__name__)
ship(__name__)


class Automaton:
    """Masks of a list of (host glob, path glob) pairs."""

    def __init__(self, globs: Sequence[tuple[str, str]]):
        literals: list[int] = []  # by bit; -1 is a start bit
        stays: list[tuple[int, bool]] = []  # (bit, whether it may stay over the separator)
        starts, finals = [], []
        for host, path in globs:
            starts.append(len(literals))
            literals.append(-1)
            for part, in_path in ((host, False), (None, True), (path, True)):
                for b in [SEPARATOR] if part is None else part.encode():
                    if part is not None and b == ord("*"):
                        stays.append((len(literals) - 1, in_path))
                    else:
                        literals.append(b)
            finals.append(len(literals) - 1)
        self.words = len(literals) // 64 + 1
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        bit = lambda i: (i // 64, np.uint64(1) << np.uint64(i % 64))
        for i, b in enumerate(literals):
            if b >= 0:
                w, m = bit(i)
                self.step[b, w] |= m
        for i, in_path in stays:
            w, m = bit(i)
            self.stay[:, w] |= m
            if not in_path:
                self.stay[SEPARATOR, w] &= ~m
        self.start = np.zeros(self.words, np.uint64)
        for i in starts:
            w, m = bit(i)
            self.start[w] |= m
        self.finals = np.array(finals)

    def side_by_side(self) -> int:
        """How many strings may run at once."""
        return max(1, STATE_BYTES // (8 * self.words + len(self.finals)))

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which of the globs fit each of the byte strings, as a matrix of booleans."""
        n = np.diff(offsets)
        order = np.argsort(-n, kind="stable")
        length = n[order]
        state = np.repeat(self.start[None, :], len(n), axis=0)
        begin = offsets[:-1][order]
        live = len(n)
        for i in range(int(length[0]) if len(n) else 0):
            while live and length[live - 1] <= i:
                live -= 1
            own = state[:live]
            byte = data[begin[:live] + i]
            moved = own << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= own[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (own & self.stay[byte])
        fit = np.zeros((len(n), len(self.finals)), bool)
        fit[order] = (state[:, self.finals // 64] >> (self.finals % 64).astype(np.uint64)) & np.uint64(1) != 0
        return fit


def _rule_globs(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    out = []
    for rule, _ in rules:
        host, slash, path = rule.partition("/")
        out += [(host, slash + path + "*"), ("*." + host, slash + path + "*")]
    return out


def _judge(rules: Sequence[tuple[str, str]], blocked: Sequence[tuple[str, str]]):
    automaton = Automaton([*_rule_globs(rules), *blocked])
    many = automaton.side_by_side()
    longest = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0]), rules[i][0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[], []]
            for _, _, data, offsets in k.slices(batch.column(3)):
                for i in range(0, len(offsets) - 1, many):
                    fit = automaton.run(data, offsets[i : i + many + 1])
                    rule = np.full(len(fit), -1)
                    for r in reversed(longest):
                        rule[fit[:, 2 * r] | fit[:, 2 * r + 1]] = r
                    block = fit[:, 2 * len(rules) :].any(axis=1)
                    for r, b in zip(rule.tolist(), block.tolist()):
                        columns[0].append(rules[r][0] if r >= 0 else None)
                        columns[1].append(rules[r][1] if r >= 0 else "block" if b else "allow")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, blocked: Sequence[tuple[str, str]] = BLOCKED) -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict (allow or block) of every row."""
    from .shared import ascii_lower

    url = F.coalesce(F.col("url"), F.lit(""))
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    kind = pages.schema["page_id"].dataType.simpleString()
    parts = own_columns(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    canonical = F.concat(F.encode("host", "UTF-8"), F.unhex(F.lit("FF")), F.encode("path", "UTF-8"))
    return parts.select("page_id", "host", "path", canonical.alias("canonical")).mapInArrow(_judge(rules, blocked), f"page_id {kind}, host string, path string, rule string, verdict string")
