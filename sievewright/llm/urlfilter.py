"""URL filters by a bit-parallel wildcard automaton.

Every rule becomes a glob over the canonical string "." + host + path: `*` stands for any run without "/", `**` for any
run. A Shift-And automaton holds one bit for each state of each glob in as many 64-bit words as are needed, and steps all
globs over all URLs of a batch at once, one character position after the other.

Edge cases: a null url, an empty one and one without "://" have an empty host and path and match no host rule; the empty
table gives an empty result; repeated rows are judged one by one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict for a host, its subdomains and the paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


#: Bytes of strings that the automaton holds at once, filled up to the longest.
ROOM = 4 << 20

#: Globs over "." + host + path that block a URL which no host rule judges.
BLOCKED_GLOBS = ("**/ads/**", "**/login/**", "**/cgi-bin/**", "**.exe", "**.zip", "**.swf")


def parse_glob(glob: str) -> list[int]:
    """Byte values, with -1 for `*` and -2 for `**`."""
    raw, out, i = glob.encode(), [], 0
    while i < len(raw):
        if raw[i : i + 2] == b"**":
            out.append(-2)
            i += 2
        else:
            out.append(-1 if raw[i] == 42 else raw[i])
            i += 1
    return out


class Automaton:
    """All globs at once. State j of a glob: its first j literals are consumed; a wildcard after them loops on state j."""

    def __init__(self, globs: Sequence[str]) -> None:
        spans, bits = [], 0
        parsed = [parse_glob(g) for g in globs]
        for tokens in parsed:
            spans.append(bits)
            bits += 1 + sum(t >= 0 for t in tokens)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final = []
        for base, tokens in zip(spans, parsed, strict=True):
            at = base
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for t in tokens:
                if t >= 0:
                    at += 1
                    self.step[t, at // 64] |= np.uint64(1 << at % 64)
                else:
                    some = np.ones(256, bool)
                    some[47] = t == -2
                    self.loop[some, at // 64] |= np.uint64(1 << at % 64)
            self.final.append(at)

    def match(self, strings: list[bytes], room: int = ROOM) -> np.ndarray:
        """A boolean for each string and glob: does the glob match the whole string? Strings of like length go together, so that
        a group takes `room` bytes, or those of its one string."""
        out = np.empty((len(strings), len(self.final)), bool)
        order = sorted(range(len(strings)), key=lambda i: -len(strings[i]))
        at = 0
        while at < len(order):
            group = order[at : at + max(1, room // max(1, len(strings[order[at]])))]
            out[group] = self.match_group([strings[i] for i in group])
            at += len(group)
        return out

    def match_group(self, strings: list[bytes]) -> np.ndarray:
        n = len(strings)
        size = np.fromiter(map(len, strings), np.int64, n)
        order = np.argsort(-size, kind="stable")
        longest = int(size.max()) if n else 0
        chars = np.zeros((n, longest), np.uint8)
        flat = np.frombuffer(b"".join(strings[i] for i in order), np.uint8)
        chars[np.arange(longest) < size[order][:, None]] = flat
        state = np.tile(self.start, (n, 1))
        active = np.searchsorted(-size[order], -np.arange(longest), side="left")
        one, top = np.uint64(1), np.uint64(63)
        for j in range(longest):
            k = int(active[j])
            c, now = chars[:k, j], state[:k]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:k] = (moved & self.step[c]) | (now & self.loop[c])
        out = np.empty((n, len(self.final)), bool)
        for g, at in enumerate(self.final):
            out[order, g] = (state[:, at // 64] >> np.uint64(at % 64)) & one
        return out


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    blocked: Sequence[str] = BLOCKED_GLOBS,
    key: str = "page_id",
    url: str = "url",
    otherwise: str = "allow",
) -> DataFrame:
    """key, host, path, the longest rule that fits (else null) and the verdict: the rule's, else block if one of the
    globs in `blocked` matches, else `otherwise`. Rules of equal length: the one listed first. Also: glob, the blocking one."""
    rules = sorted(rules, key=lambda r: -len(r.name))
    globs = [*(r.glob for r in rules), *blocked]
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))

    def make():
        automaton = Automaton(globs)

        def step(batch: dict[str, list]) -> dict[str, list]:
            canon = [f".{h}{p}".encode() for h, p in zip(batch["host"], batch["path"], strict=True)]
            hits = automaton.match(canon)
            rule, verdict, glob = [], [], []
            for row in hits:
                first = int(row.argmax()) if row.any() else -1
                ruled = 0 <= first < len(rules)
                rule.append(rules[first].name if ruled else None)
                glob.append(globs[first] if first >= len(rules) else None)
                verdict.append(rules[first].verdict if ruled else "block" if first >= 0 else otherwise)
            return {**batch, "rule": rule, "verdict": verdict, "glob": glob}

        return step

    kind = dict(parts.dtypes)["key"]
    out = map_rows(parts, make, f"key {kind}, host string, path string, rule string, verdict string, glob string")
    return out.withColumnRenamed("key", key)
