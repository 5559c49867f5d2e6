"""Secret scans: fixed patterns, and a token-efficiency test for strings that look random.

A byte-level vocabulary spends few characters a token on strings that no text contains. Runs of key-like characters whose
ratio of characters to tokens is low are reported as `random`, unless they are digests of a known length, UUIDs, or
identifiers whose parts are words of the vocabulary and short numbers. Keys of one case, or of letters only, are tested like others.

Edge cases: a null text counts as empty and has no spans; offsets count code points, the end is exclusive; spans of one
kind never overlap; a random span never overlaps a span of the fixed patterns; repeated rows are scanned one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, map_rows

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Lengths in hex digits of the digests in common use: CRC-64 to SHA-512.
DIGEST_LENGTHS = {16, 32, 40, 48, 56, 64, 96, 128}
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
SEPARATORS = re.compile(r"[-_/+=]+")
#: A part between separators: words of three letters or more held together by camel case, then or else a short number. Where
#: its words end is certain, so that nothing is tried again and time is linear.
PART = re.compile(r"(?:[A-Z]?[a-z]{3,}+|[A-Z]{3,}(?![a-z]))*+[0-9]{0,4}")
#: Characters that are encoded at once, so that time is linear in very long runs.
ENCODED = 4096
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CHARS_PER_TOKEN = 2.0


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


REMEMBERED.append(vocabulary.cache_clear)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, kinds as places in KINDS, in order."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_identifier(s: str, enc: tiktoken.Encoding) -> bool:
    """Whether the parts between separators are short numbers and words that cost at most a token for CHARS_PER_TOKEN characters."""
    parts = [x for x in SEPARATORS.split(s) if x]
    if not all(PART.fullmatch(x) for x in parts):
        return False
    return all(len(w) >= CHARS_PER_TOKEN * n_tokens(w, enc) for x in parts for w in WORD.findall(x))


def n_tokens(s: str, enc: tiktoken.Encoding) -> int:
    """Tokens of s, each ENCODED characters on their own."""
    return sum(len(enc.encode_ordinary(s[i : i + ENCODED])) for i in range(0, len(s), ENCODED))


def is_known(s: str, enc: tiktoken.Encoding) -> bool:
    """Digests, UUIDs, identifiers and strings without a letter carry no secret by themselves."""
    if (len(s) in DIGEST_LENGTHS and DIGEST.fullmatch(s)) or UUID.fullmatch(s):
        return True
    return not any(c.isalpha() for c in s) or is_identifier(s, enc)


def random_spans(text: str, taken: list[tuple[int, int, int]], enc: tiktoken.Encoding, ratio: float) -> list[tuple[int, int, int]]:
    """Random strings that meet none of `taken`, which is in order."""
    found, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][2])
            i += 1
        if reach <= s and (e - s) / n_tokens(m[0], enc) < ratio:
            if not is_known(m[0], enc):
                found.append((s, 3, e))
    return found


def scan_secrets(
    docs: DataFrame,
    vocabulary_path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    ratio: float = CHARS_PER_TOKEN,
) -> DataFrame:
    """key, text, spans: an array of (kind, start, end), ordered by start and then by kind. A null text has no spans; long texts are
    scanned whole, in linear time; rows that repeat are scanned each. An empty table gives no rows. Columns beside the identifier and the
    text are not read, whatever their names."""

    def make():
        enc = vocabulary(vocabulary_path, pattern)

        def step(batch: dict[str, list]) -> dict[str, list]:
            spans = []
            for t in batch["text"]:
                found = base_spans(t) if t else []
                found = sorted(found + random_spans(t, found, enc, ratio)) if t else []
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
            return {**batch, "spans": spans}

        return step

    df = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = map_rows(df, make, f"key {dict(df.dtypes)['key']}, text string, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnsRenamed({"key": key, "text": text})


def spans_text(spans: F.Column) -> F.Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def span_digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def redact(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mask; overlapping spans become one. Other columns stay, whatever their names; a null text
    stays null; an empty table stays empty."""

    def make():
        enc = vocabulary(vocabulary_path, pattern)

        def clean(t: str | None) -> str | None:
            if not t:
                return t
            found = base_spans(t)
            out, done = [], 0
            for s, _, e in sorted(found + random_spans(t, found, enc, CHARS_PER_TOKEN)):
                if s >= done:
                    out += [t[done:s], mask]
                done = max(done, e)
            return "".join([*out, t[done:]]) if out else t

        return lambda batch: {**batch, text: [clean(t) for t in batch[text]]}

    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    return map_rows(docs, make, schema)
