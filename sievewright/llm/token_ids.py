"""Token ids by the tokenizers library, with the ids of space-delimited segments remembered.

Both vocabularies split a text before a single space between non-space characters whatever stands around it, so a text's
ids are those of its segments one after the other. A worker remembers the ids of segments and of the pieces they are
made of; what it hasn't seen goes to the library's own model. Texts in which spaces meet other white space go to the
library as a whole.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import REMEMBERED, one_thread

#: Segments remembered by a worker in each of two generations.
MEMO = 300_000
#: Marks the first segment of a text, which no space precedes; texts that hold it go to the library as a whole.
FIRST = "\x01"
#: Segments after the first that are empty or have white space or FIRST where the next one begins.
EDGES = r"^$|^[\s\p{Z}\x0b\x1c-\x1f\x85]|[\s\p{Z}\x0b\x1c-\x1f\x85]$|(?s:.)\x01"


class Memo:
    """Two generations of a dict: the older one goes when the newer one is full."""

    def __init__(self, size: int = MEMO) -> None:
        self.new: dict = {}
        self.old: dict = {}
        self.size = size

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in kept}
    return table | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(kept)))}


class Encoder:
    """Unsigned 16-bit ids, as encode(text, add_special_tokens=False) of the library gives them."""

    def __init__(self, path: str) -> None:
        one_thread()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.model = self.tokenizer.model
        #: A vocabulary with word ends drops white space, so that the space before a segment says nothing.
        self.spaced = not spec["model"].get("end_of_word_suffix")
        pre = spec["pre_tokenizer"]
        split = next((p["pattern"]["Regex"] for p in pre.get("pretokenizers", []) if p["type"] == "Split"), None)
        plain = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pieces = regex.compile(split or plain)
        self.letters = byte_letters()
        self.segments, self.known = Memo(), Memo()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.known.new.get(piece)
        if ids is None:
            ids = self.known.old.get(piece)
            if ids is None:
                mapped = piece.encode().decode("latin-1").translate(self.letters)
                ids = array("H", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            self.known.put(piece, ids)
        return ids

    def segment(self, text: str) -> bytes:
        """Ids of a text of Latin-1 characters by its pieces; of others by the library, which knows normal forms and classes."""
        if not text.isascii() and max(text) > "\xff":
            return self.whole(text)
        if not self.spaced:
            text = text.lower()
        core = text.rstrip(".,;:!?")
        if core.lstrip(" ").isalpha() and core.rfind(" ") < 1:
            return self.piece(core) + self.piece(text[len(core) :]) if len(core) < len(text) else self.piece(core)
        return b"".join(map(self.piece, self.pieces.findall(text)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and the n + 1 places where they begin and end; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.empty(0, np.uint16), np.zeros(1, np.int64)
        marked = pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), texts, pa.scalar("", pa.large_string()))
        if not self.spaced:
            marked = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(marked, " ")
        at = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        index = np.asarray(coded.indices)[: at[-1]]
        segments = coded.dictionary.to_pylist()
        parts = list(map(self.segments.new.get, segments))
        lead, old, put = " " * self.spaced, self.segments.old, self.segments.put
        for i in [i for i, ids in enumerate(parts) if ids is None]:
            s = segments[i]
            ids = old.get(s)
            if ids is None:
                ids = self.segment(s[1:] if lead and s[:1] == FIRST else lead + s)
            put(s, ids)
            parts[i] = ids
        odd = np.empty(0, np.int64)
        if self.spaced:
            odd = np.flatnonzero(pc.match_substring_regex(coded.dictionary, EDGES).to_numpy(zero_copy_only=False))
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
        begin = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(parts), np.uint16)
        lengths = size[index]
        ends = np.cumsum(lengths)
        offsets = np.concatenate([[0], ends])[at - at[0]]
        flat = ids[np.repeat(begin[index] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        if len(odd):
            rows = np.unique(np.searchsorted(at, np.flatnonzero(np.isin(index, odd)), "right") - 1)
            each = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            for r in rows.tolist():
                each[r] = np.frombuffer(self.whole(texts[r].as_py()), np.uint16)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
            flat = np.concatenate(each)
        return flat, offsets


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


REMEMBERED.append(encoder.cache_clear)
