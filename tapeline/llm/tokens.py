"""Byte-level tokenizer ids: those of a ``tokenizers`` file, from a faster encoder where it is proven to be the same.

The faster encoder merges by the ranks of the joined tokens, the library by its list of merges. Both walk the same way
if ranks and vocabulary agree and each token's own merge, recovered from the ranks alone, is the one in the list: while
two neighbours are joined, everything inside them has been joined by lower ranks only, and no token crosses
their borders, so they are the two parts that the token's own recovery ends with. The proof is made once, on the driver, over
the whole vocabulary; without it the library encodes everything. A text that holds the string of an added token goes to
the library in any case, so that it is treated exactly as the library treats it.

Defined results: null and empty text have no ids; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np

#: Fixed value: the pattern of byte-level tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOOK_AHEAD = r"\s+(?!\S)|"
_TWO_SPACES = re.compile(r"\s\s")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def parts_of(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What joining by ranks below the token's own leaves of it."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def same_encoder(config: dict, ranks: dict[bytes, int], pattern: str) -> bool:
    """Whether ranks and pattern give the ids of the tokenizer that ``config`` (the parsed file) describes."""
    model, split = config["model"], config["pre_tokenizer"] or {}
    plain = not config["normalizer"] and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not (plain and byte_level and pattern == PATTERN):
        return False
    letters = byte_letters()
    raw = lambda word: bytes(letters[c] for c in word)
    added = {t["content"] for t in config["added_tokens"]}
    if {raw(w): i for w, i in model["vocab"].items() if w not in added} != ranks:
        return False
    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    single = sum(len(t) == 1 for t in ranks)
    if len(merges) + single != len(ranks):
        return False
    return all(ranks[a + b] == single + i and parts_of(a + b, ranks) == [a, b] for i, (a, b) in enumerate(merges))


_proven: dict[tuple[str, str | None, str | None], bool] = {}


class ByteLevel:
    """Encoder of one tokenizer file. With ``special_as_text``, the strings of added tokens in a text are ordinary text."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None, special_as_text: bool = False):
        with open(json_path, encoding="utf-8") as f:
            self.json_text = f.read()
        self.ranks_text, self.pattern, self.special_as_text, self.fast = None, pattern, special_as_text, False
        config = json.loads(self.json_text)
        self.added = [t["content"] for t in config["added_tokens"]]
        if ranks_path and pattern:
            with open(ranks_path, "rb") as f:
                self.ranks_text = f.read()
            key = (json_path, ranks_path, pattern)
            if key not in _proven:
                _proven[key] = same_encoder(config, self._ranks(), pattern)
            self.fast = _proven[key]

    def _ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks_text.splitlines()) if a}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def open(self) -> ByteLevel:
        if self.fast and not hasattr(self, "_whole"):
            import tiktoken

            ranks = self._ranks()
            made = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            # The look-ahead only decides where two white-space characters meet; other texts go without it.
            self._whole, self._single = made("whole", self.pattern), made("single", self.pattern.replace(_LOOK_AHEAD, ""))
            self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self._bytes[i] = len(token)
        return self

    def library(self):
        """The library's tokenizer, made when a text needs it."""
        if not hasattr(self, "_slow"):
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.json_text)
            self._slow.encode_special_tokens = self.special_as_text
        return self._slow

    def _library(self, text: str) -> bool:
        return not self.fast or (not self.special_as_text and any(t in text for t in self.added))

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        self.open()
        if self._library(text):
            return self.library().encode(text, add_special_tokens=False).ids
        return (self._whole if _TWO_SPACES.search(text) else self._single)(text)

    def offsets(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(ids, first characters, characters after the last) of the text's tokens; tokens that share a character both name it."""
        if not text:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.open()
        if self._library(text):
            made = self.library().encode(text, add_special_tokens=False)
            spans = np.array(made.offsets, np.int64).reshape(-1, 2)
            return made.ids, spans[:, 0], spans[:, 1]
        ids = self.ids(text)
        ends = np.cumsum(self._bytes[ids])
        begins = np.concatenate([[0], ends[:-1]])
        if not text.isascii():
            char_of = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
            begins, ends = char_of[begins], char_of[ends - 1] + 1
        return ids, begins, ends
