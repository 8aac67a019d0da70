"""Pre-tokens of a byte-level BPE tokenizer file: what counting and packing share."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import regex

#: The byte-level pre-tokenizer's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are split into pre-tokens at a time; a text is only cut before white space that follows something else, which no
#: pre-token spans.
WINDOW = 1 << 20
#: Symbols whose pairs are looked up at a time.
BLOCK = 1 << 20
#: Texts are handled together up to so many characters; known pre-tokens are forgotten beyond so many.
GROUP_CHARS, KNOWN_MOST = 1 << 22, 600_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, all others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class TokenizerFile:
    """The parts of a byte-level BPE file that are needed here; files of another kind are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        before, model = data["pre_tokenizer"], data["model"]
        if data["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or model["type"] != "BPE" or model["ignore_merges"]:
            raise ValueError(f"{path}: only plain byte-level BPE files are supported")
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in data["added_tokens"]):
            raise ValueError(f"{path}: special tokens that take neighbours along are not supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]


class Splitter:
    """Splits texts into pre-tokens; a special token's string stands as one of its own."""

    def __init__(self, specials: Iterable[str]):
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile(r"\S(?=\s)")
        longest = sorted(specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest))) if longest else None

    def windows(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > WINDOW and (m := self.cut.search(text, at + WINDOW)):
            yield text[at : m.end()]
            at = m.end()
        yield text[at:] if at else text

    def plain(self, text: str) -> list[str]:
        if len(text) <= WINDOW:
            return self.find(text)
        return [t for w in self.windows(text) for t in self.find(w)]

    def __call__(self, text: str) -> list[str]:
        if not self.special or not self.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.plain(text[at:])


class Merger:
    """Rank-synchronous merging. All pre-tokens of a batch lie in one ragged array; in each round every sequence applies its own
    lowest-ranked pair wherever it stands, all sequences at once. Sequences without a pair are done."""

    def __init__(self, file: TokenizerFile):
        self.first = np.array([file.vocab[c] for c in byte_letters()], np.int32)
        self.width = max(file.vocab.values()) + 1
        keys = np.array([file.vocab[a] * self.width + file.vocab[b] for a, b in file.merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([file.vocab[a + b] for a, b in file.merges], np.int32)
        self.none = len(keys)

    def _rank(self, sym: np.ndarray) -> np.ndarray:
        """The rank of each symbol with the next; a block at a time, for long runs."""
        rank = np.full(len(sym), self.none, np.int32)
        for a in range(0, len(sym) - 1, BLOCK):
            left, right = sym[a : a + BLOCK], sym[a + 1 : a + 1 + BLOCK]
            key = left[: len(right)].astype(np.int64) * self.width + right
            at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
            rank[a : a + len(key)] = np.where(self.keys[at] == key, self.ranks[at], self.none)
        return rank

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        """How many symbols of each pre-token survive."""
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        done = sizes.copy()
        live = np.flatnonzero(sizes > 1)
        if not len(live):
            return done
        sym = self.first[np.frombuffer(b"".join([pretokens[i] for i in live]), np.uint8)]
        size = sizes[live]
        while len(live):
            ends = np.cumsum(size)
            rank = self._rank(sym)
            rank[ends - 1] = self.none  # a sequence's last symbol starts no pair
            least = np.minimum.reduceat(rank, ends - size)
            hit = (rank < self.none) & (rank == np.repeat(least, size))
            # in a run such as a a a, pairs overlap: every other one counts, from the left
            place = np.arange(len(sym), dtype=np.int32 if len(sym) < 1 << 31 else np.int64)
            begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, -1))
            hit &= (place - begin) & 1 == 0
            del place, begin
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            size = np.add.reduceat(keep.astype(np.int64), ends - size)
            going = (least < self.none) & (size > 1)
            done[live] = size
            sym = sym[keep & np.repeat(going, ends - np.r_[0, ends[:-1]])]
            live, size = live[going], size[going]
        return done


def groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in order, together up to GROUP_CHARS."""
    now, chars = [], 0
    for t in texts:
        now.append(t)
        chars += len(t)
        if chars >= GROUP_CHARS:
            yield now
            now, chars = [], 0
    if now:
        yield now
