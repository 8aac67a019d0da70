"""SentencePiece encoding and decoding by a max-plus parallel scan.

The library's merges give the one segmentation in which every neighbouring two pieces would be left alone if merged by themselves.
So the lattice of pieces, with 0 for a transition between such neighbours and minus infinity for any other, has a single path that
isn't minus infinity, and max-plus finds it. A giant document is cut into chunks of so many characters, wherever that falls. The states
of a cut are the pieces that may end at or reach over it; each chunk gives a transfer matrix from the states of its left cut to those of
its right, the matrices are combined pairwise, and once the states at all cuts are known each chunk is traced back by itself. Before a
word-start mark, which no piece spans, there is one state: inside a chunk, the words between the first such place and the last don't
depend on the chunk's states, and words that were met before are looked up.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole
from .pretokens import groups

MARK = "▁"
#: Characters of a chunk; words, of so many characters at most, and pairs of pieces that are kept between batches.
CHUNK, WORD_MOST, KNOWN_MOST, PAIRS_MOST = 16_384, 64, 400_000, 500_000
#: A piece's place in the text, start and end; None is the place before a mark, which no piece spans.
State = tuple[int, int] | None


def fields(data: bytes) -> dict[int, list]:
    """The fields of a message in protocol buffers' wire format, by number."""
    out, at = {}, 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


def checked(path: str) -> str:
    """The path of a BPE model that takes texts as they are, puts a mark in front and spells other characters in bytes; others are refused."""
    with open(path, "rb") as f:
        model = fields(f.read())
    trainer, normalizer = fields(model[2][0]), fields(model[3][0])
    last = lambda of, field, default: of.get(field, [default])[-1]
    # model_type BPE, byte_fallback, no whitespace as suffix; no charsmap, a dummy prefix, extra spaces kept, spaces escaped
    fit = last(trainer, 3, 1) == 2 and last(trainer, 35, 0) and not last(trainer, 24, 0)
    fit = fit and not last(normalizer, 2, b"") and last(normalizer, 3, 1) and not last(normalizer, 4, 1) and last(normalizer, 5, 1)
    if not fit or any(last(fields(p), 3, 1) == 4 for p in model[1]):
        raise ValueError(f"{path}: only BPE models with byte fallback that take texts as they are, without user-defined symbols, are supported")
    return path


class Lattice:
    """Pieces, known by a number, and which of them may stand next to each other."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=checked(path))
        plain = [i for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.score = {p.id_to_piece(i): p.get_score(i) for i in plain}
        self.ids = {p.id_to_piece(i): i for i in plain}
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        order = {s: k for k, s in enumerate(sorted(self.ids, key=lambda s: (-self.score[s], s)))}
        # pieces that the merges make of their own characters, with the two that they are made from
        halves = {s: two for s in self.ids if len(s) > 1 and len(two := self.merged(s, s)) == 2}
        if any(MARK in s.lstrip(MARK) for s in halves):
            raise ValueError(f"{path}: a piece has a mark behind other characters")
        self.numbers: dict[str, int] = {}
        self.spelt = [b""]  # the ids of each piece as little-endian bytes; number 0 is none
        self.when, self.left, self.right = [-1], [0], [0]  # single characters aren't made
        self.trie: dict = {}  # by character; at 0 the number of the piece that ends there
        for s in sorted(halves, key=len):
            x, y = halves[s]
            self.number(s, order[s], self.number(x), self.number(y))
        #: when two neighbours would be merged, whatever they are made from
        self.across: dict[int, int] = {}
        for s in halves:
            for k in range(1, len(s)):
                if s[:k] in self.numbers and s[k:] in self.numbers:
                    self.across[self.numbers[s[:k]] << 32 | self.numbers[s[k:]]] = order[s]
        self.alone: dict[int, bool] = {}

    def number(self, s: str, when: int = -1, left: int = 0, right: int = 0) -> int:
        """A piece's number; characters that no piece has get one when they are met."""
        if (n := self.numbers.get(s)) is None:
            n = self.numbers[s] = len(self.spelt)
            self.spelt.append(np.array([self.ids[s]] if s in self.ids else [self.bytes[x] for x in s.encode()], "<u4").tobytes())
            for values, value in ((self.when, when), (self.left, left), (self.right, right)):
                values.append(value)
            node = self.trie
            for c in s:
                node = node.setdefault(c, {})
            node[0] = n
        return n

    def merged(self, text: str, short_of: str = "") -> list[str]:
        """What the merges give for a short text: the best-scored adjacent pair first, the leftmost of equals. Those of a piece can be
        followed short of the last that makes it whole."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0 or (len(parts) == 2 and short_of):
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def neighbours(self, x: int, y: int) -> bool:
        """Whether merges leave two pieces alone. Followed backwards: what stands at the border when the later of its sides was made
        must not have merged across before; of equal merges the left one comes first."""
        across, when = self.across, self.when
        limit = 1 << 60
        while True:
            if 2 * across.get(x << 32 | y, limit) < limit:
                return False
            if when[x] < 0 and when[y] < 0:
                return True
            if when[x] > when[y]:
                limit, x = 2 * when[x], self.right[x]
            else:
                limit, y = 2 * when[y] + 1, self.left[y]

    def reach(self, text: str, begin: int, end: int, entry: int = 0) -> tuple[list[int], list[int]]:
        """For each end of a piece that starts in [begin, end) and that the path can have, counted from ``begin``: its number and its start.
        ``entry`` is the number of the piece that ends at ``begin``, or 0 where no piece would be merged with what follows. From one entry,
        each end has one piece at most."""
        trie, alone, n = self.trie, self.alone, len(text)
        if len(alone) > PAIRS_MOST:
            alone.clear()
        size = min(end - begin + self.longest, n - begin) + 1
        found, start = [-1] * size, [-1] * size
        found[0] = entry
        for at in range(begin, end):
            if (before := found[at - begin]) < 0:
                continue
            if (node := trie.get(text[at])) is None:
                self.number(text[at])
                node = trie[text[at]]
            key, to = before << 32, at + 1
            while True:
                if (piece := node.get(0)) is not None and found[to - begin] < 0:
                    if not before:
                        fine = True
                    elif (fine := alone.get(key | piece)) is None:
                        fine = alone[key | piece] = self.neighbours(before, piece)
                    if fine:
                        found[to - begin], start[to - begin] = piece, at - begin
                if to == n or (node := node.get(text[to])) is None:
                    break
                to += 1
        return found, start

    def trace(self, reached: tuple[list[int], list[int]], till: int) -> bytes:
        """The ids of the path up to the end ``till``, counted as ``reach`` does."""
        (found, start), spelt, out = reached, self.spelt, []
        while till > 0:
            out.append(spelt[found[till]])
            till = start[till]
        return b"".join(out[::-1])

    def word(self, text: str) -> bytes:
        """Ids of what stands between two places that no piece spans."""
        return self.trace(self.reach(text, 0, len(text)), len(text))

    def crossing(self, text: str, cut: int) -> list[State]:
        """States of a cut: pieces that start before it and end at or behind it, up to a place that no piece spans."""
        if cut in (0, len(text)) or breaks(text, cut):
            return [None]
        first = max(cut - self.longest, 0)
        first = max((k for k in range(first + 1, cut) if breaks(text, k)), default=first)
        out = []
        for a in range(first, cut):
            node = self.trie
            for b in range(a, min(a + self.longest, len(text))):
                if (node := node.get(text[b])) is None:
                    break
                if 0 in node and b + 1 >= cut:
                    out.append((a, b + 1))
        if text[cut - 1] not in self.trie:
            out.append((cut - 1, cut))
        return out

    def transfer(self, text: str, begin: int, end: int, left: list[State], right: list[State]) -> np.ndarray:
        """Max-plus matrix of a stretch: 0 where the path leads from a left state to a right state, else minus infinity."""
        out = np.full((len(left), len(right)), -np.inf)
        for i, entry in enumerate(left):
            if entry and entry[1] >= end:  # one piece covers the stretch
                out[i] = [0.0 if s == entry or (s is None and entry[1] == end) else -np.inf for s in right]
                continue
            at = entry[1] if entry else begin
            found, start = self.reach(text, at, end, self.number(text[slice(*entry)]) if entry else 0)
            for j, s in enumerate(right):
                a, b = s or (None, end)
                if 0 < b - at < len(found) and found[b - at] >= 0 and (s is None or start[b - at] == a - at):
                    out[i, j] = 0.0
        return out


def breaks(text: str, at: int) -> bool:
    """Whether a word begins there: no piece spans the place before a mark that follows another character."""
    return text[at] == MARK and text[at - 1] != MARK


class Chunk:
    """A stretch of a giant document: the words between its first break and its last are the same for all states of its cuts."""

    def __init__(self, lattice: Lattice, text: str, begin: int, end: int):
        self.lattice, self.text, self.begin, self.end = lattice, text, begin, end
        inside = (m.end() - 1 for m in BREAK.finditer(text, max(begin - 1, 0), end))
        self.first = self.last = next((k for k in inside if k >= begin), None) if begin else 0
        for self.last in inside:
            pass
        self.left, self.right = lattice.crossing(text, begin), lattice.crossing(text, end)

    def matrix(self) -> np.ndarray:
        of = self.lattice.transfer
        if self.first is None:
            return of(self.text, self.begin, self.end, self.left, self.right)
        lead = of(self.text, self.begin, self.first, self.left, [None]) if self.first > self.begin else np.zeros((len(self.left), 1))
        return product(lead, of(self.text, self.last, self.end, [None], self.right))

    def part(self, begin: int, end: int, entry: State, till: State) -> bytes:
        if entry and entry[1] >= end:
            return b""
        at = entry[1] if entry else begin
        reached = self.lattice.reach(self.text, at, end, self.lattice.number(self.text[slice(*entry)]) if entry else 0)
        return self.lattice.trace(reached, (till[1] if till else end) - at)

    def ids(self, entry: State, till: State, words: Callable[[str], bytes]) -> bytes:
        """Traced back between its states; the piece over the right cut belongs to it, that over the left one doesn't."""
        if self.first is None:
            return b"" if entry and entry == till else self.part(self.begin, self.end, entry, till)
        lead = self.part(self.begin, self.first, entry, None) if self.first > self.begin else b""
        return lead + words(self.text[self.first : self.last]) + self.part(self.last, self.end, None, till)


def scan(lattice: Lattice, text: str, words: Callable[[str], bytes], chunk: int = CHUNK) -> bytes:
    """Ids of a marked text of any length, in chunks; ``words`` gives those of whole words."""
    cuts = [*range(0, len(text), chunk), len(text)]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < lattice.longest:
        del cuts[-2]
    chunks = [Chunk(lattice, text, *ends) for ends in pairwise(cuts)]
    chosen = settle_path([c.matrix() for c in chunks])
    return b"".join(c.ids(c.left[a], c.right[b], words) for c, (a, b) in zip(chunks, pairwise(chosen), strict=True))


BREAK = re.compile(f"[^{MARK}]{MARK}")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def settle_path(steps: list[np.ndarray]) -> list[int]:
    """The state at each cut of the best path: matrices are combined pairwise up a tree, then halves are settled down it."""
    tree = [steps]
    while len(tree[-1]) > 1:
        low = tree[-1]
        tree.append([product(low[k], low[k + 1]) if k + 1 < len(low) else low[k] for k in range(0, len(low), 2)])
    ends = [0, int(tree[-1][0][0].argmax())]
    if tree[-1][0][0, ends[1]] == -np.inf:
        raise ValueError("no segmentation")
    for low in reversed(tree[:-1]):
        new = [ends[0]]
        for k in range(0, len(low), 2):
            if k + 1 < len(low):
                new.append(int((low[k][ends[k // 2]] + low[k + 1][:, ends[k // 2 + 1]]).argmax()))
            new.append(ends[k // 2 + 1])
        ends = new
    return ends


class Encoder:
    """Encodes a worker's texts; the ids of words that were met are kept between batches."""

    def __init__(self, path: str):
        self.lattice = lattice = Lattice(path)
        # a character that is in no longer piece is a word by itself
        inner = "".join(sorted({c for s in lattice.numbers if len(s) > 1 for c in s} - {MARK}))
        self.find = re.compile(f"{MARK}*[{re.escape(inner)}]+|{MARK}+|[^{MARK}{re.escape(inner)}]").findall
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> bytes:
        known, found = self.known, self.find(text)
        out = list(map(known.get, found))
        if None in out:
            for k, s in enumerate(found):
                if out[k] is None:
                    out[k] = ids = known.get(s) or self.lattice.word(s)
                    if len(s) <= WORD_MOST:
                        known[s] = ids
        return b"".join(out)

    def __call__(self, texts: Iterable[str], chunk: int = CHUNK) -> Iterator[bytes]:
        for group in groups(texts):
            if len(self.known) > KNOWN_MOST:  # frequent words come early
                self.known = dict(islice(self.known.items(), KNOWN_MOST // 2))
            for t in group:
                marked = MARK + t.replace(" ", MARK) if t else ""
                yield self.words(marked) if len(marked) <= chunk else scan(self.lattice, marked, self.words, chunk)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and model."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    code = encoder(path)
    for b in batches:
        found = list(code(x.as_py() for x in b.column("text")))
        ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), ids], ["doc_id", "text", "ids"])


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and ids of every row. Null texts count as empty, which have no ids. A null doc_id stays null; repeated rows each get a
    row; an empty table gives an empty result; further columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(partial(_encode, path=path), "doc_id long, text string, ids array<int>")


#: The bytes of each id, by worker process and model.
_PIECES: dict[str, list[bytes]] = {}


def piece_bytes(path: str) -> list[bytes]:
    if path not in _PIECES:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        found = [p.id_to_piece(i).encode() for i in range(p.vocab_size())]
        for k in range(256):
            found[p.piece_to_id(f"<0x{k:02X}>")] = bytes([k])
        _PIECES[path] = found
    return _PIECES[path]


def text_of(ids: Iterable[int], piece: list[bytes]) -> str:
    """Pieces joined, byte pieces as UTF-8, marks as spaces but for the one added in front."""
    return b"".join(map(piece.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


def _decode(path: str):
    def decoded(ids: pa.Array) -> pa.Array:
        piece = piece_bytes(path)
        return pa.array([text_of(r.values.to_numpy().tolist(), piece) if r.is_valid else None for r in ids], pa.string())

    return decoded


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with a column ``decoded``: the text of their ``ids``. Null ids have no text."""
    return rows.withColumn("decoded", F.arrow_udf(_decode(path), "string")(F.col("ids")))


def _crc32(ids: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(r.values.to_numpy().astype("<i4").tobytes()) if r.is_valid else None for r in ids], pa.int64())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids) and same (whether decoding gives the text again) of every row: digests
    of what ``encode_ids`` and ``decode`` give. Texts that hold the mark itself decode to a space there, so ``same`` is false."""
    rows = decode(encode_ids(docs, path), path)
    crc = F.arrow_udf(_crc32, "long")(F.col("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), crc.alias("ids_crc32"), (F.col("decoded") == F.col("text")).alias("same"))
