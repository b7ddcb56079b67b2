"""Token encoding that is exact for a given tokenizer file and fast for repeated words.

A byte-level BPE file splits a text into pieces before it merges bytes; no piece holds a white-space character that
follows another character, except pieces of white space only. So wherever a single space stands between two
characters that are no white space, the piece before ends and a new piece begins with that space, whatever stands
further left or right; and a single line end there is a piece of its own. Such places are stable boundaries: tokens on
either side don't depend on the other side. All texts of a batch are cut there into fields, on their UTF-8 bytes; Arrow
makes the fields distinct, and the ids of all are gathered from those of the distinct ones. Of these, words in Latin
letters, digits and marks are merged by the file's own merge table, many at once; any other field is encoded by the
tokenizer as it is.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex

#: Fields that a Python worker keeps at most; then it begins anew. It bounds memory and changes no result.
CACHE_FIELDS = 30_000
#: A field longer than this is not looked up again.
CACHE_CHARS = 64
#: How byte-level files split a text into pieces. Letters and digits of the Latin blocks only are split by it here, as
#: libraries agree on their classes; other fields go to the tokenizer as they are.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LATIN_END = "\u0250"
#: Pieces of up to so many bytes are merged together, those of like length at once; longer ones one by one.
WIDTHS = (6, 9, 12, 16, 24, 40)

#: What a byte of a plain field belongs to: 1 letters (ASCII, U+00C0 to U+017F), 2 digits, 3 marks; 0 is a byte of others.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)]] = 1
_KIND[0x27] = 0  # contractions are pieces of their own

_ASCII_WHITE = np.zeros(256, dtype=bool)
_ASCII_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


@dataclass
class Encoded:
    """The tokens of a column of texts. Those of text i belong to the fields firsts[i] to firsts[i + 1]; begins: where each
    field begins in the texts' bytes, laid one after the other; ends: tokens up to and with each field; starts: where
    each field's ids begin in `distinct`."""

    firsts: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    starts: np.ndarray
    distinct: np.ndarray

    def edges(self) -> np.ndarray:
        """Tokens before each text, and in all."""
        return np.concatenate(([0], self.ends))[self.firsts]

    def counts(self) -> np.ndarray:
        """Tokens of each text."""
        return np.diff(self.edges())

    def ids(self) -> np.ndarray:
        """The ids of all texts, one after the other."""
        before = np.concatenate(([0], self.ends))
        n = np.diff(before)
        return self.distinct[np.repeat(self.starts - before[:-1], n) + np.arange(before[-1])]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after the other, and where each begins (one entry more than texts).
    Nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _wide_white(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether three bytes are the UTF-8 form of a white-space character: U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F,
    U+205F or U+3000."""
    general = (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return ((a == 0xE2) & (general | ((b == 0x81) & (c == 0x9F)))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


def stable_separators(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the spaces and line ends that stand alone between two characters of one text that are no white space."""
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    at = at[~edge[at] & ~edge[at + 1]]
    before, after = data[at - 1], data[at + 1]
    solid = ~(_ASCII_WHITE[before] | _ASCII_WHITE[after])
    # white space beyond ASCII: U+0085 and U+00A0 have two bytes, the others three
    last = len(data) - 1
    some = np.flatnonzero(before >= 0x80)
    p, x = at[some], before[some]
    second = data[np.maximum(p - 2, 0)]
    solid[some[((second == 0xC2) & ((x == 0x85) | (x == 0xA0))) | _wide_white(data[np.maximum(p - 3, 0)], second, x)]] = False
    some = np.flatnonzero(after >= 0x80)
    p, x = at[some], after[some]
    second = data[np.minimum(p + 2, last)]
    solid[some[((x == 0xC2) & ((second == 0x85) | (second == 0xA0))) | _wide_white(x, second, data[np.minimum(p + 3, last)])]] = False
    return at[solid]


class _Merges:
    """The merges of a BPE model for many short pieces at once: in each round every piece that has a pair to merge merges
    the one of least rank, the leftmost of several, as the model does one by one."""

    NONE = np.int32(2**31 - 1)
    BITS = 20
    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocab: dict[str, int], merges: list, letters: dict[int, int]):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.base = np.asarray([vocab[chr(letters[b])] for b in range(256)], dtype=np.int32)
        self.merged = np.asarray([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = self._key(np.asarray([vocab[a] for a, _ in pairs]), np.asarray([vocab[b] for _, b in pairs]))
        # open addressing; one place more than the table has lets a probe go on without a wrap
        self.keys, self.ranks = np.full((1 << self.BITS) + 64, -1, dtype=np.int64), np.full((1 << self.BITS) + 64, self.NONE, dtype=np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            now = np.flatnonzero(free)[first]
            self.keys[at[now]], self.ranks[at[now]] = keys[left[now]], left[now]
            rest = np.ones(len(left), dtype=bool)
            rest[now] = False
            left, at = left[rest], at[rest] + 1

    @staticmethod
    def _key(a, b) -> np.ndarray:
        return a.astype(np.int64) << 32 | b.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.MULTIPLIER) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it is no merge or one side is none (-1)."""
        key = self._key(a, np.maximum(b, 0)).ravel()
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.ranks[at], self.NONE)
        more = np.flatnonzero((there != key) & (there >= 0))
        while len(more):
            at[more] += 1
            there = self.keys[at[more]]
            hit = there == key[more]
            out[more[hit]] = self.ranks[at[more[hit]]]
            more = more[~hit & (there >= 0)]
        return np.where((a < 0) | (b < 0), self.NONE, out.reshape(a.shape))

    def run(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, one after the other; number of each one's) of pieces of at most WIDEST bytes."""
        out = np.full((len(begins), int(sizes.max(initial=1))), -1, dtype=np.int32)
        least = 0
        for most in WIDTHS:
            rows = np.flatnonzero((sizes > least) & (sizes <= most))
            least = most
            for at in range(0, len(rows), 1 << 13):
                self._round(rows[at : at + (1 << 13)], data, begins, sizes, out)
        lengths = (out >= 0).sum(axis=1)
        return out[out >= 0].astype("<u4"), lengths

    def _round(self, rows, data, begins, sizes, out) -> None:
        if not len(rows):
            return
        width = int(sizes[rows].max())
        place = np.arange(width)
        symbols = np.where(place < sizes[rows, None], self.base[data[np.minimum(begins[rows, None] + place, len(data) - 1)]], np.int32(-1))
        ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                out[rows, :1] = symbols
                return
            j = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), j]
            live = best != self.NONE
            if not live.all():
                done = ~live
                out[rows[done], : symbols.shape[1]] = symbols[done]
                rows, symbols, ranks, j, best = rows[live], symbols[live], ranks[live], j[live], best[live]
            every = np.arange(len(rows))
            # every row that is left merges one pair, so each round is narrower by one
            after = np.arange(symbols.shape[1] - 1) > j[:, None]
            symbols = np.where(after, symbols[:, 1:], symbols[:, :-1])
            symbols[every, j] = self.merged[best]
            after = after[:, : ranks.shape[1] - 1]
            ranks = np.where(after, ranks[:, 1:], ranks[:, :-1])
            left = np.flatnonzero(j > 0)
            ranks[left, j[left] - 1] = self.rank(symbols[left, j[left] - 1], symbols[left, j[left]])
            right = np.flatnonzero(j < symbols.shape[1] - 1)
            ranks[right, j[right]] = self.rank(symbols[right, j[right]], symbols[right, j[right] + 1])


class ByteBpe:
    """A tokenizers .json file with a byte-level pre-tokenizer and no normalizer."""

    proven = True

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        model = json.loads(self.tokenizer.to_str())["model"]
        simple = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self.merges = _Merges(model["vocab"], model["merges"], self.letters) if simple else None
        self.merge = self.tokenizer.model.tokenize
        self.kind = _KIND.copy()
        self.kind[[s.encode()[0] for s in self.special]] = 0
        self.others: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        # the model reads bytes as letters: printable Latin-1 as itself, other bytes in turn from U+0100
        return [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))]

    def _field(self, field: str) -> list[int]:
        """The ids of one field."""
        word = field[1:] if field[0] == " " else field
        if max(field) >= LATIN_END or len(word.split(None, 1)) != 1 or word[0].isspace() or word[-1].isspace() or any(s in field for s in self.special):
            return self.tokenizer.encode(field, add_special_tokens=False).ids
        return [i for piece in PIECES.findall(field) for i in self._piece(piece)]

    def _other(self, field: str) -> list[int]:
        """The ids of a field that the merge table doesn't do; short ones are kept."""
        ids = self.others.get(field)
        if ids is None:
            ids = self._field(field)
            if len(field) <= CACHE_CHARS:
                if len(self.others) >= CACHE_FIELDS:
                    self.others.clear()
                self.others[field] = ids
        return ids

    def _fields(self, fields: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all fields, one after the other; number of each one's) of distinct fields."""
        if not len(fields):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        data, offsets = raw_bytes(fields)
        kind = self.kind[data]
        lead = offsets[:-1][data[offsets[:-1]] == 0x20]
        kind[lead] = kind[np.minimum(lead + 1, len(data) - 1)]
        sign = np.flatnonzero((data == 0xC3))
        sign = sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)]  # the two signs among the letters
        kind[sign] = 0
        plain = np.minimum.reduceat(kind, offsets[:-1]) > 0
        heads = np.ones(len(data) + 1, dtype=bool)
        heads[1:-1] = kind[1:] != kind[:-1]
        heads[offsets] = True
        begins = np.flatnonzero(heads)
        sizes, begins = np.diff(begins), begins[:-1]
        owner = np.searchsorted(offsets, begins, side="right") - 1
        long = np.zeros(len(fields), dtype=bool)
        long[owner[sizes > WIDTHS[-1]]] = True
        plain &= ~long & (self.merges is not None)
        mine = plain[owner]
        lengths = np.zeros(len(fields), dtype=np.int64)
        ids, n = self.merges.run(data, begins[mine], sizes[mine]) if mine.any() else (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))
        np.add.at(lengths, owner[mine], n)
        others = np.flatnonzero(~plain)
        if not len(others):
            return ids, lengths
        found = [self._other(f) for f in fields.take(pa.array(others)).to_pylist()]
        lengths[others] = [len(x) for x in found]
        every = np.empty(int(lengths.sum()), dtype="<u4")
        own = np.repeat(plain, lengths)
        every[own], every[~own] = ids, [i for x in found for i in x]
        return every, lengths

    def encoded(self, column: pa.Array) -> Encoded:
        """The tokens of every text of a string column."""
        data, offsets = raw_bytes(column)
        at = stable_separators(data, offsets)
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = cut[at] = True
        cut[at[data[at] == 0x0A] + 1] = True
        begins = np.flatnonzero(cut)
        fields = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        ids, lengths = self._fields(fields.dictionary)
        index = np.asarray(fields.indices, dtype=np.int64)
        return Encoded(np.searchsorted(begins, offsets), begins[:-1], np.cumsum(lengths[index]), (np.cumsum(lengths) - lengths)[index], ids)

    def counts(self, column: pa.Array) -> np.ndarray:
        return self.encoded(column).counts()

    def packed(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of each text's)."""
        found = self.encoded(column)
        return found.ids(), found.counts()

    def count(self, text: str) -> int:
        return int(self.counts(pa.array([text], pa.string()))[0])

    def pack(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.packed(pa.array([text], pa.string()))[0].astype("<u4", copy=False).tobytes()

    def marks(self, column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Tokens of each text, and for each text (offsets in bytes at which a token begins in any context, 0s, tokens
        before each)."""
        found = self.encoded(column)
        before, edges = np.concatenate(([0], found.ends)), found.edges()
        out = []
        for k, (a, b) in enumerate(zip(found.firsts[:-1].tolist(), found.firsts[1:].tolist(), strict=True)):
            at = found.begins[a + 1 : b] - found.begins[a] if b > a else np.zeros(0, dtype=np.int64)
            out.append((at, np.zeros(len(at), dtype=np.int64), before[a + 1 : b] - edges[k]))
        return np.diff(edges), out


class Agreeing:
    """Any other file: nothing is proven from the text, so neighbours are spliced where their tokens agree."""

    proven = False

    def __init__(self, path: str, agree: int = 8):
        self.agree = agree
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda text: processor.encode(text, num_threads=1)
            self._spans = lambda text: (lambda m: (m["ids"], [b for _, b in m["offsets"]]))(processor.encode(text, return_type="offset_mapping", num_threads=1))
        else:
            tokenizer = _tokenizer(path)
            self.ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
            self._spans = lambda text: (lambda e: (e.ids, [b for _, b in e.offsets]))(tokenizer.encode(text, add_special_tokens=False))

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def counts(self, column: pa.Array) -> np.ndarray:
        return np.asarray([self.count(t or "") for t in column.to_pylist()], dtype=np.int64)

    def packed(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.asarray(self.ids(t or ""), dtype="<u4") for t in column.to_pylist()]
        return np.concatenate([np.zeros(0, dtype="<u4"), *ids]), np.asarray([len(x) for x in ids], dtype=np.int64)

    def pack(self, text: str) -> bytes:
        return np.asarray(self.ids(text), dtype="<u4").tobytes()

    def marks(self, column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Tokens of each text, and for each text (offsets in bytes at which a token ends, a hash of the `agree` tokens on
        either side with their places, tokens before each). Boundaries with fewer tokens on a side are left out."""
        totals, out = [], []
        for text in column.to_pylist():
            ids, ends = (np.asarray(x, dtype=np.int64) for x in self._spans(text or ""))
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[ends]
            totals.append(len(ids))
            k = np.arange(self.agree, max(self.agree, len(ids) - self.agree))
            sums = np.zeros(len(k), dtype=np.uint64)
            for j in range(-self.agree, self.agree):
                for value in (ids[k + j], place[k + j] - place[k - 1]):
                    sums = (sums ^ value.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    sums ^= sums >> np.uint64(29)
            out.append((place[k - 1], sums.view(np.int64), k))
        return np.asarray(totals, dtype=np.int64), out


_loaded: dict[str, ByteBpe | Agreeing] = {}


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def load(path: str) -> ByteBpe | Agreeing:
    """The tokenizer of a file, kept by each Python worker."""
    if path not in _loaded:
        proven = False
        if path.endswith(".json"):
            tokenizer = _tokenizer(path)
            added = tokenizer.get_added_tokens_decoder().values()
            split = tokenizer.pre_tokenizer
            proven = type(split).__name__ == "ByteLevel" and split.use_regex and not split.add_prefix_space and tokenizer.normalizer is None
            proven = proven and not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added)
        _loaded[path] = ByteBpe(path) if proven else Agreeing(path)
    return _loaded[path]
