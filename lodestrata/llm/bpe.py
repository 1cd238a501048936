"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never be merged over, so a cut
between them is certain. Each pre-token is cut there, the fragments are encoded
independently with the vocabulary's merges, and their ids are concatenated; the result is
that of merging the whole pre-token. Each different pre-token of a batch of texts is encoded
once, and all fragments side by side: each round merges the pair of least rank of every one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from lodestrata.llm import textops as X
from lodestrata.runtime import extended, ship

#: The pre-token pattern of byte-level BPE vocabularies, the commonest branch first.
PRETOKEN = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose class is the same in every Unicode version in use. Other texts are
#: split by the tokenizer file's own pre-tokenizer, whose tables may be older or newer.
_UNSTABLE = re.compile(r"[^\x00-՗‐-‧‰-⁞₠-₿　-〩ぁ-ゖ゠-ヿ一-龥가-힣]")
#: Validity of pairs of tokens that a worker remembers.
CACHE = 800_000
#: Letters of texts that are encoded at once, and bytes of the longest fragment merged side by side.
BATCH, SHORT = 1 << 20, 64
_NONE = np.int64(1 << 40)
#: Endings that stand by themselves behind an apostrophe: of one letter, and of two.
_ONE, _TWO = "stmd", ("re", "ve", "ll")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character; this is the way back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class _Merges:
    """The merges of a vocabulary as a hash table of pairs of ids, and merging of many fragments side by side."""

    def __init__(self, size: int, merges: list[tuple[int, int, int]]) -> None:
        self.size = np.int64(size)
        bits = max(4, (4 * len(merges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, _NONE, np.int64)
        self.made = np.array([m for _, _, m in merges], np.int64)
        keys = np.array([a * size + b for a, b, _ in merges], np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.key[at] not in (-1, key):
                at = (at + 1) & self.mask
            if self.key[at] == -1:
                self.key[at], self.rank[at] = key, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``_NONE`` where there is no merge."""
        key = left * self.size + right
        at = self._slot(key)
        held = self.key[at]
        out = np.where(held == key, self.rank[at], _NONE)
        todo = np.flatnonzero((held != key) & (held != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.key[at[todo]]
            found = held == key[todo]
            out[todo[found]] = self.rank[at[todo[found]]]
            todo = todo[~found & (held != -1)]
        return out

    def merged(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments, given as ids of their bytes one behind another, and how many each has."""
        n = len(length)
        owner = np.repeat(np.arange(n), length)
        rank = np.full(len(sym), _NONE, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        done, whose = [], []
        while len(sym):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            live = least < _NONE
            if not live.all():
                done.append(sym[~live])
                whose.append(owner[~live])
                sym, owner, rank, least = sym[live], owner[live], rank[live], least[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            near = np.diff(hit) == 1
            if near.any():  # of a run like a a a a the first and third pair merge
                start = np.flatnonzero(np.append(True, ~near))
                hit = hit[(np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit))))) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            at = hit - np.arange(len(hit))
            at = np.concatenate([at, at[at > 0] - 1])
            rank[at] = _NONE
            at = at[at + 1 < len(sym)]
            at = at[owner[at] == owner[at + 1]]
            rank[at] = self.ranks(sym[at], sym[at + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        ids, owner = np.concatenate(done), np.concatenate(whose)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)


class Codec:
    """Encoder and decoder of one tokenizer file; made once for each Python worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens: list[bytes] = [b""] * self.size
        #: Pairs of bytes that stand side by side in some token; all others are certain cuts.
        self.inside: set[tuple[int, int]] = set()
        for token, i in vocab.items():
            self.tokens[i] = raw = bytes(letters[c] for c in token)
            self.inside.update(zip(raw, raw[1:]))
        self._ids = {self.tokens[i]: i for i in vocab.values()}
        self._longest: dict[bytes, int] = {}
        for raw in self._ids:
            self._longest[raw[:2]] = max(len(raw), self._longest.get(raw[:2], 1))
        # by rank: single bytes come first, then what each merge makes
        self._rank = [1 << 30] * self.size
        self._parts: list[tuple[int, int]] = []
        self._joined: dict[int, int] = {}
        for b in range(256):
            if (i := self._ids.get(bytes([b]))) is not None:
                self._rank[i] = len(self._parts)
            self._parts.append((b, b))
        for merge in spec["model"]["merges"]:
            a, b = (vocab[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            rank = len(self._parts)
            self._rank[self._ids[self.tokens[a] + self.tokens[b]]] = rank
            self._parts.append((self._rank[a], self._rank[b]))
            self._joined[self._rank[a] << 32 | self._rank[b]] = rank
        for text, i in self.added.items():
            self.tokens[i] = text.encode()
        self._size = [len(x) for x in self.tokens]
        self._pairs: dict[int, bool] = {}
        self._find = regex.compile(PRETOKEN).findall
        self._pretokenizer = Tokenizer.from_file(path).pre_tokenizer
        self._special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._merges = _Merges(self.size, [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])])
        self._bytes = np.array([self._ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        self._cut = np.ones(1 << 16, bool)
        self._cut[[a << 8 | b for a, b in self.inside]] = False
        self._token_bytes, self._token_at = _joined(self.tokens)
        self._digits, self._digits_at = _joined([f"{i},".encode() for i in range(self.size)])

    def pretokens(self, text: str) -> list[str]:
        if not _UNSTABLE.search(text):
            return self._find(text)
        return [text[a:b] for _, (a, b) in self._pretokenizer.pre_tokenize_str(text)]

    def cuts(self, raw: bytes) -> list[bytes]:
        """The fragments between certain cuts."""
        at = [i for i, pair in enumerate(zip(raw, raw[1:]), 1) if pair not in self.inside]
        return [raw[a:b] for a, b in zip([0, *at], [*at, len(raw)])]

    def fragment(self, raw: bytes) -> list[int]:
        """Ids of a fragment, as merging by rank gives them.

        A sequence of tokens is what merging gives exactly if each neighbouring pair is;
        so the longest tokens that follow each other validly are sought, with steps back.
        """
        found, longest, size, n = self._ids.get, self._longest, self._size, len(raw)
        if (one := found(raw)) is not None:
            return [one]
        out: list[int] = []
        dead: set[int] = set()
        pos, least = 0, 0
        while pos < n:
            # the longest token at pos; after a step back only shorter ones
            k = least or min(n - pos, longest.get(raw[pos : pos + 2], 1))
            least = 0
            while k:
                if pos + k not in dead and (token := found(raw[pos : pos + k])) is not None and (not out or self._follows(out[-1], token)):
                    break
                k -= 1
            if k:
                out.append(token)
                pos += k
            else:
                dead.add(pos)
                pos -= size[out[-1]]
                least = size[out.pop()] - 1
        return out

    def _follows(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens gives these two tokens."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE:
                self._pairs = {}
            known = self._pairs[key] = self._valid(self._rank[a], self._rank[b])
        return known

    def _valid(self, a: int, b: int) -> bool:
        """Undoes the merges of both, the latest first, and looks for a pair that would have been merged before."""
        limit = 1 << 60
        while True:
            if self._joined.get(a << 32 | b, limit) < limit:
                return False
            if a > b:
                limit, a = a, self._parts[a][1]
                if a == limit:
                    limit, b = b + 1, self._parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self._parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self._parts[a][1]
                    if a == limit:
                        return True

    def _merged(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, given as their bytes one behind another, and how many each has.

        They are cut where cuts are certain, fragments are encoded by themselves, and their
        ids put together. Those with a long fragment are taken one by one.
        """
        data = raw.astype(np.int64)
        begins = np.zeros(len(data), bool)
        begins[(np.cumsum(size) - size)[size > 0]] = True
        begins[1:] |= self._cut[data[:-1] << 8 | data[1:]]
        at = np.flatnonzero(begins)
        length = np.diff(np.append(at, len(data)))
        owner = np.repeat(np.arange(len(size)), size)[at]
        alone = np.zeros(len(size), bool)
        alone[owner[length > SHORT]] = True
        if (self._bytes < 0).any():
            alone[:] = True
        use = ~alone[owner]
        ids, count = self._merges.merged(self._bytes[data[np.repeat(use, length)]], length[use])
        count = np.bincount(owner[use], count, len(size)).astype(np.int64)
        if alone.any():
            ends, parts, low = np.cumsum(size), [], 0
            before = np.cumsum(count)
            for i in np.flatnonzero(alone).tolist():
                got = [t for part in self.cuts(raw[ends[i] - size[i] : ends[i]].tobytes()) for t in self.fragment(part)]
                parts += [ids[low : before[i]], np.array(got, np.int64)]
                low, count[i] = before[i], len(got)
            ids = np.concatenate([*parts, ids[low:]])
        return ids, count

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts; special tokens' strings give their ids."""
        out: list[np.ndarray] = []
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= BATCH):
                size += len(texts[high])
                high += 1
            out += self._batch(texts[low:high])
            low = high
        return out

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        odd = [bool(_UNSTABLE.search(t) or (self._special is not None and self._special.search(t))) for t in texts]
        plain = [t for t, o in zip(texts, odd) if not o]
        got = iter(self._plain(plain) if plain else [])
        return [self._odd(t) if o else next(got) for t, o in zip(texts, odd)]

    def _odd(self, text: str) -> np.ndarray:
        """A text with special tokens, or split by the tokenizer file's own pre-tokenizer."""
        out = []
        for i, part in enumerate(self._special.split(text) if self._special is not None else [text]):
            if i % 2:
                out.append(np.array([self.added[part]], np.int64))
            elif part:
                raws = [p.encode() for p in self.pretokens(part)]
                out.append(self._merged(np.frombuffer(b"".join(raws), np.uint8), np.array([len(r) for r in raws], np.int64))[0])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Pre-tokens are found and counted for all texts together; each different one is encoded once."""
        joined = "".join(texts)
        rows = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = pretoken_starts(points, rows)
        if not len(starts):
            return [np.zeros(0, np.int64) for _ in texts]
        raw = np.frombuffer(joined.encode(), np.uint8)
        if len(raw) == len(points):
            at = np.append(starts, len(raw))
        else:
            wide = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            at = np.append((np.cumsum(wide) - wide)[starts], len(raw))
        size = np.diff(at)
        _, first, which = np.unique(X.hashes(raw, at[:-1], at[1:]), return_index=True, return_inverse=True)
        # the bytes of each pre-token are those of the one that it is encoded as
        if (size != size[first][which]).any() or (raw != raw[np.repeat(at[first][which] - at[:-1], size) + np.arange(len(raw))]).any():
            return [self._odd(t) for t in texts]
        own = size[first]
        ids, count = self._merged(raw[_spread(at[first], own)], own)
        begin = np.cumsum(count) - count
        every = ids[_spread(begin[which], count[which])]
        ends = np.append(0, np.cumsum(count[which]))[np.searchsorted(starts, rows)].tolist()
        return [every[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, text: str) -> list[int]:
        return self._batch([text])[0].tolist()

    def written(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        ids = np.asarray(ids, np.int64)
        return self._digits[_spread(self._digits_at[ids], np.diff(self._digits_at)[ids])].tobytes()[:-1]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        ids = np.asarray(ids, np.int64)
        return self._token_bytes[_spread(self._token_at[ids], np.diff(self._token_at)[ids])].tobytes().decode("utf-8", "replace")


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each span, one span behind another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def _class_table() -> np.ndarray:
    """For each code point whether it is white space, a letter, a number or something else."""
    every = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        use = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        every[[ord(c) for c in regex.findall(pattern, use)]] = kind
    return every


_classes: list[np.ndarray] = []


def pretoken_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts that lie one behind another as code points; ``rows`` has their edges.

    A run of letters, of numbers or of other characters is a pre-token, with a space before
    it. Of a longer run of white space all but the last character is one, and that last one
    too unless it is such a space. A contraction is one where its apostrophe begins a run.
    """
    if not _classes:
        _classes.append(_class_table())
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes[0][points]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    starts = edge[:n].copy()
    blank, gap = kind == _SPACE, points == 0x20
    starts[1:] |= (kind[1:] != kind[:-1]) & ~gap[:-1]
    last = blank.copy()  # white space before another character of its text
    last[:-1] &= ~blank[1:] & ~edge[1:n]
    last[-1] = False
    starts |= last
    starts[1:] |= blank[1:] & ~blank[:-1]
    quote = np.flatnonzero((points == 0x27) & starts)
    quote = quote[quote + 1 < n]
    quote = quote[~edge[quote + 1]]
    one = quote[np.isin(points[quote + 1], [ord(c) for c in _ONE])]
    two = quote[quote + 2 < n]
    two = two[~edge[two + 2]]
    two = two[np.isin(points[two + 1] << 16 | points[two + 2], [ord(a) << 16 | ord(b) for a, b in _TWO])]
    for at, size in ((one, 2), (two, 3)):
        starts[at + 1] = False
        after = at + size
        starts[after[after < n]] = True
    return np.flatnonzero(starts)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a tokenizer file. A bare name is looked up among the public tokenizers."""
    if path not in _codecs:
        full = path
        if "/" not in path:
            import public_tokenizers

            full = public_tokenizers.path(path)
        _codecs[path] = Codec(str(full))
    return _codecs[path]


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens`` and ``ids`` (array of int): the token ids of each whole text.

    A null or empty text has no ids. Rows are independent: nothing is shuffled, repeated
    rows, ties and null keys don't matter, and other columns pass through unchanged, save
    that a column named ``n_tokens`` or ``ids`` is replaced. An empty table gives an empty one.
    """
    return _mapped(docs, tokenizer, text, ids=True)


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids_text`` (decimal ids joined by commas) and ``decoded``.

    Nulls and clashing names are treated as in ``encode``.
    """
    return _mapped(docs, tokenizer, text, ids=False)


def _mapped(docs: DataFrame, tokenizer: str, text: str, ids: bool) -> DataFrame:
    new = ("n_tokens", "ids") if ids else ("n_tokens", "ids_text", "decoded")
    docs = docs.drop(*(c for c in new if c != text))

    def made(use: Codec, got: list[np.ndarray]) -> list[pa.Array]:
        counts = pa.array(map(len, got), pa.int64())
        if ids:
            return [counts, pa.array(got, pa.list_(pa.int32()))]
        return [counts, pa.array([use.written(x).decode() for x in got], pa.string()), pa.array(map(use.decode, got), pa.string())]

    return _with(docs, tokenizer, text, "n_tokens long, ids array<int>" if ids else "n_tokens long, ids_text string, decoded string", made)


def _with(docs: DataFrame, tokenizer: str, text: str, ddl: str, made: Callable[[Codec, list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """Adds columns made from the ids of each text."""
    ship(docs.sparkSession)
    schema = extended(docs.schema, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(tokenizer)
        for whole in batches:
            for batch in _slices(whole, text):
                got = use.encode_all([t or "" for t in batch.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, *made(use, got)], schema.names)

    return docs.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, text: str) -> Iterable[pa.RecordBatch]:
    """Slices of about ``BATCH`` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + BATCH, "right")))
        yield batch.slice(low, high - low)
        low = high


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each document: its id, token count, and digests of ids and of the decoded text.

    The digests are taken where the ids are made, so that neither these nor the decoded
    text leave the task.
    """
    docs = docs.select("doc_id", "text")

    def made(use: Codec, got: list[np.ndarray]) -> list[pa.Array]:
        return [
            pa.array(map(len, got), pa.int64()),
            pa.array([hashlib.sha256(use.written(x)).hexdigest() for x in got], pa.string()),
            pa.array([hashlib.sha256(use.decode(x).encode()).hexdigest() for x in got], pa.string()),
        ]

    return _with(docs, tokenizer, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", made).drop("text")
