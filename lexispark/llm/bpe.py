"""Encoding and decoding by byte-pair merges, each found at the root of a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import in_batches, spread, text_of
from lexispark.llm.packing import TEXT_AT_ONCE, Recent, WordIds, _spans

#: Parts whose ids a Python worker keeps: twice as many at most.
CACHED = 200_000
#: Words of one text whose ids are written out at once.
WORDS_AT_ONCE = 1 << 18
#: Parts of more signs than this have their tree in flat arrays, not in lists.
LONG = 1 << 12
#: Parts of up to so many pairs are merged many at a time; trees of so many leaves in all at once.
LEAVES, LEAVES_AT_ONCE = 64, 1 << 17
_NO_PAIR = (1 << 63) - 1
_SHIFT = 32


def merge_all(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """What is left of `symbols` when the leftmost pair of the lowest rank has been merged until no pair has a rank.

    ranks: of the pair a << 32 | b; made: the symbol that the pair of each rank becomes. A leaf of the tree stands for
    the pair that begins at a place, as rank * leaves + place, so that the least key at the root is the merge to make.
    A merge changes three leaves at most, each with the nodes above it: O(n log n) for n symbols, whatever their pairs."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    keep = (lambda values: array("q", values)) if n > LONG else list
    tree = keep([_NO_PAIR]) * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(symbols[i] << _SHIFT | symbols[i + 1])
        if rank is not None:
            tree[size + i] = rank * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    if tree[1] == _NO_PAIR:
        return symbols
    now, after, before = keep(symbols), keep(range(1, n + 1)), keep(range(-1, n - 1))
    while (key := tree[1]) != _NO_PAIR:
        rank, i = divmod(key, size)
        j = after[i]
        k = after[j]
        h = before[i]
        now[i], now[j] = made[rank], -1
        after[i] = k
        # the pair of the left neighbour, the one that now begins here, and that of the symbol that is gone
        changes = []
        if h >= 0:
            changes.append((h, ranks.get(now[h] << _SHIFT | now[i])))
        if k < n:
            before[k] = i
            changes.append((i, ranks.get(now[i] << _SHIFT | now[k])))
            changes.append((j, None))
        else:
            changes.append((i, None))
        for at, rank in changes:
            key = _NO_PAIR if rank is None else rank * size + at
            at += size
            if tree[at] == key:
                continue
            tree[at] = key
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1
    return [s for s in now if s >= 0]


class Merges:
    """The list of merges as arrays, and merge_all() over many short runs of symbols at a time: a tree for each, side by
    side in one array, whose roots are read and whose changed leaves are carried up for all runs together."""

    def __init__(self, ranks: dict[int, int], made: list[int]):
        self.ranks, self.made_list = ranks, made
        pairs = np.fromiter(ranks.keys(), np.int64, len(ranks))
        order = np.argsort(pairs)
        self.pairs, self.rank_of = np.append(pairs[order], _NO_PAIR), np.append(np.fromiter(ranks.values(), np.int64, len(ranks))[order], 0)
        self.made = np.array(made or [0], dtype=np.int64)

    def keys(self, a: np.ndarray, b: np.ndarray, place: np.ndarray | int, bits: int) -> np.ndarray:
        """The leaf's key of the pair of symbols a, b that begins at `place`; -1 is no symbol."""
        pair = a << _SHIFT | b
        at = np.searchsorted(self.pairs, pair)
        return np.where((self.pairs[at] == pair) & (a >= 0) & (b >= 0), self.rank_of[at] << bits | place, _NO_PAIR)

    def of_class(self, symbols: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """symbols: a row for each run of up to 2**bits + 1, filled up with -1. What is left of all runs in a row, and
        how many of each."""
        rows, size = len(symbols), 1 << bits
        width = size + 2  # the last column stands behind every run, and before it
        now = np.concatenate([symbols, np.full((rows, 1), -1, np.int64)], axis=1).ravel()
        after = np.tile(np.arange(1, width + 1) % width, rows)
        before = np.tile(np.arange(-1, width - 1) % width, rows)
        tree = np.full((rows, 2 * size), _NO_PAIR, np.int64)
        tree[:, size:] = self.keys(symbols[:, :-1], symbols[:, 1:], np.arange(size), bits)
        for i in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        tree = tree.ravel()
        live = np.arange(rows)
        while len(live):
            key = tree[live * (2 * size) + 1]
            some = key != _NO_PAIR
            if not some.all():
                live, key = live[some], key[some]
            row, root = live * width, live * (2 * size)
            i = key & (size - 1)
            j = after[row + i]
            k, h = after[row + j], before[row + i]
            new = self.made[key >> bits]
            now[row + i], now[row + j] = new, -1
            after[row + i], before[row + k] = k, i
            right, left = self.keys(new, now[row + k], i, bits), self.keys(now[row + h], new, h, bits)
            # the pair of the symbol that is gone, unless that was the last one; the new symbol's; its left neighbour's
            gone, first = j < size, h < size
            tree[root[gone] + size + j[gone]] = _NO_PAIR
            own = i < size
            tree[root[own] + size + i[own]] = right[own]
            tree[root[first] + size + h[first]] = left[first]
            for place, there in ((j, gone), (i, own), (h, first)):
                node, base = (place[there] + size) >> 1, root[there]
                for _ in range(bits):
                    tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
                    node >>= 1
        now = now.reshape(rows, width)
        kept = now >= 0
        return now[kept], kept.sum(axis=1)

    def of_runs(self, runs: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """runs: the symbols of all runs in a row, size: how many each has. The same of what is left of them."""
        first, bits = np.cumsum(size) - size, np.zeros(len(size), dtype=np.int64)
        for b in range(LEAVES.bit_length()):
            bits[size > (1 << b) + 1] = b + 1
        left, found = np.zeros(len(size), dtype=np.int64), []
        for b in np.unique(bits).tolist():
            own = np.flatnonzero(bits == b)
            if 1 << b > LEAVES:
                for x in own.tolist():
                    out = np.array(merge_all(runs[first[x] : first[x] + size[x]].tolist(), self.ranks, self.made_list), dtype=np.int64)
                    left[x] = len(out)
                    found.append((own[own == x], out))
                continue
            wide = (1 << b) + 1
            for at in range(0, len(own), max(1, LEAVES_AT_ONCE >> b)):
                some = own[at : at + max(1, LEAVES_AT_ONCE >> b)]
                rows = np.full((len(some), wide), -1, np.int64)
                rows[np.arange(wide) < size[some][:, None]] = runs[_spans(first[some], size[some])]
                out, left[some] = self.of_class(rows, b)
                found.append((some, out))
        start, every = np.cumsum(left) - left, np.empty(left.sum(), dtype=np.int64)
        for some, out in found:
            every[_spans(start[some], left[some])] = out
        return every, left


class TreeIds(WordIds):
    """Ids and decoded text of texts: parts as in WordIds, merged by merge_all() over the file's list of merges."""

    def __init__(self, tokenizer_file: str):
        super().__init__(tokenizer_file)
        whole = json.loads(Path(tokenizer_file).read_text("utf-8"))
        model, ids = whole["model"], whole["model"]["vocab"]
        if whole.get("decoder") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain merges of bytes, decoded without a decoder, are known here")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids, self.tokens = ids, {i: t for t, i in ids.items()} | {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[a] << _SHIFT | ids[b]] = rank
            self.made.append(ids[a + b])
        self.merges = Merges(self.ranks, self.made)
        signs = _signs_of_bytes()
        self.inner = np.array([ids.get(x, -1) for x in signs], dtype=np.int64)
        self.final = np.array([ids.get(x + self.suffix, -1) for x in signs], dtype=np.int64)
        count = 1 + max(self.tokens, default=0)
        self.as_number = pa.array(map(str, range(count)), pa.string())
        self.as_token = pa.array([self.tokens.get(i) for i in range(count)], pa.string())
        self.texts = Recent(CACHED)

    def encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts in a row, and how many each has: its bytes as signs, the last one with the end of a word, then
        merged. A sign that the vocabulary lacks is left out, as the library does without an unknown token."""
        raw = [p.encode() for p in parts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        every = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[every]
        ends = np.cumsum(size)[size > 0] - 1
        symbols[ends] = self.final[every[ends]]
        if (symbols < 0).any():
            size = np.bincount(np.repeat(np.arange(len(size)), size)[symbols >= 0], minlength=len(size))
            symbols = symbols[symbols >= 0]
        ids, size = self.merges.of_runs(symbols, size)
        if any(p in self.added for p in parts):
            each = [ids[z - n : z] if p not in self.added else np.frombuffer(self.added[p], dtype="<u4") for p, n, z in zip(parts, size.tolist(), np.cumsum(size).tolist())]
            ids, size = np.concatenate(each).astype(np.int64), np.fromiter(map(len, each), np.int64, len(each))
        return ids, size

    def decoded(self, ids: list[int]) -> str:
        """Tokens of ids, one blank between them; an id without a token gives nothing."""
        return " ".join(t for i in ids if (t := self.tokens.get(i)) is not None)

    def written(self, parts: list[str]) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Of each distinct part: its ids in decimals, its decoded text, and how many ids it has."""
        if lack := self.texts.lacking(parts):
            ids, size = self.encoded(lack)
            at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            numbers, tokens = (pc.binary_join(pa.ListArray.from_arrays(at, x.take(pa.array(ids))), " ").to_pylist() for x in (self.as_number, self.as_token))
            self.texts.update(zip(lack, zip(numbers, tokens, size.tolist())))
        numbers, tokens, size = zip(*map(self.texts.__getitem__, parts)) if parts else ((), (), ())
        return pa.array(numbers, pa.string()), pa.array(tokens, pa.string()), np.array(size, dtype=np.int64)

    def report(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """Of each text: the number of its ids, and the SHA-256 of its ids and of its decoded text."""
        codes, count, distinct = self.words(texts)
        flat = distinct.flatten().dictionary_encode()
        ids, tokens, number = self.written(flat.dictionary.to_pylist())
        at = np.concatenate([[0], np.cumsum(distinct.value_lengths().to_numpy())])
        part = flat.indices.to_numpy()
        some = number[part] > 0
        if not some.all():  # an empty part stands for no token, so for no blank either
            part, at = part[some], np.concatenate([[0], np.cumsum(some)])[at]
        a_word = np.diff(np.concatenate([[0], np.cumsum(number[part])])[at])
        joined = [pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), x.take(pa.array(part))), " ") for x in (ids, tokens)]
        ends = np.concatenate([[0], np.cumsum(count)])
        if not a_word.all():
            some = a_word[codes] > 0
            codes, ends = codes[some], np.concatenate([[0], np.cumsum(some)])[ends]
        totals = np.diff(np.concatenate([[0], np.cumsum(a_word[codes])])[ends]).tolist()
        return totals, *([h.hexdigest() for h in self._hashed(x, codes, ends)] for x in joined)

    def _hashed(self, words: pa.Array, codes: np.ndarray, ends: np.ndarray) -> Iterator:
        """SHA-256 of each text's words joined by blanks, a bounded number of words at a time."""
        text, last = 0, len(ends) - 1
        while text < last:
            stop = max(text + 1, min(last, int(np.searchsorted(ends, ends[text] + WORDS_AT_ONCE, side="right")) - 1))
            if stop == text + 1:  # one text, of any length
                h = hashlib.sha256()
                for a in range(ends[text], ends[stop], WORDS_AT_ONCE):
                    z = min(a + WORDS_AT_ONCE, ends[stop])
                    h.update((b" " if a > ends[text] else b"") + self._joined(words, codes[a:z], np.array([0, z - a]))[0])
                yield h
            else:
                for whole in self._joined(words, codes[ends[text] : ends[stop]], ends[text : stop + 1] - ends[text]):
                    yield hashlib.sha256(whole)
            text = stop

    @staticmethod
    def _joined(words: pa.Array, codes: np.ndarray, ends: np.ndarray) -> list[bytes]:
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(codes)))
        return pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()


def _signs_of_bytes() -> list[str]:
    """The sign that stands for each byte: itself where it can be seen, else the next free ones from 256 on."""
    seen = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


def _report(batches: Iterator[pa.RecordBatch], tokenizer_file: str) -> Iterator[pa.RecordBatch]:
    ids_of = TreeIds.at(tokenizer_file)
    for batch in batches:
        sizes, at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy()), 0
        while at < batch.num_rows:  # a text alone, or several of bounded size
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_AT_ONCE, side="right")))
            number, ids, texts = ids_of.report(batch.column(1).slice(at, upto - at))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), pa.array(number, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            at = upto


def encoding_report(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids with one blank between them) and decoded_sha256 of each text.

    A null text counts as empty and has no ids; a null or repeated doc_id stays as it is; added tokens that a text spells
    out are their ids; other columns are ignored; an empty table gives an empty result. One pass without a shuffle: each
    distinct part of a word is merged once for each worker that meets it and does not hold it any more. A run of letters
    or of signs without a break takes some 60 bytes of memory for each of its own bytes while it is merged."""
    return in_batches(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))), partial(_report, tokenizer_file=tokenizer_file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(batches: Iterator[pa.RecordBatch], tokenizer_file: str) -> Iterator[pa.RecordBatch]:
    ids_of = TreeIds.at(tokenizer_file)
    for batch in batches:
        for i in range(batch.num_rows):
            codes, _, distinct = ids_of.words(batch.column(1).slice(i, 1))
            every, size = ids_of.encoded(distinct.flatten().to_pylist())
            first, a_word = np.cumsum(size) - size, distinct.value_lengths().to_numpy()
            part = _spans((np.cumsum(a_word) - a_word)[codes], a_word[codes])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([every[_spans(first[part], size[part])].astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encoded(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id and the ids of its text, an array. Odd rows as in encoding_report()."""
    return in_batches(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))), partial(_encode, tokenizer_file=tokenizer_file), "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], tokenizer_file: str) -> Iterator[pa.RecordBatch]:
    ids_of = TreeIds.at(tokenizer_file)
    for batch in batches:
        texts = [None if ids is None else ids_of.decoded(ids) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decoded(rows: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id and the text of its `ids`: tokens with one blank between them, as the library joins them without a decoder.
    Null ids give a null text, ids without a token nothing."""
    return in_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), partial(_decode, tokenizer_file=tokenizer_file), "doc_id long, text string")
