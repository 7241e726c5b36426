"""Repeated strings: maximal repeats from enhanced suffix arrays, and their removal from later documents.

Every string of MIN bytes has a key, the least hash of the short grams in it, so equal strings have equal keys. Runs of
strings with one key are segments. Segments whose key another document has too go to the bucket of their key, each
text once a chunk; a bucket then holds all occurrences of its strings, and its suffix array finds all of their repeats.

A key of very many segments is hot: a frequent passage in ever other surroundings. Its segments are first cut down to
the strings that another document has as well, so that what meets in one bucket is what is repeated.

Texts stay in chunks in the shared folder; keys, segments and answers travel as packed columns, a row for each chunk
and bucket. Nothing grows with the number of copies of a text but the number of chunks that hold one. Texts that are
equal by their hash are compared byte by byte before they count as equal."""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import in_batches, spread, stored, text_of

MIN, GRAM = 50, 16
#: Bytes of a chunk of documents; of text to a bucket; segments of a key from which it is hot.
CHUNK, A_BUCKET, HOT = 4 << 20, 4 << 20, 2048
#: Strings of a segment, at most.
LONGEST = 64
_NONE = np.iinfo(np.int64).max  # stands for a null doc_id, which is after all others
_BASE = 0x9E3779B97F4A7C15
_u = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _u(29))) * _u(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _u(32))) * _u(0x94D049BB133111EB)
    return h ^ (h >> _u(29))


def _gram_hashes(flat: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place on; GRAM is a power of 2."""
    h, step, n = flat.astype(np.uint64), _BASE, 1
    h += _u(1)
    while n < GRAM:
        longer = h[:-n] * _u(step)
        longer += h[n:]
        h, step, n = longer, step * step % 2**64, 2 * n
    h ^= h >> _u(29)
    h *= _u(0xBF58476D1CE4E5B9)
    h ^= h >> _u(32)
    return h


def _window_least(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        h, n = np.minimum(h[:-n], h[n:]), 2 * n
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


class Segments:
    """The segments of a chunk: document (its place), start in the chunk's bytes, length, key, and, if asked for, a
    hash of the text."""

    def __init__(self, texts: list[bytes], hashed: bool = True):
        self.flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        found = [self._part(at, min(at + CHUNK, len(self.flat) - MIN + 1), hashed) for at in range(0, max(0, len(self.flat) - MIN + 1), CHUNK)]
        self.doc, self.start, self.length, self.key, self.hash = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.int64, np.uint64, np.uint64)))

    def _part(self, begin: int, end: int, hashed: bool) -> tuple[np.ndarray, ...]:
        """Of the strings that start from begin to end; long texts go part by part, so that memory is bounded."""
        with np.errstate(over="ignore"):
            grams = _gram_hashes(self.flat[begin : end + MIN - 1])
            key = _window_least(grams, MIN - GRAM + 1)
            # a run starts where the key changes, and with a document; none spans two
            new = np.ones(len(key), dtype=bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            opens = self.starts[(self.starts > begin) & (self.starts < end)] - begin
            new[opens] = True
            first = np.nonzero(new)[0]
            n = np.diff(np.append(first, len(key)))
            doc = np.searchsorted(self.ends, first + begin, side="right")
            n = np.minimum(n, self.ends[doc] - MIN + 1 - begin - first)  # strings that end in the document
            first, doc, n = first[n > 0], doc[n > 0], n[n > 0]
            pieces = -(-n // LONGEST)
            if pieces.max(initial=0) > 1:
                turn = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first, doc = np.repeat(first, pieces) + turn * LONGEST, np.repeat(doc, pieces)
                n = np.minimum(np.repeat(n, pieces) - turn * LONGEST, LONGEST)
            length = n + MIN - 1
            text = _text_hashes(self.flat, first, length, grams) if hashed else np.zeros(0, np.uint64)
            return doc, first + begin, length, key[first], text


    def _strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A hash of each string of the segments, its segment's place in `which`, and its place in the segment."""
        length = self.length[which]
        body, first, n = _cut(self.flat, self.start[which], length), np.cumsum(length) - length, length - MIN + 1
        piece = np.repeat(np.arange(len(which)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return _string_hashes(_gram_hashes(body), first[piece] + at) if len(body) else np.zeros(0, np.uint64), piece, at

    def strings(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash, and the document, of each string of the segments with these keys."""
        which = np.nonzero(np.isin(self.key, keys))[0]
        mark, piece, _ = self._strings(which)
        return mark, self.doc[which][piece]

    def cut(self, keys: np.ndarray, wanted: np.ndarray) -> None:
        """Cut the segments with these keys to runs of strings whose hashes are wanted."""
        hot = np.isin(self.key, keys)
        which = np.nonzero(hot)[0]
        if not len(which):
            return
        mark, piece, at = self._strings(which)
        keep = np.isin(mark, wanted)
        begins = keep & np.concatenate([[True], ~keep[:-1] | (piece[1:] != piece[:-1])])
        ends = keep & np.concatenate([~keep[1:] | (piece[1:] != piece[:-1]), [True]])
        a, z = np.nonzero(begins)[0], np.nonzero(ends)[0]
        seg = which[piece[a]]
        start, length = self.start[seg] + at[a], z - a + MIN
        new = (self.doc[seg], start, length, self.key[seg], _text_hashes(self.flat, start, length))
        self.doc, self.start, self.length, self.key, self.hash = (np.concatenate([old[~hot], more]) for old, more in zip((self.doc, self.start, self.length, self.key, self.hash), new))


def _string_hashes(grams: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of the MIN bytes from each place on, by grams that cover them."""
    mark = np.zeros(len(place), np.uint64)
    with np.errstate(over="ignore"):
        for k in sorted({*range(0, MIN - GRAM, GRAM), MIN - GRAM}):
            mark = mark * _u(_BASE) + grams[place + k]
            mark ^= mark >> _u(31)
    return mark


def _text_hashes(flat: np.ndarray, start: np.ndarray, length: np.ndarray, grams: np.ndarray | None = None) -> np.ndarray:
    """A hash of each piece of MIN to MIN + LONGEST - 1 bytes, over grams that cover it without gaps; the last ones may
    overlap. `grams` are those of flat, if they are known."""
    if grams is None:
        grams = _gram_hashes(_cut(flat, start, length)) if len(start) else np.zeros(0, np.uint64)
        start = np.cumsum(length) - length
    with np.errstate(over="ignore"):
        text = _mixed(length.astype(np.uint64))
        for k in range(0, MIN - 1 + LONGEST, GRAM):
            text = text * _u(_BASE) + grams[start + np.minimum(k, length - GRAM)]
            text ^= text >> _u(31)
        return _mixed(text)


def _confirm(flat: np.ndarray, start: np.ndarray, length: np.ndarray, lead: np.ndarray) -> None:
    """Each piece has the bytes of the piece `lead`, or the hash that said so has failed."""
    other = np.nonzero(lead != np.arange(len(lead)))[0]
    for a in range(0, len(other), 1 << 16):
        x, y = other[a : a + (1 << 16)], lead[other[a : a + (1 << 16)]]
        if not np.array_equal(length[x], length[y]) or not np.array_equal(_cut(flat, start[x], length[x]), _cut(flat, start[y], length[y])):
            raise RuntimeError("two texts with one hash; choose another base for the hashes")


def _cut(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the pieces, one after the other."""
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return flat[np.repeat(start, length) + at]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key & _u(0xFFFFFF)) * _u(buckets) >> _u(24)).astype(np.int64)


def _low(key: np.ndarray) -> np.ndarray:
    """The 40 bits of a key that are compared within a bucket. Keys that only seem equal cost time, not results."""
    return key >> _u(24)


def _pack5(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack5(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


# Chunks ---------------------------------------------------------------------------------------------------------------


def _chunk(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    press, task, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def one() -> pa.RecordBatch:
        body = press.compress(b"".join(texts))
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([body], pa.binary())],
            names=["chunk", "ids", "lengths", "size", "body"],
        )

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            raw = text.as_buffer().to_pybytes()
            if texts and size + len(raw) > most:
                yield one()
                ids, texts, size, number = [], [], 0, number + 1
            ids.append(doc)
            texts.append(raw)
            size += len(raw)
    if texts:
        yield one()


def chunked(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """Whole documents by chunks of at most so many bytes, or one document: chunk, ids, lengths, size (bytes), body
    (compressed)."""
    d = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    return in_batches(d, partial(_chunk, most=most), "chunk long, ids array<long>, lengths array<long>, size long, body binary")


def _texts(table: pa.Table, row: int = 0) -> tuple[np.ndarray, list[bytes]]:
    ids = np.array([_NONE if i is None else i for i in table.column("ids")[row].as_py()], dtype=np.int64)
    body, texts, at = zstandard.ZstdDecompressor().decompress(table.column("body")[row].as_py(), max_output_size=max(1, table.column("size")[row].as_py())) if table.column("size")[row].as_py() else b"", [], 0
    for n in table.column("lengths")[row].as_py():
        texts.append(body[at : at + n])
        at += n
    return ids, texts


# Keys that more than one document has ------------------------------------------------------------------------------------


_SENT = "bucket long, chunk long, keys binary, twice binary, number binary"
_BITS = "chunk long, kind int, bucket long, bits binary, hot binary, none binary"


def _ordered(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a chunk by bucket, then low bits, as _sets() has them; the buckets."""
    found = np.sort(value)
    found = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
    bucket = _bucket(found, buckets)
    order = _by_bucket(found, bucket)
    return found[order], bucket[order]


def _by_bucket(found: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The order by bucket and low bits. Values that are alike in both get the same answers, so theirs is free."""
    if len(bucket) and bucket.max() >= 1 << 23:
        return np.lexsort((_low(found), bucket))
    return np.argsort((bucket.astype(np.uint64) << _u(40)) | _low(found))


def _sets(value: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a chunk by bucket, then low bits; whether two of its documents have each; how often it comes,
    up to 255; the buckets."""
    order = np.argsort(value)
    ranked, doc = value[order], doc[order]
    head = np.nonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))[0] if len(ranked) else np.zeros(0, np.int64)
    found, number = ranked[head], np.diff(np.append(head, len(ranked)))
    low, high = (f.reduceat(doc, head) if len(head) else doc for f in (np.minimum, np.maximum))
    bucket = _bucket(found, buckets)
    order = _by_bucket(found, bucket)
    return found[order], (low != high)[order], np.minimum(number, 255).astype(np.uint8)[order], bucket[order]


def _sent_sets(chunk: int, sets: tuple[np.ndarray, ...], buckets: int) -> pa.RecordBatch:
    found, twice, number, bucket = sets
    at = np.searchsorted(bucket, np.arange(buckets + 1))
    use = np.nonzero(at[1:] > at[:-1])[0]
    spans = [(at[i], at[i + 1]) for i in use]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(use, pa.int64()), pa.array([chunk] * len(use), pa.int64()), pa.array([_pack5(_low(found[a:z])) for a, z in spans], pa.binary()),
            pa.array([np.packbits(twice[a:z]).tobytes() for a, z in spans], pa.binary()), pa.array([number[a:z].tobytes() for a, z in spans], pa.binary()),
        ], names=["bucket", "chunk", "keys", "twice", "number"],
    )


def _send_keys(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        table = pa.Table.from_batches([b])
        for row in range(b.num_rows):
            seg = Segments(_texts(table, row)[1], hashed=False)
            yield _sent_sets(b.column(0)[row].as_py(), _sets(seg.key, seg.doc, buckets), buckets)


def _shared(table: pa.Table, kind: int, hot: int) -> pa.Table:
    """Which of the values that chunks sent to a bucket two documents have; and which of these come `hot` times."""
    parts = [_unpack5(x) for x in table.column("keys").to_pylist()]
    counts = np.array([len(p) for p in parts])
    key = np.concatenate(parts)
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(table.column("twice").to_pylist(), counts)])
    number = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("number").to_pylist()]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    head = np.nonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))[0]
    size = np.diff(np.append(head, len(key)))
    several, many = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    if len(key):
        several[order] = np.repeat((size > 1) | np.maximum.reduceat(twice[order], head), size)
        many[order] = np.repeat(np.add.reduceat(number[order], head) >= hot, size)
    at = np.concatenate([[0], np.cumsum(counts)])
    bits = lambda x: pa.array([np.packbits(x[a:z]).tobytes() for a, z in zip(at, at[1:])], pa.binary())
    none = pa.nulls(len(counts), pa.binary())
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([kind] * len(counts), pa.int32()), "bucket": table.column("bucket"), "bits": bits(several), "hot": bits(several & many) if hot < _NONE else none, "none": none})


def _said(found: np.ndarray, bucket: np.ndarray, buckets: int, rows: list[tuple[int, bytes]]) -> np.ndarray:
    """The flags of a chunk's values, from the (bucket, bits) rows about it."""
    at, flags = np.searchsorted(bucket, np.arange(buckets + 1)), np.zeros(len(found), dtype=bool)
    for i, raw in rows:
        flags[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=at[i + 1] - at[i]).astype(bool)
    return flags


def _rows(bits: pa.Table, kind: int, column: str) -> list[tuple[int, bytes]]:
    return [(r["bucket"], r[column]) for r in bits.select(["kind", "bucket", column]).to_pylist() if r["kind"] == kind and r[column] is not None]


def _known(texts: list[bytes], bits: pa.Table, buckets: int, hashed: bool = True) -> tuple[Segments, np.ndarray, np.ndarray]:
    """The segments of a chunk; the keys that another document has; the hot ones among them."""
    seg = Segments(texts, hashed)
    key, bucket = _ordered(seg.key, buckets)
    return seg, np.sort(key[_said(key, bucket, buckets, _rows(bits, 0, "bits"))]), key[_said(key, bucket, buckets, _rows(bits, 0, "hot"))]


def _send_strings(chunk: pa.Table, bits: pa.Table, buckets: int) -> pa.Table:
    """As _send_keys(), of the strings of hot keys."""
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary()), ("number", pa.binary())])
    if not chunk.num_rows:
        return schema.empty_table()
    seg, _, hot = _known(_texts(chunk)[1], bits, buckets, hashed=False)
    if not len(hot):
        return schema.empty_table()
    return pa.Table.from_batches([_sent_sets(chunk.column("chunk")[0].as_py(), _sets(*seg.strings(hot), buckets), buckets)]).cast(schema)


def _final(texts: list[bytes], bits: pa.Table, buckets: int) -> tuple[Segments, np.ndarray]:
    """The segments of a chunk, those of hot keys cut, and the keys that another document has."""
    seg, shared, hot = _known(texts, bits, buckets)
    if len(hot):
        mark, bucket = _ordered(seg.strings(hot)[0], buckets)
        seg.cut(hot, mark[_said(mark, bucket, buckets, _rows(bits, 1, "bits"))])
    return seg, shared


# Segments to their buckets -----------------------------------------------------------------------------------------------


def _leads(seg: Segments, rank: np.ndarray) -> np.ndarray:
    """For each segment the one of the least rank with its text, compared byte by byte."""
    order = np.argsort(seg.hash)
    ranked = seg.hash[order]
    head = np.nonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))[0] if len(ranked) else np.zeros(0, np.int64)
    number = np.diff(np.append(head, len(ranked)))
    lead = np.arange(len(order))
    several = np.repeat(number > 1, number)
    order, number = order[several], number[number > 1]
    order = order[np.lexsort((order, rank[order], seg.hash[order]))]
    lead[order] = np.repeat(order[np.cumsum(number) - number], number)
    _confirm(seg.flat, seg.start, seg.length, lead)
    return lead


def _send_segments(chunk: pa.Table, bits: pa.Table, buckets: int) -> pa.Table:
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("low", pa.binary()), ("hash", pa.binary()), ("doc", pa.binary()), ("length", pa.binary()), ("text", pa.binary())])
    if not chunk.num_rows or not bits.num_rows:
        return schema.empty_table()
    ids, texts = _texts(chunk)
    seg, shared = _final(texts, bits, buckets)
    place = np.minimum(np.searchsorted(shared, seg.key), max(0, len(shared) - 1))
    use = shared[place] == seg.key if len(shared) and len(seg.key) else np.zeros(len(seg.key), bool)
    # each text once, with the least document that has it
    use = np.nonzero(use & (_leads(seg, ids[seg.doc]) == np.arange(len(seg.key))))[0] if use.any() else np.zeros(0, np.int64)
    if not len(use):
        return schema.empty_table()
    bucket = _bucket(seg.key[use], buckets)
    order = np.argsort(bucket, kind="stable")
    use, bucket = use[order], bucket[order]
    press, number = zstandard.ZstdCompressor(level=3), chunk.column("chunk")[0].as_py()
    edges = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
    rows = []
    for a, z in zip(edges[:-1], edges[1:]):
        u = use[a:z]
        rows.append((int(bucket[a]), number, _pack5(_low(seg.key[u])), seg.hash[u].tobytes(), press.compress(ids[seg.doc[u]].tobytes()), seg.length[u].astype(np.uint8).tobytes(), press.compress(_cut(seg.flat, seg.start[u], seg.length[u]).tobytes())))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# The suffix array of a bucket --------------------------------------------------------------------------------------------


def repeated_starts(text: np.ndarray, start: np.ndarray, length: np.ndarray, least: int = MIN) -> tuple[np.ndarray, np.ndarray]:
    """Places, with their pieces, whose `least` bytes occur in several places that don't all follow one same byte.

    Other suffixes are in no maximal repeat: theirs occur once, or start a byte earlier. Compared by hashes of the
    bytes, so a few places too many may come; none is missed."""
    n = np.maximum(length - least + 1, 0)
    piece = np.repeat(np.arange(len(start)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    if not len(place):
        return place, piece
    with np.errstate(over="ignore"):
        grams, mark = _gram_hashes(text), np.zeros(len(place), np.uint64)
        for k in sorted({*range(0, least - GRAM, GRAM), least - GRAM}):
            mark = mark * _u(_BASE) + grams[place + k]
            mark ^= mark >> _u(31)
    order = np.argsort(mark)
    mark, left = mark[order], np.where(place == start[piece], -1, text[np.maximum(place - 1, 0)].astype(np.int16))[order]
    head = np.nonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))[0]
    count = np.diff(np.append(head, len(mark)))
    low, high = np.minimum.reduceat(left, head), np.maximum.reduceat(left, head)
    use = np.sort(order[np.repeat((count > 1) & ((low != high) | (low == -1)), count)])
    return place[use], piece[use]


def enhanced_suffix_array(text: np.ndarray, place: np.ndarray, end: np.ndarray, least: int = MIN) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start at `place` and stop before `end`, and the common prefix of each with the
    one before; 0 where that is under `least`. Each has `least` bytes or more; an absent byte comes before all."""
    rest = end - place
    reach = int(rest.max(initial=0))
    wide = np.concatenate([text, np.zeros(reach + 16, np.uint8)])
    keys = []
    for k in range(0, reach, 7):  # seven bytes a key: a byte counts one more than itself, or 0 beyond the end
        key = np.zeros(len(place), np.uint64)
        for j in range(k, k + 7):
            key = key * _u(257) + np.where(rest > j, wide[place + np.minimum(j, reach)].astype(np.uint64) + _u(1), _u(0))
        keys.append(key)
    order = np.lexsort(keys[::-1]) if keys else np.zeros(0, np.int64)
    lcp = np.zeros(len(order), dtype=np.int64)
    alive = np.arange(1, len(order))
    p, q = place[order], place[order[:-1]]
    room = np.minimum(rest[order][1:], rest[order][:-1])
    for k in range(reach):
        alive = alive[room[alive - 1] > k]
        alive = alive[wide[p[alive] + k] == wide[q[alive - 1] + k]]
        if not len(alive):
            break
        lcp[alive] += 1
    lcp[lcp < least] = 0
    return order, lcp


def lcp_intervals(lcp: list[int], left: list[int], least: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """The maximal repeats: (length, first, last, least value) of each interval of the common-prefix interval tree
    whose suffixes can't all be extended to the left by one same byte.

    A stack holds the open intervals, each with the one left byte seen so far (-2: several; -1 in `left` is a byte
    like no other) and the least value; a closed interval hands both to the one that it lies in."""
    stack: list[list[int]] = []
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else 0
        first, byte, low = i - 1, left[i - 1], least[i - 1]
        if byte == -1:
            byte = -2 if depth or stack else -1
        while stack and stack[-1][0] > depth:
            length, start, own, value = stack.pop()
            own, value = own if own == byte else -2, min(value, low)
            if own == -2:
                yield length, start, i - 1, value
            first, byte, low = start, own, value
        if depth:
            if stack and stack[-1][0] == depth:
                top = stack[-1]
                if top[2] != byte:
                    top[2] = -2
                if low < top[3]:
                    top[3] = low
            else:
                stack.append([depth, first, byte, low])


def maximal_repeats(text: np.ndarray, start: np.ndarray, length: np.ndarray, value: np.ndarray, least: int = MIN) -> tuple[np.ndarray, ...]:
    """All occurrences of all maximal repeats of `least` bytes or more among the pieces: group, piece, place in text,
    length, and the least `value` of a piece in the group."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    place, piece = repeated_starts(text, start, length, least)
    if not len(place):
        return none
    order, lcp = enhanced_suffix_array(text, place, start[piece] + length[piece], least)
    place, piece = place[order], piece[order]
    left = np.where(place == start[piece], -1, text[np.maximum(place - 1, 0)].astype(np.int64))
    groups = list(lcp_intervals(lcp.tolist(), left.tolist(), value[piece].tolist()))
    if not groups:
        return none
    size, first, last, least_value = (np.array(c, dtype=np.int64) for c in zip(*groups))
    number = last - first + 1
    group = np.repeat(np.arange(len(groups)), number)
    at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + first[group]
    return group, piece[at], place[at], size[group], least_value[group]


class _Bucket:
    """The segments of a bucket, unpacked: low bits of the key, hash, document, start and length in `flat`, row of the
    table; and the distinct texts: the number of each segment's, and the first holder of each."""

    def __init__(self, table: pa.Table):
        press, self.chunks = zstandard.ZstdDecompressor(), table.column("chunk").to_pylist()
        joined = lambda name, kind, plain: np.concatenate([np.frombuffer(x if plain else press.decompress(x), kind) for x in table.column(name).to_pylist()])
        low = np.concatenate([_unpack5(x) for x in table.column("low").to_pylist()])
        self.hash, self.doc, self.flat = joined("hash", np.uint64, True), joined("doc", np.int64, False), joined("text", np.uint8, False)
        self.length = joined("length", np.uint8, True).astype(np.int64)
        self.row = np.repeat(np.arange(table.num_rows), [len(x) // 8 for x in table.column("hash").to_pylist()])
        self.start = np.cumsum(self.length) - self.length
        order = np.lexsort((self.doc, self.hash, low))
        new, key = np.ones(len(order), dtype=bool), np.ones(len(order), dtype=bool)
        key[1:] = low[order][1:] != low[order][:-1]
        new[1:] = key[1:] | (self.hash[order][1:] != self.hash[order][:-1])
        self.text = np.empty(len(order), dtype=np.int64)
        self.text[order] = np.cumsum(new) - 1
        self.lead, self.of_key = order[new], (np.cumsum(key) - 1)[new]
        _confirm(self.flat, self.start, self.length, self.lead[self.text])

    def maximal(self) -> tuple[np.ndarray, ...]:
        """maximal_repeats() of the distinct texts of keys that have several: group, text, place in it, length, and the
        least document of the group."""
        several = np.nonzero(np.bincount(self.of_key)[self.of_key] > 1)[0]
        if not len(several):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        pick = self.lead[several]
        length = self.length[pick]
        begin = np.cumsum(length + 1) - length - 1
        body = np.full(int((length + 1).sum()), 0xFF, np.uint8)  # UTF-8 has no such byte
        body[np.repeat(begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = _cut(self.flat, self.start[pick], length)
        group, piece, place, size, least = maximal_repeats(body, begin, length, self.doc[pick])
        return group, several[piece], place - begin[piece], size, least

    def answers(self, which: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray | None = None) -> pa.Table:
        """For each chunk the parts of its segments: hash, from and length, and the group if there is one."""
        schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary()), ("hot", pa.binary()), ("none", pa.binary())])
        if not len(which):
            return schema.empty_table()
        by = np.argsort(self.row[which], kind="stable")
        which, begin, size = which[by], begin[by], size[by]
        edges = np.concatenate([[0], np.nonzero(np.diff(self.row[which]))[0] + 1, [len(which)]])
        packed = lambda a, z: np.stack([begin[a:z], size[a:z]]).astype(np.uint8).tobytes()
        rows = [(self.chunks[self.row[which[a]]], 2, 0, self.hash[which[a:z]].tobytes(), packed(a, z), None if group is None else group[by][a:z].tobytes()) for a, z in zip(edges[:-1], edges[1:])]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _bucket_repeats(table: pa.Table) -> pa.Table:
    """For each chunk the parts of its segments' texts that a smaller document has. A whole segment is one part. Only
    for the least document of the chunk that has the segment; for its others the chunk itself knows."""
    b = _Bucket(table)
    later = np.nonzero(b.doc > b.doc[b.lead][b.text])[0]
    _, text, place, size, least = b.maximal()
    more = least < b.doc[b.lead[text]]
    which = np.concatenate([later, b.lead[text[more]]])
    return b.answers(which, np.concatenate([np.zeros(len(later), np.int64), place[more]]), np.concatenate([b.length[later], size[more]]))


def _bucket_groups(table: pa.Table) -> pa.Table:
    """For each chunk all parts of its segments' texts that are maximal repeats, with a digest of the repeat."""
    b = _Bucket(table)
    holders = np.argsort(b.text, kind="stable")
    count = np.bincount(b.text)
    first = np.cumsum(count) - count
    whole = np.nonzero(count > 1)[0]
    _, text, place, size, _ = b.maximal()
    text, place, size = np.concatenate([whole, text]), np.concatenate([np.zeros(len(whole), np.int64), place]), np.concatenate([b.length[b.lead[whole]], size])
    at = b.start[b.lead[text]] + place
    group = np.array([xxhash.xxh64_intdigest(b.flat[x : x + n].tobytes()) for x, n in zip(at.tolist(), size.tolist())], dtype=np.uint64)
    n = count[text]
    which = holders[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[text], n)]
    return b.answers(which, np.repeat(place, n), np.repeat(size, n), np.repeat(group, n))


# Removal ---------------------------------------------------------------------------------------------------------------


def _answered(seg: Segments, said: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment, place in the chunk, length and group of each part that the buckets name, of all segments with its
    text."""
    said = [r for r in said.select(["kind", "bits", "hot", "none"]).to_pylist() if r["kind"] == 2]
    if not said:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    of, both = np.concatenate([np.frombuffer(r["bits"], np.uint64) for r in said]), [np.frombuffer(r["hot"], np.uint8).reshape(2, -1) for r in said]
    begin, size = np.concatenate(both, axis=1).astype(np.int64)
    group = np.concatenate([np.frombuffer(r["none"], np.uint64) for r in said]) if said[0]["none"] is not None else np.zeros(len(of), np.uint64)
    by = np.argsort(of, kind="stable")
    of, begin, size, group = of[by], begin[by], size[by], group[by]
    named = np.nonzero(np.isin(seg.hash, of, kind="sort"))[0]
    a, z = np.searchsorted(of, seg.hash[named], side="left"), np.searchsorted(of, seg.hash[named], side="right")
    which = np.repeat(named, z - a)
    at = np.arange((z - a).sum()) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + np.repeat(a, z - a)
    return which, seg.start[which] + begin[at], size[at], group[at]


def _covered(ids: np.ndarray, texts: list[bytes], said: pa.Table, buckets: int) -> tuple[Segments, np.ndarray]:
    """Which bytes of the chunk lie in a string that a smaller document has."""
    seg, _ = _final(texts, said, buckets)
    change = np.zeros(len(seg.flat) + 1, dtype=np.int64)
    if len(seg.hash):
        own = ids[seg.doc]
        full = own > own[_leads(seg, own)]
        which, place, size, _ = _answered(seg, said)
        named = ~full[which]
        for at, n in ((seg.start[full], seg.length[full]), (place[named], size[named])):
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
    return seg, np.cumsum(change[:-1]) > 0


def _report(chunk: pa.Table, said: pa.Table, buckets: int) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    if not chunk.num_rows:
        return schema.empty_table()
    ids, texts = _texts(chunk)
    seg, gone = _covered(ids, texts, said, buckets)
    rows = []
    for doc, a, z in zip(chunk.column("ids")[0].as_py(), seg.starts.tolist(), seg.ends.tolist()):
        out = gone[a:z]
        removed = int(out.sum())
        spans = int(np.count_nonzero(out[1:] & ~out[:-1]) + (len(out) > 0 and bool(out[0])))
        rows.append((doc, z - a, removed, spans, hashlib.sha256(seg.flat[a:z][~out].tobytes()).hexdigest()))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _kept(chunk: pa.Table, said: pa.Table, buckets: int) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    if not chunk.num_rows:
        return schema.empty_table()
    ids, texts = _texts(chunk)
    seg, gone = _covered(ids, texts, said, buckets)
    rows = []
    for doc, a, z in zip(chunk.column("ids")[0].as_py(), seg.starts.tolist(), seg.ends.tolist()):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:z].astype(np.int8), [0]])))
        rows.append((doc, seg.flat[a:z][~gone[a:z]].tobytes(), [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _grouped(chunk: pa.Table, said: pa.Table, buckets: int) -> pa.Table:
    schema = pa.schema([("group", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
    if not chunk.num_rows:
        return schema.empty_table()
    _, texts = _texts(chunk)
    seg, shared = _final(texts, said, buckets)
    which, place, size, group = _answered(seg, said)
    _, inverse, count = np.unique(seg.hash, return_inverse=True, return_counts=True) if len(seg.hash) else (0, np.zeros(0, int), np.zeros(0, int))
    whole = np.nonzero((count[inverse] > 1) & np.isin(seg.key, shared))[0]  # whose other holders may all be in this chunk
    own = np.array([xxhash.xxh64_intdigest(seg.flat[a : a + n].tobytes()) for a, n in zip(seg.start[whole].tolist(), seg.length[whole].tolist())], dtype=np.uint64)
    which, place, size, group = (np.concatenate(x) for x in ((which, whole), (place, seg.start[whole]), (size, seg.length[whole]), (group, own)))
    once = np.unique(np.stack([group.view(np.int64), place, size, seg.doc[which]], axis=1), axis=0) if len(which) else np.zeros((0, 4), np.int64)
    doc = once[:, 3]
    ids = chunk.column("ids")[0].as_py()
    return pa.Table.from_arrays([pa.array(once[:, 0]), pa.array([ids[d] for d in doc.tolist()], pa.int64()), pa.array(once[:, 1] - seg.starts[doc] if len(doc) else once[:, 1]), pa.array(once[:, 2])], schema=schema)


def _release(spark) -> None:
    """Lets Spark drop the files of shuffles that nothing refers to any more, which it does soon after a collection of
    the driver's garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def _answers(docs: DataFrame, find, chunk: int, a_bucket: int, hot: int) -> tuple[DataFrame, DataFrame, int]:
    """The chunks, what the buckets say about each, and the number of buckets."""
    spark = docs.sparkSession
    chunks = stored(chunked(docs, chunk), "chunks")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = 1 + total // a_bucket
    shared = lambda sent, kind, most: stored(sent.groupBy("bucket").applyInArrow(lambda t: _shared(t, kind, most), _BITS), "bits")
    bits = shared(chunks.mapInArrow(partial(_send_keys, buckets=buckets), _SENT), 0, hot)
    _release(spark)
    if not bits.where(F.regexp_count(F.hex("hot"), F.lit("[^0]")) > 0).isEmpty():
        both = chunks.groupBy("chunk").cogroup(bits.groupBy("chunk"))
        strings = shared(both.applyInArrow(lambda c, b: _send_strings(c, b, buckets), _SENT), 1, _NONE)
        del both
        bits = bits.unionByName(strings)
        _release(spark)
    both = chunks.groupBy("chunk").cogroup(bits.groupBy("chunk"))
    segments = both.applyInArrow(lambda c, b: _send_segments(c, b, buckets), "bucket long, chunk long, low binary, hash binary, doc binary, length binary, text binary")
    answers = stored(segments.groupBy("bucket").applyInArrow(find, _BITS), "answers")
    del both, segments
    _release(spark)
    return chunks, bits.unionByName(answers), buckets


def _by_chunk(docs: DataFrame, find, finish, schema: str, chunk: int, a_bucket: int, hot: int) -> DataFrame:
    chunks, said, buckets = _answers(docs, find, chunk, a_bucket, hot)
    return chunks.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(lambda c, s: finish(c, s, buckets), schema)


def repeat_groups(docs: DataFrame, chunk: int = CHUNK, a_bucket: int = A_BUCKET, hot: int = HOT) -> DataFrame:
    """group, doc_id, start, length (bytes): all occurrences of the maximal repeats of MIN bytes or more that two
    documents have. `group` is a digest of the repeated string.

    A repeat is maximal within its segment, a run of strings with one key of at most MIN + LONGEST - 1 bytes; of a
    longer passage the groups overlap, so that they cover it, and each of its strings of MIN bytes is in one with all
    its occurrences. Nulls, short texts, repeated rows and empty tables as in repeat_report()."""
    return _by_chunk(docs, _bucket_groups, _grouped, "group long, doc_id long, start long, length long", chunk, a_bucket, hot)


def repeat_report(docs: DataFrame, chunk: int = CHUNK, a_bucket: int = A_BUCKET, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row: what stays of its text, as UTF-8, without each
    byte of a 50-byte string that also starts in a document with a smaller doc_id.

    A null text is empty; texts under 50 bytes lose nothing; a null doc_id counts as larger than all others; rows
    that repeat a doc_id are judged each, and not against each other; other columns are ignored; no rows, no rows."""
    return _by_chunk(docs, _bucket_repeats, _report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", chunk, a_bucket, hot)


def without_repeats(docs: DataFrame, chunk: int = CHUNK, a_bucket: int = A_BUCKET, hot: int = HOT) -> DataFrame:
    """doc_id, kept (the bytes that stay), removed (start and end of each removed run); see repeat_report()."""
    return _by_chunk(docs, _bucket_repeats, _kept, "doc_id long, kept binary, removed array<struct<start:long,end:long>>", chunk, a_bucket, hot)


#: The rows of repeat_report() over `documents`, by all 50-byte strings.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50),
g AS (SELECT p.doc_id, p.i, substr(d.h, 2 * p.i + 1, 100) AS s FROM p JOIN d USING (doc_id)),
m AS (SELECT s, min(doc_id) AS low FROM g GROUP BY 1),
x AS (SELECT g.doc_id, g.i FROM g JOIN m USING (s) WHERE m.low < g.doc_id),
e AS (SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
r AS (SELECT doc_id, i, sum(CASE WHEN before >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY 1, 2),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM u),
t AS (SELECT k.doc_id, string_agg(substr(d.h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS body, max(z) AS fin, count(*) AS spans, sum(z - a) AS gone FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(t.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN t.doc_id IS NULL THEN d.h ELSE t.body || substr(d.h, 2 * t.fin + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
