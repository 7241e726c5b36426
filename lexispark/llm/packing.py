"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import os
import string
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexispark.llm.common import in_batches, spread, stored, text_of

#: Parts of words whose ids a Python worker keeps: twice as many at most, those used last.
CACHED_PARTS = 100_000
#: Bytes of text, and parts, that are looked up at once.
TEXT_AT_ONCE, PARTS_AT_ONCE = 4 << 20, 1 << 18
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Recent(dict):
    """A cache of bounded size: when it is full, what it holds becomes the older half, and the older half goes."""

    def __init__(self, size: int):
        self.size, self.older = size, {}

    def lacking(self, keys: Iterable[str]) -> list[str]:
        """Those of the distinct keys that neither half has; those of the older half come into the newer one."""
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        lack, older = [], self.older
        for key in keys:
            if key not in self:
                if (found := older.get(key)) is None:
                    lack.append(key)
                else:
                    self[key] = found
        return lack


class WordIds:
    """Ids of texts.

    The tokenizer never joins what white space parts, so its ids of a text are those of its words in a row, and a
    word's ids those of its parts: runs of letters, single digits, runs of other signs. Arrow splits a batch of texts
    into words, the distinct ones into parts, and numbers both; Python handles each distinct part of a batch once, and
    the tokenizer each part that the worker has not seen of late. What is a letter, a digit or white space beyond ASCII
    is the tokenizer's to say, whose tables are of another version of Unicode than Arrow's and Python's. Added tokens
    that a text spells out are parts of their own, as to the tokenizer."""

    #: Parts of words of ASCII signs alone.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"
    of_file: dict[tuple[type, str], WordIds] = {}

    def __init__(self, tokenizer_file: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.parts = Tokenizer.from_file(tokenizer_file), Recent(CACHED_PARTS)
        # the same model for parts, which need no normalising and no other split than at blanks; its last tokens end so
        self.plain = Tokenizer.from_file(tokenizer_file)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.last = np.zeros(1 + max(vocabulary.values()), dtype=bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens must stand for their own characters alone")
        self.added = {t.content: _bytes([i]) for i, t in added.items()}
        self.pieces = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split if self.added else lambda text: [text]
        self.apart, self.split = regex.compile(r"\p{White_Space}+").split, regex.compile(self.PARTS).findall
        self.foreign_split = self.tokenizer.pre_tokenizer[0]  # without the bytes' signs, which come next

    @classmethod
    def at(cls, tokenizer_file: str) -> WordIds:
        if (cls, tokenizer_file) not in cls.of_file:
            cls.of_file[cls, tokenizer_file] = cls(tokenizer_file)
        return cls.of_file[cls, tokenizer_file]

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The words of all texts in a row as numbers, how many each text has, and the parts of the word of each number."""
        split = pc.utf8_split_whitespace(texts)
        words, count = split.flatten(), split.value_lengths().to_numpy()
        odd = np.zeros(len(texts), dtype=bool)
        for sign in ("\x1c", "\x1d", "\x1e", "\x1f", *self.added):  # white space to Arrow alone, or a part of its own
            odd |= pc.match_substring(texts, sign).to_numpy(zero_copy_only=False)
        if odd.any():
            every = [self._odd(t.as_py()) if x else w.as_py() for t, w, x in zip(texts, split, odd)]
            words, count = pa.array([w for each in every for w in each], pa.string()), np.array([len(each) for each in every])
        numbered = words.dictionary_encode()
        return numbered.indices.to_numpy(), count, self._parts(numbered.dictionary, odd.any())

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each closed by end_id, and where each text's ids end."""
        codes, count, distinct = self.words(texts)
        parts = distinct.flatten().dictionary_encode()
        ids = [*self.of_parts(parts.dictionary.to_pylist()), end_id.to_bytes(4, "little")]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        first, every = np.cumsum(size) - size, np.frombuffer(b"".join(ids), dtype="<u4")
        # from words to parts; the end is one word more, of one part
        a_word = np.append(distinct.value_lengths().to_numpy(), 1)
        begin, part = np.cumsum(a_word) - a_word, np.append(parts.indices.to_numpy(), len(ids) - 1)
        ids_a_word = np.add.reduceat(np.append(size[part], 0), begin) * (a_word > 0)
        word = np.insert(codes, np.cumsum(count), len(a_word) - 1)
        at = np.concatenate([[0], np.cumsum(ids_a_word[word])])
        out = np.empty(at[-1], dtype="<u4")
        for a in range(0, len(word), PARTS_AT_ONCE):
            some = word[a : a + PARTS_AT_ONCE]
            own = part[_spans(begin[some], a_word[some])]
            out[at[a] : at[a + len(some)]] = every[_spans(first[own], size[own])]
        return out, at[np.cumsum(count + 1)]

    def _odd(self, text: str) -> list[str]:
        return [w for piece in self.pieces(text) for w in ([piece] if piece in self.added else self.apart(piece)) if w]

    def _parts(self, words: pa.Array, odd: bool) -> pa.Array:
        """The parts of each word, normalised."""
        plain = pc.ascii_lower(words)
        foreign = pc.invert(pc.string_is_ascii(words)).to_numpy(zero_copy_only=False)
        if foreign.any():
            own = words.filter(pa.array(foreign)).to_pylist()
            normal = self.tokenizer.normalizer.normalize_str(" ".join(own)).split(" ")
            if len(normal) != len(own):
                normal = [self.tokenizer.normalizer.normalize_str(w) for w in own]
            plain = pc.replace_with_mask(plain, pa.array(foreign), pa.array(normal, pa.string()))
        # letters and signs behind them are told apart by Arrow alone, where all is ASCII
        core, tail = pc.ascii_rtrim(plain, string.punctuation), pc.ascii_ltrim(plain, string.ascii_lowercase)
        simple = pc.and_(pc.ascii_is_alpha(core), pc.string_is_ascii(plain))
        marked = pc.if_else(simple, pc.binary_join_element_wise(core, tail, " "), plain)
        rest = pc.and_(pc.invert(simple), pc.string_is_ascii(plain))
        marked = pc.replace_with_mask(marked, rest, pa.array([" ".join(self.split(w)) for w in plain.filter(rest).to_pylist()], pa.string()))
        rest = pc.invert(pc.string_is_ascii(plain))
        marked = pc.replace_with_mask(marked, rest, pa.array(self._foreign(plain.filter(rest).to_pylist()), pa.string()))
        parts = pc.split_pattern(marked, " ")
        if odd and any(w in self.added for w in words.to_pylist()):
            parts = pa.array([[w] if w in self.added else p for w, p in zip(words.to_pylist(), parts.to_pylist())], pa.list_(pa.string()))
        return parts

    def _foreign(self, words: list[str]) -> list[str]:
        """The parts of words, set apart by blanks, by the tokenizer's own split of all words at once."""
        ends, found, at = np.cumsum([len(w) + 1 for w in words]).tolist(), [[] for _ in words], 0
        for part, (start, _) in self.foreign_split.pre_tokenize_str(" ".join(words)) if words else ():
            while start >= ends[at]:
                at += 1
            found[at].append(part)
        return [" ".join(parts) for parts in found]

    def of_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts, little-endian; an empty one has none."""
        lack = self.parts.lacking(parts)
        self.parts.update((p, self.added.get(p, b"")) for p in lack if not p or p in self.added)
        lack = [p for p in lack if p and p not in self.added]
        if lack:
            found = np.array(self.plain.encode_batch_fast([" ".join(lack)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[found]) + 1
            # no part is without a token, so as many last tokens as parts are one for each
            if len(ends) == len(lack) and ends[-1] == len(found):
                ids, edges = found.tobytes(), [0, *(4 * ends).tolist()]
                self.parts.update(zip(lack, [ids[a:z] for a, z in zip(edges, edges[1:])]))
            else:  # a sign that the model has no such tokens, or that these parts are not its own
                self.parts.update((p, _bytes(self.tokenizer.encode(p, add_special_tokens=False).ids)) for p in lack)
        return list(map(self.parts.__getitem__, parts))


def _spans(start: np.ndarray, number: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one span after the other."""
    return np.arange(number.sum()) + np.repeat(start - np.cumsum(number) + number, number)


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _tokenize(batches: Iterator[pa.RecordBatch], tokenizer_file: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    ids_of = WordIds.at(tokenizer_file)
    for batch in batches:
        sizes, at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy()), 0
        while at < batch.num_rows:  # a text alone, or several of bounded size
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_AT_ONCE, side="right")))
            ids, ends = ids_of(batch.column(1).slice(at, upto - at), end_id)
            starts = np.concatenate([[0], ends[:-1]])
            number = -(-(ends - starts) // capacity)
            doc = np.repeat(np.arange(len(ends)), number)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
            a = starts[doc] + piece * capacity
            z = np.minimum(a + capacity, ends[doc])
            crc = [zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), z.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(z - a, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            at = upto


def tokenized(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pieces of each text's ids followed by end_id: doc_id, piece, start, length and crc32 of the ids."""
    run = partial(_tokenize, tokenizer_file=tokenizer_file, end_id=end_id, capacity=capacity)
    return in_batches(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))), run, _PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths: the sequences of an item-by-item best fit, by whole groups.

    Returns runs (length, first rank, number, first sequence, items a sequence, offset): the items of that length
    and rank go to consecutive sequences, so many in each. The size of the plan depends on the number of lengths."""
    free: dict[int, list[list[int]]] = {}  # what is left -> [first sequence, number]
    lefts: list[int] = []
    runs, made = [], 0

    def give(left: int, first: int, number: int) -> None:
        if left and number:
            if left not in free:
                insort(lefts, left)
                free[left] = []
            free[left].append([first, number])

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            at = bisect_left(lefts, length)
            if at < len(lefts):
                left = lefts[at]
                first, number = free[left].pop()
                if not free[left]:
                    del free[left], lefts[at]
            else:
                each = capacity // length
                left, first, number = capacity, made, -(-rest // each)
                made += number
            each = left // length
            whole = min(number, rest // each)
            if whole:
                runs.append((length, rank, whole * each, first, each, capacity - left))
                rank, rest = rank + whole * each, rest - whole * each
                give(left - each * length, first, whole)
                first, number = first + whole, number - whole
            if rest and number:
                runs.append((length, rank, rest, first, rest, capacity - left))
                give(left - rest * length, first, 1)
                first, number, rank, rest = first + 1, number - 1, rank + rest, 0
            give(left, first, number)
    return runs


def packed(pieces: DataFrame, capacity: int = 4096, rows_a_bucket: int = 50_000) -> DataFrame:
    """Pieces (doc_id, piece, length, ...) with the sequence_id and offset planned for them.

    Only the histogram of lengths, at most `capacity` rows, comes to the driver. An item's rank within its length is
    the number of such items in smaller buckets, plus its place in its own bucket; buckets hold some tens of
    thousands of rows however many items share a length. Equal rows take places of their own. Empty in, empty out."""
    spark = pieces.sparkSession
    columns = pieces.columns
    hist = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if hist and max(hist) > capacity:
        raise ValueError("a piece is longer than a sequence")
    rows, tasks = sum(hist.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 + max(rows // rows_a_bucket, min(rows // 500, 4 * tasks))
    schema = "p_length long, p_rank long, p_number long, p_first long, p_each long, p_offset long"
    slots = spark.createDataFrame(plan(hist, capacity), schema)
    own = pieces.withColumn("p_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = own.groupBy("length", "p_bucket").agg(F.count("*").alias("p_n"))
    before = before.withColumn("p_before", F.sum("p_n").over(W.partitionBy("length").orderBy("p_bucket")) - F.col("p_n")).drop("p_n")
    order = W.partitionBy("length", "p_bucket").orderBy(*(F.col(c) for c in ("doc_id", "piece", "ids_crc32") if c in columns))
    ranked = own.withColumn("p_at", F.row_number().over(order) - 1).join(before, ["length", "p_bucket"])
    ranked = ranked.withColumn("p_at", F.col("p_at") + F.col("p_before"))
    ahead = F.col("p_at") - F.col("p_rank")
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("p_length")) & (ahead >= 0) & (ahead < F.col("p_number")))
    return placed.select(
        *columns,
        (F.col("p_first") + F.floor(ahead / F.col("p_each"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + F.pmod(ahead, F.col("p_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens.

    A null text counts as empty and gives its end id alone; a null doc_id stays null; repeated rows are packed as
    often as they come; other columns are ignored; an empty table gives an empty result. Only documents longer than a
    sequence are cut."""
    return packed(stored(tokenized(docs, tokenizer_file, end_id, capacity), "pieces"), capacity)
