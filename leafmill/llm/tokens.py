"""Token counts by prefix dynamic programming (operator 9).

No token of ``word_bpe_49k.json`` crosses ASCII white space: its splitter never
matches any, and neither its normaliser nor its special strings reach over it.
So with the chunks c1 c2 ... of a text between white space,

    count[k] = count[k - 1] + tokens(ck)

is the exact token count of the prefix that ends with ck.  A chunk's tokens are
taken from the library once and kept, so a text is counted without encoding it
again.  The row of prefix counts of every document is stored; its token count,
whether it is over a limit, and how much of it fits a budget are read from there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import blobs, id_and_text, map_batches, settle, table
from leafmill.llm.runs import mixed, word_keys, word_spans

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Chunks that a worker keeps, at most, and their ids; it starts anew beyond that.
KEPT, KEPT_IDS = 300_000, 2_000_000
#: Texts are looked up together, up to about so many bytes.
TOGETHER = 1 << 20
#: What may end a chunk as a piece of its own: the splitter takes such a run as a whole after a letter or digit.
_MARKS = bytes(set(range(33, 127)) - set(b"'") - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
#: Before a combining mark (UTF-8 leads 0xCC and up cover them all) the case of a letter may matter to its composition.
_PLAIN = re.compile(rb"[\x21-\x7e\xc3\x80-\xbf]+")
_STEM_END = re.compile(rb"(?:[0-9A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")
#: One word to the splitter, in the form that the normaliser leaves it, and the marks after it.
_WORD = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]){1,64})([" + re.escape(_MARKS) + rb"]*)")


class Merges:
    """Byte-pair merges of many words at once, in the library's order: the least rank, the leftmost of equals."""

    BITS = 18

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256.
        alphabet, more = {}, 256
        for x in range(256):
            if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
                alphabet[x] = chr(x)
            else:
                alphabet[x] = chr(more)
                more += 1
        self.inner = np.array([vocab[alphabet[x]] for x in range(256)])
        self.last = np.array([vocab[alphabet[x] + end] for x in range(256)])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs])
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs])
        self.keys = np.full(1 << self.BITS, -1)
        self.ranks = np.full(1 << self.BITS, len(pairs))
        self.none = len(pairs)
        slot = self._slot(keys)
        for rank, (k, h) in enumerate(zip(keys.tolist(), slot.tolist(), strict=True)):
            while self.keys[h] >= 0:
                h = (h + 1) & ((1 << self.BITS) - 1)
            self.keys[h], self.ranks[h] = k, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 20 | right).ravel()
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], self.none)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out.reshape(left.shape)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, little-endian unsigned 32-bit."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes).tolist():
            members = np.flatnonzero(sizes == size)
            for i in range(0, len(members), max(1, (1 << 18) // size)):
                at = members[i : i + max(1, (1 << 18) // size)]
                raw = np.frombuffer(b"".join([words[k] for k in at.tolist()]), np.uint8).reshape(len(at), size)
                ids = self.inner[raw]
                ids[:, -1] = self.last[raw[:, -1]]
                while True:
                    width = ids.shape[1]
                    if width > 1:
                        ranks = self.rank(ids[:, :-1], ids[:, 1:])
                        best = ranks.argmin(1)
                        least = ranks[np.arange(len(ids)), best]
                        ended = least == self.none
                    else:
                        ended = np.ones(len(ids), bool)
                    if ended.any():
                        raw_ids = ids[ended].astype("<u4").tobytes()
                        for j, k in enumerate(at[ended].tolist()):
                            out[k] = raw_ids[4 * width * j : 4 * width * (j + 1)]
                        if ended.all():
                            break
                        at, ids, best, least = at[~ended], ids[~ended], best[~ended], least[~ended]
                    ids[np.arange(len(ids)), best] = self.merged[least]
                    place = np.arange(width - 1)
                    ids = np.take_along_axis(ids, place + (place > best[:, None]), 1)
        return out


class Chunks:
    """The token ids of chunks, as the library gives them, found by 128-bit keys.

    A key holds a chunk's own bytes, or a strong hash of a long one, so no two
    chunks are taken for each other.  An open-addressed table of keys leads to
    entries: how many ids a chunk has, and where they begin in one long array.
    """

    BITS = 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model) if model.get("end_of_word_suffix") else None
        self.forget()

    def forget(self) -> None:
        self._room(self.BITS)
        self.held = 0
        self.sizes, self.starts, self.flat, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _room(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros((2, 1 << bits), np.uint64)
        self.slots = np.full(1 << bits, -1, np.int32)

    def _slot(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (mixed(one ^ mixed(two)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        slot = self._slot(one, two)
        out = self.slots[slot]
        todo = np.flatnonzero((out >= 0) & ((self.keys[0, slot] != one) | (self.keys[1, slot] != two)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            entry, at = self.slots[slot[todo]], slot[todo]
            out[todo] = entry
            todo = todo[(entry >= 0) & ((self.keys[0, at] != one[todo]) | (self.keys[1, at] != two[todo]))]
        return out

    def put(self, one: np.ndarray, two: np.ndarray, ids: list[bytes]) -> None:
        """Add chunks that aren't held, each once."""
        sizes = np.fromiter((len(x) >> 2 for x in ids), np.int64, len(ids))
        n, more = self.held + len(ids), int(sizes.sum())
        if n > len(self.sizes):
            self.sizes, self.starts = (np.concatenate([x, np.zeros(max(n, len(x)), x.dtype)]) for x in (self.sizes, self.starts))
        if self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(more, len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + more] = np.frombuffer(b"".join(ids), "<u4")
        self.sizes[self.held : n], self.starts[self.held : n] = sizes, self.used + np.cumsum(sizes) - sizes
        if 2 * n > 1 << self.bits:  # only for one group of texts with very many chunks, as the table was emptied for it
            self._room(int(2 * n).bit_length())
        entry = np.arange(self.held, n, dtype=np.int32)
        slot = self._slot(one, two)
        todo = np.arange(len(one))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = entry[free]  # of several for one slot, one stays
            won = free[self.slots[slot[free]] == entry[free]]
            self.keys[0, slot[won]], self.keys[1, slot[won]] = one[won], two[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.held, self.used = n, self.used + more

    @staticmethod
    def stem(chunk: bytes) -> tuple[bytes, bytes]:
        """A chunk in pieces whose ids, end to end, are the chunk's own; lower-cased where that changes no id."""
        if b"<|" in chunk or not _PLAIN.fullmatch(chunk):
            return chunk, b""
        chunk = chunk.lower()
        stem = chunk.rstrip(_MARKS)
        return (stem, chunk[len(stem) :]) if _STEM_END.search(stem) else (chunk, b"")

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks: plain words by the merges, all other pieces by the library, all at once."""
        words, other, pairs = {}, {}, []
        for c in chunks:
            found = _WORD.fullmatch(c.lower()) if self.merges else None
            stem, marks = found.groups() if found else self.stem(c)
            (words if found else other)[stem] = b""
            if marks:
                other[marks] = b""
            pairs.append((stem, marks, found))
        if words:
            words = dict(zip(words, self.merges.encode(list(words)), strict=True))
        for c, e in zip(other, self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in other], add_special_tokens=False), strict=True):
            other[c] = np.array(e.ids, "<u4").tobytes()
        return [(words if found else other)[stem] + (other[marks] if marks else b"") for stem, marks, found in pairs]

    def entries(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For groups of texts: the entry of each chunk, the texts' bounds in chunks, and each chunk's end in bytes of its text."""
        first, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= TOGETHER or i == len(texts) - 1:
                part = texts[first : i + 1]
                joined, bounds = b"".join(part), np.cumsum([0, *map(len, part)])
                start, end = word_spans(joined, bounds)
                one, two = word_keys(joined, start, end)
                entry = self.find(one, two)
                missing = np.flatnonzero(entry < 0)
                if len(missing):
                    new = missing[self._each_once(one[missing], two[missing])]
                    if self.held and (self.held + len(new) > KEPT or self.used > KEPT_IDS):
                        self.forget()
                        missing = np.arange(len(one))
                        new = self._each_once(one, two)
                    self.put(one[new], two[new], self.encode([joined[a:z] for a, z in zip(start[new].tolist(), end[new].tolist(), strict=True)]))
                    entry[missing] = self.find(one[missing], two[missing])
                words = np.searchsorted(start, bounds)
                yield entry, words, end - np.repeat(bounds[:-1], np.diff(words))
                first, held = i + 1, 0

    @staticmethod
    def _each_once(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Where each key comes first."""
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        return order[new]

    def counts(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """How many tokens each chunk has, text by text."""
        for entry, bounds, _ in self.entries(texts):
            sizes = self.sizes[entry]
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield sizes[a:z]

    def prefixes(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For groups of texts: offsets of their prefix rows, and these end to end, in bytes and in tokens; a row starts with 0."""
        for entry, bounds, end in self.entries(texts):
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            so_far = np.append(0, np.cumsum(self.sizes[entry]))
            at = np.arange(len(entry)) + text + 1
            ends, counts = (np.zeros(len(entry) + len(bounds) - 1, np.int64) for _ in range(2))
            ends[at], counts[at] = end, so_far[1:] - so_far[bounds[:-1]][text]
            yield bounds + np.arange(len(bounds)), ends, counts

    def each(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids (unsigned 32-bit) of each text."""
        for entry, bounds, _ in self.entries(texts):
            sizes = self.sizes[entry]
            ends = np.append(0, np.cumsum(sizes))
            at = np.repeat(self.starts[entry] - ends[:-1], sizes) + np.arange(ends[-1])
            ids = self.flat[at]
            for a, z in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist(), strict=True):
                yield ids[a:z]


_chunks: dict[str, Chunks] = {}


def chunks_of(vocabulary: str) -> Chunks:
    """The worker's own table for a vocabulary: a name of public_tokenizers, or a path."""
    if vocabulary not in _chunks:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _chunks[vocabulary] = Chunks(path)
    return _chunks[vocabulary]


def prefix_counts(sizes: np.ndarray) -> np.ndarray:
    """count[k]: tokens of a text up to and with its k-th chunk, from the counts of its chunks; count[0] is 0."""
    return np.append(0, np.cumsum(sizes))


def chunk_ends(text: bytes) -> np.ndarray:
    """Bytes of the prefix that ends with the k-th chunk; 0 for k = 0."""
    return np.append(0, word_spans(text, np.array([0, len(text)]))[1])


def fits(counts: np.ndarray, ends: np.ndarray, budget: int) -> int:
    """Bytes of the longest prefix of whole chunks with at most ``budget`` tokens."""
    return int(ends[np.searchsorted(counts, budget, side="right") - 1])


#: Prefix rows only ever rise, so their differences are what is stored.
RISING = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


def prefix_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, ends, counts): the stored prefix row of every document.

    counts[k] is the exact token count of the first ends[k] bytes, those up to
    and with the k-th chunk; both start with 0.
    """

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        texts, first = blobs(batch.column(1)), 0
        for offsets, ends, counts in chunks_of(vocabulary).prefixes(texts):
            n = len(offsets) - 1
            rows = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (ends, counts)]
            yield {"doc_id": batch.column(0).slice(first, n), "n_bytes": [len(t) for t in texts[first : first + n]], "ends": rows[0], "counts": rows[1]}
            first += n

    return settle(map_batches(id_and_text(docs), "doc_id long,n_bytes long,ends array<long>,counts array<long>", make), **RISING)


def within(rows: DataFrame, budget: Column | int) -> DataFrame:
    """Rows of a prefix table with n_tokens, over_limit and fit_bytes for a budget of tokens, read from the stored counts.

    fit_bytes: length of the longest prefix of whole chunks within the budget;
    the whole text's if that is within it.
    """
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    rows = rows.withColumn("n_tokens", F.element_at("counts", -1)).withColumn("over_limit", F.col("n_tokens") > budget)
    held = F.size(F.filter("counts", lambda c: c <= budget))
    return rows.withColumn("fit_bytes", F.when(F.col("over_limit"), F.element_at("ends", held)).otherwise(F.col("n_bytes")))


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Operator 9's contract: doc_id, n_bytes, n_tokens, over_limit; then fit_bytes.

    All are answered from the stored prefix rows.  A null text is empty (0
    tokens); bytes that are not valid UTF-8 count as U+FFFD does; doc_id may be
    null or repeat; an empty table has no rows.
    """
    return within(prefix_table(docs, vocabulary), limit).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
