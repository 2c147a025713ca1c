"""Packing into windows by best-fit decreasing.

One pass tokenises each whole document, cuts an overlong one into full windows and a rest, and
takes each piece's checksum; the ids themselves are never shuffled. Pieces are then dealt evenly
(no key, so no hot one) over shards of about ``SHARD`` pieces, and each shard is packed on its own:
pieces by falling length, each into the tightest open window that still takes it, found in a
segment tree over remaining capacity. A shard leaves at most a few windows part full, which is
under a thousandth of its tokens.

Defined cases: a null or empty text is one piece that holds the end id alone; an empty table gives
an empty result; repeated rows are packed each; columns besides id and text are not read. Very
long texts are cut into windows, so no piece is larger than one. Ties in length go by doc_id, then start.
"""

from __future__ import annotations

import itertools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WorkerCache, arrow_schema, prepare, release, text_of, tokenizer_path

MODEL, END, WINDOW = "word_bpe_49k.json", 2, 4096
#: Pieces that one shard packs.
SHARD = 4096
#: Bytes of text whose words are looked up at once: a word costs one lookup a chunk. A worker holds some 20 MB more for each MB.
CHUNK_BYTES = 4 << 20
#: Entries of a worker's cache and the longest word in it.
CACHE, LONGEST = 450_000, 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Letters that the normaliser turns into a letter and marks, which are one run with a stop or comma after them.
MARKED = r"\x{0130}\x{0958}-\x{095F}\x{09DC}\x{09DD}\x{09DF}\x{0A33}\x{0A36}\x{0A59}-\x{0A5B}\x{0A5E}\x{0B5C}\x{0B5D}\x{0F43}\x{0F4D}\x{0F52}\x{0F57}\x{0F5C}\x{0F69}\x{FB1D}\x{FB1F}\x{FB2A}-\x{FB36}\x{FB38}-\x{FB3C}\x{FB3E}\x{FB40}\x{FB41}\x{FB43}\x{FB44}\x{FB46}-\x{FB4E}"
#: A stop or comma after another letter is a token run of its own, so a blank before it changes no token.
APART, APARTED = rf"([^\P{{L}}{MARKED}]|\p{{N}})([.,][ \n])", r"\1 \2"


class Words:
    """Blank-separated words to their ids as bytes. The tokenizer drops blanks, so no token goes across one.

    New words of letters alone are encoded many in one call and told apart by their last tokens.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path(model))
        self.encode = tok.encode_batch_fast
        vocabulary = tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def each(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.encode(words, add_special_tokens=False)]

    def joined(self, words: list[str]) -> list[bytes]:
        """Of words of letters: encoded together."""
        ids = np.array(self.encode([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(words) or at[-1] != len(ids):
            return self.each(words)
        raw, cuts = ids.tobytes(), [0, *(4 * at).tolist()]
        return [raw[a:b] for a, b in itertools.pairwise(cuts)]

    def lookup(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words. When the newer half of the cache is full it becomes the older half."""
        found = list(map(self.known.get, words))
        new = [w for w, x in zip(words, found, strict=True) if x is None]
        if not new:
            return found
        if len(self.known) + len(new) > CACHE // 2:
            self.older, self.known = self.known, {}
        learnt = {w: x for w in new if (x := self.older.get(w)) is not None}
        learnt |= self.learn([w for w in new if w not in learnt] if learnt else new)
        if max(map(len, learnt)) > LONGEST:
            self.known.update((w, x) for w, x in learnt.items() if len(w) <= LONGEST)
        else:
            self.known.update(learnt)
        return [learnt[w] if x is None else x for w, x in zip(words, found, strict=True)]

    def learn(self, new: list[str]) -> dict[str, bytes]:
        plain, learnt = [w for w in new if w.isalpha()], {}
        for lo in range(0, len(plain), 64):
            some = plain[lo : lo + 64]
            learnt.update(zip(some, self.joined(some), strict=True))
        others = [w for w in new if not w.isalpha()]
        learnt.update(zip(others, self.each(others), strict=True))
        return learnt


_words = WorkerCache(Words)


def lowered(word: str) -> str:
    """In lower case where that changes no id: not before a mark, nor where an added token may stand, which is found as it is written."""
    return word.lower() if word.isascii() and "<|" not in word else word


def token_bytes(texts: pa.Array, model: str = MODEL, chunk: int = CHUNK_BYTES) -> Iterator[bytes]:
    """Each text's ids as little-endian 32-bit integers; of so many texts at once as hold about chunk bytes."""
    tok = _words.get(model)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk, "right")))
        plain = pc.replace_substring_regex(texts.slice(lo, hi - lo), APART, APARTED)
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()  # a word is looked up once a chunk
        words = [lowered(w) for w in coded.dictionary.to_pylist()]
        distinct = list(dict.fromkeys(words))
        found = dict(zip(distinct, tok.lookup(distinct), strict=True))
        ids = [found[w] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        past = np.cumsum(each)
        tokens = flat[np.repeat(starts[codes] - (past - each), each) + np.arange(past[-1] if len(past) else 0)]
        past = np.concatenate([[0], past])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for i in range(hi - lo):
            yield tokens[past[i] : past[i + 1]].tobytes()
        lo = hi
        del plain, lists, coded, words, distinct, found, ids, flat, tokens, codes, each
        pa.default_memory_pool().release_unused()


class _Pieces:
    def __init__(self, model: str, end: int, window: int, chunk: int):
        self.model, self.end, self.window, self.chunk = model, end, window, chunk

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, wide, end = arrow_schema(PIECES), 4 * self.window, np.array([self.end], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, raw in zip(b.column(0).to_pylist(), token_bytes(b.column(1), self.model, self.chunk), strict=True):
                raw += end
                for at in range(0, len(raw), wide):
                    piece = raw[at : at + wide]
                    for col, v in zip(out, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
        release()


def cut_documents(docs: DataFrame, model: str = MODEL, end: int = END, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_BYTES) -> DataFrame:
    """Pieces of at most window ids: full ones, then the rest."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(_Pieces(model, end, window, chunk), PIECES)


class Tree:
    """Segment tree over remaining capacity 0..window: how many open windows have each."""

    def __init__(self, window: int):
        self.base = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, room: int, by: int) -> None:
        i, count = room + self.base, self.count
        while i:
            count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of at least need that an open window has, or -1."""
        i, count, base = need + self.base, self.count, self.base
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < base:
                    i <<= 1
                    if not count[i]:
                        i += 1
                return i - base
            i >>= 1
        return -1


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each length; lengths fall."""
    tree, open_by, n = Tree(window), [[] for _ in range(window + 1)], 0
    where, offset = [], []
    for size in lengths:
        room = tree.tightest(size)
        if room < 0:
            room, w = window, n
            n += 1
        else:
            w = open_by[room].pop()
            tree.add(room, -1)
        where.append(w)
        offset.append(window - room)
        if room > size:
            open_by[room - size].append(w)
            tree.add(room - size, 1)
    return where, offset


class _Pack:
    def __init__(self, window: int, shards: int):
        self.window, self.shards = window, shards

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        where, offset = best_fit(t["length"].to_pylist(), self.window)
        ids = np.array(where, np.int64) * self.shards + TaskContext.get().partitionId()
        t = t.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset, pa.int64()))
        yield from t.combine_chunks().to_batches()


def pack(docs: DataFrame, model: str = MODEL, end: int = END, window: int = WINDOW, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_BYTES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The pieces are written once to the shared folder, so a lost executor costs no second
    tokenisation and the deal of pieces to shards repeats exactly.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.cut(cut_documents(docs, model, end, window, id_col, text_col, chunk), "pieces")
    shards = max(1, round(pieces.count() / shard))
    dealt = pieces.repartition(shards)
    return dealt.mapInArrow(_Pack(window, shards), f"{PIECES}, sequence_id long, offset long")
