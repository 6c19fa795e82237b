"""Token ids in Simple-8b: 64-bit words whose four high bits select how many ids share the word.

Fixed values of the code: selector s = 1..14 packs COUNT[s] ids of WIDTH[s] bits.  Selector 0 is the
escape: the word holds nothing else and the next word is one raw 64-bit value.  Ids are coded in
blocks of BLOCK ids that start on a word of their own, so blocks are coded and decoded side by side.

File layout (little-endian): segments with their length in front; a segment has a magic number, a document
table (ids as text, lengths), block offsets and words.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from reelscope.llm.common import ragged, scratch, slices
from reelscope.llm.files import Replacing, open_for_reading

COUNT = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTH = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 2048
MAGIC = b"S8B1"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): the coded words and the first word of each block (with the total at the end)."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    ends = np.minimum(np.arange(0, n, BLOCK) + BLOCK, n)
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)
    choice = np.zeros(n, np.uint8)
    open_ = n
    narrow = values.astype(np.uint32) if values.max() < 1 << 32 else values
    for s in range(1, 15):
        at = np.flatnonzero(narrow < narrow.dtype.type(1 << WIDTH[s])) if WIDTH[s] < 32 or narrow is values else np.arange(n)
        reach = COUNT[s] - 1
        if reach:
            at = at[: len(at) - reach][at[reach:] - at[: len(at) - reach] == reach] if len(at) > reach else at[:0]
            at = at[left[at] > reach]
        at = at[choice[at] == 0]
        choice[at] = s
        open_ -= len(at)
        if not open_:
            break
    step = np.where(choice == 0, 1, np.array(COUNT)[choice])
    at = np.arange(0, n, BLOCK)
    blocks = np.arange(len(at))
    picked, owner = [], []
    while len(at):
        picked.append(at)
        owner.append(blocks)
        at = at + step[at]
        on = at < ends[blocks]
        at, blocks = at[on], blocks[on]
    starts = np.sort(np.concatenate(picked))
    chosen = choice[starts]
    size = np.where(chosen == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(1, 15):
        mine = chosen == s
        if mine.any():
            grid = values[starts[mine][:, None] + np.arange(COUNT[s])]
            shifts = (np.arange(COUNT[s]) * WIDTH[s]).astype(np.uint64)
            words[place[mine]] = np.bitwise_or.reduce(grid << shifts, axis=1) | np.uint64(s << 60)
    raw = chosen == 0
    words[place[raw] + 1] = values[starts[raw]]
    first = np.searchsorted(starts, np.arange(0, n, BLOCK))
    return words, np.r_[place[first], len(words)].astype(np.int64)


def decode(words: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """The ids again.  Raw words of escapes are found block by block along the offsets."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    if (selectors == 0).any():  # an escape, or a raw value that looks like one: walk those blocks
        for a, b in zip(offsets[:-1], offsets[1:]):
            if (selectors[a:b] == 0).any():
                i = a
                while i < b:
                    if selectors[i] == 0:
                        head[i + 1] = False
                        i += 1
                    i += 1
    at = np.flatnonzero(head)
    sel = selectors[at]
    count = np.where(sel == 0, 1, np.array((*COUNT, 0))[np.minimum(sel, 15)])
    place = np.cumsum(count) - count
    out = np.zeros(total, np.uint64)
    for s in range(1, 15):
        mine = sel == s
        if mine.any():
            shifts = (np.arange(COUNT[s]) * WIDTH[s]).astype(np.uint64)
            out[place[mine][:, None] + np.arange(COUNT[s])] = (words[at[mine]][:, None] >> shifts) & np.uint64((1 << WIDTH[s]) - 1)
    raw = sel == 0
    out[place[raw]] = words[at[raw] + 1]
    return out


def pack(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """One segment: documents in order, their ids one after another."""
    words, offsets = encode(ids)
    names = json.dumps(doc_ids).encode()
    lengths = np.ascontiguousarray(lengths, np.int64)
    body = [MAGIC, struct.pack("<QQQQ", len(names), len(lengths), len(offsets), len(words)), names, lengths.tobytes(), offsets.astype(np.int64).tobytes(), words.tobytes()]
    return b"".join(body)


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids)."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    names, docs, blocks, size = struct.unpack_from("<QQQQ", data, 4)
    at = 36
    doc_ids = json.loads(data[at : at + names])
    lengths = np.frombuffer(data, np.int64, docs, at := at + names)
    offsets = np.frombuffer(data, np.int64, blocks, at := at + 8 * docs)
    words = np.frombuffer(data, np.uint64, size, at + 8 * blocks)
    return doc_ids, lengths, decode(words, offsets, int(lengths.sum()))


#: Fixed values of the piece hash: an odd base, its inverse modulo 2 ** 64, and an odd multiplier.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STIR = np.uint64(0xD6E8FEB86659FD93)
SPACES = np.zeros(256, bool)
SPACES[[32, 10, 9, 13]] = True
#: Fixed value: how this kind of vocabulary marks a token that closes a word.
WORD_END = "</w>"
MARKS, SMALL = np.zeros(256, bool), np.zeros(256, bool)
MARKS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = True
SMALL[97:123] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Numbered:
    """64-bit keys and their numbers in a few sorted runs, merged as they grow; lookups are vectorised."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for known, numbers in self.runs:
            at = np.searchsorted(known, keys)
            at[at == len(known)] = 0
            hit = known[at] == keys
            out[hit] = numbers[at[hit]]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Number new keys, which are sorted, in their order."""
        numbers = self.size + np.arange(len(keys))
        self.size += len(keys)
        self.runs.append((keys, numbers))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            (k1, n1), (k2, n2) = self.runs.pop(), self.runs.pop()
            k, n = np.r_[k2, k1], np.r_[n2, n1]
            order = np.argsort(k, kind="stable")
            self.runs.append((k[order], n[order]))
        return numbers


class PieceEncoder:
    """Ids of texts by a tokenizer that drops white space and never joins across it.

    The library encodes every different piece between spaces once while it is remembered (by a 64-bit hash), and
    texts are put together from the pieces.  The tokenizer also splits letters from marks and lower-cases, so ASCII
    marks (but the apostrophe of contractions) part from letters here too, and A-Z is lower-cased first (but in texts
    with combining accents, which lower and upper letters may take up differently).  Slices that hold the text of an
    added token are left as they are between spaces.  New pieces are encoded many at a time, with a special token between.
    """

    def __init__(self, path: str, end_id: int, most_remembered: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.library, self.end_id, self.most = Tokenizer.from_file(path), end_id, most_remembered
        special = sorted(i for i, t in self.library.get_added_tokens_decoder().items() if t.special and not t.lstrip and not t.rstrip)
        self.border = special[0] if special else None
        self.border_text = self.library.id_to_token(special[0]) if special else ""
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.closing = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.closes = bool(self.closing.any())
        self.up, self.down = powers(BASE, 1), powers(INVERSE, 1)
        self.forget()

    def forget(self) -> None:
        self.known = Numbered()
        self.pool = [np.zeros(0, np.uint32)]
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, ids per piece)."""
        letters = np.fromiter(map(str.isalpha, new), bool, len(new)) & self.closes
        ids, sizes, order = [], [], []
        for kind in (True, False):
            at = np.flatnonzero(letters == kind)
            order.append(at)
            for i in range(0, len(at), 1000):
                got = self._run([new[j] for j in at[i : i + 1000].tolist()], kind)
                ids.append(got[0])
                sizes.append(got[1])
        flat, size = np.concatenate(ids), np.concatenate(sizes).astype(np.int64)
        back = np.empty(len(new), np.int64)
        back[np.concatenate(order)] = np.arange(len(new))
        starts = np.cumsum(size) - size
        return ragged(flat, starts[back], size[back]), size[back].astype(np.int32)

    def _run(self, pieces: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of letters are one word each: put apart by spaces, their ids part behind every id that closes a word.
        Others (and if the count is not right) are put apart by a special token; pieces that hold it are encoded alone."""
        if letters:
            run = np.array(self.library.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.closing[run])
            if len(stops) == len(pieces) and len(run) and stops[-1] == len(run) - 1:
                return run, np.diff(np.r_[-1, stops])
        if self.border is not None and not any(self.border_text in x for x in pieces):
            run = np.array(self.library.encode(self.border_text.join(pieces), add_special_tokens=False).ids + [self.border], np.uint32)
            stops = np.flatnonzero(run == self.border)
            if len(stops) == len(pieces):
                return run[run != self.border], np.diff(np.r_[-1, stops]) - 1
        got = [self.library.encode(x, add_special_tokens=False).ids for x in pieces]
        return np.array([i for ids in got for i in ids], np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text), each text closed by the end id."""
        if self.known.size > self.most:
            self.forget()
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        lowered = [x if b"\xcc" in x or b"\xcd" in x else x.lower() for x in raw]
        plain = not any(t in x for x in lowered for t in self.specials)
        raw = lowered if plain else raw
        borders = np.cumsum([len(x) + 1 for x in raw])
        data = b"\n".join([*raw, b""])
        c = np.frombuffer(data, np.uint8)
        gap = np.r_[True, SPACES[c], True]
        loose = np.zeros(len(c), bool)
        if plain:
            loose[1:] = (MARKS[c[1:]] & SMALL[c[:-1]]) | (SMALL[c[1:]] & MARKS[c[:-1]])
        starts = np.flatnonzero((gap[:-2] | loose) & ~gap[1:-1])
        stops = np.flatnonzero(~gap[1:-1] & (gap[2:] | np.r_[loose[1:], False])) + 1
        if len(c) > len(self.up):
            self.up, self.down = powers(BASE, len(c)), powers(INVERSE, len(c))
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(c * self.up[: len(c)], out=sums[1:])
        keys = (sums[stops] - sums[starts]) * self.down[starts]
        keys = (keys ^ (keys >> np.uint64(32)) ^ (stops - starts).astype(np.uint64)) * STIR
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        number = self.known.find(distinct)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            places = first[fresh]
            pieces = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[places].tolist(), stops[places].tolist())]
            ids, sizes = self.encoded(pieces)
            number[fresh] = self.known.add(distinct[fresh])
            held = sum(map(len, self.pool))
            self.starts = np.r_[self.starts, held + np.cumsum(sizes, dtype=np.int64) - sizes]
            self.sizes = np.r_[self.sizes, sizes]
            self.pool.append(ids)
            if len(self.pool) > 8:
                self.pool = [np.concatenate(self.pool)]
        pool = np.concatenate([*self.pool, np.array([self.end_id], np.uint32)])
        at = number[inverse]
        ends_ = np.searchsorted(starts, borders)
        begin, size = np.insert(self.starts[at], ends_, len(pool) - 1), np.insert(self.sizes[at].astype(np.int64), ends_, 1)
        ids = ragged(pool, begin, size)
        upto = np.cumsum(size)[ends_ + np.arange(len(ends_))]
        return ids, np.diff(np.r_[0, upto])


#: A worker process keeps its encoders, with what they remember, from task to task.
_ENCODERS: dict[tuple, PieceEncoder] = {}


def tokenizer_ids(path: str, end_id: int, most_remembered: int = 1_500_000) -> Callable[[], PieceEncoder]:
    """Task-side maker of an encoder for ``write_tokens``."""

    def make() -> PieceEncoder:
        key = (path, end_id, most_remembered)
        if key not in _ENCODERS:
            _ENCODERS[key] = PieceEncoder(*key)
        return _ENCODERS[key]

    return make


def write_tokens(docs: DataFrame, make_encoder, id_column: str = "doc_id", text: str = "text", files: int | None = None, segment_ids: int = 1 << 20, file_bytes: int = 256 << 20) -> tuple[str, DataFrame]:
    """(folder, manifest): encode every text and write token files in ascending id order.

    Null ids come first; repeated ids follow each other by text.  Rows are dealt by ranges of (id, text hash),
    so a run of equal ids may span files.  A file is a row of segments of about ``segment_ids`` ids, each with its
    length in front, so memory does not grow with a partition.  The manifest (part, piece, file, n_docs, n_ids) is a table with one row per file.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{id_column}`").alias("_o"), F.xxhash64(F.col(f"`{text}`")).alias("_h"), F.col(f"`{text}`").alias("_t"))
    ordered = rows.repartitionByRange(files, "_o", "_h").sortWithinPartitions("_o", "_h").select("id", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece = TaskContext.get().partitionId(), 0
        encode_texts, ids, names, lengths = make_encoder(), [], [], []
        out, n_docs, n_ids = None, 0, 0

        def close() -> pa.RecordBatch:
            out.done()
            return pa.RecordBatch.from_pylist([{"part": part, "piece": piece, "file": out.name, "n_docs": n_docs, "n_ids": n_ids}], MANIFEST)

        for batch, last in ends(cut for batch in batches for cut in slices(batch, "_t", 2 << 20)):
            got, sizes = encode_texts(batch.column(1).to_pylist())
            ids.append(got)
            lengths.append(sizes)
            names += batch.column(0).to_pylist()
            if last or sum(map(len, ids)) >= segment_ids:
                if out is None:
                    out, n_docs, n_ids = Replacing(folder, f"part-{part:06d}-{piece:05d}.s8b"), 0, 0
                data = pack(np.concatenate(ids), names, np.concatenate(lengths))
                out.write(struct.pack("<Q", len(data)) + data)
                n_docs, n_ids = n_docs + len(names), n_ids + sum(map(len, ids))
                ids, names, lengths = [], [], []
                if last or out.size >= file_bytes:
                    yield close()
                    out, piece = None, piece + 1

    listed = ordered.mapInArrow(run, "part int, piece int, file string, n_docs bigint, n_ids bigint")
    listed.write.parquet(f"{folder}/manifest")
    return folder, spark.read.schema(listed.schema).parquet(f"{folder}/manifest")


def ends(items: Iterator) -> Iterator[tuple]:
    """(item, whether it is the last one)."""
    items = iter(items)
    for held in items:
        for item in items:
            yield held, False
            held = item
        yield held, True


def segments(folder: str, name: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, lengths, ids) of each segment of a file."""
    with open_for_reading(folder, name) as stream:
        while head := stream.read(8):
            yield unpack(stream.read(struct.unpack("<Q", head)[0]))


MANIFEST = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_tokens(folder: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per document, from the files alone; start counts the ids of all documents before it.

    The running sum is taken over the manifest (one row per file); every file is read by one task.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy(F.lit(0)).orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("file", before.cast("bigint").alias("base"))
    files = placed.repartition(max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "file")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, base in zip(pdf["file"], pdf["base"]):
                for doc_ids, lengths, ids in segments(folder, name):
                    view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    stops = np.cumsum(lengths)
                    starts = stops - lengths
                    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                    yield pd.DataFrame({"id": pd.Series(doc_ids, dtype="object"), "start": base + starts, "n_tokens": lengths, "ids_crc32": np.array(crc, np.int64)})
                    base += len(ids)

    out = files.mapInPandas(run, "id string, start bigint, n_tokens bigint, ids_crc32 bigint")
    return out.withColumn("id", F.col("id").cast(id_type))


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(id, ids) per document, for training jobs that stream the files."""

    def run(frames):
        for pdf in frames:
            for name in pdf["file"]:
                for doc_ids, lengths, ids in segments(folder, name):
                    yield pd.DataFrame({"id": pd.Series(doc_ids, dtype="object"), "ids": np.split(ids.astype(np.int64), np.cumsum(lengths)[:-1])})

    return manifest.select("file").mapInPandas(run, "id string, ids array<bigint>")
