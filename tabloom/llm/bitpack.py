"""Token-id output: fixed-width bit packing with block offsets.

A shard file holds whole documents' ids, each in the minimum number of bits of
the vocabulary, in blocks of a fixed number of ids; block offsets let a reader
unpack any range with numpy without touching the rest.  All numbers are little-endian:

    8 bytes   magic "TLBITS01"
    u32 x 4   vocabulary size, bits an id, ids a block, 0
    u64 x 2   ids, documents
    u64 x (blocks + 1)     byte offset of each block in the payload, then its length
    u64 x (documents + 1)  index of each document's first id, then the number of ids
    payload   each block's ids as one little-endian bit stream, padded to whole bytes

Shards travel and rest as one binary cell each of a Parquet dataset, beside the
ids of their documents, so that writing is Spark's own committed output: it
reaches any store, and a lost executor's shards are written again.

Documents are dealt out by ranges of doc_id and sorted, so that shards in order
of (part, seq) hold ids in ascending doc_id order (null ids first, equal ids by
text).  A null text counts as empty; an empty text has the end id alone; repeated
rows are separate documents; an empty table gives an empty dataset.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_pieces, kept, new_path, only, parts, table

MAGIC = b"TLBITS01"
_HEAD = struct.Struct("<8sIIIIQQ")
BLOCK_IDS = 65536
SHARD_IDS = 1 << 19
#: Characters encoded at once, and pieces kept by a worker: bounds of memory, not of the input.
BATCH_CHARS = 1 << 20
CACHED_PIECES = 350_000
#: Marks that form a piece of their own after a run of letters, however many.
_MARKS = ".,;:!?*#%&$"

_BLANK = re.compile(r"[ \t\r\n]+")
#: Characters at which str.split() cuts though they are no white space to the vocabulary.
#: Beyond these letters, normal form and case mapping depend on the order in which they are applied.
_WIDE = re.compile("[^\x00-\u012f\u0131-\u017f]")
#: A point or comma beside another mark, with which it would be one piece.
_CROWDED = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s][.,])|(?<=_[.,]))")
_NO_SPACE = re.compile(r"[\x1c-\x1f]")


def min_bits(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as one little-endian bit stream."""
    ids = np.asarray(ids, np.uint64)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    rows = -(-len(ids) // 8)
    lanes = np.zeros((rows, 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((rows, bits + 8), np.uint8)  # eight ids fill `bits` bytes
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        value = lanes[:, j] << np.uint64(shift)
        for k in range(-(-(bits + shift) // 8)):
            out[:, byte + k] |= ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out[:, :bits].tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data, n: int, bits: int) -> np.ndarray:
    """The first n ids of a bit stream, as little-endian uint32."""
    rows = -(-n // 8)
    held = np.zeros(rows * bits, np.uint8)
    got = np.frombuffer(data, np.uint8)[: rows * bits]
    held[: len(got)] = got
    wide = np.zeros((rows, bits + 8), np.uint64)
    wide[:, :bits] = held.reshape(rows, bits)
    out = np.empty((rows, 8), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        value = wide[:, byte].copy()
        for k in range(1, -(-(bits + shift) // 8)):
            value |= wide[:, byte + k] << np.uint64(8 * k)
        out[:, j] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


def shard_bytes(docs: list[np.ndarray], vocab_size: int, block: int = BLOCK_IDS) -> bytes:
    """A shard file of these documents' ids."""
    bits = min_bits(vocab_size)
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    blocks = [pack(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    starts = np.cumsum([0, *map(len, docs)]).astype("<u8")
    head = _HEAD.pack(MAGIC, vocab_size, bits, block, 0, len(ids), len(docs))
    return b"".join([head, offsets.tobytes(), starts.tobytes(), *blocks])


class Shard:
    """Random access to a shard file's ids."""

    def __init__(self, data):
        magic, self.vocab_size, self.bits, self.block, _, self.n_ids, self.n_docs = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a shard of packed token ids")
        blocks = -(-self.n_ids // self.block)
        at = _HEAD.size
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at)
        at += 8 * (blocks + 1)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at)
        self.payload = memoryview(data)[at + 8 * (self.n_docs + 1) :]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop; only their blocks are unpacked."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        got = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            got.append(unpack(self.payload[int(self.offsets[b]) : int(self.offsets[b + 1])], n, self.bits))
        flat = np.concatenate(got)
        return flat[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class Encoder:
    """Whole texts to ids by the tokenizers library.

    The vocabulary's pre-tokenizer drops white space and no piece crosses it, so
    a text's ids are those of its runs between blanks, end to end.  Each distinct
    run is encoded once by the library; a run of letters is lower-cased first if it
    is ASCII (the vocabulary's own rule), and the marks at its end encoded apart (a
    piece of their own in any case).  A run that is not in normal form C goes to the
    library as it is, marks included: normalised, its letters may end in a mark that
    belongs to the piece after them.  What was met lately is kept, in two generations, so memory stays bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        self.kept: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.lowers = self.of_library(["AZ"]) == self.of_library(["az"])
        self.added = sorted({str(t.content)[:2] for t in self.library.get_added_tokens_decoder().values()})
        # a vocabulary whose pieces all end in a token of a kind of its own: ids of many pieces can be cut apart
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.vocab_size, bool)
            self.ends[[k for token, k in self.library.get_vocab().items() if token.endswith(suffix)]] = True

    def of_library(self, runs: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(runs, add_special_tokens=False)]

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters, encoded as one text of words and cut where words end."""
        if self.ends is None:
            return self.of_library(words)
        ids = np.fromiter(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cuts) != len(words) or (cuts and cuts[-1] != 4 * len(ids)):
            return self.of_library(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]  # noqa: B905  the last cut is the end

    def learn(self, runs: set[str]) -> None:
        """Have each run's ids in self.kept."""
        if len(self.kept) > CACHED_PIECES:
            self.kept, self.older = {"": b""}, self.kept
        kept, older = self.kept, self.older
        new = runs.difference(kept)
        if older:
            again = [r for r in new if r in older]
            kept.update((r, older[r]) for r in again)
            new.difference_update(again)
        whole, words, odd = {}, set(), []
        for run in new:
            if self.lowers and run.isascii() and run.isalpha() and run.islower():
                words.add(run)  # the commonest case: its ids are kept under its own name below
                continue
            head = run.rstrip(_MARKS)
            if self.lowers and head.isalpha():
                if run.isascii():
                    head = head.lower()
                elif not (is_normalized("NFC", run) and head.lower().isalpha()):
                    odd.append(run)
                    continue
                whole[run] = head
                words.add(head)
            else:
                odd.append(run)
        for run, ids in zip(odd, self.of_library(odd) if odd else (), strict=True):
            kept[run] = ids
        heads = {w: kept[w] for w in words if w in kept}
        lacking = [w for w in words if w not in heads]
        for k in range(0, len(lacking), 20_000):
            some = lacking[k : k + 20_000]
            heads.update(zip(some, self.of_words(some), strict=True))
        tails = {run[len(head) :] for run, head in whole.items()}
        marks = dict(zip(tails, self.of_library(list(tails)), strict=True)) if tails else {}
        for run, head in whole.items():
            kept[run] = heads[head] + marks[run[len(head) :]]
        kept.update(heads)

    def runs_of(self, text: str) -> list[str]:
        """The text's runs between blanks; lower-cased, and with lone points and commas apart, where that is safe for all of it."""
        if _NO_SPACE.search(text):
            return _BLANK.split(text)
        if self.lowers and (text.isascii() or not _WIDE.search(text)) and not any(x in text for x in self.added):
            text = text.lower()
            if not _CROWDED.search(text):
                text = text.replace(".", " . ").replace(",", " , ")
        return text.split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for some in in_pieces(texts, len, BATCH_CHARS):
            runs = [self.runs_of(t) for t in some]
            distinct: set[str] = set()
            distinct.update(*runs)
            self.learn(distinct)
            out += [np.frombuffer(b"".join(map(self.kept.__getitem__, r)), "<u4") for r in runs]
        return out


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))


SHARDS = "part int, seq int, start_in_part long, n_ids long, doc_ids array<long>, data binary"


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_ids: int = SHARD_IDS, block: int = BLOCK_IDS) -> str:
    """Encode, append end_id to each document, and write shards in ascending doc_id order at path."""

    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seq, start, held, names, size = 0, 0, [], [], 0
        end = np.array([end_id], "<u4")

        def shard():
            nonlocal seq, start, held, names, size
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([shard_bytes(held, enc.vocab_size, block)], pa.binary())],
                names=["part", "seq", "start_in_part", "n_ids", "doc_ids", "data"],
            )
            seq, start, held, names, size = seq + 1, start + size, [], [], 0
            return row

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), (t or "" for t in batch.column(1).to_pylist()), strict=True)
            for some in in_pieces(rows, lambda r: len(r[1]), BATCH_CHARS):
                for (doc_id, _), ids in zip(some, enc.encode([t for _, t in some]), strict=True):
                    ids = np.concatenate([ids, end])
                    if held and size + len(ids) > shard_ids:
                        yield shard()
                    held.append(ids)
                    names.append(doc_id)
                    size += len(ids)
        if held:
            yield shard()

    n = parts(docs.sparkSession)
    dealt = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SHARDS).write.parquet(path)
    return path


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files alone."""
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row a written partition
    before, at = {}, 0
    for row in totals:
        before[row["part"]] = at
        at += row["n"]

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            for part, start, doc_ids, data in zip(rows["part"], rows["start_in_part"], rows["doc_ids"], rows["data"], strict=True):
                shard = Shard(data)
                ids = shard.ids()
                bounds = shard.starts.astype(np.int64)
                raw = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(bounds[:-1] + (before[part] + start), pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "start_in_part", "doc_ids", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    spark = docs.sparkSession
    return read_packed(spark, write_packed(docs, new_path(spark, "packed"), tokenizer, end_id))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
