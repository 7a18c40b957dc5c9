"""Token counts of whole texts by overlap resynchronisation.

Texts up to `chunk` characters are cut at every boundary that is proven stable by the
text alone (the second rule below), and each distinct run between two of them is encoded
once by the library; what was met lately is kept, in two generations, so memory stays
bounded.  A longer text is encoded in chunks that overlap; each chunk's token offsets are absolute positions in the
text.  Two neighbours are spliced at a common boundary that is proven stable:

* both encodings end a token there, and agree on the token after it,
* the text has a single blank between two characters that are no white space
  there.  The pre-tokenizer always begins a new piece at such a blank, whatever
  surrounds it, and no merge crosses a piece, so the tokens left of the boundary
  are those of the left chunk and the tokens right of it those of the right one.

If an overlap holds no such boundary it is widened (twice as long each time), to
the rest of the text if need be, so the count is always the library's own.

Special strings inside a text are matched as the library does by default: the
boundary lies at a blank, which no special string of the vocabulary contains
(else the text is encoded whole).  sentencepiece models have no such boundary
that holds for every model; their texts are encoded whole.

Null text counts as empty (0 tokens); rows are independent, so repeated rows count
alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bitpack import tokenizer_path
from .shared import in_pieces, kept, only, table

CHUNK = 32_768
OVERLAP = 512
BATCH_CHARS = 1 << 20
#: Runs whose counts a worker keeps: a bound of memory, not of the input.
KEPT_RUNS = 350_000

_SPACE = re.compile(r"\s")
_STABLE = re.compile(r"(?<=\S) (?=\S)")


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunk, self.overlap = chunk, min(overlap, chunk // 2)
        self.pieces = path.endswith(".model")
        self.kept: dict[str | None, int] = {None: 0}
        self.older: dict[str | None, int] = {}
        if self.pieces:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.splits = False
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            added = self.library.get_added_tokens_decoder().values()
            self.splits = not any(" " in str(t.content) or t.lstrip or t.rstrip for t in added)
            # tokens that begin with the byte of a blank, as byte-level vocabularies write it
            self.blank = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
            self.blank[[k for token, k in self.library.get_vocab().items() if token.startswith("\u0120")]] = True

    def whole(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(x) for x in self.library.encode(texts, num_threads=1)]
        if not self.splits:
            return self.of_library(texts)
        runs = [_STABLE.split(t) for t in texts]
        # a run after a boundary keeps its blank; the first one has none
        first = self.of_library([r[0] for r in runs])
        for r in runs:
            r[0] = None
        distinct: set[str | None] = set()
        distinct.update(*runs)
        self.learn(distinct)
        count = self.kept.__getitem__
        return [n + sum(map(count, r)) for n, r in zip(first, runs, strict=True)]

    def of_library(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, runs: set[str | None]) -> None:
        """Have the number of tokens of each run in self.kept."""
        if len(self.kept) > KEPT_RUNS:
            self.kept, self.older = {None: 0}, self.kept
        new = runs.difference(self.kept)
        again = [r for r in new if r in self.older]
        self.kept.update((r, self.older[r]) for r in again)
        new.difference_update(again)
        spaced = [r for r in new if _SPACE.search(r)]
        new.difference_update(spaced)
        self.kept.update(zip(spaced, self.of_library([" " + r for r in spaced]), strict=True))
        plain = list(new)
        for k in range(0, len(plain), 20_000):
            some = plain[k : k + 20_000]
            self.kept.update(zip(some, self.of_runs(some), strict=True))

    def of_runs(self, runs: list[str]) -> list[int]:
        """Of runs without white space, encoded as one text: each begins with its blank's token, and has no other one."""
        ids = np.fromiter(self.library.encode_batch_fast([" " + " ".join(runs)], add_special_tokens=False)[0].ids, np.int64)
        begins = np.flatnonzero(self.blank[ids])
        if len(begins) != len(runs) or begins[0]:
            return self.of_library([" " + r for r in runs])
        return np.diff(np.append(begins, len(ids))).tolist()

    def spans(self, text: str, start: int, stop: int) -> list[tuple[int, int]]:
        """Absolute (begin, end) of the tokens of text[start:stop]."""
        return [(a + start, b + start) for a, b in self.library.encode(text[start:stop], add_special_tokens=False).offsets]

    def chunked(self, text: str) -> int:
        n = len(text)
        total, start, begin = 0, 0, 0  # begin: tokens from here on are not counted yet
        left = self.spans(text, 0, min(n, self.chunk))
        stop = min(n, self.chunk)
        while stop < n:
            overlap = self.overlap
            while True:
                start = max(begin, stop - overlap)
                after = min(n, start + max(self.chunk, 2 * overlap))
                right = self.spans(text, start, after)
                cut = stable_boundary(text, left, right, start, stop, begin)
                if cut is not None:
                    total += sum(1 for a, _ in left if begin <= a < cut)
                    begin, left, stop = cut, right, after
                    break
                if start == begin:  # the overlap is all that is left of this chunk: a longer one instead
                    stop = min(n, begin + 2 * (stop - begin))
                    left = self.spans(text, begin, stop)
                    if stop == n:
                        break
                overlap *= 2
        return total + sum(1 for a, _ in left if a >= begin)

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = []
        for k, t in enumerate(texts):
            if len(t) <= self.chunk or not self.splits:
                short.append(k)
            else:
                out[k] = self.chunked(t)
        for k, n in zip(short, self.whole([texts[k] for k in short]) if short else [], strict=True):
            out[k] = n
        return out


def stable_boundary(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], start: int, stop: int, begin: int) -> int | None:
    """The last proven boundary of both encodings within [start, stop), past begin."""
    seen = {a: b for a, b in right if a < stop}
    for a, b in reversed(left):
        if a <= max(start, begin):
            return None
        if b < stop and text[a] == " " and not text[a - 1].isspace() and not text[a + 1].isspace() and seen.get(a) == b:
            return a
    return None


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Counter:
    return kept(("counter", path, chunk, overlap), lambda: Counter(path, chunk, overlap))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; one pass, no shuffle."""

    def run(batches):
        count = counter(tokenizer, chunk, overlap)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [x for some in in_pieces(texts, len, BATCH_CHARS) for x in count.counts(some)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    slim = only(docs, "doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
