"""Best-fit packing of token sequences.

A document's tokens end with an end id; documents longer than a sequence are cut into full pieces, the first
of which takes the remainder.  Full pieces are sequences by themselves.  The rest are packed online with a
bounded number of open bins: bins are kept by free space, a bitset has a bit per free space in use, so
the best fit is the lowest bit not under the piece's length; beyond the bound the fullest bin closes.

Pieces (a few numbers each, no text) are dealt by hash to as many packing tasks as their count needs, and
each task packs its share longest first within stretches.  A task keeps the open bins and one stretch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .durable import written


@dataclass(frozen=True)
class Packing:
    length: int = 1024
    end_id: int = 2
    open_bins: int = 8192
    #: Pieces of one packing task: few tasks leave few half-empty bins, and this many take some seconds.
    pieces_per_task: int = 400_000


#: Characters on which both libraries were compared one by one: Latin, general punctuation, the euro sign.
COMPARED = r"[^\x00-\u024F\u2010-\u2027\u2030-\u205E\u20AC]"
#: Characters without white space between, or of white space alone, from which the faster library's merging would take long.
LONG_RUN = 4096
#: Pieces sorted by length before they are packed: long ones first leave short ones to fill the gaps, and a
#: stretch well under the number of open bins keeps those open that the short ones need.
STRETCH = 4096


class Encoder:
    """Ids of texts by a ``tokenizers`` file of byte-level BPE, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them: a text that
    spells an added token, such as an end mark, has that token's id there.

    Where the same vocabulary stands beside it as ranks (``.tiktoken``), a faster library that gives the same ids does most of the
    work: for texts of compared characters that spell no added token and have no run of ``LONG_RUN`` characters, and only if it agrees with
    ``tokenizers`` on the first 64 texts that a worker sees, each up to 20,000 characters.  All other texts go to ``tokenizers``
    itself, whose ids are the definition."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.other = re.compile("|".join([COMPARED, *map(re.escape, added)])).search
        self.special = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.run = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}").search
        self.fast = self._ranks(path.removesuffix(".json") + ".tiktoken")
        self.agreed = False

    @staticmethod
    def _ranks(path: str):
        import base64
        import os

        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def defined(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: str) -> bool:
        """Whether the faster library may take this text."""
        if (self.special if text.isascii() else self.other)(text):
            return False
        return len(text) < LONG_RUN or not self.run(text)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if self.fast and not self.agreed:
            some = [t[:20_000] for t in texts[:64]]
            some = [t for t in some if self.plain(t)]
            self.agreed = all(a == self.fast.encode_ordinary(t) for t, a in zip(some, self.defined(some), strict=True))
            self.fast = self.fast if self.agreed else None
        for text in texts:
            if self.fast and self.plain(text):
                # an array from the start: a list of the ids of a very long text would take many times its size
                yield self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            else:
                yield np.array(self.defined([text])[0], "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces(docs: DataFrame, setting: Packing, tokenizer: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document: at least one piece, for the end id is a token."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoder(tokenizer).encode, setting.length
        end = np.array([setting.end_id], "<u4").tobytes()
        for batch in batches:
            texts = tb.texts_of(batch.column(1))
            for part in tb.slices(texts):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode(texts[part.start : part.stop].to_pylist()), part.start):
                    ids = ids.tobytes() + end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % width + 1, n + 1, width)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by free space; ``put`` places one length and returns (bin, offset)."""

    def __init__(self, width: int, most: int, first: int = 0, step: int = 1):
        self.width, self.most = width, most
        self.bits, self.n = 0, 0
        self.free: list[list[int]] = [[] for _ in range(width + 1)]
        self.next, self.step = first, step

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            held = self.free[free]
            number = held.pop()
            if not held:
                self.bits ^= 1 << free
            self.n -= 1
        else:
            free, number = self.width, self.next
            self.next += self.step
        left = free - length
        if left:
            self.free[left].append(number)
            self.bits |= 1 << left
            self.n += 1
            if self.n > self.most:  # the fullest bin closes
                low = (self.bits & -self.bits).bit_length() - 1
                held = self.free[low]
                held.pop()
                if not held:
                    self.bits ^= 1 << low
                self.n -= 1
        return number, self.width - free


def stretches(batches: Iterator[pa.RecordBatch], rows: int = STRETCH) -> Iterator[pa.Table]:
    """The same rows in tables of ``rows`` rows, whatever the batches' sizes; the last may be shorter."""
    held, n = [], 0
    for batch in batches:
        while n + batch.num_rows >= rows:
            held.append(batch.slice(0, rows - n))
            batch = batch.slice(rows - n)
            yield pa.Table.from_batches(held)
            held, n = [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held)


def pack(docs: DataFrame, tokenizer: str | None = None, setting: Packing = Packing()) -> DataFrame:
    """Every piece with its sequence and its place there: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece, the end id.  Repeated rows are packed as often as they are there, a null
    ``doc_id`` stays null; other columns are ignored; an empty table gives an empty result.  Sequence numbers are unique
    and not contiguous, however the result is coalesced, dealt anew or united: a packing share has its number as a column.  The order of packing
    depends on ids, pieces, lengths and the written pieces' places alone, so a task that runs again gives the same places."""
    every = written(pieces(docs, setting, tokenizer or tokenizer_path()), "pieces")
    full = every.where(F.col("length") == setting.length)
    rest = every.where(F.col("length") < setting.length)
    shares = max(1, -(-rest.count() // setting.pieces_per_task))
    names = [f.name for f in every.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, share = None, None
        for table in stretches(batches):
            numbers = table.column("share").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if share != numbers[a]:
                    share = numbers[a]
                    # even numbers: sequences packed here, dealt to shares in turn; odd numbers: full pieces
                    bins = Bins(setting.length, setting.open_bins, 2 * int(share), 2 * shares)
                part = table.slice(a, b - a)
                length = part.column("length").to_numpy()
                order = np.argsort(-length, kind="stable")
                placed = np.empty((len(length), 2), np.int64)
                for i, n in zip(order.tolist(), length[order].tolist(), strict=True):
                    placed[i] = bins.put(n)
                out = part.select(names).append_column("sequence_id", pa.array(placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))
                yield from out.combine_chunks().to_batches()

    # rows without ids that are equal are dealt out by their place in the table of pieces
    place = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    dealt = rest.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32", place)).withColumn("share", F.pmod("_h", F.lit(shares)).cast("int"))
    # a share is a task: by hash several would meet in one
    dealt = dealt.repartitionById(shares, "share").sortWithinPartitions("share", "_h", "doc_id", "piece", "ids_crc32", "length", "start").drop("_h")
    packed = dealt.mapInArrow(run, every.schema.add("sequence_id", "long").add("offset", "long"))
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)
