"""Best-fit packing planned on the length histogram.

Only the counts of piece lengths reach the driver (one number per length, at most `capacity`). There
best-fit decreasing runs over counts: a group of equally filled sequences takes as many pieces of a
length as fit, so the plan has a few ranges per length, whatever the number of documents. Pieces get a
rank within their length (salted, so that a common length is not one task's work) and join the range
that holds the rank; sequence and offset follow by arithmetic.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgpulse.llm.common import bounded_batches, cache, per_text
from orgpulse.staging import stage

CAPACITY = 2048
END_ID = 0
SALT_PIECES = 100_000  # pieces of one length that get their ranks in one task
# Characters for which the fast encoder and the tokenizer file split texts alike: printable ASCII,
# tab, line feed, and Latin letters. Texts with others go through the tokenizer library itself.
_PLAIN = r"[\t\n\x20-\x7eÀ-ÖØ-öø-ſ]*"


class Encoder:
    """Token ids of whole texts as the tokenizer file gives them, without added special tokens."""

    def __init__(self, path: str, ranks_path: str | None) -> None:
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.path = path
        self.plain = re.compile(_PLAIN)
        self.fast = _rank_encoder(ranks_path) if ranks_path else None

    @cached_property
    def full(self):
        """The tokenizer library's own; loaded at the first text that needs it, as it takes 100 MB."""
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(self.path)
        loaded.no_truncation()
        loaded.no_padding()
        return loaded

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and self.plain.fullmatch(text) and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # white space of some 600,000 characters exceeds its matcher's stack
                pass
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


def _rank_encoder(path: str):
    """The same vocabulary as merge ranks for a faster encoder; it yields the same ids."""
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str, ranks_path: str | None) -> Encoder:
    """One encoder per Python worker, as long as the worker packs."""
    held = cache(__name__)
    key = (path, ranks_path)
    if key not in held:
        held[key] = Encoder(path, ranks_path)
    return held[key]


def piece_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document: all full but the first, which takes what is left over."""
    first = total % capacity or capacity
    return [first] + [capacity] * ((total - first) // capacity)


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with the end id."""

    def run(values: list[str]) -> pd.Series:
        encode = encoder(tokenizer, ranks)
        out = []
        for text in values:
            ids = np.append(encode(text), END_ID).astype("<u4")
            start, cut = 0, []
            for number, length in enumerate(piece_lengths(len(ids), capacity)):
                crc = zlib.crc32(ids[start : start + length].tobytes())
                cut.append({"piece": number, "start": start, "length": length, "ids_crc32": crc})
                start += length
            out.append(cut)
        return pd.Series(out, dtype=object)

    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
    return docs.select("doc_id", per_text(run, kind).alias("p")).select("doc_id", F.inline("p"))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: ranges (length, first rank, end rank, first sequence, pieces
    per sequence, offset). Pieces of a range fill their sequences one after the other."""
    ranges: list[tuple[int, int, int, int, int, int]] = []
    groups: list[tuple[int, int, int]] = []  # (free, first sequence, sequences), by free space
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(free: int, first: int, many: int) -> None:
            """Put pieces into `many` sequences that have `free` tokens left."""
            nonlocal left, rank
            each = free // length
            full, rest = divmod(min(left, many * each), each)
            taken = full * each + rest
            ranges.append((length, rank, rank + taken, first, each, capacity - free))
            rank, left = rank + taken, left - taken
            ends = ((free - each * length, first, full), (free - rest * length, first + full, 1 if rest else 0))
            unused = first + full + ends[1][2]
            for group in (*ends, (free, unused, first + many - unused)):
                if group[2]:
                    insort(groups, group)

        while left:
            at = bisect_left(groups, (length, -1, -1))  # the fullest sequences that still have room
            if at == len(groups):
                each = capacity // length
                many = -(-left // each)
                sequences += many
                place(capacity, sequences - many, many)
            else:
                place(*groups.pop(at))
    return ranges


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, salt_pieces: int = SALT_PIECES
) -> DataFrame:
    """Pieces of all documents (doc_id, text) with sequence_id and offset.

    A null or empty text is one piece that holds the end id alone. Repeated rows are packed as often
    as they occur, rows with a null id too. No document gives no piece. Texts are encoded whole, however
    long. Pieces of equal length are interchangeable: which of them takes which slot is settled by
    (doc_id, piece, ids_crc32), and between rows equal in these it makes no difference.

    A full piece is a sequence of its own and needs no slot; such sequences have negative numbers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    every = stage(pieces(docs, tokenizer, ranks, capacity), "pieces")
    whole = every.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    cut = every.where(F.col("length") < capacity)
    many = stage(cut.groupBy("length").agg(F.count("*").alias("n")), "lengths")  # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in many.collect()}
    # A length gets as many salts as its pieces need, so no task ranks more than about `salt_pieces`.
    salts = many.select("length", F.ceil(F.col("n") / salt_pieces).alias("salts"))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", salt).drop("salts")
    by_salt = stage(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "salts")
    found = [(*r, k) for k, r in enumerate(plan(counts, capacity))]
    names = ("length", "from_rank", "to_rank", "sequence", "each", "at", "range")
    # As an Arrow table: a list of rows would go through Python workers of a second kind on every executor.
    columns = zip(*found, strict=True) if found else [()] * len(names)
    ranges = spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)}))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("row", F.row_number().over(own) - 1).join(F.broadcast(offsets), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("row"))
    # The plan is bounded by the capacity, not by the documents, and each rank lies in one range.
    within = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    placed = ranked.join(F.broadcast(ranges), "length").where(within)
    place = F.col("rank") - F.col("from_rank")
    return placed.select(
        *every.columns,
        (F.col("sequence") + F.floor(place / F.col("each"))).alias("sequence_id"),
        (F.col("at") + (place % F.col("each")) * F.col("length")).alias("offset"),
    ).unionByName(whole)
