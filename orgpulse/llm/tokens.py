"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie in one flat array of symbols with their row numbers. Each round
looks up the merge rank of every neighbouring pair, finds each row's lowest, and merges all its
occurrences at once, left to right; rows without a mergeable pair leave the array. A pair made by a
merge always ranks below that merge, so rounds give the same result as single merges. What survives is
the number of tokens.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from orgpulse.llm.common import bounded_batches, free_name, per_text

LIMIT = 512
# Counts of this many pre-tokens are remembered from batch to batch (about 100 bytes each).
REMEMBERED = 400_000
_NONE = np.int64(1 << 40)


class MergeTable:
    """The merges of a byte-level tokenizer file as sorted arrays."""

    def __init__(self, path: str) -> None:
        import regex
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.bytes = np.array([ids[c] for c in _byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = np.int64(max(ids.values()) + 1)
        keys = np.array([ids[a] * int(self.width) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def survivors(self, words: list[str]) -> np.ndarray:
        """Number of symbols of each word after all merges."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        symbols = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        row = np.repeat(np.arange(len(words)), size)
        rank = self._ranks(symbols, row)
        out = size.copy()
        while len(symbols):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            low = np.minimum.reduceat(rank, first)
            many = np.diff(np.append(first, len(row)))
            live = np.repeat(low < _NONE, many)
            if not live.all():
                symbols, row, rank = symbols[live], row[live], rank[live]
                many, low = many[low < _NONE], low[low < _NONE]
                if not len(symbols):
                    break
            hit = rank == np.repeat(low, many)
            # In a run of overlapping equal pairs every second one merges, from the left.
            at = np.flatnonzero(hit)
            start = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            at = at[place % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            np.subtract.at(out, row[at], 1)
            # Only pairs beside a merge change.
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            symbols, row, rank, changed = symbols[keep], row[keep], rank[keep], changed[keep]
            changed[:-1] |= changed[1:]
            at = np.flatnonzero(changed)
            rank[at] = self._ranks(symbols, row, at)
        return out

    def _ranks(self, symbols: np.ndarray, row: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Merge rank of the pairs that begin at `at`; a row's last symbol begins none."""
        at = np.arange(len(symbols)) if at is None else at
        after = np.minimum(at + 1, len(symbols) - 1)
        pair = (row[after] == row[at]) & (after > at)
        return np.where(pair, self.rank(symbols[at], symbols[after]), _NONE)

    def counts(self, values: list[str]) -> list[int]:
        """Tokens of each text; a special string counts as one token."""
        extra = [0] * len(values)
        words: list[list[str]] = []
        for i, text in enumerate(values):
            if self.split is not None and self.split.search(text):
                parts = self.split.split(text)
                extra[i] = len(parts) - 1
                words.append([w for p in parts for w in self.pattern.findall(p)])
            else:
                words.append(self.pattern.findall(text))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for ws in words for w in ws if w not in self.known})
        if new:
            self.known.update(zip(new, self.survivors(new).tolist(), strict=True))
        get = self.known.__getitem__
        return [e + sum(map(get, ws)) for e, ws in zip(extra, words, strict=True)]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for letters from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_tables: dict[str, MergeTable] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """`docs` with a struct column `tokens` (n_bytes, n_tokens, over_limit) of its `text`.

    A null or empty text has no bytes and no tokens. Every row is counted, repeated ones too; a clash
    with a column `tokens` is avoided by underscores."""
    bounded_batches(docs.sparkSession)

    def run(values: list[str]) -> pd.DataFrame:
        if tokenizer not in _tables:
            _tables[tokenizer] = MergeTable(tokenizer)
        n = np.array(_tables[tokenizer].counts(values), np.int64)
        return pd.DataFrame({"n_bytes": [len(v.encode()) for v in values], "n_tokens": n, "over_limit": n > limit})

    return docs.withColumn(free_name(docs, "tokens"), per_text(run, "n_bytes long, n_tokens long, over_limit boolean"))
