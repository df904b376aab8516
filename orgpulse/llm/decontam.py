"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items form one automaton (in several blocks if they are many). Each
document's words are streamed through it; the state and the longest matching length after every word
say which item windows end there. Words inside a window of `window` item words, or inside a whole
shorter item, are hit; documents whose hit share reaches the coverage limit are contaminated.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.llm.common import bounded_batches, cache, free_name, per_text, texts
from orgpulse.staging import stage

WINDOW = 13
COVERAGE = 20  # contaminated: COVERAGE * hit words >= words
# Bytes of item texts in one automaton, about 50 bytes of memory each. A larger benchmark is matched in
# several passes, each with one block of items, so that neither memory nor broadcasts grow with it.
BLOCK_BYTES = 2 << 20

# Digits, A-Z (as a-z), a-z and every byte of a non-ASCII character belong to words.
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD).split()


class SuffixAutomaton:
    """Every word sequence that occurs in an item, with the items of each window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        for _, words in items:
            last = 0
            self.shortest = min(self.shortest, len(words))
            for word in words:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary) + 1))
        # States can still split while items are added, so windows are marked in a second walk.
        self.found: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        marks: dict[tuple[int, int], set[int]] = {}
        for number, words in items:
            at, size = 0, min(window, len(words))
            for place, word in enumerate(words):
                at = self.next[at][self.vocabulary[word]]
                if place + 1 >= size:
                    marks.setdefault((self._state_of(at, size), size), set()).add(number)
        for (state, size), numbers in marks.items():
            self.found.setdefault(state, []).append((size, tuple(sorted(numbers))))

    def _state_of(self, state: int, size: int) -> int:
        """The state of the suffix of `size` words."""
        while self.link[state] >= 0 and self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, parent: int, child: int, symbol: int) -> int:
        """`child` if it is `parent` plus one word, else a copy of it that is."""
        if self.length[parent] + 1 == self.length[child]:
            return child
        copy = self._new(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:  # an earlier item has the same beginning
            return self._split(last, self.next[last][symbol], symbol)
        state = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = state
            at = self.link[at]
        if at >= 0:
            self.link[state] = self._split(at, self.next[at][symbol], symbol)
        return state

    def match(self, words: list[bytes], hit: np.ndarray) -> set[int]:
        """Mark the hit words of a text in `hit`; the numbers of the items with occurring windows."""
        get = self.vocabulary.get
        ids = [get(w, 0) for w in words]
        known = np.flatnonzero(np.diff(np.concatenate([[0], np.array(ids, np.int32) != 0, [0]])))
        numbers: set[int] = set()
        for first, last in known.reshape(-1, 2):  # runs of words that items use
            if last - first < self.shortest:
                continue
            state = size = 0
            for place in range(first, last):
                symbol = ids[place]
                while state and symbol not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if symbol in self.next[state]:
                    state, size = self.next[state][symbol], size + 1
                if size < self.shortest:
                    continue
                at, longest = state, 0
                while at > 0:
                    for need, items in self.found.get(at, ()):
                        if need <= size:
                            longest = max(longest, need)
                            numbers.update(items)
                    at = self.link[at]
                if longest:
                    hit[place + 1 - longest : place + 1] = True
        return numbers


def _blocks_of(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The items with a block number, and the number of blocks. A block holds about `block_bytes` of text."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), blocks


def _held(items: DataFrame) -> bytes:
    """The items of one block, (id, words) each; items without words are left out."""
    rows = [(r["item_id"], words_of(r["text"])) for r in items.collect()]
    return pickle.dumps([(number, words) for number, words in rows if words])


def _automaton(name: str, held: bytes, window: int) -> SuffixAutomaton:
    """The automaton of a block; a Python worker keeps the last one."""
    kept = cache(__name__)
    if name not in kept:
        kept.clear()
        kept[name] = SuffixAutomaton(pickle.loads(held), window)
    return kept[name]


def _matches(spark: SparkSession, items: DataFrame, window: int, cut: int | None = None) -> tuple[Column, Broadcast]:
    """A struct of a text's n_words, items and hit runs against the items of one block. With the limit `cut`,
    what is left of a text without its hit words is a further field `rest`; it is null where no words are hit
    or the hit words reach the limit."""
    shared = spark.sparkContext.broadcast(_held(items))
    name = uuid.uuid4().hex
    columns = ["n_words", "items", "spans", "rest"]
    kind = f"n_words long, items array<long>, spans {_SPANS}" + (", rest string" if cut is not None else "")

    def run(values: list[str]) -> pd.DataFrame:
        automaton = _automaton(name, shared.value, window)
        out = []
        for text in values:
            words = words_of(text)
            hit = np.zeros(len(words), bool)
            numbers = automaton.match(words, hit)
            spans = _runs(hit)
            rest = None if cut is None else _rest(text, spans, len(words), cut)
            out.append((len(words), sorted(x for x in numbers if x is not None), spans, rest))
        found = pd.DataFrame(out, columns=columns)
        return found.drop(columns="rest") if cut is None else found.astype({"rest": object})

    return per_text(run, kind), shared


_SPANS = "array<struct<first: long, end: long>>"


def _rest(text: str, spans: Sequence[dict[str, int]], n_words: int, coverage: int) -> str | None:
    """`text` without the hit words in `spans` and the separators after them; null where none is hit or they
    reach the limit."""
    n_hit = sum(s["end"] - s["first"] for s in spans)
    if not n_hit or n_hit * coverage >= n_words:
        return None
    raw = text.encode()
    is_word = np.concatenate([[False], np.frombuffer(raw.translate(_WORD), np.uint8) != 32])
    starts = np.flatnonzero(is_word[1:] & ~is_word[:-1]).tolist() + [len(raw)]
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : starts[s["first"]]])
        at = starts[s["end"]]
    return b"".join([*kept, raw[at:]]).decode()


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
    return [{"first": int(a), "end": int(b)} for a, b in edges]


def _verdict(found: Column, coverage: int, cut: bool) -> Column:
    n_hit = F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return F.struct(
        found["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        found["items"].alias("items"),
        ((n_hit > 0) & (n_hit * coverage >= found["n_words"])).alias("contaminated"),
        found["spans"].alias("spans"),
        *([found["rest"].alias("rest")] if cut else []),
    )


def _joined_runs(spans: Column) -> Column:
    """Overlapping and touching runs of several blocks as one each, in order."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["first"]), grown).otherwise(
            F.concat(done, F.array(s))
        )

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), add)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """`docs` (a `text` column, any others) with a struct column `found`: n_words, n_hit, items
    (distinct ids, ascending), contaminated, spans (first word, end word) of the hit runs.

    Null texts and texts without words have no hits. Items without words are no windows, items with
    equal texts are each reported. An empty benchmark hits nothing. Items with a null id are matched
    (their words are hit) but not listed. A clash with a column `found` is avoided by underscores."""
    return _marked(docs, benchmark, window, coverage, block_bytes, False)


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, coverage: int, block_bytes: int, cut: bool) -> DataFrame:
    """`contamination`; with `cut` the struct has what is left of texts hit below the limit as `rest`. A row
    goes to Python once for both: every further call in a stage is one more worker beside each task, and
    executors keep their workers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    name = free_name(docs, "found")
    items, blocks = _blocks_of(benchmark, block_bytes)
    if blocks == 1:
        found, _ = _matches(spark, items, window, coverage if cut else None)
        return docs.withColumn(name, found).withColumn(name, _verdict(F.col(name), coverage, cut))
    # One pass over the documents for each block; only one block is broadcast at a time.
    items = stage(items.sort("block"), "items")
    row = free_name(docs, "row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    passes = []
    for k in range(blocks):
        found, shared = _matches(spark, items.where(F.col("block") == k), window)
        hits = rows.select(row, found.alias("m")).select(row, "m.items", "m.spans").where(F.size("spans") > 0)
        passes.append(stage(hits, "hits"))
        shared.destroy()
    per_row = (
        reduce(DataFrame.union, passes)
        .groupBy(row)
        .agg(F.flatten(F.collect_list("items")).alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))
        .select(
            F.col(row).alias("_at"),
            F.struct(F.array_sort(F.array_distinct("_items")).alias("items"), _joined_runs(F.col("_spans")).alias("spans")).alias("_m"),
        )
    )
    merged = rows.join(per_row, F.col(row) == F.col("_at"), "left")
    none = F.array()
    spans = F.coalesce(F.col("_m")["spans"], none.cast(_SPANS))
    merged = merged.withColumn("_spans", spans).withColumn(name, _counted(coverage if cut else None))
    full = F.struct(
        F.col(name)["n_words"].alias("n_words"),
        F.coalesce(F.col("_m")["items"], none.cast("array<long>")).alias("items"),
        F.col("_spans").alias("spans"),
        F.col(name)["rest"].alias("rest"),
    )
    return merged.withColumn(name, full).withColumn(name, _verdict(F.col(name), coverage, cut)).select(*docs.columns, name)


def _counted(cut: int | None) -> Column:
    """The words of a text, and its `rest` as `_matches` gives it."""

    def run(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        cache(__name__)
        out = []
        for t, s in zip(texts(text), spans, strict=True):
            n_words = len(words_of(t))
            out.append((n_words, None if cut is None else _rest(t, s, n_words, cut)))
        return pd.DataFrame(out, columns=["n_words", "rest"]).astype({"n_words": "int64", "rest": object})

    run.__annotations__ = {"text": pd.Series, "spans": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "n_words long, rest string").asNondeterministic()("text", "_spans")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """`docs` without contaminated documents; in the others, hit words below the limit are removed with
    the separators after them. All columns stay; documents without hits stay as they are."""
    marked = _marked(docs, benchmark, window, coverage, block_bytes, True)
    found = marked.columns[-1]
    rest = marked.where(f"not {found}.contaminated")
    text = F.when(F.col(f"{found}.n_hit") > 0, F.col(f"{found}.rest")).otherwise(F.col("text"))
    return rest.withColumn("text", text).drop(found)
