"""Repeated passages by relative Lempel-Ziv parsing.

The reference is the corpus itself. It is cut into passages that content chooses: every window of
`window` words belongs to its least `GRAM`-word run (its *anchor*), and the windows of one anchor are a
passage. Equal windows have equal anchors at equal places, so a long factor of a passage can only lie in
passages with the same anchor. Passages are therefore dealt by anchor to reference blocks, and parsing
against the one block of its anchor is parsing against every indexed block.

A block is indexed by a suffix array over its passages; the longest match of a place elsewhere is then
that with a neighbour in suffix order. Each passage is parsed greedily into the longest factors. Factors
of at least `window` words are duplicates; windows that cross the end of a factor belong to no factor
and are looked up one by one.

Equal passages are counted before anything is compared, so thousands of copies are one row: a passage
that occurs twice is a factor as a whole, and only one of each goes into a block. An anchor whose
passages are too many for one block (a phrase in very many contexts) is cut into blocks of one window
each, where a count per window says the same as a parse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.common import _power_tables, bounded_batches, free_name, join_hot, mix, signed, slices, texts, word_hashes
from orgpulse.staging import stage

WINDOW = 35  # words
GRAM = 8  # words of an anchor
BLOCK_PASSAGES = 4_000  # of one reference block, on average
ANCHOR_PASSAGES = 2_000  # more distinct passages of one anchor are compared window by window
_WORDS = 1 << 18  # words of a text that are handled by one round of array operations
_U = np.uint64
_LOW = _U(0xFFFFFFFF)
_KEY = ["h", "d1", "d2"]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of `width` values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _digests(h: np.ndarray, first: np.ndarray, end: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the word runs [first, end), together with `extra`."""
    up, down = _power_tables(len(h) + 1)
    out = []
    for salt in (0x9FB21C651E98DF25, 0xD1B54A32D192ED03):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h ^ _U(salt)) * up[: len(h)])])
        out.append(mix((sums[end] - sums[first]) * down[first] + mix(extra + _U(salt))))
    return out[0], out[1]


def passages(h: np.ndarray, bounds: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """The passages of texts whose word hashes are h[bounds[i] : bounds[i + 1]]: text, first window
    (counted in the text), number of windows, anchor hash h and the digests d1 and d2."""
    parts: list[dict[str, np.ndarray]] = []
    with np.errstate(over="ignore"):
        for at in range(0, max(0, len(h) - window + 1), _WORDS):
            w = h[at : at + _WORDS + window - 1]
            gram = w.copy()
            for k in range(1, GRAM):
                gram = mix(gram[:-1] * _U(0xD6E8FEB86659FD93) + w[k:])
            places = np.arange(len(gram), dtype=_U)
            least = _least((gram & ~_LOW) | places, window - GRAM + 1) & _LOW
            start = np.arange(len(least))
            text = np.searchsorted(bounds, start + at, side="right") - 1
            inside = bounds[text + 1] >= start + at + window
            start, text, anchor = start[inside], text[inside], least[inside].astype(np.int64)
            if not len(start):
                continue
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
            first, many = start[new], np.diff(np.append(new, len(start)))
            offset = (anchor[new] - first).astype(_U)
            d1, d2 = _digests(w, first, first + many + window - 1, offset * _U(window) + many.astype(_U))
            columns = {"text": text[new], "first": first + at - bounds[text[new]], "n": many, "h": signed(gram[anchor[new]])}
            parts.append({**columns, "d1": signed(d1), "d2": signed(d2)})
    names = ("text", "first", "n", *_KEY)
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in names}


def _hashed(values: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of whole texts: number of the first one, word hashes, bounds of the texts in them."""
    raw = [v.encode() for v in values]
    for part in slices([len(v) for v in raw]):
        chunk = raw[part]
        starts, h = word_hashes(b" ".join(chunk))
        ends = np.cumsum([0, *[len(v) + 1 for v in chunk]])
        yield part.start, h, np.searchsorted(starts, ends)


def _with_key(docs: DataFrame) -> DataFrame:
    """(row, id, at): all columns in `row`; rows of equal id and `at` are the same document."""
    kind = docs.schema["doc_id"].dataType
    return docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id"), F.lit(0).cast(kind)).alias("id"),
        F.xxhash64("doc_id", "text").alias("at"),
    )


def all_passages(rows: DataFrame, window: int) -> DataFrame:
    """(id, at, first, n, h, d1, d2): every passage of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, h, bounds in _hashed(texts(b["text"])):
                p = passages(h, bounds, window)
                of = start + p.pop("text")
                yield pd.DataFrame({"id": b["id"].to_numpy()[of], "at": b["at"].to_numpy()[of], **p})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "at", "row.text").mapInPandas(run, f"id {kind}, at long, first int, n int, h long, d1 long, d2 long")


def _contents(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(h, d1, d2, n, words): the word hashes of the wanted passages (h, d1, d2, at), from a text that
    has them."""
    asked = wanted.groupBy("at").agg(F.collect_list("d1").alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = b["asked"].tolist()
            for start, h, bounds in _hashed(texts(b["text"])):
                p = passages(h, bounds, window)
                of, first = p.pop("text"), p.pop("first")
                of_text = np.searchsorted(of, np.arange(len(bounds)))
                runs = enumerate(zip(of_text[:-1], of_text[1:], strict=True))
                here = np.concatenate([a + np.flatnonzero(np.isin(p["d1"][a:z], asked[start + i])) for i, (a, z) in runs])
                found = {k: v[here] for k, v in p.items()}
                begin = bounds[of[here]] + first[here]
                words = [h[s : s + m + window - 1].tobytes() for s, m in zip(begin, found["n"], strict=True)]
                yield pd.DataFrame({**found, "words": pd.Series(words, dtype=object)})

    texts_of = rows.select("at", "row.text").join(asked, "at").select("text", "asked")
    found = texts_of.mapInPandas(run, "n int, h long, d1 long, d2 long, words binary")
    return found.dropDuplicates(_KEY)


def factor_lengths(words: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For every window start of every passage of a block: the longest match with any other place of the
    block that is a window start, found between neighbours of the suffix array."""
    many = np.array([len(w) - window + 1 for w in words])
    size = np.array([len(w) for w in words])
    _, symbol = np.unique(np.concatenate(words), return_inverse=True)
    width = int(size.max())
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    padded = np.concatenate([symbol + 1, np.zeros(width, np.int64)]).astype(">u4")
    of = np.repeat(np.arange(len(words)), many)
    begin = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    left = size[of] - begin
    suffix = padded[(first[of] + begin)[:, None] + np.arange(width)]
    suffix[np.arange(width) >= left[:, None]] = 0
    order = np.argsort(suffix.view(f"S{4 * width}")[:, 0], kind="stable")
    suffix, left = suffix[order], left[order]
    same = suffix[1:] == suffix[:-1]
    common = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    common = np.minimum(common, np.minimum(left[1:], left[:-1]))
    longest = np.zeros(len(of), np.int64)
    longest[order[1:]] = common
    longest[order[:-1]] = np.maximum(longest[order[:-1]], common)
    return np.split(longest, np.cumsum(many)[:-1])


def parse(longest: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Runs of repeated window starts of one passage, from a greedy parse into longest factors."""
    found: list[tuple[int, int]] = []
    at = 0
    while at < len(longest):
        factor = int(longest[at])
        if factor < window:  # a literal word
            at += 1
            continue
        found.append((at, at + factor - window + 1))
        # Windows that cross the factor's end lie in neither this factor nor the next one.
        for s in range(at + factor - window + 1, min(at + factor, len(longest))):
            if longest[s] >= window:
                found.append((s, s + int(longest[s]) - window + 1))
        at += factor
    merged: list[tuple[int, int]] = []
    for a, z in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(z, merged[-1][1]))
        else:
            merged.append((a, z))
    return merged


def _parsed(contents: DataFrame, blocks: int, window: int) -> DataFrame:
    """(h, d1, d2, runs): repeated window starts of each passage that has some."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = factor_lengths([np.frombuffer(w, _U) for w in rows["words"]], window)
        runs = [[x for r in parse(f, window) for x in r] if f.max() >= window else [] for f in lengths]
        out = rows[_KEY].assign(runs=pd.Series(runs, index=rows.index, dtype=object))
        return out[[len(r) > 0 for r in runs]]

    dealt = contents.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(block, "h long, d1 long, d2 long, runs array<int>")


def _by_window(contents: DataFrame, window: int) -> DataFrame:
    """(h, d1, d2, runs) for passages of overfull anchors: every window is a block of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, words in zip(b[_KEY].itertuples(index=False, name=None), b["words"], strict=True):
                w = np.frombuffer(words, _U)
                starts = np.arange(len(w) - window + 1)
                with np.errstate(over="ignore"):
                    w1, w2 = _digests(w, starts, starts + window, np.zeros(len(starts), _U))
                h, d1, d2 = key
                yield pd.DataFrame({"h": h, "d1": d1, "d2": d2, "s": starts, "w1": signed(w1), "w2": signed(w2)})

    single = stage(contents.mapInPandas(run, "h long, d1 long, d2 long, s int, w1 long, w2 long"), "windows")
    counts = single.groupBy("w1", "w2").agg(F.count("*").alias("many")).where("many > 1")
    counts = stage(counts.select(F.struct("w1", "w2").alias("w"), "many"), "windowcounts")
    keyed = single.select(*_KEY, "s", F.struct("w1", "w2").alias("w"))
    found = join_hot(keyed, counts, "w", F.col("many"), max(1, single.count()))
    runs = F.flatten(F.transform(F.sort_array(F.collect_list("s")), lambda s: F.array(s, s + 1)))
    return found.groupBy(*_KEY).agg(runs.alias("runs"))


def repeated_windows(
    rows: DataFrame, window: int, block_passages: int = BLOCK_PASSAGES, anchor_passages: int = ANCHOR_PASSAGES
) -> DataFrame:
    """(id, at, runs) of every text with repeated windows; runs: flat list of window starts and ends."""
    every = stage(all_passages(rows, window), "passages")
    distinct = stage(every.groupBy(*_KEY).agg(F.count("*").alias("times"), F.min("at").alias("at")), "distinct")
    kinds = stage(distinct.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "anchors")
    total = distinct.count()
    open_ones = stage(join_hot(distinct.drop("times"), kinds, "h", F.col("kinds"), max(1, total)), "open")
    contents = _contents(rows, open_ones, window).join(kinds.where(F.col("kinds") > anchor_passages), "h", "left")
    contents = stage(contents, "contents")
    few = contents.where("kinds is null").drop("kinds")
    blocks = max(1, -(-few.count() // block_passages))
    partly = _parsed(few, blocks, window).unionByName(_by_window(contents.where("kinds is not null").drop("kinds"), window))
    partly = stage(partly, "factors")
    # A passage that occurs twice is a factor as a whole, whatever the block says.
    marked = distinct.select(*_KEY, "times").join(partly, _KEY, "left").where("times > 1 or runs is not null")
    marked = stage(marked.select(F.struct(*_KEY).alias("key"), "times", "runs"), "marked")
    keyed = every.select("id", "at", "first", "n", F.struct(*_KEY).alias("key"))
    found = join_hot(keyed, marked, "key", F.col("times"), max(1, every.count()))
    whole = F.array(F.col("first"), F.col("first") + F.col("n"))
    some = F.transform("runs", lambda r: r + F.col("first"))
    placed = found.select("id", "at", F.when(F.col("times") > 1, whole).otherwise(some).alias("runs"))
    return placed.groupBy("id", "at").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _cut(window: int) -> Column:
    """Struct of n_words, n_removed, the kept text and the removed runs of words."""

    @F.pandas_udf("n_words long, n_removed long, kept string, spans array<struct<first: long, end: long>>")
    def cut(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(texts(text), runs.tolist(), strict=True):
            words = t.encode().split()
            if r is None or not len(r):
                out.append((len(words), 0, b" ".join(words).decode(), []))
                continue
            edges = np.asarray(r, np.int64).reshape(-1, 2)
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, edges[:, 0], 1)
            np.add.at(steps, edges[:, 1] + window - 1, -1)
            gone = np.cumsum(steps)[:-1] > 0
            ends = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            out.append((len(words), int(gone.sum()), kept.decode(), [{"first": int(a), "end": int(b)} for a, b in ends]))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "spans"])

    return cut("row.text", "runs")


def without_repeats(docs: DataFrame, window: int = WINDOW, **options: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) for every row of `docs` (doc_id, text; other columns are
    ignored): `kept` joins the words outside of repeated windows by one space, `spans` lists the removed
    runs of words.

    Words are runs without ASCII white space. A window is repeated if its words also start at any other
    place, of the same text too, overlapping it or not; all are judged on the input. Null and empty
    texts have no words; texts of fewer than `window` words lose none. A repeated row is a second
    document and repeats its result; rows with a null id are judged like all others. An empty table
    gives an empty result. Texts of any length are read whole, in rounds of bounded size."""
    return _judged(docs, window, options).select("row.doc_id", "m.*")


def deduplicated(docs: DataFrame, window: int = WINDOW, **options: int) -> DataFrame:
    """`docs` with a further column `kept_text`: the text without repeated windows, its words joined by one
    space. All rows and columns stay; a clash with a column of that name is avoided by underscores."""
    return _judged(docs, window, options).select("row.*", F.col("m.kept").alias(free_name(docs, "kept_text")))


def _judged(docs: DataFrame, window: int, options: dict[str, int]) -> DataFrame:
    """(row, m): every row and what `_cut` says of it."""
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    bounded_batches(docs.sparkSession)
    rows = _with_key(docs)
    found = repeated_windows(rows, window, **options)
    return rows.join(found, ["id", "at"], "left").select("row", _cut(window).alias("m"))
