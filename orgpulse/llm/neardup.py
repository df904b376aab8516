"""Near-duplicate groups by min-max hashing.

Every distinct shingle set is hashed under `permutations` permutations, and of each one both the
minimum and the maximum are kept, so a signature has twice as many values as hash passes. Bands of
`rows` values propose candidates; a link needs the exact Jaccard similarity of the two full sets.

Texts with one shingle set are one *class*, represented by its smallest id, so thousands of copies
cost one row. Inside a band bucket pairs are not enumerated: a few members (*probes*) are compared
with the bucket, linked members merge, and only buckets whose unprobed members still lie in several
components go on, with more probes. A bucket of near copies collapses at once. What stays open after two
rounds holds texts that are almost alike: the ids of overlapping open buckets form clusters, and a
cluster is compared in blocks, each pair of blocks one task of bounded size that multiplies two presence
matrices and returns no more than a spanning set of links. Clusters over a size limit go on with probes
until no bucket is open, so no candidate is left out.

A pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**32 = 4.7e-8 with the defaults.
Before full sets are fetched, pairs whose signatures (four bits of each value) differ in more places
than a pair at 0.8 does with probability 1e-8 are dropped: in more than 51 of 128, which is 8.3e-9 by
the binomial distribution. So the filter adds less to the miss than the bands have anyway.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.common import bounded_batches, cache, mix, per_text, shingle_sets, signed, slices
from orgpulse.staging import stage

PERMUTATIONS = 64
ROWS = 4
WIDTH = 5
SIMILARITY = (80, 100)
FIRST_PROBES = 1
MORE_PROBES = 8  # times as many in each further round
BLOCKS_ABOVE = 8  # ids of buckets open after so many probes are compared in blocks
BLOCK = 128  # ids of a block
BLOCK_BYTES = 1 << 20  # of the sets of a block; long texts make smaller blocks
CLUSTER = 20_000  # ids of a cluster that is compared in blocks
FILTER_MISS = 1e-8  # probability at most that the signatures of a pair at the limit speak against it
_COLUMNS = 16_384  # shingles of one presence matrix
# Up to this many ids (16 bytes each) of candidate classes are broadcast to pick their texts.
BROADCAST_IDS = 1_000_000
_U = np.uint64


def min_max_values(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """Signatures of non-empty sets: minima under every permutation, then maxima, one row per set."""
    factors = np.random.default_rng(7).integers(0, 2**63, permutations, dtype=np.uint64) * _U(2) + _U(1)
    out = np.empty((len(sets), 2 * permutations), _U)
    for part in slices([len(s) for s in sets], 1 << 17):
        flat = np.concatenate(sets[part])
        first = np.cumsum([0, *[len(s) for s in sets[part]]])[:-1]
        for k, a in enumerate(factors):
            y = flat * a
            y ^= y >> _U(32)
            out[part, k] = np.minimum.reduceat(y, first)
            out[part, permutations + k] = np.maximum.reduceat(y, first)
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for every full band of `rows` signature values."""
    bands = values.shape[1] // rows
    parts = values[:, : bands * rows].reshape(len(values), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U)), (len(values), bands))
    for r in range(rows):
        key = mix(key * _U(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key


def packed_bits(values: np.ndarray) -> np.ndarray:
    """The low four bits of every signature value, sixteen to a word."""
    words = -(-values.shape[1] // 16)
    low = np.zeros((len(values), words * 16), _U)
    low[:, : values.shape[1]] = values & _U(15)
    shifts = np.tile(np.arange(0, 64, 4, dtype=_U), words)
    return np.bitwise_or.reduce((low << shifts).reshape(len(values), words, 16), axis=2)


def most_mismatches(values: int, similarity: tuple[int, int]) -> int:
    """The fewest signature places that a pair of the least similarity exceeds with a probability of at
    most `FILTER_MISS`, by the exact binomial tail."""
    differ = (1 - similarity[0] / similarity[1]) * 15 / 16
    tail = 0.0
    for k in range(values, 0, -1):
        tail += comb(values, k) * differ**k * (1 - differ) ** (values - k)
        if tail > FILTER_MISS:
            return k
    return 0


def _mismatches(words: int) -> Column:
    total = F.lit(0)
    for k in range(words):
        x = F.get("bits", F.lit(k)).bitwiseXOR(F.get("pbits", F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def describe(docs: DataFrame, width: int, permutations: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, keys, bits): set size, 128-bit set fingerprint, band keys, signature."""

    def run(values: list[str]) -> pd.DataFrame:
        sets = shingle_sets([t.encode().lower() for t in values], width)
        size = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(size)
        prints = np.zeros((len(sets), 2), _U)
        keys: list = [None] * len(sets)
        bits: list = [None] * len(sets)
        if len(full):
            some = [sets[i] for i in full]
            flat, first = np.concatenate(some), np.cumsum([0, *size[full]])[:-1]
            prints[full, 0] = np.add.reduceat(mix(flat), first)
            prints[full, 1] = np.add.reduceat(mix(flat ^ _U(0xA0761D6478BD642F)), first)
            values = min_max_values(some, permutations)
            found, packed = signed(band_keys(values, rows)), signed(packed_bits(values))
            for row, i in enumerate(full):
                keys[i], bits[i] = found[row], packed[row]
        columns = {"n_shingles": size, "fp1": signed(prints[:, 0]), "fp2": signed(prints[:, 1])}
        return pd.DataFrame({**columns, "keys": pd.Series(keys, dtype=object), "bits": pd.Series(bits, dtype=object)})

    schema = "n_shingles long, fp1 long, fp2 long, keys array<long>, bits array<long>"
    return docs.select("doc_id", per_text(run, schema).alias("m")).select("doc_id", "m.*")


def _set_table(docs: DataFrame, width: int) -> DataFrame:
    """(id, items): the full set of each text as 64-bit hashes in ascending order, packed."""

    def run(values: list[str]) -> pd.Series:
        sets = shingle_sets([t.encode().lower() for t in values], width)
        return pd.Series([s.tobytes() for s in sets], dtype=object)

    found = docs.select(F.col("doc_id").alias("id"), per_text(run, "binary").alias("items"))
    return found.dropDuplicates(["id"])


def _linked(similarity: tuple[int, int]) -> Column:
    need, of = similarity

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        cache(__name__)
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
            if of * min(len(x), len(y)) < need * max(len(x), len(y)):
                out.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort(kind="stable")  # two sorted runs: a merge
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            out.append(of * shared >= need * (len(both) - shared))
        return pd.Series(out, dtype=bool)

    return linked("items_a", "items_b")


def connected(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over the links (a, b), for every id above its root.
    Alternating star contraction; every step is aggregation and join, cut off by a written table."""
    edges = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    while True:
        many = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        above = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi")
        if many.isEmpty() and above.isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        # Large star: every neighbour above u moves to the smallest of u and its neighbours.
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def alike(sets: list[np.ndarray], similarity: tuple[int, int]) -> np.ndarray:
    """Which of these sets are similar enough, as a matrix."""
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    both = np.zeros((len(sets), len(sets)))
    for first in range(0, len(shared), _COLUMNS):
        here = (column >= first) & (column < first + _COLUMNS)
        seen = np.zeros((len(sets), min(_COLUMNS, len(shared) - first)), np.float32)
        seen[row[here], column[here] - first] = 1
        both += seen @ seen.T
    return similarity[1] * both >= similarity[0] * (size[:, None] + size[None, :] - both)


def _compare_blocks(ids: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): links between components of the rows (id, comp, cluster, blocks), all pairs of a cluster
    compared. Every id goes to as many pairs of blocks as its cluster has blocks."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = (
        ids.join(sets, "id")
        .withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
        .select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "comp", "items")
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        cache(__name__)
        found = np.argwhere(np.triu(alike([np.frombuffer(x, _U) for x in rows["items"]], similarity), 1))
        comp = rows["comp"].to_numpy()
        root = {c: c for c in comp}
        links = []
        for x, y in found:
            a, b = comp[x], comp[y]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((min(a, b), max(a, b)))
        return pd.DataFrame(links, columns=["a", "b"]).astype(np.int64)

    return dealt.groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def find_components(
    members: DataFrame, sets: DataFrame, similarity: tuple[int, int], probes: int, values: int
) -> DataFrame:
    """(id, root) of every member id: components over the confirmed links in the buckets (key, id, bits).

    Probes are the members of lowest hash, the same in all buckets that a group of near copies shares,
    so the group is compared with few of its members. Links are contracted to links between the
    components of the last round; only those go through `connected`."""
    rank = F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1))
    ids = stage(members.select("id").distinct().withColumn("root", F.col("id")), "components")
    state = members.withColumns({"rank": rank, "comp": F.col("id")})
    checked: DataFrame | None = None
    near = _mismatches(-(-values // 16)) <= most_mismatches(values, similarity)
    while True:
        groups = state.groupBy("key").agg(
            F.count("*").alias("size"), F.min("rank").alias("low"), F.min("comp").alias("c1"), F.max("comp").alias("c2")
        )
        share = F.least(F.lit(float(1 << 62)) * F.lit(probes - 1) / F.col("size"), F.lit(float(1 << 62)))
        groups = groups.where("c1 < c2").select("key", F.greatest("low", share.cast("long")).alias("below"))
        state = stage(
            state.join(groups, "key").withColumn("probe", F.col("rank") <= F.col("below")).drop("below"), "buckets"
        )
        if state.isEmpty():
            return ids
        probe = state.where("probe").select("key", F.col("id").alias("p"), F.col("comp").alias("pc"), F.col("bits").alias("pbits"))
        first = F.col("id") < F.col("p")
        pairs = (
            state.join(probe, "key")
            .where((F.col("comp") != F.col("pc")) & (~F.col("probe") | (F.col("id") > F.col("p"))) & near)
            .select(
                F.least("id", "p").alias("a"),
                F.greatest("id", "p").alias("b"),
                F.when(first, F.col("comp")).otherwise(F.col("pc")).alias("ca"),
                F.when(first, F.col("pc")).otherwise(F.col("comp")).alias("cb"),
            )
            .distinct()
        )
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        judged = stage(
            pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
            .select("a", "b", "ca", "cb", _linked(similarity).alias("ok")),
            "pairs",
        )
        tried = judged.select("a", "b")
        checked = tried if checked is None else checked.union(tried)
        ids, state = _contract(judged.where("ok").select("ca", "cb"), ids, state.where("not probe").drop("probe"))
        if probes == BLOCKS_ABOVE:
            open_rows = _open_only(state)
            grouped = _clusters(open_rows, sets)
            small = grouped.where(F.col("size") <= CLUSTER)
            ids, open_rows = _contract(_compare_blocks(small, sets, similarity), ids, open_rows)
            state = open_rows.join(small.select("id"), "id", "left_anti")
        probes *= MORE_PROBES


def _contract(links: DataFrame, ids: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`ids` (id, root) and `state` (comp) after merging the components that `links` join."""
    links = stage(links.toDF("a", "b"), "links")
    if links.isEmpty():
        return ids, state
    merged = connected(links).select(F.col("id").alias("comp"), F.col("root").alias("to"))
    ids = ids.withColumnRenamed("root", "comp").join(merged, "comp", "left")
    ids = stage(ids.select("id", F.coalesce("to", "comp").alias("root")), "components")
    return ids, state.join(merged, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")


def _open_only(state: DataFrame) -> DataFrame:
    """Rows of the buckets whose members lie in several components."""
    spread = state.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2")
    return stage(state.join(spread.select("key"), "key"), "buckets")


def _clusters(state: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, comp, cluster, size, blocks) of the ids in `state`; ids of one bucket are in one cluster.
    A cluster has so many blocks that neither ids nor bytes of sets are too many for one."""
    first = state.groupBy("key").agg(F.min("id").alias("b"))
    joined = connected(state.select("key", F.col("id").alias("a")).join(first, "key").select("a", "b"))
    ids = state.groupBy("id").agg(F.first("comp").alias("comp")).join(joined, "id", "left")
    ids = stage(ids.select("id", "comp", F.coalesce("root", "id").alias("cluster")), "clusters")
    held = ids.join(sets.select("id", F.octet_length("items").alias("held")), "id")
    size = held.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("held").alias("held"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("held") / BLOCK_BYTES))
    return ids.join(size.select("cluster", "size", blocks.alias("blocks")), "cluster")


def near_duplicates(
    docs: DataFrame,
    width: int = WIDTH,
    similarity: tuple[int, int] = SIMILARITY,
    permutations: int = PERMUTATIONS,
    rows: int = ROWS,
    probes: int = FIRST_PROBES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text; further columns
    are ignored).

    Words are runs without ASCII white space, A-Z in lower case. A null or empty text, or one without
    words, has no shingles and is its own component. A repeated row repeats its result. Rows with a
    null doc_id can be named by no link: they count as their own component (null) and are kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    described = stage(describe(docs, width, permutations, rows), "minmax")
    linkable = described.where("n_shingles > 0 and doc_id is not null")
    classes = stage(
        linkable.groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")),
        "classes",
    )
    copied = classes.where("copies > 1").select("n_shingles", "fp1", "fp2", "id")
    # Only the representative of a class enters the bands; single texts represent themselves.
    first = linkable.join(copied, ["n_shingles", "fp1", "fp2"], "left").where("id is null or id = doc_id")
    banded = first.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), "bits")
    shared = banded.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("key")
    members = stage(banded.join(shared, "key").dropDuplicates(["key", "id"]), "members")
    active = members.select(F.col("id").alias("doc_id")).distinct()
    if members.select("id").distinct().count() <= BROADCAST_IDS:
        active = F.broadcast(active)
    sets = stage(_set_table(docs.join(active, "doc_id", "left_semi"), width), "sets")
    groups = classes.select("n_shingles", "fp1", "fp2", "id").join(
        find_components(members, sets, similarity, probes, 2 * permutations), "id", "left"
    )
    return described.join(groups, ["n_shingles", "fp1", "fp2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "id", "doc_id")).alias("component_id"),
        F.coalesce(F.coalesce("root", "id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, **options: object) -> DataFrame:
    """`docs` without the documents that a smaller id of their component stands for; all columns stay.
    Rows that repeat the kept id exactly stay too, as they cannot be told apart by id."""
    found = near_duplicates(docs, **options)  # type: ignore[arg-type]
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
