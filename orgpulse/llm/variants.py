"""Spelling variants: words one edit apart, found by a frontier that walks a trie held as a table.

The vocabulary is a trie whose unary chains are single edges: a row (node, label, child) of a distributed
edge table, a node being the hash of a prefix that is a word or has several continuations. The frontier
is a table of states (word, position, node, edits). One edit is spent at a node of the word's own path:
another edge is taken whose label agrees behind its first letter (replacement), or a letter of the word
is left out (deletion; insertions are the same pairs seen from the other word). Then the states join the
edge table level by level, each step consuming one label, until the word is used up; states that end in
a word are neighbours.

An edit in the first half of a word would start near the root, where a trie is dense. Such pairs are
found in the trie of the reversed words, where the edit is in the second half. So edits start at a depth
of half the word only, the edge table needs no edges above that, and no state meets the root, which all
words share. Nodes that hold a noticeable share of the rows of a join (their number is bounded by that
share, their edges by the alphabet) are looked up by broadcast, all others by a shuffle without hot keys.
A collision of two prefix hashes only adds candidates, which the exact check at the end removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.common import join_hot
from orgpulse.staging import stage

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
DROP_EVERY = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5  # a form occurs at least so many times as often


def lowered(c: Column) -> Column:
    """A-Z in lower case, all other letters unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def occurrences(docs: DataFrame, least_length: int = 1, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word): every letter run of at least `least_length` letters of every text, one letter left out where
    `drop_every` divides the crc32 of `<doc_id>:<run>`; 0 leaves all runs as they are. A null id counts
    as the empty text."""
    run = f"{LETTERS}{{{least_length},}}"  # whole runs: a run that is too short matches nowhere
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered(F.col("text")), F.lit(run), F.lit(0))).alias("run"),
    )
    if not drop_every:
        return runs.select(F.col("run").alias("word"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY
) -> DataFrame:
    """(word, n) of the words of at least `least_length` letters that occur at least `least_count` times."""
    long_ones = occurrences(docs, least_length, drop_every).where(F.length("word") >= least_length)
    return long_ones.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _part(text: str, first: Column, length: Column) -> Column:
    """`length` code points of a text column from `first`, counted from 0."""
    return F.substring(text, first + 1, length)


def _node(prefix: Column) -> Column:
    return F.xxhash64("side", prefix)


def trie(words: DataFrame, least_depth: int) -> tuple[DataFrame, DataFrame]:
    """The tries of the words (side 0) and of the reversed words (side 1) from depth `least_depth` on.

    Paths: (side, t, depth, node, own), one row for every node on the path of every spelled word `t`;
    `own` marks its last. Edges: (node, first, label, child)."""
    spelled = words.select(F.lit(0).alias("side"), F.col("word").alias("t")).union(
        words.select(F.lit(1).alias("side"), F.reverse("word").alias("t"))
    )
    length = F.length("t")
    prefixes = spelled.select("side", "t", F.explode(F.sequence(F.lit(least_depth), length)).alias("depth")).select(
        "side",
        "t",
        "depth",
        _node(_part("t", F.lit(0), F.col("depth"))).alias("node"),
        F.xxhash64(_part("t", F.col("depth"), F.lit(1))).alias("next"),
        (F.col("depth") == length).alias("own"),
    )
    nodes = prefixes.groupBy("node").agg(
        F.count("*").alias("below"),
        F.min("next").alias("a"),
        F.max("next").alias("b"),
        F.max(F.col("own").cast("int")).alias("ends"),
    )
    nodes = stage(nodes.where("a <> b or ends = 1").select("node", "below"), "trienodes")
    total = words.agg(F.count("*")).first()[0] * 2
    paths = stage(join_hot(prefixes.drop("next"), nodes, "node", F.col("below"), total).drop("below"), "triepaths")
    chain = paths.groupBy("side", "t").agg(F.sort_array(F.collect_list("depth")).alias("depths"))
    step = F.transform(
        F.slice("depths", F.lit(1), F.size("depths") - 1),
        lambda d, i: F.struct(d.alias("depth"), F.get("depths", i + 1).alias("end")),
    )
    edges = chain.select("side", "t", F.inline(step)).select(
        _node(_part("t", F.lit(0), F.col("depth"))).alias("node"),
        _part("t", F.col("depth"), F.lit(1)).alias("first"),
        _part("t", F.col("depth"), F.col("end") - F.col("depth")).alias("label"),
        _node(_part("t", F.lit(0), F.col("end"))).alias("child"),
    )
    return paths, stage(edges.distinct(), "trieedges")


def _along(states: DataFrame, edges: DataFrame, kept: Column) -> DataFrame:
    """States joined with the edges of their node where `kept` holds, moved to the child."""
    by_node = edges.select("node", "first", "label", "child")
    total = states.count()
    many = states.groupBy("node").agg(F.count("*").alias("n"))
    hot = F.broadcast(stage(many.where(F.col("n") * 1000 >= total).select("node"), "hotnodes"))
    common = states.join(F.broadcast(by_node.join(hot, "node")), "node").where(kept)
    rest = states.join(hot, "node", "left_anti").join(by_node, "node").where(kept)
    moved = (F.col("pos") + F.length("label")).alias("pos")
    return common.unionByName(rest).select("side", "t", moved, F.col("child").alias("node"))


def near_words(words: DataFrame, least_length: int) -> DataFrame:
    """(a, b): every ordered pair of words (word) that differ by one inserted, deleted or replaced letter."""
    paths, edges = trie(words, least_length // 2)
    # The edited letter lies in the second half as this side spells it; a middle letter counts on both.
    start = paths.where((F.col("depth") >= F.floor(F.length("t") / 2)) & ~F.col("own")).withColumnRenamed("depth", "pos")
    here, after = _part("t", F.col("pos"), F.lit(1)), _part("t", F.col("pos") + 1, F.lit(1))
    # Of a run of equal letters the last one is left out, which makes the way to a neighbour unique.
    deleted = start.where(here != after).select("side", "t", (F.col("pos") + 1).alias("pos"), "node")
    label_rest = F.expr("substring(label, 2)")
    replaced = _along(
        start.select("side", "t", "pos", "node"),
        edges,
        (F.col("first") > here)  # the pair is found from its smaller word alone
        & (F.length("label") <= F.length("t") - F.col("pos"))
        & (label_rest == _part("t", F.col("pos") + 1, F.length("label") - 1)),
    )
    states = stage(deleted.unionByName(replaced), "frontier")
    done: DataFrame | None = None
    while True:
        used_up = F.col("pos") == F.length("t")
        ended = states.where(used_up).select("side", "t", "node")
        done = ended if done is None else done.unionByName(ended)
        walking = states.where(~used_up)
        if walking.isEmpty():
            break
        agrees = F.col("label") == _part("t", F.col("pos"), F.length("label"))
        states = stage(_along(walking, edges, agrees), "frontier")
    ends = paths.where("own").select("node", F.col("t").alias("u"))
    found = done.join(ends, "node").where(F.levenshtein("t", "u", 1) == 1)
    spelled = [F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(F.col(c))).alias(c) for c in ("t", "u")]
    pairs = found.select(*spelled)
    return pairs.toDF("a", "b").union(pairs.select("u", "t")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of the chain of forms. Each round doubles the steps that
    every word looks ahead; forms occur ever more often, so no chain is a circle."""
    ahead = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = stage(ahead.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), "beyond"), "roots")
        ahead = moved.select("word", "root")
        if moved.where("beyond is not null").isEmpty():
            return ahead


def spelling_variants(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    drop_every: int = DROP_EVERY,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `docs` (doc_id, text; other columns are
    ignored).

    A word's form is its most frequent near word (ties: the smallest in code-point order) if that occurs
    at least `ratio` times as often; the root is the end of the chain of forms, the word itself without
    a form. Null and empty texts have no words, repeated rows count each, an empty table gives no rows.
    A word of any length is one word; the frontier takes as many levels as the longest chain of words
    and branchings has within one word, not as many as the word has letters."""
    words = stage(vocabulary(docs, max(least_length, 1), least_count, drop_every), "vocabulary")
    pairs = stage(near_words(words.select("word"), max(least_length, 1)), "nearwords")
    target = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    best = F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("form")))
    near = pairs.join(target, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))
    held = words.join(near, "word", "left")
    has_form = F.col("form_n") >= ratio * F.col("n")
    judged = stage(
        held.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has_form, F.col("form")).alias("form"),
            F.when(has_form, F.col("form_n")).alias("form_n"),
        ),
        "variants",
    )
    ends = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
