"""Toxicity by weak supervision.

Voters (word lists, words and word beginnings over-represented in toxic training texts, spelling and
address patterns, counts) vote on every whole text. How often each vote pattern occurs is counted over the whole corpus;
the number of patterns is bounded by the number of voters. On those counts a generative label model is
fitted by expectation-maximisation: class rates of every voter, and joint rates of the voters whose
votes correlate beyond what the class explains. Training labels, where known, fix the class. A linear
classifier is then trained on the posterior labels and scores documents as a column expression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.common import bounded_batches, bucket_of, cache, per_text, shingle_sets, signed, texts
from orgpulse.staging import stage

HOLDOUT = (5, 0)
MINED_ROWS = 20_000  # about so many labelled training rows are searched for toxic words
MINED_SUPPORT = 5  # toxic texts that must have a mined word
MINED_SHARE = 0.7  # share of its texts that must be toxic
MINED_EVIDENCE = 30.0  # and its log-likelihood ratio
SKETCHES = 3
CORRELATED = 0.25

INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid imbecile imbeciles fool fools dumb dumbass dunce "
    "retard retarded halfwit dimwit simpleton clown clowns airhead blockhead"
)
CONTEMPT = (
    "worthless pathetic disgusting scum trash loser losers garbage filth filthy vermin pig pigs maggot "
    "parasite lowlife scumbag creep coward cowards freak freaks ugly repulsive despicable"
)
PROFANITY = (
    "fuck fucking fucked fucker motherfucker shit shitty bullshit asshole assholes bitch bitches bastard "
    "bastards cunt dick dickhead prick whore slut damn crap piss wanker twat"
)
OTHER_LANGUAGES = (
    "idiotisch dummkopf arschloch scheisse scheiße abschaum versager wichser hurensohn schwachkopf "
    "connard connasse salope crétin imbécile ordure abruti merde putain enculé "
    "idiota imbécil estúpido estúpida basura escoria perdedor cabrón gilipollas mierda puta pendejo"
)
LISTS = tuple(frozenset(x.split()) for x in (INSULTS, CONTEMPT, PROFANITY, OTHER_LANGUAGES))
ADDRESS = re.compile(
    r"\byou(?:'re|r| are)? (?:a |an |such a |such an |all |so )?(?:are |is )?([a-z]+)\b|"
    r"\b(shut up|drop dead|kill yourself|go die|hate you|nobody likes you)\b"
)
_THREATS = ("shut up", "drop dead", "kill yourself", "go die", "hate you", "nobody likes you")
_DISGUISED = re.compile(r"(?<![^\s])[a-z]+[0-9@$!*_.\-]+[a-z][a-z0-9@$!*_.\-]*|(?<![^\s])(?:[a-z][ .\-_]){3,}[a-z](?![a-z])")
_FOLD = str.maketrans("0134578@$!", "oleastbasi")

VOTERS = (
    "insult", "contempt", "profanity", "other_language", "mined_even", "mined_odd", "stem_once", "stem_twice",
    "stem_more", "disguised", "addressed", "two_words", "dense", "none",
)
STEM_LENGTHS = (4, 5, 6, 7)
MAX_HITS = 7  # hits are counted up to here in the classifier's features
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    return text.lower().encode().translate(_LETTERS).decode().split()


@dataclass(frozen=True)
class Mined:
    """What the training texts add to the lists: whole words, and beginnings of words."""

    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()

    def stem_of(self, word: str) -> bool:
        return any(word[:k] in self.stems for k in STEM_LENGTHS if len(word) > k)


def votes(text: str, mined: Mined) -> tuple[int, int]:
    """Bits of the voters that fire on a whole text, in the order of VOTERS, and the number of hits."""
    low = text.lower()
    words = low.encode().translate(_LETTERS).split()
    known, starts = _known(mined)
    stems = sum(1 for w in words if w[:4] in starts and mined.stem_of(w.decode())) if starts else 0
    hits = [w.decode() for w in words if w in known]
    seen = set(hits)
    disguised = False
    if any(c in low for c in "013457@$!*") or ". " in low or " - " in low or "-" in low:
        for m in _DISGUISED.finditer(low):
            plain = re.sub(r"[^a-zß-ÿ]", "", m[0].translate(_FOLD))
            masked = re.sub(r"[^a-z*]", "", m[0])
            if any(plain in x for x in LISTS[:3]) or "*" in masked.strip("*") and _unmask(masked):
                disguised = True
                break
    addressed = any(t in low for t in _THREATS) or (
        bool(seen) and any(m[1] in seen for m in ADDRESS.finditer(low) if m[1])
    )
    fired = [bool(seen & x) for x in LISTS]
    fired += [any(w in mined.words and len(w) % 2 == k for w in seen) for k in (0, 1)]
    fired += [stems > 0, stems > 1, stems > 2]
    fired += [disguised, addressed, len(seen) > 1, len(hits) * 200 >= max(1, len(words)) and bool(hits)]
    fired.append(not any(fired))
    return sum(1 << k for k, f in enumerate(fired) if f), len(hits)


def _unmask(masked: str) -> bool:
    pattern = re.compile(masked.replace("*", "[a-z]") + r"\Z")
    return any(pattern.match(w) for x in LISTS[:3] for w in x)


def _known(mined: Mined) -> tuple[frozenset[bytes], frozenset[bytes]]:
    """All listed and mined words, and the first four bytes of the mined stems."""
    held = cache(__name__)
    if mined not in held:
        words = frozenset(w.encode() for w in mined.words.union(*LISTS))
        held[mined] = (words, frozenset(x.encode()[:4] for x in mined.stems))
    return held[mined]


def _training(labels: DataFrame, label: str, holdout: tuple[int, int] | None) -> DataFrame:
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    if holdout:
        known = known.where(bucket_of("doc_id", holdout[0]) != holdout[1])
    return known.groupBy("doc_id").agg(F.max("y").alias("y"))


def _patterns(text: str) -> list[str]:
    """What mining counts of a text: its words, and the beginnings (marked by ^) of at least two words."""
    words = words_of(text)
    starts = Counter(f"^{w[:k]}" for w in words for k in STEM_LENGTHS if len(w) > k)
    return [*set(words), *(x for x, n in starts.items() if n > 1)]


def mine(docs: DataFrame, training: DataFrame, rows: int = MINED_ROWS) -> Mined:
    """Words and word beginnings that occur in clearly more toxic training texts than their share of
    the texts explains. The training rows are a hash sample of about `rows`, a bound on the fit. Copies
    of one text would make all its words look toxic: of texts that share a minimum hash of their word
    pairs (near copies nearly always do, under one of several hashes), one counts."""
    n = training.count()
    if not n:
        return Mined()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    chosen = training.where(draw < int(min(1.0, rows / n) * (1 << 30)))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    seeds = np.random.default_rng(5).integers(0, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sketches = [f"s{k}" for k in range(SKETCHES)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = texts(b["text"])
            rows = [
                (int(y), _patterns(t), *[int(signed((h * k).min(keepdims=True))[0]) for k in seeds])
                for t, y, h in zip(values, b["y"], shingle_sets([t.encode().lower() for t in values], 2), strict=True)
                if len(h)
            ]
            if rows:
                yield pd.DataFrame(rows, columns=["y", "patterns", *sketches])

    schema = "y int, patterns array<string>" + "".join(f", {s} long" for s in sketches)
    distinct = sample.mapInPandas(run, schema)
    for s in sketches:
        distinct = distinct.dropDuplicates([s])
    distinct = stage(distinct.select("y", "patterns"), "mined")
    n, toxic = distinct.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == n:
        return Mined()
    counted = (
        distinct.select("y", F.explode("patterns").alias("w"))
        .groupBy("w")
        .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    )
    base = toxic / n
    share = F.col("t") / (F.col("t") + F.col("c"))
    evidence = 2 * (
        F.col("t") * F.log(share / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    )
    # Every one needs MINED_SUPPORT of the sampled toxic texts, so a bounded sample has boundedly many.
    few = counted.where((F.col("t") >= MINED_SUPPORT) & (share >= MINED_SHARE) & (evidence >= MINED_EVIDENCE))
    found = {r["w"] for r in few.select("w").collect()}
    stems = Mined(stems=frozenset(w[1:] for w in found if w[0] == "^"))
    # A word that begins with a mined stem alone proves less than several such words.
    return Mined(frozenset(w for w in found if w[0] != "^" and not stems.stem_of(w)), stems.stems)


@dataclass
class LabelModel:
    """Blocks of correlated voters, the class prior, and each block's joint rates by class."""

    blocks: list[list[int]]
    prior: float
    rates: list[np.ndarray]  # per block (2, 2 ** voters)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(patterns), 1))
        for block, rate in zip(self.blocks, self.rates, strict=True):
            log += np.log(rate[:, _joint(patterns, block)]).T
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)


def _joint(patterns: np.ndarray, block: list[int]) -> np.ndarray:
    return sum(((patterns >> v) & 1) << i for i, v in enumerate(block))


def _em(patterns: np.ndarray, gold: np.ndarray, n: np.ndarray, blocks: list[list[int]], start: np.ndarray) -> LabelModel:
    """Rates of the blocks by expectation-maximisation; rows with a known label keep it."""
    q = np.where(gold >= 0, gold, start)
    model = LabelModel(blocks, 0.5, [])
    for _ in range(200):
        weight = np.stack([n * (1 - q), n * q])
        prior = float(np.clip((weight[1].sum() + 1) / (n.sum() + 2), 1e-6, 1 - 1e-6))
        rates = []
        for block in blocks:
            table = np.full((2, 1 << len(block)), 0.1)
            np.add.at(table, (slice(None), _joint(patterns, block)), weight)
            rates.append(table / table.sum(axis=1, keepdims=True))
        model = LabelModel(blocks, prior, rates)
        new = np.where(gold >= 0, gold, model.posterior(patterns))
        moved, q = np.abs(new - q).max(), new
        if moved < 1e-7:
            break
    return model


def label_model(patterns: np.ndarray, gold: np.ndarray, n: np.ndarray) -> LabelModel:
    """Fit accuracies with independent voters, find pairs that stay correlated within the classes, and
    fit again with those voters in joint blocks (at most four voters each)."""
    k = len(VOTERS)
    bits = np.array([[(p >> v) & 1 for v in range(k)] for p in patterns], float)
    start = np.clip(bits[:, :-1].sum(axis=1) / 4, 0.02, 0.98)
    alone = _em(patterns, gold, n, [[v] for v in range(k)], start)
    q = np.where(gold >= 0, gold, alone.posterior(patterns))
    strength = np.zeros((k, k))
    for weight in (n * (1 - q), n * q):
        if weight.sum() < 1:
            continue
        centred = bits - (weight @ bits) / weight.sum()
        cov = (centred * weight[:, None]).T @ centred / weight.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        strength = np.maximum(strength, np.abs(cov / np.outer(sd, sd)))
    blocks = [[v] for v in range(k)]
    pairs = sorted(((strength[a, b], a, b) for a in range(k) for b in range(a)), reverse=True)
    for value, a, b in pairs:
        one, two = (next(x for x in blocks if v in x) for v in (a, b))
        if value >= CORRELATED and one is not two and len(one) + len(two) <= 4:
            blocks.remove(two)
            one.extend(two)
    return _em(patterns, gold, n, blocks, q)


def _features(patterns: np.ndarray, hits: np.ndarray) -> np.ndarray:
    bits = [(patterns >> v) & 1 for v in range(len(VOTERS))]
    return np.stack([*bits, np.log1p(hits), np.ones(len(patterns))], axis=1).astype(float)


def linear_weights(patterns: np.ndarray, hits: np.ndarray, posterior: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression on soft labels, by Newton steps."""
    x = _features(patterns, hits)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], 1.0)
    penalty[-1] = 1e-3
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (posterior - p)) - penalty * w
        hessian = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", holdout: tuple[int, int] | None = HOLDOUT) -> DataFrame:
    """(doc_id, pattern, hits, score) of every row of `docs` (doc_id, text).

    Null and empty texts get the pattern on which only the voter `none` fires. Without labelled
    rows the label model rests on the voters alone. Repeated rows are scored each."""
    bounded_batches(docs.sparkSession)
    training = stage(_training(labels, label, holdout), "training")
    mined = mine(docs, training)

    def run(values: list[str]) -> pd.DataFrame:
        return pd.DataFrame([votes(t, mined) for t in values], columns=["pattern", "hits"])

    scanned = docs.select("doc_id", per_text(run, "pattern int, hits long").alias("v"))
    voted = stage(scanned.select("doc_id", "v.*"), "votes")
    capped = F.least("hits", F.lit(MAX_HITS))
    # Every document of the corpus counts; at most 2**14 patterns, 8 hit counts and 3 label states.
    counted = (
        voted.join(training, "doc_id", "left")
        .groupBy("pattern", capped.alias("hits"), F.coalesce("y", F.lit(-1)).alias("gold"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    if not counted:
        return voted.withColumn("score", F.lit(0.0))
    p, h, g, n = (np.array([r[k] for r in counted]) for k in ("pattern", "hits", "gold", "n"))
    model = label_model(p, g, n.astype(float))
    soft = np.where(g >= 0, g, model.posterior(p))
    weights = linear_weights(p, h, soft, n.astype(float))
    return voted.withColumn("score", _score(weights, capped))


def _score(weights: np.ndarray, hits: Column) -> Column:
    total = F.lit(float(weights[-1])) + F.log1p(hits) * float(weights[-2])
    for v in range(len(VOTERS)):
        total = total + F.getbit(F.col("pattern"), F.lit(v)) * float(weights[v])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))
