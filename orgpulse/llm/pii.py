"""Personal data by aggregated weak labelers.

Regular expressions find base spans (e-mail, ip, card, phone) and looser candidates (secrets, phones in
national form, spelled-out e-mail addresses). Format, gazetteer, context, border and placeholder
labelers vote on every candidate. Expectation-maximisation over the counts of vote patterns of the whole
corpus estimates how reliable each labeler is; a logistic span classifier is trained on the posterior
and decides on the candidates. Base spans always stay; the classifier adds others.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.common import bounded_batches, per_text
from orgpulse.staging import stage

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "local_phone", "spelled_email")
KINDS = BASE + ADDED
THRESHOLD = 0.5
LABELERS = ("format", "gazetteer", "context", "border", "placeholder")
NEAR = 24  # characters before a span that context labelers read

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,64}[0-9])[A-Za-z0-9_+/-]{20,}={0,2}(?![A-Za-z0-9_+/-])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,64})+"
)

# Words that stand before personal data, by kind.
CUES = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "fon", "llam"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential"),
    "local_phone": ("tel", "phone", "call", "fax", "mobile", "fon", "llam"),
    "spelled_email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
}
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk it nl eu info biz co us ca ch at be".split())
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "xoxb", "xoxp", "AIza", "eyJ", "glpat")
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "36", "35", "22")
PLACEHOLDERS = ("xxxx", "0000000", "1234567", "abcdefg", "example_", "changeme", "127.0.0.1", "0.0.0.0")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if place % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ with a local part before it and a domain after it; linear in the text, however long the
    run of letters before an @ is."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        else:
            done = max(done, begin)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind as listed and start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, votes): base spans and looser candidates that do not touch them. Votes hold a
    digit per labeler: 0 abstains, 1 says no, 2 says yes."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    loose: list[tuple[str, int, int]] = []
    if _DIGIT.search(text):
        loose += [("secret", m.start(), m.end()) for m in _SECRET.finditer(text) if re.search("[A-Za-z]", m[0])]
        loose += [("local_phone", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    if "at" in text and ("(dot)" in text or "[dot]" in text):
        loose += [("spelled_email", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    # A looser span overlaps a base span if, of those that start before its end, one ends behind its start.
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    before = [(x, bisect_left(starts, x[2])) for x in loose]
    free = [x for x, at in before if not at or reach[at - 1] <= x[1]]
    return [(k, a, b, vote(text, k, a, b)) for k, a, b in [*base, *free]]


def vote(text: str, kind: str, start: int, end: int) -> int:
    span = text[start:end]
    low = span.lower()
    digits = re.sub(r"[^0-9]", "", span)
    before = text[max(0, start - NEAR) : start].lower()
    if kind == "secret":
        mixed = len(digits) >= 4 and len(set(span)) >= 10
        shape = 2 if mixed and ("_" not in span or span.startswith(KEY_STARTS)) else 1
        listed = 2 if span.startswith(KEY_STARTS) or re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", span) else 0
    elif kind in ("email", "spelled_email"):
        shape = 2 if not low.startswith((".", "-")) and ".." not in low else 1
        listed = 2 if re.split(r"[.\]) ]+", low.rstrip(")]"))[-1] in TOP_DOMAINS else 0
    elif kind == "card":
        shape, listed = (2 if luhn(digits) else 1), (2 if digits.startswith(CARD_STARTS) else 0)
    elif kind == "ip":
        shape, listed = 2, (0 if low.startswith(("0.", "255.")) else 2)
    else:
        shape = 2 if 9 <= len(digits) <= 15 else 1
        listed = 2 if kind == "phone" or digits[:1] not in "01" else 0
    cue = 2 if any(c in before for c in CUES[kind]) else 0
    outer = text[start - 1 : start] + text[end : end + 1]
    border = 1 if any(c.isalnum() for c in outer) else 2
    fake = 1 if any(p in low for p in PLACEHOLDERS) or digits and len(set(digits)) == 1 else 0
    code = 0
    for v in (shape, listed, cue, border, fake):
        code = code * 3 + v
    return code


def _digits(code: np.ndarray) -> np.ndarray:
    """Votes (patterns, labelers) of vote codes."""
    return np.stack([code // 3 ** (len(LABELERS) - 1 - k) % 3 for k in range(len(LABELERS))], axis=1)


@dataclass
class SpanModel:
    """Reliability of each labeler by kind, and the weights of the span classifier."""

    reliability: np.ndarray  # (kinds, labelers, class, vote)
    weights: np.ndarray

    def accept(self, kind: str, code: int) -> bool:
        return kind in BASE or self.probability(np.array([KINDS.index(kind)]), np.array([code]))[0] >= THRESHOLD

    def probability(self, kinds: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_span_features(kinds, codes) @ self.weights, -30, 30)))


def _span_features(kinds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    votes = _digits(codes)
    yes, no = (votes == 2).astype(float), (votes == 1).astype(float)
    return np.hstack([np.eye(len(KINDS))[kinds], yes, no])


def fit_counts(kinds: np.ndarray, codes: np.ndarray, n: np.ndarray) -> SpanModel:
    """Expectation-maximisation on counted vote patterns, then logistic regression on the posterior.
    Prior beliefs: a labeler that votes is right in 7 of 10 cases, for every kind, worth ten spans."""
    votes = _digits(codes)
    right = np.array([[0.5, 0.35, 0.15], [0.4, 0.1, 0.5]])  # (class, vote)
    table = np.tile(right, (len(KINDS), len(LABELERS), 1, 1))
    prior = np.full(len(KINDS), 0.6)
    is_base = kinds < len(BASE)
    q = np.full(len(n), 0.5)
    for _ in range(200):
        log = np.stack([np.log(1 - prior[kinds]), np.log(prior[kinds])], axis=1)
        for k in range(len(LABELERS)):
            log += np.log(table[kinds, k, :, votes[:, k]])
        new = np.where(is_base, 1.0, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50))))
        moved, q = np.abs(new - q).max(initial=0), new
        table = np.tile(right * 10, (len(KINDS), len(LABELERS), 1, 1))
        for k in range(len(LABELERS)):
            np.add.at(table, (kinds, k, 0, votes[:, k]), n * (1 - q))
            np.add.at(table, (kinds, k, 1, votes[:, k]), n * q)
        table /= table.sum(axis=3, keepdims=True)
        total = np.bincount(kinds, n, len(KINDS)) + 10
        prior = np.clip((np.bincount(kinds, n * q, len(KINDS)) + 6) / total, 0.01, 0.99)
        if moved < 1e-7:
            break
    x = _span_features(kinds, codes)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        step = np.clip(np.linalg.solve(hessian, x.T @ (n * (q - p)) - 0.1 * w), -2, 2)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return SpanModel(table, w)


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array of (kind number, start, end, votes)) of every row; null texts have none."""
    bounded_batches(docs.sparkSession)
    number = {k: i for i, k in enumerate(KINDS)}

    def run(values: list[str]) -> pd.Series:
        spans = [[{"k": number[k], "a": s, "b": e, "v": v} for k, s, e, v in candidates(t)] for t in values]
        return pd.Series(spans, dtype=object)

    return docs.select("doc_id", per_text(run, "array<struct<k:int,a:int,b:int,v:int>>").alias("spans"))


def fit(found: DataFrame) -> SpanModel:
    """Learn from the spans of all rows. The driver gets one count per kind and vote pattern, at most
    7 * 3**5 numbers."""
    one = found.select(F.explode("spans").alias("s")).select("s.k", "s.v")
    rows = one.groupBy("k", "v").agg(F.count("*").alias("n")).collect()
    k, v, n = (np.array([r[c] for r in rows], int) for c in ("k", "v", "n"))
    return fit_counts(k, v, n.astype(float))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array of (kind, start, end)) of every row of `docs` (doc_id, text), by kind as in
    KINDS, then start. Null and empty texts have none; repeated rows are searched each."""
    found = stage(found_spans(docs), "spans")
    model = fit(found)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def accepted(spans: pd.Series) -> pd.Series:
        known: dict[tuple[int, int], bool] = {}
        out = []
        for row in spans:
            good = []
            for s in row:
                key = (s["k"], s["v"])
                if key not in known:
                    known[key] = model.accept(KINDS[s["k"]], s["v"])
                if known[key]:
                    good.append((s["k"], s["a"], s["b"]))
            out.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(good)])
        return pd.Series(out, dtype=object)

    return found.select("doc_id", accepted("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every accepted span of `text` replaced by its kind in brackets; all rows and columns
    stay, texts without spans as they are. Overlapping spans become one, named after the first."""
    bounded_batches(docs.sparkSession)
    model = fit(found_spans(docs))

    @F.pandas_udf("string")
    def cover(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            spans = sorted((a, b, k) for k, a, b, v in candidates(t) if model.accept(k, v)) if t else []
            parts, at = [], 0
            for a, b, kind in spans:
                if a >= at:
                    parts += [t[at:a], f"[{kind.upper()}]"]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]) if spans else t)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", cover("text"))
