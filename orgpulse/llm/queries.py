"""The registered queries of the operators, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.llm import (
    decontam,
    hostrules,
    htmlmain,
    langid,
    lzdedup,
    neardup,
    packing,
    pii,
    quality,
    tokens,
    toxicity,
    variants,
    whitening,
)
from orgpulse.llm.common import bucket_of, table


def _held_out(modulus: int, rest: int) -> Column:
    return (bucket_of("doc_id", modulus) == rest).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def many(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))
    return pii.personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[many(k) for k in pii.BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op5_hostrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.host_rules(table(spark, sf_dir, "documents")).drop("host_refused")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform(F.col("found.items"), lambda x: x.cast("string")))
    return marked.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        "found.contaminated",
    )


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = langid.with_language(docs.select("doc_id", "text"), langid.fit(docs))
    return marked.select("doc_id", _held_out(4, 2), "found.lang_pred", "found.score")


def tokenizer_files() -> dict[str, str]:
    return {
        "tokenizer": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
    }


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer_files())


def op9_htmlmain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmlmain.extract(table(spark, sf_dir, "pages"))
    return found.select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, tokenizer_files()["tokenizer"]).select("doc_id", "tokens.*")


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lzdedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_toxicity,
        op3_neardup,
        op4_pii,
        op5_hostrules,
        op6_decontam,
        op7_langid,
        op8_packing,
        op9_htmlmain,
        op10_tokens,
        op11_substrings,
        op12_variants,
        op13_whitening,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_neardup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM d),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, t.component_id, t.doc_id = t.component_id AS kept
FROM (SELECT id AS doc_id, MIN(root) AS component_id FROM r GROUP BY id) t LEFT JOIN n ON n.doc_id = t.doc_id
""",
    "op5_hostrules": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
often AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING COUNT(*) > 1),
rep AS (
  SELECT doc_id, COUNT(DISTINCT i + k) AS n
  FROM win JOIN often USING (doc_id, s), (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM d) d
  LEFT JOIN rep ON rep.doc_id = d.doc_id),
f AS (
  SELECT *, CAST(n_words < {hostrules.MIN_WORDS} AS INT) AS r1,
    CAST(n_repeat_words * 100 > n_words * {hostrules.REPEATED_PERCENT} AS INT) AS r2,
    CAST(n_symbols * 100 > word_chars * {hostrules.SYMBOL_PERCENT} AS INT) AS r3,
    CAST(n_dup_lines * 100 > n_lines * {hostrules.DUPLICATE_LINE_PERCENT} AS INT) AS r4 FROM m),
host AS (
  SELECT source, k, COUNT(*) AS n, SUM(v) AS bad
  FROM (SELECT source, unnest([1, 2, 3, 4]) AS k, unnest([r1, r2, r3, r4]) AS v FROM f) GROUP BY source, k),
prior AS (
  SELECT k, COUNT(*) AS hosts, least(greatest(AVG(bad / n), 1e-4), 1 - 1e-4) AS mean,
    greatest(var_pop(bad / n) - AVG(bad / n * (1 - bad / n) / n), 1e-6) AS beyond FROM host GROUP BY k),
beta AS (
  SELECT k, CASE WHEN hosts < {hostrules.MIN_HOSTS} THEN 0.5 ELSE mean END AS mean,
    CASE WHEN hosts < {hostrules.MIN_HOSTS} THEN 2.0
      ELSE least(greatest(mean * (1 - mean) / beyond - 1, 2.0), {hostrules.MOST_STRENGTH}) END AS strength FROM prior),
posterior AS (
  SELECT source, (bad + mean * strength) / (n + strength) AS rate, n + strength + 1 AS weight,
    least(greatest({hostrules.WORSE} * mean, {hostrules.LIMITS[0]}), {hostrules.LIMITS[1]}) AS limit_
  FROM host JOIN beta USING (k)),
verdict AS (
  SELECT source, bool_or(rate - {hostrules.SURE} * sqrt(rate * (1 - rate) / weight) > limit_) AS refused
  FROM posterior GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 + r2 > 0 AS base_failed,
  r1 + r2 = 0 AND NOT refused AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
""",
    "op6_decontam": rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(len(w), {decontam.WINDOW}) AS m FROM (
    SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark) WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b))),
hit AS (SELECT doc_id, item_id, i, dw.m FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s),
words AS (
  SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, COUNT(*) AS n, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AND {decontam.COVERAGE} * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
""",
    "op11_substrings": rf"""
WITH d AS (
  SELECT ROW_NUMBER() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i : i + {lzdedup.WINDOW - 1}], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - {lzdedup.WINDOW - 2})) AS i FROM d)),
often AS (SELECT s FROM win GROUP BY s HAVING COUNT(*) > 1),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + {lzdedup.WINDOW})) AS p FROM win WHERE s IN (SELECT s FROM often)),
per_row AS (SELECT r, list(p) AS ps, COUNT(*) AS n FROM gone GROUP BY r),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM (
    SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = x.r AND gone.p = x.p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(per_row.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN per_row ON per_row.r = d.r LEFT JOIN kept ON kept.r = d.r
""",
    "op12_variants": rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab),
runs AS (
  SELECT id, run, COUNT(*) AS k FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
      unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]{{{variants.LEAST_LENGTH},}}')) AS run FROM documents)
  GROUP BY id, run),
bytes AS (
  SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END)) AS b
  FROM runs),
hashed AS (
  SELECT run, k, xor(list_reduce(b, lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1]), 4294967295), 4294967295) AS h
  FROM bytes, crc),
cut AS (
  SELECT k, CASE WHEN h % {variants.DROP_EVERY} = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
w AS (
  SELECT word, CAST(SUM(k) AS BIGINT) AS n FROM cut WHERE length(word) >= {variants.LEAST_LENGTH}
  GROUP BY word HAVING SUM(k) >= {variants.LEAST_COUNT}),
gap AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
shorter AS (SELECT DISTINCT gap.word AS a, w.word AS b FROM gap JOIN w ON gap.rest = w.word),
near AS (
  SELECT a, b FROM shorter UNION SELECT b, a FROM shorter
  UNION SELECT x.word, y.word FROM gap x JOIN gap y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
best AS (
  SELECT a AS word, COUNT(*) AS n_near, MAX(w.n) AS top, arg_min(b, struct_pack(n := -w.n, b := b)) AS b
  FROM near JOIN w ON w.word = b GROUP BY a),
form AS (SELECT w.word, best.b AS form, best.top AS form_n FROM w JOIN best USING (word) WHERE best.top >= {variants.RATIO} * w.n),
chain(word, root, depth) AS (
  SELECT word, word, 0 FROM w UNION ALL SELECT chain.word, form.form, depth + 1 FROM chain JOIN form ON form.word = chain.root),
ends AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word)
SELECT w.word, form.form, ends.root, w.n, CAST(coalesce(best.n_near, 0) AS BIGINT) AS n_near, form.form_n
FROM w JOIN ends USING (word) LEFT JOIN best ON best.word = w.word LEFT JOIN form ON form.word = w.word
""",
}
