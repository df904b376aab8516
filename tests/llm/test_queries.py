"""Registered queries of the text operators on a small folder, every column against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from orgpulse.llm import hostrules, htmlmain, lzdedup, packing, queries, variants, whitening
from tests.oracle_check import compare, database

SF = "/root/testdata/sf0.001"
WORDS = "stone river garden window letter summer winter market people mountain".split()


def rows():
    """Texts with nulls, empty and long ones, ties, repeated rows and shared passages."""
    rng = random.Random(5)
    shared = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(60)]
    out = []
    for i in range(40):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "es", str(i)]) for _ in range(rng.randint(0, 150))]
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = shared[i % 3 : rng.randint(30, 60)]
        out.append((i, " ".join(words)))
    out += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (103, "one"), (None, " ".join(shared[:50])), (None, None)]
    out += [(104, "tick tock " * 60), (105, "x" * 30_000), (106, " ".join(WORDS * 700)), (107, "\n".join(shared))]
    out += [(108, "stonne stonne stonne stonne stonne " + "stone river " * 40), (109, "Éclairs éclairs Eclairs " * 6)]
    return [(a, b, "clash", "clash", 7) for a, b in out]


SCHEMA = "doc_id long, text string, at string, runs string, n int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeated(texts, window):
    """Removed word places of every text, from a count of all windows."""
    split = [words_of(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    gone = []
    for w in split:
        starts = [i for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1]
        gone.append({i + k for i in starts for k in range(window)})
    return split, gone


def digests(texts, ids, window):
    split, gone = repeated(texts, window)
    return Counter(
        (i, len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest())
        for i, w, g in zip(ids, split, gone, strict=True)
    )


def test_op11(spark, folder):
    got = Counter(tuple(r) for r in queries.op11_substrings(spark, folder).collect())
    assert got == digests([r[1] for r in rows()], [r[0] for r in rows()], 35)


@pytest.mark.parametrize("limits", [{"block_passages": 3}, {"anchor_passages": 1}, {"anchor_passages": 0, "block_passages": 1}])
def test_block_sizes_change_nothing(spark, limits):
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    texts = []
    for _ in range(50):
        a = rng.randrange(200)
        cut = base[a : a + rng.randint(5, 100)]
        if rng.random() < 0.5 and cut:
            cut[rng.randrange(len(cut))] = "other"
        texts.append(" ".join(cut + [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(20))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    split, gone = repeated(texts, 12)
    for r in lzdedup.without_repeats(docs, 12, **limits).collect():
        spans = {k for s in r["spans"] for k in range(s["first"], s["end"])}
        assert (r["n_words"], spans, r["n_removed"]) == (len(split[r["doc_id"]]), gone[r["doc_id"]], len(gone[r["doc_id"]]))
    kept = lzdedup.deduplicated(docs.withColumnRenamed("doc_id", "DOC_ID").withColumnRenamed("DOC_ID", "doc_id"), 12)
    assert kept.columns == ["doc_id", "text", "kept_text"] and kept.count() == len(texts)


def test_factors_are_longest_matches_and_crossing_windows_are_looked_up():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 3, rng.integers(6, 20)).astype(np.uint64) for _ in range(30)]
    lengths = lzdedup.factor_lengths(words, 6)
    every = [(i, s) for i, w in enumerate(words) for s in range(len(w) - 5)]
    for i, s in every:
        best = 0
        for j, t in every:
            if (i, s) != (j, t):
                same = 0
                while s + same < len(words[i]) and t + same < len(words[j]) and words[i][s + same] == words[j][t + same]:
                    same += 1
                best = max(best, same)
        assert lengths[i][s] == best
    for f in lengths:
        assert {s for a, z in lzdedup.parse(f, 6) for s in range(a, z)} == {s for s in range(len(f)) if f[s] >= 6}


def test_no_documents(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    for f in (queries.op11_substrings, queries.op12_variants, queries.op13_whitening, queries.op8_packing, queries.op10_tokens):
        assert f(spark, at).count() == 0


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_variants(table, least_length, least_count, ratio, drop_every):
    counts = Counter()
    for i, text in table:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least_length and k >= least_count}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if len(a) == len(b):
                one = sum(x != y for x, y in zip(a, b, strict=True)) == 1
            else:
                x, y = sorted((a, b), key=len)
                one = len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))
            if one:
                near[a].add(b)
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def test_op12(spark, folder):
    got = queries.op12_variants(spark, folder).collect()
    want = brute_variants([r[:2] for r in rows()], 6, 5, 5, 199)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r["form"] for r in got)


@pytest.mark.parametrize("least_length", [1, 3, 4])
def test_dense_vocabularies(spark, least_length):
    rng = random.Random(least_length)
    text = " ".join("".join(rng.choices("abcé", k=rng.randint(1, 7))) for _ in range(2500))
    table = [(1, text), (2, "a" * 3000 + " " + "a" * 2999 + " " + "a" * 3000 + "b"), (3, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = {tuple(r) for r in variants.spelling_variants(docs, least_length, 1, 2, 7).collect()}
    assert got == brute_variants(table, least_length, 1, 2, 7)


def test_op13(spark, tmp_path):
    rng = np.random.default_rng(2)
    cov = np.diag([9.0, 4, 2, 1.5, 1.4, 1.3, 1, 1, 0.5, 0.1])
    vectors = (rng.standard_normal((400, 10)) @ np.sqrt(cov) / 4).astype(np.float32)
    table = [(i, v.tolist(), "clash") for i, v in enumerate(vectors)]
    table += [(None, vectors[0].tolist(), "clash"), (5, vectors[5].tolist(), "clash"), (7, None, "clash")]
    table += [(1000 + k, [x, *vectors[1][1:].tolist()], "clash") for k, x in enumerate([None, math.nan, math.inf, -math.inf])]
    at = str(tmp_path)
    docs = spark.createDataFrame(table, "vec_id long, embedding array<float>, deviation string")
    docs.repartition(5).write.parquet(f"{at}/embeddings.parquet")
    got = queries.op13_whitening(spark, at).toPandas()
    x = np.floor(256 * vectors.astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, own = np.linalg.eigh(centred.T @ centred / n)
    values, own = values[::-1], own[:, ::-1]
    want = (x - sums / n) @ own[:, :4] / np.sqrt(values[:4])
    assert len(got) == 4 * (len(vectors) + 2) and got["n"].eq(n).all() and got["identity_error"].max() < 1e-9
    signs = {}
    for r in got.itertuples():
        i = 0 if r.vec_id != r.vec_id else int(r.vec_id)
        k = r.component - 1
        sign = signs.setdefault(k, math.copysign(1, r.whitened * want[i, k]))
        assert abs(r.whitened - sign * want[i, k]) < 1e-9
        assert r.deviation == ((n * x[i] - sums) ** 2).sum()
        assert abs(r.explained - values[k] / values.sum()) < 1e-12


def test_whitening_of_few_dimensions_and_equal_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whitened_components(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 0.0, 1.0]) for i in range(9)] + [(9, [3.0]), (10, [])], "vec_id long, embedding array<double>")
    got = whitening.whitened_components(line).toPandas()
    assert set(got["vec_id"]) == set(range(11)) and got["component"].max() == 2 and got["identity_error"].max() < 1e-9


def test_a_missed_eigenvector_is_found():
    class Diagonal:
        dimension = 40
        values = np.concatenate([[50.0, 40, 30, 20], np.linspace(1, 19, 36)])

        def times(self, q):
            return self.values[:, None] * q

    values, vectors = whitening.eigenvectors(Diagonal(), 4, guard=6)
    assert np.allclose(values, [50, 40, 30, 20]) and np.allclose(np.abs(vectors), np.eye(40)[:4], atol=1e-10)
    blind = np.eye(40)[:, 1:11]  # a block without the first eigenvector
    assert whitening._missed(Diagonal(), blind, 20.0, np.random.default_rng(0), 8) is not None


def test_op8_and_op10(spark, folder):
    files = queries.tokenizer_files()
    library = Tokenizer.from_file(files["tokenizer"])
    library.no_truncation()
    ids = {}
    for i, text, *_ in rows():
        ids.setdefault(i, []).append(library.encode(text or "", add_special_tokens=False).ids)
    want = Counter()
    for i, many in ids.items():
        for one in many:
            arr, start = np.array([*one, 0], "<u4"), 0
            lengths = packing.piece_lengths(len(arr), 2048)
            for piece, length in enumerate(lengths):
                want[i, piece, start, length, zlib.crc32(arr[start : start + length].tobytes())] += 1
                start += length
    packed = queries.op8_packing(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) == -(-sum(k[3] * v for k, v in want.items()) // 2048)
    counts = Counter(tuple(r) for r in queries.op10_tokens(spark, folder).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    expected = Counter()
    for i, text, *_ in rows():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected[i, len((text or "").encode()), n, n > 512] += 1
    assert counts == expected


def test_long_white_space_is_encoded_as_the_library_does():
    files = queries.tokenizer_files()
    encode = packing.Encoder(files["tokenizer"], files["ranks"])
    library = Tokenizer.from_file(files["tokenizer"])
    for text in ("a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "a" * 200_000):
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_salts_follow_the_count(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 5)) for i in range(300)], "doc_id long, text string")
    for salt_pieces in (1, 7, 10**6):
        packed = packing.pack(docs, queries.tokenizer_files()["tokenizer"], salt_pieces=salt_pieces).collect()
        slots = {(r["sequence_id"], r["offset"] + k) for r in packed for k in range(r["length"])}
        assert len(packed) == 300 and len(slots) == sum(r["length"] for r in packed)


def test_a_bad_host_among_clean_ones_and_a_clean_one_among_bad_ones(spark):
    good = " ".join(f"w{k}" for k in range(60))
    junk = " ".join(f"w{k} #$%&" for k in range(60)) + " ####" * 40
    many = [(h * 1000 + k, junk if h == 7 else good, f"host{h}") for h in range(60) for k in range(80 if h == 7 else 20)]
    found = hostrules.host_rules(spark.createDataFrame(many, "doc_id long, text string, source string")).toPandas()
    assert not found["base_failed"].any()
    assert set(found.loc[~found["kept"], "doc_id"]) == {7000 + k for k in range(80)}
    turned = [(h * 1000 + k, good if h == 7 else junk, f"host{h}") for h in range(60) for k in range(20)]
    found = hostrules.host_rules(spark.createDataFrame(turned, "doc_id long, text string, source string")).toPandas()
    assert found.loc[found["doc_id"] // 1000 == 7, "kept"].all()


def test_pages_without_known_tags_keep_their_text():
    nothing = htmlmain.learn(np.zeros((len(htmlmain.PLACES), htmlmain.FEATURES)))
    text = "A plain sentence that goes on for a while. " * 12
    page = f"<table><tr><td><a href=x>Home</a></td><td><a href=y>News</a></td></tr><tr><td>{text}</td></tr></table>"
    assert htmlmain.main_text(page, nothing) == text.strip()
    assert len(htmlmain.blocks_of("<div>" * 20_000 + "x" + "</section>" * 20_000)) == 1


def test_components_are_cut_apart(monkeypatch):
    sizes, cut = [], htmlmain.minimum_cut
    monkeypatch.setattr(htmlmain, "minimum_cut", lambda c, e: sizes.append(len(c)) or cut(c, e))
    blocks = [htmlmain.Block("word", 0.0, htmlmain.NEITHER, k, "div") for k in range(400)]
    for k in range(0, 400, 20):
        blocks[k] = htmlmain.Block("A long sentence. " * 30, 0.0, htmlmain.IN_CONTENT, k, "p")
    odds = np.zeros(htmlmain.FEATURES + len(htmlmain.PLACES))
    odds[htmlmain.features(blocks[0])] = 3.0
    odds[htmlmain.features(blocks[1])] = -0.1
    htmlmain.label(blocks, odds)
    assert not sizes or max(sizes) < 20


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert compare(got, database(SF).sql(queries.ORACLES[name]).df()) is None
