"""The text operators against brute-force versions, with nulls, empty texts, ties and repeated rows."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orgpulse.llm import common, decontam, hostrules, htmlmain, langid, neardup, packing, pii, quality, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, found string, tokens string"
WORDS = "the of and river stone light house green walk seven north".split()


def rows(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(rng.choices(WORDS, k=rng.randint(1, 120)))
        out.append((i, text, "en", f"s{i % 3}"))
        if i % 5 == 0:
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            out.append((1000 + i, " ".join(words), "en", "s0"))
        if i % 7 == 0:
            out.append((2000 + i, text.upper(), "en", None))
    out += [(3000, None, None, None), (3001, "", "en", "s1"), (3002, " \n\t ", "en", "s1"), (3003, "alone", "en", "s1")]
    out += [(3003, "alone", "en", "s1"), (None, "no id here", "en", "s2"), (3004, "x" * 50_000, "en", "s2")]
    return [(*r, "clash", "clash") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, empty, spark, width):
    sets = {r[0]: shingles(r[1], width) for r in rows() if r[0] is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in neardup.near_duplicates(docs, width).collect():
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["component_id"] is None and r["kept"]
    kept = neardup.keep_one_of_each(docs, width=width)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert neardup.near_duplicates(empty).count() == 0


def test_block_comparison_finds_what_pairs_find():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**60, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 60 - k], rng.integers(0, 2**60, k, dtype=np.uint64)])) for k in range(12)]
    got = neardup.alike(sets, (80, 100))
    for a in range(12):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            assert got[a, b] == (100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared))


def test_signature_filter_misses_less_than_the_bands():
    bands = (1 - 0.8**neardup.ROWS) ** (2 * neardup.PERMUTATIONS // neardup.ROWS)
    for values, similarity in ((128, (80, 100)), (128, (95, 100)), (32, (1, 2)), (128, (1, 1)), (16, (0, 1))):
        p = (1 - similarity[0] / similarity[1]) * 15 / 16
        most = neardup.most_mismatches(values, similarity)

        def tail(m, n=values, p=p):
            return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(m + 1, n + 1))

        assert tail(most) <= 1e-8 < bands and (most == 0 or tail(most - 1) > 1e-8)


def test_clusters_over_the_limit_go_on_with_probes(docs, monkeypatch):
    whole = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    monkeypatch.setattr(neardup, "CLUSTER", 1)
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()} == whole


def test_decontamination(docs, empty, spark):
    items = [(1, " ".join(WORDS[:9])), (2, "Stone, light!"), (3, ""), (4, None), (5, "stone light"), (6, "the of and river")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def brute(text, window):
        d = word.findall((text or "").lower())
        hit, found = set(), set()
        for item, t in items:
            w = word.findall((t or "").lower())
            m = min(window, len(w))
            starts = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
            for k in range(len(d) - m + 1):
                if tuple(d[k : k + m]) in starts:
                    found.add(item)
                    hit |= set(range(k, k + m))
        return len(d), len(hit), sorted(found)

    for size in (2 << 20, 30):  # one automaton, and several
        marked = decontam.contamination(docs, bench, window=4, block_bytes=size)
        assert marked.columns[-1] == "_found"
        for r in marked.collect():
            f = r["_found"]
            assert (f["n_words"], f["n_hit"], list(f["items"])) == brute(r["text"], 4)
            assert f["contaminated"] == (f["n_hit"] > 0 and 20 * f["n_hit"] >= f["n_words"])
    clean = decontam.decontaminate(docs, bench, window=4, coverage=1)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert brute(r["text"], 4)[1] == 0 or "stone" in r["text"]  # joining the rest may form a new window
    assert decontam.contamination(docs, bench.limit(0)).where("_found.n_hit > 0").count() == 0
    assert decontam.contamination(empty, bench).count() == 0


def python_calls(df):
    return df._jdf.queryExecution().executedPlan().toString().count("EvalPython ")


def test_decontamination_cuts_in_the_pass_that_matches(docs, spark):
    """A second call would keep a second worker beside every task of the pipeline's executors."""
    bench = spark.createDataFrame([(1, "of AND; river"), (2, "light house green")], "item_id long, text string")
    clean = decontam.decontaminate(docs, bench, window=4, coverage=2)
    assert python_calls(clean) == 1
    item, word = [(b"of", b"and", b"river"), (b"light", b"house", b"green")], r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def brute(text):
        found = list(re.finditer(word, (text or "").lower()))
        words = [m.group().encode() for m in found]
        hit = {i + k for i in range(len(words)) if tuple(words[i : i + 3]) in item for k in range(3)}
        if hit and 2 * len(hit) >= len(words):
            return []
        ends = [m.start() for m in found[1:]] + [len(text or "")]
        head = (text or "")[: found[0].start()] if found else text
        return [head + "".join(text[m.start() : e] for i, (m, e) in enumerate(zip(found, ends)) if i not in hit) if found else text]

    want = Counter((r[0], t) for r in rows() for t in brute(r[1]))
    assert sum(len(t or "") for _, t in want) < sum(len(r[1] or "") for r in rows())
    for size in (2 << 20, 20):  # one automaton, and several
        clean = decontam.decontaminate(docs, bench, window=4, coverage=2, block_bytes=size)
        assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == want


def test_the_plan_of_packing_takes_no_python_workers(docs):
    path = public_tokenizers.path
    packed = packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), capacity=64)
    assert "ExistingRDD" not in packed._jdf.queryExecution().executedPlan().toString()


def test_hashing_takes_little_beside_its_result(monkeypatch):
    texts = [" ".join(random.Random(i).choices(WORDS, k=5000)).encode() for i in range(150)]
    common.shingle_sets(texts[:1], 5)  # tables that stay
    tracemalloc.start()
    found = common.shingle_sets(texts, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 3 << 20
    assert peak - sum(x.nbytes for x in found) < 16 << 20
    monkeypatch.setattr(common, "_PIECE", 1 << 10)
    assert all((a == b).all() for a, b in zip(found[:20], common.shingle_sets(texts[:20], 5), strict=True))


def test_packing_round_trip(docs, empty):
    path = public_tokenizers.path
    reference = Tokenizer.from_file(path("byte_bpe_50k.json"))
    packed = packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), capacity=64).collect()
    want = Counter()
    for r in rows():
        n = len(reference.encode(r[1] or "", add_special_tokens=False).ids) + 1
        want[r[0]] += n
    got, sequences = Counter(), defaultdict(list)
    for p in packed:
        got[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == want
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(empty, path("byte_bpe_50k.json")).count() == 0


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    counted = tokens.token_counts(docs, path)
    for r in counted.collect():
        text = r["text"] or ""
        assert r["_tokens"]["n_tokens"] == len(reference.encode(text, add_special_tokens=False).ids)
        assert r["_tokens"]["n_bytes"] == len(text.encode())
    rng = random.Random(3)
    odd = ["<|endoftext|>a<|endoftext|>", "aaaaaaaaaa", "日本語　x\u0085y", "it's I'VE", "\x1c a", "½ ٣", "👩‍👩‍👧 ok", ""]
    odd += ["".join(rng.choice("ab \n\t'sé1٣.,-日​") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    table = tokens.MergeTable(path)
    assert table.counts(odd) == [len(reference.encode(t, add_special_tokens=False).ids) for t in odd]
    encode = packing.Encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert all(encode(t).tolist() == reference.encode(t, add_special_tokens=False).ids for t in odd)
    assert tokens.token_counts(empty, path).count() == 0


def test_host_rules(docs, empty):
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)

    by_id = {r[0]: brute(r[1]) for r in rows()}
    for r in hostrules.host_rules(docs).collect():
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == by_id[r["doc_id"]]
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r["kept"] and r["base_failed"])
    assert hostrules.host_rules(empty).count() == 0


def test_hot_and_other_hosts_get_the_same_verdicts(docs, monkeypatch):
    def verdicts():
        return Counter((r["doc_id"], r["host_refused"], r["kept"]) for r in hostrules.host_rules(docs, worse=1.0, sure=0.0).collect())

    whole = verdicts()
    assert sum(whole.values()) == docs.count() and len({k[1] for k in whole}) == 2
    for share in (0, 2, 10**9):  # no host hot, some, all
        monkeypatch.setattr(hostrules, "HOT_SHARE", share)
        assert verdicts() == whole


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_personal_data(docs, empty, spark):
    rng = random.Random(2)
    parts = ["a", "@", ".", "1", "0", "25", "-", " ", "+", "(", "é", "b.c", "4111111111111111", "@x.y", "%"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(t) == base_spans(t)
    texts = [(1, 'é a.b@c.com token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 1.2.3.4'), (2, None), (3, "clean text")]
    small = spark.createDataFrame(texts, "doc_id long, text string")
    spans = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.personal_data(small).collect()}
    assert spans == {1: ["email", "ip", "secret"], 2: [], 3: []}
    cleaned = {r["doc_id"]: r["text"] for r in pii.redact(small).collect()}
    assert cleaned == {1: 'é [EMAIL] token = "[SECRET]" [IP]', 2: None, 3: "clean text"}
    assert pii.redact(docs).columns == docs.columns
    assert pii.personal_data(empty).count() == 0


def test_main_text(spark):
    html = (
        '<head><title>T</title></head><body><nav><a href="/">Home</a></nav><article><h1>A &lt;b&gt;</h1><p><b>One<br>two'
        '<p>Three\n  four.<script>var t="</p>"</script><div class="comments"><p>Nice!</p></div></article>'
        "<footer>&copy; me</footer>"
    )
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<nav>x</nav>")], "page_id long, html string")
    got = {r["page_id"]: r["main_text"] for r in htmlmain.extract(pages).collect()}
    assert got == {1: "A <b>\nOne two\nThree four.", 2: "", 3: "", 4: ""}
    assert htmlmain.extract(pages.limit(0)).count() == 0


def test_minimum_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def value(side, costs=costs, edges=edges):
            own = sum(abs(c) for c, s in zip(costs, side, strict=True) if (c > 0) != s)
            return own + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(value([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert value(htmlmain.minimum_cut(costs, edges)) == pytest.approx(best)


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = langid.fit(docs)
    names = langid.with_language(docs, model).selectExpr(
        "avg(int(found.lang_pred = lang)) a", "max(found.score) b", "min(found.score) c"
    ).first()
    assert names["a"] > 0.95 and 0 <= names["c"] <= names["b"] <= 1
    good = quality.quality(docs, labels).join(labels, "doc_id").where("crc32(string(doc_id)) % 5 = 0")
    assert good.selectExpr("avg(int((score >= 0.3) = (quality = 1)))").first()[0] > 0.9
    bad = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("crc32(string(doc_id)) % 5 = 0")
    assert bad.selectExpr("avg(int((score >= 0.5) = (toxic = 1)))").first()[0] > 0.9


def test_without_known_languages_texts_with_letters_stay(docs, empty):
    no_lang = docs.withColumn("lang", F.lit(None).cast("string"))
    in_other_folds = docs.where("crc32(string(doc_id)) % 4 = 2")
    for rows in (no_lang, in_other_folds):
        model = langid.fit(rows)
        assert not model.languages
        kept = langid.identified(rows, model)
        assert kept.columns == rows.columns
        want = Counter(r["doc_id"] for r in rows.collect() if any(c.isalpha() for c in r["text"] or ""))
        assert want and Counter(r["doc_id"] for r in kept.collect()) == want
        with pytest.raises(ValueError, match="no row to learn from"):
            langid.identified(rows, model, min_score=0.1)
    assert langid.identified(empty, langid.fit(empty)).count() == 0


def test_classifiers_on_odd_rows(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (quality.quality, toxicity.toxicity):
        scored = f(docs, labels).collect()
        assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
        assert f(empty, labels).count() == 0
    marked = langid.with_language(docs, langid.fit(docs))
    assert marked.columns[-1] == "_found"
    by_id = {r["doc_id"]: r["_found"]["lang_pred"] for r in marked.collect()}
    assert by_id[3000] == by_id[3001] == by_id[3002] == "und" and by_id[3003] == "en"
    assert {r["found"]["lang_pred"] for r in langid.with_language(docs.drop("found"), langid.fit(empty)).collect()} == {"und"}


def test_the_cut_decides_where_text_and_place_disagree(monkeypatch):
    long, short = f"<p>{'Words that an article would have. ' * 8}</p>", "<p>Buy</p>"
    odds = np.zeros(htmlmain.FEATURES + len(htmlmain.PLACES))
    odds[htmlmain.FEATURES :] = htmlmain.learn(np.zeros((len(htmlmain.PLACES), htmlmain.FEATURES)))[htmlmain.FEATURES :]
    a, b = htmlmain.blocks_of(long + short)
    odds[htmlmain.features(a)], odds[htmlmain.features(b)] = 2.5, -3
    cuts, cut = [], htmlmain.minimum_cut
    monkeypatch.setattr(htmlmain, "minimum_cut", lambda *x: cuts.append(cut(*x)) or cuts[-1])

    def kept(inner):
        del cuts[:]
        return [x != "" for x in htmlmain.main_text(f'<div class="sidebar">{inner}</div>', odds).split("\n")]

    # Paragraphs under a bad hint: none can be decided on its own, the cut finds them to be content.
    assert kept(long * 3) == [True] * 3 and cuts == [[True] * 3]
    # One ad beside them stays out; the cut still keeps the paragraphs although the ad pulls at the first.
    assert kept(short + long * 3) == [True] * 3 and cuts == [[True] * 3]
    # The same paragraph between ads goes with them.
    assert kept(short + long + short) == [False]
    # Inside a content element the same short text is kept only while its neighbours hold it.
    assert htmlmain.main_text(f"<main>{short}</main>", odds) == ""
    assert htmlmain.main_text(f"<main>{long}{short}{long}</main>", odds).count("\n") == 2


def test_text_and_place_odds_are_of_one_size():
    counts = np.zeros((len(htmlmain.PLACES), htmlmain.FEATURES))
    html = "<article>" + f"<p>{'A long sentence of the article. ' * 8}</p>" * 4 + '</article><div class="ad"><p>Buy</p></div>'
    for b in htmlmain.blocks_of(html):
        counts[b.place, htmlmain.features(b)] += 500
    odds = htmlmain.learn(counts)
    assert np.abs(odds).max() <= htmlmain.LIMIT
    places = odds[htmlmain.FEATURES :]
    assert np.abs(places).max() <= htmlmain.PLACE_LIMIT and places[htmlmain.IN_CONTENT] > 1.9 > -1.9 > places[htmlmain.BAD_HINT]
    # A hint under which the text reads like content loses its weight.
    counts[htmlmain.BAD_HINT], counts[htmlmain.IN_BOILERPLATE] = counts[htmlmain.IN_CONTENT], 10 * counts[htmlmain.BAD_HINT]
    assert htmlmain.learn(counts)[htmlmain.FEATURES + htmlmain.BAD_HINT] > -0.5


def test_content_elements_override_outer_forms_and_hints():
    def places(html):
        return [b.place for b in htmlmain.blocks_of(html)]

    assert places("<form><p>a</p><main><p>b</p></main></form>") == [htmlmain.IN_WRAPPER, htmlmain.IN_CONTENT]
    assert places('<div class="sidebar"><article>a</article></div>') == [htmlmain.IN_CONTENT]
    assert places("<nav><article>a</article></nav><article><aside>b</aside></article>") == [htmlmain.IN_BOILERPLATE] * 2


def test_raw_elements_without_an_end():
    def found(html):
        return [b.text for b in htmlmain.blocks_of(html)]

    for tag in ("<svg/>", '<svg viewBox="0 0 1 1" />', "<math />", "<select>", "<object data='x'>", "<canvas>", "<iframe>"):
        assert found(f"<p>a</p>{tag}<article>b</article>") == ["a", "b"], tag
        assert found(f"<p>a</p>{tag}<article>b</article><svg><g>x</g></svg>") == ["a", "b"], tag
    assert found("<object><article>b</article><object>x</object><p>c") == ["b", "c"]
    assert found("<svg><svg>x</svg>y<svg/></svg><p>b</p>") == ["b"]
    for tag in ("script", "style", "textarea", "template"):
        assert found(f"<p>a</p><{tag}>b") == ["a"]
