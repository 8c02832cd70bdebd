"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, and brute-force versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonoglyph.llm import compact_windows as W, graph, itq, jaccard_join as J, kneser_ney as K, license_scan as L, line_dedup as D, packing as P, quality_rules as Q, text as T, token_counts as C, unigram as U
from sonoglyph.llm.tokens import WordEncoder, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "é" * 3), (6, "a b\nc d\nA b"), (7, "word " * 30_000), (8, "a b\nc d\nA b"), (8, "a b\nc d\nA b")]


def text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 1, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


# -- 1 -------------------------------------------------------------------------------------------------------------


def base(t):
    t = t or ""
    words = WORD.findall(t)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_quality_rules(spark, docs, labels):
    rng = random.Random(1)
    rows = ODD + [(20 + i, text(rng, rng.randrange(120), 12) + "\n" * (i % 3) + "x # y\nx # y") for i in range(30)]
    got = Q.quality_rules(docs(rows), labels).collect()
    assert sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == sorted((i, *base(t)) for i, t in rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert Q.quality_rules(docs([]), labels).count() == 0
    alone = Q.quality_rules(docs(rows), labels.where("false")).where("kept = base_failed").count()
    assert alone == 0


def test_ratio_by_hand(spark, docs, labels):
    rows = [(4, "the cat sat. the dog"), (6, "the cat sat"), (7, "### ### zz")]
    got = {r["doc_id"]: r for r in Q.quality_rules(docs(rows), labels).collect()}
    token = re.compile(r"[\w\x80-\U0010ffff]+|[^\w\s]+")

    def grams(t):
        w = token.findall(t)
        return w + list(zip(w, w[1:], strict=False))

    raw, target = Counter(g for _, t in rows for g in grams(t)), Counter(g for i, t in rows if i in (4, 6) for g in grams(t))
    n = 1 << Q.BITS
    a, b = sum(target.values()) + n, sum(raw.values()) + n
    for i, t in rows:
        want = sum(math.log((target[g] + 1) / a) - math.log((raw[g] + 1) / b) for g in grams(t)) / (len(grams(t)) + Q.PRIOR_GRAMS)
        assert got[i]["score"] == pytest.approx(want)


# -- 2 -------------------------------------------------------------------------------------------------------------


def test_windows_are_the_trees():
    rng = np.random.default_rng(1)

    def tree(h, s, e, w):
        if e - s < w:
            return []
        c = s + int(np.argmin(h[s:e]))
        return [*tree(h, s, c, w), (s, c, e - 1), *tree(h, c + 1, e, w)]

    for _ in range(200):
        bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 60, rng.integers(1, 6)))])
        h, w = rng.integers(0, 40, bounds[-1]).astype(np.uint64) << np.uint64(40), int(rng.integers(1, 12))
        got = list(zip(*(x.tolist() for x in W.windows(h, bounds, w)), strict=True))
        assert got == [x for a, b in zip(bounds, bounds[1:], strict=False) for x in tree(h, a, b, w)]


def test_passages_found_and_removed(spark, docs):
    rng = random.Random(2)
    shared, other = text(rng, 70, 10**6), text(rng, 60, 10**6)
    near = shared.split()
    near[35] = "changed"
    rows = [(i, text(rng, 200, 10**6)) for i in range(10, 40)]
    rows += [(50, text(rng, 80, 10**6) + " " + shared + " " + text(rng, 90, 10**6)), (51, text(rng, 30, 10**6) + " " + shared), (52, " ".join(near) + " " + text(rng, 40, 10**6)), (53, other + "\n" + text(rng, 9, 10**6)), (54, text(rng, 5, 10**6) + " " + other)]
    made = docs([*ODD[:6], *rows])
    found = W.find_passages(made).collect()
    assert {r["doc_id"] for r in found} == {51, 52, 54} and {r["source_doc_id"] for r in found if r["doc_id"] == 51} == {50}
    spans = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in found}
    assert spans[51] == (30, 100) and spans[54] == (5, 65) and spans[52] == (0, 70)
    left = {r["doc_id"]: r["text"] for r in W.remove_passages(made, W.find_passages(made)).collect()}
    assert left[50] == dict(rows)[50] and left[51].split() == dict(rows)[51].split()[:30] and left[1] is None and left[54].split() == dict(rows)[54].split()[:5]
    assert W.find_passages(docs([])).count() == 0


# -- 3 -------------------------------------------------------------------------------------------------------------


def best_path(model, pieces, t):
    t = "▁" + t.replace(" ", "▁")
    best = [(0.0, 0, [])] + [None] * len(t)
    for e in range(1, len(t) + 1):
        for s in range(max(0, e - 16), e):
            i = pieces.get(t[s:e])
            cost = float(model.score[i]) if i is not None else float(model.score.min()) - U.UNKNOWN_PENALTY
            if (i is not None or e - s == 1) and (best[e] is None or best[s][0] + cost > best[e][0]):
                best[e] = (best[s][0] + cost, s, [i] if i is not None else [int(model.byte_ids[b]) for b in t[s:e].encode()])
    out, e = [], len(t)
    while e:
        out = best[e][2] + out
        e = best[e][1]
    return out


def test_unigram(spark, docs):
    import sentencepiece

    m = U.load_model(vocabulary(U.MODEL))
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(U.MODEL))
    pieces = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    texts = ["", "a", " ", "  two  spaces ", "日本語 é\U0001f642\n\nfoo", "\x00\t", "\U0001f642\U0001f642 \U0001f642a", "The and attion to thanedble the, anea."]
    got = {r["doc_id"]: r for r in U.encode(docs([*enumerate(texts), (99, None)]), model=m).collect()}
    for i, t in enumerate(texts):
        assert got[i]["decoded"] == t and got[i]["ids"] == (best_path(m, pieces, t) if t else [])
    assert got[99]["ids"] == [] and got[4]["n_byte_pieces"] > 0
    assert U.encode(docs([]), model=m).count() == 0


def test_trie():
    words = {bytes(w, "ascii"): i for i, w in enumerate(["a", "ab", "abc", "b", "bcd", "zz"])}
    t = U.build_trie(words)

    def find(w):
        s = 0
        for c in w:
            n = t.base[s] + c
            if t.base[s] <= 0 or n >= len(t.check) or t.check[n] != s:
                return -1
            s = n
        return t.value[s]

    assert {w: find(w) for w in words} == words and find(b"bc") == -1 and find(b"q") == -1 and find(b"abcd") == -1


# -- 4 -------------------------------------------------------------------------------------------------------------


def test_licenses(spark, docs):
    mit = L.TEMPLATES[3][1]
    rows = [*ODD[:6], (20, "text\nReleased under the mit license\nmore"), (21, mit), (22, mit.replace("copies", "duplicates", 1)), (23, "Released under"), (24, "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.")]
    got = sorted((r["doc_id"], r["line"], r["license"]) for r in L.license_scan(docs(rows)).collect() if r["doc_id"] != 24)
    assert got == [(20, 2, "MIT"), (21, 1, "MIT"), (22, 1, "MIT")]
    assert L.license_scan(docs(rows)).where("doc_id = 24 and license = 'CC-BY-4.0' and line > 0").count() == 2
    assert L.license_scan(docs([])).count() == 0 and L.license_scan(docs(rows), templates=[("x", "one")]).count() == 0
    # wrapped over lines inside a source file, with comment marks, and a full text between others
    body = dict(enumerate(t for _, t in L.TEMPLATES))
    apache, full = body[1].split(), body[14].split()
    wrap = lambda w, n, mark: [mark + " ".join(w[i : i + n]) for i in range(0, len(w), n)]
    source = ["import x", "", *wrap(apache, 9, "# "), "", "def f(): pass", *["y = 1"] * 30]
    document = ["Copyright (c) 2020 someone", "", *wrap(full, 12, "")[:6], "", *wrap(full, 12, "")[6:], "", "Other text follows here."]
    found = {(r["doc_id"], r["line"], r["n_lines"], r["license"], r["template"]): r["dice"] for r in L.license_scan(docs([(1, "\n".join(source)), (2, "\n".join(document)), (3, "\n".join(source[4:]) * 2)])).collect()}
    assert found[1, 3, len(wrap(apache, 9, "")), "Apache-2.0", 1] == 1.0 and max(d for (i, *_, t), d in found.items() if (i, t) == (2, 14)) > 0.95
    assert L.license_scan(docs([(1, "word " * 100_000 + "\n" + "\n" * 5_000)])).count() == 0


# -- 5 -------------------------------------------------------------------------------------------------------------


def links(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, docs, size, percent):
    rng = random.Random(size)
    rows = [*ODD[:8], (9, "One"), (10, "one")]
    for family in range(6):
        first = text(rng, rng.randrange(12, 90), 50).split()
        for k in range(12):
            w = list(first)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            rows.append((100 + 20 * family + k, " ".join(w[: len(w) - rng.randrange(3)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_join(docs(rows), size=size, percent=percent).collect()}
    assert got == links(rows, size, percent)


def test_jaccard_edges(spark, docs):
    assert J.jaccard_join(docs([])).count() == 0
    kept = J.keep_first(docs([*ODD, (30, "x y z a b c"), (31, "X y z a b c")]), size=5, percent=80)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7, 30] and "_id" in kept.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(5, 5), (3, 9), (9, 3), (9, 7), (100, 99)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(20, 61), 20), 3: 3, 9: 3, 7: 3, 99: 99, 100: 99}


# -- 6 and 7 -------------------------------------------------------------------------------------------------------


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows = [*ODD, *((100 + i, text(rng, rng.randrange(1, 400))) for i in range(60))]
    t = Tokenizer.from_file(vocabulary(P.VOCABULARY))
    want = Counter()
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 512):
            want[(i, at // 512, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes()))] += 1
    got = P.placements(docs(rows), capacity=512).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    least = -(-sum(r["length"] for r in got) // 512)
    assert max(bins.values()) <= 512 and len(bins) <= least + 2
    assert P.placements(docs([])).count() == 0


def test_grouping_genetics():
    rng = random.Random(1)
    length = [rng.randrange(1, 400) for _ in range(300)]
    a, b = (P.best_fit(rng.sample(range(300), 300), length, [], 512) for _ in range(2))
    child = P.crossover(a, b, length, 512, rng)
    assert sorted(p for _, ps in child for p in ps) == list(range(300))
    assert all(free == 512 - sum(length[p] for p in ps) >= 0 for free, ps in child)
    best = P.evolve(length, [], 512, 1, 4, 20)
    assert len(best) <= min(len(a), len(b)) and len(best) <= -(-sum(length) // 512) + 2


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(C.VOCABULARY))
    rows = [*ODD, (2**62 + 5, "it's 3.5% <|endoftext|> café"), (-7, "x")]
    path = str(tmp_path / "tokens")
    C.write_token_files(docs([*rows, (None, "left out")]), path)
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    for block in (7, 64, 1 << 18):
        files = C.scan_token_files(spark, path, block=block)
        assert Counter(map(tuple, files.collect())) == want
    empty = str(tmp_path / "none")
    C.write_token_files(docs([]), empty)
    assert C.scan_token_files(spark, empty).count() == 0


def test_word_encoder():
    texts = ["It's O'Neil's 3rd café!! a.b, x's.", "İstanbul ΣΣ. é 中文　字 \x1cq", "'s .'s --'s...'s", "<|endoftext|> x<|endoftext|>.", "", None, "a×b ÷ É. ÀB!! x.\ny", "a’. b’s", "#tag a#b |"]
    e = WordEncoder(vocabulary(P.VOCABULARY))
    (s,) = T.slices(pa.array(texts))
    ids, bounds = e.encode(s)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


# -- 8 -------------------------------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    for i in range(0, 120, 4):
        for k in range(1, 4):
            x[i + k] = x[i] + rng.normal(scale=0.06 * k, size=16)
    x[200] = 2 * x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None, *[1.0] * 15]), (904, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component_id", F.lit(1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(300, dtype=bool)
    for block in (4, 512):
        got = {r["vec_id"]: r for r in itq.near_vectors(df, block=block).collect()}
        found = sum(r["n_links"] for r in got.values())
        assert 0.9 * near.sum() <= found <= near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(300))
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 905)) and got[200]["component_id"] == 0
    assert itq.near_vectors(df.where("false")).count() == 0


# -- 9 -------------------------------------------------------------------------------------------------------------


def kneser_ney_by_hand(train, t):
    """log-probability of a text, by the definition."""
    units = lambda x: np.frombuffer(x.encode("utf-16-le"), "<u2").tolist()
    code = lambda x: [K.EDGE] * 3 + units(x) + [K.EDGE]
    counts = {4: Counter()}
    for x in train:
        c = code(x)
        counts[4].update(tuple(c[i : i + 4]) for i in range(len(c) - 3))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discounts(c):
        n = [0, *(sum(v == i for v in c.values()) for i in (1, 2, 3, 4))]
        if not n[1]:
            return [0.5] * 3
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(i - (i + 1) * y * n[i + 1] / n[i], K.LEAST_DISCOUNT), i) if n[i] else i / 2 for i in (1, 2, 3)]

    d = {n: discounts(c) for n, c in counts.items()}

    def p(g):
        n = len(g)
        if not n:
            return 1 / K.SYMBOLS
        own = {h: v for h, v in counts[n].items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        left = sum(d[n][min(v, 3) - 1] for v in own.values()) / total
        v = counts[n].get(g, 0)
        return (max(v - d[n][min(v, 3) - 1], 0) / total if v else 0) + left * p(g[1:])

    c = code(t)
    return sum(math.log(p(tuple(c[i : i + 4]))) for i in range(len(c) - 3)), len(units(t))


def test_kneser_ney(spark, docs):
    rng = random.Random(9)
    words = {"en": ["the", "cat", "sat", "on", "mat", "\u00e9"], "zh": ["\u6570\u636e", "\u8bed\u8a00", "\u5927\u89c4\u6a21", "\u6a21\u578b", "\U00020000", "\u3002"]}
    schema = "doc_id long, text string, lang string, chunk string, c int"
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 30))), lang, "x", 1) for lang, start in (("en", 0), ("zh", 300)) for i in range(start, start + 80)]
    rows += [(200, "### $$$ QQQQ zzz", "en", "x", 1), (201, None, "en", "x", 1), (202, "", None, "x", 1), (203, "the cat sat", None, "x", 1), (380, "\u9f98\u9750\u9f49\u7228\u7c72\u9ea4", "zh", "x", 1), (None, "the cat sat on", "en", "x", 1), (0, rows[0][1], "en", "x", 1)]
    made = spark.createDataFrame(rows, schema).repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(60), *range(300, 360)]], "doc_id long, quality int, toxic int")
    texts = {i: t for i, t, *_ in rows}
    fits = {r[0] for r in labels.where(F.pmod(F.xxhash64(F.lit("fits"), "doc_id"), F.lit(2)) == 0).select("doc_id").collect()}
    train = [texts[k] for k in fits] + ([texts[0]] if 0 in fits else [])
    for chunk in (200, K.CHUNK):
        found = K.kneser_ney(made, labels, least_held_out=5, chunk=chunk).collect()
        got = {r["doc_id"]: r for r in found}
        assert len(found) == len(rows)
        for i in (0, 5, 61, 70, 200, 301, 340, 375, 380):
            log_p, n = kneser_ney_by_hand(train, texts[i])
            assert got[i]["perplexity"] == pytest.approx(math.exp(-log_p / (n + 1)), rel=1e-6) and got[i]["n_symbols"] == n
        assert not any(got[i]["kept"] for i in (200, 201, 202, 380)) and got[None]["kept"] and got[203]["kept"]
        assert sum(got[i]["kept"] for i in [*range(80), *range(300, 380)]) >= 140
        held = {lang: sorted(got[i]["perplexity"] for i in [*range(start, start + 60)] if i not in fits) for lang, start in (("en", 0), ("zh", 300))}
        for lang, i in (("en", 5), ("zh", 301)):  # a threshold of its own for each language, near the largest held-out one
            assert held[lang][-2] * 0.999 <= got[i]["threshold"] <= held[lang][-1] * 1.001
    assert K.kneser_ney(docs([]), labels).count() == 0
    assert K.kneser_ney(made, labels.where("false")).where("kept").count() == len(rows) - 2


# -- 10 ------------------------------------------------------------------------------------------------------------


def test_lines(spark, docs):
    rng = random.Random(10)
    rows = [(i, "\n".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12)))) for i in range(10, 40)]
    rows += [(50, "p\nq\nr\ns\nt\nu"), (51, "x\np\nq\nr\ns\nt\ny"), (52, None), (53, ""), (54, "p\nq")]
    seen, gone = set(), {}
    for i, t in rows:
        w = t.split("\n") if t is not None else []
        for k in range(len(w) - 1):
            if (w[k], w[k + 1]) in seen:
                gone.setdefault(i, set()).update((k, k + 1))
            seen.add((w[k], w[k + 1]))
    got = {r["doc_id"]: r for r in D.line_dedup(docs(rows)).collect()}
    for i, t in rows:
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))
        assert (got[i]["text"], got[i]["n_deleted"]) == (want, len(gone.get(i, ())))
    # each later suffix has its longest run that an earlier place has too; the first copy is the earliest of those
    place = {(i, k): t.split("\n")[k:] for i, t in rows if t for k in range(len(t.split("\n")))}

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    best, longest = {}, Counter()
    for p, x in place.items():
        for q, y in place.items():
            n = common(x, y) if p != q else 0
            if n >= 2:
                longest[p[0]] = max(longest[p[0]], n)
                if q < p and (n, (-q[0], -q[1])) > best.get(p, (0, ())):
                    best[p] = (n, (-q[0], -q[1]))
    found = D.intervals(D.line_ids(docs(rows)))
    runs = {(r["doc_id"], r["at"]): (r["lines"], (-r["first_doc_id"], -r["first_at"])) for r in found.where(D._LATE).collect()}
    assert runs == best and all(got[i]["longest"] == longest[i] for i, _ in rows)
    whole = {(r["doc_id"], r["at"], r["lines"]) for r in D.maximal_runs(found).collect()}
    assert whole == {(*p, n) for p, (n, _) in best.items() if best.get((p[0], p[1] - 1), (0,))[0] != n + 1} and (51, 1, 5) in whole
    assert D.line_dedup(docs([])).count() == 0
    assert D.line_dedup(docs(ODD)).count() == len(ODD)
    ranks = D.suffix_ranks(D.line_ids(docs(rows)))[2].groupBy("rank").agg(F.count("*").alias("n")).orderBy("rank").collect()
    assert all(a["rank"] + a["n"] == b["rank"] for a, b in zip(ranks, ranks[1:], strict=False))


# -- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = before.columns, before.count()
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.cut(stage(spark, before, sf), "test")
        if name != "best_fit_packing":
            assert after.columns == columns and after.count() <= n
            n, before = after.count(), after
    assert n >= 100
    t = Tokenizer.from_file(vocabulary(P.VOCABULARY))
    want = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in before.collect()}
    got = {}
    for r in after.collect():
        assert len(r["ids"]) <= 4096 and sum(p["length"] for p in r["pieces"]) == len(r["ids"])
        for p in r["pieces"]:
            got[p["doc_id"], p["piece"]] = r["ids"][p["offset"] : p["offset"] + p["length"]]
    assert {d: sum((got[d, i] for i in range(1 + max(p for e, p in got if e == d))), []) for d in {d for d, _ in got}} == want


def test_pipeline_of_odd_tables(spark, docs):
    import corpus_pipeline

    rng = random.Random(12)
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_deleted int, longest string, _cleared int, _was_empty int, component_id int, kept boolean, text_hash int"
    passage = text(rng, 70, 10**6)
    good = [(i, f"{text(rng, 60, 10**6)}\n{text(rng, 60, 10**6)}") for i in range(1, 20)]
    rows = [*good, (30, good[0][1]), (30, text(rng, 90, 10**6)), (31, None), (None, text(rng, 80, 10**6)), (None, good[1][1]), (32, ""), (33, "a\nb\nc"), (34, "a\nb\nc"), (40, f"{text(rng, 100, 10**6)} {passage}"), (41, f"{passage} {text(rng, 100, 10**6)}")]
    full = [(i, t, "en", "s", len(t or ""), 77, 78, "l", 1, 2, 3, True, 4) for i, t in rows]
    made = spark.createDataFrame(full, schema).repartition(2)
    stages = dict(corpus_pipeline.STAGES)
    kept = K.keep_likely(made, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted((i or 0, t) for i, t in rows if t) and kept.columns == made.columns
    after = stages["line_dedup"](spark, made, "")
    assert after.columns == made.columns and {tuple(r[5:]) for r in after.collect()} == {full[0][5:]}
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in after.collect())
    # of the two texts of 30, the one of the least hash is the document
    first = made.where("doc_id = 30").orderBy(F.xxhash64("text")).first()["text"]
    gone = [(34, "a\nb\nc")] + [(30, good[0][1])] * (first == good[0][1])
    assert left == sorted((i or 0, t or "") for i, t in rows if (i, t) not in gone) and all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in after.collect())
    after = stages["jaccard_join"](spark, made, "")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in after.collect()) == sorted((i or 0, t or "") for i, t in rows if i != 34 and (i, t) != (30, good[0][1])) and after.columns == made.columns
    after = stages["compact_windows"](spark, made, "")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in after.collect())
    assert after.columns == made.columns and (41, rows[-1][1].removeprefix(passage + " ")) in got and (30, rows[20][1]) in got and {tuple(r[5:]) for r in after.collect()} == {full[0][5:]}
    packed = stages["best_fit_packing"](spark, made, "").collect()
    assert sum(len(r["pieces"]) for r in packed) == len(rows) and all(len(r["ids"]) <= 4096 for r in packed)
    for name in ("line_dedup", "jaccard_join", "compact_windows", "best_fit_packing"):
        assert stages[name](spark, made.where("false"), "").count() == 0


def test_pack_of_repeated_rows(spark, docs):
    packed = P.pack(docs([(1, "one two three four five"), (1, "one two three four five"), (2, None)]), capacity=12).collect()
    assert all(len(r["ids"]) <= 12 for r in packed) and sum(len(r["pieces"]) for r in packed) == 3 and all(r["ids"][-1] == 1 for r in packed)
