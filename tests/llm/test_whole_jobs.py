"""Cases in which a part of the job could be left out without other tests noticing."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from sonoglyph.llm import compact_windows as W, itq


def text(rng, n, words=10**6):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# -- 2 -------------------------------------------------------------------------------------------------------------


def test_copies_of_variants_among_copies(spark, docs):
    rng = random.Random(3)
    rows, variants = [], []
    for k in range(12):
        common = text(rng, 60)
        variant = common.split()
        for i in (14, 29, 44):
            variant[i] = f"changed{k}x{i}"
        for i in range(1, 31):
            own = i in (15, 28)
            rows.append((100 * k + i, text(rng, 20) + " " + (" ".join(variant) if own else common) + " " + text(rng, 20)))
        variants.append((100 * k + 28, 100 * k + 15))
    found = W.find_passages(docs(rows)).collect()
    pairs = {(r["doc_id"], r["source_doc_id"]) for r in found if r["start_word"] <= 20 and r["end_word"] >= 80}
    assert set(variants) <= pairs
    assert {d for d, _ in pairs} >= {i for i, _ in rows if i % 100 not in (1, 15)}


def test_copies_among_unrelated_documents(spark, docs):
    """Documents that hold the passage's single shingles in another order come before its copies and between them."""
    for before, between in ((1, 1), (3, 3)):
        rng = random.Random(10 * before)
        passage = text(rng, 60)
        words = passage.split()
        shingles = [" ".join(words[i : i + 5]) for i in range(56)]
        ids = iter(range(-5, 1000))
        rows = [(next(ids), " ".join(rng.sample(shingles, 56))) for _ in range(before)]
        copies = []
        for k in range(100):
            copies.append(next(ids))
            rows.append((copies[-1], text(rng, 40) + " " + passage + " " + text(rng, 40)))
            if k == 50:
                rows += [(next(ids), " ".join(rng.sample(shingles, 56))) for _ in range(between)]
        found = {r["doc_id"] for r in W.find_passages(docs(rows)).collect() if r["start_word"] <= 40 and r["end_word"] >= 100}
        assert len(found & set(copies[1:])) >= 98 and copies[0] not in found


def test_negative_ids_and_repeated_rows(spark, docs):
    rng = random.Random(4)
    passage, other = text(rng, 80), text(rng, 90)
    rows = [(-5, passage), (-4, "x " + passage), (7, passage), (7, passage), (8, other), (8, None), (9, other + " y")]
    found = {(r["doc_id"], r["source_doc_id"], r["start_word"], r["end_word"]) for r in W.find_passages(docs(rows)).collect()}
    assert (-4, -5, 1, 81) in found and (9, 8, 0, 90) in found and {d for d, *_ in found} == {-4, 7, 9}
    long = " ".join(f"u{i}" for i in range(60_000))
    found = W.find_passages(docs([(1, long), (2, long), (3, "word " * 5_000), (4, "word " * 5_000)])).collect()
    assert {(r["doc_id"], r["source_doc_id"]) for r in found} == {(2, 1), (4, 3)} and max(r["end_word"] for r in found) == 60_000


def test_chain_over_batches():
    names = W._MADE
    rng = np.random.default_rng(5)
    n = 300
    v, sig, doc = rng.integers(0, 6, n) * 8, rng.integers(0, 4, n), rng.integers(-20, 20, n)
    place = sig << W._SIGNATURE | rng.integers(0, 9, n) << W._C
    order = np.lexsort((place, doc, sig, v))
    v, sig, doc, place = v[order], sig[order], doc[order], place[order]
    none = pa.array([None] * n, pa.int64())
    whole = pa.RecordBatch.from_arrays([pa.array(v), pa.array(doc), pa.array(place), none, none], names)

    def pairs(step):
        out = pa.Table.from_batches(list(W._chain(iter([whole.slice(i, step) for i in range(0, n, step)]))))
        return sorted(map(tuple, (r.values() for r in out.to_pylist())))

    want = []
    for g in np.unique(v):
        rows = [(int(s), int(d), int(p)) for w, s, d, p in zip(v, sig, doc, place, strict=True) if w == g]
        firsts = [next(r for r in rows if r[:2] == k) for k in dict.fromkeys(r[:2] for r in rows)]
        for r in rows:
            lead, k = next(x for x in rows if x[0] == r[0]), [x[:2] for x in firsts].index(r[:2])
            partners = [(lead, True)]
            if k and firsts[k - 1][1] != lead[1]:
                partners.append((firsts[k - 1], False))
            if r[:2] == lead[:2] and lead[0] != rows[0][0]:
                partners.append((rows[0], False))
            for x, led in partners:
                if x[1] != r[1]:
                    a, b = sorted((x, r), key=lambda y: y[1])
                    want.append((a[1], b[1], led, int(g & 7), b[2], a[2]))
    assert pairs(n) == pairs(1) == pairs(7) == sorted(want)


# -- 8 -------------------------------------------------------------------------------------------------------------


def test_recall_of_the_default_index():
    rng = np.random.default_rng(8)
    for d, n in ((64, 20_000), (160, 1_000)):
        x = rng.normal(size=(n, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rotations = itq.learn_rotations(x[:5_000], itq.CODE_BITS)
        off = rng.normal(size=x.shape)
        off -= (off * x).sum(1, keepdims=True) * x
        off /= np.linalg.norm(off, axis=1, keepdims=True)
        for cosine in (0.951, 0.96, 0.97):
            y = cosine * x + np.sqrt(1 - cosine**2) * off
            met = (itq.codes(x, rotations, itq.KEY_BITS) == itq.codes(y, rotations, itq.KEY_BITS)).any(1).mean()
            print(d, cosine, met)
            assert met >= 0.95


def test_equal_vectors_are_one_class(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6, 64))
    x[3] = x[0] + 0.1 * rng.normal(size=64)
    rows = [(i, x[0].tolist()) for i in range(100, 400)] + [(-3, x[3].tolist()), (-3, x[3].tolist()), (5, x[1].tolist()), (6, x[1].tolist()), (7, x[2].tolist()), (None, x[2].tolist()), (8, x[4][:5].tolist())]
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {(i, 300, -3, False) for i in range(100, 400)} | {(-3, 300, -3, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (None, 0, None, True), (8, 0, 8, True)}


# -- hashes ----------------------------------------------------------------------------------------------------------


def thue_morse(n):
    """Two different words of n letters that polynomials modulo a power of 2 do not tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_different_words_stay_different(spark, docs):
    from collections import Counter

    from sonoglyph.llm import jaccard_join as J, packing as P, quality_rules as Q, text as T, token_counts as C, unigram as U
    from sonoglyph.llm.tokens import WordEncoder, vocabulary

    for n in (8, 64, 128, 1024, 2048):
        a, b = thue_morse(n)
        (s,) = T.slices(pa.array([a, b, a]))
        assert T.spans_hash(s.data, s.offsets[:-1], s.offsets[1:]).tolist().count(T.spans_hash(s.data, s.offsets[:1], s.offsets[1:2])[0]) == 2
        equal = T.spans_equal(s.data, s.offsets[[0, 0, 0]], s.offsets[[1, 1, 1]], s.offsets[:-1], s.offsets[1:])
        assert equal.tolist() == [True, False, True]
        e = WordEncoder(vocabulary(P.VOCABULARY))
        ids, bounds = e.encode(s)
        assert [ids[x:y].tolist() for x, y in zip(bounds, bounds[1:], strict=False)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in (a, b, a)]
    a, b = thue_morse(1024)
    rows = [(1, f"{a}\n{b}"), (2, f"x {a}"), (3, f"x {b}"), (4, f"{b}\n{a}\n{b}")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["n_dup_lines"] for r in Q.quality_rules(docs(rows), labels).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert all(r["component_id"] == r["doc_id"] for r in J.jaccard_join(docs(rows), size=3, percent=90).collect())
    assert {r["doc_id"]: r["decoded"] for r in U.encode(docs(rows)).collect()} == dict(rows)
    e = WordEncoder(vocabulary(C.VOCABULARY)).tokenizer
    path = C.new_path(spark, "test-tokens")
    C.write_token_files(docs(rows), path)
    assert Counter(map(tuple, C.scan_token_files(spark, path).collect())) == Counter((i, len(e.encode(t, add_special_tokens=False).ids)) for i, t in rows)


# -- 2 against brute force ---------------------------------------------------------------------------------------------


def shingle_list(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    return [" ".join(words[i : i + W.SIZE]) for i in range(len(words) - W.SIZE + 1)]


def like_passages(texts, queries, width=W.WIDTH, similarity=W.SIMILARITY):
    """(a, b, start, end): documents a < b, one of them a query, with runs of ``width`` shingles that are so similar, and the words of b's."""
    lists = {i: shingle_list(t) for i, t in texts.items()}
    have = {}
    for i, s in lists.items():
        for x in set(s):
            have.setdefault(x, []).append(i)
    least = int(np.ceil(similarity / (1 + similarity) * 2 * width - 1e-9))
    out = []
    for q in queries:
        for o, n in Counter(i for x in set(lists[q]) for i in have[x] if i != q).items():
            if n < min(least, 1 + least // 2) or (o in queries and o < q):
                continue
            a, b = sorted((q, o))
            known = {x: k for k, x in enumerate(dict.fromkeys(lists[a] + lists[b]))}
            x, y = (np.array([known[s] for s in lists[i]]) for i in (a, b))
            if min(len(x), len(y)) < width:
                continue
            rows_x = np.array([len(set(x[i : i + width].tolist())) for i in range(len(x) - width + 1)])
            hit = None
            for j in range(len(y) - width + 1):
                own = np.unique(y[j : j + width])
                inside = np.isin(x, own)
                if inside.sum() < least * 0.5:
                    continue
                for i in np.flatnonzero(np.convolve(inside, np.ones(width, int), "valid") >= least * 0.5):
                    shared = len(np.intersect1d(own, x[i : i + width]))
                    if shared >= similarity * (len(own) + rows_x[i] - shared):
                        hit = (a, b, j, j + width + W.SIZE - 1)
                        break
                if hit:
                    out.append(hit)
                    break
    return out


def caught(found, truth):
    spans = {}
    for r in found:
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    return sum(any(s < end and start < e for s, e in spans.get(b, [])) for _, b, start, end in truth) / max(1, len(truth))


def test_passages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = W.find_passages(docs).collect()
    truth = like_passages(texts, list(texts))
    assert len(truth) > 10 and caught(found, truth) >= 0.97
    lists = {i: shingle_list(t) for i, t in texts.items()}
    for r in found:
        a = set(lists[r["doc_id"]][r["start_word"] : r["end_word"] - W.SIZE + 1])
        b = set(lists[r["source_doc_id"]][r["source_start_word"] : r["source_end_word"] - W.SIZE + 1])
        assert len(a & b) >= W.SIMILARITY * len(a | b) - 1e-9 and r["source_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 40
