import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from leaklens.llm import decontamination, mixing, near_dup, quality, substring_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, a long, digest string, score string"


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1, "y", "z") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    passage = words(rng, 60)
    base = [words(rng, 120) for _ in range(30)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows.append((100, base[0], "s0"))                                           # exact copy
    rows.append((101, base[1].replace(base[1].split()[50], "other", 1), "s1"))  # near copy
    rows += [(102, f"{words(rng, 80)} {passage} {words(rng, 40)}", None), (103, f"{words(rng, 33)} {passage} {words(rng, 90)}", "s1")]
    rows += [(104, None, None), (105, "", "s2"), (106, "one two", "s2"), (107, "one two", "s0"), (None, base[2], "s1"),
             (108, " ".join(["again"] * 300), "s0"), (109, words(rng, 30000), "s2"), (5, base[5], "s2")]
    return rows


def brute_classes(rows):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[0-9a-z]+", (t or "").lower())
        sets[i] = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    root = {i: i for i in sets if i is not None}
    ids = sorted(root)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both, any_ = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if both and both >= 0.8 * any_:
                a, b = sorted((root[i], root[j]))
                root = {n: a if r == b else r for n, r in root.items()}
    return root


def test_near_duplicates_equal_brute_force(spark, corpus):
    got = near_dup.near_duplicates(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    want = brute_classes(corpus)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    kept = near_dup.drop_near_duplicates(frame(spark, corpus))
    assert kept.columns == frame(spark, corpus).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}


def test_near_duplicates_of_a_large_family(spark):
    """More documents than one block, with similarities around the threshold."""
    rng = random.Random(2)
    base = words(rng, 60).split()
    rows = []
    for i in range(600):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "s"))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_dart_signatures_estimate_weighted_similarity():
    x = near_dup.W.mix(np.arange(400, dtype=np.uint64))
    weight = np.ones(600)
    weight[:20], weight[300:310] = 7.5, 2.25
    element = np.concatenate([x[:300], x[:300]])
    element[500:] = x[300:]
    sig = near_dup.dart_signatures(element, weight, np.array([0, 300, 600]), 8000)
    low = np.minimum(weight[:200], weight[300:500]).sum()
    high = np.maximum(weight[:200], weight[300:500]).sum() + 200
    assert abs((sig[0] == sig[1]).mean() - low / high) < 0.02


def test_empty_tables(spark):
    none = frame(spark, []) if False else spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert near_dup.near_duplicates(none).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0
    assert substring_dedup.drop_repeated_passages(none).count() == 0
    assert decontamination.contaminations(none, items).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert quality.classify(none, labels).count() == 0


def test_repeated_passages(spark, corpus):
    docs = frame(spark, corpus)
    got = substring_dedup.repeated_passages(docs).collect()
    text = {i: t for i, t, _ in corpus}
    assert {100, 101, 102, 103, 108} <= {r.doc_id for r in got}
    assert not {104, 105, 106, 107, 109, 7} & {r.doc_id for r in got}
    hit = next(r for r in got if r.doc_id == 103)
    assert hit.removed and hit.keeper == 102 and text[103][hit.start_char:hit.end_char] in text[102] and hit.n_words >= 26
    cut = {r.doc_id: r for r in substring_dedup.drop_repeated_passages(docs).collect()}
    assert cut[102].text == text[102] and cut[104].text is None and cut[105].text == ""
    assert len(cut[103].text) < len(text[103]) and cut[103].n_chars == len(cut[103].text)


@pytest.mark.parametrize("shift", range(8))
def test_every_repeat_of_fifty_words_is_found(shift):
    rng = random.Random(shift)
    passage = words(rng, 50)
    texts = [f"{words(rng, 20 + shift)} {passage} {words(rng, 30)}", f"{words(rng, 41 + 3 * shift)} {passage} {words(rng, 9)}"]
    import pyarrow as pa
    doc, _, _, digest = substring_dedup._units(substring_dedup.W.split(pa.array(texts), lower=False))
    assert set(digest[doc == 0].tolist()) & set(digest[doc == 1].tolist())


def test_decontamination(spark, corpus):
    rng = random.Random(9)
    items = [(1, words(rng, 40)), (2, words(rng, 20)), (3, None), (4, ""), (5, words(rng, 300))]
    lines = {i: (t or "").split() for i, t in items}
    changed = [w if k % 5 else f"z{k}" for k, w in enumerate(lines[1])]
    rows = corpus + [(200, f"{words(rng, 50)} {items[0][1]} {words(rng, 70)}", "s"), (201, f"{words(rng, 11)} {items[1][1]}", "s"),
                     (202, f"{words(rng, 25)} {' '.join(changed)} {words(rng, 25)}", "s"), (203, f"{words(rng, 500)} {items[4][1]}", "s"),
                     (204, " ".join(lines[1][:12]) + " " + words(rng, 60), "s")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminations(frame(spark, rows), table).collect()}
    assert got == {(200, 1), (201, 2), (202, 1), (203, 5)}
    kept = {r.doc_id for r in decontamination.drop_contaminated(frame(spark, rows), table).select("doc_id").collect()}
    assert kept == {i for i, _, _ in rows} - {200, 201, 202, 203}


def test_decontamination_of_items_in_a_third_of_the_rows(spark):
    rng = random.Random(11)
    shared, common = words(rng, 40), words(rng, 40, 12)     # common: words of every text below
    rows = [(i, f"{words(rng, 60)} {words(rng, 30, 12)} {shared if i % 3 == 0 else ''} {words(rng, 30)}", "s") for i in range(90)]
    rows += [(100 + i, f"{rows[1][1]} {shared}", "s") for i in range(30)]                   # exact copies
    rows.append((200, f"{words(rng, 60)} {common} {words(rng, 30)}", "s"))
    items = spark.createDataFrame([(1, shared), (2, common)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminations(frame(spark, rows), items).collect()}
    want = {(i, 1) for i, t, _ in rows if shared in t} | {(200, 2)}
    assert got & ({(i, 1) for i, _, _ in rows} | {(200, 2)}) == want


@pytest.mark.parametrize("n_items, n_words", [(2900, 40), (300, 300)])
def test_decontamination_against_many_items(spark, n_items, n_words):
    rng = random.Random(12)
    items = [(i, words(rng, n_words, 20000)) for i in range(n_items)]
    rows, want = [], set()
    for i in range(0, n_items, n_items // 60):
        near = [w if rng.random() > 0.3 else f"w{rng.randrange(20000)}" for w in items[i][1].split()]
        near[-6:] = items[i][1].split()[-6:]
        rows += [(2 * i, f"{words(rng, 50, 20000)} {items[i][1]} {words(rng, 50, 20000)}", "s"),
                 (2 * i + 1, f"{words(rng, 50, 20000)} {' '.join(near)} {words(rng, 50, 20000)}", "s")]
        want |= {(2 * i, i), (2 * i + 1, i)}
    table = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminations(frame(spark, rows), table).collect()} == want


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontamination._lcs(np.array(a), np.array(b)) == best[-1][-1]


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in full]
        rest = total - sum(2 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2 * sizes[s] for s in full}
        full |= over


def test_mixing(spark, corpus):
    rows = corpus + [(1000 + i, "a b c d e f g h i j"[:1 + 2 * (i % 10)], f"s{i % 5}") for i in range(3000)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rows: sorted((str(r.source), str(r.doc_id), r.copies) for r in rows)
    assert key(got) == key(again)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns + ["copy"] and out.count() == sum(r.copies * r.rows for r in got)


def test_reduction_conserves_words():
    import pandas as pd
    rng = np.random.default_rng(3)
    size = rng.integers(1, 500, 700)
    pdf = pd.DataFrame({"size": size, "chance": rng.random(700), "draw": rng.random(700), "tie": [str(i) for i in range(700)]})
    out = mixing._reduce(pdf)
    assert (out["size"] * out["chance"]).sum() == pytest.approx((pdf["size"] * pdf["chance"]).sum())
    assert ((out["chance"] > 0) & (out["chance"] < 1)).sum() <= 1 and out["chance"].between(0, 1).all()
    level = mixing._reduce(pdf, last=False)
    assert (level["size"] * level["chance"]).sum() == pytest.approx((pdf["size"] * pdf["chance"]).sum())
    assert ((level["chance"] > 0) & (level["chance"] < 1)).sum() == mixing.KEPT


def test_the_document_left_open_is_a_small_one():
    import pandas as pd
    rng = np.random.default_rng(5)
    expected = np.zeros(40)
    size = np.array([9000, 4000, 700] + [100 + i for i in range(36)] + [3])
    for run in range(400):
        pdf = pd.DataFrame({"size": size, "chance": np.full(40, 0.37), "draw": rng.random(40), "tie": [str(i) for i in range(40)]})
        out = mixing._reduce(pdf)
        left = out["size"][(out["chance"] > 0) & (out["chance"] < 1)]
        if run == 0:
            even = mixing._reduce(pdf[3:].reset_index(drop=True))
            assert even["size"][(even["chance"] > 0) & (even["chance"] < 1)].max() <= 110
        assert len(left) <= 1
        expected += out.sort_values("tie", key=lambda c: c.astype(int))["chance"].to_numpy()
    assert np.abs(expected / 400 - 0.37).max() < 0.1     # draws keep every document's expectation


def test_toxicity_learns_words_and_bears_marks(spark):
    rng = random.Random(7)
    bad = ["blockhead", "numbskull", "dimwit"]
    rows, labels = [], []
    for i in range(600):
        t = words(rng, 40).split()
        toxic = i % 3 == 0
        if toxic:
            t[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(t), "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "b l o c k h e a d", "s"), (1003, "you d.i.m.w.i.t", "s"),
             (1004, "numbxskull here", "s"), (1005, words(rng, 30000), "s"), (None, "dimwit", "s")]
    labels += [(None, 1, 1), (1, 1, None), (2, 1, 0), (2, 1, 0)]
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r["p"] for r in toxicity.score(docs, model, "p").collect()}
    assert all(0 <= p <= 1 for p in got.values())
    held = [i for i in range(600) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.97
    assert got[1002] >= 0.5 and got[1003] >= 0.5 and got[1004] >= 0.5 and got[None] >= 0.5
    assert got[1000] < 0.5 and got[1001] < 0.5 and got[1005] < 0.5
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and {1000, 1001, 1005} <= {r.doc_id for r in kept.collect()}


def test_training_reads_whole_texts(spark):
    text = " ".join(f"w{i}" for i in range(3000)) + " late s p a c e d"
    rows = [(i, text, "s") for i in range(20)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    got = toxicity.training_sample(frame(spark, rows), labels).collect()
    assert got and all(set(r.words) == toxicity.raw_words(text) for r in got)
    assert {"w2999", "late", "spaced"} <= set(got[0].words)


def test_string_kernel_equals_definition():
    from itertools import combinations

    def naive(s, t):
        total = 0.0
        for a in combinations(range(len(s)), 3):
            for b in combinations(range(len(t)), 3):
                if [s[i] for i in a] == [t[i] for i in b]:
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    for s, t in (("idiot", "idxiot"), ("abcabc", "acb"), ("aaaa", "aaa")):
        got = toxicity._subsequences(toxicity._codes([s], 8), toxicity._codes([t], 8))[0]
        assert got == pytest.approx(naive(s, t), rel=1e-5)


def test_quality_probabilities_sum_to_one_and_junk_goes(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["river", "stone", "green", "light", "under", "water"]) for _ in range(30)), "s") for i in range(200)]
    labels = [(i, 1, 0) for i in range(150)]
    rows += [(500, "zq#xv!kj%qz&xx " * 20, "s"), (501, None, "s"), (502, "", "s"), (None, "river stone", "s")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert not got[500].kept and not got[501].kept and got[501].perplexity is None
    assert np.mean([got[i].kept for i in range(150, 200)]) > 0.9
    model = quality.train(docs.filter("doc_id < 150"))
    order = quality.ORDER
    rows = model[order][0].withColumn("context", quality._context(quality.F.col("gram")))
    letters = [r.gram for r in model[1][0].collect()]
    context = rows.select("context").first().context
    every = spark.createDataFrame([((context << 16) | c,) for c in letters], "gram long")
    total = sum(2.718281828459045 ** r.logp for r in quality.probabilities(every, model).collect())
    assert 0.98 < total <= 1.0 + 1e-9


def test_unseen_good_texts_are_kept(spark):
    """Thresholds come from good texts outside the counts: new texts of the same
    kind pass as well as those in the counts."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(i, prose(), "s") for i in range(300)] + [(i, prose(), "s") for i in range(300, 400)]
    rows += [(i, "".join(rng.choice("xqzjk#%&0123 ") for _ in range(300)), "s") for i in range(400, 420)]
    rows += [(500, None, "s"), (501, "", "s"), (0, rows[0][1], "s")]
    labels = [(i, 1, 0) for i in [*range(300), 500, 501]] + [(400, 0, 0), (None, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(frame(spark, rows), marks).collect()
    kept = [r.doc_id for r in got if r.kept]
    assert len(got) == len(rows) and kept.count(0) == 2
    assert sum(i < 300 for i in kept) > 290 and sum(300 <= i < 400 for i in kept) >= 94 and max(kept) < 400
    bare = quality.classify(frame(spark, rows[:1]), marks).collect()       # nothing left out, or nothing counted
    assert len(bare) == 1


def test_ids_meet_the_labels_and_texts_travel_in_bundles(spark):
    rows = [(i % 300 if i % 50 else None, f"text {i % 200} é🙂" if i % 7 else None) for i in range(700)]
    docs = spark.createDataFrame([(i, t, "en" if i else None) for i, t in rows], "doc_id long, text string, lang string").coalesce(2)
    blocks = quality._blocks(docs).localCheckpoint()
    assert blocks.count() <= 6
    back = [(i, t) for r in blocks.collect() for i, t in zip(r.doc_id, quality._unpacked(bytes(r.packed)))]
    key = lambda r: (r[0] is not None, r)       # noqa: E731
    assert sorted(back, key=key) == sorted([(i, t or "") for i, t in rows], key=key)
    good = spark.range(0, 300, 3).withColumnRenamed("id", "__good")
    got = [quality._unpacked(bytes(r.packed))[i] for r in quality._trusted(blocks, good).collect() for i in r.rows]
    kept = docs.filter("doc_id % 3 = 0").filter(~quality.held_out(quality.F.col("text"))).collect()
    assert sorted(got) == sorted(r.text or "" for r in kept)


def test_bounds_of_windows_are_summed_over_few_rows():
    import pyarrow as pa

    from leaklens.llm import words as W

    rng = np.random.default_rng(2)
    words = W.split(pa.array(["", "a", " ".join(f"w{i % 90}" for i in range(1001)), "b c", " ".join(["x"] * 5000)] + ["ab cd " * 8] * 9000))
    most = np.zeros((1 << decontamination.HASH_BITS, 30), dtype=np.float32)
    used = np.unique(decontamination._buckets(words))[::2]
    most[used] = rng.random((len(used), 30), dtype=np.float32)
    at, rows = decontamination._bounds(most)
    assert len(rows) == len(used) + 1 and (rows[at] == most).all()
    want, blocks = decontamination._block_sums(words, most, decontamination.STRIDE)
    got, of = decontamination._row_sums(words.ptr, at[decontamination._buckets(words)], rows)
    assert (got == want).all() and (of == blocks).all()


def test_stretches_join_neighbouring_windows():
    s, w = decontamination.STRIDE, decontamination.PASSAGE
    hits = [np.array(x) for x in ([1, 0, 1, 1, 1], [0, 1, 0, 0, 1], [40, 3, 2, 0, 2], [0.3, 0.4, 0.5, 0.9, 0.6])]
    assert list(decontamination._stretches(hits, np.array([10, 20]))) == [
        (0, 1, [(3 * s - 20, 3 * s + w + 20, 0.4)] if 3 * s > 20 else [(0, 3 * s + w + 20, 0.4)]),
        (1, 0, [(0, 2 * s + w + 10, 0.9), (40 * s - 10, 40 * s + w + 10, 0.3)]),
        (1, 1, [(0, 2 * s + w + 20, 0.6)])]
    assert not list(decontamination._stretches([x[:0] for x in hits], np.array([10, 20])))


def test_block_sums_take_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from leaklens.llm import words as W

    words = W.split(pa.array(["a bc def " * 30_000, "", "a", "bc " * 17]))
    table = np.random.default_rng(1).random((1 << decontamination.HASH_BITS, 40), dtype=np.float32)
    for stride in (decontamination.STRIDE, decontamination.ITEM_PASSAGE):
        tracemalloc.start()
        sums, blocks = decontamination._block_sums(words, table, stride)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 12_000_000          # all words' rows are 14 MB, beside 2 MB of sums and their places
        doc, at = 3, int(blocks[:3].sum())
        part = decontamination._buckets(words)[words.ptr[doc]:words.ptr[doc + 1]]
        want = [table[part[a:a + stride]].sum(axis=0) for a in range(0, len(part), stride)]
        assert np.allclose(sums[at:], want, rtol=1e-5) and len(sums) == blocks.sum()


def test_workers_collect_cycles_after_the_scoring(spark):
    docs = spark.createDataFrame([(i, f"some plain words {i}") for i in range(16)], "doc_id long, text string").repartition(4)
    model = toxicity.Model(["plain"], np.array([1.0]), 0.0, 1.0, 0.0)
    assert toxicity.score(docs, model).count() == 16

    def state(batches):
        import gc

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gc.isenabled()])], ["on"])

    toxicity.score(docs, model).collect()
    assert all(r.on for r in docs.mapInArrow(state, "on boolean").collect())


def test_no_rdd_beside_the_search_and_bounded_batches(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, "w " * 2000) for i in range(6000)], "doc_id long, text string").coalesce(1)
    none = decontamination._found(docs, docs.limit(0).withColumnRenamed("doc_id", "item_id"))
    assert "Scan ExistingRDD" not in none._jdf.queryExecution().toString().split("Physical Plan")[-1] and none.count() == 0
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {name: spark.conf.get(name) for name in names}
    try:
        items = str(tmp_path / "benchmark.parquet")
        spark.createDataFrame([(1, "w " * 60)], "item_id long, text string").write.parquet(items)
        for text, kept in (("7m", "7m"), ("1g", str(8 << 20)), (str(8 << 20), str(8 << 20))):
            spark.conf.set(names[1], text)
            corpus_pipeline.drop_contaminated(spark, docs.limit(3), str(tmp_path))
            assert spark.conf.get(names[1]) == kept

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

        got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in got) == 6000 and max(r.rows for r in got) <= 2000 and max(r.bytes for r in got) < 12e6
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
