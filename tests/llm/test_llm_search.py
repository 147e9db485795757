"""Decontamination, near-duplicates, neighbours, segmentations, substrings and the pipeline, against brute force."""

import collections
import hashlib
import importlib.util
import itertools
import random
import re

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import op3_decontamination as op3
from tidelog.llm import op4_alike as alike
from tidelog.llm import op4_simhash as op4
from tidelog.llm import op5_neighbours as op5
from tidelog.llm import op8_sentencepiece as op8
from tidelog.llm import op10_substrings as op10
from tidelog.llm import registry
from tidelog.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(chance, n):
    return " ".join(f"{chance.choice(WORDS)}{chance.randrange(50)}" for _ in range(n))


# ---------------------------------------------------------------- op3


def brute_hits(text, items, span=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own, hit, ids = cut(text), set(), set()
    for item, other in items:
        w = cut(other)
        if not w or item is None:
            continue
        n = min(span, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add(str(item))
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [op3.BROADCAST_BYTES, 0])
def test_decontamination(spark, limit):
    chance = random.Random(2)
    items = [(i, words(chance, chance.choice((1, 3, 9, 10, 11, 40)))) for i in range(12)]
    items += [(12, None), (None, "an item without an id and ten words or more of it"), (13, ""), (3, words(chance, 12)), (100, items[2][1]), (14, "ÉTÉ été, deux!")]
    docs = []
    for i in range(40):
        parts = [words(chance, chance.randrange(0, 30))]
        for _, t in chance.sample(items, 2):
            w = (t or "").split()
            a = chance.randrange(0, max(1, len(w) - 8))
            parts += [" ".join(w[a : a + chance.choice((8, 9, 10, 11, 40))]).upper() if chance.random() < 0.3 else "; ".join(w[a : a + 15]), words(chance, 3)]
        docs.append((i, " ".join(parts), "clash", i))
    docs += [(50, None, "", 0), (51, "", "", 0), (None, docs[3][1], "", 0), (4, docs[4][1], "again", 1), (52, "-- !! ..", "", 0), (53, "été deux " + "x " * 50_000 + items[5][1], "", 0), (5, "another text under a known id", "", 0)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, hash string, w int")
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("kh", F.lit(1))
    out = op3.decontaminate(frame, bench, broadcast_bytes=limit)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect())
    assert got == collections.Counter((d[0], *brute_hits(d[1], items)) for d in docs)
    bad = {d[0] for d in docs if brute_hits(d[1], items)[4]}
    kept = op3.clean(frame, bench, broadcast_bytes=limit)
    assert kept.columns == frame.columns and collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(d[0] for d in docs if d[0] not in bad)
    assert op3.decontaminate(frame.where("false"), bench, broadcast_bytes=limit).count() == 0
    none = op3.decontaminate(frame, bench.where("false"), broadcast_bytes=limit)
    assert none.count() == len(docs) and none.where("contaminated or n_hit > 0").count() == 0


# ---------------------------------------------------------------- op4


def brute_print(text, shingle=4, seed=42):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, seed) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, near):
    """The smallest index reachable from each."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(prints)), 2):
            if label[i] != label[j] and near(prints[i], prints[j]):
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def test_fingerprints():
    texts = ["One two three four five", "", None, "  \t\n", "three words only", "a b c d " * 300, "É é Å", "x" * 200_000]
    got = op4.fingerprints(texts, 4, (42, 7))
    assert [[int(v) for v in r] for r in got] == [[brute_print(t, 4, 42), brute_print(t, 4, 7)] for t in texts]


def test_every_close_pair_shares_an_anchor():
    chance = np.random.default_rng(5)
    for blocks, within, bits in ((3, 1, 4), (3, 1, 5), (4, 2, 11)):
        cover = op4.whole_cover(blocks)
        base = chance.integers(0, 1 << 63, 200, dtype=np.uint64)
        flips = np.array([sum(1 << int(b) for b in chance.choice(64, bits, replace=False)) for _ in base], dtype=np.uint64)
        row_a, key_a, home_a = op4.anchors(base[:, None], cover, within)
        row_b, key_b, _ = op4.anchors((base ^ flips)[:, None], cover, within)
        for i in range(200):
            assert set(key_a[(row_a == i) & home_a]) & set(key_b[row_b == i])
        assert (np.bincount(row_a[home_a]) == blocks).all()


@pytest.mark.parametrize("most", [op4.MOST, 3])
def test_near_duplicates(spark, most):
    chance = random.Random(9)
    docs = []
    for _ in range(12):
        base = words(chance, chance.choice((5, 60, 150))).split()
        for _ in range(chance.choice((1, 2, 6))):
            copy = list(base)
            for _ in range(chance.randrange(0, 3)):
                copy[chance.randrange(len(copy))] = "changed"
            docs.append(" ".join(copy))
    docs += ["", None, " ", "tiny", "tiny", docs[0], docs[0].upper()]
    chance.shuffle(docs)
    rows = [(i * 3 + 1, t, "x", i) for i, t in enumerate(docs)]
    frame = spark.createDataFrame([*rows, rows[4], (None, docs[5], "y", 0)], "doc_id bigint, text string, copy_id string, f0 int")
    out = op4.near_duplicates(frame, most=most)
    prints = [brute_print(t) for t in docs]
    label = brute_components(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    want = collections.Counter((r[0], label[i] * 3 + 1) for i, r in enumerate(rows))
    want[(rows[4][0], label[4] * 3 + 1)] += 1
    want[(None, label[5] * 3 + 1)] += 1
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in out.collect()) == want
    kept = op4.keep_one(frame, most=most)
    assert kept.columns == frame.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert set(ids) - {None} == {label[i] * 3 + 1 for i in range(len(docs))}
    assert op4.near_duplicates(frame.where("false")).count() == 0 and op4.keep_one(frame.where("false")).count() == 0


def test_dense_group_links_linearly():
    chance = np.random.default_rng(1)
    near = np.array([sum(1 << int(b) for b in chance.choice(64, 2, replace=False)) for _ in range(600)], dtype=np.uint64)
    near = np.unique(near)[:, None]
    rows, roots = op4.forest(near, np.ones(len(near), dtype=bool), 4)
    assert len(rows) == len(near) - 1 and set(roots) == {0}


def cosine(a, b, shingle=5):
    a, b = shingles(a, shingle), shingles(b, shingle)
    return len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else float(a == b)


def shingles(text, shingle=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def test_majority():
    chance = np.random.default_rng(4)
    sizes = [1, 2, 3, 14, 15, 16, 29, 30, 31, 300]
    hashes = chance.integers(0, 1 << 64, sum(sizes), dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    for got, a, n in zip(op4.majority(hashes, starts), starts, sizes, strict=True):
        assert int(got) == sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in hashes[a : a + n]) * 2 > n)


@pytest.mark.parametrize("limits", [{}, {"most": 3, "most_hashes": 3_000}])
def test_pipeline_links_by_exact_similarity(spark, limits):
    import corpus_pipeline

    chance = random.Random(12)
    docs = []
    for n in [6, 7, 8, 8, 9, 12, 40, 90, 200, 304] * 3:
        base = words(chance, n).split()
        docs.append(" ".join(base))
        for _ in range(4):  # some just above the bound, some just below
            copy, to = list(base), max(1, round((n - 4) * chance.uniform(0.1, 0.3)))
            copy[n - min(to, n) :] = words(chance, min(to, n)).split()
            docs.append(" ".join(copy))
            docs.append(" ".join([*base, *words(chance, to).split()]))
    docs += ["", None, " \n", "a b", "A,  b", docs[1] + " " + docs[1], "x y z " * 40, "x y z " * 90, "!!", " !!", "??"] + [words(chance, 6) for _ in range(300)]
    frame = spark.createDataFrame([(i, d, "c", i) for i, d in enumerate(docs)], "doc_id bigint, text string, node string, f0 int")
    near = lambda a, b: cosine(a, b) >= 0.8 - 1e-12 if shingles(a) else not shingles(b) and (a or "").strip() == (b or "").strip()
    label = brute_components(docs, near)
    assert 20 < sum(i != x for i, x in enumerate(label)) < 250
    kept = alike.keep_one(frame, **corpus_pipeline.NEAR, **limits)
    assert sorted(r[0] for r in kept.collect()) == sorted(set(label)) and kept.columns == frame.columns
    assert alike.keep_one(frame.where("false"), **corpus_pipeline.NEAR).count() == 0
    more = frame.unionAll(frame.where("doc_id < 5")).unionAll(frame.where("doc_id in (1, 2)").withColumn("doc_id", F.lit(None).cast("bigint")))
    kept = alike.keep_one(more, **corpus_pipeline.NEAR)
    assert collections.Counter(r[0] for r in kept.collect()) == collections.Counter([*set(label), *[x for x in set(label) if x < 5], None, None])


def test_search_at_the_bound():
    """Pairs of the least similarity that links: the share that meets at an anchor within the bounds on bits."""
    chance, found, n = np.random.default_rng(21), 0, 1_500
    cover = op4.perfect_cover(alike.WORDS)
    sets = []
    for _ in range(n):  # 160 of 200 shingles in common: a cosine of 0.8
        every = chance.integers(0, 1 << 63, 240, dtype=np.uint64)
        sets += [np.sort(every[:200]), np.sort(every[40:])]
    prints = alike.prints_of(sets)[0]
    one, other = prints[0::2], prints[1::2]
    near = op4.apart(prints, np.arange(0, 2 * n, 2), np.arange(1, 2 * n, 2)) <= alike.BITS
    met = np.zeros(n, dtype=bool)
    for a, b in ((one, other), (other, one)):
        row_a, key_a, home = op4.anchors(a, cover, 1)
        row_b, key_b, _ = op4.anchors(b, cover, 1)
        lead = np.array([(x.word + 1) % alike.WORDS for x in cover])
        held = set(zip(row_b.tolist(), key_b.tolist(), strict=True))
        for r, k in zip(row_a[home].tolist(), key_a[home].tolist(), strict=True):
            w = lead[k & 31]
            if (r, k) in held and int(a[r, w] ^ b[r, w]).bit_count() <= alike.LEAD_BITS:
                met[r] = True
    found = (near & met).mean()
    assert found > 0.99, found


def test_dense_component_links_linearly():
    chance = np.random.default_rng(5)
    base = chance.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.append(np.delete(base, chance.integers(100)), chance.integers(0, 1 << 63, 3, dtype=np.uint64))) for _ in range(300)]
    rows, roots = alike.linked(sets, alike.prints_of(sets)[0], (4, 5))
    assert len(rows) == 299 and set(roots) == {0}


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, few):
    chance = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000 + chance.randrange(40), 1000 + chance.randrange(40)) for _ in range(30)] + [(5000, 5000 + i) for i in range(1, 90)] + [(7, 7), (8, 7), (8, 7)]
    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r["a"]: r["b"] for r in components(frame, few).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: r for x, r in label.items() if x != r}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), few).count() == 0
    # nodes of several fields, nulls first
    rows = [((1, None, 5), (1, "é", 2)), ((0, "z", 1), (1, None, 5)), ((0, "b", 1), (0, "a", 9)), ((0, "a", 9), (0, "c", 0))]
    kind = "struct<none:int,name:string,f:bigint>"
    found = {tuple(r["a"]): tuple(r["b"]) for r in components(spark.createDataFrame(rows, f"a {kind}, b {kind}"), few).collect()}
    assert found == {(1, None, 5): (0, "z", 1), (1, "é", 2): (0, "z", 1), (0, "b", 1): (0, "a", 9), (0, "c", 0): (0, "a", 9)}


# ---------------------------------------------------------------- op5


def brute_neighbours(rows, top):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scores = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in scores[:top]]
    return out


def test_neighbours_whole_space(spark):
    """With a recall of 1 on few vectors everything is gone through: the exact answer, ties and copies included."""
    chance = np.random.default_rng(6)
    rows = [(i, chance.integers(-3, 4, 8).astype(float).tolist()) for i in range(120)]
    rows = [(i, [1.0] * 8 if i % 3 == 0 else v if any(v) else [1.0] + [0.0] * 7) for i, v in rows]
    odd = [(200, None), (220, [0.0] * 8), (240, [float("nan")] + [1.0] * 7), (260, [float("inf")] * 8), (280, [None] + [1.0] * 7), (300, [1.0, 2.0]), (None, [1.0] * 8), (320, []), rows[7]]
    frame = spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    good = op5.usable(frame)
    assert good.count() == 120
    out = op5.neighbours(good, good.where("vec_id % 20 = 0"), top=5, recall=1.0, k=4)
    got = collections.defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_neighbours(rows, 5)
    assert got.keys() == want.keys() and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)
    few = good.where("vec_id < 3")
    assert op5.neighbours(few, few.where("vec_id = 0")).count() == 2
    none = good.where("false")
    assert op5.neighbours(none, none).count() == 0


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op5, "BLOCK", 4)
    chance = np.random.default_rng(8)
    rows = [(i, chance.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    good = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out = op5.neighbours(good, good.where("vec_id % 20 = 0"), top=4, recall=1.0, k=2)
    got = {q: [r["vec_id"] for r in out.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (0, 20, 40)}
    assert got == {q: [i for i, _ in v] for q, v in brute_neighbours(rows, 4).items()}


def test_neighbours_recall(spark):
    found = op5.query(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = brute_neighbours(list(zip(table.vec_id.tolist(), table.embedding.tolist(), strict=True)), 20)
    got = found.groupby("query_id").vec_id.apply(set)
    assert sum(len(got[q] & {i for i, _ in v}) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_cells_in_order():
    chance = np.random.default_rng(3)
    index = op5.MultiIndex(chance.normal(size=(200, 8)), 5)
    query = chance.normal(size=8)
    order = list(index.order(query))
    sums = [index.first[c // 5] @ query[:4] + index.second[c % 5] @ query[4:] for c in order]
    assert sorted(order) == list(range(25)) and all(a >= b - 1e-12 for a, b in zip(sums, sums[1:], strict=False))


# ---------------------------------------------------------------- op8


def brute_segmentations(text):
    model, whole = op8.vocabulary(op8.VOCABULARY), "▁" + text.replace(" ", "▁")
    known = {p: i for i, p in enumerate(model.pieces) if model.content[i] and not re.fullmatch("<0x..>", p)}
    out = {}

    def go(at, ids, weight):
        if at == len(whole):
            out[tuple(ids)] = weight
            return
        for end in range(at + 1, min(len(whole), at + op8.WIDTH) + 1):
            piece = whole[at:end]
            if piece in known:
                go(end, [*ids, known[piece]], weight + model.log_weight[known[piece]])
            elif end == at + 1:
                data = piece.encode()
                go(end, [*ids, *(int(model.byte_ids[b]) for b in data)], weight + model.log_weight[3] * len(data))

    go(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: v - total for k, v in out.items()}


@pytest.mark.parametrize("text", ["the", "a b", "né\nx", "x  y", "࿿!"])
def test_samples_without_replacement(text):
    exact, n = brute_segmentations(text), 1_500
    found = op8.segmentations(op8.Lattices(op8.vocabulary(op8.VOCABULARY)), list(range(n)), [text] * n, 3)
    for rows in found:
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(set(ids)) == len(ids) == min(3, len(exact))
        assert all(abs(exact[i] - r[1]) < 1e-4 for i, r in zip(ids, rows, strict=True))
        assert all(a[2] >= b[2] for a, b in zip(rows, rows[1:], strict=False)) and all(0 <= r[3] <= 1 for r in rows)
    p = {k: np.exp(v) for k, v in exact.items()}
    first, second = (collections.Counter(tuple(rows[k][0].tolist()) for rows in found if len(rows) > k) for k in (0, 1))
    for k in p:
        assert abs(first[k] / n - p[k]) < 5 * (p[k] * (1 - p[k]) / n) ** 0.5 + 0.002
        after = sum(p[o] * p[k] / (1 - p[o]) for o in p if o != k)
        assert len(p) < 2 or abs(second[k] / n - after) < 5 * (after * max(0, 1 - after) / n) ** 0.5 + 0.003
    # a result over its inclusion probability: unbiased for the total of 1
    assert abs(np.mean([sum(np.exp(r[1]) / r[3] for r in rows) for rows in found]) - 1) < 0.02


def test_segmentation_rows(spark):
    rows = [(1, "some text, here"), (1, "some text, here"), (2, ""), (3, None), (None, "no key"), (4, "long wörds 世界 🙂 \t\n" * 4_000), (5, "▁ as it is"), (6, "  spaces  ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("rank", F.lit("clash")).withColumn("piece_ids", F.lit(0))
    out = op8.sampled(docs, k=2).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=op8.VOCABULARY)
    for r in out:
        want = (r["text"] or "").replace("▁", " ")
        assert r["decoded"] == want and r["n_pieces"] == len(r["ids"])
        if r["doc_id"] != 6:
            assert model.decode(r["ids"]) == want
    assert collections.Counter(r["doc_id"] for r in out) == {1: 4, 2: 1, 3: 1, None: 2, 4: 2, 5: 2, 6: 2}
    twice = [tuple(r["ids"]) for r in out if r["doc_id"] == 1]
    assert len(set(twice)) == 2
    again = op8.sampled(docs.repartition(5), k=2).collect()
    assert {(r["doc_id"], r["rank"], tuple(r["ids"])) for r in again} == {(r["doc_id"], r["rank"], tuple(r["ids"])) for r in out}
    assert {r["inclusion"] for r in out if r["doc_id"] in (2, 3)} == {1.0}
    whole = op8.encoded(docs)
    assert whole.count() == len(rows) and whole.columns == ["doc_id", "text", "rank", "piece_ids", "inclusion"]
    assert op8.sampled(docs.where("false")).count() == 0


def test_units():
    chance = random.Random(31)
    for _ in range(3_000):
        text = "".join(chance.choice(["a", "b", " ", "\n", "▁", "\0", "é"][: chance.choice((3, 4, 7))]) for _ in range(chance.randrange(1, 9)))
        assert op8.units_of(text) == op8._UNIT.findall("▁" + text.replace(" ", "▁"))


def test_nodes_without_mass_are_passed_over():
    """A text with one segmentation but for edges of next to no mass still gives its rows, and no row twice."""
    lattices = op8.Lattices(op8.vocabulary(op8.VOCABULARY))
    for n in (1, 2, 5, 40):
        rows = op8.segmentations(lattices, [n], ["ab" * n], 6)[0]
        assert len({tuple(r[0].tolist()) for r in rows}) == len(rows) == min(6, len(brute_segmentations("ab" * n)) if n < 5 else 6)


def test_cache_doesnt_show(monkeypatch):
    texts = [f"words {i} of the text number {i * 7919} again and again" for i in range(60)]
    large = op8.segmentations(op8.Lattices(op8.vocabulary(op8.VOCABULARY)), list(range(60)), texts, 2)
    monkeypatch.setattr(op8, "CACHE", 200)
    small = op8.Lattices(op8.vocabulary(op8.VOCABULARY))
    for at in range(0, 60, 7):
        for d, rows in enumerate(op8.segmentations(small, list(range(at, min(60, at + 7))), texts[at : at + 7], 2)):
            assert [r[0].tolist() for r in rows] == [r[0].tolist() for r in large[at + d]]


def test_encoded_documents_have_all_samples(spark):
    import corpus_pipeline

    rows = [(1, "some text, here"), (2, ""), (3, None), (4, "wörds 世界 🙂 \t\n" * 50), (5, "▁ as it is")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("segmentations", F.lit("clash"))
    out = {r["doc_id"]: r for r in corpus_pipeline.sentencepiece(spark, docs, SF).collect()}
    want = collections.defaultdict(list)
    for r in sorted(op8.sampled(docs).collect(), key=lambda r: r["rank"]):
        want[r["doc_id"]].append((r["ids"], r["log_prob"], r["perturbed"], r["inclusion"], r["decoded"] == (r["text"] or "").replace("▁", " ")))
    assert set(out) == set(want) and {d: len(x) for d, x in want.items()} == {1: 2, 2: 1, 3: 1, 4: 2, 5: 2}
    for d, r in out.items():
        assert [tuple(x) for x in r["segmentations"]] == want[d] and all(x["round_trip"] for x in r["segmentations"])
        assert r["piece_ids"] == want[d][0][0]


# ---------------------------------------------------------------- op10


def test_gear_and_minima():
    data = np.random.default_rng(2).integers(0, 256, 400, dtype=np.uint8)
    want = []
    for i in range(400):
        want.append(sum(int(op10.GEAR[data[j]]) << (i - j) for j in range(max(0, i - 31), i + 1)) % (1 << 32))
    h = op10.gear(data)
    assert h.tolist() == want
    for reach in (1, 2, 3, 20, 31):
        least = [min(want[max(0, i - reach) : i], default=2**32 - 1) for i in range(400)]
        assert op10._least_before(h, reach).tolist() == least


def test_chunks_resist_insertions():
    text = words(random.Random(7), 400).encode()
    for data in (b"", b"x", text, b"no-spaces-" * 2_000, "世界".encode() * 3_000, b"To " * 5_000):
        ends = op10.chunk_ends(data)
        assert (np.diff(np.append(0, ends)) > 0).all() and (not data or ends[-1] == len(data))
        starts = [0, *ends.tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            data[a:b].decode("utf-8")
            assert b - a <= op10.MAX_CHUNK + op10.NEXT_SPACE + 4
    moved = b"something put in front of it all " + text
    before, after = ({d for _, d in op10.units(x)} for x in (text, moved))
    assert len(before - after) <= 4


def brute_cuts(rows):
    first, cuts = {}, collections.defaultdict(list)
    for key, text in sorted(rows, key=lambda r: r[0]):
        for place, digest in op10.units((text or "").encode()):
            first.setdefault(digest, (key, place))
    for key, text in rows:
        for place, digest in op10.units((text or "").encode()):
            if first[digest] != (key, place):
                cuts[key].append(place)
    return {k: op10.without(t, cuts[k])[0] if k in cuts else t for k, t in rows}


def test_short_runs_stay():
    text = words(random.Random(17), 300)
    data = text.encode()
    starts, count = [0, *op10.chunk_ends(data).tolist()], len(op10.chunk_ends(data))
    for repeats in ([], [3], [3, 5], [3, 4, 5, 6], list(range(count - 1)), [count - 2], [0, 1, 2, 20, 21, 22, 23]):
        want, cut, runs = bytearray(), 0, []
        for k in repeats:
            runs.append([*runs.pop(), k]) if runs and runs[-1][-1] == k - 1 else runs.append([k])
        gone = set()
        for run in runs:
            if starts[run[-1] + 2] - starts[run[0]] >= op10.MIN_RUN:
                gone |= set(range(run[0], run[-1] + 2))
                cut += len(run)
        for i in range(count):
            want += b"" if i in gone else data[starts[i] : starts[i + 1]]
        assert op10.without(text, repeats) == (want.decode(), cut)
    assert op10.without(text, list(range(count - 1)))[0] == ""


def test_every_cut_chunk_stays_somewhere(spark):
    chance = random.Random(23)
    pool = [words(chance, 12) + ". " for _ in range(40)]
    rows = [(i, "".join(chance.choice(pool) for _ in range(chance.randrange(1, 25)))) for i in range(60)]
    out = {r["doc_id"]: r for r in op10.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k: r["text"] for k, r in out.items()} == brute_cuts(rows) and sum(r["n_cut"] for r in out.values()) > 50
    chunks = lambda t: {t.encode()[a:b] for a, b in itertools.pairwise([0, *op10.chunk_ends(t.encode()).tolist()])}
    kept = "\0".join(r["text"] for r in out.values()).encode()
    assert all(c in kept for _, t in rows for c in chunks(t))


def test_passages_stay_once(spark):
    chance = random.Random(12)
    passage, line = words(chance, 60), words(chance, 25) + "\n"
    rows = [(i, f"{words(chance, 80)} {passage} {words(chance, 40)}" if i % 3 == 0 else words(chance, 120)) for i in range(1, 16)]
    rows += [(20, line * 9), (21, rows[1][1]), (22, ""), (23, None), (24, "short"), (25, "short"), (26, words(chance, 20_000))]
    frame = spark.createDataFrame([(a, b, "c", 1, -1) for a, b in rows], "doc_id bigint, text string, cuts string, n_cut int, n_chars bigint")
    out = op10.deduplicated(frame)
    got = {r["doc_id"]: r for r in out.collect()}
    want = brute_cuts(rows)
    assert {k: r["text"] for k, r in got.items()} == want and out.columns == ["doc_id", "text", "cuts", "n_chars", "n_cut"]
    assert sum(passage in (r["text"] or "") for r in got.values()) == 1
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())
    assert got[21]["text"] == "" and got[24]["text"] == got[25]["text"] == "short"
    clean = [k for k, _ in rows if k < 16 and k % 3]
    assert all(got[k]["text"] == dict(rows)[k] and got[k]["n_cut"] == 0 for k in clean)
    assert op10.deduplicated(frame.where("false")).count() == 0
    null = spark.createDataFrame([(None, passage), (1, passage), (1, passage), (1, "another text of this id")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in op10.deduplicated(null).collect()) == [(0, passage), (1, ""), (1, ""), (1, "another text of this id")]


# ---------------------------------------------------------------- all of them


def test_queries_are_registered():
    found = sorted(int(re.match(r"op(\d+)_", x)[1]) for x in registry.QUERIES)
    assert found == list(range(1, 11))


def test_pipeline(spark):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no pipeline")
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["text"]) for r in whole} == {(r["doc_id"], r["text"]) for r in now.collect()}
    model = op8.vocabulary(op8.VOCABULARY)
    assert all(model.decode(np.array(r["piece_ids"], dtype=np.int64)) == r["text"] for r in whole)
    assert 0 < len(whole) < docs.count()
