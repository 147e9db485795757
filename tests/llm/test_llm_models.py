"""Classifier, language, sharding, WARC and token counts."""

import collections
import gzip
import hashlib

import numpy as np
import pytest

from tidelog.llm import op1_quality as op1
from tidelog.llm import op2_language as op2
from tidelog.llm import op6_warc as op6
from tidelog.llm import op7_sharding as op7
from tidelog.llm import op9_token_counts as op9
from tidelog.llm.common import fold, free, labelled_sample

SF = "/root/testdata/sf0.01"
CLASHING = "doc_id bigint, text string, score string, hash int, key string, slot int, w string"


def odd_documents(spark):
    """Nulls, an empty and a long text, repeated rows, clashing columns."""
    rows = [(1, "plain words here.", "a", 1, "k", 5, "w"), (1, "plain words here.", "a", 1, "k", 5, "w"), (None, "no id at all", None, None, None, None, None), (2, None, "b", 2, "", 0, ""), (3, "", "c", 3, "x", 1, "y"), (4, "ab é\n" * 30_000, "d", 4, "z", 2, "q")]
    return spark.createDataFrame(rows, CLASHING)


# ---------------------------------------------------------------- op1


def test_quality_on_held_out_rows(spark):
    out = op1.query(spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = out.where("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95
    assert out.where("score < 0 or score > 1 or score is null or (predicted = 1) <> (score >= 0.5)").count() == 0


def test_quality_network():
    good, bad = [b"a calm sentence, number %d." % i for i in range(60)], [b"LOUD!! WORDS!! %d!!" % i for i in range(60)]
    net = op1.Network().fit(good + bad, np.array([1.0] * 60 + [0.0] * 60), epochs=12)
    assert (net.scores(good) > 0.5).all() and (net.scores(bad) < 0.5).all()
    # filters over every chunk of a text: the whole, in segments, by brute force
    text = bytes(np.random.default_rng(0).integers(32, 120, 5_000, dtype=np.uint8))
    rows = op1.blocks(text)
    chunks = [np.concatenate([net.embed[rows[i]].ravel(), net.embed[rows[i + 1]].ravel()]) for i in range(len(rows) - 1)]
    want = (np.stack(chunks) @ net.filters.reshape(-1, op1.FILTERS)).max(axis=0)
    assert np.allclose(net.pooled([text])[0], want, atol=1e-4)
    old, op1.SEGMENT = op1.SEGMENT, 512
    try:
        assert np.allclose(net.pooled([text, b""])[0], want, atol=1e-4)
    finally:
        op1.SEGMENT = old
    late = b"a calm sentence. " * 40_000 + b"LOUD!! WORDS!! HERE!!"
    assert net.scores([late])[0] < net.scores([b"a calm sentence. " * 40_000])[0]  # the end of a long text counts


def test_quality_gradients():
    net = op1.Network(3)
    texts, target = [b"some words and more of them %d" % i for i in range(4)], np.array([1.0, 0.0, 1.0, 0.0])
    before = -np.log(np.where(target == 1, net.scores(texts), 1 - net.scores(texts))).mean()
    net.fit(texts, target, epochs=120)
    assert -np.log(np.where(target == 1, net.scores(texts), 1 - net.scores(texts))).mean() < before / 2


def test_quality_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id bigint, quality int")
    net = op1.train(docs, labels)
    out = op1.scored(docs, net).toPandas()
    assert len(out) == 6 and out.score.between(0, 1).all()
    assert abs(out[out.doc_id == 2].score.iloc[0] - out[out.doc_id == 3].score.iloc[0]) < 1e-6  # single precision, in batches of other sizes
    kept = op1.keep_good(docs, net)
    assert kept.columns == docs.columns
    none = op1.train(docs, labels.where("false"))
    assert set(op1.scored(docs, none).toPandas().score) == {0.5}
    assert op1.scored(docs.where("false"), none).count() == 0


# ---------------------------------------------------------------- op2


def test_language_on_held_out_rows(spark):
    out = op2.query(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(docs, "doc_id").toPandas()
    assert (held.lang_pred == held.lang).mean() > 0.97 and out.count() == 1000


def test_language_model():
    texts = {"xx": ["the cat and the dog"], "yy": ["der hund und die katze"], "zz": ["что это такое"]}
    model = op2.fit([f"{t} {i}" for ts in texts.values() for t in ts for i in range(20)], [k for k in texts for _ in range(20)], epochs=6)
    for lang, (text,) in texts.items():
        assert model.predict(text)[0] == lang
    for nothing in (None, "", "123 !?", "\n", "½ ²", "Ⅷ ① ٣", "\u0301"):
        assert model.predict(nothing) == ("und", 0.0)
    assert 0 < len(model.used) < 1 << op2.BITS
    # sums over the whole text, by brute force over the n-grams
    text = "the end of it"
    grams = np.concatenate([x for segment in op2.features(text) for x in segment])
    full = np.zeros((1 << op2.BITS, 3))
    full[model.used] = model.weights
    assert np.allclose(model.logits(text), model.level + full[grams].sum(axis=0) * op2.SCALE / len(grams), atol=1e-4)
    assert op2.fit([], []).predict("word") == ("und", 0.0)


def test_language_segments(monkeypatch):
    """A text that is longer than a segment has the n-grams, and the scores, that it has in one piece."""
    model = op2.fit(["the cat and the dog", "der hund und die katze"] * 10, ["xx", "yy"] * 10)
    text = "Die Katze und the ΣΊΣΥΦΟΣ \U0001f642 dog " * 40
    whole, want = [np.sort(np.concatenate(x)) for x in zip(*op2.features(text), strict=True)], model.logits(text)
    for size in (1, 2, 3, 7, 64, 1_000):
        monkeypatch.setattr(op2, "SEGMENT", size)
        assert all(np.array_equal(a, np.sort(np.concatenate(b))) for a, b in zip(whole, zip(*op2.features(text), strict=True), strict=True))
        assert np.allclose(model.logits(text), want)


def test_language_fit_is_ftrl():
    """Against a plain version of the published update, a coordinate at a time."""
    texts, langs = ["aa ab", "ba bb", "ab ab", "bb ba", "aa", "bb"], ["x", "y", "x", "y", "x", "y"]
    model = op2.fit(texts, langs, epochs=2, seed=5)
    chance = np.random.default_rng(5)
    order = chance.permutation(len(texts))
    held, seen = order[: len(order) // 5], order[len(order) // 5 :]
    counted = [collections.Counter(np.concatenate([x for s in op2.features(t) for x in s]).tolist()) for t in texts]
    often = collections.Counter(k for d in seen for k in counted[d])
    idf = {k: np.log((len(seen) + 1) / (n + 1)) + 1 for k, n in often.items()}
    z, n = collections.defaultdict(lambda: [0.0, 0.0]), collections.defaultdict(lambda: [0.0, 0.0])

    def weight(k, c):
        l1 = 0.0 if k == "bias" else op2.L1
        return 0.0 if abs(z[k][c]) <= l1 else -(z[k][c] - np.sign(z[k][c]) * l1) / ((op2.BETA + n[k][c] ** 0.5) / op2.ALPHA + op2.L2)

    for _ in range(2):
        for d in chance.permutation(seen):
            x = {k: op2.SCALE * idf.get(k, 0.0) * v / sum(counted[d].values()) for k, v in counted[d].items()} | {"bias": 1.0}
            w = {k: [weight(k, c) for c in (0, 1)] for k in x}
            e = np.exp([sum(w[k][c] * x[k] for k in x) for c in (0, 1)])
            p = e / e.sum()
            for k in x:
                for c in (0, 1):
                    g = (p[c] - (langs[d] == ["x", "y"][c])) * x[k]
                    z[k][c] += g - ((n[k][c] + g * g) ** 0.5 - n[k][c] ** 0.5) / op2.ALPHA * w[k][c]
                    n[k][c] += g * g
    assert len(held) == 1 and np.allclose(model.level, [weight("bias", c) for c in (0, 1)], atol=1e-6)
    got = dict(zip(model.used.tolist(), model.weights, strict=True))
    want = {k: [weight(k, c) * idf[k] for c in (0, 1)] for k in idf}
    assert set(got) == {k for k, v in want.items() if any(v)} and all(np.allclose(got[k], want[k], rtol=1e-4, atol=1e-5) for k in got)


def test_language_odd_rows(spark):
    docs = odd_documents(spark)
    model = op2.fit(["plain words", "autre chose"] * 8, ["en", "fr"] * 8)
    out = op2.identified(docs, model).toPandas()
    assert len(out) == 6 and set(out[out.doc_id.isin([2, 3])].lang_pred) == {"und"}
    assert op2.identified(docs.where("false"), model).count() == 0


def test_rare_labels_stay_in_the_sample(spark):
    sizes = {f"l{i}": 900 for i in range(8)} | {"rare": 30}
    rows = [(i * 10_000 + k, f"text {k}", name) for i, (name, n) in enumerate(sizes.items()) for k in range(n)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "x", "l0"), (1_000_000, None, "l1"), (1_000_001, "y", None), (1_000_002, "z" * 70_000, "long")], "doc_id bigint, text string, lang string")
    found = labelled_sample(docs.select("doc_id", "lang"), docs, "lang", 70, 400)
    counts = collections.Counter(r[2] for r in found)
    assert counts.pop("rare") == 30 and set(counts) == {f"l{i}" for i in range(8)} and all(39 <= n <= 41 for n in counts.values())
    assert found == labelled_sample(docs.repartition(7).select("doc_id", "lang"), docs.repartition(3), "lang", 70, 400)
    few = labelled_sample(docs.select("doc_id", "lang"), docs, "lang", 70, 5)
    assert len({r[2] for r in few}) == 9 and labelled_sample(docs.where("false"), docs, "lang", 70, 5) == []


def test_folds(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id bigint").select("doc_id", fold("doc_id", 3).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 3 for r in df)
    assert free(odd_documents(spark), "Score", "new", "NEW") == ["_Score", "new", "_NEW"]


# ---------------------------------------------------------------- op6


def test_arc_versions():
    http = b"HTTP/1.0 200 OK\nContent-Type: text/plain\n\nhello"
    one = b"http://a.example/x y 1.2.3.4 20010203040506 text/plain %d\n" % len(http) + http + b"\n"
    head = b"1 0 Some Archive\nURL IP-address Archive-date Content-type Archive-length\n\n"
    data = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain %d\n" % len(head) + head + b"\n" + one + one
    found = [r for _, r in op6.parse_file(gzip.compress(data))]
    assert len(found) == 2 and found[0].url == "http://a.example/x y" and found[0].block == http
    two = b"http://b.example/ 1.2.3.4 20010203040506 text/html 404 c l 12 f.arc 4\nbody\n"
    head = b"2 0 Some Archive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    data = b"filedesc://y.arc 0.0.0.0 20010101 text/plain 200 - - 0 y.arc %d\n" % len(head)
    assert op6.parse_record(two, 0, 2)[0] == op6.Arc("http://b.example/", "1.2.3.4", "20010203040506", "text/html", b"body")
    assert op6.iso("20010203040506") == "2001-02-03T04:05:06Z" and op6.iso("20010203") == "2001-02-03T00:00:00Z" and op6.iso("?") == "1970-01-01T00:00:00Z"
    with pytest.raises(ValueError, match="declares"):
        op6.parse_record(b"u 1.1.1.1 2001 t 99\nshort", 0, 1)
    with pytest.raises(ValueError, match="header"):
        op6.parse_record(b"not a line\n", 0, 1)
    with pytest.raises(ValueError, match="version block"):
        list(op6.parse_file(one))


def test_arc_files_to_warc(spark, tmp_path):
    payload = b"<p>" + b"same text " * 20 + b"</p>"
    head = b"1 0 Me\nURL IP-address Archive-date Content-type Archive-length\n"
    records = b"".join(b"http://h/%d 1.2.3.4 20010203040506 text/html %d\n" % (i, len(payload)) + payload + b"\n" for i in range(3))
    (tmp_path / "a.arc").write_bytes(b"filedesc://a.arc 0.0.0.0 20010101000000 text/plain %d\n" % len(head) + head + b"\n" + records)
    op6.convert(op6.read_arc(spark, str(tmp_path / "a.arc")), f"file://{tmp_path}/out")
    files = list((tmp_path / "out").glob("*.gz"))
    heads = [h for f in files for h, _ in op6.read_records(f.read_bytes())]
    assert sorted(h["warc-type"] for h in heads) == ["response", "revisit", "revisit"]
    assert {h["warc-date"] for h in heads} == {"2001-02-03T04:05:06Z"} and len({h["warc-record-id"] for h in heads}) == 3
    got = op6.resolved(op6.read_warc(spark, f"file://{tmp_path}/out", "string")).toPandas()
    assert set(got.payload_bytes) == {len(payload)} and set(got.payload_digest) == {hashlib.sha256(payload).hexdigest()}
    first = min(got.key)
    assert set(got[got.record_type == "revisit"].refers_to) == {first}


def test_pages_round_trip(spark, tmp_path):
    long_, short = "<html>" + "é\r\n\r\nWARC/1.1 " * 3_000, "tiny"
    rows = [(5, "http://a b/\n", long_, 1), (3, None, long_, 2), (9, "u", short, 3), (7, "u", short, 4), (2, "u", None, 5), (1, "u", "", 6), (None, "u", long_, 7), (3, "u", long_, 8)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload_digest int")
    op6.convert(op6.pages_to_arc(pages), f"file://{tmp_path}/w")
    got = op6.resolved(op6.read_warc(spark, f"file://{tmp_path}/w")).collect()
    want = collections.Counter()
    for page, _, html, _ in rows:
        data = (html or "").encode()
        refers = 3 if html == long_ and page not in (None, 3) else None
        want[(page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers)] += 1
    assert collections.Counter((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    op6.convert(op6.pages_to_arc(pages.where("false")), f"file://{tmp_path}/none")
    assert op6.resolved(op6.read_warc(spark, f"file://{tmp_path}/none")).count() == 0


# ---------------------------------------------------------------- op7


def test_table_is_even_and_steady():
    shards = tuple(f"s{i}" for i in range(7))
    before = op7.fill(shards, 1009)
    share = np.bincount(before)
    assert share.max() - share.min() <= 1
    after = op7.fill(shards[:-1], 1009)
    stayed = before != 6
    assert (before[stayed] == after[stayed]).mean() > 0.7
    assert (op7.fill(shards, 1009) == before).all()
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError, match="distinct"):
            op7.fill(bad, 1009)
    with pytest.raises(ValueError, match="prime"):
        op7.fill(("a",), 1000)


def test_table_by_turns():
    """The definition, slot by slot."""
    shards, slots = ("a", "b", "c"), 13
    lists = []
    for x in shards:
        d = hashlib.sha256(x.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        lists.append([(offset + j * skip) % slots for j in range(slots)])
    want, turn = {}, 0
    while len(want) < slots:
        k = turn % 3
        want[next(s for s in lists[k] if s not in want)] = k
        turn += 1
    assert op7.fill(shards, slots).tolist() == [want[s] for s in range(slots)]


def test_sharding_rows(spark):
    import xxhash

    docs = odd_documents(spark)
    out = op7.shard(docs, "doc_id").collect()
    owner = op7.fill(op7.SHARDS)
    assert len(out) == 6
    for r in out:
        h = xxhash.xxh64_intdigest("" if r["doc_id"] is None else str(r["doc_id"]), 42)
        slot = (h - (h >> 63 << 64)) % op7.SLOTS
        assert (r["slot"], r["shard"]) == (slot, op7.SHARDS[owner[slot]])
    assert op7.shard(docs.where("false"), "doc_id").count() == 0
    whole = op7.query(spark, SF)
    assert whole.count() == 1000 and whole.select("shard").distinct().count() == 64
    assert "Exchange hash" not in whole._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- op9


def brute(tokens, sections, rule):
    """Each token's bytes, one by one."""
    owner = [k for k, n in enumerate(sections) for _ in range(n)]
    out, at, crossing = [0.0] * len(sections), 0, 0
    for n in tokens:
        held = collections.Counter(owner[at : at + n])
        crossing += len(held) > 1
        if rule == "first":
            out[owner[at]] += 1
        elif rule == "most":
            out[max(held, key=lambda k: (held[k], -k))] += 1
        else:
            for k, c in held.items():
                out[k] += c / n
        at += n
    return out, crossing


@pytest.mark.parametrize("rule", ["first", "most", "share"])
def test_attribution(rule):
    chance = np.random.default_rng(4)
    for _ in range(60):
        tokens, total = chance.integers(1, 5, 12), 0
        total = int(tokens.sum())
        cuts = np.sort(chance.integers(0, total + 1, 4))
        sections = np.diff(np.concatenate([[0], cuts, [total]]))
        got, crossing = op9.attribute(np.cumsum(tokens), np.cumsum(sections), rule)
        want, many = brute(tokens.tolist(), sections.tolist(), rule)
        assert np.allclose(got, want) and crossing == many and np.isclose(got.sum(), len(tokens))
    with pytest.raises(ValueError, match="no rule"):
        op9.attribute(np.array([4]), np.array([2, 4]), "none")


def test_token_counts(spark):
    docs = odd_documents(spark).drop("key")
    out = {(r["doc_id"], r["n_bytes"]): r for r in op9.by_line(docs).collect()}
    encoding, _ = op9.encoder(op9.VOCABULARY)
    for (_, size), r in out.items():
        assert sum(r["section_tokens"]) == r["n_tokens"] and len(r["section_tokens"]) == r["n_sections"]
        if not size:
            assert r["n_sections"] == r["n_tokens"] == 0
    text = "ab é\n" * 30_000
    assert out[(4, len(text.encode()))]["n_tokens"] == len(encoding.encode_ordinary(text)) and out[(4, len(text.encode()))]["n_sections"] == 30_000
    assert op9.by_line(docs).count() == 6 and op9.by_line(docs.where("false")).count() == 0
    fields = op9.by_field(docs.where("doc_id in (1, 2)"), "doc_id", ["text", "score", "w"]).collect()
    assert all(len(r["section_tokens"]) == 3 for r in fields) and {r["n_bytes"] for r in fields} == {19, 1}
    assert op9.line_ends(b"a\n\nb").tolist() == [2, 3, 4] and op9.line_ends(b"a\n").tolist() == [2] and op9.line_ends(b"").tolist() == []


def test_special_names_are_text():
    assert op9.token_ends("<|endoftext|>")[-1] == 13 and len(op9.token_ends("<|endoftext|>")) > 1
