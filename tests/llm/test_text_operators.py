"""Operators on documents, against brute force and on the awkward cases: nulls, empties, ties, repeats, extra columns."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geoloom.llm import bpe, class_lm, decontaminate, minhash_dedup, records, repeats, substring_dedup, toxicity
from geoloom.llm.text import Words, new_folder

SCHEMA = "doc_id long, text string, id string, batch int, keys string, n long, score string"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().split()


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    run = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = run(60)
    base = run(200)
    near = base.split()
    near[100] = "CHANGED"
    texts = [base, base, " ".join(near), run(40) + " " + passage + "\t" + run(30), passage + "  " + run(5), run(80).upper(), "", None, "one", "two words", " \n ", run(49), run(50), run(4000), "a b " * 60, base + " x", "é\x85 ü <|endoftext|> 'll 　 日本 don't  " + run(3)]
    return [(i, t, "x", 1, "k", 2, "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_substring_dedup(docs, nothing):
    rows = corpus()
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                keep[i : i + 50] = [False] * 50
        assert got[d].n_words == len(w) and got[d].n_removed == len(w) - sum(keep)
        assert got[d].kept.encode() == b" ".join(x for x, k in zip(w, keep) if k)
        covered = [False] * len(w)
        for a, b in got[d].removed:
            covered[a:b] = [True] * (b - a)
        assert covered == [not k for k in keep]
    assert got[1].n_removed == 200 and got[4].n_removed == 60
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_substring_dedup_null_ids_and_equal_ids(spark):
    text = " ".join(f"v{i}" for i in range(60))
    got = substring_dedup.substring_dedup(spark.createDataFrame([(3, text), (3, text), (None, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, 0), (True, 60)]


def test_substring_dedup_deals_rows_of_one_id(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"n{i} {passage}") for i in range(1500)] + [(7, f"s{i} {passage} {i}") for i in range(1500)] + [(3, f"first {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    batches = repeats.with_batch(df, 256, "doc_id", "text").where("doc_id IS NULL").groupBy("batch").count()
    assert batches.count() > 200 and batches.agg({"count": "max"}).first()[0] < 40
    got = substring_dedup.substring_dedup(df).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(None, 61, 60, 1500), (7, 62, 60, 1500), (3, 61, 0, 1)}
    with pytest.raises(TypeError, match="whole numbers"):
        substring_dedup.substring_dedup(df.selectExpr("cast(doc_id AS string) AS doc_id", "text"))


@pytest.mark.parametrize("n, share", [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates(docs, nothing, n, share):
    rows = corpus()
    sets = {d: shingles(t, n) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and share[1] * both >= share[0] * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs, words=n, share=share).collect()}
    assert got == {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}
    assert minhash_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_chain(spark):
    """A chain of edits: neighbours are linked, ends are not; many documents fail against their bucket's centre."""
    rng = random.Random(1)
    text, rows = [f"t{i}" for i in range(300)], []
    for d in range(40):
        rows.append((d, " ".join(text)))
        for _ in range(5):
            text[rng.randrange(300)] = f"n{d}-{rng.random()}"
    sets = {d: shingles(t, 3) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, share=(85, 100), block=8)
    assert {r.doc_id: r.component_id for r in got.collect()} == {d: root(d) for d in sets}


def test_decontaminate(docs, nothing, spark):
    rows = corpus()
    long = rows[13][1].split()
    items = [(0, " ".join(long[1000:1040])), (1, " ".join(long[10:22]).upper()), (2, "never seen at all in any of these"), (3, "one"), (4, ""), (5, None), (6, " ".join(long[2000:2010] + ["odd"] + long[2011:2060]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t, *_ in rows:
        own = shingles(t, 5)
        for i, item in items:
            s = shingles(item, 5)
            if s and 100 * len(s & own) >= 80 * len(s):
                want.add((d, i, len(s & own), len(s)))
    got = {tuple(r) for r in decontaminate.contained_items(docs, bench).collect()}
    assert got == want and {x[:2] for x in want} >= {(13, 0), (13, 1), (13, 6), (8, 3)}
    assert {tuple(r) for r in decontaminate.contained_items(docs, bench, block_bytes=200).collect()} == want
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {x[0] for x in want}
    assert decontaminate.contained_items(nothing, bench).count() == 0
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0


def test_bpe_round_trip(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for d, t, *_ in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[d].ids == ids and got[d].text == library.decode(ids, skip_special_tokens=False)
    assert {r.doc_id: (r.ids, r.text) for r in bpe.round_trip(docs, path).collect()} == {d: (r.ids, r.text) for d, r in got.items()}
    assert bpe.decode(bpe.encode(nothing, path), path).count() == bpe.round_trip(nothing, path).count() == 0


def test_bpe_fragments_equal_the_library_on_random_text():
    rng = random.Random(3)
    bits = ["a", "B", "é", " ", "  ", "\n", "\t", " ", "　", "'", "'s", "'ll", "$", "1", "<|endoftext|>", "<|startoftext|>", "漢", "😀", "́", "İ", "Σ", ".", "\r\n", "\x1c", "\x85", "x" * 60, "don't"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder, library = bpe.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        library.no_truncation()
        library.no_padding()
        assert coder.cutting == ("pairs" if name.startswith("byte") else "words")
        for _ in range(2):  # the second time from what is known
            ids, counts = coder.encode([t.encode() for t in texts])
            for got, want in zip(np.split(ids, np.cumsum(counts)[:-1]), library.encode_batch(texts, add_special_tokens=False), strict=True):
                assert got.tolist() == want.ids


def test_other_tokenizers_go_to_the_library(tmp_path):
    spec = json.loads(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())
    spec["normalizer"]["normalizers"].pop()
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    coder, library = bpe.Encoder(str(path)), Tokenizer.from_file(str(path))
    texts = ["Some Words", "", "some words"]
    ids, counts = coder.encode([t.encode() for t in texts])
    assert coder.cutting == "texts"
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_known_fragments_outgrow_their_table():
    rng = random.Random(8)
    coder = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    coder.known = bpe.Known(64)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 24))) + " b" for _ in range(300)]
    for a in range(0, 300, 50):
        ids, counts = coder.encode([t.encode() for t in texts[a : a + 50]])
        want = coder.tokenizer.encode_batch(texts[a : a + 50], add_special_tokens=False)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [w.ids for w in want]
    assert 0 < coder.known.held <= 32


def test_words_of_one_pattern_differ():
    signs = [0]
    for _ in range(10):
        signs += [1 - x for x in signs]
    one, other = ("".join("ab"[x ^ y] for x in signs) for y in (0, 1))
    found = Words([one.encode(), other.encode()], lower=False)
    assert len(one) == 1024 and found.hashes[0] != found.hashes[1]


def test_a_very_long_text_has_its_words():
    text = b"word " * 6_000_000
    found = Words([text], lower=True)
    assert len(found.start) == 6_000_000 and len(set(found.hashes.tolist())) == 1
    assert len(Words([b"x" * 30_000_000], lower=False).hashes) == 1


def test_records(docs, nothing, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    folder = new_folder(spark, "records")
    index = records.write_records(docs, folder, path, end_id=2)
    got = {r.doc_id: r for r in records.with_starts(records.read_records(spark, folder), index).collect()}
    start = 0
    for d, t, *_ in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(got[d].ids, "<u4").tolist() == ids and got[d].start == start
        start += len(ids)
    empty = new_folder(spark, "records")
    records.write_records(nothing, empty, path, end_id=2)
    assert records.read_records(spark, empty).count() == 0


def test_record_checksums():
    assert records.crc32c(b"123456789", [9])[0] == 0xE3069283
    parts = [b"", b"a", b"b" * 255, b"c" * 256, b"d" * 1000]
    assert records.unframe(records.frame(parts)) == parts
    broken = bytearray(records.frame(parts))
    broken[-8] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(broken))


def test_class_lm(spark):
    rng = random.Random(2)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(60))) for i in range(300)] + [(900, ""), (901, None), (902, "UNSEEN " * 3), (None, "a1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = class_lm.score_corpus(docs, n_classes=8, core=60, head=70).collect()
    assert len(got) == len(rows)
    tokens = {d: [w.lower() for w in (t or "").split()] + [None] for d, t in rows}
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    counts = {}
    for d, t in tokens.items():
        for x in t if d is not None and not held[d] else []:
            counts[x] = counts.get(x, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    base = model = n = 0.0
    for r in got:
        t = tokens[r.doc_id]
        want = sum(np.log10((counts.get(x, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for x in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(x in counts for x in t), total)
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0
        if r.held_out:
            base, model, n = base + r.base_score, model + r.score, n + r.n_tokens
    assert model / n > base / n + 0.15  # the classes tell the two halves apart


def test_class_lm_classes_for_all_words(spark):
    """The broadcast head is for speed alone, and scores follow from the table of classes, rare and unseen words too."""
    rng = random.Random(3)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice((a if i % 2 else b)[: rng.choice((5, 40))]) for _ in range(60))) for i in range(120)] + [(900, ""), (901, None), (902, "new a39 a38 new new b7"), (903, "a39")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole, small = ({r.doc_id: r for r in class_lm.score_corpus(docs, n_classes=4, core=9, head=head).collect()} for head in (1000, 9))
    assert len(whole) == len(rows)
    texts = class_lm._texts(docs.where(~class_lm.held_out()), "doc_id", "text")
    models = [class_lm.fit(texts, n_classes=4, core=9, head=head) for head in (1000, 9)]
    tables = [{r.word: (r.n, r.cls) for r in m["classes"].collect()} for m in models]
    assert tables[0] == tables[1] and models[0]["move"] == pytest.approx(models[1]["move"])
    hashes = {d: class_lm.tokens([(t or "").encode()])[0].view(np.int64).tolist() for d, t in rows}
    end, table, k, counts = int(class_lm.END.view(np.int64)), tables[0], 4, np.zeros((5, 5))
    training = [h for d, h in hashes.items() if zlib.crc32(str(d).encode()) % 10]
    assert set(table) == {w for h in training for w in h} and {c for _, c in table.values()} <= set(range(4))
    for h in training:
        for x, y in zip([end, *h], h):
            counts[table[x][1], table[y][1]] += 1
    move = np.log10((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.5))
    class_n, class_v = ([sum(f(n) for n, c in table.values() if c == i) for i in range(5)] for f in (int, bool))
    for d, h in hashes.items():
        want = 0.0
        for x, y in zip([end, *h], h):
            (_, c), (n, e) = table.get(x, (0, k)), table.get(y, (0, k))
            want += move[c, e] + np.log10((n + 0.1) / (class_n[e] + 0.1 * (class_v[e] + 1)))
        assert whole[d].score == pytest.approx(want, rel=1e-9) and small[d].score == pytest.approx(want, rel=1e-9)
        assert whole[d].base_score == pytest.approx(small[d].base_score) and whole[d].n_known == small[d].n_known == sum(w in table for w in h)


def test_class_lm_without_training_text(spark):
    assert class_lm.score_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exchange_finds_alternating_classes():
    pairs = np.zeros((10, 10))
    pairs[:3, 3:] = 4
    pairs[3:, :3] = 4
    found = class_lm.exchange(pairs, 2)
    assert len(set(found[:3])) == 1 and len(set(found[3:])) == 1 and found[0] != found[9]


def test_toxicity(spark):
    rng = random.Random(4)
    fine, bad = [f"fine{i}" for i in range(200)], ["vile1", "vile2", "vile3"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(fine) for _ in range(rng.randint(5, 60))]
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), None))
        labels.append((i, int(i % 5 == 0)))
    rows += [(600, None, 1), (601, "", 1), (None, "fine1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    labelled = spark.createDataFrame(labels + [(None, 1), (602, None)], "doc_id long, toxic int")
    model = toxicity.train(docs.where(~toxicity.held_out()), labelled)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.97
    assert len(model["slots"]) < 2000
    none = toxicity.train(docs.limit(0), labelled)
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_held_out_labels_use_up_no_bound(spark, monkeypatch):
    import inspect

    from geoloom.llm.queries import QUERIES

    taken, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda docs, labels, **k: taken.append(labels) or train(docs, labels, **k))
    QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.001")
    assert taken[0].count() and not taken[0].where(toxicity.held_out()).count()
    assert inspect.signature(train).parameters["max_train"].default == 40_000


def test_digest_queries_name_their_columns():
    from geoloom.llm.queries import ORACLES, QUERIES

    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
