"""Operators on conversations, pages and vectors, and the pipeline's stages."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow.fs as pafs
import pytest

from geoloom.llm import chat, nearest, warc
from geoloom.llm.text import new_folder, open_folder


def cheapest(roles):
    """Least repair cost by trying every sequence of actions."""
    best = chat.FAR
    states = {chat.NOTHING: 0}
    for role in roles:
        new = {}
        for (s, cost), t in itertools.product(states.items(), range(4)):
            options = []
            if t in chat.NEXT[s]:
                options.append(0 if t == role else 3)
            if t == role and any(role in chat.NEXT[x] for x in chat.NEXT[s]):
                options.append(2)
            if s == t != chat.NOTHING:
                options.append(1 if s == role else 4)
            for c in options:
                new[t] = min(new.get(t, chat.FAR), cost + c)
        states = new
    for s, cost in states.items():
        best = min(best, cost + chat.CLOSING[s][0])
    return best


def chats():
    rng, rows = random.Random(6), []
    for c in range(60):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "tool", None, "user", "assistant"]), rng.choice(["hi", "", None, "x\ny"]), 1, 2))
    rows += [(99, i, "user" if i % 3 else "assistant", f"m{i}", 1, 2) for i in range(500)]
    return rows + [(99, 5, "user", "m5", 1, 2), (None, 0, "user", "lost", 1, 2), (None, None, "user", "lost", 1, 2)]


@pytest.mark.parametrize("chunk", [7, 4096])
def test_chat_repair(spark, chunk):
    rows = chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int, id int").repartition(3)
    got = {}
    for r in chat.repair_chats(df, chunk=chunk).orderBy("conv_id", "piece").collect():
        got.setdefault(r.conv_id, []).append(r)
    key = lambda r: tuple((x is not None, x) for x in r[1:4])
    for c, pieces in got.items():
        own = sorted((r for r in rows if r[0] == c), key=key)
        roles = [chat.ROLES.index(r[2]) + 1 if r[2] in chat.ROLES else 0 for r in own]
        assert sum(p.cost for p in pieces) == cheapest(roles)
        text = "".join(p.rendered for p in pieces)
        seq = [b.split("\n", 1)[0] for b in text.split("<|im_start|>")[1:]]
        assert seq[-1] == "assistant" and all(chat.ROLES.index(b) + 1 in chat.NEXT[chat.ROLES.index(a) + 1 if a else 0] for a, b in zip([None, *seq], seq))
        assert text.count("<|im_end|>") == len(seq) and [p.text for p in []] == []
        assert len([p for p in pieces if p.action in ("keep", "relabel", "merge")]) == len(own)
    assert set(got) == {r[0] for r in rows}
    assert chat.repair_chats(df.limit(0)).count() == 0


def test_chat_chunks_give_the_whole_trace():
    rng = random.Random(8)
    for _ in range(300):
        roles = [rng.randint(0, 3) for _ in range(rng.randint(1, 14))]
        whole = list(chat.render_chunk(roles, ["t"] * len(roles), *chat.join_chunks([chat.chunk_matrix(roles, (0, 1, 2, 3))])[0], True))
        cut = sorted(rng.sample(range(1, len(roles)), min(2, len(roles) - 1))) if len(roles) > 1 else []
        parts = [roles[a:b] for a, b in zip([0, *cut], [*cut, len(roles)])]
        ends = chat.join_chunks([chat.chunk_matrix(p, (0, 1, 2, 3)) for p in parts])
        pieces = [x for k, (p, e) in enumerate(zip(parts, ends)) for x in chat.render_chunk(p, ["t"] * len(p), *e, k == len(parts) - 1)]
        assert [x[1:] for x in pieces] == [x[1:] for x in whole]


def test_warc(spark):
    big, small = "<p>" + "é" * 200, "tiny"
    rows = [(5, "http://a/\r\nb", big, "x"), (3, None, big, "x"), (9, "u", big, "x"), (1, "u", small, "x"), (2, "u", small, "x"), (4, "u", None, "x"), (7, "u", "", "x"), (None, "u", big, "x"), (3, "again", big, "x"), (8, "u", "y" * 99 + "\r\n\r\n" * 3, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = new_folder(spark, "warc")
    index = warc.write_bundles(warc.with_types(pages), folder, frame_bytes=300)
    got = sorted((r.id is None, r.id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0, bytes(r.payload) if r.payload is not None else None) for r in warc.read_bundles(spark, folder).collect())
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        revisit = html == big and page != 3
        want.append((page is None, page or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else 0, None if revisit else data))
    assert got == sorted(want)
    files, base = open_folder(folder)
    for name in {r.file for r in index.collect()}:
        table = warc.read_seek_table(files.open_input_file(f"{base}/{name}"))
        assert table and isinstance(files, (pafs.LocalFileSystem, pafs.SubTreeFileSystem))
        with files.open_input_file(f"{base}/{name}") as f:
            data = f.read_at(table[0][1], table[0][0])
        assert warc._unpacker().decompress(data, max_output_size=table[0][2]).startswith(b"WARC/1.1")
    assert warc.with_types(pages.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((600, 16)).astype(np.float32)
    rows = [(i, v.tolist(), "q") for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist(), "q") for i in range(80)]  # a hot vector
    rows += [(2000, None, "q"), (2020, [0.0] * 16, "q"), (2040, [float("nan")] * 16, "q"), (2060, [None] + [1.0] * 15, "q"), (2080, [], "q"), (None, base[1].tolist(), "q"), (3, base[3].tolist(), "q"), (2100, [1.0] * 5, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, gid string").repartition(4)
    got = {}
    for r in nearest.nearest(df, lambda i: i % 20 == 0, leaf=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    known = {i: np.array(v + [0.0] * (16 - len(v)), np.float64) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(known))
    matrix = np.array([known[i] for i in ids])
    assert set(got) == {i for i in known if i % 20 == 0}
    hit = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        scores = matrix @ known[q]
        want = [int(ids[j]) for j in np.lexsort((ids, -scores)) if ids[j] != q][:20]
        hit += len(set(want) & {v for _, v, _ in found})
        total += 20
        assert all(s == pytest.approx(float(known[v] @ known[q]), abs=1e-9) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
    assert hit / total >= 0.9
    assert nearest.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    exact = {}
    for r in nearest.nearest(df, lambda i: i % 20 == 0, leaf=64, trees=3, target=1.0).collect():
        exact.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, found in exact.items():
        scores = matrix @ known[q]
        found.sort()
        want = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:20]
        assert [s for _, _, s in found] == pytest.approx(scores[want], abs=1e-9) and len(found) == 20
    fine = [[4.603992, 1e-9, 0.25], [4.603992 + 1e-9, 0.0, 0.25], [1e300, 0.0, 0.0]]
    doubles = spark.createDataFrame(list(enumerate(fine)), "vec_id long, embedding array<double>")
    got = nearest.nearest(doubles, lambda i: i == 0, target=1.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(j, sum(a * b for a, b in zip(fine[0], fine[j]))) for j in (2, 1)]
    forest = nearest.Forest((base * 3e37).astype(np.float32), 2, 64)  # squares beyond the range of floats
    assert len(np.unique(forest.leaves((base * 3e37).astype(np.float32))[:, 0])) == 1 << forest.depth
    assert np.array_equal(forest.leaves((base * 3e37).astype(np.float32)), nearest.Forest(base * 3e37 / 2.0**80, 2, 64).leaves(base * 3e37 / 2.0**80))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest.nearest(few, lambda i: i == 0).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(9)
    text = lambda n: " ".join(f"k{rng.randrange(400)}" for _ in range(n))
    item, passage, copied = text(30), text(60), text(80)
    rows = [(i, text(60) + (" awful" if i % 4 == 0 else ""), "en", "s", 1) for i in range(200)]
    rows += [(300, copied, "en", "s", 1), (301, copied, "en", "s", 1), (302, passage + " " + text(40), "en", "s", 1), (303, text(40) + " " + passage, "en", "s", 1), (304, text(50) + " " + item, "en", "s", 1), (305, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(P.STAGES)
    kept = {r.doc_id for r in stage["toxicity"](spark, docs, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows if not (r[0] < 200 and r[0] % 4 == 0)}
    kept = {r.doc_id for r in stage["near-dedup"](spark, docs, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows} - {301}
    cut = {r.doc_id: r for r in stage["substring dedup"](spark, docs.where("doc_id <> 301"), str(tmp_path)).collect()}
    assert set(cut) == {r[0] for r in rows} - {301} and len(cut[303].text.split()) == 40 and cut[303].n_chars == len(cut[303].text)
    assert all(cut[r[0]].text == r[1] for r in rows if r[0] not in (301, 303))
    kept = {r.doc_id for r in stage["decontamination"](spark, docs, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows} - {304}
    final = P.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == {r[0] for r in rows if not (r[0] < 200 and r[0] % 4 == 0)} - {301, 304}


def test_chat_order_does_not_depend_on_the_cuts(spark):
    """Equal turns and roles over several real partitions: texts stay in their order."""
    texts = [f"{random.Random(i).randrange(10**6):06d}" + "x" * (i % 400) for i in range(3000)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        df = spark.createDataFrame([(1, 0, "user", t) for t in texts], "conv_id long, turn long, role string, text string").repartition(8)
        got = chat.repair_chats(df, chunk=256).orderBy("piece").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    whole = "".join(r.rendered for r in got)
    at = [whole.index(t) for t in sorted(texts)]
    assert at == sorted(at)


def test_pipeline_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(i, f"w{i} " + " ".join(f"a{(i % 3) * 7 + k}" for k in range(80)), "en", "s", 9, "x", 1, True, 0.1) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long, kept string, cut_id long, gone boolean, toxic_score double")
    spark.createDataFrame([(i, 1, i % 2) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs.drop("kept", "cut_id", "gone", "toxic_score")
    for stage in (pipeline.drop_toxic, pipeline.drop_near_duplicates, pipeline.cut_repeats):
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        assert sorted(map(tuple, found.select(plain.columns).collect())) == sorted(map(tuple, stage(spark, plain, str(tmp_path)).collect()))
