"""Near duplicates and repeated passages against brute force; the pipeline."""

import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sparkloom.llm import common, neardup, packing, suffixdedup

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, key long, node string, root int, size double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n", 2, 0.5) for i, t in rows], SCHEMA)


def shingle_set(text):
    import re

    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, root = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for g in s:
            by_shingle[g].add(k)
    for k, (i, s) in enumerate(sets):
        for m in {m for g in s for m in by_shingle[g] if m < k}:
            j, t = sets[m]
            if 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 400)) for _ in range(n)]


def near_rows(seed):
    """Groups of copies with 0 to 12 edits, documents around one passage, and chains."""
    rng, rows, base = random.Random(seed), [], None
    for g in range(4):
        base = words(rng, 60 + 20 * g)
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = "edit" + str(rng.randint(0, 10**6))
            rows.append(" ".join(own))
    passage = words(rng, 40)
    rows += [" ".join(words(rng, rng.randint(0, 60)) + passage + words(rng, rng.randint(0, 60))) for _ in range(80)]
    chain = words(rng, 80)
    for _ in range(12):
        chain = chain[3:] + words(rng, 3)
        rows.append(" ".join(chain).title())
    rows += [" ".join(words(rng, 70)) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, block, split, rounds", [(1, 512, 1 << 14, 6), (2, 16, 1 << 14, 1), (3, 16, 10, 0)])
def test_near_duplicates(spark, seed, block, split, rounds, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SPLIT", split)
    monkeypatch.setattr(neardup, "MAX_ROUNDS", rounds)
    rows = near_rows(seed)
    assert sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()) == brute_components(rows)


@pytest.mark.parametrize("seed, rounds", [(1, 6), (2, 1), (4, 0)])
def test_near_duplicates_where_ids_repeat_with_several_texts(spark, seed, rounds, monkeypatch):
    """An id's texts are one document: it joins what each of them is linked with, also an empty one."""
    monkeypatch.setattr(neardup, "MAX_ROUNDS", rounds)
    rows = [(i // 3, t) for i, t in near_rows(seed)] + [(0, ""), (7, None), (500, ""), (500, "one two three")]
    assert sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()) == brute_components(rows)


def test_collisions_equal_brute_force():
    rng = np.random.default_rng(4)
    for n, m, values in ((40, 50, 3), (1, 9, 2), (30, 30, 40)):
        a, b = (rng.integers(0, values, (k, neardup.COORDINATES)).astype(np.uint32) for k in (n, m))
        a[:, :8] = b[:, :8] = 5  # lists that all are in
        assert (neardup.collisions(a, b) == (a[:, None] == b[None]).sum(2)).all()


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "ONE\ttwo"), (10, "one two three"), (11, long), (12, long + " x"), (13, long), (13, long), (13, "other text of six whole words"), (3, "É é a b c d"), (4, "é é a b c d")]
    found = neardup.near_duplicates(frame(spark, [*rows, (None, long)]))
    got = defaultdict(set)
    for r in found.collect():
        got[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert found.count() == len(rows)
    assert {i: got[i] for i in (3, 4, 5, 6, 7, 8, 9, 10)} == {3: {(3, True)}, 4: {(4, True)}, 5: {(5, True)}, 6: {(6, True)}, 7: {(7, True)}, 8: {(8, True)}, 9: {(8, False)}, 10: {(10, True)}}
    assert (11, False) in got[12] and (11, False) in got[13]
    assert neardup.near_duplicates(frame(spark, []).where("false")).count() == 0
    kept = neardup.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and {r["doc_id"] for r in kept.collect()} >= {3, 4, 5, 8, 10, 11}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            m = min(root[a], root[b])
            root[a] = root[b] = m
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in root} == root


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.75, 0.9):
        pool = rng.integers(0, 1 << 62, 3000, np.uint64)
        cut = int(3000 * (1 - share) / 2)
        a, b = np.unique(pool[cut:]), np.unique(pool[: 3000 - cut])
        (x, s), (y, t) = neardup.signature(a), neardup.signature(b)
        assert abs(np.mean(np.frombuffer(s, np.uint8) == np.frombuffer(t, np.uint8)) - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.13
        assert np.sum(np.frombuffer(x, np.uint64) == np.frombuffer(y, np.uint64)) >= (neardup.MATCHES if share >= 0.75 else 0)


# --- repeated passages


def brute_removal(rows):
    """(id, bytes, removed, spans, hash) of each row."""
    first, masks = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        masks.append((i, len(data), int(gone.sum()), spans, sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(masks)


def passage_rows(seed, n=120):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgé ß日\n\0") for _ in range(n))
    passages = [text(rng.randint(30, 160)) for _ in range(8)]
    rows = [(rng.randint(0, 3 * n), text(rng.randint(0, 80)) + rng.choice(passages)[rng.randint(0, 20) :] + text(rng.randint(0, 60)) + rng.choice(passages)) for _ in range(n)]
    rows += [(1000 + i, "z" * (40 + i)) for i in range(20)] + [(2000 + i, "ab" * (20 + i)) for i in range(20)] + [(3000, rows[0][1]), (3001, rows[0][1]), (3001, rows[0][1])]
    return rows


def in_process(rows, batches, buckets):
    """The three deals without Spark, so that module constants can be changed."""
    tables = {}
    for b in range(batches):
        own = [(i, t) for i, t in rows if i % batches == b]
        tables[b] = pa.table({"__batch": pa.array([b] * len(own), pa.int64()), "__id": pa.array([i for i, _ in own], pa.int64()), "__text": pa.array([t for _, t in own], pa.string())})
    none = pa.table({"batch": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        first.setdefault(t, i)
    copies = [(i % batches, suffixdedup.COPIES, i.to_bytes(8, "big")) for i, t in rows if len((t or "").encode()) >= 50 and first[t] < i]
    replies = pa.table({"batch": [c[0] for c in copies], "kind": pa.array([c[1] for c in copies], pa.int32()), "payload": pa.array([c[2] for c in copies], pa.binary())}) if copies else none

    def deal(send, answer, given):
        sent = pa.concat_tables([send(t, given.filter(pa.compute.equal(given["batch"], b)), buckets) for b, t in tables.items()])
        out = [given]
        for bucket in set(sent["bucket"].to_pylist()):
            out.append(answer(sent.filter(pa.compute.equal(sent["bucket"], bucket))).cast(none.schema))
        return pa.concat_tables([t.cast(none.schema) for t in out])

    import pyarrow.compute  # noqa: F401

    shared = deal(suffixdedup._send_anchors, lambda t: suffixdedup._answers(suffixdedup.shared_anchors(t), suffixdedup.SHARED), replies)
    found = deal(suffixdedup._send_items, lambda t: suffixdedup._answers(suffixdedup.answer_items(t), suffixdedup.FOUND), shared)
    found = found.filter(pa.compute.not_equal(found["kind"], suffixdedup.SHARED))
    out = [suffixdedup._digest(t, found.filter(pa.compute.equal(found["batch"], b))) for b, t in tables.items() if t.num_rows]
    return sorted(tuple(r.values()) for t in out for r in t.to_pylist())


@pytest.mark.parametrize("seed, hot, batch_windows, block, batches", [(1, 20_000, 1 << 18, 1 << 19, 3), (2, 2, 200, 64, 5), (3, 0, 17, 1 << 19, 1)])
def test_removal_in_process(monkeypatch, seed, hot, batch_windows, block, batches):
    """Also with every anchor hot, tiny suffix arrays (many levels) and blocks that cut documents."""
    monkeypatch.setattr(suffixdedup, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(suffixdedup, "BATCH_WINDOWS", batch_windows)
    monkeypatch.setattr(suffixdedup, "BATCHES", 1 << 30)
    monkeypatch.setattr(suffixdedup, "_BLOCK", block)
    rows = passage_rows(seed)
    assert in_process(rows, batches, 4) == brute_removal(rows)


def test_suffix_arrays_and_merge():
    rng = random.Random(6)
    text = np.frombuffer("".join(rng.choice("ab\0") * rng.randint(1, 30) for _ in range(200)).encode(), np.uint8)
    at = np.array(sorted(rng.sample(range(len(text) - 49), 900)))
    order, new = suffixdedup.suffix_array(text, at)
    array = at[order]
    window = lambda p: text[p : p + 50].tobytes()
    assert array.tolist() == sorted(at.tolist(), key=lambda p: (window(p), p))
    assert new.tolist() == [True] + [window(p) != window(q) for p, q in zip(array[1:], array, strict=False)]
    a, b = (x[suffixdedup.suffix_array(text, x)[0]] for x in (at[:500], at[500:]))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffixdedup, "MERGE", 7)
        parts = list(suffixdedup.merged(text, a, b))
    assert len(parts) > 50
    assert [window(p) for part, _ in parts for p in part] == [window(p) for p in array]


def test_suffix_family_levels(monkeypatch):
    """Forty batches of one text: what is found, and few levels of falling size that hold each window once."""
    monkeypatch.setattr(suffixdedup, "MERGE", 16)
    rng, seen = random.Random(1), {}
    texts = ["".join(rng.choice(("x" * 20, "y" * 17, "z" * 9)) for _ in range(8)).encode() for _ in range(40)]
    ends = np.cumsum([len(t) for t in texts])
    family = suffixdedup.SuffixFamily(np.frombuffer(b"".join(texts), np.uint8), ends, np.arange(40))
    most = 0
    for doc, t in enumerate(texts):
        lo, own = int(ends[doc]) - len(t), [t[k : k + 50] for k in range(len(t) - 49)]
        found = family.add(lo, int(ends[doc]), lo + np.arange(len(own)), np.full(len(own), doc))
        assert found.tolist() == [seen.get(w, doc) < doc for w in own]
        for w in own:
            seen.setdefault(w, doc)
        sizes = [len(x) for x in family.levels]
        most = max(most, len(sizes))
        assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert most >= 3


def test_removal_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in suffixdedup.op9_suffix_array_dedup(spark, SF).collect()) == brute_removal(rows)


def test_removal_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 49), (5, "x" * 49), (6, "é" * 40), (7, "a" + "é" * 40), (8, "日本" * 5000), (9, "日本" * 4000 + "z"), (9, "日本" * 4000 + "z"), (-3, "q" * 60), (10, "q" * 70)]
    found = suffixdedup.removal_digest(frame(spark, [*rows, (None, "q" * 60)]))
    assert sorted(tuple(r) for r in found.collect()) == brute_removal(rows)
    assert suffixdedup.removal_digest(frame(spark, []).where("false")).count() == 0
    cut = suffixdedup.without_repeats(frame(spark, rows))
    assert cut.columns == frame(spark, rows).columns
    texts = defaultdict(set)
    for r in cut.collect():
        texts[r["doc_id"]].add(r["text"])
    assert texts[1] == {None} and texts[2] == {""} and texts[5] == {"x" * 49} and texts[7] == {"a"} and texts[9] == {"z"} and texts[10] == {""}


def test_removal_where_one_id_has_a_third_of_the_rows(spark, monkeypatch):
    """Its texts go to many batches; none of them matches another of them, all are judged against smaller ids."""
    monkeypatch.setattr(suffixdedup, "BATCH_BYTES", 2000)
    rng = np.random.default_rng(8)
    passages = ["".join(rng.choice(list("abcdefgh "), 70)) for _ in range(12)]
    text = lambda: " ".join([passages[rng.integers(12)], "".join(rng.choice(list("xyzw "), 60)), passages[rng.integers(12)]])
    rows = [(50 if k % 3 == 0 else k, text()) for k in range(120)]
    rows += [(50, rows[4][1]), (50, rows[100][1])]
    found = suffixdedup.removal_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(brute_removal(rows))


def test_removal_where_an_id_has_a_copy_and_another_text(spark):
    """Only the copy goes whole; the other text stays, and its passages are found in later documents."""
    rng = random.Random(4)
    a, b, c = ("".join(rng.choice("abcdefghij klmnop") for _ in range(120)) for _ in range(3))
    rows = [(-7, a), (1, a), (2, a), (2, b), (3, c + b), (-5, c), (-5, a)]
    assert sorted(tuple(r) for r in suffixdedup.removal_digest(frame(spark, rows)).collect()) == brute_removal(rows)
    cut = sorted((r["doc_id"], r["text"]) for r in suffixdedup.without_repeats(frame(spark, rows)).collect())
    assert cut == [(-7, a), (-5, ""), (-5, c), (1, ""), (2, ""), (2, b), (3, "")]


# --- the pipeline


def test_pipeline(spark):
    docs = common.documents(spark, SF)
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = common.materialize(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.keys() <= ids
        ids = set(after)
        if name == "near_duplicates":
            assert ids == {i for i, *_, kept in brute_components(before) if kept}
        if name == "repeated_passages":
            wanted = {r[0]: r for r in brute_removal(before)}
            for i, t in before:
                n = wanted[i][1] - len(after[i].encode())
                assert n <= wanted[i][2] and (n == wanted[i][2] or not t.isascii())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in rows} == ids
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r)[:5] for r in rows)
    assert packing.solve({}, 5) == []


def test_pipeline_keeps_clean_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = common.documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = common.materialize(stage(spark, docs, SF), "stage")
    kept = {r["doc_id"] for r in docs.collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.99 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated ids, columns that are named like internal ones, no labels; and an empty table."""
    good = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = [(i, t, "en", "s", len(t), "x", 1) for i, t in good] + [(good[0][0], good[0][1], "en", None, 1, None, None), (good[1][0], good[2][1], None, "s", 2, "y", 2)]
    rows += [(None, good[3][1], "en", "s", 5, "z", 3), (901, None, "en", "s", 0, "z", 3), (902, "", None, None, None, None, None), (903, "①② 123", "fr", "s", 6, "z", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, root int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    docs = common.documents(spark, f"{tmp_path}/odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, f"{tmp_path}/odd"), name)
        assert docs.schema.names == [c.split()[0] for c in schema.split(", ")]
    left = {r["doc_id"] for r in docs.collect()}
    assert left <= {i for i, _ in good} and len(left) > 10
    placed = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert {r["doc_id"] for r in placed.collect()} == left
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
