"""Licences, language, BPE, quality, token files, packing."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import bpe, common, langid, licenses, packing, quality, tokenfile, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score double, shard string"
ODD = ["", "  a  b\n\n c ", "Don't 'll x'S _foo__bar 12x3 ª²½ ﬁ İ", "a\x1cb \x85 c\xa0d", "<|endoftext|> hi<|startoftext|>", "日本語 text", "é é ΑΣ ΣΑΣ", "x" * 3000, "\t\r\n x\x0b\x0cy  ", "ab" * 200, "😀👍🏽 a😀", "<|endoftext|", "क्षि ①② Ⅷ"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that are named like internal ones."""
    rows = [(i, t, "en", 0.5, "s") for i, t in enumerate(ODD)] + [(1, "again", None, None, None), (1, "again", None, None, None), (None, "no id", "en", 1.0, "x"), (99, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def kept(odd):
    return [r for r in odd.collect() if r["doc_id"] is not None]


# --- licences


def test_license_lines(spark):
    text = "Some words here.\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.\nreleased UNDER the mit license"
    docs = spark.createDataFrame([(1, text), (2, "nothing to see"), (3, None), (4, "Released under the MIT License, friends."), (None, text)], "doc_id long, text string")
    assert {(r["doc_id"], r["license_id"], r["n_lines"], r["dice"]) for r in licenses.scan(docs).collect()} == {(1, "MIT", 2, 1.0), (1, "GPL-3.0", 1, 1.0), (4, "MIT", 1, 8 / 9)}


def test_full_license_text(spark):
    for name, text in licenses.TEMPLATES:
        broken = text.replace(". ", ".\n", 2)
        found = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD).scan(f"Preface.\n\n{broken}\n\nMore")
        assert name in found and found[name][1] > 0.9, name


def test_licenses_within_longer_documents():
    t, rng = licenses.Templates(licenses.TEMPLATES + licenses.TEXTS, licenses.THRESHOLD), random.Random(3)
    prose = [" ".join(f"{rng.choice('river stone cloud field house'.split())}{rng.randrange(50)}" for _ in range(200)) for _ in range(2)]
    mit = max((text for name, text in licenses.TEMPLATES if name == "MIT"), key=len).replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    assert t.scan(f"{prose[0]}\n\n{mit}\n\n{prose[1]}") == {"MIT": (0, 1.0)}
    assert t.scan("We like it. Licensed under the Apache License, Version 2.0. Please enjoy.") == {"Apache-2.0": (0, 1.0)}
    assert t.scan(f"{prose[0]} This work is licensed under the GNU General Public License, version 3. {prose[1]}") == {"GPL-3.0": (0, 1.0)}
    for name, text in licenses.TEXTS:
        words = text.split()
        wrapped = "\n".join(" ".join(words[i : i + 12]) + "\n" * (i % 5 == 0) for i in range(0, len(words), 12))
        assert set(t.scan(f"{prose[0]}\n{wrapped}\n{prose[1]}")) == {name}
        assert set(t.scan(f"{prose[0]}\n{wrapped}\n{prose[1]}".replace("\n", "\r\n"))) == {name}
    for text in (mit, mit.replace("\n", "\r\n"), f"Title\r\n\r\n{mit}".replace("\n", "\r\n")):
        assert t.scan(text)["MIT"][1] > 0.95


def test_license_pruning_loses_nothing():
    rng, vocabulary = random.Random(2), "released under the mit license a b version of this work is licensed gnu".split()
    t = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14)))
        own, wanted = licenses.bigrams(licenses.words_of(text)), {}
        for name, b in t.sets:
            dice = 2 * len(own & b) / (len(own) + len(b))
            if 100 * dice >= licenses.THRESHOLD - 1e-9:
                wanted[name] = max(dice, wanted.get(name, 0))
        best = {n: d for n, d in wanted.items() if d == max(wanted.values())}
        assert {n: d for n, (_, d) in t.scan(text).items()} == best


def test_license_oracle(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    wanted = {tuple(r) for r in c.sql(licenses.ORACLE_SQL).fetchall()}
    assert {tuple(r) for r in licenses.op1_license_scan(spark, SF).collect()} == wanted and wanted


def test_licenses_of_odd_rows(odd, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    assert licenses.scan(odd, []).count() == 0


# --- language


def test_language_of_held_out_documents(spark):
    rows = langid.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and len(rows) == 200
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) > 20
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_backs_off():
    rows = [("xx", "kaka", 5), ("xx", "kamu", 3), ("yy", "zozo", 5), ("yy", "zoru", 4), ("yy", "rare", 1)]
    model = langid.build_model(rows)
    assert "rare" not in model.words  # below the count of the vocabulary: n-grams only
    predict = langid.Predictor(model, limit=2).predict
    assert predict("kaka")[0] == "xx" and predict("zozo zozo")[0] == "yy"
    assert predict("kakamu")[0] == "xx" and predict("ruzo zoz KAK zozozo")[0] == "yy"
    assert predict("123 !!") == ("und", 0.0) and predict(None) == ("und", 0.0) and predict("") == ("und", 0.0)
    assert predict("qqq")[1] == pytest.approx(0.5)


def test_letters_are_of_category_l():
    model = langid.build_model([("xx", "abc", 5), ("yy", "zoz", 5)])
    for text in ("①② ½", "²", "Ⅷ", "٣ 5", "_", "〇"):
        assert langid.Predictor(model).predict(text) == ("und", 0.0), text
    assert langid.words_of("a①b Ⅷc ªx ﬁ 日本") == ["a", "b", "c", "ªx", "ﬁ", "日本"]


def test_many_languages(spark):
    words = {f"l{i:03d}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in ("ka", "lo", "mi")] for i in range(600)}
    docs = spark.createDataFrame([(k, " ".join(own * 3), lang) for k, (lang, own) in enumerate(words.items())], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert [found[k] for k in range(600)] == list(words)


def test_language_query_equals_brute_force(spark):
    """Dense tables of add-half log frequencies, counted from all documents of the training split."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    cut = lambda t: re.findall(r"(?:(?![\d_])\w)+", (t or "").lower())
    train = [(cut(t), lang) for i, t, lang in docs if lang and t and zlib.crc32(str(i).encode()) % 5]
    langs = sorted({lang for _, lang in train})
    count = {lang: Counter(w for own, x in train if x == lang for w in own) for lang in langs}
    vocabulary = {w for c in count.values() for w in c if sum(d[w] for d in count.values()) >= 2}

    def grams(w, n):
        w = f"\x02{w}\x03" if n > 1 else w
        return [w[i : i + n] for i in range(len(w) - n + 1)]

    tables = {0: {lang: {w: n for w, n in c.items() if w in vocabulary} for lang, c in count.items()}}
    for n in range(1, 6):
        tables[n] = {lang: defaultdict(float) for lang in langs}
        for lang, c in count.items():
            for w, k in c.items():
                for g in grams(w, n):
                    tables[n][lang][g] += 1 + math.log(k)
    keys = {n: set().union(*t.values()) for n, t in tables.items()}
    size = {n: {lang: sum(t[lang].values()) + len(keys[n]) / 2 for lang in langs} for n, t in tables.items()}
    score = lambda n, key: np.array([math.log(tables[n][lang].get(key, 0) + 0.5) - math.log(size[n][lang]) for lang in langs])

    def predict(text):
        own, total = cut(text), np.zeros(len(langs))
        for w in own:
            if w in keys[0]:
                total += score(0, w)
                continue
            for n in range(5, 0, -1):
                if known := [g for g in grams(w, n) if g in keys[n]]:
                    total += np.mean([score(n, g) for g in known], 0)
                    break
        if not own:
            return "und", 0.0
        p = np.exp((total - total.max()) / len(own) * min(len(own), 40))
        return langs[int(p.argmax())], p.max() / p.sum()

    wanted = {i: predict(t) for i, t, _ in docs}
    for r in langid.op2_language_id(spark, SF).collect():
        assert r["lang_pred"] == wanted[r["doc_id"]][0] and r["score"] == pytest.approx(wanted[r["doc_id"]][1], abs=1e-4)


def test_language_of_odd_rows(odd, none):
    empty = langid.fit(none)
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}
    model = langid.fit(odd)
    found = langid.identify(odd, model).collect()
    assert len(found) == len(kept(odd))
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (0, 99)) for r in found)
    assert langid.identify(none, model).count() == 0
    good = langid.keep_identified(odd, model)
    assert good.columns == odd.columns and good.where("doc_id in (0, 99)").count() == 0 and good.where("doc_id = 1").count() == 3


# --- BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.resolve("word_bpe_49k.json"))


def wanted_digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_library(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aBzé ßÄ'sſŸ\t\n_12.,!$-  tmd日ΣΆ½<|>") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    rules = bpe.Rules("word_bpe_49k.json")
    known = {w: rules.merge(w) for t in texts[::2] for w in rules.words(t)}
    codec = bpe.Codec("word_bpe_49k.json", bpe.Lexicon(bpe.compile_lexicon(known)), limit=50)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids and codec.decode(ids) == library.decode(ids, skip_special_tokens=False) and codec.digest(t) == wanted_digest(library, t)


def test_lexicon_is_minimal_and_exact(spark):
    words = {w: [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "é", "日本"])}
    data = bpe.compile_lexicon(words)
    lexicon = bpe.Lexicon.mapped(bpe.put_lexicon(spark, data))
    assert all(lexicon.lookup(w) == ids for w, ids in words.items())
    assert all(lexicon.lookup(w) is None for w in ("", "ta", "tapss", "x", "sto"))
    # tap(s), top(s) and stop(s) share their ends: no two states have the same future
    assert len(lexicon.final) == 13
    assert bpe.Lexicon(bpe.compile_lexicon({})).lookup("a") is None


def test_bpe_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in bpe.op3_bpe(spark, SF).collect()}
    assert found == {r["doc_id"]: wanted_digest(library, r["text"]) for r in docs}


def test_bpe_of_odd_rows(odd, none, library):
    lexicon = bpe.build_lexicon(odd, "word_bpe_49k.json", size=5)
    encoded = bpe.encode(odd, "word_bpe_49k.json", lexicon)
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == sorted((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in kept(odd))
    back = bpe.decode(encoded, "word_bpe_49k.json").where("doc_id = 5").first()["text"]
    assert back == library.decode(library.encode(ODD[5], add_special_tokens=False).ids, skip_special_tokens=False)
    empty = bpe.build_lexicon(none, "word_bpe_49k.json")
    assert bpe.digest(none, "word_bpe_49k.json", empty).count() == 0 and bpe.digest(odd, "word_bpe_49k.json", empty).count() == len(kept(odd))


# --- quality


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op4_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows) > 100


def test_quality_query_equals_brute_force(spark):
    """Bags counted feature by feature, the same steps in plain loops, every document scored by itself."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    ids = sorted(i for i in marks if i in docs)
    bags = {i: quality.bag(docs[i], quality.BITS) for i in docs}
    rng = np.random.default_rng(0)
    vectors = ((rng.random((1 << quality.BITS, 8), np.float32) - 0.5) / 8).astype(np.float64)
    layer, bias, step, steps = np.zeros((8, 2)), np.zeros(2), 0, 6 * len(ids)

    def forward(i):
        at, reps = bags[i]
        share = reps / max(1, reps.sum())
        z = (share[:, None] * vectors[at]).sum(0) @ layer + bias
        return at, share, np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    for _ in range(6):
        for k in rng.permutation(len(ids)):
            at, share, p = forward(ids[k])
            rate = 0.5 * (1 - step / steps)
            step += 1
            error = p - np.eye(2)[marks[ids[k]]]
            mean, back = (share[:, None] * vectors[at]).sum(0), layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= 0.05 * rate * error
            if len(at):
                vectors[at] -= rate * share[:, None] * back / (share**2).sum()
    found = quality.op4_quality_classifier(spark, SF).collect()
    assert len(found) == len(docs)
    assert all(r["score"] == pytest.approx(forward(r["doc_id"])[2][1], abs=2e-3) for r in found)


def test_scorer_equals_single_documents():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cÄ\n!") for _ in range(rng.randint(0, 200))) for _ in range(30)] + ["", None, "word " * 200, "x" * 1000]
    model = quality.train([quality.bag(t, 10) for t in texts[:20]], [i % 2 for i in range(20)], [0, 1], bits=10, dim=3)
    scorer = quality.Scorer(model)
    for t, p in zip(texts, scorer.probabilities(texts), strict=True):
        at, reps = quality.bag(t or "", 10)
        mean = reps @ model.vectors[at] / max(1, reps.sum()) if len(at) else np.zeros(3)
        z = mean @ model.layer + model.bias
        assert p == pytest.approx(np.exp(z) / np.exp(z).sum(), rel=1e-4)


def test_repeated_tokens_are_a_feature():
    last = (1 << 12) - 1
    assert dict(zip(*quality.bag("la la la lo", 12), strict=True)).get(last, 0) >= 2


def test_segments_cover_the_text(monkeypatch):
    monkeypatch.setattr(quality, "SEGMENT", 10)
    for t in ("", "short", "a b c d e f g h i j k l", "x" * 35, "aaa bbbbbbbbbbbbbb cc"):
        assert "".join(quality.segments(t)) == t and all(len(p) <= 10 for p in quality.segments(t))


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (4, None), (None, 1), (5, 7)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    assert quality.score(odd, model).count() == len(kept(odd)) and quality.score(none, model).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    blank = quality.fit(none, labels)
    assert {r["score"] for r in quality.score(odd, blank).collect()} == {0.5}


# --- token files


def test_elias_fano_select():
    rng = np.random.default_rng(0)
    for n, most in ((1, 0), (5, 3), (300, 9), (1000, 100_000)):
        ids = rng.integers(0, 50_000, most * 1 + 5).astype("<u2")
        ends = np.sort(rng.integers(0, len(ids) + 1, n))
        ends[-1] = len(ids)
        docs = np.sort(rng.integers(-(1 << 63) if n == 300 else -50, (1 << 63) - 1 if n == 300 else 1 << 20, n))
        data = tokenfile.pack_shard(docs, ends, ids)
        shard = tokenfile.ShardReader(data)
        assert [shard.end(i) for i in range(n)] == ends.tolist() and [shard.doc_id(i) for i in range(n)] == docs.tolist()
        if n == 1000:  # an id and a boundary take about 2 + 10 and 2 + 7 bits, not 128
            assert len(data) - 2 * len(ids) < n * 26 / 8 + 400
        assert shard.document(n - 1).tolist() == ids[ends[-2] if n > 1 else 0 :].tolist()
        with pytest.raises(ValueError):
            tokenfile.ShardReader(data[:-9] + b"x" + data[-8:])


def test_token_files_query(spark, monkeypatch):
    t = Tokenizer.from_file(tokens.resolve("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    start, wanted = 0, []
    for r in docs:
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        wanted.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in tokenfile.op7_token_files(spark, SF).orderBy("doc_id").collect()] == wanted


def test_token_files_of_odd_rows(spark, odd, none):
    for docs, n in ((odd, len(kept(odd))), (none, 0)):
        folder = common.scratch_path(spark, "test")
        shards = tokenfile.write_shards(docs, folder, "byte_bpe_50k.json", 0, shard_ids=40, partitions=3)
        shards = common.materialize(shards, "shards")
        rows = tokenfile.read_documents(spark, folder, tokenfile.with_starts(shards)).orderBy("start").collect()
        assert len(rows) == n and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
        assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))


def test_wordwise_encoder_equals_the_library():
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice("aBzé ßÄ'sſŸ\t\n_12.,!$-  tmd日Σ") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = tokens.WordwiseEncoder(name, limit=100)
        assert encoder.word is not None
        for t in texts:
            assert encoder.encode(t).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_new_words_go_to_the_model_alone():
    rng = random.Random(8)
    words = ["".join(rng.choice("aBcdéßÄŒž019.,'_-") for _ in range(rng.randint(1, 9))) for _ in range(800)]
    texts = [rng.choice(["", " ", "\n"]).join(" ".join(rng.sample(words, 40)).split("a")) for _ in range(20)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = tokens.WordwiseEncoder(name, limit=300)
        library, encoder.tokenizer = encoder.tokenizer, None  # no normalisation or pre-tokenisation again for a word
        for t in texts:
            assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_a_full_memory_of_words_keeps_what_a_text_found():
    encoder = tokens.WordwiseEncoder("word_bpe_49k.json", limit=10)
    learned, learn = [], encoder._learn
    encoder._learn = lambda words: (learned.append(sorted(words)), learn(words))
    text = "one two three four five six seven eight"
    for t in (text, f"{text} nine ten eleven"):
        assert encoder.encode(t).tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert learned == [sorted(text.split()), ["eleven", "nine", "ten"]] and len(encoder.memo) == 3


# --- packing


def best_sum(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_fullest_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        room = rng.randint(1, 40)
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        got = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert all(got.count(x) <= counts[x] for x in got)
        assert sum(got) == best_sum([x for x, n in counts.items() for _ in range(n)], room)


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark):
    t = Tokenizer.from_file(tokens.resolve("word_bpe_49k.json"))
    ids = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.op8_best_fit_packing(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(
        (d, k, s, len(x[s : s + 4096]), zlib.crc32(x[s : s + 4096].tobytes())) for d, x in ids.items() for k, s in enumerate(range(0, len(x), 4096))
    )
    assert check_packing(rows, 4096) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_packing_uses_the_fewest_sequences(spark):
    rows = packing.op8_best_fit_packing(spark, "/root/testdata/sf0.1").select("length", "sequence_id", "offset").collect()
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 4096)


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd, capacity=8).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept(odd)}
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, 8) <= -(-total // 8) + 2
    assert packing.pack(none).count() == 0


def test_places_of_a_hot_length():
    places = packing.solve({4: 1_000_000, 3: 10, 1: 5}, 10)
    assert len(places) < 20
    assert sum(b - a for _, a, b, *_ in places) == 1_000_015
