"""Operators that SQL cannot state, against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from logspark.llm import ann, bpe, decontamination, language_id, quality, queries, sharding, simhash
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path(queries.RANKS)


# Language identification.


def test_language_on_held_out_rows(spark):
    rows = queries.op3_language_id(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_language_masks_equal_plain_sets(spark):
    """Counts by the filters exceed those of exact trigram sets by little."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, sample=10**9)
    sets, seen = defaultdict(Counter), language_id.learning_rows(docs).collect()
    for r in seen:
        for keys in language_id.trigrams(r["text"]):
            sets[r["lang"]].update(keys.tolist())
    total = {k: sum(c.values()) for k, c in sets.items()}
    most = defaultdict(float)
    for k, c in sets.items():
        for g, n in c.items():
            most[g] = max(most[g], n / total[k])
    kept = {k: {g for g, n in c.items() if n >= language_id.LEAST and n / total[k] >= language_id.SHARE * most[g]} for k, c in sets.items()}
    for i, name in enumerate(model["names"]):
        bit = np.uint64(1 << i)
        keys = np.array(sorted(kept[name]), np.uint64)
        for k in range(language_id.HASHES):
            assert (model["table"][0][language_id.slots(keys, k)] & bit).all()
    assert (model["false"] < 0.02).all()


def test_language_of_odd_texts(spark, docs):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r for r in language_id.predict(docs(ODD), model).collect()}
    for i, text in enumerate(ODD):
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    none = language_id.fit(docs(["a"]).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.predict(docs(ODD), none).collect()} == {"und"}
    assert language_id.predict(docs(["a"]).limit(0), language_id.fit(docs(["a"]).limit(0))).count() == 0


def test_every_label_is_learned(spark):
    """More labels than a few machine words hold bits for, each with letters of its own."""
    own = [chr(0x4E00 + 7 * i) * 3 + " " + chr(0x4E01 + 7 * i) * 3 for i in range(600)]
    rows = [(600 * k + i, " ".join([t] * 4), f"l{i:03d}") for k in range(8) for i, t in enumerate(own)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table)
    assert len(model["names"]) == 600
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(table.where("doc_id < 600"), model).collect()}
    assert sum(got[i] == f"l{i:03d}" for i in range(600)) >= 590


# Nearest neighbours.


def near_by_force(rows, k=20):
    rows = [(i, np.asarray(v, float)) for i, v in rows]
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            best = sorted((-float(v @ w), j) for j, w in rows if j != i)[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = near_by_force([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = defaultdict(list)
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    vectors = {r["vec_id"]: np.asarray(r["embedding"], float) for r in table.collect()}
    assert all(abs(s - vectors[q] @ vectors[j]) < 1e-12 for q, v in got.items() for j, s in v)


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.1, 5)).tolist()) for i in range(90)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]
    bad = [(200, None), (220, [0.0] * 6), (240, [1.0, None] * 3), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (300, [1.0]), (320, []), (None, [1.0] * 6)]
    table = spark.createDataFrame([(i, v, 0) for i, v in [*rows, *bad]], "vec_id long, embedding array<float>, rank int")
    usable = [(i, np.float32(v)) for i, v in rows]
    want = near_by_force(usable)
    got = defaultdict(list)
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(few).orderBy("rank").collect()] == [(0, 1, 1, 4.0), (0, 2, 2, -1.0)]
    assert ann.search(few.limit(0)).count() == 0


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP", 7)
    monkeypatch.setattr(ann, "QUERIES", 2)
    test_small_tables_are_searched_whole(spark)


@pytest.mark.parametrize("lengths", ["one long", "lognormal"])
def test_neighbours_of_unlike_lengths(spark, lengths):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(20_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v *= np.where(np.arange(20_000) == 3, 100, 1)[:, None] if lengths == "one long" else rng.lognormal(0, 0.5, (20_000, 1))
    table = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search(table, every=100).collect():
        got[r["query_id"]].add(r["vec_id"])
    scores = v[::100] @ v.T
    scores[np.arange(200), np.arange(0, 20_000, 100)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert len(got) == 200 and all(len(x) == 20 for x in got.values())
    assert sum(len(got[100 * i] & set(x)) for i, x in enumerate(want.tolist())) >= 0.95 * 20 * 200


def test_queries_with_few_candidates_meet_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "WANTED", 1)
    rng = np.random.default_rng(3)
    # Nearly all vectors lie in one direction; the queries lie elsewhere.
    rows = [(20 * i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(6, 8)))]
    rows += [(20 * i + 1, (np.eye(8)[0] * (1 + 1e-4 * i)).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(table, tables=1, probe_share=0.01).collect()}
    assert got == {(q, i + 1): j for q, v in near_by_force(rows).items() for i, (j, _) in enumerate(v)}


def test_repeated_ids_are_one_candidate(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    # Beside the queries 0 and 20: one vec_id on equal rows and one on rows that differ a little.
    rows += [(101, (3 * np.array(rows[0][1])).tolist())] * 35
    rows += [(103, (np.array(rows[20][1]) * (3 + 0.01 * i)).tolist()) for i in range(35)] + [rows[20]] * 30
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    for q in (0, 20, 40):
        best = {}
        for j, w in rows:
            if j != q:
                best[j] = max(best.get(j, -np.inf), float(np.dot(rows[q][1], w)))
        assert got[q] == [(j, round(s, 9)) for j, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]]


def test_each_dimension_is_searched_among_its_own(spark):
    rng = np.random.default_rng(5)
    parts = [[(i, rng.normal(size=dim).tolist()) for i in ids] for dim, ids in ((6, range(60)), (9, range(60, 100)), (1, range(100, 103)))]
    table = spark.createDataFrame(sum(parts, []), "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(table).collect()}
    assert got == {(q, i + 1): j for rows in parts for q, v in near_by_force(rows).items() for i, (j, _) in enumerate(v)}


# Sharding.


def check_shards(rows, texts, shards=40):
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want


def test_shards_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.assign(df).collect()
    check_shards(rows, [r["text"] for r in df.collect()])
    assert sum(r["shard"] == r["home_shard"] for r in rows) > 0.6 * len(rows)


def test_shards_with_hot_keys(spark, docs):
    texts = [*ODD, *["same"] * 400]
    df = docs(texts).withColumn("doc_id", F.when(F.col("doc_id") > 150, F.lit(7)).when(F.col("doc_id") > 100, F.lit(None)).otherwise(F.col("doc_id")))
    check_shards(sharding.assign(df).collect(), texts)
    assert sharding.assign(df.limit(0)).count() == 0


def test_ring_against_a_walk():
    """Dealing counted cells equals walking every key on its own, round by round."""
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(0, 256, 500) ** 2 // 256, minlength=256)
    limits = [63] * 4 + [62] * 4
    dealt = sharding.place(counts, 8, limits, nodes=5)
    points = sharding.ring(8, 5, 256)
    shard_of, used = {}, Counter()
    left = [(cell, i) for cell in range(256) for i in range(counts[cell])]
    for step in range(8):
        rest = []
        for cell, i in left:
            start = next((n for n, (c, _) in enumerate(points) if c >= cell), 0)
            order = list(dict.fromkeys(points[(start + n) % len(points)][1] for n in range(len(points))))
            if used[order[step]] < limits[order[step]]:
                shard_of[cell, i] = order[step], used[order[step]]
                used[order[step]] += 1
            else:
                rest.append((cell, i))
        left = rest
    got = {(r.cell, i): (r.shard, r.slot + i - r.low) for r in dealt.itertuples() for i in range(r.low, r.high)}
    assert got == shard_of


# Byte-level BPE.


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_tokens(rows, texts, tokenizer):
    assert len(rows) == len(texts)
    for r in rows:
        ids = tokenizer.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_tokens_of_documents(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_tokens(queries.op7_bpe(spark, SF).collect(), texts, tokenizer)


def test_tokens_of_odd_texts(docs, tokenizer, monkeypatch):
    rng = random.Random(9)
    letters = "aabbccdeeéß漢字😀 \n\t'sre0123.,-_​ İAB"
    texts = [*ODD, *("".join(rng.choices(letters, k=rng.randint(1, 200))) for _ in range(300)), "a" * 50_000, "ab" * 30_000, "<|endoftext|>", "…" * 900]
    for block in (bpe.BLOCK, 500):
        monkeypatch.setattr(bpe, "BLOCK", block)
        monkeypatch.setattr(bpe, "BATCH", block // 5)
        monkeypatch.setattr(bpe, "PART", block // 9)
        out = bpe.digest(bpe.encode(docs(texts), RANKS, public_tokenizers.PATTERN), RANKS).collect()
        check_tokens(out, dict(enumerate(texts)), tokenizer)


def test_tokens_keep_other_columns(docs):
    df = docs(ODD).withColumn("ids", F.lit("old"))
    out = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert sorted(out.columns) == sorted(set(df.columns) - {"text"}) and out.count() == len(ODD)
    nulls = bpe.decode(out.withColumn("ids", F.when(F.col("doc_id") > 3, F.col("ids"))), RANKS).orderBy("doc_id").collect()
    assert [r["decoded"] for r in nulls[:4]] == [None] * 4 and bytes(nulls[4]["decoded"]).decode() == ODD[4]
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_replay_of_a_vocabulary_out_of_order():
    """A pair may rank before the merges that made its parts; the words still come out as one by one."""
    ranks = {bytes([b]): b for b in range(256)}
    for i, token in enumerate([b"cdx", b"cab", b"ab", b"cd", b"dx", b"abab", b"xa", b"ca"]):
        ranks[token] = 256 + i
    merges = bpe.Merges(ranks)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdx", k=rng.randint(1, 12))).encode() for _ in range(3000)]
    ids, counts = merges.replay(words)
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [merges.alone(w) for w in words]


# Decontamination.


def slotted(text):
    """Words of a text, lower-cased, and the same with typed slots; written apart from the operator."""
    raw = (text or "").encode()
    found = list(re.finditer(rb"(?:[0-9A-Za-z\x80-\xff]|(?<=[0-9])[.,](?=[0-9]))+", raw))
    plain, out = [], []
    for n, m in enumerate(found):
        word = m[0]
        low = word.lower()
        between = raw[found[n - 1].end() : m.start()] if n else b"."
        kind = low
        if len(word) > 1 and b"A" <= word[:1] <= b"Z" and not re.search(rb'[.!?:;\n\r|"(]', between):
            kind = "NAME"
        if low.decode("utf-8", "replace") in decontamination.UNITS.split():
            kind = "UNIT"
        if re.fullmatch(rb"[0-9][0-9.,]*", low) or low.decode("utf-8", "replace") in decontamination.NUMBERS.split():
            kind = "NUM"
        plain.append(low)
        out.append(kind)
    return plain, out


def leaks_by_force(docs, items):
    windows = {}
    texts = {d: slotted(text) for d, text in docs}
    out = set()
    for i, item in items:
        p, c = slotted(item)
        if size := min(len(c), 8):
            if size not in windows:
                windows[size] = {d: [{tuple(t[k : k + size]) for k in range(len(t) - size + 1)} for t in both] for d, both in texts.items()}
            own = [(tuple(p[k : k + size]), tuple(c[k : k + size])) for k in range(len(c) - size + 1)]
            solid = lambda w: sum(isinstance(x, bytes) for x in w) >= 3
            out |= {
                (d, i) for d, (there, slots) in windows[size].items()
                if 2 * sum(w in there or (solid(s) and s in slots) for w, s in own) >= len(own)
            }
    return out


def test_lists_of_slots_are_no_leak(docs, spark):
    """Items of numbers or names alone are found by their very words only; capitals do not matter to plain windows."""
    numbers, names = "3 5 7 11 13 17 19 23 29 31 37 41", "We met Anna Boris Clara Dora Emil Fritz Gerda Hans Ida Jonas there"
    items = spark.createDataFrame([(1, numbers), (2, "1 2 3 4 5 6 7 8 9 10"), (3, names), (4, ITEM)], "item_id long, text string")
    texts = [
        "prices 2 4 6 8 10 12 14 16 18 20 22 24 26", "sums " + numbers + " end", "We saw Karl Lena Mara Nils Olga Paul Rosa Sven Tina Udo there", names.upper(),
        ITEM.upper(), ITEM.lower(), ITEM.title(), ITEM.replace("5", "6"), "9 " * 5000, "Anna Bert " * 3000,
    ]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs(texts), items).collect()}
    assert got == {(1, 1), (3, 3), (4, 4), (5, 4), (6, 4), (7, 4)}
    assert got == leaks_by_force(enumerate(texts), [tuple(r) for r in items.collect()])


def test_leaks_in_texts_longer_than_a_piece(docs, spark):
    """The passage stands across the border of two hashed pieces of the text."""
    word = "filler "
    at = (1 << 20) // len(word)
    text = word * (at - 4) + ITEM + " " + word * at
    items = spark.createDataFrame([(4, ITEM)], "item_id long, text string")
    assert [(r["doc_id"], r["share"]) for r in decontamination.leaks(docs([word * 2 * at, text]), items).collect()] == [(1, 1.0)]


def test_leaks_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontamination(spark, SF).collect()}
    assert got == leaks_by_force([(r["doc_id"], r["text"]) for r in docs], items)
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    whole = {(r["doc_id"], i) for r in docs for i, t in items if plain(t) in plain(r["text"])}
    assert whole and whole <= got


ITEM = "A train leaves the town at 5 km per hour and Anna walks 5 miles before noon while 12 birds sing on the old roof."


def test_leaks_with_other_numbers(docs, spark):
    items = spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "", 0), (4, "mit license", 0), (1, ITEM, 0), (None, "x", 0)], "item_id long, text string, pos int")
    other = ITEM.replace("5", "7").replace("12", "thirty").replace("Anna", "Boris").replace("km", "miles")
    torn = ITEM.replace("at 5", "at 8").replace("walks 5", "walks 9")
    texts = [*ODD, "before " + ITEM + " after", "One two. " + other + " more", torn, ITEM[:40]]
    rows = {(r["doc_id"] - len(ODD), r["item_id"]): r for r in decontamination.leaks(docs(texts), items).collect()}
    assert {k for k in rows if k[0] >= 0} == {(0, 1), (1, 1)}
    assert rows[0, 1]["exact"] and not rows[1, 1]["exact"]
    assert (ODD.index("mit license") - len(ODD), 4) in rows
    df = docs(texts)
    kept = decontamination.clean(df, items)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {len(ODD), len(ODD) + 1, ODD.index("mit license")}
    assert decontamination.clean(df, items.limit(0)).count() == len(texts)
    assert decontamination.clean(df.limit(0), items).count() == 0


# Quality.


def weights_by_force(spark, model, docs):
    return {r["doc_id"]: quality.weigh(r["text"], model["ratios"]) for r in docs}


def test_quality_keeps_clean_and_drops_the_rest(spark):
    sf = "/root/testdata/sf0.1"
    kept = {r["doc_id"] for r in queries.op9_quality(spark, sf).select("doc_id").collect()}
    label = {(r["doc_id"]): (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    share = lambda q, t: np.mean([d in kept for d, (a, b) in label.items() if a == q and b == t])
    assert share(1, 0) >= 0.99
    assert share(0, 0) <= 0.03 and share(0, 1) <= 0.03
    # Over a third of the texts labelled toxic alone hold none of the words that mark the others.
    assert share(1, 1) <= 0.45


def test_quality_is_a_gumbel_top_k(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    weights = weights_by_force(spark, model, docs.collect())
    noise = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.gumbel().alias("g")).collect()}
    assert abs(np.mean(list(noise.values())) - 0.5772) < 0.2
    k = sum(w >= model["cut"] for w in weights.values())
    want = sorted(weights, key=lambda d: -(weights[d] + noise[d]))[:k]
    assert {r["doc_id"] for r in quality.select(docs, labels).collect()} == set(want)


def test_quality_of_odd_texts(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(ODD)
    assert quality.keep(df, none).columns == df.columns and quality.keep(df, none).count() == len(ODD)
    assert quality.keep(df.limit(0), none).count() == 0
    labels = spark.createDataFrame([(i, int(i % 2 == 0), None if i % 3 else 0) for i in range(60)] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    texts = ["good words here and there " * 5 if i % 2 == 0 else "%%% ### bad $$$ " * 5 for i in range(60)]
    kept = {r["doc_id"] for r in quality.keep(docs(texts), labels).collect()}
    assert kept == {i for i in range(60) if i % 2 == 0}


def test_kth_largest(spark):
    rng = random.Random(8)
    values = [rng.gauss(0, 10) for _ in range(500)] + [3.25] * 400 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 100, 450, 902):
        assert quality.kth_largest(df, "x", k, bins=16) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df.limit(0), "x", 1) is None


# Near copies.


def print_by_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components_by_force(prints):
    """`prints`: pairs of id and fingerprint."""
    root = {f: f for _, f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = np.array(sorted(root), dtype=np.uint64)
    for i, f in enumerate(distinct):
        differ = np.bitwise_count(distinct[i + 1 :] ^ f)
        for g in distinct[i + 1 :][differ <= 2]:
            a, b = find(int(f)), find(int(g))
            root[max(a, b)] = min(a, b)
    least = {}
    for d, f in prints:
        least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least[find(f)] for d, f in prints}


def check_copies(df, texts):
    got = simhash.near_copies(df).collect()
    prints = [(i, print_by_force(t)) for i, t in texts.items()]
    want = components_by_force(prints)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((d, f"{f:016x}", want[d, f]) for d, f in prints)
    return want


def test_copies_of_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_copies(df, {r["doc_id"]: r["text"] for r in df.collect()})


def test_copies_of_odd_texts(docs):
    base = "the quick brown fox jumps over the lazy dog and runs away from it all " * 8
    texts = [*ODD, *ODD, *(base + f"end {i % 7}" for i in range(40)), "A B", "a  b"]
    want = check_copies(docs(texts), dict(enumerate(texts)))
    df = docs(texts)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.deduplicate(df.limit(0)).count() == 0 and simhash.near_copies(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "same text here"), (1, "same text here"), (None, "same text here"), (None, "only without an id"), (2, "other words stand here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.near_copies(df).count() == 5
    assert sorted(map(tuple, simhash.deduplicate(df).collect()), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)


@pytest.mark.parametrize("paired", [64, 2])
def test_links_of_dense_fingerprints(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(6)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for s in seeds for _ in range(12)}
    prints |= {seeds[0] ^ (1 << b) for b in range(64)}
    numbered = list(enumerate(sorted(prints)))
    want = components_by_force(numbered)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in numbered]
    df = spark.createDataFrame(signed, "doc_id long, f long")
    got = {r["f"] % (1 << 64): r["component_id"] for r in simhash.linked(df).collect()}
    assert got == {f: c for (_, f), c in want.items()}


# The pipeline.


def test_pipeline(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(r["doc_id"], r["text"]) for r in quality.select(docs, labels).collect()]
    prints = [(d, print_by_force(t)) for d, t in left]
    stay = set(components_by_force(prints).values())
    left = [(d, t) for d, t in left if d in stay]
    gone = {d for d, _ in leaks_by_force(left, items)}
    left = {d: t for d, t in left if d not in gone}
    assert {r["doc_id"] for r in rows} == set(left) and len(rows) == len(left)
    assert set(rows[0].asDict()) == set(docs.columns) - {"text"} | {"ids"}
    from tests.llm.test_scans import found_by_python

    for r in rows:
        text, out, at = left[r["doc_id"]], "", 0
        for a, _, b, _ in found_by_python(text):
            if a > at or (a == at == 0 and not out):
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r["ids"] == tokenizer.encode_ordinary(out + text[at:])
    assert set(texts) >= set(left)


def test_stages_on_an_empty_table(spark, docs):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_repeated_ids_add_no_learning_text(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    many = docs(["good words here"]).unionByName(docs(["bad"], first=1)).crossJoin(spark.range(500)).drop("id")
    rows = quality.labelled(many.unionByName(docs(["a text that sorts before"], first=0)), labels).collect()
    assert sorted((r["text"], r["kind"]) for r in rows) == sorted([("a text that sorts before", quality.TARGET), ("bad", quality.LOW)])


def test_parts_of_a_hot_key_follow_its_rows(docs, monkeypatch):
    monkeypatch.setattr(sharding, "PARTS", 1)
    monkeypatch.setattr(sharding, "PART_ROWS", 8)
    texts = [*ODD, *["same"] * 400]
    df = docs(texts).withColumn("doc_id", F.when(F.col("doc_id") > 150, F.lit(7)).otherwise(F.col("doc_id"))).repartition(40)
    check_shards(sharding.assign(df).collect(), texts)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_rows_taken_out_by_bitmaps(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BITMAP_BYTES", most)
    numbers = [n + (part << 33) for part in (0, 1, 7) for n in (*range(70), 32767, 32768, 99999)]
    gone = [n for n in numbers if n % 7 in (2, 3)]
    held = spark.createDataFrame([(n, f"t{n}") for n in numbers], "row long, text string")
    left = simhash.without(held, spark.createDataFrame([(n,) for n in gone], "row long"))
    assert left.columns == ["row", "text"]
    assert sorted(map(tuple, left.collect())) == sorted((n, f"t{n}") for n in set(numbers) - set(gone))
    assert sorted(r.row for r in simhash.without(held, held.select("row").limit(0)).collect()) == sorted(numbers)
