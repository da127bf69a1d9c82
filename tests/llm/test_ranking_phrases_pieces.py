"""Lexical ranking, collocations and SentencePiece against brute force and the library."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from logspark.llm import lexical, phrases, queries, sentence_bpe
from tests.llm.conftest import ODD, same_rows

PIECES = public_tokenizers.path(queries.PIECES)


# Ranked lexical search.


def terms_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked_by_force(docs, items, k=10):
    """`docs` and `items` are (id, text); items have distinct ids."""
    docs = [(i, Counter(t)) for i, text in docs if (t := terms_of(text))]
    size = len(docs)
    whole = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in docs:
            m = 25 + 75 * sum(c.values()) * size // whole
            score = sum(
                n * math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, n in Counter(terms_of(text)).items() if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


WORDS = ["a", "B", "çà", "漢字", "x1", "zz", "the", "of", "2", "q-r", "end."]


def random_texts(n, seed, longest=30):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, longest))) for _ in range(n)]


def ranked(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    return same_rows(lexical.search(d, q), ["item_id", "rank", "doc_id", "score"])


def test_ranking_equals_brute_force(spark):
    texts = [*ODD, *random_texts(60, 1), *["the same text"] * 30, "the " * 40_000]
    docs = [*enumerate(texts), (None, "the of zz"), (None, "of 2"), (5, "the of zz"), (5, None)]
    items = [(100 + i, t) for i, t in enumerate([*ODD, *random_texts(20, 2, 8), "the same text", "zz " * 500])] + [(None, "the of")]
    assert ranked(spark, docs, items) == ranked_by_force(docs, items)


def test_ranking_in_many_small_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 3)
    monkeypatch.setattr(lexical, "TERMS", 11)
    docs, items = list(enumerate(random_texts(40, 3))), list(enumerate(random_texts(12, 4, 6)))
    assert ranked(spark, docs, items) == ranked_by_force(docs, items)


def test_rows_of_one_item_and_empty_tables(spark):
    docs = [(1, "red fox"), (1, "red fox"), (2, "blue dog"), (3, "cat"), (4, "bird")]
    twice = ranked(spark, docs, [(7, "fox"), (7, "fox"), (7, "dog")])
    assert [r[:3] for r in twice] == [(7, 1, 2), (7, 2, 1), (7, 3, 1)]
    assert ranked(spark, docs, []) == ranked(spark, [], [(1, "x")]) == ranked(spark, [(1, None)], [(1, "x")]) == []


def test_tiles_are_exact_beyond_two_to_the_53rd(monkeypatch):
    rng = random.Random(5)
    entries = {i: [(t, rng.choice([0, 1, 40_000, 10**9, 10**10, 3 * lexical.WEIGHT, 10**11 + 7])) for t in rng.sample(range(50), 20)] for i in range(9)}
    monkeypatch.setattr(lexical, "CELLS", 120)
    monkeypatch.setattr(lexical, "COLUMNS", 6)
    at = [(d, t, rng.randint(0, 10**6)) for d in range(13) for t in rng.sample(range(50), 25)]
    row, term, impact = (np.array(x) for x in zip(*at, strict=True))
    found = {}
    for tile in lexical.tiles(entries):
        scores = tile.scores(row, term, impact, 13, 50)
        found |= {int(i): scores[k].tolist() for k, i in enumerate(tile.items)}
        for low, high in zip(tile.cuts[:-1], tile.cuts[1:], strict=True):
            assert tile.weights[:, low:high].sum(axis=1).max() * lexical.IMPACT < 2**53
            assert len(set(tile.terms[low:high].tolist())) == high - low
    for i, own in entries.items():
        weight = dict(own)
        want = [sum(weight.get(t, 0) * x for d2, t, x in at if d2 == d) for d in range(13)]
        assert found.get(i, [0] * 13) == want


def test_terms_of_long_texts_in_parts(monkeypatch):
    text = "".join(random.Random(6).choices([*WORDS, " ", "\n", "-"], k=3000))
    want = Counter(t.encode() for t in terms_of(text))
    monkeypatch.setattr(lexical, "PIECE", 50)
    assert lexical.counted(text.encode()) == (sum(want.values()), want)
    assert lexical.counted(None) == lexical.counted(b"") == (0, Counter())


# Collocations.


def counts_by_force(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    return f, n


def collocations_by_force(rows, least=100, most=2000):
    f, n = counts_by_force(rows)
    out = []
    for lang in f:
        often = {p: c for p, c in f[lang].items() if c >= least}
        inside = defaultdict(int)
        for q, c in often.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    inside[q[i : i + m]] = max(inside[q[i : i + m]], c)
        found = []
        for p, a in often.items():
            if len(p) > 1 and inside[p] < a:
                cuts = [(1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), a, f[lang][p[:k]], f[lang][p[k:]]))
        for rank, (score, _, phrase, a, l, r) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, n[lang], -score))
    return sorted(out, key=repr)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["Of", "the", "red", "fox", "ça", "漢", "a\x00b", "\x01", "x-y", "\xa0", "_"]
    rows = []
    for _ in range(6000):
        text = "".join(words[min(rng.randrange(11), rng.randrange(11))] + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!?"]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    rows += [("de", "ein fester satz aus vielen worten, immer gleich")] * 130 + [("rare", "once")] + [(None, t) for t in ODD]
    rows.append(("en", "go go. " * 30_000))
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, words int").repartition(5)
    want = collocations_by_force(rows)
    assert same_rows(phrases.collocations(table), COLUMNS) == want and len(want) > 100
    few = same_rows(phrases.collocations(table, most=7), COLUMNS)
    assert few == collocations_by_force(rows, most=7)
    assert phrases.collocations(table.limit(0)).count() == 0
    assert phrases.collocations(table.where("lang = 'rare'")).count() == 0


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 40)
    rows = [("en", "a b c. " * 30 + "d " * 100), ("de", ""), ("en", "x y")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in (0, 1)], names=["lang", "text"])
    f, found = counts_by_force(rows)[0]["en"], Counter()
    blocks = list(phrases._blocks(iter([batch])))
    for block in blocks:
        key = [(block.langs[k], block.words[k]) if k >= 0 else None for k in block.key]
        found.update(tuple(w for _, w in part) for m in range(1, 6) for i in range(len(key) - m + 1) if None not in (part := key[i : i + m]))
    assert found == f and len(blocks) > 3


@pytest.mark.parametrize("counters", [2, 27])
def test_counters_keep_all_that_is_frequent(spark, monkeypatch, counters):
    h = np.random.default_rng(8).integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    counts = np.arange(3000) % 110
    rows = [(part, bytearray(data)) for own in (slice(0, 2000), slice(1000, 3000)) for part, data in phrases._packed(h[own], counts[own])]
    bits = phrases.often_counted(spark.createDataFrame(rows, "part int, data binary"))
    total = counts * np.where((np.arange(3000) >= 1000) & (np.arange(3000) < 2000), 2, 1)
    held = phrases._held(bits, h)
    assert held[total >= 100].all() and not held[total < 100].any()


# SentencePiece.


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def odd_texts():
    rng = random.Random(9)
    parts = ["a", "b", " ", "  ", "\n", "é", "日", "本", "語", "😀", "▁", "the", "ing", " of", ".", "1", "\x00", "́", "ﬁ", "\t", "    ", "Ω", "न", "ा", "<s>", "\r", "￿", "𐍈"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choices("abcdefgh", k=rng.randint(0, 600))) for _ in range(100)] + [" " * k for k in range(40)] + ["a" * k for k in range(0, 300, 7)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x370, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(60)) for _ in range(400)]
    return texts + ["ab" * 300, "日本語" * 400, " a" * 500, "x" * 5000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=20_000))]


def test_piece_ids_and_texts_equal_the_library(spark, docs, library):
    texts = [*odd_texts(), *ODD, "the end of it. " * 400_000]
    encoded = sentence_bpe.encode(docs(texts).withColumnRenamed("f", "packed").repartition(3), PIECES)
    assert encoded.columns == ["doc_id", "lang", "source", "n_chars", "row", "labels", "packed", "ids"]
    got = {r["doc_id"]: r for r in sentence_bpe.decode(encoded, PIECES, packed="packed").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[i]["ids"] == ids and got[i]["decoded"] == library.decode(ids), (text or "")[:80]
        assert bytes(got[i]["packed"]) == struct.pack(f"<{len(ids)}I", *ids)


def test_pieces_of_whole_documents(spark, library):
    rows = {r["doc_id"]: r for r in queries.op13_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        own = rows.pop(r["doc_id"])
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert not rows


def test_any_ids_decode_as_the_library_does(library):
    rng, model = random.Random(10), sentence_bpe.Pieces(open(PIECES, "rb").read())
    for _ in range(2000):
        ids = [rng.choice([rng.randint(0, 2), rng.randint(3, 258), rng.randint(131, 258), rng.randint(259, 31_999), 28_705, 259]) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_rounds_equal_pairs_one_by_one(library):
    model = sentence_bpe.Pieces(open(PIECES, "rb").read())
    words = sorted({w for t in odd_texts() for w in model.word.findall("▁" + t.replace(" ", "▁")) if w[0] in model.symbols and len(w) < sentence_bpe.LONG})
    flat, size = model.encode(words)
    for word, ids in zip(words, np.split(flat, np.cumsum(size)[:-1]), strict=True):
        assert ids.tolist() == model.alone([model.symbols[c] for c in word])


def test_models_of_other_kinds_are_refused():
    data = bytearray(open(PIECES, "rb").read())
    at = data.index(b"/8T") + 3
    assert data.index(b"\x18\x02", at) > at
    data[data.index(b"\x18\x02", at) + 1] = 1
    with pytest.raises(ValueError):
        sentence_bpe.Pieces(bytes(data))


def test_null_ids_and_empty_tables(spark, docs):
    assert sentence_bpe.digest(sentence_bpe.encode(docs(["a"]).limit(0), PIECES), PIECES).count() == 0
    held = spark.createDataFrame([(1, None), (2, []), (3, [1, 264, 2])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in sentence_bpe.decode(held, PIECES).orderBy("doc_id").collect()] == [None, "", "a"]
