"""Corpus operators against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import common, fingerprints, jaccard, lempelziv, mixing, packing, quality, repair, sharding, suffixes, tokenids, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, __row string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgéß") for _ in range(rng.randrange(1, 7))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base, passage = sentence(rng, 120), sentence(rng, 70)
    texts = [None, "", "   \n", "That it.", "one two", base, base, base.upper(), passage, "<|endoftext|> a<|endoftext|>", "x  y  z\n\n it's 12 　q", "l " * 3000]
    for _ in range(30):
        words = base.split(" ")
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        texts.append(" ".join(words))
    texts += [sentence(rng, 15) + " " + passage + "\t" + sentence(rng, 10) for _ in range(4)]
    texts += [sentence(rng, rng.randrange(1, 150)) for _ in range(12)]
    return [(3 * k, t, "en", "hot" if k % 3 else f"s{k % 4}", len(t or ""), "x", "y") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(docs, rows, empty):
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    texts = [(i, t or "") for i, t, *_ in rows]
    by_text = {}
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert by_text.setdefault(edited, got[i].edited_fingerprint) == got[i].edited_fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if t and t == after:
            assert got[i].near_next == 1
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_likeness_is_by_position(spark):
    """Against plain Python over sketches of real and made texts; moved passages count, scattered single anchors do not."""
    rng = random.Random(21)
    passage, words = sentence(rng, 80), sentence(rng, 200).split(" ")
    pairs = [(passage, sentence(rng, 9) + " " + passage), (" ".join(words), " ".join(rng.sample(words, len(words)))), (passage, passage), ("", ""), ("", passage), ("ab", "ab"), ("ab cd ef", "xx ab"), (passage, sentence(rng, 90))]
    made = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    held = fingerprints.with_sketch(fingerprints.with_sketch(made, "a", "x"), "b", "y")
    got = {r.k: r for r in held.select("k", "x", "y", fingerprints.likeness(F.col("x"), F.col("y")).alias("like")).collect()}
    for r in got.values():
        x, y = (dict(tuple(v) for v in s) for s in (r.x, r.y))
        assert list(x) == sorted(x) and len(x) == len(r.x) <= fingerprints.SKETCH
        either = sorted({*x, *y})[: fingerprints.SKETCH]
        moved = [y[h] - x[h] for h in either if h in x and h in y]
        want = sum(s == 0 or moved.count(s) > 1 for s in moved) / len(either) if either else 1.0
        assert r.like == pytest.approx(want)
    assert got[0].like > 0.6 and got[1].like < 0.1 and got[2].like == got[3].like == got[5].like == 1 and got[4].like == 0 and got[7].like < 0.05


def test_syncmers_are_context_free(spark):
    rng = random.Random(1)
    shared = sentence(rng, 60)
    two = spark.createDataFrame([(sentence(rng, 9) + " " + shared,), (shared + " " + sentence(rng, 9),)], "text string")
    sets = [set(a.hash for a in r.a) for r in fingerprints.with_anchors(two, "text", "a").collect()]
    assert len(sets[0] & sets[1]) > 0.7 * min(map(len, sets))


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs, {"hot": 0.5, "s0": 3.0})
    assert got.columns == [*docs.columns, "replica"]
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    rates = {r.source: r.rate for r in mixing.rates(docs, {"hot": 0.5, "s0": 3.0}, 0.5, "source", "text").collect()}
    import math

    for i, _, _, source, *_ in rows:
        u = int(hashlib.md5(f"0:{i}:1".encode()).hexdigest()[:13], 16) / (1 << 52)
        k, p = 0, math.exp(-rates[source])
        total = p
        while total <= u:
            k += 1
            p *= rates[source] / k
            total += p
        assert counts.get(i, 0) == k
    assert mixing.mix(empty).count() == 0


def test_mixing_rates_hold_on_many_documents(spark):
    many = spark.range(20_000).selectExpr("id AS doc_id", "'abcdefghij' AS text", "IF(id % 3 = 0, 'rare', 'hot') AS source")
    n = {r.source: r["count"] for r in mixing.mix(many, {"rare": 0.6, "hot": 0.4}).groupBy("source").count().collect()}
    assert abs(n["rare"] - 12_000) < 500 and abs(n["hot"] - 8_000) < 500
    high = mixing.mix(many.limit(50), {"rare": 1.0, "hot": 0.0})
    assert high.where("source = 'hot'").count() == 0


def test_repeated_passages(docs, rows, empty):
    spans = suffixes.repeated_passages(docs, 50).collect()
    flagged = {}
    for s in spans:
        flagged.setdefault(s.doc_id, set()).update(range(s.start, s.stop))
    seen, want = {}, {}
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        for p in range(len(words) - 49):
            run = tuple(words[p : p + 50])
            if run in seen:
                want.setdefault(i, set()).update(range(p, p + 50))
            seen.setdefault(run, (i, p))
    assert set(flagged) == set(want)
    for i in want:
        assert flagged[i] <= want[i]
    assert sum(map(len, flagged.values())) > 0.9 * sum(map(len, want.values()))
    assert suffixes.repeated_passages(empty).count() == 0


def test_repeated_passages_are_whole(spark, docs, rows):
    """Also where the only shared anchor is a phrase of many documents in which the passage ends."""
    rng = random.Random(8)
    low = [sentence(rng, 8) for _ in range(400)]
    phrase = min(low, key=lambda t: int(suffixes.gram_hashes(suffixes.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0], 8)[0]))
    texts = [f"{sentence(rng, 12)} {phrase} {sentence(rng, 60)}" for _ in range(60)]
    texts += [f"{passage} {sentence(rng, 30)}" for passage in (f"{sentence(rng, 42)} {phrase}" for _ in range(20)) for _ in range(2)]
    for n in (42, 45, 60, 80):
        for _ in range(5):
            passage = sentence(rng, n) + " " + phrase
            texts += [f"{sentence(rng, 9)} {passage} {sentence(rng, 30)}" for _ in range(2)]
    ending = [(k, t) for k, t in enumerate(texts)]
    for table, given in ((docs, [r[:2] for r in rows]), (spark.createDataFrame(ending, "doc_id long, text string").repartition(3), ending)):
        flagged, seen, want = {}, set(), {}
        for s in suffixes.repeated_passages(table, 50).collect():
            assert not flagged.setdefault(s.doc_id, set()) & set(range(s.start, s.stop))
            flagged[s.doc_id].update(range(s.start, s.stop))
        for i, t in given:
            words = WORD.findall(t or "")
            for p in range(len(words) - 49):
                run = tuple(words[p : p + 50])
                if run in seen:
                    want.setdefault(i, set()).update(range(p, p + 50))
                seen.add(run)
        assert flagged == want


def test_shards(spark, docs, empty):
    slim = docs.select("doc_id", F.col("text").alias("t"))
    got = sharding.shard(slim, 7, "doc_id", [F.col("t")]).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(got) == docs.count()
    assert sharding.shard(empty.drop("shard"), 7, "doc_id", [F.col("text")]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = spark.range(n).select(sharding.permuted(F.col("id"), n, 11).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


def test_quality_learns_and_scores_all(spark, empty):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 30) if i % 2 else " ".join(w + "***" for w in sentence(rng, 30).split()), i % 2) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    weights = quality.train(quality.labelled(docs, labels))
    scores = quality.score(docs, weights).collect()
    assert len(scores) == 302
    held = [r for r in scores if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held]) > 0.95
    assert quality.score(empty, quality.train(quality.labelled(empty, labels))).count() == 0


def test_quality_trains_on_every_labelled_row(spark, monkeypatch):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "good ").otherwise("bad "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", ((F.col("doc_id") + 1) % 2).cast("int").alias("quality"))
    known = quality.labelled(docs, labels)
    wanted = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(r.doc_id for r in known.select("doc_id").collect()) == wanted and len(wanted) > 13_000
    monkeypatch.setattr(quality, "SHARD_ROWS", 100)
    few = known.where("doc_id < 900")
    rows = few.select("text", "label", F.xxhash64("doc_id").alias("o")).orderBy("o", "text").collect()
    shards = -(-len(rows) // 100)
    total = np.zeros((1 << quality.BITS) + quality.EXTRA)
    for k in range(shards):
        mine = [r for r in rows if r.o % shards == k]
        vectors = [quality.features(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text)]))[:2] for r in mine]
        total += len(mine) * quality.ftrl([(i, x.astype(np.float32)) for i, x in vectors], np.array([r.label for r in mine]))
    weights = quality.train(few)
    assert shards > 3 and np.allclose(weights, total / len(rows), atol=1e-5)
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in quality.score(docs.where("doc_id < 900"), weights).collect())


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenids.vocabulary_path())
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]


def test_token_files_round_trip(docs, rows, empty, ids):
    got = {r.doc_id: r for r in repair.token_files(docs, tokenids.vocabulary_path()).collect()}
    at = 0
    for i, t, *_ in rows:
        want = ids(t)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].start == at and got[i].n_tokens == len(want)
        at += len(want)
    assert repair.token_files(empty, tokenids.vocabulary_path()).count() == 0


def test_repair_replaces_pairs_and_decodes_single_documents():
    rng = np.random.default_rng(0)
    parts = [rng.permutation(np.tile([5, 6, 7, 8], 200)) if k % 2 else np.tile([1, 2, 3], 300) for k in range(6)]
    ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    symbols, symbol_ends, rules, lengths = repair.compress(ids, ends, 10)
    assert len(symbols) < 0.7 * len(ids) and len(rules) == len(lengths)
    assert (repair.expand(symbols, rules, 10) == ids).all()
    for k, p in enumerate(parts):
        assert (repair.decode_document(symbols, symbol_ends, rules, 10, k) == p).all()
    assert all(len(repair.expand(np.array([10 + k]), rules, 10)) == n for k, n in enumerate(lengths))


def test_packing(docs, rows, empty, ids):
    pieces = packing.pack(docs, tokenids.vocabulary_path(), 64).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for i, t, *_ in rows:
        mine = sorted(by_doc[i], key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in mine), "<u4").tolist() == ids(t)
    for s, held in by_seq.items():
        held.sort(key=lambda p: p.offset)
        assert [p.offset for p in held] == [sum(q.length for q in held[:k]) for k in range(len(held))]
        assert s == max(by_seq) or sum(p.length for p in held) == 64
    assert sorted(by_seq) == list(range(len(by_seq))) and packing.pack(empty, tokenids.vocabulary_path()).count() == 0


def brute_components(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("n", "num", "few", "small"), [(3, 90, 24, 16), (5, 80, 24, 16), (3, 90, 3, 16), (5, 80, 2, 60)])
def test_jaccard(docs, rows, n, num, few, small, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "SMALL", small)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, n, num, 100).collect()}
    assert got == brute_components(rows, n, num, 100)


@pytest.mark.parametrize("num", [75, 80, 90, 97])
def test_jaccard_entries_meet_whatever_is_frequent(num):
    """Sets that link share an entry: all members frequent, none, or some; of equal and unequal sizes, at the very edge of the similarity."""
    rng = np.random.default_rng(num)
    links = 0
    for turn in range(600):
        size = int(rng.integers(1, 40 if turn % 3 else 400))
        x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        spare = len(x) - -(-num * len(x) // 100)
        gone, new = (int(rng.integers(0, spare + 1)), int(rng.integers(0, spare + 2))) if turn % 2 else (spare // 2, spare - spare // 2)
        y = np.unique(np.concatenate([rng.permutation(x)[: len(x) - gone], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < num * (len(x) + len(y) - both):
            continue
        links += 1
        cells = rng.integers(0, 20, 1 << jaccard.CELL_BITS).astype(np.int32)
        if turn % 4 == 0:  # what only one of them has comes anywhere in the order
            cells[(np.setxor1d(x, y) >> np.uint64(64 - jaccard.CELL_BITS)).astype(np.int64)] = rng.integers(5, 20)
        for limit in (0, 2, 5, 10, 100):
            a, b = (jaccard.index_entries(s, cells, limit, num, 100)[0] for s in (x, y))
            assert np.array_equal(x, y) or len(np.intersect1d(a, b))
    assert links > 150


@pytest.mark.parametrize("num", [75, 80, 90, 97])
def test_jaccard_similar_sets_share_as_many_entries_as_they_need(num):
    """Unequal rare parts and sizes, at the edge of the similarity; and sets with little in common share fewer."""
    rng, links, met = np.random.default_rng(num + 1), 0, 0
    for turn in range(400):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(20, 60 if turn % 2 else 600)), dtype=np.uint64))
        spare = len(x) - -(-num * len(x) // 100)
        y = np.unique(np.concatenate([rng.permutation(x)[: len(x) - spare // 2], rng.integers(0, 1 << 63, spare - spare // 2, dtype=np.uint64)]))
        z = np.unique(np.concatenate([x[:1], rng.integers(0, 1 << 63, len(x), dtype=np.uint64)]))
        cells = rng.integers(0, 20, 1 << jaccard.CELL_BITS).astype(np.int32)
        for limit in (0, 1, 3, 5, 10, 19, 100):
            (a, _, p), (b, _, q), (c, _, r) = (jaccard.index_entries(s, cells, limit, num, 100) for s in (x, y, z))
            both = len(np.intersect1d(x, y))
            if 100 * both >= num * (len(x) + len(y) - both):
                links += 1
                assert len(np.intersect1d(a, b)) >= (max(p, q) if min(p, q) else 1)
            if limit == 100 and len(x) * num > jaccard.SMALL * 100:
                met += len(np.intersect1d(a, c)) >= min(max(p, r), jaccard.SHARE)
    assert links > 500 and not met


def test_jaccard_index_grows_with_the_prefix():
    rng = np.random.default_rng(3)
    cells = np.full(1 << jaccard.CELL_BITS, 50, dtype=np.int32)
    for size in (20, 200, 2000):
        x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        assert len(jaccard.index_entries(x, cells, 0, 80, 100)[0]) <= 0.9 * size + 3


def test_jaccard_signatures_never_rule_out_a_link():
    rng = np.random.default_rng(9)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 20_000 if _ % 10 == 0 else 300)), dtype=np.uint64))
        kept = rng.permutation(x)[: int(rng.integers(0, len(x) + 1))]
        y = np.unique(np.concatenate([kept, rng.integers(0, 1 << 64, int(rng.integers(1, 40)), dtype=np.uint64)]))
        both = jaccard.shared_members(x.tobytes(), len(x), y.tobytes(), len(y))
        assert both == len(np.intersect1d(x, y))
        assert jaccard.most_shared(jaccard.signature(x), len(x), jaccard.signature(y), len(y)) >= both


@pytest.mark.parametrize("num", [80, 90])
def test_jaccard_in_groups_of_edited_copies(spark, num, monkeypatch):
    """Many copies of two texts, with so many edits that some pairs link and most do not, in entries that are all large."""
    monkeypatch.setattr(jaccard, "FEW", 2)
    rng, texts = np.random.default_rng(num), []
    for base in range(2):
        words = [f"w{base}x{i}" for i in range(90)]
        for _ in range(90):
            copy = list(words)
            for _ in range(int(rng.integers(0, 6 if num == 90 else 11))):
                copy[int(rng.integers(0, len(copy)))] = f"e{int(rng.integers(0, 40))}"
            texts.append(" ".join(copy[: int(rng.integers(86, 91))]))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for _ in texts:  # labels settle in fewer rounds than there are texts
        was = list(root)
        for i, x in enumerate(sets):
            for j in range(i):
                if root[i] != root[j] and 100 * len(x & sets[j]) >= num * len(x | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if was == root:
            break
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, 3, num, 100).collect()}
    assert got == dict(enumerate(root)) and 10 < len(set(root)) < 170


def test_jaccard_of_nothing_and_repeats(spark, empty):
    assert jaccard.jaccard_components(empty).count() == 0
    odd = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (9, "a b c d"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(odd).collect())
    assert got == [("2", 0, "2"), ("4", 2, "4"), ("4", 2, "4"), ("9", 2, "4"), ("None", 2, "None")]


def test_top_k(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-200, 200, (300, 12))
    x[40] = x[41]
    df = spark.createDataFrame([(int(i), [int(v) for v in r]) for i, r in enumerate(x)], "vec_id long, x array<long>")
    got = [tuple(r) for r in topk.top_k(df.where("vec_id % 20 = 0"), df, 5).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 300, 20):
        s = x @ x[q]
        order = [i for i in sorted(range(300), key=lambda i: (-s[i], i)) if i != q][:5]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(order)]
    assert got == want
    assert topk.top_k(df.limit(0), df).count() == 0
    bad = spark.createDataFrame([(0, None), (1, [1.0, float("nan")]), (2, [1.0, None]), (3, [1.0, 2.0])], "vec_id long, e array<float>")
    assert [r.vec_id for r in bad.where(topk.usable(F.col("e"))).collect()] == [3]


def test_substring_dedup(spark, docs, rows, empty):
    got = {r.doc_id: r for r in lempelziv.strip(docs, 20).collect()}
    seen = {}
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        gone = set()
        for p in range(len(words) - 19):
            run = tuple(words[p : p + 20])
            if seen.setdefault(run, (i, p)) != (i, p):
                gone.update(range(p, p + 20))
        assert (got[i].n_words, got[i].n_removed) == (len(words), len(gone))
        assert got[i].kept == " ".join(w for k, w in enumerate(words) if k not in gone)
        assert got[i]["shard"] == "x" and got[i]["__row"] == "y"
    assert lempelziv.strip(empty).count() == 0


def test_factors_are_greedy_copies_of_earlier_passages(spark, docs, rows):
    """Each factor is a copy of the place it names, in order and without overlap; a plain parser finds the same ones."""
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in lempelziv.factors(docs.select("doc_id", "text"), 20).collect()}
    seen, first_whole = {}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - 19):
            seen.setdefault(tuple(words[i][p : p + 20]), (i, p))
    for i in sorted(words):
        mine, want, open_ = words[i], [], None
        whole = first_whole.setdefault(tuple(mine), i)
        if whole != i and len(mine) >= 20:
            want = [(0, len(mine), whole, 0)]
        else:
            for p in range(len(mine) - 19):
                ref = seen[tuple(mine[p : p + 20])]
                if ref == (i, p):
                    open_ = None
                elif open_ and ref == (open_[2], open_[3] + p - open_[0]):
                    open_[1] = p + 20
                else:
                    start = max(p, want[-1][1][1] if want else 0)
                    open_ = [p, p + 20, ref[0], ref[1]]
                    want.append([start, open_, ref[0], ref[1] + start - p])
            want = [(s, o[1], d, q) for s, o, d, q in want]
        assert got.get(i, []) == want
        for s, e, d, q in want:
            assert words[d][q : q + e - s] == mine[s:e] and (d, q) < (i, s)
        assert all(a[1] <= b[0] for a, b in zip(want, want[1:]))


STAGE_ROWS = "doc_id long, text string, lang string, source string, n_chars long, `a b` map<string,int>, kept string, replica int, maybe string"


def stage_rows():
    """Documents with null and repeated ids, copies, passages that repeat and columns of clashing names."""
    rng = random.Random(21)
    rows = [(i, t, "en", s, n, {"k": 1}, "k", 7, "m") for i, t, _, s, n, *_ in corpus()]
    rows += [(None, sentence(rng, 40), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return [*rows, rows[20], rows[20], (rows[20][0], "quite another text", *rows[20][2:])]


def key(r):
    return str(tuple(r))


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    rows = stage_rows()
    docs = spark.createDataFrame(rows, STAGE_ROWS).repartition(3)
    labels = spark.createDataFrame([(3 * k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for stage in list(stages.values())[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0

    # 1: the rows at or over the threshold, as they are
    sample = quality.labelled(docs, labels)
    scores = quality.score(docs, quality.train(sample), keep=F.struct(*[docs[c] for c in docs.columns])).collect()
    bar = quality.threshold(quality.cross_scores(sample), corpus_pipeline.LOSE)
    got = stages["quality_classifier"](spark, docs, str(tmp_path)).collect()
    assert sorted(map(key, got)) == sorted(key(r.keep) for r in scores if r.score >= bar) and 0 <= bar <= 0.5

    # 2: the first document of each component
    want = brute_components([r for r in rows if r[0] is not None and r[1] != "quite another text"], 5, 80, 100)
    stay = {i for i, (_, c) in want.items() if i == c}
    got = stages["ngram_jaccard_join"](spark, docs, str(tmp_path)).collect()
    assert sorted(map(key, got)) == sorted(key(r) for r in docs.collect() if r.doc_id is None or r.doc_id in stay)

    # 3: texts without words that an earlier run of 20 covers; rows of one id and other texts follow the greatest
    plain = [r for r in rows if r[1] != "quite another text"]
    clean = spark.createDataFrame(plain, STAGE_ROWS)
    seen, out, by_id = {}, [], {}
    for i, t in sorted({(r[0], r[1]) for r in plain if r[0] is not None}, key=lambda x: x[0]):
        words, gone = WORD.findall(t or ""), set()
        for p in range(len(words) - 19):
            if seen.setdefault(tuple(words[p : p + 20]), (i, p)) != (i, p):
                gone.update(range(p, p + 20))
        by_id[i] = t if not gone else " ".join(w for k, w in enumerate(words) if k not in gone)
    for r in plain:
        left = r[1] if r[0] is None else by_id[r[0]]
        if left or not WORD.findall(r[1] or ""):
            out.append((r[0], left, None if left is None else len(left)))
    got = stages["substring_dedup"](spark, clean, str(tmp_path)).collect()
    assert sorted(str((r.doc_id, r.text, r.n_chars)) for r in got) == sorted(map(str, out))
    assert {r.maybe for r in got} == {"m", None} and {r.kept for r in got} == {"k", None}

    # 4: the counts that the rates give, by hand
    rates = {r.source: r.rate for r in mixing.rates(docs, None, 0.5, "source", "text").collect()}
    want = []
    for r in docs.collect():
        u = int(hashlib.md5(f"0:{'' if r.doc_id is None else r.doc_id}:1".encode()).hexdigest()[:13], 16) / (1 << 52)
        k, p = 0, np.exp(-rates[r.source])
        total = p
        while total <= u:
            k += 1
            p *= rates[r.source] / k
            total += p
        want += [key(r)] * k
    got = stages["mix_sources"](spark, docs, str(tmp_path)).collect()
    assert sorted(map(key, got)) == sorted(want) and max(rates.values()) < 200


def test_pipeline_stages_keep_what_is_clean(spark):
    sf = "/root/testdata/sf0.001"
    start = docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), start.schema)
        assert docs.columns == start.columns and docs.count() > 0, name
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_any_stretch_of_ids_is_read_alone(spark, docs, rows, ids, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_IDS", 700)
    path = f"{tmp_path}/files"
    repair.write_token_files(docs, path, tokenids.vocabulary_path())
    whole = [i for _, t, *_ in rows for i in ids(t)]
    rng = random.Random(3)
    asked = [(f"r{k}", a, min(len(whole), a + rng.randrange(1, 2000))) for k, a in enumerate(rng.randrange(len(whole)) for _ in range(20))] + [("none", 5, 5), ("all", 0, len(whole))]
    found = {}
    for r in repair.read_ranges(spark, path, spark.createDataFrame(asked, "name string, start long, stop long")).collect():
        found.setdefault(r.name, []).append((r.at, r.ids))
    for name, a, b in asked:
        assert np.frombuffer(b"".join(x for _, x in sorted(found.get(name, []))), "<u4").tolist() == whole[a:b]


def test_ids_are_the_librarys(ids):
    """Runs of white space, blank lines, blanks outside ASCII, special tokens and long texts, whatever stands beside them."""
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u3000", "\u2003", "\x1c", "\x85", "\u180e", "\u200b", "\ufeff", "a", "K", "'s", "'", "!", "<|endoftext|>", "é", "漢字", "7", "12", ".", "-", "\r\n", "\0", "🙂"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 14))) for _ in range(5000)]
    texts += ["First paragraph.\n\nSecond paragraph.", "a\n\nK", "x:\n\n- item", " ", "", "w" * 300_000, sentence(rng, 400_000)]
    coder = tokenids.encoder(tokenids.vocabulary_path())
    for at in range(0, len(texts), 50):
        some = [t.encode() for t in texts[at : at + 50]]
        got, counts = coder.encode(np.frombuffer(b"".join(some), np.uint8), np.append(0, np.cumsum([len(t) for t in some])), 0)
        for t, g in zip(texts[at : at + 50], np.split(got, np.cumsum(counts)[:-1]), strict=True):
            assert g.tolist() == ids(t), t[:80]


def test_lone_words_share_calls_of_the_library(ids):
    """Words of letters are encoded many at a time, with the ids that they have alone; signs and letters beyond Latin-1 are left as they are."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab Zé×÷ÿÀñ'\n.9ŃÃ ") for _ in range(rng.randrange(0, 30))) for _ in range(2000)] + ["é", "×a", " É", "Ã", "Ń a", "ÿÀ"]
    coder, raw, sent = tokenids.PieceEncoder(tokenids.vocabulary_path()), [t.encode() for t in texts], []
    encode = coder._ids
    coder._ids = lambda some: sent.append(len(some)) or encode(some)
    got, counts = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw])), 0)
    for t, g in zip(texts, np.split(got, np.cumsum(counts)[:-1]), strict=True):
        assert g.tolist() == ids(t), t
    assert 0 < sum(sent) < coder.known


def plain_features(text):
    """The features of one text as {place: value}, word by word."""
    from ledgerloom.llm.wordhash import mix64, span_hashes

    def hashed(b):
        return int(span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])

    def mixed(v):
        return int(mix64(np.array([v & (1 << 64) - 1], dtype=np.uint64))[0])

    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+|([!-/:-@[-`{-~\x00-\x08\x0e-\x1f\x7f])\1*", text) and [m.group(0) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|([!-/:-@[-`{-~\x00-\x08\x0e-\x1f\x7f])\1*", text)]
    sign = [not re.match(rb"[0-9A-Za-z\x80-\xff]", w) for w in words]
    loud = [len(w) > 1 and w.isalpha() and w.isupper() and all(c < 128 for c in w) for w in words]
    h = [hashed((w[:3] if s else w).lower() if all(c < 128 for c in w) else bytes(c + 32 if 65 <= c <= 90 else c for c in w)) for w, s in zip(words, sign)]
    shape = [x if s else 1 if u else 2 for x, s, u in zip(h, sign, loud)]
    keys = set(h)
    keys |= {mixed(a * 0x9E3779B97F4A7C15 + b) for a, b in zip(h, h[1:])} | {mixed(a * 0xD6E8FEB86659FD93 + b + 7) for a, b in zip(shape, shape[1:])}
    places = {k >> 64 - quality.BITS for k in keys}
    n, size = max(1, len(words)), max(1, len(text))
    distinct = len({x >> 24 for x in h}) / n
    extra = [1, distinct, sum(sign) / n, sum(loud) / n, np.log1p(size) / 10, np.log1p(n) / 10, distinct**2, sum(65 <= c <= 90 for c in text) / size]
    return {p: len(places) ** -0.5 for p in places} | {(1 << quality.BITS) + k: v for k, v in enumerate(extra)}


def test_features_and_updates_against_plain_versions():
    rng = random.Random(9)
    texts = [t.encode() for t in ["", "a", "WOW such WOW!!!! é É ok", "x,,, y -- Z9 $$$$$ $$", sentence(rng, 60), sentence(rng, 25).upper()]]
    offsets = np.cumsum([0, *map(len, texts)])
    i, x, first = quality.features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    made = [dict(zip(i[a:b].tolist(), x[a:b].tolist())) for a, b in zip(first, first[1:])]
    for got, t in zip(made, texts):
        want = plain_features(t)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    labels = [1, 0, 1, 0, 1, 0]
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        return -(z[k] - np.sign(z[k]) * quality.L1) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for f, y in zip(made, labels):
            p = 1 / (1 + np.exp(-sum(weight(k) * v for k, v in f.items())))
            step = {k: ((p - y) * v, weight(k)) for k, v in f.items()}
            for k, (g, w) in step.items():
                z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / quality.ALPHA * w
                n[k] = n.get(k, 0.0) + g * g
    got = quality.ftrl([(i[a:b], x[a:b]) for a, b in zip(first, first[1:])], np.array(labels))
    assert np.count_nonzero(got) > 50 and all(abs(got[k] - weight(k)) < 1e-5 for k in z)


AWKWARD = "doc_id long, text string, block string, __block string, `n words` int"


def awkward(spark, n=600):
    """Null and repeated ids, one id far from all others, a third of the rows without an id."""
    rng = random.Random(12)
    ids = [None if k % 3 == 0 else k // 2 if k % 5 == 0 else k for k in range(n - 1)] + [1 << 62]
    return spark.createDataFrame([(i, sentence(rng, rng.randrange(0, 9)), "b", "c", 1) for i in ids], AWKWARD).repartition(4)


def test_numbers_follow_the_key_whatever_its_values(spark):
    df = awkward(spark)
    got = common.numbered(df, "doc_id", [F.col("text")], "number", rows_per_block=20).collect()
    assert sorted(r.number for r in got) == list(range(600)) and got[0].asDict().keys() == {*df.columns, "number"}
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.number)]
    assert ordered == [None] * 200 + sorted(i for i in ordered if i is not None)
    sizes = df.withColumn("b", common.block_of(df, "doc_id", F.col("text"), 20)).groupBy("b").count().collect()
    assert max(r["count"] for r in sizes) < 60 and len(sizes) > 15


def test_next_document_with_awkward_ids(spark):
    df = awkward(spark).select("doc_id", "text")
    got = fingerprints.with_next(df, "doc_id", "text", lambda d: d, ["doc_id", "text"], rows_per_block=20).collect()
    assert len(got) == 600
    known = sorted((r.doc_id, r.text, r.next.doc_id) for r in got if r.doc_id is not None)
    ids = [i for i, *_ in known]
    for k, (i, _, after) in enumerate(known[:-1]):
        assert after in (i, ids[k + 1]) or after == min(j for j in ids if j > i)
    assert known[-1][2] is None and sum(r.next.doc_id is None for r in got) == 200
    alone = fingerprints.with_next(df.where("doc_id = 1"), "doc_id", "text", lambda d: d, ["doc_id"]).collect()
    assert [r.next.doc_id for r in alone] == [1]


def plain_permutation(number, n, seed):
    """The Feistel walk of one row number in plain Python."""
    import math

    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def once(p):
        left, right = divmod(p, b)
        for turn in range(sharding.ROUNDS):
            key = (turn * 104729 + (seed * 7919) % 2147483647) % 2147483647
            x = ((right if turn % 2 == 0 else left) % 2147483647 * 48271 + key) % 2147483647
            x = (x ^ x >> 15) * 40503 % 2147483647
            x ^= x >> 13
            left, right = ((left + x) % a, right) if turn % 2 == 0 else (left, (right + x) % b)
        return left * b + right

    p = once(number)
    while p >= n:
        p = once(p)
    return p


def test_shard_and_slot_can_be_computed_alone(spark):
    df = awkward(spark).withColumn("shard", F.lit("x"))
    got = sharding.shard(df, 7, "doc_id", [F.col("text")], seed=5).collect()
    numbers = {p % 7 * 1000 + p // 7 for p in (plain_permutation(k, 600, 5) for k in range(600))}
    assert {r["shard"] * 1000 + r["slot"] for r in got} == numbers and got[0]["block"] == "b" and len(got) == 600
    largest = next(r for r in got if r.doc_id == 1 << 62)
    assert divmod(plain_permutation(599, 600, 5), 7) == (largest["slot"], largest["shard"])


def plain_sketch(spark, text):
    """Closed syncmers of one text in plain Python, with Spark's hash of single values looked up."""
    units = re.findall(r"\S{1,4}", text)
    h = [r[0] for r in spark.createDataFrame([(u,) for u in units], "u string").select(F.xxhash64("u")).collect()] if units else []

    def pairs(values):
        return [r[0] for r in spark.createDataFrame(values, "a long, b long").select(F.xxhash64("a", "b")).collect()] if values else []

    inner = pairs([(h[i], h[i + 1]) for i in range(len(h) - 1)]) if len(h) >= 4 else []
    if len(inner) >= 3:
        spots = [i for i in range(len(inner) - 2) if min(inner[i : i + 3]) != inner[i + 1] or inner[i + 1] in (inner[i], inner[i + 2])]
        anchors = list(zip(pairs([(inner[i], inner[i + 2]) for i in spots]), spots, strict=True))
    else:
        anchors = list(zip(h, range(len(h)), strict=True))
    first = {h: p for h, p in reversed(anchors)}
    return dict(sorted(first.items())[: fingerprints.SKETCH])


def test_fingerprints_and_likeness_by_hand(spark):
    rng = random.Random(4)
    texts = ["", "a", "ab cd", "one two three", sentence(rng, 30), sentence(rng, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(df).collect()}
    sketches = [plain_sketch(spark, t) for t in texts]
    for k, s in enumerate(sketches):
        assert got[k].fingerprint == ",".join(f"{h & (1 << 64) - 1:016X}:{p:X}" for h, p in s.items())
        after = sketches[(k + 1) % len(texts)]
        either = sorted({*s, *after})[: fingerprints.SKETCH]
        moved = [after[h] - s[h] for h in either if h in s and h in after]
        want = sum(m == 0 or moved.count(m) > 1 for m in moved) / len(either) if either else 1
        assert abs(got[k].near_next - want) < 1e-12


def test_top_k_is_exact_at_any_size(spark):
    rng = np.random.default_rng(3)
    big = [(i, [int(v) for v in rng.integers(-(1 << 30), 1 << 30, 6)]) for i in range(60)] + [(60, [5, 5]), (61, []), (7, [1 << 30] * 6)]
    df = spark.createDataFrame(big, "vec_id long, x array<long>")
    got = [tuple(r) for r in topk.top_k(df.where("vec_id % 20 = 0"), df, 4).orderBy("query_id", "rank").collect()]
    want = []
    for q, x in big:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in big if i != q)[:4]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_stops_reading_where_scores_are_peaked():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(2000, 16)) ** 7 * 5)
    left, read = topk.candidates_left(x[:64], np.arange(64), x, np.arange(2000), 5)
    full = x[:64] @ x.T
    np.fill_diagonal(full, -np.inf)
    assert all(left[q][np.argsort(-full[q])[:5]].all() for q in range(64)) and not left[np.arange(64), np.arange(64)].any()
    assert read < 0.4 * 64 * x.size and left.sum() < 64 * 100


def test_anchors_match_by_position(spark):
    rng = random.Random(6)
    shared, other = sentence(rng, 80), sentence(rng, 80)
    texts = [(1, shared), (2, sentence(rng, 12) + " " + shared), (3, other), (4, sentence(rng, 90)), (None, shared), (5, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = fingerprints.positional_matches(df).collect()
    shift = len(re.findall(r"\S{1,4}", texts[1][1])) - len(re.findall(r"\S{1,4}", shared))
    assert [(r.doc_id, r.ref_doc, r["shift"]) for r in got] == [(2, 1, shift)] and got[0].n > 30
    assert fingerprints.positional_matches(df.limit(0)).count() == 0


def test_words_in_binary_sequences_hash_apart():
    """Sequences on which sums over powers modulo 2**64 agree."""
    from ledgerloom.llm.wordhash import span_hashes

    one = bytes(b"ab"[bin(k).count("1") % 2] for k in range(4096))
    two = bytes(b"ba"[bin(k).count("1") % 2] for k in range(4096))
    got = span_hashes(np.frombuffer(one + two, np.uint8), np.array([0, 4096]), np.array([4096, 8192]))
    assert got[0] != got[1]
