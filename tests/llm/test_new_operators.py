"""Operators 11 to 13 against brute force on small tables with awkward rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import audit, simhash, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask string, fp string, node string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sentence(rng, n, letters="abcdefgéß#"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))


def corpus():
    rng = random.Random(11)
    base = sentence(rng, 260)
    texts = [None, "", "   \n", "That it.", "that IT.", "one two", base, base, base.upper(), "x  y  z\n\n it's 12 　q", "l " * 3000, "a b c", "b" * 5000]
    for k in range(60):
        words = base.split(" ")
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        texts.append(" ".join(words) + (" " if k % 9 == 0 else ""))
    texts += [sentence(rng, rng.randrange(1, 300)) for _ in range(25)]
    texts += rng.choices(texts, k=20)
    rng.shuffle(texts)
    rows = [(3 * k if k % 17 else None, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), "x", "y", "z") for k, t in enumerate(texts)]
    return rows + rows[5:9] + [(rows[1][0], "another text under a used id", "en", "", 3, "x", "y", "z")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_fingerprint(text, n=3):
    words = WORD.findall(lowered(text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    held = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in held) > len(held))


def plain_components(nodes, linked):
    """Smallest first member of each node (doc_id, fp) by links and equal ids' own fingerprints."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(nodes, 2):
            if linked(a[1], b[1]) and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


@pytest.mark.parametrize(("within", "segments", "few"), [(2, 5, 32), (2, 5, 1), (3, 7, 1), (1, 4, 1)])
def test_simhash(docs, rows, within, segments, few, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", few)
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(docs, within=within, segments=segments).collect())
    given = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    low = {}
    for i, fp in given:
        if i is not None:
            low[fp] = min(i, low.get(fp, i))
    nodes = [(d, fp) for fp, d in low.items()]
    comp = plain_components(nodes, lambda a, b: (a ^ b).bit_count() <= within)
    assert got == Counter((i, fp, None if i is None else comp[low[fp], fp][0]) for i, fp in given)
    assert len({c for c in comp.values()}) < len(nodes)


def test_simhash_large_buckets(spark):
    """Many near fingerprints, without texts: components as brute force has them, whatever the size of buckets."""
    rng = random.Random(3)
    made = {rng.getrandbits(64) for _ in range(200)}
    for centre in list(made)[:3]:
        made |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    nodes = [(k, fp) for k, fp in enumerate(sorted(made))]
    comp = plain_components(nodes, lambda a, b: (a ^ b).bit_count() <= 2)
    classes = spark.createDataFrame([((d, simhash.signed(fp)), simhash.signed(fp)) for d, fp in nodes], "node struct<doc:long,fp:long>, fp long")
    path = simhash.workspace(spark)
    found = {r.node.doc: r.comp.doc for r in simhash.components(simhash.links(classes, 2, 5, path), path).collect()}
    assert {d: found.get(d, d) for d, _ in nodes} == {d: comp[d, fp][0] for d, fp in nodes}
    assert simhash.bucketed(classes, 2, 5).groupBy("start", "key").count().where(f"count > {simhash.FEW}").count() > 0


def test_some_chain_is_always_in_budget():
    rng = random.Random(4)
    for within, segments in ((1, 4), (2, 5), (2, 9), (3, 7)):
        allowed = simhash.budgets(within, segments)
        for _ in range(2000):
            apart = sum(1 << b for b in rng.sample(range(64), rng.randrange(within + 1)))
            assert any(all((apart & mask).bit_count() <= most for mask, most in zip(chain, allowed, strict=True)) for chain in simhash.chains(segments))


def test_simhash_empty(empty):
    assert simhash.simhash_components(empty).count() == 0


def plain_words(rows, lose_every):
    counts = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if lose_every and h % lose_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def plain_forms(words, ratio):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(a == b[:p] + b[p + 1 :] for p in range(len(b)))

    neighbours = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in neighbours.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(neighbours[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def misspelt():
    """Texts of few letters, so that many words are near each other, among them chains, runs of one letter and signs at the upper bound."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 10))) for _ in range(150)] + ["a" * k for k in range(5, 12)] + ["ÿÿÿÿÿÿ", "Aÿÿÿÿÿ", "×÷×÷×÷", "l" * 3000, "l" * 3001]
    weights = [6 ** rng.randrange(4) for _ in words]
    words, weights = [*words, "qwertzu", "qwertzo", "qwertso"], [*weights, 15, 150, 1500]
    out = [(None if k % 13 == 0 else k // 2, " ".join(w.upper() if w.isascii() and rng.random() < 0.2 else w for w in rng.choices(words, weights, k=300)) + rng.choice(["-", "1x", " Œuvre", "\n"])) for k in range(40)]
    return [*out, (7, None), (8, ""), (9, "12 34"), *out[:2]]


@pytest.mark.parametrize(("lose_every", "block", "held"), [(None, 1 << 17, 100_000), (7, 1 << 17, 100_000), (7, 300, 10)])
def test_spelling(spark, misspelt, lose_every, block, held, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "HELD_WORDS", held)
    monkeypatch.setattr(spelling, "LONG", 1000)
    table = spark.createDataFrame([(*r, 1) for r in misspelt], "doc_id long, text string, word long").repartition(3)
    words = {w: n for w, n in plain_words(misspelt, lose_every).items() if len(w) >= 6 and n >= 5}
    got = rows_of(spelling.spelling_variants(table, lose_every=lose_every))
    want = sorted(plain_forms(words, 5), key=repr)
    assert got == want
    assert sum(1 for r in got if r[1]) > 5
    assert lose_every or any(r[2] != r[1] for r in got if r[1])


def test_spelling_of_short_words(spark):
    rng = random.Random(13)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 400) for _ in range(150)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.spelling_forms(table, 2)) == sorted(plain_forms(words, 2), key=repr)


def test_spelling_empty(empty):
    assert spelling.spelling_variants(empty).count() == 0


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 201):
        s = rng.permutation(n)
        a, b, c, d = (rng.integers(0, n + 1, 60) for _ in range(4))
        which, value = spelling.WaveletTree(s).report(a, b, c, d)
        want = {(k, v) for k in range(60) for v in s[a[k] : b[k]].tolist() if c[k] <= v < d[k]}
        assert len(which) == len(want) and set(zip(which.tolist(), value.tolist(), strict=True)) == want


def plain_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, _, source, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        docs.append((i, source or "", fails))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for _, p, _ in docs}:
            held = [(i, f) for i, p, f in docs if p == part]
            all_ = held
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in held if f[x]]
                held = [(i, f) for i, f in held if not f[x]]
                failing = [f for _, f in all_ if f[x]]
                shapley[part, x] += len(gone)
                out[part, order, step] = (len(held), len(gone), len(failing) - len(gone), sum(1 for f in failing if sum(f.values()) == 1), sum(1 for i, _ in gone if i in good), sum(1 for i, _ in gone if i in toxic))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("ranges", [4, 40])
def test_audit(spark, docs, rows, ranges, monkeypatch):
    """40 ranges cut through copies of one text, one after another."""
    monkeypatch.setattr(audit, "LISTED", 50)
    labels = [(r[0], k % 2, 1 - k % 3 % 2) for k, r in enumerate(rows) if k % 4] + [(None, 1, 1), (3, None, None), (999999, 1, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        copies = spark.createDataFrame([*rows, *[(10_000 + k, rows[3][1], "en", f"s{k % 3}", 0, "x", "y", "z") for k in range(200)]], SCHEMA)
        given = [tuple(r) for r in copies.collect()]
        got = audit.audit(copies, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain_audit(given, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want and len(got) == len(want)


def test_audit_empty(spark, empty, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(empty, none).count() == 0
    assert audit.audit(docs, none).where("good_lost + toxic_lost > 0").count() == 0
