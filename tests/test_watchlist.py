"""No similar name is lost: the candidate index against all pairs."""

from hypothesis import given, settings
from hypothesis import strategies as st
import random

from pyspark.sql import functions as F

from ledgerloom.functions import documents, money, names
from ledgerloom.operators import surveillance, watchlist
from ledgerloom.sources import statements


def test_similar_names_equals_all_pairs(spark):
    rng = random.Random(2)
    own = {"".join(rng.choice("ABCDE ") for _ in range(rng.randrange(1, 12))).strip() for _ in range(150)} - {""}
    for name in list(own)[:60]:  # short and long forms, and names with one letter moved
        own |= {name[: max(1, len(name) // 2 + 1)], name + name, name[1:] + name[:1]}
    own |= {"TRAN THI NGOC", "MARTHA", "CASINOABC"}
    listed = [*sorted(own)[::5], "TRAN THI", "MARTHAXXXX", "CASINO", ""]
    table = spark.createDataFrame([(k, n, n) for k, n in enumerate(listed)], "position int, entry string, other string")
    for least in (7_500, 9_000, 9_200, 10_000):
        got = {(r.name, r.position) for r in watchlist.similar_names(spark.createDataFrame([(n,) for n in own], "name string"), table, least).collect()}
        assert got == {(a, k) for a in own for k, b in enumerate(listed) if b and names.truncated_winkler(a, b) >= least}
    assert {("TRAN THI NGOC", listed.index("TRAN THI")), ("MARTHA", listed.index("MARTHAXXXX"))} <= {(a, k) for a in own for k, b in enumerate(listed) if b and names.truncated_winkler(a, b) >= 9_000}


@given(st.text("ABCD", min_size=1, max_size=12), st.text("ABCD", min_size=1, max_size=12), st.sampled_from([7_200, 8_000, 9_000, 9_200, 9_900]))
@settings(max_examples=3000, deadline=None)
def test_bounds_hold_for_every_similar_pair(a, b, least):
    if names.truncated_winkler(a, b) < least:
        return
    tokens = [{(x, s[: i + 1].count(x)) for i, x in enumerate(s)} for s in (a, b)]
    shared, same = len(tokens[0] & tokens[1]), names._same_start(a, b)
    need = watchlist.least_jaro(least, same)
    assert shared * (len(a) + len(b)) * 10_000 >= (3 * need - 10_000) * len(a) * len(b)
    lowest = min(watchlist.least_jaro(least, k) for k in range(5))
    order = [sorted(t, key=lambda u: (-u[1], -ord(u[0]))) for t in tokens]
    prefixes = [set(o[: max(0, len(o) - max(1, -(-len(o) * max(0, 3 * lowest - 20_000) // 10_000)) + 1)]) for o in order]
    assert prefixes[0] & prefixes[1]


def test_ratio_beyond_64_bits_is_null(spark):
    big = 9 * 10**18
    given_ = [(big, 9, 1), (big, 9, 10), (-big, 9, 1), (5, 1, 2), (7, 1, 2), (-7, 1, 2), (big, big, big), (1, 1, 0), (big, big, 1), (-(2**63), 1, 1), (2**62, 2, -1), (2**62, 2, 1)]
    rows = spark.createDataFrame(given_, "a long, n long, d long").select(money.times_ratio(F.col("a"), F.col("n"), F.col("d")).alias("r")).collect()

    def want(a, n, d):
        if not d:
            return None
        whole, rest = divmod(abs(a * n), abs(d))
        whole += 2 * rest > abs(d) or (2 * rest == abs(d) and whole % 2)
        out = whole if (a * n < 0) == (d < 0) else -whole
        return out if -(2**63) <= out < 2**63 else None

    assert [r.r for r in rows] == [want(*g) for g in given_]


def test_totals_are_whole_words(spark):
    content = "Date;Ref;Amount;Note\n2024-01-01;R1;1;x\nsummary of fees;R2;2;y\n2024-01-02;R3;3;z\nTổng cộng;;9;\n2024-01-03;R4;5;y\n"
    files = spark.createDataFrame([("f", content)], "file string, content string")
    aliases = {"date": ["Date"], "ref": ["Ref"], "amount": ["Amount"], "narration": ["Note"]}
    assert [r.ref_code for r in statements.delimited(files, aliases).orderBy("row_id").collect()] == ["R1", "R2", "R3"]
    assert [tuple(r) for r in statements.ends(files, aliases).collect()] == [("f", 4, 1)]


def test_last_narration_of_mt940_gains_no_blank(spark):
    files = spark.createDataFrame([("f", ":25:1\n:61:2401010101C5,00NTRFX\n:86:a\nb\n")], "file string, content string")
    assert [r.narration for r in statements.mt940(files).collect()] == ["a b"]


def test_triples(spark):
    texts = {
        "see [[A1]] and [[B1|b]] then [[B1]] [[C1]]": [("A1", "links_to", "B1"), ("B1", "links_to", "C1")],
        "Anna IS A friend of Bob. yes, Bob created Tool; Tool is a thing": [("Anna", "friend_of", "Bob"), ("Bob", "created", "Tool"), ("Tool", "is_a", "thing")],
        "Bob lives in Rome, Bob lives in Rome": [("Bob", "located_in", "Rome")],
        "she likes tea. Hà Nội là thủ đô của Việt Nam": [("Hà Nội", "capital_of", "Việt Nam")],
        "": [],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", documents.triples(F.col("text")).alias("t")).collect()
    assert {r.text: [tuple(x) for x in r.t] for r in rows} == texts
    assert spark.createDataFrame([(None,)], "text string").select(documents.triples(F.col("text")).alias("t")).first().t in (None, [])


def test_fused_scores_by_hand(spark):
    rows = [(1, 1, 19_500, 1000, True, "x"), (2, 1, 40_000, 1030, False, "x"), (3, 2, 100, 5 * 86_400, True, "x"), (4, 3, 100, 9 * 86_400, True, "x"), (5, 4, 101, 9 * 86_400, True, "x"), (6, 5, 102, 9 * 86_400, True, "x")]
    tx = spark.createDataFrame(rows, "tx_id long, account long, amount long, ts long, is_credit boolean, narration string")
    listed = spark.createDataFrame([(3, 2, "KEYWORD"), (3, 2, "NAME")], "tx_id long, account long, list string")
    risks = spark.createDataFrame([(3, 9_500, "A"), (4, 8_100, "B")], "tx_id long, bps int, category string")
    got = {r.tx_id: (r.score, r.reasons) for r in surveillance.enhanced_scores(tx, listed, risks).collect()}
    # 1: its pair's transit alert, a burst, the band and an outlier; 2: high value, a burst and an outlier
    assert got[1] == (3_500 + 1_500 + 3_000, "statutory,burst,band,outlier") and got[2] == (3_500 + 1_500 + 2_500, "statutory,burst,outlier")
    assert got[3] == (2_500 + 3_500 + 2_375, "statutory,narration") and 4 not in got and 5 not in got


def test_alerts_and_risks_keep_every_row(spark):
    rows = [(1, 7, 7, "Tran Thi Ngoc", "danh  bac USDT"), (1, 11, 7, None, None), (2, 5, 11, "", "binanse"), (3, 5, 6, "TRẦN THỊ NGỌC", "danh bac"), (3, 5, 6, "TRẦN THỊ NGỌC", "danh bac"), (4, None, None, "x", "")]
    tx = spark.createDataFrame(rows, "tx_id long, account long, counter_account long, counterparty string, narration string")
    accounts, names_ = spark.createDataFrame([(1, 7), (0, 11)], "position int, account long"), spark.createDataFrame([(0, "Tran Thi Ngoc")], "position int, name string")
    got = sorted(tuple(r) for r in watchlist.watchlist(tx, ["danh bac", "USDT"], accounts, names_, ("account",)).select("tx_id", "account", "list", "entry").collect())
    assert got == sorted([(1, 7, "KEYWORD", "USDT"), (1, 7, "ACCOUNT", "7"), (1, 7, "NAME", "Tran Thi Ngoc"), (1, 11, "ACCOUNT", "11"), (2, 5, "ACCOUNT", "11"), *[(3, 5, "KEYWORD", "danh bac"), (3, 5, "NAME", "Tran Thi Ngoc")] * 2])
    risks = sorted((r.tx_id, r.bps, r.category or "") for r in watchlist.whole_risk(tx, {"C": ["USDT", "BINANCE"], "G": ["danh bac"]}).collect())
    assert risks == sorted([(1, 9_500, "G"), (1, 0, ""), (2, 8_300, "C"), (3, 9_500, "G"), (3, 9_500, "G"), (4, 0, "")])


def test_texts_are_searched_once_each(spark):
    """What is asked of a text is not pushed below the grouping of texts, where every row would pay for it."""
    tx = spark.range(1000).selectExpr("id AS tx_id", "id % 9 AS account", "id % 7 AS counter_account", "concat('a', id % 3) AS counterparty", "concat('pay ', id % 5) AS narration")
    listed = watchlist.watchlist(tx, ["danh bac"], spark.createDataFrame([(0, 3)], "position int, account long"), spark.createDataFrame([(0, "ab")], "position int, name string"))
    for found in (listed, watchlist.whole_risk(tx, {"C": ["BINANCE"]})):
        above = []
        for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines():
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [a for a in above if a[0] < depth]
            assert not ("translate" in line and any("Aggregate [narration#" in a or "Aggregate [counterparty#" in a for _, a in above if "min(" not in a)), line[:300]
            above.append((depth, line))
