"""Queries of names, references, masks, watchlists and statements, over texts built from the driver's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import names
from ledgerloom.functions import text as T
from ledgerloom.operators import credit as K
from ledgerloom.operators import reconcile as R
from ledgerloom.operators import surveillance as S
from ledgerloom.operators import watchlist as W
from ledgerloom.plans.registry import BANK, BURST, HOUR, MEDIAN, MULE, NIGHT, STRUCT, SURGE, TXN, query
from ledgerloom.sources import statements as P
from ledgerloom.sources.adapters import bank_lines, invoices, table, transactions

NAMES = ["CÔNG TY CỔ PHẦN THƯƠNG MẠI NGUYỄN HỮU ĐỨC", "Công ty TNHH Ánh Dương", "Banking Group", "GROUPON LTD", "Tập đoàn Hoàng Anh Gia Lai", "Trần Thị Ngọc", "An Phát JSC", "Hải Đăng Máy Bơm", "CTY TNHH MTV Sông Hồng", "", "Hòa Bình Corp", "LTD"]
NOTES = ["ck tien HAGL hd 2026-8889", "TT tien may bom hai dang INV 00123", "thanh toan don hang cho song hong", "phi dich vu", "nap USDT binance", "AP chuyen khoan PC-778", "chuyển tiền nhanh cho Trần Thị Ngọc stk 0123456789", "danh bac online", "call 0912345678 or 012345678901", "p2p", "binanse topup", "", "PHI HD 2026/77 FT12345 VN-4567"]
PAIR_SQL = f"pairs AS (SELECT c_custkey AS id, {NAMES!r}[c_custkey % 12 + 1] AS name, {NOTES!r}[c_custkey * 7 % 13 + 1] AS note, {NAMES!r}[c_custkey * 5 % 7 + 1] AS other FROM customer)"


def pairs(spark, d) -> DataFrame:
    def pick(values: list[str], at) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))

    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), pick(NAMES, k % 12).alias("name"), pick(NOTES, k * 7 % 13).alias("note"), pick(NAMES, k * 5 % 7).alias("other"))


UP = "upper(replace(replace(strip_accents({0}), 'đ', 'd'), 'Đ', 'D'))"
PHRASES = ["JOINT STOCK COMPANY", "CONG TY CO PHAN", "CONG TY TNHH MTV", "CONG TY TNHH", "CONG TY", "TAP DOAN", "CO PHAN", "CO LTD"]
TOKENS = ["COMPANY", "GROUP", "BANK", "JSC", "LTD", "CTY", "TNHH", "CP", "MTV", "TM", "DV", "XNK"]


def core_sql(x: str) -> str:
    """The telling words of a name as a list: padded, phrases cut one after the other, tokens filtered."""
    out = f"' ' || replace(trim(regexp_replace({UP.format(x)}, '[^A-Z0-9]+', ' ', 'g')), ' ', '  ') || ' '"
    for p in PHRASES:
        out = f"replace({out}, ' {p.replace(' ', '  ')} ', '')"
    return f"list_filter(string_split(trim(regexp_replace({out}, ' +', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains({TOKENS!r}, w))"


@query("txt_unmarked", f"WITH {PAIR_SQL} SELECT id, {UP.format('name')} AS name, {UP.format('note')} AS note FROM pairs")
def _(spark, d):
    return pairs(spark, d).select("id", T.unmarked_upper(F.col("name")).alias("name"), T.unmarked_upper(F.col("note")).alias("note"))


@query("txt_core_of_firms", f"WITH {PAIR_SQL}, c AS (SELECT id, name, array_to_string({core_sql('name')}, ' ') AS core FROM pairs) SELECT id, CASE WHEN core = '' THEN trim(regexp_replace({UP.format('name')}, '[^A-Z0-9]+', ' ', 'g')) ELSE core END AS core FROM c")
def _(spark, d):
    return pairs(spark, d).select("id", T.core_name(F.col("name")).alias("core"))


@query("udf_winkler_float", f"WITH {PAIR_SQL} SELECT id, round(jaro_winkler_similarity({UP.format('name')}, {UP.format('other')}), 9) AS similarity FROM pairs WHERE name <> '' AND other <> ''")
def _(spark, d):
    rows = pairs(spark, d).where("name <> '' AND other <> ''")
    return rows.select("id", F.round(names.winkler(T.unmarked_upper(F.col("name")), T.unmarked_upper(F.col("other"))), 9).alias("similarity"))


@query(
    "udf_winkler_truncated",
    f"""WITH {PAIR_SQL}, j AS (SELECT id, {UP.format('name')} AS a, {UP.format('other')} AS b, jaro_similarity({UP.format('name')}, {UP.format('other')}) AS j FROM pairs WHERE name <> '' AND other <> '')
    SELECT id, a = b AS same, j >= 0.7 AS close FROM j""",
)
def _(spark, d):
    rows = pairs(spark, d).where("name <> '' AND other <> ''")
    bps = names.winkler_bps(T.unmarked_upper(F.col("name")), T.unmarked_upper(F.col("other")))
    return rows.select("id", (bps == 10_000).alias("same"), (bps >= 6_998).alias("close"))


PARTY = f"""c AS (SELECT *, {core_sql('name')} AS one, {core_sql('other')} AS two, {UP.format('trim(name)')} AS pa, {UP.format('trim(other)')} AS pb FROM pairs),
    e AS (SELECT *, array_to_string(one, ' ') AS x, array_to_string(two, ' ') AS y, len(list_distinct(one)) AS n1, len(list_distinct(two)) AS n2, len(list_intersect(list_distinct(one), list_distinct(two))) AS shared FROM c),
    f AS (SELECT *, CASE WHEN least(n1, n2) > 0 THEN shared / least(n1, n2) ELSE 0 END AS held, CASE WHEN x = '' OR y = '' THEN 0 ELSE jaro_winkler_similarity(x, y) END AS jw, len(list_filter(one, lambda w: length(w) >= 4 AND list_contains(two, w))) > 0 AS telling FROM e),
    g AS (SELECT id, CASE WHEN pa = pb THEN 1 WHEN pa = '' OR pb = '' THEN 0 WHEN x = y THEN 1 WHEN least(n1, n2) > 0 AND shared = least(n1, n2) THEN 0.88 + 0.12 * least(n1, n2) / greatest(n1, n2)
        WHEN least(length(x), length(y)) >= 3 AND (contains(x, y) OR contains(y, x)) THEN 0.88 + 0.12 * least(length(x), length(y)) / greatest(length(x), length(y)) WHEN held >= 0.8 THEN 0.88 + 0.12 * held
        WHEN shared = 0 THEN least(jw, 0.65) WHEN telling AND greatest(jw, held * 0.85) < 0.75 THEN greatest(jw, held * 0.85, 0.70 + 0.15 * held) ELSE greatest(jw, held * 0.85) END AS similarity FROM f)"""


@query("txt_party_similarity", f"WITH {PAIR_SQL}, {PARTY} SELECT id, CAST(round(similarity, 8) AS DOUBLE) AS similarity FROM g")
def _(spark, d):
    like = F.round(names.party_similarity(F.col("name"), F.col("other")), 8).cast("double")
    return names.once_each(pairs(spark, d), "name", "other", {"similarity": like}).select("id", "similarity")


@query(
    "txt_plain_party_similarity",
    f"""WITH {PAIR_SQL}, c AS (SELECT id, lower({UP.format('trim(name)')}) AS x, lower({UP.format('trim(other)')}) AS y FROM pairs), e AS (SELECT *, list_distinct(string_split(x, ' ')) AS one, list_distinct(string_split(y, ' ')) AS two FROM c)
    SELECT id, CAST(round(CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN 0.95 WHEN len(list_intersect(one, two)) >= 0.6 * least(len(one), len(two)) THEN 0.90 ELSE jaro_winkler_similarity(x, y) END, 8) AS DOUBLE) AS similarity FROM e""",
)
def _(spark, d):
    like = F.round(names.plain_party_similarity(F.col("name"), F.col("other")), 8)
    return names.once_each(pairs(spark, d), "name", "other", {"similarity": like}).select("id", "similarity")


FILL = names.FILLER
SHORT = "[" + ", ".join(f"{{'s': '{s}', 'f': '{f}'}}" for s, f in names.KNOWN_SHORT) + "]"
WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
SEMANTIC = f"""u AS (SELECT id, upper(name) AS p, upper(note) AS n FROM pairs), w AS (SELECT *, {WORDS.format('p')} AS pw, {WORDS.format('n')} AS nw FROM u),
    s AS (SELECT *, array_to_string(list_transform(pw, lambda x: x[1]), '') AS ini, len(list_filter({SHORT}, lambda k: (contains(p, k.f) OR contains(k.f, p)) AND list_contains(nw, k.s))) > 0 AS known,
        len(list_filter(range(1, len(pw)), lambda i: len(list_filter([2, 3, 4], lambda k: i + k - 1 <= len(pw) AND list_contains(nw, array_to_string(list_transform(pw[i : i + k - 1], lambda x: x[1]), '')))) > 0)) > 0 AS part FROM w),
    v AS (SELECT *, CASE WHEN length(ini) >= 2 AND list_contains(nw, ini) THEN 9500 WHEN known THEN 9200 WHEN part THEN 8500 ELSE 0 END AS short_bps, list_filter(pw, lambda x: length(x) > 1 AND NOT list_contains({FILL!r}, x)) AS pc, list_filter(nw, lambda x: length(x) > 1 AND NOT list_contains({FILL!r}, x)) AS nc FROM s),
    k AS (SELECT *, len(list_filter(pc, lambda x: len(list_filter(nc, lambda y: contains(y, x))) > 0)) AS covered FROM v),
    cover AS (SELECT id, p, n, short_bps, CASE WHEN len(pc) = 0 THEN 0 WHEN covered = len(pc) THEN greatest(9200, covered * 10000 // len(pc)) ELSE covered * 10000 // len(pc) END AS core_bps FROM k),
    term AS (SELECT id, 1 AS side, unnest({WORDS.format('p')}) AS t, 10 AS wt FROM u UNION ALL SELECT id, 2, unnest({WORDS.format('n')}), 10 FROM u
        UNION ALL SELECT id, 1, unnest(list_transform(range(1, length(replace(p, ' ', ''))), lambda i: substr(replace(p, ' ', ''), i, 2))), 3 FROM u UNION ALL SELECT id, 2, unnest(list_transform(range(1, length(replace(n, ' ', ''))), lambda i: substr(replace(n, ' ', ''), i, 2))), 3 FROM u),
    tw AS (SELECT id, side, t, sum(wt) AS v FROM term GROUP BY ALL), norm AS (SELECT id, sum(CASE WHEN side = 1 THEN v * v END) AS a, sum(CASE WHEN side = 2 THEN v * v END) AS b FROM tw GROUP BY id),
    dot AS (SELECT x.id, sum(x.v * y.v) AS d FROM tw x JOIN tw y ON x.id = y.id AND x.t = y.t AND x.side = 1 AND y.side = 2 GROUP BY 1),
    cosine AS (SELECT id, p, n, short_bps, core_bps, CASE WHEN p = '' OR n = '' THEN 0 WHEN p = n THEN 10000 WHEN d IS NULL THEN 0 ELSE least(10000, d * 10000 // CAST(floor(sqrt(CAST(a * b AS DOUBLE))) AS BIGINT)) END AS cosine_bps FROM cover LEFT JOIN norm USING (id) LEFT JOIN dot USING (id))"""


@query("txt_semantic_parts", f"WITH {PAIR_SQL}, {SEMANTIC} SELECT id, short_bps, CAST(core_bps AS INT) AS core_bps, CAST(cosine_bps AS INT) AS cosine_bps, CAST(CASE WHEN p = '' OR n = '' THEN 0 WHEN p = n THEN 10000 ELSE greatest(short_bps, core_bps, cosine_bps) END AS INT) AS semantic_bps FROM cosine")
def _(spark, d):
    p, n = F.upper("name"), F.upper("note")
    parts = {"short_bps": names.short_name_bps(p, n), "core_bps": names.core_coverage_bps(p, n).cast("int"), "cosine_bps": names.token_cosine_bps(p, n), "semantic_bps": names.semantic_bps(p, n).cast("int")}
    return names.once_each(pairs(spark, d), "name", "note", parts).select("id", *parts)


@query(
    "txt_narration_refs",
    rf"""WITH {PAIR_SQL}, r AS (SELECT id, regexp_extract_all(upper(note), '\b((?:HD|INV|PC|PT)[-_/ ]?\d{{4}}[-_/ ]?\d{{2,8}})\b', 1) || regexp_extract_all(upper(note), '\b((?:HD|INV|PC|PT|FT|NPS|VN)[-_/ ]?\d{{2,12}})\b', 1) || regexp_extract_all(upper(note), '\b([A-Z]{{2,3}}-\d{{3,}})\b', 1) AS refs FROM pairs)
    SELECT id, array_to_string(list_filter(list_transform(range(1, len(refs) + 1), lambda i: CASE WHEN list_position(refs, refs[i]) = i THEN refs[i] END), lambda x: x IS NOT NULL), ',') AS refs FROM r""",
)
def _(spark, d):
    return pairs(spark, d).select("id", F.array_join(names.narration_refs(F.col("note")), ",").alias("refs"))


@query("txt_without_boilerplate", f"WITH {PAIR_SQL} SELECT id, trim(regexp_replace({''.join(['replace('] * len(names.BOILERPLATE))}' ' || replace({UP.format('note')}, ' ', '  ') || ' '{''.join(f', {chr(39)} {p.replace(chr(32), chr(32) * 2)} {chr(39)}, {chr(39)}{chr(39)})' for p in names.BOILERPLATE)}, ' +', ' ', 'g')) AS rest FROM pairs")
def _(spark, d):
    return pairs(spark, d).select("id", names.without_boilerplate(F.col("note")).alias("rest"))


@query(
    "join_band_scored",
    f"""{BANK}, b AS (SELECT *, CASE line_id % 3 WHEN 0 THEN party WHEN 1 THEN 'CONG TY TNHH ' || party ELSE party || ' - 77 pay' END AS written FROM bank),
    m AS (SELECT line_id, invoice_id, i.amount - b.amount AS fee, abs(b.ts - i.ts) AS lag, CASE WHEN line_id % 3 = 2 THEN 0.88 + 0.12 * 2 / 4 ELSE 1 END AS likeness FROM b JOIN inv i ON b.customer = i.customer AND (i.amount = b.amount OR i.amount - b.amount BETWEEN 1100 AND 11000) AND abs(b.ts - i.ts) <= 259200),
    s AS (SELECT *, 0.5 * (CASE WHEN fee = 0 THEN 1 ELSE 0.95 END) + 0.4 * likeness + 0.1 * (1 - lag / 259200 * 0.1) AS score FROM m WHERE likeness >= 0.85)
    SELECT line_id, arg_min(invoice_id, (-round(score, 9), invoice_id)) AS invoice_id, CAST(round(max(score), 6) AS DOUBLE) AS score FROM s WHERE score >= 0.85 GROUP BY line_id""",
)
def _(spark, d):
    k = F.col("line_id") % 3
    lines = bank_lines(spark, d).withColumn("party", F.when(k == 0, F.col("party")).when(k == 1, F.concat(F.lit("CONG TY TNHH "), "party")).otherwise(F.concat("party", F.lit(" - 77 pay"))))
    best = R.scored_band(lines, invoices(spark, d))
    return best.select("line_id", "invoice_id", F.round("score", 6).alias("score"))


@query(
    "join_stepped_edges",
    f"""{BANK}, m AS (SELECT line_id, invoice_id AS entry_id, abs(i.amount - b.amount) AS fee, abs(b.ts - i.ts) AS lag, CASE WHEN b.party = i.party THEN 1.0 ELSE jaro_winkler_similarity(lower(b.party), lower(i.party)) END AS likeness FROM bank b JOIN inv i
        ON (i.amount = b.amount OR abs(i.amount - b.amount) BETWEEN 1100 AND 11000) AND (abs(b.ts - i.ts) <= 259200 OR b.ts // 86400 = i.ts // 86400)),
    s AS (SELECT *, 0.5 * (CASE WHEN fee = 0 THEN 1 ELSE 0.92 END) + 0.4 * likeness + 0.1 * (CASE WHEN lag <= 86400 THEN 1 WHEN lag <= 172800 THEN 0.95 ELSE 0.88 END) AS score FROM m) SELECT line_id, entry_id, fee, CAST(round(score, 6) AS DOUBLE) AS score FROM s WHERE score >= 0.85""",
)
def _(spark, d):
    """Edges of the simpler score, over all customers."""
    lines = bank_lines(spark, d).withColumn("direction", F.lit("CREDIT")).withColumn("narration", F.lit("ck"))
    entries = invoices(spark, d).select(F.col("invoice_id").alias("entry_id"), F.lit("CREDIT").alias("direction"), F.col("party").alias("partner"), "amount", "ts")
    return R.stepped_edges(lines, entries).select("line_id", "entry_id", "fee", F.round("score", 6).alias("score"))


# --- watchlists -------------------------------------------------------------------------------------------------------------------

KEYS, CLUSTERS = ["danh bac", "USDT"], {"CRYPTO": ["USDT", "BINANCE", "P2P"], "GAMBLING": ["danh bac", "casino"]}
ACCOUNTS, LISTED = [(0, 7), (1, 11)], [(0, "Tran Thi Ngoc"), (1, "Hai Dang May Bon")]
#: Payers whose names are short or long forms of listed ones, which only their first letters bring over the threshold, or miss it by little.
PAYERS = [*NAMES, "TRAN THI NGOC LAN HUONG", "Trần Thị", "Tran T", "HAI DANG MAY BON QUANG NINH", "Hai Dan", "NGOC THI TRAN", "TRANG THI NGA", "Hoi Dong May Ban"]
WATCH = f"watched AS (SELECT tx_id, account, amount, ts, is_credit, account * 3 % 17 AS counter_account, {PAYERS!r}[tx_id % 20 + 1] AS counterparty, {NOTES!r}[tx_id * 7 % 13 + 1] AS narration FROM txn)"
LIKE = "jaro_winkler_similarity({0}, '{1}') >= 0.9"
HIT_1, HIT_2 = (LIKE.format(UP.format("counterparty"), n.upper()) for _, n in LISTED)
ALERTS = f"""SELECT tx_id, account, 'KEYWORD' AS list, CASE WHEN contains({UP.format('narration')}, 'DANH BAC') THEN 'danh bac' ELSE 'USDT' END AS entry FROM watched WHERE contains({UP.format('narration')}, 'DANH BAC') OR contains({UP.format('narration')}, 'USDT')
    UNION ALL SELECT tx_id, account, 'ACCOUNT', CASE WHEN account = 7 OR counter_account = 7 THEN 7 ELSE 11 END::VARCHAR FROM watched WHERE account IN (7, 11) OR counter_account IN (7, 11)
    UNION ALL SELECT tx_id, account, 'NAME', CASE WHEN {HIT_1} THEN 'Tran Thi Ngoc' ELSE 'Hai Dang May Bon' END FROM watched WHERE counterparty <> '' AND ({HIT_1} OR {HIT_2})"""
RISKS = f"""SELECT tx_id, CASE WHEN contains(t, 'DANH BAC') THEN 9500 WHEN contains(t, 'USDT') OR contains(t, 'BINANCE') OR contains(' ' || t || ' ', ' P2P ') THEN 9200 WHEN contains(t, 'CASINO') THEN 8600 WHEN contains(t, 'BINANSE') THEN 8300 ELSE 0 END AS bps,
    CASE WHEN contains(t, 'DANH BAC') THEN 'GAMBLING' WHEN contains(t, 'USDT') OR contains(t, 'BINANCE') OR contains(' ' || t || ' ', ' P2P ') THEN 'CRYPTO' WHEN contains(t, 'CASINO') THEN 'GAMBLING' WHEN contains(t, 'BINANSE') THEN 'CRYPTO' END AS category
    FROM (SELECT tx_id, {UP.format('narration')} AS t FROM watched)"""
# a structuring window alerts on its first row
SCREEN = f"""SELECT tx_id, account, 'HIGH_VALUE' AS rule, 1 AS ordinal, CASE WHEN amount >= 30000 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM txn WHERE amount >= 20000
    UNION ALL SELECT opened[2], account, 'STRUCTURING', 2, 'CRITICAL' FROM ({STRUCT}) UNION ALL SELECT in_id, account, 'TRANSIT_MULE', 3, 'CRITICAL' FROM ({MULE})
    UNION ALL SELECT tx_id, account, 'NIGHT', 4, 'HIGH' FROM ({NIGHT}) UNION ALL SELECT tx_id, account, 'WATCHLIST', 5, CASE list WHEN 'KEYWORD' THEN 'HIGH' ELSE 'CRITICAL' END FROM ({ALERTS})"""


def watched(spark, d) -> DataFrame:
    def pick(values: list[str], at) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))

    k = F.col("tx_id")
    return transactions(spark, d).select("tx_id", "account", "amount", "ts", "is_credit", (F.col("account") * 3 % 17).alias("counter_account"), pick(PAYERS, k % 20).alias("counterparty"), pick(NOTES, k * 7 % 13).alias("narration"))


def alerts_of(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    spark = rows.sparkSession
    return W.watchlist(rows, KEYS, spark.createDataFrame(ACCOUNTS, "position int, account long"), spark.createDataFrame(LISTED, "position int, name string"), keep)


@query("aml_watchlist", f"{TXN}, {WATCH} SELECT tx_id, list, entry FROM ({ALERTS})")
def _(spark, d):
    return alerts_of(watched(spark, d))


@query("txt_narration_risk", f"{TXN}, {WATCH} {RISKS}")
def _(spark, d):
    return W.whole_risk(watched(spark, d), CLUSTERS)


@query("aml_statutory_screen", f"{TXN}, {WATCH} {SCREEN}")
def _(spark, d):
    rows = watched(spark, d)
    return S.statutory_screen(rows, alerts_of(rows, ("account",)))


ENHANCED = f"""{TXN}, {WATCH}, {MEDIAN}, st AS (SELECT tx_id, sum(CASE severity WHEN 'CRITICAL' THEN 3500 ELSE 2500 END) AS base FROM ({SCREEN}) GROUP BY tx_id), bu AS ({BURST}), su AS ({SURGE}), ri AS ({RISKS}),
    f AS (SELECT t.*, coalesce(base, 0) AS base, bu.tx_id IS NOT NULL AS burst, su.tx_id IS NOT NULL AS surge, CASE WHEN mad > 0 THEN 6745 * abs(amount - median) // mad ELSE 0 END AS z, ({HOUR} >= 23 OR {HOUR} < 5) AND amount >= 10000 AS night,
        amount BETWEEN 19000 AND 19999 AS band, CASE WHEN bps >= 8200 THEN bps ELSE 0 END AS bps
        FROM txn t CROSS JOIN mads LEFT JOIN st USING (tx_id) LEFT JOIN bu ON bu.tx_id = t.tx_id LEFT JOIN su ON su.tx_id = t.tx_id LEFT JOIN ri ON ri.tx_id = t.tx_id),
    s AS (SELECT *, least(10000, base + least(2500, CASE WHEN burst THEN 1500 ELSE 0 END + CASE WHEN surge THEN 2000 ELSE 0 END + CASE WHEN night THEN 2000 ELSE 0 END)
        + least(3000, CASE WHEN band THEN 2500 ELSE 0 END + CASE WHEN z > 50000 THEN 2500 WHEN z > 35000 THEN 2000 ELSE 0 END) + bps * 2500 // 10000) AS score FROM f)
    SELECT tx_id, account, CAST(score AS INT) AS score, concat_ws(',', CASE WHEN base > 0 THEN 'statutory' END, CASE WHEN burst THEN 'burst' END, CASE WHEN surge THEN 'surge' END, CASE WHEN night THEN 'night' END, CASE WHEN band THEN 'band' END,
        CASE WHEN z > 35000 THEN 'outlier' END, CASE WHEN bps > 0 THEN 'narration' END) AS reasons FROM s WHERE score > 0"""


@query("aml_enhanced_scores", ENHANCED)
def _(spark, d):
    rows = watched(spark, d)
    listed = alerts_of(rows, ("account",))
    return S.enhanced_scores(rows, listed, W.whole_risk(rows, CLUSTERS))


@query(
    "aml_alert_actions",
    f"{TXN}, {WATCH}, a AS ({SCREEN}) SELECT tx_id, rule, CASE severity WHEN 'CRITICAL' THEN 85 ELSE 60 END AS score, CASE severity WHEN 'CRITICAL' THEN 'FILE_REPORT' ELSE 'COMPLIANCE_HOLD' END AS action FROM a",
)
def _(spark, d):
    """The report score and action of every statutory alert."""
    rows = watched(spark, d)
    score, action = K.report_action(F.col("severity"), {"CRITICAL": 85, "HIGH": 60, "MEDIUM": 35})
    return S.statutory_screen(rows, alerts_of(rows, ("account",))).select("tx_id", "rule", score.alias("score"), action.alias("action"))


@query("aml_fused_profiles", f"WITH s AS ({ENHANCED}) SELECT tx_id, CASE WHEN score >= 7000 THEN 'CRITICAL' WHEN score >= 5000 THEN 'HIGH' WHEN score >= 2500 THEN 'MEDIUM' ELSE 'LOW' END AS profile FROM s")
def _(spark, d):
    """The risk class of every fused score."""
    rows = watched(spark, d)
    listed = alerts_of(rows, ("account",))
    return S.enhanced_scores(rows, listed, W.whole_risk(rows, CLUSTERS)).select("tx_id", S.risk_profile(F.col("score")).alias("profile"))


# --- statements -------------------------------------------------------------------------------------------------------------------

QUOTED = f"{BANK} SELECT 'f' || customer AS file, ref AS ref_code, CASE WHEN line_id % 2 = 0 THEN 'credit' ELSE 'debit' END AS posting_type, amount, amount + 5 AS balance_after, CASE WHEN line_id % 3 = 0 THEN 'paid; \"in full\" and more' ELSE 'paid; \"in full\"' END AS narration FROM bank WHERE amount > 0"


def _money(cents) -> F.Column:
    return F.concat(F.translate(F.format_number(F.expr("amount DIV 100"), 0), ",", "."), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))


def quoted_files(spark, d) -> DataFrame:
    """A file for each customer: quoted cells with the delimiter and quotes in them, decimals, continued narrations, totals."""
    value, balance = _money(F.col("amount")), F.concat(F.lit('"'), (F.col("amount") + 5).cast("string"), F.lit(',00"'))
    even = F.col("line_id") % 2 == 0
    row = F.concat(F.lit('2024-01-01;"'), "ref", F.lit('";'), F.when(even, "").otherwise(value), F.lit(";"), F.when(even, value).otherwise(""), F.lit(';"'), ((F.col("amount") + 5) / 100).cast("decimal(18,2)").cast("string"), F.lit('";"paid; ""in full"""'))
    row = F.concat(row, F.when(F.col("line_id") % 3 == 0, "\n;;;;;and more").otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", row.alias("r")))), lambda x: x["r"]), "\n")
    head = "\ufeffNgân hàng X\nSố tài khoản: 0071;\nSố dư đầu kỳ: 1.000,50\nDate;Ref;Debit;Credit;Balance;Narration\n"
    return bank_lines(spark, d).where("amount > 0").groupBy(F.col("customer").alias("k")).agg(F.concat(F.lit(head), body, F.lit("\nTổng cộng;;1.000,00;2.000,00;;\nafter;x;1;1;1;y\n")).alias("content")).select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("file"), "content")


COLUMNS = {"date": ["Date"], "ref": ["Ref"], "debit": ["Debit"], "credit": ["Credit"], "balance": ["Balance"], "narration": ["Narration"]}


@query("io_quoted_statements", QUOTED)
def _(spark, d):
    rows = P.delimited(quoted_files(spark, d), COLUMNS, places=2)
    return rows.select("file", "ref_code", "posting_type", "amount", "balance_after", "narration")


@query("io_statement_metadata", f"{BANK} SELECT DISTINCT 'f' || customer AS file, ';' AS delimiter, '0071' AS account, '1.000,50' AS opening, NULL::VARCHAR AS closing, 'X' AS bank, CAST(1 AS INT) AS score FROM bank WHERE amount > 0")
def _(spark, d):
    files = quoted_files(spark, d)
    rules = spark.createDataFrame([("X", "xbank", ["NGÂN HÀNG X"]), ("Y", "ybank", ["NGÂN HÀNG Y", "ZZZ"])], "bank string, mark string, keywords array<string>")
    found = P.metadata(files, {"account": r"(?iu)số tài khoản:\s*([0-9]+)", "opening": r"(?iu)số dư đầu kỳ:\s*([0-9.,]+)", "closing": r"(?iu)số dư cuối kỳ:\s*([0-9.,]+)"})
    sniffed = files.select("file", P.quoted_delimiter(F.col("content")).alias("delimiter"))
    return found.join(sniffed, "file").join(P.signature_scores(files, rules), "file")


@query("io_ledger_text", f"{BANK} SELECT 'f' || customer AS file, ref AS doc_no, CASE WHEN line_id % 2 = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS entry_type, amount FROM bank WHERE amount > 0")
def _(spark, d):
    return P.ledger_text(quoted_files(spark, d), {"doc_no": ["Ref"], "receivable": ["Credit"], "payable": ["Debit"], "partner": ["Narration"], "date": ["Date"]}, places=2).select("file", "doc_no", "entry_type", "amount")


def tagged_files(spark, d, row, head: str, tail) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", row.alias("r")))), lambda x: x["r"]), "\n")
    return bank_lines(spark, d).groupBy(F.col("customer").alias("k")).agg(F.concat(F.lit(head), body, tail).alias("content")).select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("file"), "content")


CENTS = f"{BANK} SELECT 'f' || customer AS file, ref AS ref_code, amount FROM bank"
ENDS = f"{BANK} SELECT 'f' || customer AS file, 'ACC-7' AS account, 50025 AS opening, CAST(-sum(amount) AS BIGINT) AS closing FROM bank GROUP BY customer"


def _dec(x, sign: str) -> F.Column:
    return F.concat(F.expr(f"{x} DIV 100").cast("string"), F.lit(sign), F.lpad(F.expr(f"{x} % 100").cast("string"), 2, "0"))


def mt940_files(spark, d) -> DataFrame:
    row = F.concat(F.lit(":61:2401010102C"), _dec("amount", ","), F.lit("NTRF"), "ref", F.lit("\n:86:paid"))
    total = F.concat(F.lit("\n:62F:D240131EUR"), _dec("sum(amount)", ","))
    return tagged_files(spark, d, row, ":20:S\n:25:ACC-7\n:60F:C240101EUR500,25\n", total)


def camt_files(spark, d) -> DataFrame:
    row = F.concat(F.lit('<Ntry xmlns="u"><NtryRef>'), "ref", F.lit('</NtryRef><Amt Ccy="EUR">'), _dec("amount", "."), F.lit("</Amt><CdtDbtInd>CRDT</CdtDbtInd></Ntry>"))
    total = F.concat(F.lit('<Bal><Tp><CdOrPrtry><Cd>CLBD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">'), _dec("sum(amount)", "."), F.lit("</Amt><CdtDbtInd>DBIT</CdtDbtInd></Bal></BkToCstmrStmt></Document>"))
    return tagged_files(spark, d, row, '<Document><BkToCstmrStmt><Acct><Id><Othr><Id>ACC-7</Id></Othr></Id></Acct><Bal><Tp><CdOrPrtry><Cd>OPBD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">500.25</Amt><CdtDbtInd>CRDT</CdtDbtInd></Bal>', total)


@query("io_mt940_decimals", CENTS)
def _(spark, d):
    return P.mt940(mt940_files(spark, d), 2).select("file", "ref_code", "amount")


@query("io_mt940_balances", ENDS)
def _(spark, d):
    return P.mt940_balances(mt940_files(spark, d), 2)


@query("io_camt053_decimals", CENTS)
def _(spark, d):
    return P.camt053(camt_files(spark, d), 2).select("file", "ref_code", "amount")


@query("io_camt053_balances", ENDS)
def _(spark, d):
    return P.camt053_balances(camt_files(spark, d), 2)
