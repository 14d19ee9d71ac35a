"""Remarks of payments: entities, abbreviations and intents by expressions, and dictionaries of any size by joins of words, and by automata for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import unmarked_upper

# Short forms in remarks and what they stand for.
ABBREVIATIONS = {
    "ck": "chuyển khoản", "c/k": "chuyển khoản", "ch/khoan": "chuyển khoản", "ib": "internet banking", "mb": "mobile banking", "nps": "chuyển mạch tài chính napas", "napas": "chuyển mạch tài chính napas", "vietqr": "mã thanh toán vietqr",
    "tt": "thanh toán", "ttoan": "thanh toán", "th/toan": "thanh toán", "t.toan": "thanh toán", "ung": "tạm ứng", "t/ung": "tạm ứng", "tam ung": "tạm ứng", "dc": "đặt cọc", "hd": "hóa đơn", "hđ": "hóa đơn", "hdon": "hóa đơn", "hopdong": "hợp đồng",
    "hop dong": "hợp đồng", "d1": "đợt 1", "d2": "đợt 2", "d3": "đợt 3", "gd1": "giai đoạn 1", "gd2": "giai đoạn 2", "mst": "mã số thuế", "vat": "thuế giá trị gia tăng", "gtgt": "giá trị gia tăng", "phi": "phí dịch vụ", "phi ck": "phí chuyển khoản", "phi gd": "phí giao dịch", "phi dv": "phí dịch vụ",
}
# What shows each intent, in a remark as it is and in one without marks, and how sure it is; the first that is shown counts.
INTENTS = [
    ("ADVANCE", 0.95, "tam ung|ung|dat coc", "tam ung"),
    ("BANK_FEE", 0.95, "phi duy tri|phi ql|phi dv|phi dich vu|quan ly tai khoan|phi thuong nien|phí", None),
    ("PAYROLL", 0.92, None, "luong|thuong|tien luong"),
    ("WITHDRAWAL", 0.90, None, "rut tien|rut vi"),
    ("INTERNAL_TRANSFER", 0.88, None, "noi bo|dieu chuyen"),
    ("PAYMENT", 0.95, "chuyen khoan|thanh toan|ck|tt|napas|vietqr|tien hang|hoa don|hop dong|hd", "thanh toan|chuyen khoan|hoa don"),
]
#: A border between a plain letter, digit or underline and anything else, marked letters included.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
# How entities are written, without borders around them; the group that is taken.
INVOICE, DENSE = r"(?:hd|hđ|hdon|hoa\s*don|hop\s*dong|so|inv|pkt)[\s\-_:#]*([a-zA-Z0-9/\-_]+)", r"(?:hd|hđ|inv)[^A-Za-z0-9_]+([a-zA-Z0-9\-]+)"
TAX, PHONE, TRACE = r"(\d{10}(?:-\d{3})?)", r"((?:\+84|0)(?:3|5|7|8|9)\d{8})", r"((?:NPS|FT|MBB|TCB|VCB|BIDV|TX|VN)\d{6,})"
#: Signs of a dictionary that one automaton holds, of some forty bytes each.
AUTOMATON_SIGNS = 1 << 20
#: Lengths of the patterns without white space that are looked up by joins; they lie inside runs of other signs, which are cut into pieces of twice the larger.
SHORTEST, LONGEST = 9, 256
WORD = r"[^\x20\x09-\x0D]"
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _all(x: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)))


def entities(remark: Column) -> Column:
    """A struct of lists: invoices, tax_codes, phones and traces of a remark, each without repeats, in order; references are in upper case."""
    low = F.lower(F.trim(remark))
    found = F.transform(_all(low, EDGE + INVOICE + EDGE), F.upper)
    dense = F.slice(F.transform(_all(low, DENSE), F.upper), 1, 1)
    return F.struct(
        F.array_distinct(F.when(F.size(found) > 0, found).otherwise(dense)).alias("invoices"),
        _all(remark, EDGE + TAX + EDGE).alias("tax_codes"),
        _all(remark, PHONE + EDGE).alias("phones"),
        F.array_distinct(F.transform(_all(remark, "(?i)" + EDGE + TRACE + EDGE), F.upper)).alias("traces"),
    )


def expanded(remark: Column) -> Column:
    """A remark in lower case with its short forms written out; anything but letters, digits, underlines, dashes and slashes parts words."""
    forms = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    words = F.filter(F.split(F.lower(F.trim(remark)), r"[^\p{L}\p{M}0-9_]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(forms, w), w)), " ")


def intent(normalized: Column) -> Column:
    """(intent, confidence) of an expanded remark; OTHER with a half where nothing shows one."""
    bare, out = F.lower(unmarked_upper(normalized)), F.struct(F.lit("OTHER").alias("intent"), F.lit(0.5).alias("confidence"))
    for name, sure, plain, unmarked in reversed(INTENTS):
        hit = F.lit(False)
        for text, pattern in ((normalized, plain), (bare, unmarked)):
            hit = hit | text.rlike(pattern) if pattern else hit
        out = F.when(hit, F.struct(F.lit(name).alias("intent"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def dictionary_hits(rows: DataFrame, patterns: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pattern, start): every place, counted in signs from 0, at which a pattern of `patterns` (pattern string) stands in a text; places may overlap.

    Patterns of SHORTEST to LONGEST signs without white space are `word_hits`. The others are dealt to automata of about AUTOMATON_SIGNS signs, each of which
    is broadcast and passes over the texts once, so what is sent at once is bounded for any dictionary. Null and empty patterns and null texts have no places.
    """
    context, kind = rows.sparkSession.sparkContext, rows.schema[key].dataType.simpleString()
    every = patterns.where("pattern <> ''").select("pattern").distinct()
    joined = F.length("pattern").between(SHORTEST, LONGEST) & F.col("pattern").rlike(rf"^{WORD}+\z")
    known = every.where(~joined)
    signs = known.agg(F.sum(F.length("pattern").cast("long"))).first()[0] or 0
    parts = max(1, -(-signs // AUTOMATON_SIGNS))

    def searched(part: int) -> DataFrame:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for row in known.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part).toLocalIterator():
            automaton.add_word(row[0], row[0])
        automaton.make_automaton()
        if not len(automaton):
            return rows.select(key).limit(0).selectExpr(f"`{key}`", "'' AS pattern", "0L AS start")
        held = context.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owner, found, start = [], [], []
                for i, said in enumerate(batch.column(1)):
                    for end, pattern in held.value.iter(said.as_py() or ""):
                        owner.append(i)
                        found.append(pattern)
                        start.append(end + 1 - len(pattern))
                    if len(owner) > 100_000:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(found), pa.array(start, pa.int64())], [key, "pattern", "start"])
                        owner, found, start = [], [], []
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(found, pa.string()), pa.array(start, pa.int64())], [key, "pattern", "start"])

        return rows.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, pattern string, start long")

    out = word_hits(rows, every.where(joined), key, text)
    for part in range(parts if signs else 0):
        out = out.union(searched(part))
    return out


def word_hits(rows: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """`dictionary_hits` for distinct patterns of SHORTEST to LONGEST signs without white space, by joins that grow with texts and dictionary and not with their product.

    Long runs without white space are cut into pieces, each of which tells the places in its first LONGEST signs. Each distinct piece is looked up once: a place whose first SHORTEST signs begin
    a pattern is tried with the lengths that patterns with that beginning have.
    """
    kind = rows.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, len(whole), 256)):
            said = batch.column(1).cast(pa.large_string()).fill_null("")
            bounds = np.frombuffer(said.buffers()[1], np.int64)[said.offset : said.offset + len(said) + 1]
            data = np.frombuffer(said.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            bounds = bounds - bounds[0]
            # signs before each byte, and the byte at which each run starts and ends
            signs, solid = np.append(0, np.cumsum((data & 0xC0) != 0x80)), ~_WHITE[data]
            edge = np.append(solid, False) != np.append(False, solid)
            edge[bounds] |= np.append(solid, False)[bounds] | np.append(False, solid)[bounds]
            edges = np.flatnonzero(edge)
            start, end = edges[:-1], edges[1:]
            fits = (signs[end] - signs[start] >= SHORTEST) & np.append(solid, False)[start]
            start, end = start[fits], end[fits]
            size = signs[end] - signs[start]
            # runs of more than LONGEST places are cut
            n = np.maximum(1, -(-(size - SHORTEST + 1) // LONGEST))
            run, turn = np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            first = signs[start][run] + LONGEST * turn
            begin, stop, long = start[run], end[run], n[run] > 1
            begin[long], stop[long] = (np.searchsorted(signs, at[long], side="right") - 1 for at in (first, np.minimum(first + 2 * LONGEST, signs[end][run])))
            owner = np.searchsorted(bounds, begin, side="right") - 1
            width = stop - begin
            upto = np.append(0, np.cumsum(width))
            held = data[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], width)]
            piece = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(held)]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), piece, pa.array((first - signs[bounds[owner]]).astype(np.int64))], [key, "piece", "start"])

    places = rows.select(key, F.col(text).cast("string")).mapInArrow(cut, f"`{key}` {kind}, piece string, start long")
    length = F.length("piece")
    tried = places.select("piece").distinct().select("piece", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), length - SHORTEST + 1))).alias("at"))
    sizes = words.groupBy(F.substring("pattern", 1, SHORTEST).alias("begin")).agg(F.collect_set(F.length("pattern")).alias("sizes"))
    begun = tried.withColumn("begin", F.substring("piece", F.col("at"), F.lit(SHORTEST))).join(sizes, "begin")
    sized = begun.select("piece", "at", F.explode(F.filter("sizes", lambda n: n <= length - F.col("at") + 1)).alias("n"))
    hits = sized.select("piece", "at", F.substring("piece", F.col("at"), F.col("n")).alias("pattern")).join(words, "pattern")
    return places.join(hits, "piece").select(key, "pattern", (F.col("start") + F.col("at") - 1).alias("start"))


def contact_key(name: Column) -> Column:
    """The key under which a contact is looked up: no marks, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(unmarked_upper(name)), r"\s+", " "))
