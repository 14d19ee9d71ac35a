"""Column functions on money: parsing, checked arithmetic, ratios, fees. Amounts are longs in minor units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fees that banks charge for a transfer, one by one and as an inclusive range.
FEES = [1100, 2200, 3300, 5500, 7700, 8800, 9900, 11000]
FEE_RANGE = (1100, 11000)


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division of longs, towards zero."""
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_amount(text: Column, places: int = 0, thousand: str = "auto", decimal: str = "auto", strip: list[str] | None = None) -> Column:
    """Minor units from a text, with `places` digits behind the decimal sign; digits beyond them are cut.

    A blank or a lone dash is 0. Brackets, a minus at either end, and CR or DR at either end make it negative. With "auto", of dot and
    comma the later one is the decimal sign if both occur; one that occurs once, with one or two digits behind it, is the decimal sign;
    else both part thousands. With a stated decimal sign ("none": there is none) all thousand signs and blanks go. Text without
    a digit is 0 and a number beyond 64 bits is null.
    """
    clean = F.trim(text)
    for token in strip or []:
        clean = F.replace(clean, F.lit(token))

    def parsed(clean: Column, bare: Column) -> Column:
        negative = clean.rlike(r"^(-|CR|DR)|(-|CR|DR)$|^\(.*\)$")
        if decimal == "none":
            whole, part = F.regexp_replace(bare, "[ .,]" if thousand == "auto" else f"[ {thousand}]", ""), F.lit("")
        elif "auto" not in (thousand, decimal):
            whole, part = F.regexp_replace(F.split_part(bare, F.lit(decimal), F.lit(1)), f"[ {thousand}]" if thousand != "none" else " ", ""), F.split_part(bare, F.lit(decimal), F.lit(2))
        else:
            by_dot = bare.rlike(r",.*\.[^,]*$|^[^.,]*\.\d{1,2}$")
            by_comma = bare.rlike(r"\..*,[^.]*$|^[^.,]*,\d{1,2}$")
            sign = F.when(by_dot, F.lit(".")).when(by_comma, F.lit(",")).otherwise("!")
            whole, part = F.regexp_replace(F.split_part(bare, sign, F.lit(1)), "[., ]", ""), F.split_part(bare, sign, F.lit(2))
        scale = 10**places
        units = F.try_multiply(F.coalesce(F.nullif(whole, F.lit("")), F.lit("0")).try_cast("long"), F.lit(scale).cast("long"))
        cents = F.coalesce(F.rpad(F.substring(part, 1, places), places, "0").try_cast("long"), F.lit(0).cast("long")) if places else F.lit(0).cast("long")
        return F.when(~bare.rlike("[0-9]"), F.lit(0).cast("long")).otherwise(F.try_add(units, cents) * F.when(negative, -1).otherwise(1))

    return let(F.trim(clean), lambda c: let(F.regexp_replace(F.regexp_replace(c, "[^0-9., ]", ""), "^ +| +$", ""), lambda bare: parsed(c, bare)))


def checked(kind: str, a: Column, b: Column, currency_a: Column, currency_b: Column) -> Column:
    """a plus, minus or times b (`add`, `subtract`, `multiply`); null where the result leaves 64 bits or the currencies differ."""
    made = {"add": F.try_add, "subtract": F.try_subtract, "multiply": F.try_multiply}[kind](a, b)
    return F.when((currency_a == currency_b) if kind != "multiply" else F.lit(True), made)


def times_ratio(amount: Column, numerator: Column, denominator: Column) -> Column:
    """amount * numerator / denominator, halves to the even neighbour, over 128-bit products; null for a zero denominator or a result beyond 64 bits."""
    wide = amount.cast("decimal(19,0)") * numerator.cast("decimal(19,0)")
    size, over = F.abs(wide), F.nullif(F.abs(denominator.cast("decimal(19,0)")), F.lit(0).cast("decimal(19,0)"))

    def rounded(rest: Column) -> Column:
        whole = F.try_divide(size - rest, over).cast("decimal(38,0)")  # without a rest, and null where it has more digits than a long
        up = (rest * 2 > over) | ((rest * 2 == over) & (whole % 2 == 1))
        made = whole + F.when(up, 1).otherwise(0)
        return F.when((wide < 0) != (denominator < 0), -made).otherwise(made).try_cast("long")

    return let(size % over, rounded)


def unbundled(gross: Column, rate_bps: int) -> tuple[Column, Column]:
    """(net, tax) of a gross amount with tax of rate_bps included; the net takes all where it would be 0, and both are null for no gross."""
    raw = div(gross.cast("decimal(28,0)") * 10_000, F.lit(10_000 + rate_bps).cast("decimal(10,0)")).cast("long") if rate_bps > 0 else gross
    net = F.when(gross > 0, F.when((gross < 2) | (raw == 0), gross).otherwise(raw))
    return net, gross - net


def in_fee_schedule(fee: Column, fees: list[int] | None = None, between: tuple[int, int] | None = None) -> Column:
    """Whether a difference is one of the stated fees or lies in a stated range, ends included."""
    hit = F.lit(False)
    if fees:
        hit = hit | fee.isin(fees)
    if between:
        hit = hit | fee.between(*between)
    return hit


def fee_direction(paid: Column, invoiced: Column) -> Column:
    """Who bore a transfer fee: SHORT_BY_FEE, OVER_BY_FEE, EXACT or OTHER."""
    return F.when(paid == invoiced, "EXACT").when(~F.abs(paid - invoiced).isin(FEES), "OTHER").when(paid < invoiced, "SHORT_BY_FEE").otherwise("OVER_BY_FEE")


def split_fee(gross: Column, narration: Column) -> Column:
    """The fee part of a gross amount: all of it for a pure fee, else a known fee that the narration states after `phi`; principal + fee = gross."""
    stated = F.regexp_extract(F.lower(narration), r"\bphi ([0-9]+)\b", 1).try_cast("long")
    return F.when(F.lower(narration).rlike(r"^(thu )?phi\b") | gross.isin(FEES), gross).when(stated.isin(FEES) & (stated < gross), stated).otherwise(F.lit(0).cast("long"))


# The words that may stand beside an amount.
CURRENCY_WORDS = ["VND", "VNĐ", "Đ", "DONG", "ĐỒNG", "USD", "EUR", "CR", "DR", "D", "C"]


def parse_strict(text: Column, signed: bool = False) -> Column:
    """Whole units from a text that is an amount and nothing else, else null: no date, path, time, other words or signs; decimals are cut.

    Only a leading minus or one pair of brackets may mark a negative, whose sign is dropped unless `signed`.
    """
    clean = F.trim(F.regexp_replace(F.trim(text), r"""^["']+|["']+$""", ""))
    words_ok = F.forall(F.regexp_extract_all(F.upper(clean), F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: w.isin(CURRENCY_WORDS))
    shape = clean.rlike(r"^(\(\s*-?[^()-]*\)[^()-]*|-?[^()-]*)$") & clean.rlike(r"[0-9]") & ~clean.rlike(r"[^0-9.,()+\s\p{L}-]")
    value = F.abs(parse_amount(F.regexp_replace(clean, r"[^0-9.,]", ""), 0))
    negative = clean.rlike(r"^-|^\(.*\)$") if signed else F.lit(False)
    return F.when(shape & words_ok, F.when(negative, -value).otherwise(value))
