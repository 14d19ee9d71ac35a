"""Small Arrow helpers on JSON texts and statements of fact; one document a row."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Keys of JSON objects whose values are hidden, by what their lower-case form contains or ends with.
SECRET_PARTS = ("password", "secret", "api_key", "apikey", "token", "private_key")
ENDINGS = {"[REDACTED_CCCD]": ("cccd", "cmnd"), "[REDACTED_BANK_ACCOUNT]": ("stk", "bank_account", "account_number")}


def _hidden(key: str) -> str | None:
    low = key.lower()
    if any(p in low for p in SECRET_PARTS):
        return "[REDACTED_SECRET]"
    return next((new for new, names in ENDINGS.items() if any(low == n or low.endswith("_" + n) for n in names)), None)


def _walk(value: object) -> object:
    if isinstance(value, dict):
        return {k: _hidden(k) or _walk(v) for k, v in value.items()}
    return [_walk(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def hide_keys(texts: pd.Series) -> pd.Series:
    """JSON with the values of telling keys replaced, at any depth; `masks.scrub` on the result masks what stands in values. Null for no JSON."""
    return texts.map(lambda t: _as_json(t, lambda v: json.dumps(_walk(v), ensure_ascii=False)))


def canonical_json(text: Column) -> Column:
    """JSON without blanks and with sorted keys, as a variant keeps them; null for no JSON."""
    return F.to_json(F.try_parse_json(text))


def _as_json(text: str | None, use) -> str | None:
    try:
        return use(json.loads(text)) if text is not None else None
    except ValueError:
        return None


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def fits(schema: dict, value: object) -> bool:
    """Whether a value meets type, enum, required, properties and items of a JSON schema."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number" and not number or kind == "integer" and not (number and float(value).is_integer()):
        return False
    if kind in _TYPES and not isinstance(value, _TYPES[kind]):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        return all(k in value for k in schema.get("required", [])) and all(fits(s, value[k]) for k, s in schema.get("properties", {}).items() if k in value)
    return all(fits(schema["items"], v) for v in value) if isinstance(value, list) and "items" in schema else True


def meets_schema(texts: Column, schema: dict) -> Column:
    """A boolean column: whether each JSON text fits the schema; false for no JSON."""

    @F.pandas_udf(BooleanType())
    def run(held: pd.Series) -> pd.Series:
        def one(text: str | None) -> bool:
            try:
                return text is not None and fits(schema, json.loads(text))
            except ValueError:
                return False

        return held.map(one).astype(bool)

    return run(texts)


# The phrases that state a relation, in the order in which they are looked for.
RELATIONS = [
    ("friend_of", [" là bạn của ", " là bạn thân của ", " is a friend of ", " is friends with "]),
    ("works_at", [" làm việc tại ", " làm việc ở ", " công tác tại ", " works at ", " works for "]),
    ("located_in", [" nằm ở ", " ở tại ", " sống ở ", " sống tại ", " toạ lạc tại ", " is located in ", " lives in "]),
    ("capital_of", [" là thủ đô của ", " là thủ đô nước ", " is the capital of "]),
    ("part_of", [" thuộc về ", " là một phần của ", " belongs to ", " is part of "]),
    ("likes", [" thích ", " yêu thích ", " đam mê ", " likes ", " loves "]),
    ("created", [" tạo ra ", " phát triển ", " sáng lập ", " created ", " founded ", " developed "]),
    ("is_a", [" là ", " is a ", " is an ", " is "]),
]
# Phrases that may stand before what is spoken of, and words that name nothing.
OPENINGS = [
    "đúng vậy", "chính xác", "vâng", "ừ", "tất nhiên", "và ", "còn ", "nhưng ", "mà ", "and ", "but ", "tôi nghĩ rằng", "tôi biết rằng", "thực ra", "bạn có biết", "theo như tôi biết",
    "nói chung", "thực tế", "i think that", "actually", "as you know", "in fact", "yes", "yeah", "sure", "right", "well",
]
PRONOUNS = [
    "tôi", "tao", "mình", "bạn", "cậu", "anh", "chị", "em", "chúng tôi", "chúng nó", "nó", "họ", "đây", "đó", "kia", "gì", "ai", "nào", "sao",
    "i", "me", "you", "he", "she", "it", "we", "they", "this", "that", "what", "who",
]
TRIPLE = "struct<subject:string,relation:string,object:string>"
#: Every phrase with its relation, in order.
PHRASES = [(r, p) for r, phrases in RELATIONS for p in phrases]
#: Patterns without flags, so that any engine can state its own.
OPENING, EDGE, LINK, CLAUSE_END, ROLE = f"^(?:(?:{'|'.join(OPENINGS)})\\s*)+", "^[\"'`()\\[\\],:]+|[\"'`()\\[\\],:]+$", r"\[\[(.*?)\]\]", r"[.!?;,\n]", r"^\s*(user|assistant)\s*:"


def cleaned(x: Column) -> Column:
    """What a clause speaks of, without openings, brackets and quotes."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), f"(?iu){OPENING}", "")), EDGE, ""))


def named(x: Column) -> Column:
    """Whether a cleaned text names something: 2 to 80 signs, one of them a letter or digit, and no pronoun."""
    return F.length(x).between(2, 80) & ~F.lower(x).isin(PRONOUNS) & x.rlike(r"[\p{L}\p{N}]")


def triples(text: Column) -> Column:
    """An array of (subject, relation, object): neighbours among [[links]], then the first stated relation of each clause that is new; without repeats.

    Phrases are found in any case of letters. A phrase whose sides name nothing, or the same, or give what was there before, leaves the clause to the next one.
    """
    links = F.transform(F.regexp_extract_all(text, F.lit(f"(?s){LINK}"), F.lit(1)), lambda x: F.trim(F.split_part(x, F.lit("|"), F.lit(1))))
    links = F.transform(F.filter(links, lambda x: F.octet_length(x).between(1, 80)), cleaned)
    none = F.array().cast(f"array<{TRIPLE}>")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(links) - 1, F.lit(1))), lambda i: F.struct(F.get(links, i - 1).alias("subject"), F.lit("links_to").alias("relation"), F.get(links, i).alias("object")))
    beside = F.array_distinct(F.filter(pairs, lambda t: t["subject"] != t["object"]))
    clauses = F.filter(F.transform(F.split(F.regexp_replace(text, f"(?im){ROLE}", ""), CLAUSE_END), lambda c: F.trim(c)), lambda c: F.octet_length(c) >= 5)
    phrases = F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(p).alias("phrase")) for r, p in PHRASES])

    def sides(clause: Column, p: Column) -> Column:
        at = F.instr(F.lower(clause), p["phrase"])
        return F.struct(cleaned(F.substring(clause, F.lit(1), at - 1)).alias("subject"), p["relation"].alias("relation"), cleaned(F.substring(clause, at + F.length(p["phrase"]), F.length(clause))).alias("object"))

    def stated(clause: Column) -> Column:
        there = F.filter(phrases, lambda p: F.contains(F.lower(clause), p["phrase"]))
        return F.filter(F.transform(there, lambda p: sides(clause, p)), lambda t: named(t["subject"]) & named(t["object"]) & (F.lower(t["subject"]) != F.lower(t["object"])))

    def with_new(found: Column, told: Column) -> Column:
        new = F.filter(told, lambda t: ~F.array_contains(found, t))
        return F.concat(found, F.slice(new, 1, 1))

    telling = F.filter(F.transform(clauses, stated), lambda told: F.size(told) > 0)
    return F.aggregate(telling, F.coalesce(beside.cast(f"array<{TRIPLE}>"), none), with_new)
