"""Masking with collision-safe tokens, and restoring, as projections.

A token is a prefix, 32 lower-case hex digits that are new for each row, an underscore, a counter of at least four
digits, and a suffix. The hex digits come from a key, the row's key and the text, so that a task that runs again makes the same
tokens, and two texts of one row key share none; without the key they can't be told.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import byte_slice, let

#: The token's parts, and how often a new name space is tried if a token already stands in the text.
PREFIX, SUFFIX, ATTEMPTS = "{{LLMG_", "}}", 32
TOKENS = "array<struct<token:string,value:string>>"
#: Bytes that a token has at most, with a counter of up to ten digits.
LONGEST = 6 + 32 + 1 + 10 + 2 + 1
TOKEN = r"\{\{LLMG_[0-9a-f]{32}_[0-9]{4,}\}\}"


def token_text(namespace: Column, number: Column) -> Column:
    return F.concat(F.lit(PREFIX), namespace, F.lit("_"), F.lpad(number.cast("string"), F.greatest(F.length(number.cast("string")), F.lit(4)), F.lit("0")), F.lit(SUFFIX))


def namespace(text: Column, key: str, row_key: Column, count: Column) -> Column:
    """The first of ATTEMPTS name spaces none of whose `count` tokens stands in the text, or null."""
    own = F.sha2(text.cast("binary"), 256)
    space = lambda i: F.left(F.sha2(F.concat_ws("|", F.lit(key), row_key.cast("string"), own, i).cast("binary"), 256), F.lit(32))
    spaces = F.transform(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), lambda i: space(i.cast("string")))
    clear = lambda n: ~F.exists(F.sequence(F.lit(1), count), lambda i: F.contains(text, token_text(n, i)))
    return F.when(~F.contains(text, F.lit(PREFIX)), space(F.lit("0"))).otherwise(F.try_element_at(F.filter(spaces, clear), F.lit(1)))


def token_list(raw: Column, masked: Column, space: Column) -> Column:
    """token and value of each masked finding, counted in text order from 1."""
    return F.transform(masked, lambda f, i: F.struct(token_text(space, i + 1).alias("token"), byte_slice(raw, f["start"], f["end"]).alias("value")))


def rebuilt(raw: Column, masked: Column, tokens: Column) -> Column:
    """The text with each finding's bytes replaced by its token; findings are in order and apart."""
    begins = F.concat(F.array(F.lit(0)), F.transform(masked, lambda f: f["end"]))
    ends = F.concat(F.transform(masked, lambda f: f["start"]), F.array(F.octet_length(raw)))
    gaps = F.zip_with(begins, ends, lambda a, b: byte_slice(raw, a, b))
    between = F.concat(F.transform(tokens, lambda t: t["token"]), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, between, lambda g, t: F.concat(g, t)), "")


def placeholder_map(text: Column, masked: Column, findings: Column) -> Column:
    """token and value of each finding (in order and apart), read off the masked text; null where the two texts don't agree around them."""
    raw, out = text.cast("binary"), masked.cast("binary")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("to"), F.lit(True).alias("ok"), F.array().cast(TOKENS).alias("pairs"))

    def step(acc: Column, f: Column) -> Column:
        gap = f["start"] - acc["at"]
        same = byte_slice(raw, acc["at"], f["start"]) == byte_slice(out, acc["to"], acc["to"] + gap)
        here = acc["to"] + gap
        token = F.regexp_extract(byte_slice(out, here, here + LONGEST), "^" + TOKEN, 0)
        pair = F.struct(token.alias("token"), byte_slice(raw, f["start"], f["end"]).alias("value"))
        ok = acc["ok"] & (gap >= 0) & F.coalesce(same, F.lit(False)) & (token != "")
        return F.struct(f["end"].alias("at"), (here + F.octet_length(token)).alias("to"), ok.alias("ok"), F.concat(acc["pairs"], F.array(pair)).alias("pairs"))

    def whole(acc: Column) -> Column:
        rest = byte_slice(raw, acc["at"], F.octet_length(raw)) == byte_slice(out, acc["to"], F.octet_length(out))
        return F.when(acc["ok"] & F.coalesce(rest, F.lit(False)), acc["pairs"])

    return F.aggregate(findings, start, step, whole)


def hits_of(response: Column, tokens: Column) -> Column:
    """token and value (null if it isn't known) of the well-formed tokens in a response, in order.

    A set as masking makes it holds its tokens in the order of their numbers, and is asked by place; any other by search.
    """
    hits = F.when(F.contains(response, F.lit(PREFIX)), F.regexp_extract_all(response, F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    space = lambda t: F.substring(F.get(t, F.lit(0))["token"], len(PREFIX) + 1, 32)
    in_turn = lambda t: F.forall(F.transform(t, lambda x, i: F.coalesce(x["token"] == token_text(space(t), i + 1), F.lit(False))), lambda x: x)
    number = lambda hit: F.regexp_extract(hit, "_([0-9]+)}}$", 1).try_cast("int")
    by_place = lambda t, hit: let(F.get(t, number(hit) - 1), lambda x: F.when(x["token"] == hit, x["value"]))
    by_search = lambda t, hit: F.try_element_at(F.transform(F.filter(t, lambda x: x["token"] == hit), lambda x: x["value"]), F.lit(1))
    looked = lambda find: lambda hit: F.struct(hit.alias("token"), find(hit).alias("value"))

    def known(t: Column) -> Column:
        return F.when(in_turn(t), F.transform(hits, looked(lambda hit: by_place(t, hit)))).otherwise(F.transform(hits, looked(lambda hit: by_search(t, hit))))

    return let(tokens, known)


def restored(response: Column, tokens: Column, hits: Column) -> Column:
    """Known tokens replaced by their values in one pass; unknown ones stay, and values aren't looked into. `hits`: hits_of() them."""
    values = F.transform(hits, lambda h: F.coalesce(h["value"], h["token"]))
    text = F.array_join(F.zip_with(F.split(response, TOKEN, -1), F.concat(values, F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")
    return F.when((F.size(tokens) == 0) | (F.size(hits) == 0), response).otherwise(text)


def misses(hits: Column) -> Column:
    """How many well-formed tokens of the response aren't known; repeats count."""
    return F.size(F.filter(hits, lambda h: h["value"].isNull()))


def placeholders(response: Column) -> Column:
    """The different well-formed tokens, in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(response, F.lit(TOKEN), F.lit(0)))
