"""The engine's queries over the driver's tables, and the same answers in SQL.

Families that occur in `documents` are compared with patterns that the other engine runs itself. Families that don't
are compared by construction: SQL makes texts of table columns, so that where each span lies is plain arithmetic.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions.scanners import INN_11, INN_12
from ..operators import detectors as d
from ..operators.guard import BLOCK, Guard, restore
from ..operators.masking import placeholders
from ..operators.observe import detect_events, mask_events, restore_events, totals
from ..operators.resolve import resolve_checked
from ..sources import suites
from ..streaming.pipelines import windowed_findings
from . import evaluation as ev
from .mapping import Mapping
from .mapping import map_labels as label_annotations

KEY = "masking key of the test queries"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def spans_out(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, "entity", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


# families that occur in documents --------------------------------------------------------------------------------

def span_sql(pattern: str, entity: str, ok: str, of: str = "documents", key: str = "doc_id") -> str:
    """Candidates of an RE2 pattern with offsets in bytes (a, b) and characters (pos), neighbours (p1, p2, n1, n2: one and two characters) and digits (g)."""
    p = pattern.replace("'", "''")
    return f"""
        SELECT {key}, '{entity}' AS entity, a::INT AS span_start, b::INT AS span_end, pos, v FROM (
            SELECT *, a + strlen(v) AS b, right(substr(text, 1, pos), 1) AS p1, right(substr(text, 1, pos), 2) AS p2,
                   substr(text, pos + length(v) + 1, 1) AS n1, substr(text, pos + length(v) + 1, 2) AS n2, regexp_replace(v, '[^0-9]', '', 'g') AS g
            FROM (
                SELECT {key}, text, hits[i] AS v,
                       coalesce(list_sum(list_transform(gaps[1:i], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: strlen(x))), 0) AS a,
                       (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::BIGINT AS pos
                FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
                    SELECT {key}, text, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps FROM {of} WHERE regexp_matches(text, '{p}')))))
        WHERE {ok}"""


WORDY = r"[\p{L}\p{Nd}]"
ALONE = f"NOT regexp_matches(p1, '{WORDY}') AND NOT regexp_matches(n1, '{WORDY}')"
NUMBER = ALONE + r" AND NOT regexp_matches(p2, '[0-9][-._]$') AND NOT regexp_matches(n2, '^[-._][0-9]')"
LUHN = "list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 1 THEN (2 * substr(g, i, 1)::INT) // 10 + (2 * substr(g, i, 1)::INT) % 10 ELSE substr(g, i, 1)::INT END)) % 10 = 0"
SAME = "length(replace(g, g[1], '')) = 0"

FOUND_SQL = {
    "EMAIL": span_sql(
        r"[a-zA-Z0-9](?:[a-zA-Z0-9._+-]*[a-zA-Z0-9])?@[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?)+",
        "EMAIL",
        r"NOT regexp_matches(p1, '[\p{L}\p{Nd}.+_@-]') AND NOT regexp_matches(n1, '[\p{L}\p{Nd}.+_@-]') AND NOT contains(string_split(v, '@')[1], '..')",
    ),
    "PHONE": span_sql(
        r"\+[0-9][0-9\s\-().]{5,22}[0-9]|(?:\+7|8)[0-9\s\-().]{8,22}[0-9]",
        "PHONE",
        r"""NOT regexp_matches(p1, '[\p{L}\p{Nd}+()-]') AND NOT regexp_matches(n1, '[\p{L}\p{Nd}+()-]') AND NOT contains(v, '.') AND length(g) BETWEEN 8 AND 15
            AND (NOT regexp_matches(v, '[()]') OR regexp_full_match(v, '[^()]*\([0-9]+\)[^()]*'))
            AND (CASE WHEN v[1] = '8' OR g[1] = '7' THEN length(g) = 11 AND (NOT contains(v, '(') OR regexp_extract(v, '\(([0-9]+)\)', 1) = substr(g, 2, 3)) ELSE v[1] = '+' END)""",
    ),
    "IP_ADDRESS": span_sql(
        r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
        "IP_ADDRESS",
        ALONE + r" AND NOT regexp_matches(n2, '^(:|\.[0-9])') AND len(list_filter(string_split(v, '.'), lambda x: NOT regexp_full_match(x, '0|[1-9][0-9]{0,2}') OR x::INT > 255)) = 0",
    ),
    "BANK_CARD": span_sql(r"(?:[0-9][ -]?){12,18}[0-9]", "BANK_CARD", f"{NUMBER} AND NOT (contains(v, ' ') AND contains(v, '-')) AND NOT ({SAME}) AND {LUHN}"),
}
PLAIN = "SELECT doc_id, entity, span_start, span_end FROM ({})"
ALL_SQL = " UNION ALL ".join(FOUND_SQL.values())
RANKED_SQL = f"""
    WITH f AS (SELECT *, CASE entity {" ".join(f"WHEN '{e}' THEN {p}" for e, p in d.PRIORITY.items())} END AS rank FROM ({ALL_SQL})),
    r AS (SELECT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.doc_id = x.doc_id AND y.span_start < x.span_end AND x.span_start < y.span_end AND y.rank > x.rank))"""


def _documents_with(detector, spark, sf_dir):
    guard = Guard((detector,), key=KEY)
    return spans_out(guard.findings_table(table(spark, sf_dir, "documents"), ["doc_id"]), "doc_id")


for _name, _maker, _entity in (("email", d.email, "EMAIL"), ("phone", d.phone, "PHONE"), ("ip", d.ip, "IP_ADDRESS"), ("bank_card", d.bank_card, "BANK_CARD")):
    query(f"detect_{_name}", PLAIN.format(FOUND_SQL[_entity]))(lambda spark, sf_dir, m=_maker: _documents_with(m(), spark, sf_dir))


@query("detect_custom_pattern", PLAIN.format(span_sql("[0-9a-f]{40}", "HEX_TOKEN", "true")))
def detect_custom(spark, sf_dir):
    return _documents_with(d.regexp("hex_token", "HEX_TOKEN", "[0-9a-f]{40}"), spark, sf_dir)


def long_numbers(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer("[0-9]{5,}", text)]


@query("detect_custom_function", PLAIN.format(span_sql("[0-9]+", "LONG_NUMBER", "length(v) >= 5")))
def detect_function(spark, sf_dir):
    return _documents_with(d.function("long_numbers", "LONG_NUMBER", long_numbers), spark, sf_dir)


@query("findings_all", PLAIN.format(ALL_SQL))
def findings_all(spark, sf_dir):
    return spans_out(Guard.full(key=KEY).findings_table(table(spark, sf_dir, "documents"), ["doc_id"]), "doc_id")


@query("resolve_all", f"{RANKED_SQL} SELECT doc_id, entity, span_start, span_end FROM r")
def resolve_all(spark, sf_dir):
    return spans_out(Guard.full(key=KEY).findings_table(table(spark, sf_dir, "documents"), ["doc_id"], resolved=True), "doc_id")


MASKED_SQL = f"""{RANKED_SQL},
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY span_start) AS k, coalesce(lag(pos + length(v)) OVER (PARTITION BY doc_id ORDER BY span_start), 0) AS before FROM r),
    t AS (SELECT n.*, documents.text, '{{{{LLMG_' || left(sha256('{KEY}|' || doc_id || '|' || sha256(documents.text) || '|0'), 32) || '_' || lpad(k::VARCHAR, 4, '0') || '}}}}' AS token FROM n JOIN documents USING (doc_id)),
    m AS (SELECT doc_id, string_agg(substr(text, before + 1, pos - before) || token, '' ORDER BY k) || substr(any_value(text), max(pos + length(v)) + 1) AS masked, count(*) AS n_tokens FROM t GROUP BY doc_id)"""


@query("mask_documents", f"{MASKED_SQL} SELECT doc_id, 'success' AS status, sha256(coalesce(masked, text)) AS masked_sha256, coalesce(n_tokens, 0)::INT AS n_tokens FROM documents LEFT JOIN m USING (doc_id)")
def mask_documents(spark, sf_dir):
    masked = Guard.full(key=KEY).mask(table(spark, sf_dir, "documents"), "doc_id")
    return masked.select("doc_id", F.col("masked.status").alias("status"), F.sha2(F.col("masked.text").cast("binary"), 256).alias("masked_sha256"), F.size("masked.tokens").alias("n_tokens"))


@query("restore_roundtrip", "SELECT doc_id, true AS same, 'success' AS status FROM documents")
def restore_roundtrip(spark, sf_dir):
    masked = Guard.full(key=KEY).mask(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    sides = masked.select("doc_id", "text", F.col("masked.text").alias("response"), F.col("masked.tokens").alias("tokens"))
    back = restore(sides, "response", "tokens")
    return back.select("doc_id", (F.col("restored.text") == F.col("text")).alias("same"), F.col("restored.status").alias("status"))


@query(
    "restore_misses",
    """SELECT conv_id, turn, (turn % 3)::INT AS misses, CASE WHEN turn % 3 = 0 THEN 'success' ELSE 'restore_miss' END AS status, strlen(text) + 49 * (turn % 3) AS bytes FROM conversations""",
)
def restore_misses(spark, sf_dir):
    strange = "{{LLMG_" + "0" * 32 + "_00012}}"
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(f"concat(text, repeat(' {strange} ', cast(turn % 3 as int)))").alias("response"), F.expr("array(named_struct('token', '{{LLMG_" + "1" * 32 + "_0001}}', 'value', 'x'))").alias("tokens"))
    back = restore(talk, "response", "tokens")
    return back.select("conv_id", "turn", F.col("restored.misses").alias("misses"), F.col("restored.status").alias("status"), F.octet_length("restored.text").cast("long").alias("bytes"))


@query("policy_block_rows", f"SELECT DISTINCT doc_id, true AS no_text FROM ({FOUND_SQL['BANK_CARD']})")
def policy_block_rows(spark, sf_dir):
    guard = Guard.full(key=KEY, entity_actions={"BANK_CARD": BLOCK})
    masked = guard.mask(table(spark, sf_dir, "documents"), "doc_id").where(F.col("masked.status") == "blocked")
    return masked.select("doc_id", F.col("masked.text").isNull().alias("no_text"))


@query("entity_counts_by_lang", f"{RANKED_SQL} SELECT lang, entity, count(*) AS findings FROM r JOIN documents USING (doc_id) GROUP BY lang, entity")
def entity_counts_by_lang(spark, sf_dir):
    found = Guard.full(key=KEY).findings_table(table(spark, sf_dir, "documents"), ["doc_id", "lang"], resolved=True)
    return found.groupBy("lang", "entity").agg(F.count(F.lit(1)).alias("findings"))


@query(
    "mask_event_totals",
    f"{RANKED_SQL} SELECT 'mask' AS operation, 'success' AS outcome, (SELECT count(*) FROM documents) AS calls, (SELECT count(*) FROM r) AS findings, 0::BIGINT AS restore_misses, (SELECT sum(strlen(text)) FROM documents)::BIGINT AS input_bytes",
)
def mask_event_totals(spark, sf_dir):
    guard = Guard.full(key=KEY)
    return totals(mask_events(guard, guard.mask(table(spark, sf_dir, "documents"), "doc_id")))


@query(
    "event_totals",
    f"""WITH x AS (SELECT doc_id, span_end - span_start AS n FROM ({FOUND_SQL["EMAIL"]})), d AS (SELECT count(*) AS calls, sum(strlen(text)) AS b FROM documents)
    SELECT operation, 'success' AS outcome, calls, CASE operation WHEN 'restore' THEN 0 ELSE (SELECT count(*) FROM x) END::BIGINT AS findings, 0::BIGINT AS restore_misses,
           (b + CASE operation WHEN 'restore' THEN (SELECT coalesce(sum(46 - n), 0) FROM x) ELSE 0 END)::BIGINT AS input_bytes
    FROM d, (VALUES ('detect'), ('mask'), ('restore')) o(operation)""",
)
def event_totals(spark, sf_dir):
    guard, docs = Guard((d.email(),), key=KEY), table(spark, sf_dir, "documents").select("doc_id", "text")
    masked = guard.mask(docs, "doc_id")
    back = restore(masked.select(F.col("masked.text").alias("response"), F.col("masked.tokens").alias("tokens")), "response", "tokens")
    return totals(detect_events(guard.detect(docs)).unionByName(mask_events(guard, masked)).unionByName(restore_events(back, "response")))


@query("action_counts", f"{RANKED_SQL} SELECT CASE entity WHEN 'PHONE' THEN 'allow' ELSE 'mask' END AS action, count(*) AS findings FROM r GROUP BY ALL")
def action_counts_(spark, sf_dir):
    guard = Guard.full(key=KEY, entity_actions={"PHONE": "allow"})
    events = mask_events(guard, guard.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))
    return events.select(F.explode("action_counts").alias("a")).groupBy("a.action").agg(F.sum("a.count").alias("findings"))


@query("placeholders_distinct", "SELECT conv_id, turn, (1 + turn % 2)::INT AS tokens, (turn % 2 = 1) AS second_is_last FROM conversations")
def placeholders_distinct(spark, sf_dir):
    a, b = ("{{LLMG_" + c * 32 + "_0001}}" for c in "ab")
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit(a), "text", F.expr(f"if(turn % 2 = 1, '{b}', '')"), F.lit(a)).alias("response"))
    found = talk.select("conv_id", "turn", placeholders(F.col("response")).alias("p"))
    return found.select("conv_id", "turn", F.size("p").alias("tokens"), (F.element_at("p", -1) == b).alias("second_is_last"))


@query(
    "finding_errors",
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 1 THEN 'entity' WHEN 2 THEN 'confidence' WHEN 3 THEN 'span' WHEN 4 THEN 'utf8_boundary' WHEN 5 THEN 'detector' END AS error,
              CASE WHEN c_custkey % 7 IN (0, 6) THEN 1 ELSE 0 END::INT AS resolved FROM customer""",
)
def finding_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('яя ', cast(c_custkey as string)) as text", "c_custkey % 7 as k")
    case = lambda at, bad, good: F.when(F.col("k") == at, F.lit(bad)).otherwise(F.lit(good))
    own = F.struct(case(1, " ", "OWN").alias("entity"), F.lit(0).alias("start"), F.when(F.col("k") == 3, 99).when(F.col("k") == 4, 1).otherwise(2).alias("end"), case(2, 1.5, 0.5).alias("confidence"), case(5, None, "d").alias("detector"))
    wide = F.struct(F.lit("OWN").alias("entity"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit(0.5).alias("confidence"), F.lit("d").alias("detector"))
    checked = rows.select("c_custkey", resolve_checked(F.array(wide, own), F.col("text")).alias("r"))
    return checked.select("c_custkey", F.col("r.error").alias("error"), F.size("r.findings").alias("resolved"))


# families by construction -----------------------------------------------------------------------------------------

def dig(s: str, i: int) -> str:
    return f"cast(substring({s}, {i}, 1) as int)"


def weigh(s: str, weights) -> str:
    return "(" + " + ".join(f"{w} * {dig(s, i + 1)}" for i, w in enumerate(weights)) + ")"


NINE = "lpad(cast(c_custkey * 7919 + 100000000 as string), 9, '0')"
TEN = f"{NINE} || cast(c_custkey % 10 as string)"
ELEVENTH = f"cast({weigh(f'({TEN})', INN_11)} % 11 % 10 as string)"
TWELFTH = f"cast({weigh(f'({TEN} || {ELEVENTH})', INN_12)} % 11 % 10 as string)"
#: What the check of an account and a bank code sums, with 0 for the account's own check digit.
CODED = f"('225' || '40702810' || '0' || '00' || {NINE})"
#: family: detector, columns to prepare (both engines), text before, value, text after, whether the value is a finding.
BUILT = {
    "inn": (d.inn, "INN", "клиент ИНН ", f"{NINE} || cast(({weigh(NINE, (2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 + c_custkey % 3) % 10 as string)", " активен", "c_custkey % 3 = 0"),
    "snils": (
        d.snils,
        "SNILS",
        "снилс ",
        f"substring({NINE}, 1, 3) || '-' || substring({NINE}, 4, 3) || '-' || substring({NINE}, 7, 3) || ' ' || lpad(cast(({weigh(NINE, range(9, 0, -1))} % 101 % 100 + c_custkey % 2) % 100 as string), 2, '0')",
        ".",
        "c_custkey % 2 = 0",
    ),
    "passport": (d.passport, "PASSPORT", "паспорт РФ № ", f"substring({NINE}, 1, 4) || case when c_custkey % 4 = 0 then '-' else ' ' end || '0' || substring({NINE}, 5, 5)", ", выдан", "c_custkey % 4 <> 0"),
    "bank_account": (d.bank_account, "BANK_ACCOUNT", "расчётный счёт: ", f"'4070281' || case when c_custkey % 5 = 0 then '0' else '00' end || '00' || {NINE}", " ок", "c_custkey % 5 <> 0"),
    "date_of_birth": (
        d.date_of_birth,
        "DATE_OF_BIRTH",
        "дата рождения: ",
        "lpad(cast(case when c_custkey % 5 = 0 then 31 else c_custkey % 28 + 1 end as string), 2, '0') || '.' || lpad(cast(case when c_custkey % 5 = 0 then 2 else c_custkey % 12 + 1 end as string), 2, '0') || '.' || cast(1950 + c_custkey % 50 as string)",
        "",
        "c_custkey % 5 <> 0",
    ),
    "jwt": (d.jwt, "SECRET_JWT", "token ", "case when c_custkey % 3 = 0 then 'eyJhbGciOiJub25lIn0' else 'eyJhbGciOiJIUzI1NiJ9' end || '.eyJzdWIiOiJ4In0.' || lpad(cast(c_custkey as string), 8, 'A')", ".", "c_custkey % 3 <> 0"),
    "api_key": (d.api_key, "SECRET_API_KEY", "key=", "'ghp_' || lpad(cast(c_custkey as string), cast(36 - c_custkey % 3 as int), 'A')", " ", "c_custkey % 3 = 0"),
    "private_key": (d.private_key, "SECRET_PRIVATE_KEY", "", "'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || lpad(cast(c_custkey as string), 8, 'A') || chr(10) || '-----END ' || case when c_custkey % 3 = 0 then 'EC' else 'RSA' end || ' PRIVATE KEY-----'", "", "c_custkey % 3 <> 0"),
    "dsn": (d.dsn, "CONNECTION_STRING", "(", "'postgres://u' || cast(c_custkey as string) || case when c_custkey % 3 = 0 then '' else ':p' end || '@[::1]:5432/db'", ").", "c_custkey % 3 <> 0"),
    "inn_12": (d.inn, "INN", "ИНН ", f"{TEN} || {ELEVENTH} || cast((cast({TWELFTH} as int) + c_custkey % 2) % 10 as string)", "", "c_custkey % 2 = 0"),
    "snils_compact": (d.snils, "SNILS", "снилс ", f"{NINE} || lpad(cast(({weigh(NINE, range(9, 0, -1))} % 101 % 100 + c_custkey % 2) % 100 as string), 2, '0')", ".", "c_custkey % 2 = 0"),
    "bank_account_code": (d.bank_account, "BANK_ACCOUNT", "БИК 044525225, расчётный счёт ", f"'40702810' || cast(((10 - {weigh(CODED, (7, 1, 3) * 7 + (7, 1))} % 10) * 7 + c_custkey % 3) % 10 as string) || '00' || {NINE}", " ок", "c_custkey % 3 = 0"),
    "person_shapes": (
        d.person,
        "PERSON",
        "Договор: ",
        "case c_custkey % 7 when 0 then 'Иван Сергеевич Петров' when 1 then 'Петров Иван Сергеевич' when 2 then 'Петров И. С.' when 3 then 'И. С. Петров' when 4 then 'Мария Иванова' when 5 then 'Иванова Мария' else 'Мария Петров' end",
        " и др",
        "c_custkey % 7 <> 6",
    ),
    "address_parts": (
        d.address,
        "ADDRESS",
        "Адрес: ",
        "case c_custkey % 5 when 0 then 'ул. Ленина, д. 7, корп. 2, стр. 1, кв. ' when 1 then 'г. Москва, ул. Тверская, д. ' when 2 then 'проспект Мира, ' when 3 then 'Невский проспект, дом ' else 'ул. Ленина,, ' end || cast(c_custkey % 90 + 1 as string)",
        " указан",
        "c_custkey % 5 <> 4",
    ),
    "ip_v6_mixed": (d.ip, "IP_ADDRESS", "at ", "case c_custkey % 3 when 0 then '2001:db8::192.0.2.' || cast(c_custkey % 200 as string) when 1 then '::1' else 'fe80::1%eth0' end", " ok", "c_custkey % 3 <> 2"),
    "person": (d.person, "PERSON", "Договор: ", "case c_custkey % 4 when 0 then 'иван петров' when 1 then 'Петров И. С.' when 2 then 'Мария Иванова' else 'Ивану Сергеевичу Петрову' end", " и др", "c_custkey % 4 <> 0"),
    "address": (d.address, "ADDRESS", "Адрес: ", "'ул. Ленина, д. ' || cast(c_custkey % 200 + 1 as string) || case when c_custkey % 3 = 0 then 'АБ' else ', кв. 7' end", " указан", "c_custkey % 3 <> 0"),
    "ip_v6": (d.ip, "IP_ADDRESS", "from [", "case when c_custkey % 3 = 0 then '2001:zz' else '2001:db8::' || cast(c_custkey % 9999 as string) end", "]:443", "c_custkey % 3 <> 0"),
}


def _built(name, spark, sf_dir):
    maker, entity, before, value, after, _ = BUILT[name]
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"'{before}' || {value} || '{after}'").alias("text"))
    return spans_out(Guard((maker(),), key=KEY).findings_table(texts, ["c_custkey"]), "c_custkey")


for _name, (_maker, _entity, _before, _value, _after, _ok) in BUILT.items():
    query(
        f"detect_{_name}",
        f"SELECT c_custkey, '{_entity}' AS entity, strlen('{_before}')::INT AS span_start, (strlen('{_before}') + strlen({_value}))::INT AS span_end FROM customer WHERE {_ok}",
    )(lambda spark, sf_dir, n=_name: _built(n, spark, sf_dir))


@query("detect_url", "SELECT page_id, 'URL' AS entity, 5 AS span_start, (5 + strlen(url))::INT AS span_end FROM pages WHERE regexp_matches(url, '^https?://')")
def detect_url(spark, sf_dir):
    texts = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("see ("), "url", F.lit(").")).alias("text"))
    return spans_out(Guard((d.url(),), key=KEY).findings_table(texts, ["page_id"]), "page_id")


# intervals, evaluation, streams -----------------------------------------------------------------------------------

SPANS_SQL = "SELECT l_orderkey, (l_partkey % 100)::INT AS s, (l_partkey % 100 + l_quantity::INT)::INT AS e FROM lineitem"


@query(
    "interval_union_bytes",
    f"""WITH x AS ({SPANS_SQL}), m AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
    u AS (SELECT l_orderkey, g, max(e) - min(s) AS n FROM i GROUP BY l_orderkey, g)
    SELECT l_orderkey, sum(n)::BIGINT AS bytes, count(*) AS islands FROM u GROUP BY l_orderkey""",
)
def interval_union_bytes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "cast(l_partkey % 100 as int) as start", "cast(l_partkey % 100 + cast(l_quantity as int) as int) as end")
    merged = iv.merge_rows(rows, ["l_orderkey"])
    return merged.groupBy("l_orderkey").agg(F.sum(F.expr("end - start")).cast("long").alias("bytes"), F.count(F.lit(1)).alias("islands"))


@query("interval_difference", "SELECT c_custkey, (10 + least(c_custkey % 30, 15))::INT AS common, (20 - least(c_custkey % 30, 15))::INT AS only_a, c_custkey % 30 <= 10 AS open_tail FROM customer")
def interval_difference(spark, sf_dir):
    a = F.expr("array(named_struct('start', 0, 'end', 10), named_struct('start', 10, 'end', 15), named_struct('start', 20, 'end', 35))")
    b = F.expr("array(named_struct('start', 5, 'end', 15), named_struct('start', 20, 'end', 20 + cast(c_custkey % 30 as int)))")
    rows = table(spark, sf_dir, "customer").select("c_custkey", iv.merge(a).alias("a"), iv.merge(F.filter(b, lambda s: s["end"] > s["start"])).alias("b"))
    return rows.select("c_custkey", iv.total_bytes(iv.intersection(F.col("a"), F.col("b"))).alias("common"), iv.total_bytes(iv.difference(F.col("a"), F.col("b"))).alias("only_a"), iv.covered(F.expr("named_struct('start', 30, 'end', 35)"), iv.difference(F.col("a"), F.col("b"))).alias("open_tail"))


GOLD_SQL = f"SELECT doc_id, entity, span_start, span_end FROM ({ALL_SQL}) WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'EMAIL', 0, 3 FROM documents WHERE doc_id % 10 = 0"


def _gold_and_found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = Guard.full(key=KEY).findings_table(docs, ["doc_id"]).withColumnRenamed("doc_id", "record").select("record", *ev.SPAN)
    made = docs.where("doc_id % 10 = 0").selectExpr("doc_id as record", "'EMAIL' as entity", "0 as start", "3 as end")
    return found.where("record % 3 <> 0").unionByName(made), found


@query(
    "eval_contract",
    f"""WITH g AS (SELECT DISTINCT * FROM ({GOLD_SQL})), f AS (SELECT DISTINCT doc_id, entity, span_start, span_end FROM ({ALL_SQL})),
    k AS (SELECT coalesce(g.entity, f.entity) AS entity, g.doc_id IS NOT NULL AS gold, f.doc_id IS NOT NULL AS found FROM g FULL JOIN f ON g.doc_id = f.doc_id AND g.entity = f.entity AND g.span_start = f.span_start AND g.span_end = f.span_end),
    c AS (SELECT entity, count(*) FILTER (gold AND found) AS tp, count(*) FILTER (found AND NOT gold) AS fp, count(*) FILTER (gold AND NOT found) AS fn FROM k GROUP BY GROUPING SETS ((entity), ()))
    SELECT entity, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6)::DOUBLE AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6)::DOUBLE AS recall FROM c""",
)
def eval_contract(spark, sf_dir):
    gold, found = _gold_and_found(spark, sf_dir)
    return ev.contract(gold, found).select("entity", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "eval_exposure",
    f"""WITH x AS (SELECT doc_id, span_start AS s, span_end AS e FROM ({ALL_SQL})), n AS (SELECT doc_id, strlen(text) AS n, strlen(text) // 2 AS h FROM documents),
    m AS (SELECT doc_id, sum(e - s) AS total, sum(greatest(0, e - greatest(s, h))) AS covered FROM x JOIN n USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, (n - h)::INT AS sensitive, coalesce(covered, 0)::INT AS covered, (n - h - coalesce(covered, 0))::INT AS leaked, coalesce(total - covered, 0)::INT AS overmatched FROM n LEFT JOIN m USING (doc_id)""",
)
def eval_exposure(spark, sf_dir):
    return ev.exposure(_half_sensitive(spark, sf_dir)).select("doc_id", "sensitive", "covered", "leaked", "overmatched")


def _half_sensitive(spark, sf_dir):
    """Documents with what was found, and the second half of each text's bytes as a person."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.octet_length("text")
    seen = Guard.full(key=KEY).detect(docs).select("doc_id", F.floor(size / 2).cast("int").alias("h"), size.alias("n"), F.col("detected.findings").alias("findings"))
    gold = F.array(F.struct(F.lit("half").alias("source_label"), F.lit("PERSON").alias("mapped_entity"), F.col("h").alias("start"), F.col("n").alias("end"), F.lit("supported").alias("disposition"), F.lit("").alias("reason")))
    return seen.withColumn("annotations", gold)


@query(
    "eval_by_label",
    f"""WITH x AS (SELECT doc_id, entity, span_start AS s, span_end AS e FROM ({ALL_SQL})), n AS (SELECT doc_id, strlen(text) AS n, strlen(text) // 2 AS h FROM documents),
    y AS (SELECT *, greatest(0, e - greatest(s, h)) AS inside FROM x JOIN n USING (doc_id)), o AS (SELECT entity, sum(e - s - inside) AS o FROM y GROUP BY entity)
    SELECT 'half' AS source_label, 'PERSON' AS mapped_entity, 'supported' AS disposition, (SELECT count(*) FROM n) AS span_count, 0::BIGINT AS fully_covered_span_count,
           (SELECT sum(n - h) FROM n)::BIGINT AS sensitive, (SELECT sum(inside) FROM y)::BIGINT AS covered, ((SELECT sum(n - h) FROM n) - (SELECT sum(inside) FROM y))::BIGINT AS leaked, 0::BIGINT AS overmatched
    UNION ALL SELECT '', entity, '', 0, 0, 0, 0, 0, o::BIGINT FROM o WHERE o > 0""",
)
def eval_by_label(spark, sf_dir):
    return ev.exposure_by_label(_half_sensitive(spark, sf_dir), "doc_id")


KINDS_SQL = f"""WITH g AS (SELECT DISTINCT * FROM ({GOLD_SQL})), f AS (SELECT DISTINCT doc_id, entity, span_start, span_end FROM ({ALL_SQL})),
    k AS (SELECT coalesce(g.doc_id, f.doc_id) AS doc_id, coalesce(g.entity, f.entity) AS entity, coalesce(g.span_start, f.span_start) AS a, coalesce(g.span_end, f.span_end) AS b, g.doc_id IS NOT NULL AS gold, f.doc_id IS NOT NULL AS found
          FROM g FULL JOIN f ON g.doc_id = f.doc_id AND g.entity = f.entity AND g.span_start = f.span_start AND g.span_end = f.span_end)"""


@query(
    "eval_diagnostics",
    f"""{KINDS_SQL} SELECT doc_id, entity, CASE WHEN gold THEN 'fn' ELSE 'fp' END AS kind, CASE WHEN gold THEN a END AS gold_start, CASE WHEN gold THEN b END AS gold_end,
        CASE WHEN found THEN a END AS found_start, CASE WHEN found THEN b END AS found_end FROM k WHERE NOT (gold AND found)""",
)
def eval_diagnostics(spark, sf_dir):
    return ev.diagnostics(*_gold_and_found(spark, sf_dir)).withColumnRenamed("record", "doc_id")


@query("eval_by_source", f"{KINDS_SQL} SELECT source, count(*) FILTER (gold AND found) AS tp, count(*) FILTER (found AND NOT gold) AS fp, count(*) FILTER (gold AND NOT found) AS fn FROM k JOIN documents USING (doc_id) GROUP BY source")
def eval_by_source(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record"), "source")
    return ev.contract(*_gold_and_found(spark, sf_dir), sources).where("level = 'source'").select("source", "tp", "fp", "fn")


@query(
    "suite_rows_strict",
    """SELECT c_custkey::VARCHAR AS record, CASE c_custkey % 5 WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'unknown field' WHEN 3 THEN 'input_sha256 mismatch' WHEN 4 THEN 'unsupported schema_version' END AS error FROM customer""",
)
def suite_rows_strict(spark, sf_dir):
    line = """concat('{"schema_version":', if(c_custkey % 5 = 4, 3, 2), ',"suite_id":"s","source_id":"x","source_record_id":"', c_custkey, '","mapping_version":"1","input":"t', c_custkey,
        '","input_sha256":"', if(c_custkey % 5 = 3, '0', sha2(concat('t', c_custkey), 256)), '","annotations":[]', if(c_custkey % 5 = 2, ',"more":1', ''), '}', if(c_custkey % 5 = 1, if(c_custkey % 2 = 0, '{"x":1}', ' {}'), ''))"""
    return suites.suite_rows(table(spark, sf_dir, "customer").select(F.expr(line).alias("line"))).select(F.col("source_record_id").alias("record"), "error")


@query(
    "map_labels",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'PERSON' WHEN c_custkey % 3 = 1 THEN 'ADDRESS' ELSE 'EMAIL' END AS entity, (p + CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 12 ELSE 22 END)::INT AS span_start,
              (p + CASE c_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 21 ELSE 28 END)::INT AS span_end, CASE c_custkey % 3 WHEN 2 THEN 0 ELSE 2 END::INT AS parts FROM (SELECT c_custkey, strlen(c_custkey::VARCHAR) + 1 AS p FROM customer)""",
)
def map_labels(spark, sf_dir):
    own = Mapping("1", "s", {"MAIL": "EMAIL"}, ("FIRST_NAME", "LAST_NAME"), 2, ("STREET", "HOUSE"))
    span = lambda label, a, b: f"named_struct('label', '{label}', 'start', p + {a}, 'end', p + {b})"
    spans = f"case c_custkey % 3 when 0 then array({span('B-FIRST_NAME', 0, 4)}, {span('I-LAST_NAME', 5, 10)}) when 1 then array({span('STREET', 12, 18)}, {span('HOUSE', 20, 21)}) else array({span('MAIL', 22, 28)}) end"
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "length(cast(c_custkey as string)) + 1 as p", "concat(c_custkey, ' Anna Smith, Elm St, 5 a@b.co') as text").withColumn("spans", F.expr(spans))
    notes = label_annotations(rows, own).select("c_custkey", "annotations")
    whole = F.get(F.filter("annotations", lambda a: a["disposition"] == "supported"), F.lit(0))
    return notes.select("c_custkey", whole["mapped_entity"].alias("entity"), whole["start"].alias("span_start"), whole["end"].alias("span_end"), F.size(F.filter("annotations", lambda a: a["disposition"] == "unsupported")).alias("parts"))


@query(
    "eval_lifecycle",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'blocked' WHEN c_custkey % 4 = 1 THEN 'ok' ELSE 'mutation_miss' END AS outcome FROM customer",
)
def eval_lifecycle(spark, sf_dir):
    key = "concat('ghp_', lpad(cast(c_custkey as string), 36, 'A'))"
    mail = "concat('u', cast(c_custkey as string), '@example.com')"
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"concat('see ', if(c_custkey % 4 = 0, {key}, {mail}), ' now') as input", "c_custkey % 4 = 0 as secret")
    note = F.struct(F.lit("x").alias("source_label"), F.when(F.col("secret"), "SECRET_API_KEY").otherwise("EMAIL").alias("mapped_entity"), F.lit(4).alias("start"), (F.octet_length("input") - 4).alias("end"), F.lit("supported").alias("disposition"), F.lit("").alias("reason"))
    recipe = F.expr("case c_custkey % 4 when 2 then 'mutate_placeholder' when 3 then if(c_custkey % 8 = 3, 'delete_placeholder', 'collision') end")
    plan = F.struct(F.lit(None).cast("string").alias("expected_action"), recipe.alias("response_recipe"))
    suite = rows.select("c_custkey", "input", F.array(note).alias("annotations"), plan.alias("lifecycle"))
    return ev.lifecycle(suite, Guard.full(key=KEY), "c_custkey").select("c_custkey", "outcome")



@query(
    "events_hourly_findings",
    "SELECT date_trunc('hour', ts) AS window_start, 'EMAIL' AS entity, count(*) AS findings FROM events WHERE user_id % 2 = 0 GROUP BY ALL",
)
def events_hourly(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("ts", F.expr("concat('user', cast(user_id as string), if(user_id % 2 = 0, '@example.com', ' at home'))").alias("text"))
    return windowed_findings(Guard((d.email(),), key=KEY).findings_table(rows, ["ts"]))
