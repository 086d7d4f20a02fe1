import pytest
from pyspark.sql import functions as F

from spanveil.operators import detectors as d
from spanveil.operators.errors import ConfigError
from spanveil.operators.guard import Guard, entity_counts, restore
from spanveil.operators.observe import mask_events, totals
from spanveil.operators.resolve import first_error, resolve

TEXT = "почта a@b.co, карта 4111 1111 1111 1111, тел. +7 (912) 345-67-89"


@pytest.fixture
def texts(spark):
    rows = [(1, TEXT, "x"), (2, "ничего", "x"), (3, None, "x"), (4, "", None), (5, "token ghp_" + "A" * 36, "x"), (1, TEXT, "again")]
    return spark.createDataFrame(rows, "id long, text string, _sv_other string")


def slices(text, findings):
    return [(f.entity, text.encode()[f.start : f.end].decode()) for f in findings]


def test_detect_has_byte_offsets_and_keeps_columns(texts):
    out = Guard.full(key="k").detect(texts)
    assert out.columns == ["id", "text", "_sv_other", "detected"]
    rows = {(r.id, r._sv_other): r.detected for r in out.collect()}
    assert slices(TEXT, rows[1, "x"].findings) == [("EMAIL", "a@b.co"), ("BANK_CARD", "4111 1111 1111 1111"), ("PHONE", "+7 (912) 345-67-89")]
    assert rows[1, "x"] == rows[1, "again"]
    assert not rows[2, "x"].findings and not rows[3, "x"].findings and rows[3, "x"].status == "success"


def test_mask_and_restore(texts):
    guard = Guard.full(key="k", secret_action="mask")
    masked = guard.mask(texts, "id").select("id", "text", F.col("masked.text").alias("response"), F.col("masked.tokens").alias("tokens"), F.col("masked.status").alias("status"))
    for r in masked.collect():
        assert r.status == "success"
        assert all(t.value not in r.response for t in r.tokens)
        assert [t.token[-6:-2] for t in r.tokens] == [f"{i:04d}" for i in range(1, len(r.tokens) + 1)]
    back = restore(masked, "response", "tokens")
    assert all(r.restored.text == r.text for r in back.collect())


def test_secrets_block_by_default(texts):
    row = Guard.full(key="k").mask(texts, "id").where("id = 5").head().masked
    assert row.status == "blocked" and row.text is None and not row.findings and not row.tokens


def test_policy(texts):
    guard = Guard.full(key="k", entity_actions={"EMAIL": "allow", "PHONE": "block"})
    rows = {r.id: r.masked for r in guard.mask(texts, "id").collect()}
    assert rows[1].status == "blocked"
    allow = Guard((d.email(),), entity_actions={"EMAIL": "allow"}, key="k").mask(texts, "id").where("id = 1").head().masked
    assert allow.text == TEXT and len(allow.findings) == 1 and not allow.tokens


def test_restore_counts_unknown_tokens_and_looks_once(spark):
    a, b = ("{{LLMG_" + c * 32 + "_0001}}" for c in "01")
    rows = [(f"{a} {b} {b}", [(a, b)]), ("plain", []), ("x", None)]
    df = spark.createDataFrame(rows, "response string, tokens array<struct<token:string,value:string>>")
    out = [r.restored for r in restore(df, "response", "tokens").collect()]
    assert (out[0].text, out[0].misses, out[0].status) == (f"{b} {b} {b}", 2, "restore_miss")
    assert (out[1].text, out[1].status) == ("plain", "success")
    assert (out[2].text, out[2].status) == (None, "invalid_token_set")


def test_token_collision_takes_another_name_space(spark):
    guard = Guard((d.email(),), key="k")
    first = guard.mask(spark.createDataFrame([(1, "a@b.co")], "id long, text string"), "id").head().masked.tokens[0].token
    text = f"a@b.co {first}"
    row = guard.mask(spark.createDataFrame([(1, text)], "id long, text string"), "id").head().masked
    assert row.status == "success" and row.tokens[0].token != first


def test_resolve_prefers_rank_then_length(spark):
    rows = [([("PHONE", 0, 9, 0.9, "p"), ("BANK_CARD", 2, 6, 0.1, "c"), ("PHONE", 6, 8, 0.9, "p"), ("MINE", 6, 20, 1.0, "m")],)]
    df = spark.createDataFrame(rows, "f array<struct<entity:string,start:int,end:int,confidence:double,detector:string>>")
    found = df.select(resolve(F.col("f")).alias("r"), entity_counts(F.col("f")).alias("n")).head()
    assert [(x.entity, x.start) for x in found.r] == [("BANK_CARD", 2), ("PHONE", 6)]
    assert [(x.entity, x["count"]) for x in found.n] == [("BANK_CARD", 1), ("CUSTOM", 1), ("PHONE", 2)]


def test_finding_validation(spark):
    kind = "f array<struct<entity:string,start:int,end:int,confidence:double,detector:string>>, text string"
    rows = [([("E", 0, 2, 0.5, "d")], "яя"), ([("E", 0, 1, 0.5, "d")], "яя"), ([("E", 0, 9, 0.5, "d")], "яя"), ([(" ", 0, 2, 0.5, "d")], "яя"), ([("E", 0, 2, float("nan"), "d")], "яя")]
    out = spark.createDataFrame(rows, kind).select(first_error(F.col("f"), F.col("text")).alias("e")).collect()
    assert [r.e for r in out] == [None, "utf8_boundary", "span", "entity", "confidence"]


def test_own_detectors_and_their_failures(spark):
    def scan(text):
        if "boom" in text:
            raise RuntimeError(text)
        return [(0, 99)] if "bad" in text else [(0, 1)]

    guard = Guard((d.function("mine", "MINE", scan), d.regexp("hex", "HEX", "[0-9a-f]{4}")), key="k")
    df = spark.createDataFrame([("ok beef",), ("boom",), ("bad",)], "text string")
    a, b, c = (r.detected for r in guard.detect(df).collect())
    assert [(f.entity, f.start, f.end) for f in a.findings] == [("MINE", 0, 1), ("HEX", 3, 7)]
    assert (b.status, b.error_detector, b.error_field, b.findings) == ("detector_error", "mine", "detector", [])
    assert (c.status, c.error_field) == ("detector_error", "span")


def test_configuration_errors():
    for make in (
        lambda: Guard((d.email(), d.email())),
        lambda: Guard((), secret_action="hide"),
        lambda: Guard((), entity_actions={" ": "mask"}),
        lambda: d.regexp("x", "X", "a*"),
        lambda: d.regexp("x", "X", "("),
        lambda: d.function("", "X", len),
        lambda: d.Detector("x", "X", 2.0, scan=len),
    ):
        with pytest.raises(ConfigError):
            make()
    assert "k3y" not in repr(Guard((), key="k3y"))


def test_events_hold_no_values(texts):
    guard = Guard.full(key="k")
    events = mask_events(guard, guard.mask(texts, "id"))
    assert not any("a@b.co" in str(r) or "LLMG" in str(r) for r in events.collect())
    assert {(r.outcome, r.calls) for r in totals(events).collect()} == {("success", 5), ("blocked", 1)}


def test_events_of_all_operations(spark, texts):
    from pyspark.sql import Observation

    from spanveil.operators import observe as ob

    guard = Guard.full(key="k", secret_action="mask")
    seen, masked = guard.detect(texts), guard.mask(texts, "id")
    back = restore(masked.select(F.concat(F.col("masked.text"), F.lit(" {{LLMG_" + "0" * 32 + "_0001}}")).alias("r"), F.col("masked.tokens").alias("t")), "r", "t")
    events = ob.detect_events(seen).unionByName(ob.mask_events(guard, masked)).unionByName(ob.restore_events(back, "r"))
    assert events.schema.simpleString() == spark.createDataFrame([], ob.EVENT).schema.simpleString()
    by = {(r.operation, r.outcome): r for r in totals(events).collect()}
    assert {k: r.calls for k, r in by.items()} == {("detect", "success"): 6, ("mask", "success"): 6, ("restore", "restore_miss"): 5, ("restore", "success"): 1}
    assert by["restore", "restore_miss"].restore_misses == 5 and by["detect", "success"].findings == by["mask", "success"].findings == 7
    watch = Observation("calls")
    assert ob.observed(masked, "masked", watch).select("id").collect() and watch.get == {"calls": 6, "success": 6, "blocked": 0, "restore_miss": 0, "error": 0}
    called = spark.sparkContext.accumulator(0)

    def call(event):
        called.add(event.finding_count)
        raise RuntimeError("an observer's own error")

    assert ob.each_event(ob.detect_events(seen), call).count() == 6 and called.value == 7
    for wrong in (lambda: ob.each_event(events, None), lambda: ob.observed(masked, "masked", None), lambda: ob.unsafe_rows("x", seen, "text", "detected")):
        with pytest.raises(ConfigError):
            wrong()


def test_what_is_shown(texts):
    from spanveil.operators import observe as ob

    row = Guard.full(key="k").mask(texts, "id").where("id = 1").head()
    shown = ob.mask_result(row.masked)
    for x in (repr(shown), str(shown), f"{shown}", shown.as_json(), repr(shown.tokens), f"{shown.tokens}", str(shown.tokens)):
        assert "a@b.co" not in x and "LLMG" not in x and "почта" not in x
    event = ob.Event("mask", "success", 3, 4, 1, entity_counts={"EMAIL": 1})
    assert repr(event) == "Event(operation=mask outcome=success input_bytes=3 output_bytes=4 finding_count=1 restore_misses=0 entity_counts=1 action_counts=0)" and '"EMAIL": 1' in event.as_json()
    raw = ob.unsafe_rows("mask", Guard.full(key="k").mask(texts, "id").where("id = 1"), "text", "masked").head()
    assert raw.input == TEXT and "LLMG" in raw.output and raw.findings and not hasattr(raw, "tokens")


def test_wrong_spans_of_a_callers_column(spark):
    made = lambda a, b: lambda text: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")))
    df = spark.createDataFrame([("яя a@b.co",)], "text string")
    for spans, want in ((made(0, 2), None), (made(0, 1), "utf8_boundary"), (made(3, 3), "span"), (made(0, 99), "span")):
        row = Guard((d.email(), d.Detector("own", "OWN", 0.5, spans=spans)), key="k").detect(df).head().detected
        assert (row.error_field, row.error_detector) == (want, want and "own") and len(row.findings) == (0 if want else 2)


def test_checked_resolution(spark):
    from spanveil.operators.resolve import resolve_checked

    kind = "f array<struct<entity:string,start:int,end:int,confidence:double,detector:string>>, text string"
    out = [r.r for r in spark.createDataFrame([([("E", 0, 2, 0.5, "d"), ("E", 0, 4, 0.5, "d")], "яя"), ([("E", 0, 9, 0.5, "d")], "яя")], kind).select(resolve_checked(F.col("f"), F.col("text")).alias("r")).collect()]
    assert [(x.start, x.end) for x in out[0].findings] == [(0, 4)] and out[0].error is None and out[1].error == "span" and not out[1].findings


def test_tokens_of_one_row_key(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (1, "c@d.co")], "id long, text string")
    tokens = {r.masked.tokens[0].token for r in Guard((d.email(),), key="k").mask(df, "id").collect()}
    assert len(tokens) == 2


def test_many_spans_in_a_row(spark):
    n = 3000
    text = " ё ".join(f"+7 (912) 345-67-{i % 90 + 10}" for i in range(n)) + " x 11223344595, 112-233-445 95"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    row = Guard((d.phone(), d.snils(), d.inn()), key="k").mask(df, "id").head().masked
    assert len(row.findings) == n + 2 and all(text.encode()[f.start : f.end].decode()[:2] in ("+7", "11") for f in row.findings)
    back = restore(spark.createDataFrame([(row.text, row.tokens)], "r string, t array<struct<token:string,value:string>>"), "r", "t").head().restored
    assert back.text == text and back.misses == 0


def test_resolve_against_plain_code(spark):
    import random

    from spanveil.operators.resolve import PRIORITY

    rng = random.Random(8)
    rows = []
    for _ in range(80):
        row = []
        for _ in range(rng.choice([0, 1, 2, 5, 30, 150])):
            a = rng.randrange(600)
            row.append((rng.choice(["EMAIL", "PHONE", "INN", "OWN"]), a, a + rng.randint(1, rng.choice([3, 40])), rng.choice([0.5, 0.9]), rng.choice("xy")))
        rows.append((row,))

    def plain(row):
        chosen = []
        for f in sorted(row, key=lambda f: (-PRIORITY.get(f[0], 0), f[1] - f[2], -f[3], f[1], f[2], f[0], f[4])):
            if all(f[2] <= c[1] or c[2] <= f[1] for c in chosen):
                chosen.append(f)
        return sorted(chosen, key=lambda f: (f[1], f[2], f[0], f[4], -f[3]))

    df = spark.createDataFrame(rows, "f array<struct<entity:string,start:int,end:int,confidence:double,detector:string>>")
    got = [[tuple(x) for x in r.r] for r in df.select(resolve(F.col("f")).alias("r")).collect()]
    assert got == [plain(r[0]) for r in rows]


def test_pattern_spans_against_plain_code(spark):
    import random
    import re

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1яё日 ") for _ in range(rng.choice([0, 3, 40, 900]))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for pattern in ("[0-9]+", "a|бя", "яё?", "日+b*", "b(?=a)", "(?:a1|1)"):
        got = {(r.id, r.start, r.end) for r in Guard((d.regexp("own", "OWN", pattern),), key="k").findings_table(df, ["id"]).collect()}
        assert got == {(i, a, b) for i, t in enumerate(texts) for a, b in d.byte_offsets(t, [m.span() for m in re.finditer(pattern, t)])}


def test_hints_let_every_finding_through(spark):
    rows = ["+7 (912) 345-67-89 8 (495) 1234567 +1 (415) 555-0132", "8.495.123.45.67 89123456789", "4111 1111 1111 1111 4111-1111-1111-1111 5555555555554444", "7707083893 500100732259 7707083894", "112-233-445 95 11223344595 x11223344595", "яяя 4111111111111111.5", "паспорт 45 08 123456", "р/с 40702810900000000001", "родился 1 мая 1990"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")
    for detector in d.builtin():
        got = {(r.id, r.start, r.end) for r in Guard((detector,), key="k").findings_table(df, ["id"]).collect()}
        assert got == {(i, a, b) for i, t in enumerate(rows) for a, b in d.byte_offsets(t, detector.scan(t))}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert Guard.full(key="k").mask(df, "id").count() == 0


def test_stream(spark, tmp_path):
    from spanveil.streaming.pipelines import mask_stream

    spark.createDataFrame([(1, TEXT)], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    q = mask_stream(stream, Guard.full(key="k"), "id").writeStream.format("memory").queryName("masked_rows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert "a@b.co" not in spark.table("masked_rows").head().masked.text


def test_restored_and_counted_streams(spark, tmp_path):
    from spanveil.streaming.pipelines import restore_stream, windowed_findings

    guard = Guard((d.email(),), key="k")
    masked = guard.mask(spark.createDataFrame([(1, "mail a@b.co"), (2, "c@d.co")], "id long, text string"), "id")
    tokens = masked.select("id", F.col("masked.tokens").alias("tokens")).persist()
    masked.select("id", F.col("masked.text").alias("response")).unionByName(spark.createDataFrame([(3, "x")], "id long, response string")).write.parquet(str(tmp_path / "in"))

    def rows(frame, name, mode):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    stream = spark.readStream.schema("id long, response string").parquet(str(tmp_path / "in"))
    back = {r.id: (r.restored.text, r.restored.status) for r in rows(restore_stream(stream, tokens, "id", "response"), "restored_rows", "append")}
    assert back == {1: ("mail a@b.co", "success"), 2: ("c@d.co", "success"), 3: (None, "invalid_token_set")}
    spark.sql("select timestamp '2024-01-01 00:10:00' as ts, 'a@b.co c@d.co' as text union all select timestamp '2024-01-01 01:10:00', 'none'").write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "ev"))
    counted = rows(windowed_findings(guard.findings_table(events, ["ts"])), "counted_rows", "update")
    assert [(r.entity, r.findings) for r in counted] == [("EMAIL", 2)]


def test_errors_name_no_text(spark):
    def scan(text):
        raise ValueError(text)

    row = Guard((d.function("own", "OWN", scan),), key="k").detect(spark.createDataFrame([("secret words",)], "text string")).head()
    assert "secret words" not in str(row.detected) and row.detected.error_detector == "own"
    with pytest.raises(ConfigError) as e:
        d.regexp("own", "OWN", "secret(")
    assert "secret" not in str(e.value)
    masked = Guard.full(key="k").mask(spark.createDataFrame([(1, "ghp_" + "A" * 36)], "id long, text string"), "id").head().masked
    assert "AAAA" not in str(masked) and masked.status == "blocked"
