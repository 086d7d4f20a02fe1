import io
import json

import pytest
from pyspark.sql import functions as F

from spanveil.functions import intervals as iv
from spanveil.operators.errors import SuiteError
from spanveil.operators.guard import Guard
from spanveil.plans import evaluation as ev
from spanveil.plans import gates, mapping, reports
from spanveil.plans.cli import main
from spanveil.sources import generator, suites


def test_interval_algebra_against_sets(spark):
    import random

    rng = random.Random(5)
    rows = [tuple([(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 30) for _ in range(rng.randint(0, 6)))] for _ in "ab") for _ in range(60)]
    df = spark.createDataFrame(rows, f"a {iv.KIND}, b {iv.KIND}").withColumns({"a": iv.merge(F.col("a")), "b": iv.merge(F.col("b"))})
    bytes_of = lambda spans: {x for s, e in spans for x in range(s, e)}
    for (a, b), r in zip(rows, df.select("a", iv.union_bytes(F.col("a")).alias("n"), iv.intersection(F.col("a"), F.col("b")).alias("i"), iv.difference(F.col("a"), F.col("b")).alias("d")).collect(), strict=True):
        assert bytes_of(r.a) == bytes_of(a) and r.n == len(bytes_of(a))
        assert all(x.end < y.start for x, y in zip(r.a, r.a[1:], strict=False))
        assert bytes_of(r.i) == bytes_of(a) & bytes_of(b) and bytes_of(r.d) == bytes_of(a) - bytes_of(b)


def record(i, text, notes, **more):
    import hashlib

    kinds = ("source_label", "mapped_entity", "start", "end", "disposition", "reason")
    return {"schema_version": 2, "suite_id": "s", "source_id": f"src{i % 2}", "source_record_id": str(i), "mapping_version": "1", "input": text, "input_sha256": hashlib.sha256(text.encode()).hexdigest(), "annotations": [dict(zip(kinds, n, strict=True)) for n in notes]} | more


@pytest.fixture
def suite_file(tmp_path):
    rows = [
        record(1, "mail a@b.co", [("MAIL", "EMAIL", 5, 11, "supported", "")]),
        record(2, "карта 4111111111111111", [("CARD", "BANK_CARD", 11, 27, "supported", "")], lifecycle={"expected_action": "mask", "response_recipe": "mutate_placeholder"}),
        record(3, "key ghp_" + "A" * 36, [("KEY", "SECRET_API_KEY", 4, 44, "supported", "")]),
        record(4, "nothing here", [("NAME", "PERSON", 0, 7, "supported", "")]),
        record(5, "x y", [("OTHER", "", 0, 1, "ignored", "gap")]),
    ]
    path = tmp_path / "suite.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n")
    return str(path)


def test_suite_profiles(spark, suite_file):
    for profile, code in (("contract", 0), ("exposure", 0), ("lifecycle", 0)):
        out = io.StringIO()
        assert main([suite_file, "--profile", profile, "--format", "json"], spark, out) == code
        found = json.loads(out.getvalue())
        if profile == "contract":
            assert found["summary"] == {"tp": 3, "fp": 0, "fn": 1} and found["status"] == "fail" and found["source_ids"] == ["src0", "src1"]
            assert [(r["source_id"], r["tp"], r["fn"]) for r in found["by_source"]] == [("src0", 1, 1), ("src1", 2, 0)]
            assert [(r["entity"], r["negative_cases"], r["false_positive_cases"], r["fnr"]) for r in found["entities"] if r["entity"] == "PERSON"] == [("PERSON", 4, 0, 1.0)]
            failure = found["diagnostics"]["failures"][0]
            assert (failure["source_record_id"], failure["source_label"], failure["kind"], failure["gold_start"], failure["gold_end"]) == ("4", "NAME", "fn", 0, 7) and "predicted_start" not in failure
        if profile == "exposure":
            assert (found["summary"]["sensitive_bytes"], found["summary"]["leaked_sensitive_bytes"]) == (69, 7)
            labels = {r["source_label"]: r for r in found["by_label"]}
            assert (labels["MAIL"]["fully_covered_span_count"], labels["NAME"]["fully_covered_span_count"]) == (1, 0)
            assert found["ignored"] == [{"source_label": "OTHER", "reason": "gap", "count": 1}]
        if profile == "lifecycle":
            assert (found["ok"], found["mutation_miss"], found["blocked"], found["errors"]) == (1, 1, 1, 1)
            assert [(r["source_record_id"], r["outcome"]) for r in found["diagnostics"]] == [("4", "error")]
        out = io.StringIO()
        assert main([suite_file, "--profile", profile, "--fail-on-regression"], spark, out) == int(profile != "exposure")
        assert out.getvalue().startswith(f"# {profile} evaluation report") and "a@b.co" not in out.getvalue()


def test_gate_and_bad_use(spark, suite_file, tmp_path):
    limits = tmp_path / "t.json"
    limits.write_text(json.dumps({"schema_version": 1, "id": "g", "profiles": {"exposure": {"status": "gate", "max_leaked_sensitive_bytes": 0}}}))
    assert main([suite_file, "--profile", "exposure", "--thresholds", str(limits)], spark, io.StringIO()) == 1
    assert main([suite_file, "--profile", "what"], spark, io.StringIO()) == 2
    assert main([suite_file], spark, io.StringIO()) == 2  # a second-version file isn't a first-version one


def test_lines_with_more_than_one_object(spark):
    good = json.dumps(record(1, 'm "}{" [\\', []), ensure_ascii=False)
    lines = [good, good + " ", good + '{"x":1}', good + " {}", good + "}", good + ' "s"', good + " 5", "[" + good + "]", '"s"' + good, good[:-1], good + "{", "{}" + good]
    rows = suites.suite_rows(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r.error is None for r in rows] == [True, True] + [False] * 10
    long = json.dumps(record(1, "x" * (1 << 20), []))
    assert suites.suite_rows(spark.createDataFrame([(long,)], "line string")).head().error == "line is too long"


def test_scope_of_each_record(spark, tmp_path):
    rows = [record(1, "a@b.co and 4111111111111111", [("M", "EMAIL", 0, 6, "supported", "")], declared_entities=["EMAIL"]), record(2, "4111111111111111", [], declared_entities=["BANK_CARD"]), record(3, "+7 (912) 345-67-89 c@d.co", [])]
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    suite = suites.load_suite(spark, str(path))
    assert {(r.record, r.entity) for r in ev.record_scopes(suite).collect()} == {("1", "EMAIL"), ("2", "BANK_CARD"), ("3", "EMAIL"), ("3", "BANK_CARD")}
    found = {r["entity"]: r for r in reports.contract_report(suite, Guard.full(key="k"))["entities"]}
    assert (found["EMAIL"]["tp"], found["EMAIL"]["fp"], found["EMAIL"]["negative_cases"], found["EMAIL"]["false_positive_cases"]) == (1, 1, 1, 1)
    assert (found["BANK_CARD"]["fp"], found["BANK_CARD"]["negative_cases"]) == (1, 2) and "PHONE" not in found


def test_generated_suite(spark):
    rows = generator.smoke_rows()
    assert len(rows) == 29 and rows == generator.smoke_rows() and rows != generator.smoke_rows(1)
    suite = generator.smoke_suite(spark)
    contract = reports.contract_report(suite, Guard.full(key="k"))
    assert contract["summary"] == {"tp": 22, "fp": 0, "fn": 0} and contract["status"] == "pass"
    cycle = reports.lifecycle_report(suite, Guard.full(key="k"))
    assert (cycle["ok"], cycle["blocked"], cycle["mutation_miss"], cycle["restore_miss"], cycle["errors"]) == (15, 4, 3, 0, 0)


def test_placeholders_are_read_off_the_masked_text(spark):
    from spanveil.operators.masking import placeholder_map

    guard = Guard.full(key="k")
    masked = guard.mask(spark.createDataFrame([(1, "я a@b.co {{LLMG_x c@d.co"), (2, "none")], "id long, text string"), "id")
    held = masked.select("id", "masked.tokens", placeholder_map(F.col("text"), F.col("masked.text"), F.col("masked.findings")).alias("pairs"), placeholder_map(F.col("text"), F.concat(F.col("masked.text"), F.lit("!")), F.col("masked.findings")).alias("off"))
    for r in held.collect():
        assert r.pairs == r.tokens and r.off is None


@pytest.mark.parametrize("change", [{"schema_version": 3}, {"input_sha256": "0" * 64}, {"more": 1}, {"source_id": " "}, {"annotations": [{"source_label": "A", "mapped_entity": "EMAIL", "start": 0, "end": 99, "disposition": "supported", "reason": ""}]}])
def test_strict_rows(spark, tmp_path, change):
    path = tmp_path / "s.jsonl"
    path.write_text(json.dumps(record(1, "mail", []) | change))
    with pytest.raises(SuiteError):
        suites.load_suite(spark, str(path))


def test_empty_and_duplicate_suites(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text("\n")
    with pytest.raises(SuiteError):
        suites.load_suite(spark, str(path))
    path.write_text("\n".join(json.dumps(record(1, "mail", [])) for _ in "ab"))
    with pytest.raises(SuiteError):
        suites.load_suite(spark, str(path))


def test_mapping_runs():
    own = mapping.Mapping("1", "s", {"MAIL": "EMAIL"}, ("FIRST_NAME", "LAST_NAME", "MIDDLE_NAME"), 2, ("STREET", "HOUSE"))
    raw = "Anna Smith x Elm St, 5 a@b.co".encode()
    got = mapping.apply(own, raw, [("B-FIRST_NAME", 0, 4), ("I-LAST_NAME", 5, 10), ("STREET", 13, 19), ("HOUSE", 21, 22), ("MAIL", 23, 29), ("ODD", 11, 12)])
    assert [(g[1], g[2], g[3]) for g in got if g[4] == "supported"] == [("PERSON", 0, 10), ("ADDRESS", 13, 22), ("EMAIL", 23, 29)]
    assert [g[0] for g in got if g[4] == "unsupported"] == ["B-FIRST_NAME", "I-LAST_NAME", "ODD", "STREET", "HOUSE"]
    alone = mapping.apply(own, raw, [("FIRST_NAME", 0, 4), ("LAST_NAME", 13, 16)])
    assert not [g for g in alone if g[4] == "supported"]
    with pytest.raises(SuiteError):
        mapping.Mapping.of({"schema_version": 1, "version": "1", "source_id": "s", "direct": {"A": "NOPE"}})


def test_token_tags_to_suite(spark, tmp_path):
    import csv

    with (tmp_path / "t.csv").open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["text", "tokens", "ner_tags"])
        out.writerow(["Анна  Ли, 5", json.dumps(["Анна", "Ли", ",", "5"]), json.dumps(["B-FIRST_NAME", "B-LAST_NAME", "O", "I-N"])])
        out.writerow(["x", json.dumps(["y"]), json.dumps(["O"])])
    rows = suites.token_tag_spans(suites.read_token_tags(spark, str(tmp_path / "t.csv"))).orderBy("record").collect()
    assert [(s.label, s.start, s.end) for s in rows[0].spans] == [("FIRST_NAME", 0, 8), ("LAST_NAME", 10, 14), ("N", 16, 17)]
    assert [r.aligned for r in rows] == [True, False]


def test_standoff(spark, tmp_path):
    root = tmp_path / "devset"
    root.mkdir()
    (root / "a.txt").write_text("Анна Ли жила")
    (root / "a.spans").write_text("1 name 0 4 x\n2 surname 5 2 x\nbroken\n")
    (root / "a.objects").write_text("10 Person 1 2 9 # Анна\n")
    docs = suites.read_standoff(spark, str(tmp_path))
    held = suites.object_spans(docs).head()
    assert held.kind == "Person" and [(s.start, s.end) for s in held.spans] == [(0, 8), (9, 13)]
    assert len(suites.tree_digest(spark, str(tmp_path))) == 64


def test_thresholds_and_manifest():
    with pytest.raises(SuiteError):
        gates.Thresholds.of('{"schema_version": 1, "id": "x", "profiles": {"lifecycle": {"status": "gate", "entities": {}}}}')
    with pytest.raises(SuiteError):
        gates.manifest('{"schema_version": 1} ')
    limits = gates.Thresholds.of('{"schema_version": 1, "id": "x", "profiles": {"contract": {"status": "gate", "entities": {"EMAIL": {"min_recall": 0.9}}}}}')
    assert gates.decide(limits, "contract", {"fn": 5}, {"EMAIL": {"recall": 0.95}}) == "pass"
    assert gates.decide(limits, "contract", {}, {"EMAIL": {"recall": 0.5}}) == "fail"
    assert gates.decide(None, "contract", {"fn": 5}) == "diagnostic"


def test_contract_counts_sets(spark):
    kind = "record string, entity string, start int, end int"
    gold = spark.createDataFrame([("1", "EMAIL", 0, 3), ("1", "EMAIL", 0, 3), ("2", "PHONE", 0, 3)], kind)
    found = spark.createDataFrame([("1", "EMAIL", 0, 3), ("2", "PHONE", 1, 3)], kind)
    rows = {r.entity: r for r in ev.contract(gold, found).collect()}
    assert (rows["EMAIL"].tp, rows["PHONE"].fp, rows["PHONE"].fn, rows[None].tp) == (1, 1, 1, 1)
    assert ev.overlapping_pairs(gold, found).count() == 1
    assert [r.kind for r in ev.diagnostics(gold, found).collect()] == ["fn", "fp"]


def test_random_round_trips(spark):
    import random

    rng = random.Random(3)
    bits = ["a@b.co", "Иван Петров", "4111 1111 1111 1111", "ул. Ленина, 10", "\n", " и ", "«", "x", "{{LLMG_", "+7 (912) 345-67-89", "日本", "https://a.example.com/x"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    from spanveil.operators.guard import restore

    masked = Guard.full(key="k").mask(spark.createDataFrame(rows, "id long, text string"), "id")
    back = restore(masked.select("id", "text", F.col("masked.text").alias("r"), F.col("masked.tokens").alias("t")), "r", "t")
    assert all(r.restored.text == r.text for r in back.collect())
