import csv
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from spanveil.operators.errors import SuiteError
from spanveil.plans.dataset_cli import main
from spanveil.plans.mapping import Mapping
from spanveil.sources import datasets, suites

DIRECT = {"schema_version": 1, "version": "m1", "direct": {"Org": "URL"}, "person": {"components": ["FIRST_NAME", "LAST_NAME", "MIDDLE_NAME"], "min_components": 2}}


def manifest(tmp_path, source, digest):
    path = tmp_path / f"{source}.json"
    spec = {"schema_version": 1, "id": source, "canonical_url": "https://example.com/d/", "revision": "r1", "digest_sha256": digest, "license": "MIT", "attribution": "x", "distribution": "cache-only", "adapter_version": "1"}
    path.write_text(json.dumps(spec))
    return str(path), spec


def mapping_file(tmp_path, source):
    path = tmp_path / f"{source}-map.json"
    path.write_text(json.dumps(DIRECT | {"source_id": source}))
    return str(path)


def test_tagged_table_from_download_to_suite(spark, tmp_path):
    raw = io.StringIO()
    out = csv.writer(raw)
    out.writerow(["text", "tokens", "ner_tags"])
    out.writerow(["Анна Ли", json.dumps(["Анна", "Ли"]), json.dumps(["B-FIRST_NAME", "B-LAST_NAME"])])
    out.writerow(["x", json.dumps(["y"]), json.dumps(["O"])])
    content = raw.getvalue().encode()
    _, spec = manifest(tmp_path, datasets.TAGGED, hashlib.sha256(content).hexdigest())
    asked = []

    def opener(url, timeout):
        asked.append((url, timeout))
        return io.BytesIO(content)

    cache = str(tmp_path / "cache")
    with pytest.raises(SuiteError):
        datasets.fetch(spec | {"digest_sha256": "0" * 64}, cache, opener)
    assert not list(datasets.source_folder(cache, datasets.TAGGED).iterdir())
    datasets.fetch(spec, cache, opener)
    assert asked[-1] == ("https://example.com/d/resolve/r1/test.csv", 30)
    assert main(["--action", "normalize", "--manifest", str(tmp_path / f"{datasets.TAGGED}.json"), "--mapping", mapping_file(tmp_path, datasets.TAGGED), "--cache", cache], spark) == 0
    rows = suites.load_suite(spark, datasets.normalized_path(cache, datasets.TAGGED)).orderBy("source_record_id").collect()
    assert {(a.mapped_entity, a.start, a.end) for a in rows[0].annotations if a.disposition == "supported"} == {("PERSON", 0, 13)}
    assert [a.disposition for a in rows[1].annotations] == ["ignored"] and rows[0].suite_id == f"{datasets.TAGGED}-normalized"


def test_documents(spark, tmp_path):
    cache = tmp_path / "cache"
    root = cache / "sources" / datasets.DOCUMENTS
    for split in datasets.SPLITS:
        (root / split).mkdir(parents=True)
    (root / "devset" / "a.txt").write_text("Анна Ли, «Ромашка»")
    (root / "devset" / "a.spans").write_text("1 name 0 4 x\n2 surname 5 2 x\n3 org_name 10 7 x\n4 job 0 1 x\n")
    (root / "devset" / "a.objects").write_text("10 Person 1 2 9 4 # Анна\n11 Org 3\n12 Other 1\n")
    (root / "testset" / "list.txt").write_text("a")
    path, spec = manifest(tmp_path, datasets.DOCUMENTS, "0" * 64)
    args = ["--action", "fetch", "--manifest", path, "--cache", str(cache)]
    assert main(args, spark) == 1
    manifest(tmp_path, datasets.DOCUMENTS, datasets.digest_of(spec, str(cache)))
    assert main(args, spark) == 0
    assert main([*args[:1], "normalize", *args[2:], "--mapping", mapping_file(tmp_path, datasets.DOCUMENTS)], spark) == 0
    row = suites.load_suite(spark, datasets.normalized_path(str(cache), datasets.DOCUMENTS)).collect()
    assert [r.source_record_id for r in row] == ["devset/a"]
    notes = [(a.source_label, a.mapped_entity, a.start, a.end, a.disposition) for a in row[0].annotations]
    assert ("PERSON", "PERSON", 0, 13, "supported") in notes and ("Org", "URL", 17, 31, "supported") in notes and len(notes) == 4


def test_reviewed_files(spark, tmp_path):
    root = tmp_path / "cache" / "sources" / datasets.REVIEWED
    root.mkdir(parents=True)
    for name, kind in datasets.REVIEWED_FILES:
        text = f"ключ {datasets.ACCESS_KEY} x" if kind == "access_key" else f"é {datasets.KEY_BEGIN}\nAA\n{datasets.KEY_END} z" if kind else "nothing"
        (root / name.rsplit("/", 1)[-1]).write_text(text)
    rows = {r.record: r for r in datasets.reviewed_rows(spark, str(root)).collect()}
    assert len(rows) == 6 and not rows["main.go"].annotations
    for name, (label, kind) in {"ignoreCommit.go": ("AWS_ACCESS_KEY", "supported"), "privatekey.go": ("SECRET_PRIVATE_KEY", "unsupported")}.items():
        a = rows[name].annotations[0]
        own = rows[name].text.encode()[a.start : a.end].decode()
        assert (a.source_label, a.disposition) == (label, kind) and own.startswith(datasets.ACCESS_KEY if kind == "supported" else datasets.KEY_BEGIN) and own.endswith(datasets.ACCESS_KEY if kind == "supported" else datasets.KEY_END)
    (root / "privatekey.go").write_text(datasets.KEY_BEGIN + " cut")
    assert datasets.reviewed_rows(spark, str(root)).where("record = 'privatekey.go'").head().annotations[0].reason == "fixture_truncated_key"
    _, spec = manifest(tmp_path, datasets.REVIEWED, "x")
    spec["digest_sha256"] = datasets.digest_of(spec, str(tmp_path / "cache"))
    out = datasets.normalize(spark, spec, Mapping.of(DIRECT | {"source_id": datasets.REVIEWED}), str(tmp_path / "cache"))
    assert suites.load_suite(spark, out).where(F.size("annotations") > 0).count() == 3


def test_bad_use(spark, tmp_path):
    path, _ = manifest(tmp_path, "other", "0" * 64)
    assert main([], spark) == 2 and main(["--action", "normalize", "--manifest", path, "--cache", "c"], spark) == 2
    assert main(["--action", "fetch", "--manifest", path, "--cache", str(tmp_path)], spark) == 1
    assert main(["--action", "fetch", "--manifest", "missing", "--cache", str(tmp_path)], spark) == 1
