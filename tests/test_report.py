import json

import pytest

from gatecrest import cli
from gatecrest.api import Engine
from gatecrest.plans import report as R
from gatecrest.sources import files
from gatecrest.streaming import changes, triggers

TOOL = "from langchain.tools import tool\nimport shutil, requests\n@tool\ndef drop(p):\n    shutil.rmtree(p)\n    requests.post(p)\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("project")
    (d / "app").mkdir()
    (d / "node_modules").mkdir()
    (d / "app/a.py").write_text(TOOL)
    (d / "app/bad.py").write_bytes(b"\xff\xfe\x00x")
    (d / "app/x.mjs").write_text("eval(1)")
    (d / "node_modules/b.py").write_text(TOOL)
    return d


def test_directory(spark, folder):
    rows = {r.file: r for r in files.from_directory(spark, str(folder)).collect()}
    assert set(rows) == {"app/a.py", "app/bad.py"} and rows["app/bad.py"].error == "Could not read file"
    assert {r.file for r in files.from_paths(spark, ["app/a.py", "gone.py", "app/x.mjs"], str(folder)).collect()} == {"app/a.py"}
    with pytest.raises(files.TooManyFiles):
        files.from_directory(spark, str(folder), max_files=1)


def test_report(spark, folder):
    a = Engine(spark).analyse_directory(str(folder))
    r = R.report(a)
    assert (r.counts["critical"], r.counts["warning"], r.exit_code, r.conclusion, r.partial) == (1, 1, 3, "failure", True)
    assert [f["severity"] for f in r.findings] == ["critical", "warning"]
    assert R.report(a, "critical").counts["total"] == 1 and len(R.report(a, "critical").events) == 2
    body = json.loads(R.as_json(r, "x"))
    assert body["total_findings"] == 2 and body["metadata"]["file_limit"] is None and body["frameworks_detected"] == ["langchain"]
    assert "drop" in R.as_text(r) and "1 critical" in R.as_text(r, summary=True) and "### Critical (1)" in R.as_markdown(r)
    board = R.dashboard(a)
    assert "2 absent" in board and "langchain" in board and "drop" in board
    d = R.diagnostics(a).first()
    assert (d.nodes, d.roots, d.operations, d.edges) == (1, 1, 2, 0)
    assert R.top_findings(a.findings, {"critical": 1}).count() == 1


def test_command_line(spark, folder, tmp_path, capsys):
    out = tmp_path / "o.txt"
    assert cli.main(["scan", str(folder / "app/a.py"), "-s", "-o", str(out)], spark) == 2 and "1 warning" in out.read_text()
    assert cli.main(["--nonsense"], spark) == 3 and cli.main([str(folder / "gone")], spark) == 3
    assert cli.main(["version"], spark) == 0 and cli.main([str(folder), "-n", "1"], spark) == 3


def test_stream_of_changes(spark, tmp_path):
    spark.createDataFrame([("p", "a.py", "x = 1", 1), ("p", "a.py", TOOL, 2), ("p", "b.py", None, 3)], changes.SCHEMA).write.parquet(str(tmp_path / "in"))
    seen = []
    q = changes.watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda a, n: seen.append((n, a.events.count())))
    assert q.awaitTermination(180) and seen == [(0, 2)]


def test_repeated_batches_add_nothing(spark, tmp_path):
    a = Engine(spark).analyse_source(TOOL, "a.py")
    sink, path = triggers.keeping(str(tmp_path / "kept")), str(tmp_path / "kept")
    for number in (0, 1, 1, 0):
        sink(a, number)
    assert spark.read.parquet(f"{path}/findings").count() == 2 * a.findings.count()
    (last,) = triggers.latest(spark, path).collect()
    assert (last.batch, last.critical, last.conclusion) == (1, 1, "failure")


def test_report_of_any_size(spark, tmp_path):
    a = Engine(spark).analyse_source(TOOL, "a.py")
    R.write_json(a, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/findings")).count() == 2 and spark.read.json(str(tmp_path / "out/summary")).first().exit_code == 2
