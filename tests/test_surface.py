"""The tool server, enrichment, the command line and the stream of files."""

import datetime
import io
import json

from quarrylake import __main__ as cli
from quarrylake.plans import corpus as C
from quarrylake.plans.serve import TOOLS, Server
from quarrylake.streaming import ingest


def test_server_and_enrichment(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text('"""A file."""\ndef alpha():\n    return 1\n')
    store = C.Store(spark, str(tmp_path / "home"))
    store.add(str(root), "one")
    server = Server(store)
    assert len(server.answer({"id": 1, "method": "tools/list"})["result"]["tools"]) == len(TOOLS) == 8
    assert server.answer({"method": "notifications/initialized"}) is None
    assert server.answer({"id": 2, "method": "odd"})["error"]["code"] == -32601
    call = lambda name, **args: server.answer({"id": 3, "method": "tools/call", "params": {"name": name, "arguments": args}})["result"]
    assert json.loads(call("read", corpus="one", target="alpha")["content"][0]["text"])["candidates"][0]["path"] == "a.py"
    assert json.loads(call("search", corpus="one", query="alpha", k=2)["content"][0]["text"])[0]["path"] == "a.py"
    assert call("read", corpus="none", target="x")["isError"] and call("odd")["isError"]
    out = io.StringIO()
    server.run(['[{"id": 1, "method": "ping"}, {"id": 2, "method": "initialize"}]', "", "{"], out)
    told = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in told[0]] == [1, 2] and told[1]["error"]["code"] == -32700
    assert "All of it." in store.enrich("one", lambda prompt: "All of it." if "alpha" in prompt else "", "own").map()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "b.go").write_text("package b\nfunc Beta() {\n}\n")
    home = ["--home", str(tmp_path / "home")]
    assert cli.main([*home, "add", str(tmp_path / "src"), "--name", "two"]) == 0
    capsys.readouterr()
    cli.main([*home, "neighbors", "two", "Beta"])
    assert json.loads(capsys.readouterr().out)["definitions"][0]["path"] == "b.go"


def test_stream(spark, tmp_path):
    now = datetime.datetime(2024, 1, 1, 12)
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "x\ny", now), ("b", "x\ny", now), ("c", None, now)], ingest.SCHEMA).write.parquet(source)
    run = lambda: ingest.chunk_stream(spark, source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("d", "x\ny", now), ("e", "z", now)], ingest.SCHEMA).write.mode("append").parquet(source)
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["text"] for r in rows) == ["x\ny", "z"]
