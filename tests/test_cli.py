import json

from docspark.__main__ import main
from tests.test_render import adf, node, p


def test_commands(spark, tmp_path, capsys):
    put = lambda name, s: (tmp_path / name).write_text(s) and str(tmp_path / name)
    good, lossy, bad = put("a.json", adf(node("heading", {"type": "text", "text": "H"}), p("x"))), put("b.json", adf(node("zap"))), put("c.json", "{}")
    assert main(["convert", good, "--title", "T"]) == 0 and capsys.readouterr().out == "# T\n\n# H\n\nx\n"
    assert main(["convert", lossy, "--fail-on-lossy"]) == 4
    assert main(["convert", lossy, "--unknown-nodes", "fail"]) == 70
    assert main(["convert", lossy, "--page-map", put("m.json", "[1]")]) == 2
    assert main(["convert", bad]) == 0
    capsys.readouterr()
    assert main(["validate", bad]) == 3 and "INVALID_ROOT_NODE" in capsys.readouterr().out
    assert main(["analyze", good, "--select", "outline"]) == 0 and json.loads(capsys.readouterr().out)["outline"][0]["anchor"] == "h"
    assert main(["analyze", good, "--select", "odd"]) == 2 and main(["odd"]) == 2
    assert main(["convert", str(tmp_path / "none.json")]) == 1
    capsys.readouterr()
    assert main(["analyze", good, "--format", "text", "--select", "outline,pageRefs"]) == 0 and capsys.readouterr().out == "outline:\n  H1 H (#h)\npageRefs (0): none\n"
    assert main(["analyze", good, "--select", "referencedFileIds"]) == 0 and json.loads(capsys.readouterr().out) == {"referencedFileIds": []}
    assert main(["convert", good, "--json"]) == 0 and list(json.loads(capsys.readouterr().out)) == ["body", "wasLossy", "diagnostics", "metadata", "unresolved"]
    assert main(["validate", bad, "--json"]) == 3 and json.loads(capsys.readouterr().out)["validAdfRoot"] is False
