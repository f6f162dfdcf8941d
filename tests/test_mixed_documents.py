"""Documents whose sections have content of different shapes, in one table."""

import json

from lectern.operators import retrieval
from lectern.sources import documents


def said(content):
    """The reference's rule, in plain Python; objects as JSON with keys by name and no spaces."""
    dumped = lambda x: json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    if content is None:
        return ""
    if isinstance(content, list):
        return "".join(x if isinstance(x, str) else f"${x.get('content') or ''}$" if isinstance(x, dict) and x.get("type") == "inline_math" else dumped(x) for x in content)
    return content if isinstance(content, str) else dumped(content)


CONTENTS = ["plain", "", None, [], ["a ", {"type": "inline_math", "content": "x^2"}, " b"], [{"type": "inline_math"}, {"type": "cite", "key": "k", "n": [1, {"z": None}]}, 3, True, None, ["in"]], {"b": 1, "a": "ü\n"}, 12, 1.5, False]


def test_shapes(spark, tmp_path):
    body = {"document": {"title": "T", "metadata": {"authors": [{"name": "Ann", "affiliations": ["U", 3, "V"]}, "no object"], "affiliations": [{"id": 1, "details": "d"}]}, "content": [{"section": f"S{k}", "content": c, "references": [{"label": "r"}, {}], "figure_caption": 7} for k, c in enumerate(CONTENTS)]}}
    rows = [("mixed", json.dumps(body)), ("none", "{}"), ("bad", "{not json"), ("null", None), ("odd", json.dumps({"document": {"content": "no list", "title": 3}})), ("absent", json.dumps({"document": {"content": [{}]}}))]
    table = documents.from_json_text(spark.createDataFrame(rows, "source_file string, json string"))
    got = {r["source_file"]: r["document"] for r in table.collect()}
    assert [got[k] for k in ("none", "bad", "null")] == [None] * 3 and got["odd"]["title"] is None and got["odd"]["content"] is None
    assert [s["content"] for s in got["mixed"]["content"]] == [said(c) for c in CONTENTS]
    assert got["absent"]["content"][0]["content"] == ""
    author = got["mixed"]["metadata"]["authors"]
    assert author[0]["affiliations"] == ["U", "V"] and author[1]["name"] is None
    flat = retrieval.flattened(table).where("source_file = 'mixed'").orderBy("place").collect()
    assert [r["content"] for r in flat] == [said(c).strip(" \t\n\x0b\x0c\r") for c in CONTENTS]
    assert flat[0]["authors"] == ["Ann", ""] and flat[0]["references"] == ["r", ""] and flat[0]["figure_caption"] == ""
    for name, text in rows[:1]:
        (tmp_path / f"{name}.json").write_text(text)
    assert documents.mixed_documents(spark, str(tmp_path)).first()["document"] == got["mixed"]
