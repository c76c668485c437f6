"""Reports on disk, and pages without the lines that repeat on them."""

import json

from spindrift.operators import repair
from spindrift.sources import files


def test_a_report_is_written_without_raw_scores(spark, tmp_path):
    rows = spark.createDataFrame([("recall", 0.5, [0.4, 0.6]), ("precision", None, [])], "metric string, mean double, raw_scores array<double>")
    text = files.write_report(rows, str(tmp_path / "r"), "Run 1")
    assert text.splitlines() == ["# Run 1", "", "| metric | mean |", "|---|---|", "| recall | 0.5 |", "| precision |  |"]
    found = [json.loads(line) for f in (tmp_path / "r").glob("*.json") for line in f.read_text().splitlines()]
    assert sorted(x["metric"] for x in found) == ["precision", "recall"] and not any("raw_scores" in x for x in found)


def test_headers_that_repeat_go_from_all_pages(spark):
    body = [f"The {n} page has a body of its own, which is long enough not to be a header." for n in ("first", "second", "third")]
    rows = [("a.pdf", f"Course notes\n\n{t}\n\nCopyright us") for t in body] + [("b.pdf", "Course notes\n\nOnly page.")]
    out = [r["text"] for r in repair.repair_pages(spark.createDataFrame(rows, "source string, text string")).collect()]
    assert sum("Course notes" in t for t in out) == 1 and not any("Copyright" in t for t in out)
    assert all(any(t in x for x in out) for t in body)
