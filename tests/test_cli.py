import json

import pytest

from ledgerline import __main__ as entry
from ledgerline import cli

DOC = "Item 2.1. The council approved the plan (11-0). Mayor Mahan spoke. The cost is $1,000,000 in all."
GRID = '<table id="x_gridCalendar_ctl00"><tr><th class="rgHeader">Name</th><th class="rgHeader">Meeting Date</th></tr><tr><td>Council</td><td>1/9/2026</td></tr></table>'


@pytest.fixture
def base(spark, tmp_path):
    meetings = [("m1", "San Jose", "City Council", "1/9/2026", "", "http://a/agenda.pdf")]
    spark.createDataFrame(meetings, "meeting_id string, jurisdiction string, body string, date string, minutes_url string, agenda_url string").write.parquet(str(tmp_path / "meetings"))
    put = lambda name, rows: (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    put("entries", [{"meeting_id": "m1", "index": 0, "title": "Consent Plan", "item_number": "2.1"}, {"meeting_id": "m1", "index": 1, "title": None, "item_number": "2.2"}])
    put("documents", [{"url": "http://a/agenda.pdf", "text": DOC, "ocr_required": False}])
    put("gold", [{"case_id": "m1-0", "field_type": "amounts", "idx": 0, "value": json.dumps({"raw_text": "$1,000,000", "amount_usd": "1000000"}), "annotated_fields": ["amounts", "people"]}])
    return tmp_path


def test_stages_over_a_base_folder(spark, base, capsys):
    call = lambda *args: cli.main([args[0], "--base", str(base), *args[1:]], spark)
    assert call("eval") == 2 and call("review") == 2 and "extract has not run" in capsys.readouterr().err
    assert call("extract") == 0 and capsys.readouterr().out == "1 items, 2 facts published, 1 to review\n"
    assert call("digest") == 0 and "Consent Calendar" in capsys.readouterr().out
    high = call("check")
    findings = cli.Base(spark, str(base)).latest("findings")
    assert high == int(findings.where("severity = 'high'").count() > 0)
    assert call("review", "--accept", "m1-0-people-0") == 0 and "1 accepted" in capsys.readouterr().out
    assert call("extract") == 0 and "0 to review" in capsys.readouterr().out  # what was decided stays decided
    assert call("eval", "--promote") == 0 and "amounts" in capsys.readouterr().out
    gold = json.loads((base / "gold.json").read_text())
    gold[0]["value"] = json.dumps({"raw_text": "$5", "amount_usd": "5"})
    (base / "gold.json").write_text(json.dumps(gold))
    assert call("eval") == 1 and "amounts fell" in capsys.readouterr().out
    assert call("metrics", "--run-id", "r1") == 0 and "# Run health: San Jose" in capsys.readouterr().out
    assert call("run", "--run-id", "r2", "--at", "2026-01-10T00:00:00Z") == high
    assert cli.Base(spark, str(base)).latest("run_metrics").count() == 2 and call("metrics", "--run-id", "r2") == 0 and cli.Base(spark, str(base)).latest("run_metrics").count() == 2


def test_ingest_stage(spark, base, capsys):
    (base / "cities.yaml").write_text("- {name: SJ, homepage: 'http://s', platform: legistar, connector: legistar, legistar_url: 'https://s.legistar.com/Calendar.aspx'}\n- {name: Odd, homepage: 'http://o', platform: x, connector: gopher, legistar_url: 'https://o'}\n- {name: None yet, homepage: 'http://n', platform: x}\n")
    spark.createDataFrame([(1, "SJ", GRID), (2, "Odd", GRID), (3, "None yet", GRID)], "page_id long, source string, html string").write.parquet(str(base / "pages"))
    assert cli.main(["ingest", "--base", str(base)], spark) == 1
    out = capsys.readouterr().out
    assert "SJ: ok, 1 meetings on 1 pages" in out and "Odd: error" in out and "None yet" not in out
    kept = cli.Base(spark, str(base))
    assert kept.latest("ingested").first().date == "1/9/2026" and kept.latest("ingest_errors").first().error == "ValueError: no connector named 'gopher'"
    assert cli.main(["ingest", "--base", str(base), "--connector", "legistar"], spark) == 0


def test_base_folder_and_unknown_names(monkeypatch, tmp_path, capsys):
    monkeypatch.delenv("LEDGERLINE_BASE", raising=False)
    monkeypatch.chdir(tmp_path)
    assert cli.base_path() == str(tmp_path) and cli.base_path("hdfs://n/x/") == "hdfs://n/x" and cli.base_path("sub") == str(tmp_path / "sub")
    monkeypatch.setenv("LEDGERLINE_BASE", "/data/base")
    assert cli.base_path() == "/data/base" and cli.base_path("/given") == "/given"
    assert entry.main(["nothing", "here"]) == 2 and entry.main([]) == 0 and "stages: ingest" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["unknown"])
