"""Four documents about the refit of a ferry, from files to statuses."""

import json

from factloom.operators import events
from factloom.plans import build
from factloom.sources import bundles, sinks


def write(folder, name, text, facts, deps=(), **more):
    full = [{"role": "CONTAINS", "timex_type": "DATE"} | f for f in facts]
    (folder / f"{name}.json").write_text(json.dumps({"schema_version": "1.0", "document_id": name, "matter": "ferry", "source_text": text, "facts": full, "dependencies": list(deps)} | more))


def bundle_files(folder):
    write(folder, "log", "The Marigold entered the dry dock on 3 March 2021. Her hull survey took place on 9 March 2021.", [
        {"id": "d1", "entity": "dry dock entry", "value": "2021-03-03", "sentence": "The Marigold entered the dry dock on 3 March 2021."},
        {"id": "d2", "entity": "hull survey", "value": "2021-03-09", "sentence": "Her hull survey took place on 9 March 2021."},
    ])
    invoice = "The Marigold entered the dry dock on 4 March 2021. The hull survey took place on 9 March 2021. Payment falls due 45 days after the invoice of 1 April 2021."
    write(folder, "invoice", invoice, [
        {"id": "d1", "entity": "dry dock entry", "value": "2021-03-04", "sentence": "The Marigold entered the dry dock on 4 March 2021."},
        {"id": "d2", "entity": "hull survey", "value": "2021-03-09", "sentence": "The hull survey took place on 9 March 2021."},
        {"id": "d3", "entity": "invoice", "role": "START", "value": "2021-04-01", "sentence": "the invoice of 1 April 2021"},
        {"id": "d4", "entity": "payment", "role": "END", "sentence": "Payment falls due 45 days after the invoice"},
        {"id": "d5", "entity": "colour of the funnel", "role": "UNKNOWN", "sentence": "red with a white band", "temporal_content": False},
    ], [{"from_id": "d3", "to_id": "d4", "constraint_type": "additive", "constraint_expr": "45 days"}])
    write(folder, "other", "The Heron's dry dock entry was on 3 March 2021.", [{"id": "d1", "entity": "dry dock entry", "value": "2021-03-03", "sentence": "The Heron's dry dock entry was on 3 March 2021."}], matter="heron")


def statuses(chron):
    return {tuple(f"{s['doc_id']}:{s['fact_id']}" for s in r["sources"]): r for r in chron.events.collect()}


def test_build(spark, tmp_path):
    bundle_files(tmp_path)
    chron = build.build_chronology(bundles.read_graphs(spark, str(tmp_path)))
    found = statuses(chron)
    assert {k: r["status"] for k, r in found.items()} == {
        ("invoice:d1", "log:d1"): "disputed", ("invoice:d2", "log:d2"): "agreed", ("invoice:d3",): "single_source", ("invoice:d4",): "derived", ("invoice:d5",): "unplaced", ("other:d1",): "single_source",
    }
    derived = found[("invoice:d4",)]
    assert str(derived["date"]) == "2021-05-16" and "45 days" in derived["derivation"]
    assert events.run_counts(chron.events).first().asDict() == {"events": 5, "disputed": 1, "unplaced": 1}
    rows = sinks.export_rows(events.chronology(chron.events)).collect()
    assert rows[0]["Event"] == "dry dock entry" and "2021-03-04 (invoice)" in " ".join(r["Disputed values"] for r in rows)


def test_silent_documents_link_freely(spark, tmp_path):
    for name, said in (("a", "The bridge opened on 2 May 1999."), ("b", "On 2 May 1999 the bridge opened.")):
        write(tmp_path, name, said, [{"id": "x", "entity": "bridge opening", "value": "1999-05-02", "sentence": said}], matter=None)
    found = statuses(build.build_chronology(bundles.read_graphs(spark, str(tmp_path))))
    assert {k: r["status"] for k, r in found.items()} == {("a:x", "b:x"): "agreed"}


def test_commands(spark, tmp_path, capsys):
    bundle_files(tmp_path)
    assert build.main(["whatif", str(tmp_path), "--fact", "invoice:d3", "--date", "2021-05-01"]) == 0
    assert "datetime.date(2021, 6, 15)" in capsys.readouterr().out
    assert build.main(["validate", str(tmp_path)]) == 0
    assert build.main(["whatif", str(tmp_path), "--fact", "x:y", "--date", "2021-05-01"]) == 1
    assert "there are" in capsys.readouterr().err
