"""Round trips write and read whole tables."""

from gridlark import ingest_queries

DIR = "/root/testdata/sf0.001"


def test_json_facts_exports_every_event(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest_queries, "shared_folder", lambda _: str(tmp_path / "facts"))
    ingest_queries.json_facts_roundtrip(spark, DIR)
    events = spark.read.parquet(f"{DIR}/events.parquet")
    ids = lambda df: sorted(r["event_id"] for r in df.select("event_id").collect())
    assert ids(spark.read.json(str(tmp_path / "facts"))) == ids(events)
