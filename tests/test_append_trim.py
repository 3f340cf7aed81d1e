"""Appending and trimming number the whole table."""

from tesserine.queries import registry

from .conftest import SMALL


def test_append_trim_numbers_every_event(spark):
    ids = sorted(r.event_id for r in spark.read.parquet(f"{SMALL}/events.parquet").select("event_id").collect())
    rows = registry.QUERIES["stream_append_trim_all"](spark, SMALL).collect()
    assert sorted((r.sequence, r.event_id) for r in rows) == list(enumerate(ids, 1))[5:]
