"""The total order over every event."""

from pyspark.sql import functions as F
from quillstone.queries import QUERIES, mixed_all, read


def test_every_event_and_type_has_a_place(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    got = QUERIES["fieldvalue_places"](spark, sf_dir).join(mixed_all(events), "event_id").collect()
    assert sorted(r.place for r in got) == list(range(events.count()))
    for t in ("bool", "int", "num", "str"):
        assert any(r.v[t] is not None for r in got)
    text = [r.v["str"] for r in sorted(got, key=lambda r: r.place) if r.v["str"] is not None]
    assert text == sorted(text) and len(set(text)) > 1
