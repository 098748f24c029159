"""Each query of the engine against its SQL over the smallest tables."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from compare import difference

from quillrank.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(spark, name, registry.QUERIES[name], registry.SQL[name], sf_dir) == ""


ODD = ["", "NA", "view", None, " ", "  a ", "a\tb", "a\nb", "a\rb", "\0a", "\t", "\\", "\\t", "\\\\n", "\\e", "\\eNA", "\\\t\\", '"a', 'a"b"', "#x", "null", "é"]


def odd_tables(spark, sf_dir, folder, events, start=datetime(2024, 1, 1)):
    """A data folder whose events are ``events(event_id, user_id, event_type, props)``, a day apart over four weeks."""
    for p in Path(sf_dir).glob("*.parquet"):
        if p.stem != "events":
            (folder / p.name).symlink_to(p)
    rows = [(e, start + timedelta(days=i % 28), u, t, 1.0, p) for i, (e, u, t, p) in enumerate(events)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "events.parquet"))
    return str(folder)


def test_tsv_round_trip_keeps_rows_and_fields(spark, sf_dir, tmp_path):
    events = [(i, None if i % 3 == 0 else i, t, None if i % 4 == 0 else '{"k": 7}') for i, t in enumerate(ODD)]
    events += [(None, None, " ", None)]  # the last in SQL's order
    folder = odd_tables(spark, sf_dir, tmp_path, events)
    assert difference(spark, "tsv_round_trip", registry.QUERIES["tsv_round_trip"], registry.SQL["tsv_round_trip"], folder) == ""


PROPS = ['{"k": 7}', '{"k":"8"}', '{"k": "x"}', '{"k": -5}', '{"k": 1.5}', '{"k": 5', '{"a": {"k": 3}, "k": 4}', '{"k" : 9}', '{"k":\t6}', '{"k": null}', "", None]


def test_items_of_odd_props(spark, sf_dir, tmp_path):
    folder = odd_tables(spark, sf_dir, tmp_path, [(i, i, "click", p) for i, p in enumerate(PROPS)])
    assert difference(spark, "tsv_round_trip", registry.QUERIES["tsv_round_trip"], registry.SQL["tsv_round_trip"], folder) == ""


def test_order_of_impressions_around_1970(spark, sf_dir, tmp_path):
    folder = odd_tables(spark, sf_dir, tmp_path, [(i, i % 5, "click", '{"k": 7}') for i in range(84)], datetime(1969, 12, 13))
    assert difference(spark, "validate_order", registry.QUERIES["validate_order"], registry.SQL["validate_order"], folder) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
