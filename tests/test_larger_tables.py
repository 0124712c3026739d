"""Queries with SQL on tables whose ids are beyond what a field or a lookup table was made for."""

import duckdb
import pytest

from vigilframe.plans import registry


def events_of(folder, ids, users):
    """A row for each event id and user, services and values in turn."""
    con = duckdb.connect()
    con.execute("CREATE TABLE u AS SELECT unnest(?::BIGINT[]) AS user_id", [users])
    con.execute("CREATE TABLE e AS SELECT unnest(?::BIGINT[]) AS event_id", [ids])
    con.execute(f"""COPY (SELECT event_id + 6 * (row_number() OVER (PARTITION BY event_id ORDER BY user_id) - 1) AS event_id, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS ts, user_id,
      'click' AS event_type, 1.5 AS value, '{{"k": ' || (event_id * 7 + user_id * 10) % 100 || '}}' AS props FROM e, u) TO '{folder}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return con


@pytest.mark.parametrize("name", ["A31_geoip", "H70_frame_decode", "H75_tunnel_headers"])
def test_ids_beyond_fields(spark, tmp_path, name):
    con = events_of(tmp_path, [0, 1, 2, 3, 4, 5, 16777100, 16777216 + 5, 1 << 33], [0, 7, 25535, 25536, 65535, 65536, 70001, 1_000_000])
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = registry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
