"""The SQL of merged time where intervals are alike."""

from larkspur.plans import oracle


def test_intervals_that_are_alike_do_not_join_what_lies_apart():
    import duckdb

    c = duckdb.connect()
    # each interval of two hours is there three times, and eight hours lie between it and the next
    c.execute("CREATE TABLE lineitem AS SELECT k % 40 AS l_suppkey, TIMESTAMP '2000-01-01' + INTERVAL (r * 10) HOUR AS l_shipdate, 2.0 AS l_quantity FROM range(40) a(k), range(200) t(r), range(3) x(y) ORDER BY hash(k, r, y)")
    rows = c.execute(oracle.INTERVALS).fetchall()
    assert len(rows) == 40 and {r[1:] for r in rows} == {(600 * 7200.0, (199 * 10 + 2) * 3600.0, 200 * 7200.0)}
