"""Revisit resolution on hand-made records and against its SQL."""

import datetime as dt
from collections import Counter

from almanac.llm import queries, warc_revisits as W

SCHEMA = "record_id long, warc_type string, target_uri string, warc_date timestamp, status int, headers string, payload_digest string, url string, t long, h int"


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def record(k, kind, uri, hour, headers, status=None):
    return (k, kind, uri, None if hour is None else at(hour), status or (200 if kind == "response" else 304), headers, f"digest{k}", "clash", 1, 2)


def test_resolve(spark):
    rows = [
        record(1, "response", "http://www.Example.org/a/?b=2&a=1&utm_source=z#x", 0, 'ETag: "1"\r\nX: y\r\nDate: old'),
        record(2, "response", "https://example.org/a?a=1&b=2", 3000, 'ETag: "2"\r\netag: "3"\r\nnoise'),
        record(3, "response", "https://example.org/a?a=1&b=2", 3000, 'ETag: "4"'),
        record(10, "revisit", "https://example.org/a?a=1&b=2", 0, 'ETag: "1"'),  # not earlier
        record(11, "revisit", "https://example.org/a?a=1&b=2", 2999, 'ETag: W/"1"\r\nDate: new\r\nX: no'),
        record(12, "revisit", "https://example.org/a?a=1&b=2", 900_000, 'ETag: "3"'),
        record(13, "revisit", "https://example.org/a?a=1&b=2", 900_000, 'ETag: "4"'),
        record(14, "revisit", "https://example.org/other", 5, None),
        record(15, "revisit", None, 5, 'ETag: "1"'),
        record(16, "revisit", "https://example.org/a?a=1&b=2", None, 'ETag: "1"'),
        record(17, "revisit", "https://example.org/a?a=1&b=2", 5, "Server: s"),
        record(18, "response", "https://example.org/gone", 1, 'ETag: "1"', 404),
        record(19, "revisit", "https://example.org/gone", 5, 'ETag: "1"'),
        (None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.record_id: r for r in W.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    outcome = {k: (r.response_id, r.outcome) for k, r in got.items()}
    assert outcome == {
        10: (None, "no_response"), 11: (1, "resolved"), 12: (3, "stale_validator"), 13: (3, "resolved"), 14: (None, "no_response"),
        15: (None, "no_response"), 16: (None, "no_response"), 17: (1, "no_validator"), 19: (None, "no_response"),
    }
    assert got[11].headers == 'date: new\netag: W/"1"\nx: y' and got[11].payload_digest == "digest1"
    assert got[11].canonical_url == "example.org/a?a=1&b=2" and got[12].payload_digest is None


def test_parts_of_a_second_and_null_ids(spark):
    ms = lambda r, n: (*r[:3], r[3] + dt.timedelta(milliseconds=n), *r[4:])
    a, b = "https://example.org/a", "https://example.org/b"
    rows = [
        ms(record(9, "response", a, 0, 'ETag: "1"'), 100), ms(record(2, "response", a, 0, 'ETag: "2"'), 300),  # the later date, not the larger id
        ms(record(10, "revisit", a, 0, 'ETag: "2"'), 900), ms(record(11, "revisit", a, 0, 'ETag: "1"'), 200), ms(record(12, "revisit", a, 0, 'ETag: "1"'), 100),
        record(None, "revisit", a, 2, 'ETag: "2"'),
        record(None, "response", b, 0, 'ETag: "5"\r\nX: y'), record(13, "revisit", b, 1, 'ETag: "5"'),
        record(14, "revisit", a, 0, 'ETag: "1"'), record(14, "revisit", a, 5, 'ETag: "2"'),
    ]
    got = Counter((r.record_id, r.response_id, r.outcome, r.headers) for r in W.resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter([
        (10, 2, "resolved", 'etag: "2"'), (11, 9, "resolved", 'etag: "1"'), (12, None, "no_response", 'etag: "1"'),
        (None, 2, "resolved", 'etag: "2"'), (13, None, "resolved", 'etag: "5"\nx: y'),
        (14, None, "no_response", 'etag: "1"'), (14, 2, "resolved", 'etag: "2"'),
    ])


def test_empty(spark):
    assert W.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark, duck):
    from tests.conftest import SF_ORACLE

    for key, sql in queries.ORACLES.items():
        got = queries.QUERIES[key](spark, SF_ORACLE)
        names = sorted(got.columns)
        want = duck.execute(f"select {', '.join(names)} from ({sql})").fetchall()
        mine = [tuple(r[n] for n in names) for r in got.collect()]
        assert sorted(map(repr, mine)) == sorted(map(repr, want)) and mine, key
