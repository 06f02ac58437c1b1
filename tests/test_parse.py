"""Line fixtures, field by field."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logweir.functions.text import expand_abbreviations
from logweir.functions.timestamps import log_timestamp
from logweir.operators.parse import parse_logs, parse_with_format, rename_nested, split_prefix
from logweir.schema import FIELD_NAMES

NOW = dt.datetime(2030, 1, 1)
TRACE = "b2c3d4e5-6789-01ab-cdef-2345678901bc"

CASES = [
    (
        f"2025-05-05 10:15:23,123 ERROR payment-service traceId={TRACE} orderNumber=ORD123456 "
        "customerId=CUST7890 status=ON_HOLD amount=249.99 "
        'lines=[{product=Wireless Mouse,qty=2,price=29.99}] holdReason="Payment Declined" '
        'msg="Payment failed for order ORD123456."',
        dict(
            timestamp=dt.datetime(2025, 5, 5, 10, 15, 23),
            level="ERROR",
            source="payment-service",
            trace_id=TRACE,
            order_number="ORD123456",
            customer_id="CUST7890",
            order_status="ON_HOLD",
            amount="249.99",
            order_lines="[{product=Wireless Mouse,qty=2,price=29.99}]",
            hold_reason="Payment Declined",
            message="Payment failed for order ORD123456.",
        ),
    ),
    (
        "2025-05-05 10:15:24,001 INFO inventory-service orderNumber=ORD000002 total=10.00 "
        'amount=20.00 msg="Inventory reserved: [{product=USB-C Cable,qty=1,price=9.99}]."',
        dict(
            timestamp=dt.datetime(2025, 5, 5, 10, 15, 24),
            source="inventory-service",
            order_number="ORD000002",
            amount="20.00",
            message="Inventory reserved: [{product=USB-C Cable,qty=1,price=9.99}].",
        ),
    ),
    (
        '2025-05-05 10:15:23,123 INFO svc msg="hello"',
        dict(timestamp=dt.datetime(2025, 5, 5, 10, 15, 23), source="svc", message="hello"),
    ),
    (
        '2025-05-05 10:15:23,123 INFO svc a=1 msg="x" note=2 msg="y"',
        dict(
            timestamp=dt.datetime(2025, 5, 5, 10, 15, 23),
            source="svc",
            message="x",
            attrs={"a": "1", "note": "2"},
        ),
    ),
    (
        "Oct 10 13:55:36 host1 sshd[42]: Failed password for root",
        dict(source="sshd[42]", message="Failed password for root", attrs={"host": "host1"}),
    ),
    (
        '10.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET /x HTTP/1.0" 200 2326 "http://r" "UA"',
        dict(
            order_status="200",
            attrs={
                "ip": "10.0.0.1",
                "request": "GET /x HTTP/1.0",
                "size": "2326",
                "referrer": "http://r",
                "agent": "UA",
            },
        ),
    ),
    (
        '10.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET /x HTTP/1.0" 404 12',
        dict(
            order_status="404",
            attrs={"ip": "10.0.0.1", "request": "GET /x HTTP/1.0", "size": "12"},
        ),
    ),
    (
        "2025-05-05 10:15:23,123 INFO order-service orderNo=ORD1 carrier=UPS",
        dict(
            timestamp=dt.datetime(2025, 5, 5, 10, 15, 23),
            source="order-service",
            order_number="ORD1",
            shipping_provider="UPS",
        ),
    ),
    (
        'user=bob orderid=ORD9 status="ON HOLD" items=[a, b]',
        dict(
            customer_id="bob", order_number="ORD9", order_status="ON HOLD", order_lines="[a, b]"
        ),
    ),
    ("{bad json status=FAILED", dict(order_status="FAILED")),
    (
        '{"raw": "2025-05-05 10:15:23,123 ERROR Query failed: Timeout exceeded", '
        '"application_name": "database", "trace_id": "t1", "order_number": "ORD001000"}',
        dict(
            source="database",
            trace_id="t1",
            order_number="ORD001000",
            message="2025-05-05 10:15:23,123 ERROR Query failed: Timeout exceeded",
            attrs={"raw": "2025-05-05 10:15:23,123 ERROR Query failed: Timeout exceeded"},
        ),
    ),
    (
        "2025-05-05 10:15:23,123 CRITICAL System crash detected: segmentation fault",
        dict(message="2025-05-05 10:15:23,123 CRITICAL System crash detected: segmentation fault"),
    ),
    (
        '{"time": "2024-01-01 00:03:52", "severity": "ERROR", "svc": "click", "buyerId": "u46", '
        '"details": "json click", "items": [{"sku": "s1", "qty": 2}]}',
        dict(
            timestamp=dt.datetime(2024, 1, 1, 0, 3, 52),
            level="ERROR",
            source="click",
            customer_id="u46",
            message="json click",
            order_lines='[{"product_id":"s1","quantity":2}]',
        ),
    ),
    ('{"a":1} trailing', dict(message='{"a":1} trailing')),
    ("{'a': 1}", dict(message="{'a': 1}")),
    # an alias of a unicode key is no word boundary
    ("größe=5 total=7", dict(amount="7", attrs={"größe": "5"})),
    # repeated key: first place, last value; last placed alias wins
    ("amount=1 total=2 amount=3", dict(amount="2")),
    # tail message beats an earlier msg key
    ('x=1 msg="a" y=2 msg="b"', dict(message='a" y=2 msg="b', attrs={"x": "1", "y": "2"})),
    # records that cannot be processed keep the line
    (
        '{"message": 5, "svc": "a"}',
        dict(
            message='{"message": 5, "svc": "a"}',
            level="ERROR",
            semantic_template='{"message": 5, "svc": "a"}',
            attrs=None,
        ),
    ),
    (
        '{"message": null, "svc": "a"}',
        dict(
            message='{"message": null, "svc": "a"}',
            level="ERROR",
            semantic_template='{"message": null, "svc": "a"}',
            attrs=None,
        ),
    ),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, "f.log", line) for i, (line, _) in enumerate(CASES)]
    lines = spark.createDataFrame(rows, "id int, file_name string, line string")
    return {r["id"]: r for r in parse_logs(lines, F.lit(NOW)).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_line_fixture(parsed, case):
    line, expected = CASES[case]
    row = parsed[case].asDict()
    defaults = dict.fromkeys(row)
    defaults.update(level="INFO", source="f.log", message="", timestamp=NOW, attrs={})
    want = defaults | expected
    for name in ("id", "format", "ts_defaulted"):
        row.pop(name)
        want.pop(name)
    assert row == want, line
    assert parsed[case]["ts_defaulted"] == ("timestamp" not in expected)


def test_blank_lines_are_dropped(spark):
    lines = spark.createDataFrame([("f", ""), ("f", " \t "), ("f", "x")], "file_name string, line string")
    assert [r.message for r in parse_logs(lines).collect()] == ["x"]


def test_split_raw(spark):
    line = CASES[10][0]
    lines = spark.createDataFrame([("f.log", line)], "file_name string, line string")
    row = parse_logs(lines, F.lit(NOW), split_raw=True).first()
    assert row.timestamp == dt.datetime(2025, 5, 5, 10, 15, 23, 123000)
    assert (row.level, row.message) == ("ERROR", "Query failed: Timeout exceeded")


@pytest.mark.parametrize(
    "text,want",
    [
        ("2025-05-05 10:15:23", dt.datetime(2025, 5, 5, 10, 15, 23)),
        ("2025-05-05 10:15:23.1", dt.datetime(2025, 5, 5, 10, 15, 23, 100000)),
        ("2025-05-05 10:15:23.123456", dt.datetime(2025, 5, 5, 10, 15, 23, 123456)),
        ("2025-05-05 10:15:23,5", dt.datetime(2025, 5, 5, 10, 15, 23, 500000)),
        ("2025-5-5 1:2:3", dt.datetime(2025, 5, 5, 1, 2, 3)),
        ("2025-05-05T10:15:23.5Z", dt.datetime(2025, 5, 5, 10, 15, 23, 500000)),
        ("2025-05-05T10:15:23", dt.datetime(2025, 5, 5, 10, 15, 23)),
        ("2025-05-05T10:15:23Z", None),
        ("2025-05-05T10:15:23,5", None),
        ("2025-02-30 10:15:23", None),
        ("2025-05-05 10:15:23 ", None),
        ("10/Oct/2000:13:55:36 -0700", None),
    ],
)
def test_log_timestamp(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(log_timestamp(F.col("t")).alias("ts")).first().ts == want


@pytest.mark.parametrize(
    "line,level,message",
    [
        ("2025-05-05 10:15:23,123 ERROR disk is full", "ERROR", "disk is full"),
        ("2025-05-05 10:15:23.5 odd", "odd", ""),
        ("job error while saving it", "ERROR", "while saving it"),
        ("the job had error while saving", "INFO", "the job had error while saving"),
        ("nothing to see here", "INFO", "nothing to see here"),
        ("error", "INFO", "error"),
    ],
)
def test_split_prefix(spark, line, level, message):
    df = spark.createDataFrame([(line,)], "line string")
    got = df.select(split_prefix(F.col("line")).alias("p")).first().p
    assert (got.level, got.message) == (level, message)


def test_parse_with_format(spark):
    lines = spark.createDataFrame(
        [("2025-05-05 10:15:23,1 INFO  app: hello: world",), ("no",)], "line string"
    )
    got = parse_with_format(lines, "<Date> <Time> <Level> <Component>: <Content>").collect()
    assert got[0][1:] == (True, "2025-05-05", "10:15:23,1", "INFO", "app", "hello: world")
    assert got[1][1:] == (False, None, None, None, None, None)


def test_abbreviations(spark):
    df = spark.createDataFrame([("DB conn err, ADD subdb db_x",)], "t string")
    assert (
        df.select(expand_abbreviations(F.col("t")).alias("t")).first().t
        == "database connection error, add subdb db_x"
    )


def test_only_containers_are_renamed_inside(spark):
    lines = [
        '{"message": "{\\"status\\": 5}", "svc": "a"}',
        '{"message": "[warn] \\"user\\": bad"}',
        '{"items": [{"price": 1, "total": 2}, 3, "x"], "o": {"price": 1.5, "k": {"total": "a", "price": "b"}}}',
    ]
    df = spark.createDataFrame([(i, "f", x) for i, x in enumerate(lines)], "log_id int, file_name string, line string")
    rows = parse_logs(df).orderBy("log_id").collect()
    assert [r.message for r in rows[:2]] == ['{"status": 5}', '[warn] "user": bad']
    assert rows[2].order_lines == '[{"amount":2},3,"x"]'
    assert rows[2].attrs["o"] == '{"amount":1.5,"k":{"amount":"b"}}'


def _renamed_in_python(value, lists=0):
    """Names made canonical by plain recursion; a list inside a list stays."""
    if isinstance(value, dict):
        out = {}
        for name, inner in value.items():
            out[FIELD_NAMES.get(name, name)] = _renamed_in_python(inner)
        return out
    if isinstance(value, list) and not lists:
        return [_renamed_in_python(v, 1) for v in value]
    return value


def test_names_of_one_meaning_merge_at_any_depth(spark):
    deep = {"price": 1, "total": 2, "note": 'a "q", {b}: \\ [c]', "none": None, "on": True}
    values = [
        [{"a": {"b": {"price": 1, "total": 2}}}],
        {"total": 1.5, "x": [{"price": -2e-3, "y": {}}, [], {"total": "t", "price": deep}]},
        {"price": 1, "total": [[{"price": 1, "total": 2}], {"price": 3, "total": 4}]},
    ]
    for _ in range(9):
        deep = {"total": 0, "price": {"inner": [deep, 7]}}
    values.append({"price": 1, "total": deep})
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    rows += [(8, '{"price":1,"total":2,"price":3}'), (9, None), (10, "{}")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.t for r in df.select("id", rename_nested(F.col("t")).alias("t")).collect()}
    for i, value in enumerate(values):
        assert json.dumps(json.loads(got[i])) == json.dumps(_renamed_in_python(value))
    assert (got[8], got[9], got[10]) == ('{"amount":2}', None, "{}")
