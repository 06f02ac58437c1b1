"""The log table and the fixed values that parsing relies on."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR_DIM = 384
ANOMALY_THRESHOLD = 0.8

#: Canonical text fields that become columns of the log table.
RECORD_FIELDS = [
    "trace_id",
    "order_number",
    "customer_id",
    "order_status",
    "amount",
    "order_lines",
    "hold_reason",
    "shipping_provider",
    "tracking_number",
]

LOG_SCHEMA = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ts_defaulted", T.BooleanType()),
        T.StructField("message", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("log_vector", T.ArrayType(T.FloatType())),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("anomaly_label", T.IntegerType()),
        *[T.StructField(name, T.StringType()) for name in RECORD_FIELDS],
        T.StructField("semantic_template", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Field names found in logs, and the canonical name of each.
FIELD_NAMES = {
    "orderNumber": "order_number",
    "order_number": "order_number",
    "order-id": "order_number",
    "orderid": "order_number",
    "ordernum": "order_number",
    "orderNo": "order_number",
    "order_no": "order_number",
    "customerId": "customer_id",
    "customer_id": "customer_id",
    "custId": "customer_id",
    "cust_id": "customer_id",
    "userId": "customer_id",
    "user_id": "customer_id",
    "buyerId": "customer_id",
    "buyer_id": "customer_id",
    "status": "order_status",
    "order_status": "order_status",
    "orderState": "order_status",
    "order_state": "order_status",
    "holdReason": "hold_reason",
    "hold_reason": "hold_reason",
    "reason": "hold_reason",
    "holdreason": "hold_reason",
    "traceId": "trace_id",
    "trace_id": "trace_id",
    "traceID": "trace_id",
    "correlationId": "trace_id",
    "correlation_id": "trace_id",
    "shippingProvider": "shipping_provider",
    "shipping_provider": "shipping_provider",
    "shipper": "shipping_provider",
    "carrier": "shipping_provider",
    "trackingNumber": "tracking_number",
    "tracking_number": "tracking_number",
    "trackingNo": "tracking_number",
    "tracking_no": "tracking_number",
    "lines": "order_lines",
    "order_lines": "order_lines",
    "items": "order_lines",
    "orderItems": "order_lines",
    "order_items": "order_lines",
    "products": "order_lines",
    "amount": "amount",
    "total": "amount",
    "orderTotal": "amount",
    "order_total": "amount",
    "price": "amount",
    "grandTotal": "amount",
    "grand_total": "amount",
    "application_name": "application_name",
    "app": "application_name",
    "service": "application_name",
    "svc": "application_name",
    "component": "application_name",
    "module": "application_name",
    "level": "level",
    "severity": "level",
    "logLevel": "level",
    "log_level": "level",
    "timestamp": "timestamp",
    "time": "timestamp",
    "datetime": "timestamp",
    "createdAt": "timestamp",
    "created_at": "timestamp",
    "message": "message",
    "msg": "message",
    "log": "message",
    "description": "message",
    "details": "message",
    "paymentId": "payment_id",
    "payment_id": "payment_id",
    "transactionId": "payment_id",
    "transaction_id": "payment_id",
    "address": "address",
    "shippingAddress": "address",
    "shipping_address": "address",
    "deliveryAddress": "address",
    "delivery_address": "address",
    "productId": "product_id",
    "product_id": "product_id",
    "sku": "product_id",
    "qty": "quantity",
    "quantity": "quantity",
    "count": "quantity",
    "user": "customer_id",
    "buyer": "customer_id",
    "seller": "seller_id",
    "sellerId": "seller_id",
    "seller_id": "seller_id",
}

# Abbreviations and their expansions.
ABBREVIATIONS = {
    "conn": "connection",
    "svc": "service",
    "auth": "authentication",
    "db": "database",
    "cfg": "configuration",
    "msg": "message",
    "usr": "user",
    "pwd": "password",
    "err": "error",
    "req": "request",
    "resp": "response",
    "init": "initialize",
    "proc": "process",
    "agg": "aggregate",
    "num": "number",
    "mem": "memory",
    "perf": "performance",
    "temp": "temporary",
    "dest": "destination",
    "src": "source",
    "info": "information",
    "upd": "update",
    "del": "delete",
    "add": "add",
    "rm": "remove",
    "stat": "status",
    "env": "environment",
    "prod": "production",
    "dev": "development",
    "test": "testing",
    "qa": "quality_assurance",
}

# Line shapes (groups in order; see operators/parse.py).
LOG4J_LINE = r'^(\S+ \S+),\d+ (\w+) (\S+)(.*) msg="(.*)"$'
SYSLOG_LINE = r"^(\w{3} +\d+ \d{2}:\d{2}:\d{2}) (\S+) (\S+): (.*)$"
ACCESS_LINE = r'^(\S+) - - \[([^\]]+)\] "([^"]+)" (\d+) (\d+)(?: "([^"]*)" "([^"]*)")?'
KEY_VALUE_PREFIX = r"^(\S+ \S+),\d+ (\w+) (\S+)"
KEY_VALUE_PAIR = r'(\w+)=((?:".*?")|(?:\[.*?\])|(?:\S+))'
TRAILING_MESSAGE = r' msg="(.*)"$'

# Level words and the token pattern of free-text queries.
LEVEL_WORDS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
QUERY_TOKEN = r"[a-f0-9\-]{36}|ORD\d+|CUST\d+|\w{6,}"
