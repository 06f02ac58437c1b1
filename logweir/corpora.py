"""Log lines rendered from tables, for queries and tests that need log text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweir.session import ROWS_PER_TASK, spread

_ORDER_LINE = """
concat(
 date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'), ',',
 lpad(cast(o_orderkey % 1000 as string), 3, '0'), ' ',
 case o_orderkey % 3 when 0 then 'INFO' when 1 then 'ERROR' else 'WARNING' end, ' ',
 case o_orderkey % 4 when 0 then 'order-service' when 1 then 'payment-service'
                     when 2 then 'inventory-service' else 'shipping-service' end,
 ' traceId=', regexp_replace(md5(cast(o_orderkey as string)),
   '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5'),
 ' orderNumber=ORD', lpad(cast(o_orderkey as string), 6, '0'),
 ' customerId=CUST', lpad(cast(o_custkey as string), 6, '0'),
 ' status=', case o_orderstatus when 'P' then 'PLACED' when 'F' then 'SHIPPED' else 'ON_HOLD' end,
 ' amount=', cast(cast(o_totalprice as decimal(12,2)) as string),
 ' lines=[{product=Part ', cast(o_custkey % 50 as string),
 ',qty=', cast(o_orderkey % 5 + 1 as string), ',price=9.99}]',
 case when o_orderstatus = 'O' then ' holdReason="Payment Declined"' else '' end,
 ' msg="Order ORD', lpad(cast(o_orderkey as string), 6, '0'), ' is ', o_orderpriority, '"')
"""

_EVENT_LINE = """
case event_id % 6
 when 0 then concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ',000 INFO web-', event_type,
   ' userId=u', user_id, ' msg="user ', user_id, ' did ', event_type, '"')
 when 1 then concat('{"time": "', date_format(ts, 'yyyy-MM-dd HH:mm:ss'),
   '", "severity": "ERROR", "svc": "', event_type, '", "buyerId": "u', user_id,
   '", "details": "json ', event_type, '", "items": [{"sku": "s', event_id % 7, '", "qty": 2}]}')
 when 2 then concat('Jan  5 10:00:00 host', user_id % 4, ' ', event_type, 'd: user ', user_id,
   ' did ', event_type)
 when 3 then concat('10.0.0.', user_id % 250,
   ' - - [05/Jan/2024:10:00:00 +0000] "GET /', event_type, ' HTTP/1.1" ',
   case when event_type = 'error' then 500 else 200 end, ' ', event_id % 5000, ' "-" "agent"')
 when 4 then concat('user=u', user_id, ' status="', event_type, '" carrier=UPS')
 else concat('plain note ', event_type, ' number ', event_id) end
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is heavy per row."""
    return spread(table(spark, sf_dir, name).select(*(columns or ["*"])), ROWS_PER_TASK)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key=value line per order: ``(log_id, file_name, line)``."""
    return spread_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as log_id", "'orders.log' as file_name", f"{_ORDER_LINE} as line"
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per event, in six shapes: ``(log_id, file_name, line)``."""
    return spread_table(spark, sf_dir, "events").selectExpr(
        "event_id as log_id", "'events.log' as file_name", f"{_EVENT_LINE} as line"
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain messages of two families, with a value in each: ``(log_id, message)``."""
    return spread_table(spark, sf_dir, "events").selectExpr(
        "event_id as log_id",
        """case when event_id % 2 = 0
             then concat('user u', user_id, ' did action ', event_id % 97)
             else concat('plain note about number ', event_id) end as message""",
    )
