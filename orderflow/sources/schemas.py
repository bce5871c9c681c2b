"""Declared schemas of the order domain (Spark types)."""

from pyspark.sql import types as T

S, TS, B, I = T.StringType(), T.TimestampNTZType(), T.BooleanType(), T.IntegerType()
ARR = T.ArrayType(T.StringType())


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ORDERS = _st(("id", S), ("created_at", TS), ("customer_name", S), ("name", S), ("drink", S),
             ("temperature", S), ("temp", S), ("milk", S), ("syrups", ARR), ("notes", S), ("status", S))
INVENTORY = _st(("id", S), ("item", S), ("type", S), ("available", B), ("active", B), ("sort_order", I))
MENU_DRINKS = _st(("id", S), ("label", S), ("description", S), ("temps", ARR), ("has_milk", B),
                  ("has_syrups", B), ("show_temp", B), ("active", B), ("sort_order", I), ("updated_at", TS))
SETTINGS = _st(("key", S), ("value", S))
ARCHIVED_ORDERS = _st(("id", S), ("archived_at", TS), ("original_order_id", S), ("original_order_id_text", S),
                      ("original_created_at", TS), ("customer_name", S), ("drink", S), ("temperature", S),
                      ("milk", S), ("syrups", S), ("notes", S), ("status", S), ("order_data", S))
PUSH_SUBSCRIPTIONS = _st(("id", S), ("order_id", S), ("endpoint", S), ("p256dh", S), ("auth", S),
                         ("customer_name", S), ("order_name", S), ("user_agent", S), ("created_at", TS),
                         ("updated_at", TS), ("last_sent_at", TS))
STATUS_CHANGES = _st(("order_id", S), ("ts", TS), ("seq", T.LongType()), ("status", S))
DELIVERY_OUTCOMES = _st(("id", S), ("endpoint", S), ("status_code", I))
ORDER_DOC = _st(("name", S), ("drink", S), ("temp", S), ("milk", S), ("notes", S), ("syrups", ARR))
ORDER_GRID = ["Order ID", "Time", "Name", "Drink", "Temp", "Milk", "Syrups", "Notes", "Status"]
ARCHIVE_GRID = ["Archived At"] + ORDER_GRID
INVENTORY_GRID = ["Item", "Type", "Available"]

# legacy column names merged into the current ones
ORDER_RENAMES = {"name": "customer_name", "temp": "temperature"}
