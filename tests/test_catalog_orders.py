import datetime as dt
import json

from pyspark.sql import functions as F

from orderflow.operators import catalog as C
from orderflow.operators import orders as O

MENU = "id string, label string, description string, temps array<string>, has_milk boolean, " \
       "has_syrups boolean, show_temp boolean, active boolean, sort_order int"
INV = "item string, type string, available boolean, active boolean, sort_order int"


def menu(spark):
    return spark.createDataFrame([
        ("latte", "Latte", "", ["Hot", "Cold"], True, True, True, True, 1),
        ("americano", "Americano", "", ["Hot", "Cold"], False, True, True, True, 0),
        ("cortado", "Cortado", "", ["Hot"], True, False, True, False, 2),
    ], MENU)


def inv(spark):
    return spark.createDataFrame([
        ("Oat milk", "milk", True, True, 0), ("Whole milk", "milk", False, True, 1),
        ("Soy milk", "milk", True, False, 2), ("Vanilla", "syrup", True, True, 0),
        ("Mocha", "syrup", False, True, 1), ("Honey", "syrup", True, True, 2), ("Honey", "milk", False, True, 3),
    ], INV)


def test_stock_table_rules(spark):
    got = {r.item: r.in_stock for r in O.stock_table(inv(spark)).collect()}
    assert got["Oat milk"] and not got["Whole milk"] and "Soy milk" not in got   # inactive = absent
    assert got["Honey"] is False                                                 # milk row wins
    only_milk = inv(spark).filter("type = 'milk'")
    got2 = {r.item: r.in_stock for r in O.stock_table(only_milk).collect()}
    assert got2["Caramel"] and got2["Hazelnut"]                                  # empty type -> defaults


def test_validate_orders(spark):
    rows = [("1", "A", "latte", "", []), ("2", " A  B ", "latte", "Whole milk", ["Vanilla", "Mocha"]),
            ("3", "", "ghost", "", []), ("4", None, "americano", "", ["Nope"]), ("5", "Jo Ann", "americano", "", [])]
    o = spark.createDataFrame(rows, "id string, customer_name string, drink_id string, milk string, syrups array<string>")
    got = {r.id: r for r in O.validate_orders(o, menu(spark), inv(spark)).collect()}
    assert got["1"].error_name == "Please enter first and last name" and got["1"].error_milk == "Please choose a milk"
    assert got["2"].error_name is None and got["2"].error_milk == "Whole milk is out of stock"
    assert got["2"].error_syrups == "Mocha is out of stock"
    # unknown drink: error, and the first visible drink (americano, no milk) decides the milk rule
    assert got["3"].error_drink == "That drink is not available today" and got["3"].error_milk is None
    assert got["3"].error_name == "Please enter your name"
    assert got["4"].error_syrups == "Nope is out of stock"
    assert got["5"].valid and got["5"].errors == {}


def test_propose_reorder(spark):
    last = spark.createDataFrame([
        ("1", "latte", "Latte", "Warm", "Whole milk", ["Mocha", "Vanilla", "Honey", "Vanilla"], "x", None),
        ("2", "old-id", "LATTE", "Cold", "Oat milk", None, None, None),
        ("3", "cortado", "Cortado", "Hot", "", [], None, None),
        ("4", "latte", "Latte", "Hot", "", [], None, dt.datetime(2000, 1, 1))],
        "id string, drink_id string, drink_label string, temp string, milk string, syrups array<string>, "
        "notes string, expires_at timestamp_ntz")
    got = {r.id: r for r in O.propose_reorder(last, menu(spark), inv(spark), as_of=dt.datetime(2024, 1, 1)).collect()}
    assert got["1"].next_temp == "Hot" and got["1"].next_milk == "" and got["1"].next_syrups == ["Vanilla", "Vanilla"]
    assert got["2"].matched and got["2"].next_drink_id == "latte" and got["2"].next_milk == "Oat milk"
    assert got["2"].next_syrups == []
    assert not got["3"].matched and got["3"].error == "That saved drink is not on today's menu."
    assert "4" not in got                                                       # expired


def test_order_status(spark):
    t0 = dt.datetime(2024, 1, 1)
    q = spark.createDataFrame([("a", t0, "Ann", "waiting"), ("b", t0, "Bo", "complete"),
                               ("c", t0 + dt.timedelta(minutes=1), "Cy", "making")],
                              "id string, created_at timestamp_ntz, customer_name string, status string")
    q = q.withColumn("drink", F.lit("Latte")).withColumn("temperature", F.lit("Hot")).withColumn(
        "milk", F.lit("")).withColumn("syrups", F.array().cast("array<string>")).withColumn("notes", F.lit(""))
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("zz",)], "id string")
    got = {r.requested_id: r for r in O.order_status(ids, q).collect()}
    assert got["a"].position == 1 and got["c"].position == 2 and got["c"].orders_ahead == 1
    assert got["b"].found and got["b"].position is None
    assert not got["zz"].found and got["zz"].status is None


def test_gate(spark):
    new = spark.range(3)
    closed = spark.createDataFrame([("isOpen", '"false"')], "key string, value string")
    acc, rej = O.gate_orders(new, closed)
    assert acc.count() == 0 and rej.select("reason").distinct().first()[0] == "Queue closed"


def test_menu_documents(spark):
    drinks = [{"id": "latte", "label": " Latte ", "temps": ["Cold", "Hot", "Cold"], "milk": "on"},
              {"id": "", "label": "", "temps": [], "syrups": "0", "active": "bad"},
              {"id": "latte", "label": "Latte 2", "temps": ["Warm"], "showTemp": "OFF"}]
    docs = spark.createDataFrame([
        (1, json.dumps(drinks), json.dumps([{"item": "Oat milk"}, {"item": " "}]), None),
        (2, "[]", json.dumps([{"item": "Oat milk"}]), json.dumps([{"item": "Oat milk"}])),
        (3, '{"a": 1}', "[]", "[]"),
        (4, "not json", "[]", "[]")], "doc_id int, drinks string, milks string, syrups string")
    d, ing, rep = C.save_menu(docs)
    r = {x.doc_id: (x.doc_ok, x.duplicate_items, x.saved) for x in rep.collect()}
    assert r == {1: (True, 0, True), 2: (True, 1, False), 3: (False, 0, False), 4: (False, 0, False)}
    got = {x.id: x for x in d.collect()}
    assert set(got) == {"latte", "drink-1"}
    assert got["latte"].label == "Latte 2" and got["latte"].temps == ["Hot"] and got["latte"].sort_order == 2
    assert got["latte"].show_temp is False
    assert got["drink-1"].label == "Drink" and got["drink-1"].has_syrups is False and got["drink-1"].active is True
    assert sorted(x.item for x in ing.collect()) == ["Milk", "Oat milk"]


def test_inventory_report_and_counts(spark):
    rep = C.inventory_report(inv(spark), with_slug=True).collect()
    assert [(x.type, x.idx, x.item) for x in rep if x.type == "syrup"] == [
        ("syrup", 0, "Vanilla"), ("syrup", 1, "Mocha"), ("syrup", 2, "Honey")]
    assert {x.id for x in rep} >= {"oat-milk", "whole-milk"}
    cnt = {x.type: (x.rows, x.active_rows) for x in C.catalog_counts(inv(spark)).collect()}
    assert cnt == {"milk": (4, 3), "syrup": (3, 3)}


def test_normalize_blank_ids_and_positions(spark):
    d = spark.createDataFrame([(0, "", "Iced Tea!", None), (1, None, None, None), (2, "own", "", 9)],
                              "row_index int, id string, label string, sort_order int")
    for c, t in (("description", "string"), ("temps", "array<string>"), ("has_milk", "boolean"), ("has_syrups", "boolean"),
                 ("show_temp", "boolean"), ("active", "boolean")):
        d = d.withColumn(c, F.lit(None).cast(t))
    got = [(r.id, r.label, r.sort_order) for r in C.normalize_catalog(d).orderBy("sort_order").collect()]
    assert got == [("iced-tea", "Iced Tea!", 0), ("drink-2", "Drink", 1), ("own", "Drink", 9)]
    i = spark.createDataFrame([(0, "", "Oat  Milk", "milk", None, None, None), (1, None, " ", "syrup", False, None, None),
                               (2, "x", None, "milk", True, False, 7)],
                              "row_index int, id string, item string, type string, available boolean, active boolean, sort_order int")
    got = [tuple(r) for r in C.normalize_ingredients(i, include_inactive=True).orderBy("sort_order").collect()]
    assert got == [("oat-milk", "Oat  Milk", "milk", True, True, 0), ("item", "Syrup 2", "syrup", False, True, 1),
                   ("x", "Milk 3", "milk", True, False, 7)]
    assert C.normalize_ingredients(i).count() == 2


def test_menu_doc_member_kinds(spark):
    docs = spark.createDataFrame([
        (1, "[]", None, "[]"),            # null member counts as []
        (2, '"text"', "[]", "[]"),         # a JSON string is not an array
        (3, "[]", "[1, 2]", '{"a": []}'),  # an object is not an array
        (4, "[", "[]", "[]")],             # broken JSON
        "doc_id int, drinks string, milks string, syrups string")
    got = {r.doc_id: r.doc_ok for r in C.check_menu_doc(docs).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_all_queue_orders_are_checked(spark, smoke):
    from orderflow.plans import adapters as V
    rows = V.queue_orders(spark, smoke).select(F.substring_index("id", "-", 1).alias("order")).distinct()
    assert rows.count() == V.queue(spark, smoke).count()


def test_orders_are_read_once_and_rows_without_a_key_keep_apart(spark):
    rows = [("1", "d1", "Ann Lee", "Oat", ["A", "B"]), (None, "d1", "Bo Ray", "Soy", ["B", "A", "B"]), (None, "d9", "Cy Fox", "", None),
            ("1", "d1", "Dee Roe", "Oat", ["Z", "B"]), ("4", "d1", "Eve Poe", "Oat", ["A"]), ("4", "d1", "Eve Poe", "Oat", ["A"])]
    df = spark.createDataFrame(rows, "id string, drink_id string, customer_name string, milk string, syrups array<string>")
    menu = spark.createDataFrame([("d1", "Latte", ["Hot"], True, True, 1, True)],
                                 "id string, label string, temps array<string>, has_milk boolean, has_syrups boolean, sort_order int, active boolean")
    stock = spark.createDataFrame([("Oat", True), ("A", True), ("B", True), ("Soy", False)], "item string, in_stock boolean")
    out = O.enrich_orders(df, menu, None, stock=stock)
    got = sorted((r.customer_name, r.milk_in_stock, r.first_out_of_stock_syrup, r.in_stock_syrups) for r in out.collect())
    assert got == [("Ann Lee", True, None, ["A", "B"]), ("Bo Ray", False, None, ["B", "A", "B"]), ("Cy Fox", False, None, []),
                   ("Dee Roe", True, "Z", ["B"]), ("Eve Poe", True, None, ["A"]), ("Eve Poe", True, None, ["A"])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("customer_name#") and plan.count("LogicalRDD") == 3    # orders, menu, stock


def test_stock_lookup_equals_join_without_shuffling_orders(spark, monkeypatch):
    """few names in stock are tested in each order's row; the join of a large stock gives the same facts."""
    rows = [("1", "Oat milk", ["Vanilla", "Mocha", None, "Honey"]), ("1", "Oat milk", ["Vanilla", "Mocha", None, "Honey"]),
            ("2", None, None), ("2", "", []), (None, "Whole milk", [None, "Mocha"]), ("3", "It's \"é\\", ["It's \"é\\", "Vanilla", "Vanilla"])]
    o = spark.createDataFrame(rows, "id string, milk string, syrups array<string>")
    stock = O.stock_table(inv(spark).unionByName(spark.createDataFrame([("It's \"é\\", "syrup", True, True, 9)], INV)))
    looked = O._with_stock(o, stock, "id")
    text = looked._jdf.queryExecution().optimizedPlan().toString()
    own = [x for x in text.split("\n") if not x.lstrip().startswith(":")]  # without the stock's scalar
    assert not any(w in x for x in own for w in ("Generate", "Aggregate", "Join", "_slots"))
    monkeypatch.setattr(O, "LOOKUP_ITEMS", 1)
    joined = O._with_stock(o, stock, "id")
    assert "Join" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, looked.collect())) == sorted(map(repr, joined.collect()))
    got = {(r.id, r.milk): r for r in looked.collect()}
    assert got["1", "Oat milk"]._milk_ok and got["1", "Oat milk"]._bad_syrup == "Mocha" and got["1", "Oat milk"]._ok_syrups == ["Vanilla"]
    assert got["2", None]._milk_ok is False and got["2", None]._ok_syrups == []
    assert got["3", "It's \"é\\"]._milk_ok and got["3", "It's \"é\\"]._ok_syrups == ["It's \"é\\", "Vanilla", "Vanilla"]


def test_save_menu_judges_each_document_in_its_row(spark):
    """no join or shuffle judges the documents; odd documents as before."""
    flag = lambda m, **x: json.dumps([{"item": m, **x}])
    docs = spark.createDataFrame([
        (1, None, None, None), (2, "[]", flag("A", available="maybe"), flag("B")), (3, "[null]", "[null, {}]", "[null]"),
        (4, "[]", "[]", json.dumps([{"item": x} for x in ("C", " C ", "D", "C", "D", "E")])), (5, '[{"active": "x", "milk": "y"}]', flag("A", active="z"), "[]"),
        (6, " \n[]", " {}", "[]"), (7, "", "[]", "[]"), (8, "[]", flag("A"), "[{"), (9, "null", "[]", "[]"), (10, '"["', "[]", "[]")],
        "doc_id int, drinks string, milks string, syrups string")
    drinks, ingredients, report = C.save_menu(docs, strict=True)
    got = {r.doc_id: (r.doc_ok, r.duplicate_items, r.bad_flags, r.saved) for r in report.collect()}
    assert got == {1: (True, 0, 0, True), 2: (True, 0, 1, False), 3: (True, 1, 0, False), 4: (True, 2, 0, False), 5: (True, 0, 2, False),
                   6: (False, 0, 0, False), 7: (False, 0, 0, False), 8: (False, 0, 0, False), 9: (False, 0, 0, False), 10: (False, 0, 0, False)}
    assert ingredients.count() == 0 and drinks.count() == 0
    loose = C.save_menu(docs)
    assert sorted((r.doc_id, r.item, r.type, r.available, r.sort_order) for r in loose[1].collect()) == [
        (2, "A", "milk", True, 0), (2, "B", "syrup", True, 0), (5, "A", "milk", True, 0)]
    assert [(r.doc_id, r.id, r.active) for r in loose[0].collect()] == [(5, "drink-0", True)]
    for out in (report, ingredients):
        text = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in text and "Aggregate" not in text and text.count("LogicalRDD") == 1


def test_saved_menu_reads_each_member_once(spark):
    """no output of a save parses or judges a member twice, in a filter the optimizer adds or in a filter over the names;
    the last drink of an id is kept without a shuffle."""
    drinks = [{"id": "a", "label": "A1"}, {"id": "drink-3"}, {"id": " a ", "label": "A2"}, {"id": ""}, {"id": "x" * 81}, {"id": "x" * 80 + "y"}, None]
    docs = spark.createDataFrame([(1, json.dumps(drinks), '[{"item": "M"}]', '[{"item": "S"}, {"item": "T"}]'), (2, "[]", "[]", None),
                                  (3, json.dumps(drinks[:3]), "[]", '[{"item": "S"}, {"item": "S"}]'), (4, json.dumps(drinks[:3]), None, "[]"),
                                  (None, '[{"id": "a", "label": "N"}]', "[]", "[]")],
                                 "doc_id int, drinks string, milks string, syrups string")
    out = C.save_menu(docs)
    for df, parses in zip(out, (3, 2, 2)):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("from_json(") == parses and text.count("parseJson") == 3
        assert "Aggregate" not in text and "Join" not in text
    got = {(r.doc_id, r.id, r.label, r.sort_order) for r in out[0].collect()}
    assert got == {(1, "a", "A2", 2), (1, "drink-3", "Drink", 3), (1, "x" * 80, "Drink", 5), (1, "drink-6", "Drink", 6),
                   (4, "drink-3", "Drink", 1), (4, "a", "A2", 2), (None, "a", "N", 0)}
    assert out[0].count() == 7
    assert sorted((r.doc_id, r.item, r.type) for r in out[1].collect()) == [(1, "M", "milk"), (1, "S", "syrup"), (1, "T", "syrup")]
    alone, _ = C.ingest_menu_json(docs.filter("doc_id = 4").unionByName(docs.filter("doc_id = 4")))
    assert alone.count() == 2                      # a key that occurs twice keeps one drink of each id
