from depotlens.operators import stock as I
from helpers import by_key


def _pat(spark, rows):
    return spark.createDataFrame(
        [(m, a, t, 0.5, 10.0, 1, "January", 0, 2, "February", 0, 1, 0.5, "d") for m, a, t in rows],
        "material_number string, avg_monthly_consumption long, total_annual_consumption long, "
        "coefficient_of_variation double, max_unit_price double, peak_month int, peak_month_name string, "
        "peak_consumption long, low_month int, low_month_name string, low_consumption long, consumption_std long, "
        "cv_rounded_basis double, description string")


def test_status_grid(spark):
    pat = _pat(spark, [("z", 0, 3), ("one", 1, 12), ("two", 2, 24), ("ten", 10, 120)])
    stock = spark.createDataFrame([("z", 0.0), ("one", 1.0), ("two", 1.0), ("ten", 5.0), ("ten2", 1.0)],
                                  "material_number string, current_qty double")
    stock = stock.union(spark.createDataFrame([("ten", 11.0), ("ten", 12.0), ("ten", 10.0), ("ten", 4.0)], stock.schema))
    rows = I.predict_inventory(pat, stock).collect()
    got = {(r.material_number, r.current_quantity): r for r in rows}
    z = got[("z", 0.0)]
    assert (z.quantity_status, z.material_type, z.order_quantity, z.coverage_label, z.yearly_consumption) == \
        ("No-Consumption", "Non-Moving", 0, "Unlimited", 3)
    assert z.demand_variability == "CV: 0.00"
    assert got[("one", 1.0)].status == "Adequate - Slow-Moving" and got[("one", 1.0)].order_quantity == 0
    assert got[("two", 1.0)].quantity_status == "Low" and got[("two", 1.0)].order_quantity == 1   # int(2.2 - 1)
    assert got[("ten", 5.0)].quantity_status == "Low" and got[("ten", 5.0)].order_quantity == 6   # int(11 - 5)
    assert got[("ten", 4.0)].quantity_status == "Critical" and got[("ten", 4.0)].add_to_cart_eligible
    assert got[("ten", 10.0)].quantity_status == "Adequate" and got[("ten", 10.0)].order_quantity == 1
    assert got[("ten", 11.0)].quantity_status == "Adequate"     # 11 > 11.000000000000002 is false
    assert got[("ten", 12.0)].quantity_status == "Excess" and got[("ten", 12.0)].order_quantity == 0
    assert got[("ten", 5.0)].order_amount == 60.0 and got[("ten", 5.0)].coverage_months == 0.5
    assert not got[("ten2", 1.0)].found and got[("ten2", 1.0)].error == "Material not found"


def test_validate_stock(spark):
    s = spark.createDataFrame([("a", "5"), ("b", None), ("c", "x"), ("d", "-1")], "material_number string, current_qty string")
    got = by_key(I.validate_stock(s))
    assert got["a"]["current_qty"] == 5.0 and got["a"]["input_error"] is None
    assert got["b"]["input_error"] and got["c"]["input_error"] and got["d"]["input_error"]


def test_status_b_and_text(spark):
    pat = _pat(spark, [("ten", 10, 120)])
    stock = spark.createDataFrame([("ten", 4.0), ("ten", 30.0)], "material_number string, current_qty double")
    got = {r.current_quantity: r for r in I.predict_status_b(pat, stock).collect()}
    assert got[4.0].status == "Critical" and got[4.0].order_quantity == 7 and got[4.0].shortfall == 6.0
    assert got[4.0].recommendation == "Order 7.0 units. Target: 11 units."
    assert got[30.0].surplus == 20.0 and got[30.0].recommendation.startswith("Excess stock. Current: 30.0, Optimal: 11")
