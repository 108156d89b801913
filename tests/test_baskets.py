import random

from depotlens.operators import baskets as B

SCHEMA = "seq long, session_id long, material_number string, op string, quantity long, unit_price double"


def sequential(events):
    cart, lines = {}, []
    for seq, s, m, op, q, p in sorted(events):
        k = (s, m)
        if op == "add":
            if k in cart:
                cart[k][0] += q
            else:
                cart[k] = [q, p]
        elif op == "set":
            if k in cart:
                if (q or 0) > 0:
                    cart[k][0] = q
                else:
                    del cart[k]
        elif op == "confirm":
            if k in cart:
                lines.append((s, m, seq, cart[k][0], cart[k][1]))
                del cart[k]
    return {k: tuple(v) for k, v in cart.items()}, sorted(lines)


def random_events(n, seed):
    rnd = random.Random(seed)
    ev = []
    for seq in range(n):
        op = rnd.choice(["add", "add", "add", "set", "set", "confirm"])
        q = rnd.randint(1, 9) if op == "add" else (rnd.randint(0, 5) if op == "set" else None)
        ev.append((seq, rnd.randint(1, 4), str(rnd.randint(1, 5)), op, q, float(rnd.randint(1, 50))))
    rnd.shuffle(ev)
    return ev


def test_golden(spark):
    ev = [(1, 1, "a", "add", 2, 5.0), (2, 1, "a", "add", 3, 9.0),      # add-add keeps first price
          (3, 1, "b", "set", 4, None), (4, 1, "b", "add", 1, 2.0),     # set before add: no effect
          (5, 1, "c", "add", 2, 1.0), (6, 1, "c", "set", 0, None),     # set 0 deletes
          (7, 1, "d", "add", 2, 1.0), (8, 1, "d", "confirm", None, None), (9, 1, "d", "add", 1, 7.0)]
    got = {r.material_number: (r.quantity, r.unit_price) for r in B.basket_current(spark.createDataFrame(ev, SCHEMA)).collect()}
    assert got == {"a": (5, 5.0), "b": (1, 2.0), "d": (1, 7.0)}


def test_fold_equals_sequential_model(spark):
    for seed in range(3):
        ev = random_events(400, seed)
        want_cart, want_lines = sequential(ev)
        df = spark.createDataFrame(ev, SCHEMA).repartition(5)
        got = {(r.session_id, r.material_number): (r.quantity, r.unit_price) for r in B.basket_current(df).collect()}
        assert got == want_cart
        assigned = spark.createDataFrame([(str(i), "V") for i in range(1, 6)], "material_number string, vendor string")
        lines = sorted((r.session_id, r.material_number, r.seq, r.quantity, r.unit_price)
                       for r in B.order_lines(df, assigned).collect())
        assert lines == want_lines


def test_order_lines_in_blocks(spark):
    """Any block width gives the sequential result, one key with many events included."""
    assigned = spark.createDataFrame([(str(i), "V") for i in range(1, 6)], "material_number string, vendor string")
    for width in (1, 3, 50):
        ev = random_events(300, width)
        df = spark.createDataFrame(ev, SCHEMA)
        got = sorted((r.session_id, r.material_number, r.seq, r.quantity, r.unit_price) for r in B.order_lines(df, assigned, width).collect())
        assert got == sequential(ev)[1]
    rnd = random.Random(5)
    hot = [(seq, 1, "1", rnd.choice(["add"] * 20 + ["set", "confirm"]), rnd.randint(0, 9), float(rnd.randint(1, 50))) for seq in range(100_000)]
    df = spark.createDataFrame(hot, SCHEMA).repartition(5)
    got = sorted((r.session_id, r.material_number, r.seq, r.quantity, r.unit_price) for r in B.order_lines(df, assigned, 5_000).collect())
    assert got == sequential(hot)[1]
