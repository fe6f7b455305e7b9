"""A small shop of invented data and ten reports on it, each said once and turned into a builder query and into SQL.

The bench times the builder on it at the size of published small-scale figures (200 orders); a test compares both forms.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera import AutoNumber, Database, avg, col, count, max_, sum_

NUMBER, WHOLE, TEXT, MONEY = AutoNumber, int, str, float
#: Columns by table; "-> table" marks a reference to its id.
TABLES: dict[str, dict[str, Any]] = {
    "regions": {"name": TEXT},
    "customers": {"name": TEXT, "region_id": "-> regions", "tier": TEXT, "status": TEXT, "signup_month": TEXT},
    "sales_reps": {"name": TEXT, "region_id": "-> regions", "level": TEXT},
    "categories": {"name": TEXT},
    "suppliers": {"name": TEXT, "region_id": "-> regions", "rating": WHOLE},
    "products": {"name": TEXT, "category_id": "-> categories", "supplier_id": "-> suppliers", "price": MONEY, "cost": MONEY},
    "orders": {"customer_id": "-> customers", "sales_rep_id": "-> sales_reps", "order_month": TEXT, "status": TEXT, "channel": TEXT},
    "order_items": {"order_id": "-> orders", "product_id": "-> products", "quantity": WHOLE, "unit_price": MONEY, "discount": MONEY, "line_total": MONEY},
    "payments": {"order_id": "-> orders", "amount": MONEY, "payment_method": TEXT, "status": TEXT},
    "support_tickets": {"customer_id": "-> customers", "product_id": "-> products", "ticket_month": TEXT, "status": TEXT, "priority": TEXT, "priority_score": WHOLE, "satisfaction": WHOLE},
}
PAID_STATES, OPEN_STATES = ["paid", "shipped", "delivered"], ["pending", "cancelled", "refunded"]


def rows(seed: int = 42, size: int = 200) -> dict[str, list[dict[str, Any]]]:
    """Rows of every table; ids follow their order, from 1."""
    rng = random.Random(seed)
    pick, whole = rng.choice, rng.randint
    month = lambda year: f"{year}-{whole(1, 12):02}"
    money = lambda a, b: round(rng.uniform(a, b), 2)
    out: dict[str, list[dict[str, Any]]] = {t: [] for t in TABLES}
    out["regions"] = [{"name": f"Region {i}"} for i in range(8)]
    out["customers"] = [
        {"name": f"Customer {i}", "region_id": whole(1, 8), "tier": pick(["bronze", "silver", "gold", "platinum"]), "status": "active" if rng.random() < 0.85 else "inactive", "signup_month": month(2025)}
        for i in range(size)
    ]
    out["sales_reps"] = [{"name": f"Rep {i}", "region_id": whole(1, 8), "level": pick(["junior", "mid", "senior", "lead"])} for i in range(40)]
    out["categories"] = [{"name": f"Category {i}"} for i in range(12)]
    out["suppliers"] = [{"name": f"Supplier {i}", "region_id": whole(1, 8), "rating": whole(1, 5)} for i in range(40)]
    for i in range(120):
        price = money(10, 1200)
        out["products"].append({"name": f"Product {i}", "category_id": whole(1, 12), "supplier_id": whole(1, 40), "price": price, "cost": round(price * rng.uniform(0.4, 0.8), 2)})
    settled = {"pending": "pending", "cancelled": "cancelled", "refunded": "refunded"}
    for i in range(size):
        status = pick(PAID_STATES + OPEN_STATES)
        out["orders"].append({"customer_id": whole(1, size), "sales_rep_id": whole(1, 40), "order_month": month(2026), "status": status, "channel": pick(["website", "mobile", "phone", "partner"])})
        amount = 0.0
        for _ in range(whole(1, 5)):
            product, quantity, discount = whole(1, 120), whole(1, 5), pick([0.0, 0.05, 0.1, 0.15, 0.2])
            price = out["products"][product - 1]["price"]
            total = round(quantity * price * (1 - discount), 2)
            amount += total
            out["order_items"].append({"order_id": i + 1, "product_id": product, "quantity": quantity, "unit_price": price, "discount": discount, "line_total": total})
        out["payments"].append({"order_id": i + 1, "amount": round(amount, 2), "payment_method": pick(["credit_card", "paypal", "bank_transfer", "cash"]), "status": settled.get(status, "settled")})
    for _ in range(size * 5 // 4):
        score = whole(1, 4)
        out["support_tickets"].append({
            "customer_id": whole(1, size), "product_id": whole(1, 120), "ticket_month": month(2026), "status": pick(["open", "closed", "escalated"]),
            "priority": ["low", "medium", "high", "critical"][score - 1], "priority_score": score, "satisfaction": whole(1, 5),
        })
    return out


def database(spark: SparkSession, data: dict[str, list[dict[str, Any]]]) -> Database:
    db = Database(spark)
    for table, columns in TABLES.items():
        db.create_table(table)
        db.add_column(table, "id", AutoNumber, is_primary_key=True)
        for n, kind in columns.items():
            if isinstance(kind, str):
                db.add_column(table, n, int, nullable=False, references=f"{kind[3:]}.id")
            else:
                db.add_column(table, n, kind, nullable=False)
        db.insert_many(table, data[table])
    return db


@dataclass(frozen=True)
class Report:
    """tables: joined one after the other along references; keys and sums: alias to what; least: (alias, its least value)."""

    tables: str
    where: dict[str, list[str]]
    keys: dict[str, str]
    sums: dict[str, tuple[str, str | None]]
    least: tuple[str, float] | None
    order: list[tuple[str, str]]
    limit: int | None

    def builder(self, db: Database) -> DataFrame:
        first, *others = self.tables.split()
        q = db.query(first)
        name = lambda n: n if others else n.split(".")[1]
        for t in others:
            q = q.join(t)
        for n, known in self.where.items():
            q = q.where(col(name(n)).in_(known))
        makers = {"avg": avg, "sum": sum_, "max": max_}
        g = q.group_by(*map(name, self.keys.values())).aggregate(**{a: makers[f](name(n)) if n else count() for a, (f, n) in self.sums.items()})
        g = g.having(col(self.least[0]) >= self.least[1]) if self.least else g
        g = g.order_by(*[(name(self.keys[a]) if a in self.keys else a, way) for a, way in self.order])
        return (g if self.limit is None else g.limit(self.limit)).to_df().toDF(*self.keys, *self.sums)

    def sql(self) -> str:
        first, *others = self.tables.split()
        known, joins = [first], ""
        for t in others:
            away = [f"{k}.{n} = {t}.id" for k in known for n, kind in TABLES[k].items() if kind == f"-> {t}"]
            back = [f"{t}.{n} = {k}.id" for k in known for n, kind in TABLES[t].items() if kind == f"-> {k}"]
            known.append(t)
            joins += f" JOIN {t} ON {(away + back)[0]}"
        sums = {a: f"{f}({n or '*'})" for a, (f, n) in self.sums.items()}
        text = "SELECT " + ", ".join(f"{x} AS {a}" for a, x in (self.keys | sums).items()) + f" FROM {first}{joins}"
        tests = [f"{n} IN ({', '.join(repr(v) for v in known)})" for n, known in self.where.items()]
        text += (" WHERE " + " AND ".join(tests) if tests else "") + " GROUP BY " + ", ".join(self.keys.values())
        text += f" HAVING {sums[self.least[0]]} >= {self.least[1]}" if self.least else ""
        text += " ORDER BY " + ", ".join(f"{(self.keys | sums)[a]} {way}" for a, way in self.order)
        return text + (f" LIMIT {self.limit}" if self.limit else "")


_SOLD = {"orders.status": PAID_STATES}
_SETTLED = {"payments.status": ["settled"]}
_LINES = {"line_count": ("count", None), "revenue": ("sum", "order_items.line_total")}
_AMOUNTS = {"n": ("count", None), "total": ("sum", "payments.amount"), "mean": ("avg", "payments.amount")}
REPORTS = {
    "q01": Report("orders order_items products categories customers regions", _SOLD, {"region": "regions.name", "category": "categories.name"},
                  _LINES | {"avg_quantity": ("avg", "order_items.quantity"), "max_price": ("max", "products.price")}, ("revenue", 2000), [("revenue", "desc"), ("region", "asc"), ("category", "asc")], 20),
    "q02": Report("customers orders payments", _SETTLED, {"customer_id": "customers.id", "customer": "customers.name", "tier": "customers.tier"}, _AMOUNTS, ("total", 1000), [("total", "desc"), ("customer_id", "asc")], 15),
    "q03": Report("orders order_items products suppliers categories", _SOLD, {"supplier": "suppliers.name", "category": "categories.name"},
                  _LINES | {"avg_price": ("avg", "order_items.unit_price"), "max_price": ("max", "products.price")}, ("revenue", 1500), [("revenue", "desc"), ("supplier", "asc"), ("category", "asc")], 20),
    "q04": Report("orders sales_reps payments", _SETTLED, {"rep": "sales_reps.name", "month": "orders.order_month"}, _AMOUNTS, ("total", 1000), [("total", "desc"), ("rep", "asc"), ("month", "asc")], 20),
    "q05": Report("payments", {}, {"method": "payments.payment_method", "status": "payments.status"}, _AMOUNTS | {"most": ("max", "payments.amount")}, ("n", 2), [("total", "desc"), ("method", "asc"), ("status", "asc")], None),
    "q06": Report("support_tickets products categories", {}, {"category": "categories.name", "status": "support_tickets.status"},
                  {"n": ("count", None), "score": ("avg", "support_tickets.priority_score"), "satisfaction": ("avg", "support_tickets.satisfaction")}, ("n", 3), [("n", "desc"), ("category", "asc"), ("status", "asc")], 20),
    "q07": Report("customers regions orders payments", {"customers.status": ["active"]} | _SETTLED, {"region": "regions.name", "tier": "customers.tier"}, _AMOUNTS, ("total", 2000), [("total", "desc"), ("region", "asc"), ("tier", "asc")], 20),
    "q08": Report("orders order_items products categories", _SOLD, {"month": "orders.order_month", "category": "categories.name"},
                  _LINES | {"avg_quantity": ("avg", "order_items.quantity")}, ("revenue", 1500), [("month", "asc"), ("revenue", "desc"), ("category", "asc")], 30),
    "q09": Report("order_items products categories orders", _SOLD, {"product": "products.name", "category": "categories.name"},
                  {"units": ("sum", "order_items.quantity"), "revenue": ("sum", "order_items.line_total"), "avg_discount": ("avg", "order_items.discount")}, ("units", 5), [("units", "desc"), ("revenue", "desc"), ("product", "asc")], 20),
    "q10": Report("orders customers regions payments", {"orders.status": OPEN_STATES}, {"region": "regions.name", "tier": "customers.tier", "status": "orders.status"}, _AMOUNTS, ("n", 1),
                  [("total", "desc"), ("region", "asc"), ("tier", "asc"), ("status", "asc")], 20),
}
