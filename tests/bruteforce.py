"""Sequential models of the application's loops, written plainly from the
page code, used to check the parallel jobs on small inputs."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

_NUM = re.compile(r"^[ \t\n\r\x0b\f]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)")
CONTAINER = ("box", "container", "sack", "bundle")


def php_int(v) -> int:
    if v is None:
        return 0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, dict)):
        return int(len(v) > 0)
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return int(v) if math.isfinite(v) else 0
    m = _NUM.match(str(v))
    return int(float(m.group(1))) if m else 0


def php_trim(s: str) -> str:
    return s.strip(" \t\n\r\x00\x0b")


def eff_ppc(p) -> int:
    return max(1, php_int(p.get("pieces_per_container")))


def total(p) -> int:
    return php_int(p.get("container_quantity")) * eff_ppc(p) + php_int(p.get("loose_pieces"))


def checkout(carts, products):
    """carts: list of dict(cart_id, ts, items); products: dict id -> dict.
    Returns (decisions {cart_id: (accepted, reason)}, products after)."""
    prods = {k: dict(v) for k, v in products.items()}
    out = {}
    for cart in sorted(carts, key=lambda c: (c["ts"], c["cart_id"])):
        try:
            items = json.loads(cart["items"]) if cart["items"] is not None else None
        except (ValueError, TypeError):
            items = None
        if isinstance(items, dict):
            items = list(items.values())
        if not isinstance(items, list) or len(items) == 0:
            out[cart["cart_id"]] = (False, "No items provided.")
            continue
        prepared, err = [], None
        for line in items:
            get = line.get if isinstance(line, dict) else (lambda k, d=None: None)
            pid, qty = php_int(get("product_id")), php_int(get("quantity"))
            if pid <= 0 or qty <= 0:
                err = "Invalid item entry."
                break
            p = prods.get(pid)
            if p is None:
                err = "Product not found."
                break
            avail = total(p)
            if qty > avail:
                err = f"{p['product_name']} has only {avail} available."
                break
            unit = get("unit_type")
            if isinstance(unit, (list, dict)):
                err = "trim(): Argument #1 ($string) must be of type string, array given"
                break
            unit = "pieces" if unit is None else "1" if unit is True else "" if unit is False else php_trim(str(unit))
            pieces = qty * eff_ppc(p) if any(w in unit.lower() for w in CONTAINER) else qty
            prepared.append((pid, pieces, money(p["unit_price"]) * qty))
        if err:
            out[cart["cart_id"]] = (False, err)
            continue
        cap = Decimal("99999999.99")
        for col, bad in (("total_amount", sum(t for _, _, t in prepared) > cap),
                         ("total_price", any(t > cap for _, _, t in prepared))):
            if bad:
                err = ("SQLSTATE[22003]: Numeric value out of range: 1264 Out of range value for column "
                       f"'{col}' at row 1")
                break
        if err:
            out[cart["cart_id"]] = (False, err)
            continue
        for pid, pieces, _t in prepared:
            p = prods[pid]
            ppc = eff_ppc(p)
            t = max(0, total(p) - pieces)
            p["container_quantity"], p["loose_pieces"] = t // ppc, t % ppc
        out[cart["cart_id"]] = (True, None)
    return out, prods


def js_parse_int(v):
    if v is None:
        return None
    m = re.match(r"^[ \t\n\r\x0b\f]*([+-]?[0-9]+)", str(v))
    return int(m.group(1)) if m else None


def preview(carts, products):
    """Browser cart: {(cart_id, line_pos): (accepted, reason)}."""
    out = {}
    for cart in carts:
        items = json.loads(cart["items"])
        accepted = []
        for pos, line in enumerate(items, start=1):
            pid = js_parse_int(line.get("product_id"))
            qty = js_parse_int(line.get("quantity"))
            p = products.get(pid)
            if p is None:
                out[(cart["cart_id"], pos)] = (False, "Please select a product")
                continue
            if qty is None or qty < 1:
                out[(cart["cart_id"], pos)] = (False, "Please enter a valid quantity")
                continue
            unit = php_trim(str(line.get("unit_type"))) if line.get("unit_type") is not None else "pieces"
            unit = unit or "pieces"
            need = qty * eff_ppc(p) if any(w in unit for w in CONTAINER) else qty
            have = sum(n for (q, n) in accepted if q == pid)
            if have + need > total(p):
                out[(cart["cart_id"], pos)] = (False, f"Not enough stock. Need {need} pieces, but only "
                                                      f"{total(p) - have} available.")
                continue
            accepted.append((pid, need))
            out[(cart["cart_id"], pos)] = (True, None)
    return out


def ledger(products, events):
    """events: list of dict(event_id, ts, product_id, kind, pieces, containers, loose).
    Returns ({event_id: total_after}, {product_id: (containers, loose)})."""
    prods = {k: dict(v) for k, v in products.items()}
    totals, touched = {}, set()
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        p = prods.get(e["product_id"])
        if p is None:
            continue
        touched.add(e["product_id"])
        ppc = eff_ppc(p)
        c, l = php_int(p.get("container_quantity")), php_int(p.get("loose_pieces"))
        if e["kind"] == "sale":
            t = max(0, c * ppc + l - php_int(e["pieces"]))
            c, l = t // ppc, t % ppc
        elif e["kind"] == "add":
            c, l = c + php_int(e["containers"]), l + php_int(e["loose"])
        elif e["kind"] == "set":
            c, l = php_int(e["containers"]), php_int(e["loose"])
        p["container_quantity"], p["loose_pieces"] = c, l
        totals[e["event_id"]] = c * ppc + l
    return totals, {k: (prods[k]["container_quantity"], prods[k]["loose_pieces"]) for k in touched}


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))
