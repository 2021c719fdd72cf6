"""Every field pattern of the catalogues against another engine of regular expressions, over made-up papers."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from ladingspark.catalogs import credit, invoice, lading
from ladingspark.catalogs.notation import flags_and_pattern
from ladingspark.functions import regexx as X

LABELS = (
    "Invoice No.", "Proforma Invoice No", "Order No.", "Packing List No", "PL NO / DATE", "Invoice Date", "Date of Issue", "DATE", "Seller", "Buyer", "Shipper", "Consignee", "Notify Party", "수출자", "Ship To", "Payment Terms",
    "Delivery Date", "Incoterms", "Total Amount", "TOTAL", "Currency", "Country of Origin", "H.S. Code", "Port of Loading", "Port of Discharge", "Valid Until", "Gross Weight", "Net Weight", "Measurement", "Total Packages", "Marks & Numbers",
    "B/L No.", "AWB No", "Booking No", "Vessel / Voyage", "VESSEL", "Voyage No", "Flight No", "Place of Receipt", "Place of Delivery", "Airport of Departure", "Freight Terms", "Place of Issue", "L/C No.", "Date of Expiry", "Amount",
    "Applicant", "Applicant Bank", "Beneficiary", "Issuing Bank", "Latest Shipment", "Partial Shipments", "Transhipment", "POL", "POD", "SELLER / EXPORTER", "TERMS OF SALE",
)
VALUES = (
    "KOREA TRADING 7 CO., LTD", "INV-26-004411", "COS000012345", "180-12345678", "KE123", "2024-03-05", "USD 1,234.50", "980 KGS", "12.5 CBM", "40 CTNS", "FOB BUSAN", "T/T 30 days", "PORT KLANG\tVESSEL",
    "EVER GIVEN / 012W", "M10LC123456789", "NOT ALLOWED", "FREIGHT PREPAID", "8471.30", "AB/12 - 3", "only", "TOTAL 12 CTNS 980 KGS 1,200 KGS 12.5 M3", "x", "",
)


def made_up(n: int, seed: int) -> list[str]:
    rnd, out = random.Random(seed), ["", "\n", "no field at all"]
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 12)):
            label, value = rnd.choice(LABELS), rnd.choice(VALUES)
            parts.append(rnd.choice((label, value, f"{label}: {value}", f"{label}\n{value}", f"{value} \n  {label}", f"{value.lower()} | {label.upper()}")))
        parts.append(rnd.choice(("SHIPPER: KOREA TRADING\tCONSIGNEE: ACME GMBH\nEND", "PORT OF LOADING BUSAN\tPORT OF DISCHARGE HAMBURG\t", "POL BUSAN POD HAMBURG\n", "VESSEL / VOYAGE EVER GIVEN / 012W\n", "VESSEL EVER GIVEN V.012W\n", "BILL OF LADING B/L NO. COS0001234")))
        out.append(rnd.choice(("\n", " \n\n ", "\t")).join(parts))
    return out


CATALOGUES = {"orders": invoice.FORWARD, "invoices": invoice.reverse(), "invoice forms": invoice.FORM, "ladings": lading.FIELDS, "lading forms": lading.FORM | {"vessel": lading.VESSEL_AND_VOYAGE}, "credits": credit.NARRATIVE}


@pytest.mark.parametrize("name", CATALOGUES)
def test_hits_equal_those_of_another_engine(spark, name):
    patterns = list(dict.fromkeys(p for group in CATALOGUES[name].values() for p in group))
    texts = made_up(60, 11)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = docs.select("doc_id", *[F.expr(X.hits("text", p)).alias(f"p{i}") for i, p in enumerate(patterns)], *[F.expr(X.first("text", [p])).alias(f"f{i}") for i, p in enumerate(patterns)]).collect()
    found = 0
    for i, p in enumerate(patterns):
        flags, body = flags_and_pattern(p)
        other = re.compile(body, re.IGNORECASE if flags else 0)
        assert other.groups == X.groups_in(p) and not other.match("")
        for row in rows:
            want = [tuple([m[0]] + [(m[k] or "") if k <= other.groups else "" for k in (1, 2, 3)]) for m in other.finditer(texts[row.doc_id])]
            assert [tuple(h) for h in row[f"p{i}"]] == want, body
            assert (tuple(row[f"f{i}"]) if row[f"f{i}"] else None) == (want[0] if want else None), body
            found += len(want)
    assert found > 20


def test_value_and_label_are_told_apart():
    assert X.label_below(r"(a{2})\s*\n\s*Port") == ("(a{2})", "Port")
    assert X.label_below(r"Port\s*\n\s*(a)") is None  # the label is above
    assert X.label_below(r"a|(b)\s*\n\s*Port") is None
    assert X.looks_around(r"a(?=b)") and X.looks_around(r"\ba") and not X.looks_around(r"[\^$](?:a)")
    assert X.groups_in(r"[(](?:a)(?s)(b\()([^]()]c)") == 2
