"""Trade papers written out from the order tables, for tests and queries: what is in them is known.

Each order is a deal. Its papers differ in layout by `o_orderkey % 3` (label and value on a line,
label above value, value above label).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import kept

#: Kinds in the order in which deals take turns.
KINDS = ("CommercialInvoice", "ProformaInvoice", "PurchaseOrder", "PackingList", "BillOfLading", "LetterOfCredit", "SalesContract")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to all cores: the tables are small files, and what follows is work for the processor."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: doc_id, variant and the facts that its papers hold."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = spread(rows)
    key = F.col("o_orderkey").cast("string")
    return rows.select(
        F.col("o_orderkey").alias("doc_id"),
        (F.col("o_orderkey") % 3).cast("int").alias("variant"),
        F.concat(F.lit("KOREA TRADING "), (F.col("o_orderkey") % 97).cast("string"), F.lit(" CO., LTD")).alias("seller"),
        F.concat(F.upper("n_name"), F.lit(" IMPORT "), F.col("o_custkey").cast("string")).alias("buyer"),
        F.concat(F.lit("INV-26-"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")).alias("invoice_no"),
        F.concat(F.lit("ORD-26-"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")).alias("order_no"),
        F.concat(F.lit("COS"), F.lpad(key, 9, "0")).alias("bl_number"),
        F.concat(F.lit("MAEU"), F.lpad((F.col("o_orderkey") % 10000000).cast("string"), 7, "0")).alias("container"),
        F.concat(F.lit("M10LC"), F.lpad(key, 9, "0")).alias("lc_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2).alias("total_text"),
        F.upper("n_name").alias("port"),
        (F.col("o_orderkey") % 9000 + 100).cast("string").alias("weight"),
    )


def labelled(label: str, value: Column | str) -> Column:
    """A field in the row's layout."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.col("variant") == 0, F.concat(F.lit(f"{label}: "), v)).when(F.col("variant") == 1, F.concat(F.lit(f"{label}\n"), v)).otherwise(F.concat(v, F.lit(f"\n{label}")))


def lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def plain(label: str, value: str) -> Column:
    return F.concat(F.lit(f"{label}: "), F.col(value))


def texts(rows: DataFrame) -> DataFrame:
    """deals with one column for each kind of paper, named after it."""
    total = F.concat(F.lit("Total Amount: USD "), F.col("total_text"))
    return rows.withColumns({
        "CommercialInvoice": lines("COMMERCIAL INVOICE", "", labelled("Invoice No.", "invoice_no"), labelled("Invoice Date", "date"), "", plain("Seller", "seller"), plain("Buyer", "buyer"), "Incoterms: FOB BUSAN", "Country of Origin: KOREA", total, F.concat(F.lit("Gross Weight: "), F.col("weight"), F.lit(" KGS"))),
        "ProformaInvoice": lines("PROFORMA INVOICE", "", plain("Proforma Invoice No.", "invoice_no"), plain("Seller", "seller"), plain("Buyer", "buyer"), plain("Valid Until", "date"), total),
        "PurchaseOrder": lines("PURCHASE ORDER", "", plain("Order No.", "order_no"), plain("Order Date", "date"), plain("Buyer", "buyer"), plain("Vendor", "seller"), "Payment Terms: T/T 30 days", total),
        "PackingList": lines("PACKING LIST", "", plain("Packing List No.", "order_no"), plain("Seller", "seller"), plain("Buyer", "buyer"), F.concat(F.lit("Gross Weight: "), F.col("weight"), F.lit(" KGS")), "Measurement: 12.5 CBM", "Total Packages: 40 CTNS"),
        "BillOfLading": lines("BILL OF LADING", "", plain("B/L No.", "bl_number"), plain("Shipper", "seller"), plain("Consignee", "buyer"), "Port of Loading: BUSAN", F.concat(F.lit("Port of Discharge: PORT "), F.col("port")), F.concat(F.lit("Gross Weight: "), F.col("weight"), F.lit(" KGS")), plain("Date of Issue", "date"), plain("Container No", "container"), F.concat(F.lit("and again "), F.col("container"))),
        "LetterOfCredit": lines("IRREVOCABLE DOCUMENTARY CREDIT", "", F.when(F.col("variant") == 0, lines(
            F.concat(F.lit(":20: "), F.col("lc_number")), F.concat(F.lit(":31C: "), F.col("date")), F.concat(F.lit(":32B: USD "), F.col("total_text")), F.concat(F.lit(":50: APPLICANT: "), F.col("buyer"), F.lit("\\nSECOND LINE")), F.concat(F.lit(":59: "), F.col("seller")),
        )).otherwise(lines(plain("L/C No.", "lc_number"), plain("Date of Issue", "date"), F.concat(F.lit("Amount: USD "), F.col("total_text")), plain("Applicant", "buyer"), plain("Beneficiary", "seller")))),
        "SalesContract": lines("매매계약서", "", F.concat(F.lit("between "), F.col("seller"), F.lit(" and "), F.col("buyer"), F.lit(" hereinafter")), "", "제1조 (목적)", F.concat(F.lit("본 계약은 "), F.col("invoice_no"), F.lit(" 구매를 목적으로 한다.")), "제2조 (인도)", F.concat(F.lit("① 선적일은 "), F.col("date"), F.lit(" 로 한다.")), "1. 첫째", F.concat(F.lit("2. "), F.col("container")), "② 인도 지연 시 지급한다.", "제3조 (지급)", F.concat(F.lit("대금은 USD "), F.col("total_text"), F.lit(" 이다.")), "계약일자 서명"),
    })


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, true_type, text: one paper a deal, the kinds in turn."""
    rows = texts(deals(spark, sf_dir))
    turn = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    text = F.element_at(F.array(*map(F.col, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    return kept(rows.select("doc_id", turn.alias("true_type"), text.alias("text")))


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, description, quantity, unit_price, amount: an order's items, every seventh amount off by one."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    # Numbers of lines may come twice in an order; here each line has its own.
    items = items.withColumn("l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")))
    price = F.expr("cast(cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint) as decimal(18,0)) / 100").cast("decimal(18,2)")
    wrong = F.when(F.col("l_partkey") % 7 == 0, F.lit(1)).otherwise(F.lit(0))
    return items.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("pos"), F.concat(F.lit("Part number "), F.col("l_partkey").cast("string"), F.lit("A")).alias("description"),
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), price.cast("decimal(18,2)").alias("unit_price"), (F.col("l_quantity").cast("decimal(18,2)") * price + wrong).cast("decimal(18,2)").alias("amount"),
    )


def item_texts(items: DataFrame) -> DataFrame:
    """doc_id, text: the lines of an order as a table."""
    row = F.concat_ws(" ", "description", F.col("quantity").cast("string"), F.format_number("unit_price", 2), F.format_number("amount", 2))
    rows = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", row.alias("t")))).alias("_r"))
    return rows.select("doc_id", F.concat(F.lit("Description Quantity Unit Price Amount\n"), F.array_join(F.transform("_r", lambda r: r["t"]), "\n"), F.lit("\nEND")).alias("text"))
