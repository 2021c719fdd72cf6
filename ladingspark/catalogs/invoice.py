"""Patterns and word lists of invoice-like papers (invoice, proforma, order, packing list).

A pattern stands alone if it ignores case, and as exact(pattern) if it doesn't. Order matters: the
first pattern with an accepted match wins.
"""

from __future__ import annotations

from .notation import exact

_DAY = r"(\d{4}[-./]\d{1,2}[-./]\d{1,2})"
_TERM = "EXW|FCA|FAS|FOB|CFR|CIF|CPT|CIP|DAP|DPU|DDP|DAT"
_SELLING = r"(?:Seller|Vendor|Shipper|Consignor|Exporter)"
_SELLING_ANY = r"(?:Seller|Vendor|Shipper|Consignor|Exporter|수출자|매도인|공급자|송하인)"
_BUYING = r"(?:Buyer|Customer|Consignee|Importer)"
_BUYING_ANY = r"(?:Buyer|Customer|Consignee|Importer|수입자|매수인|구매자|수하인)"
_MASS = r"(KGS?|LBS?|TONS?)"
_PACKS = "(CTNS?|PKGS?|PLTS?|CARTONS|PALLETS|PACKAGES|CASES)"

#: Header fields, label before value first.
FORWARD = {
    "invoice_no": [
        r"Proforma\s*Invoice\s*(?:No\.?|Number|#)\s*[:\.]?\s*\n?\s*([A-Z]{2,3}-?\d{2}-?\d{3,6}|[A-Z0-9\-/]{3,30})",
        r"([A-Z]{2,3}-?\d{2}-?\d{3,6}|[A-Z]{2,}\d{4,})\s*\n\s*Proforma\s*Invoice\s*(?:No\.?|Number)",
        r"(?:^|\n)\s*Invoice\s*(?:No\.?|Number|#)\s*[:\.]?\s*\n?\s*([A-Z]{2,3}-?\d{2}-?\d{3,6}|[A-Z]{2,}\d{4,}[A-Z0-9\-/]*)",
        r"([A-Z]{2,3}-?\d{2}-?\d{3,6}|[A-Z]{2,}\d{4,})\s*\n\s*Invoice\s*(?:No\.?|Number|#)",
        exact(r"(?:송장|인보이스)\s*번호\s*[:\.]?\s*([A-Z0-9\-/]{3,30})"),
    ],
    "order_no": [
        r"(?:P\.?O\.?|Order|Purchase)\s*(?:No\.?|Number|#)\s*[:\.]?\s*\n?\s*([A-Z]{2,3}-?\d{2,6}-?\d{3,6}|[A-Z0-9\-/]{3,30})",
        r"([A-Z]{2,3}-?\d{2,6}-?\d{3,6}|[A-Z]{2,}\d{4,})\s*\n\s*(?:P\.?O\.?|Purchase\s*Order|Order)\s*(?:No\.?|Number|#)?",
        exact(r"(?:발주|주문)\s*번호\s*[:\.]?\s*([A-Z0-9\-/]{3,30})"),
    ],
    "packing_no": [
        r"Packing\s*List\s*(?:No\.?|Number)\s*[:\.]?\s*\n?\s*([A-Z0-9\-/]{3,30})",
        r"\bPL\s*No\.?\s*[:\.]?\s*([A-Z0-9\-/]{3,30})",
        r"P/L\s*No\.?\s*[:\.]?\s*([A-Z0-9\-/]{3,30})",
        r"([A-Z]{2,3}-?\d{2}-?\d{3,6})\s*\n\s*Packing\s*List\s*(?:No\.?|Number)?",
        exact(r"(?:포장|패킹)\s*번호\s*[:\.]?\s*([A-Z0-9\-/]{3,30})"),
    ],
    "quotation_no": [
        r"(?:Quotation|Proforma)\s*(?:Invoice)?\s*(?:No\.?|Number|#)\s*[:\.]?\s*\n?\s*([A-Z0-9\-/]{3,30})",
        r"([A-Z]{2,3}-?\d{2,6})\s*\n\s*Proforma\s*Invoice\s*(?:No\.?|Number)",
    ],
    "date": [
        r"(?:Invoice\s*Date|Date\s*of\s*Issue|Order\s*Date|발행일|일자)\s*[:\.]?\s*\n?\s*" + _DAY,
        _DAY + r"\s*\n\s*(?:Invoice\s*Date|Date\s*of\s*Issue|Order\s*Date)(?!\s*of\s*Expiry)",
    ],
    "seller": [
        r"(?:^|\n|\t)" + _SELLING + r"\s+([A-Za-z가-힣\(㈜][^\n\t|]{4,200}?)(?=\s*(?:\t|\||\n|Invoice\s*No|L/C\s*No|PO\s*No|Order\s*Date|Consignee|Buyer|Customer|Importer|Ship\s*To))",
        _SELLING_ANY + r"\s*[:\.]?\s*\n\s*([^\n]{5,250})",
        _SELLING + r"\s*[:\.]\s*([^|\n]{5,150}?)(?=\s*(?:\||$|Consignee|Buyer|Customer))",
        _SELLING + r"\s*[:\.]\s*([^\n]{5,250})",
        r"([^\n]{5,250})\s*\n\s*(?:Seller|Vendor|Shipper|Consignor)(?!\s*Bank)",
        r"(?:From|Sold\s*By)\s*[:\.]\s*([^\n]{3,200})",
    ],
    "buyer": [
        r"(?:^|\n|\t)" + _BUYING + r"\s+([A-Za-z가-힣\(㈜][^\n\t|]{4,200}?)(?=\s*(?:\t|\||\n|Invoice\s*No|L/C\s*No|PO\s*No|PL\s*No|Description|Notify|Vendor|Seller|Shipper|Ship\s*To))",
        _BUYING_ANY + r"\s*[:\.]?\s*\n\s*([^\n]{5,250})",
        _BUYING + r"\s*[:\.]\s*([^|\n]{5,150}?)(?=\s*(?:\||$|PL\s*No|Invoice\s*No|Date|Description))",
        _BUYING + r"\s*[:\.]\s*([^\n]{5,250})",
        r"([^\n]{5,250})\s*\n\s*(?:Buyer|Customer|Consignee)(?!\s*.)",
        r"(?:To|Sold\s*To|Bill\s*To|Messrs)\s*[:\.]\s*([^\n]{3,200})",
    ],
    "ship_to": [
        r"(?:Ship\s*To|Delivery\s*Address|배송지)\s*[:\.]?\s*\n\s*([^\n]{5,200})",
        r"([^\n]{5,200})\s*\n\s*Ship\s*To",
    ],
    "payment_terms": [
        r"(?:Payment\s*Terms?|지급조건|결제조건)\s*[:\.]?\s*\n?\s*([^\n]{3,100})",
        r"([^\n]{3,100})\s*\n\s*(?:Payment\s*Terms?)",
    ],
    "delivery_date": [
        r"(?:Delivery\s*Date|Required\s*(?:Delivery\s*)?Date|납기일?)\s*[:\.]?\s*\n?\s*" + _DAY,
        _DAY + r"\s*\n\s*(?:Delivery\s*Date|Required\s*Date|납기)",
    ],
    "incoterms": [
        rf"Incoterms?\s*[:\.]?\s*\n?\s*({_TERM})\b\s*([A-Za-z가-힣]+)?",
        rf"((?:{_TERM})\b\s*[A-Za-z가-힣]+)\s*\n\s*Incoterms?",
        rf"\b({_TERM})\s+([A-Za-z가-힣]+)",
    ],
    "total_amount": [
        r"(?:Grand\s*Total|Total\s*Amount|TOTAL(?:\s*QUOTATION)?|합계|총액)\s*[:\.]?\s*([A-Z]{3})?\s*([0-9,]+(?:\.\d{1,2})?)",
    ],
    "currency": [
        r"(?:Currency|통화)\s*[:\.]?\s*\n?\s*([A-Z]{3})",
        r"([A-Z]{3})\s*\n\s*Currency",
    ],
    "country_of_origin": [
        r"(?:Country\s*of\s*Origin|Origin|원산지)\s*[:\.]?\s*\n?\s*([A-Za-z가-힣]{2,40})",
        r"([A-Z가-힣]{2,40})\s*\n\s*Country\s*of\s*Origin",
    ],
    "hs_code": [r"H\.?S\.?\s*(?:Code|Number)\s*[:\.]?\s*(\d{4}\.\d{2,4}(?:\.\d{2})?)"],
    "port_of_loading": [
        r"Port\s*of\s*Loading\s*[:\.]?\s*\n?\s*([^\n]{3,60})",
        r"([^\n]{3,60})\s*\n\s*Port\s*of\s*Loading",
        exact(r"(?:선적항)\s*[:\.]?\s*([^\n]{3,60})"),
    ],
    "port_of_discharge": [
        r"Port\s*of\s*(?:Discharge|Destination)\s*[:\.]?\s*\n?\s*([^\n]{3,60})",
        r"([^\n]{3,60})\s*\n\s*Port\s*of\s*(?:Discharge|Destination)",
        exact(r"(?:도착항|양륙항|목적항)\s*[:\.]?\s*([^\n]{3,60})"),
    ],
    "valid_until": [
        r"Valid\s*Until\s*[:\.]?\s*\n?\s*" + _DAY,
        _DAY + r"\s*\n\s*Valid\s*Until",
    ],
    "gross_weight": [
        rf"([0-9,\.]+)\s*{_MASS}\s*\n\s*(?:Gross\s*W(?:eigh)?t|Total\s*Gross\s*W(?:eigh)?t)",
        rf"(?:Total\s*)?Gross\s*W(?:eigh)?t\.?\s*[:\.]?\s*([0-9,\.]+)\s*{_MASS}?",
        rf"\bG\.W\.?\s*[:\.]?\s*([0-9,\.]+)\s*{_MASS}?",
        exact(rf"(?:총중량)\s*[:\.]?\s*([0-9,\.]+)\s*{_MASS}?"),
    ],
    "net_weight": [
        rf"([0-9,\.]+)\s*{_MASS}\s*\n\s*(?:Net\s*W(?:eigh)?t|Total\s*Net\s*W(?:eigh)?t)",
        rf"(?:Total\s*)?Net\s*W(?:eigh)?t\.?\s*[:\.]?\s*([0-9,\.]+)\s*{_MASS}?",
        rf"\bN\.W\.?\s*[:\.]?\s*([0-9,\.]+)\s*{_MASS}?",
        exact(rf"(?:순중량)\s*[:\.]?\s*([0-9,\.]+)\s*{_MASS}?"),
    ],
    "measurement": [
        r"([0-9,\.]+)\s*(M3|CBM|CFT)\s*\n\s*(?:Measurement|Total\s*Measurement)",
        r"(?:Measurement|Total\s*Measurement|CBM|용적)\s*[:\.]?\s*([0-9,\.]+)\s*(M3|CBM|CFT)?",
        r"\bTOTAL\b[^\n]*?([0-9][0-9,\.]*)\s*(M3|CBM|CFT)\b",
    ],
    "n_packages": [
        rf"(\d+)\s+{_PACKS}\s*\n\s*Total\s*Packages",
        rf"(?:Number\s*of\s*Packages|Total\s*Packages|Packages|박스\s*수)\s*[:\.]?\s*(\d+)\s*{_PACKS}?",
    ],
    "marks_numbers": [
        r"([A-Z]{2,6}/\d+\s*-\s*\d+)\s*\n\s*Marks",
        r"Marks\s*(?:&|and)\s*Numbers\s*[:\.]?\s*([^\n]{3,60})",
    ],
}

#: Parties where the value may stand before its label.
REVERSE_SELLER = [
    r"(?:^|\n|\t)(?:Shipper\s*/\s*(?:Seller|Exporter|Consignor)|Seller\s*/\s*(?:Shipper|Exporter)|Exporter\s*/\s*(?:Seller|Shipper)|Consignor\s*/\s*Shipper)\s*[:\.]?\s+([A-Za-z가-힣\(㈜][^\n\t|]{4,200}?)(?=\s*(?:\t|\||\n|Consignee|Buyer|Customer|Importer))",
    r"(?:^|\n|\t)" + _SELLING + r"\s+([A-Za-z가-힣\(㈜][^\n\t|]{4,200}?)(?=\s*(?:\t|\||\n|Invoice\s*No|L/C\s*No|Consignee|Buyer|Customer|Importer))",
    _SELLING + r"\s*[:\.]\s*([^|\n\t]{5,150}?)(?=\s*(?:\t|\||$|Consignee|Buyer|Customer|Importer|Invoice\s*No))",
    _SELLING_ANY + r"\s*[:\.]?\s*\n\s*([^\n\t|]{5,250}?)(?=\s*(?:\t|\||\n|$))",
    _SELLING_ANY + r"\s*[:\.]?\s*\n\s*([^\n]{5,250})",
    _SELLING + r"\s*[:\.]\s*([^\n]{5,250})",
    r"([A-Za-z가-힣(㈜][^\n]{3,250})\s*\n\s*" + _SELLING + r"(?!\s*Bank)",
    r"(?:From|Sold\s*By)\s*[:\.]\s*([^\n]{3,200})",
]
REVERSE_BUYER = [
    r"(?:^|\n|\t)(?:Consignee\s*/\s*(?:Buyer|Importer|Customer)|Buyer\s*/\s*(?:Consignee|Importer)|Importer\s*/\s*(?:Buyer|Consignee))\s*[:\.]?\s+([A-Za-z가-힣\(㈜][^\n\t|]{4,200}?)(?=\s*(?:\t|\||\n|PL\s*No|Invoice\s*No|Description|Notify|Vendor|Seller|Shipper|Port))",
    r"(?:^|\n|\t)" + _BUYING + r"\s+([A-Za-z가-힣\(㈜][^\n\t|]{4,200}?)(?=\s*(?:\t|\||\n|Invoice\s*No|L/C\s*No|PL\s*No|Description|Notify))",
    _BUYING + r"\s*[:\.]\s*([^|\n\t]{5,150}?)(?=\s*(?:\t|\||$|PL\s*No|Invoice\s*No|Date|Description|Notify))",
    _BUYING_ANY + r"\s*[:\.]?\s*\n\s*([^\n\t|]{5,250}?)(?=\s*(?:\t|\||\n|$))",
    _BUYING_ANY + r"\s*[:\.]?\s*\n\s*([^\n]{5,250})",
    _BUYING + r"\s*[:\.]\s*([^\n]{5,250})",
    r"([A-Za-z가-힣(㈜][^\n]{3,250})\s*\n\s*" + _BUYING + r"(?!\s*\.)",
    r"(?:To|Sold\s*To|Bill\s*To|Messrs)\s*[:\.]\s*([^\n]{3,200})",
]

#: Layouts of forms; they fill what the header patterns leave open.
_NAME = r"([A-Z][A-Z0-9\s\.,&\-]{4,80}?)"
_MONEY = "USD|EUR|KRW|JPY|GBP|CNY|HKD|SGD"
FORM = {
    "invoice_no": [
        r"\bINVOICE\s+NO\.?\s*[:.]?\s*([A-Z][A-Z0-9\-]{3,30})",
        r"\bINVOICE\s*NO\s*/\s*DATE\s+([A-Z][A-Z0-9\-]{3,30})",
    ],
    "pl_no": [
        r"\bPL\s+No\.?\s*[:.]?\s*([A-Z][A-Z0-9\-]{3,30})",
        r"\bP/L\s+No\.?\s*[:.]?\s*([A-Z][A-Z0-9\-]{3,30})",
        r"\bPL\s*NO\s*/\s*DATE\s+([A-Z][A-Z0-9\-]{3,30})",
    ],
    "date": [
        exact(r"(?:^|\s|\n|\t|\|)(?:DATE|Date)\s*[:\.]?\s+(\d{4}[-./]\d{1,2}[-./]\d{1,2})\b"),
        r"\bPL\s*NO\s*/\s*DATE\s+\S+\s+(\d{4}[-./]\d{1,2}[-./]\d{1,2})",
        r"\bINVOICE\s*NO\s*/\s*DATE\s+\S+\s+(\d{4}[-./]\d{1,2}[-./]\d{1,2})",
    ],
    "currency": [
        exact(rf"\b({_MONEY})\s+\d"),
        rf"Currency\s*[:.]?\s+({_MONEY})\b",
    ],
    "buyer": [
        rf"CONSIGNEE\s*/\s*BILL\s*TO\s+{_NAME}\s+(?=INVOICE\s*NO|VESSEL|DATE|PAYMENT|TOTAL|TERMS\s*OF|$)",
        rf"BUYER\s*/\s*IMPORTER\s+{_NAME}\s+(?=Invoice\s*Ref|Transport|Description|SELLER|$)",
        rf"\bBILL\s+TO\s+{_NAME}\s+(?=INVOICE\s*NO|VESSEL|DATE|PAYMENT|$)",
    ],
    "seller": [
        rf"SELLER\s*/\s*EXPORTER\s+{_NAME}\s+(?=BUYER|IMPORTER|Invoice\s*Ref|Transport|$)",
        rf"(?m)^\s*{_NAME}\s+INVOICE\b",
        r"\bEXPORTER\s+([A-Za-z][A-Za-z0-9\s\.,&\-]{4,80}?)\s*[\t]\s*(?:PL\s*NO|INVOICE\s*NO)",
    ],
    "incoterms": [rf"TERMS\s+OF\s+SALE\s+({_TERM})\s+([A-Z][A-Z\s]{{2,40}}?)\s*\(?"],
    "gross_weight": [r"\bTOTAL\b[^\n]*?[\d,\.]+\s*KGS?\s+([\d,\.]+)\s*KGS?\s+[\d,\.]+\s*(?:M3|CBM|CFT)"],
    "net_weight": [r"\bTOTAL\b[^\n]*?\b([\d,\.]+)\s*KGS?\s+[\d,\.]+\s*KGS?\s+[\d,\.]+\s*(?:M3|CBM|CFT)"],
}

#: Lower-case parts of which every match of a field's patterns holds one.
MARKS = {
    "invoice_no": ("invoice", "번호"), "order_no": ("po", "p.o", "order", "purchase", "번호"), "packing_no": ("packing", "pl", "p/l", "번호"), "pl_no": ("pl", "p/l"),
    "quotation_no": ("quotation", "proforma"), "date": ("date", "발행일", "일자"), "ship_to": ("ship", "delivery", "배송지"), "payment_terms": ("payment", "지급조건", "결제조건"),
    "delivery_date": ("delivery", "required", "납기"), "incoterms": tuple(_TERM.lower().split("|")), "total_amount": ("total", "합계", "총액"),
    "currency": ("currency", "통화", *_MONEY.lower().split("|")), "country_of_origin": ("origin", "원산지"), "hs_code": ("code", "number"),
    "port_of_loading": ("loading", "선적항"), "port_of_discharge": ("discharge", "destination", "도착항", "양륙항", "목적항"), "valid_until": ("until",),
    "gross_weight": ("gross", "g.w", "총중량", "total"), "net_weight": ("net", "n.w", "순중량", "total"), "measurement": ("measurement", "cbm", "용적", "total"),
    "n_packages": ("packages", "박스"), "marks_numbers": ("marks",),
    "seller": ("seller", "vendor", "shipper", "consignor", "exporter", "수출자", "매도인", "공급자", "송하인", "from", "sold", "invoice"),
    "buyer": ("buyer", "customer", "consignee", "importer", "수입자", "매수인", "구매자", "수하인", "to", "messrs"),
}

#: Labels and headings that are no values.
LABELS = (
    "invoice no.", "invoice number", "invoice date", "po no.", "order no.", "purchase order", "packing list",
    "proforma invoice", "quotation", "valid until", "seller", "buyer", "vendor", "customer", "shipper",
    "consignee", "ship to", "bill to", "port of loading", "port of discharge", "port of destination",
    "payment terms", "delivery date", "required delivery date", "incoterms", "country of origin", "currency",
    "total", "total amount", "grand total", "total quotation", "gross weight", "net weight", "measurement", "cbm",
    "number of packages", "total packages", "marks & numbers", "parties", "goods description", "packing details",
    "ordered items", "quoted items", "ref", "ref:",
)
LABEL_STARTS = (
    "invoice", "po ", "order", "packing", "proforma", "port of", "place of", "payment", "delivery",
    "seller", "buyer", "vendor", "shipper", "consignee", "total", "gross", "net", "number of", "marks",
    "country of", "currency", "incoterms",
)
#: Fields whose short numbers are accepted, and values that are only a way to get in touch.
SHORT_NUMBERS = ("gross_weight", "net_weight", "measurement", "n_packages", "total_amount", "total_quantity", "quantity")
CONTACTS = (
    r"^\s*(Tel|Fax|Email|Phone|Contact)\s*[:\.]",
    r"^\s*\d{2,4}[-]?\d{3,4}[-]?\d{4}",
    r"^\s*\([\d\s\-]+\)",
    r"^[^\w]{0,3}\s*\d",
)

#: The block of parties, its labels, and the line of an item.
PARTY_LABELS = (
    r"^(Port|Payment|Delivery|Incoterms|Currency|Country|Parties|Goods|Ordered|Quoted|Items|Packing|Weight|"
    r"Marks|Total|Ship|Seller|Buyer|Vendor|Customer|Consignee|Shipper)\b"
)
PARTY_CONTACT = r"^(Tel|Fax|Email|Contact)\s*[:\.]"
PARTY_BLOCK_CHARS = 1500
ITEM_LINE = r"(?m)^([A-Za-z가-힣].{3,60})\s+(\d+(?:\.\d+)?)\s+([0-9,\.]+)\s+([0-9,\.]+)\s*$"
ITEM_HEADER = r"(description|quantity|unit price|amount|품명|수량|단가|금액)"

#: What each kind must have.
ESSENTIAL = {
    "CommercialInvoice": ("invoice_no", "date", "seller", "buyer"),
    "ProformaInvoice": ("seller", "buyer"),
    "PurchaseOrder": ("order_no", "seller", "buyer"),
    "PackingList": ("seller", "buyer"),
}


def reverse() -> dict[str, list]:
    """The header patterns with the value before the label tried first."""
    swapped = {name: [*reversed(patterns[:2]), *patterns[2:]] for name, patterns in FORWARD.items()}
    return swapped | {"seller": REVERSE_SELLER, "buyer": REVERSE_BUYER}
