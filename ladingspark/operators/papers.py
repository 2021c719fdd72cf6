"""Parsers of the kinds of papers: fields, items, containers, warnings and confidence.

A parser takes a DataFrame with a text column and adds columns; `fields` is a map from a field's
name to value, unit, currency, term, place and raw. Parts that only depend on the text are
expressions, worked out in one projection. A null text is read as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogs import credit, invoice, lading
from ..catalogs.notation import exact
from ..functions import regexx as X
from ..functions.tables import elements, kept
from . import extract

#: A field that is found.
RECORD = "struct<value:string,unit:string,currency:string,term:string,place:string,raw:string>"
Patterns = dict[str, list[str | exact]]


def record(value: str, raw: str, unit: str = "''", currency: str = "''", term: str = "''", place: str = "''") -> str:
    return f"named_struct('value', {value}, 'unit', {unit}, 'currency', {currency}, 'term', {term}, 'place', {place}, 'raw', {raw})"


def tidy(value: str) -> str:
    """Lower case, without colons, full stops, dashes and blanks at the end."""
    return X.strip(f"regexp_replace(lower({X.strip(value)}), {X.text(r'(?U)[:\.\-\s]+$')}, '')")


def no_value(value: str, labels: Sequence[str], starts: Sequence[str], short_numbers: bool = False) -> str:
    """Whether a match is a label or too short to be a value."""
    short = "length(v) < 3"
    if short_numbers:
        short = f"({short} and not regexp_like(v, '^[0-9.,]+$'))"
    test = f"v = '' or array_contains({X.texts(labels)}, v) or {short} or {X.starts_with_any('v', starts)}"
    return f"exists(array({tidy(value)}), v -> {test})"


def contact_only(value: str) -> str:
    return "(" + " or ".join(X.like(value, p, "i") for p in invoice.CONTACTS) + ")"


def no_invoice_value(value: str, field: str) -> str:
    out = no_value(value, invoice.LABELS, invoice.LABEL_STARTS, field in invoice.SHORT_NUMBERS)
    return f"({out} or {contact_only(value)})" if field in ("seller", "buyer") else out


def cleaned(value: str, until_cell: bool = False) -> str:
    plain = X.strip(f"regexp_replace(regexp_replace({X.strip(value)}, ',+$', ''), {X.text(r'\.+$')}, '')")
    return f"regexp_replace({plain}, {X.text(r'(?Ud)\s*[\t|]\s*.*$' if until_cell else r'(?Ud)\s*\([^\)]*$')}, '')"


#: The column with the lower-case text that the parsers look for marks in.
LOWER = "_lower"


def as_record(found: str, make: str) -> str:
    """make over the hit h, or null."""
    return f"transform(array({found}), h -> if(h is null, cast(null as {RECORD}), cast({make} as {RECORD})))[0]"


def invoice_field(t: str, field: str, patterns: Sequence[str | exact]) -> str:
    if field == "total_amount":
        return as_record(X.first(t, patterns, "h.b <> ''", invoice.MARKS[field], LOWER), record("replace(h.b, ',', '')", "h.raw", currency="h.a"))
    if field == "incoterms":
        return as_record(X.first(t, patterns, "true", invoice.MARKS[field], LOWER), record("upper(h.a)", "h.raw", term="upper(h.a)", place=X.strip("h.b")))
    if field in ("gross_weight", "net_weight", "measurement", "n_packages"):
        value = X.strip("replace(h.a, ',', '')")
        return as_record(X.first(t, patterns, f"not {no_invoice_value(value, field)}", invoice.MARKS[field], LOWER), record(value, "h.raw", unit="h.b"))
    return as_record(X.first(t, patterns, f"not {no_invoice_value('h.a', field)}", invoice.MARKS[field], LOWER), record(X.strip("h.a"), "h.raw"))


def invoice_form_field(t: str, field: str) -> str:
    patterns = invoice.FORM[field]
    if field == "incoterms":
        place = X.strip("h.b")
        return as_record(X.first(t, patterns, "true", invoice.MARKS[field], LOWER), record(f"trim(concat(upper(h.a), ' ', {place}))", "h.raw", term="upper(h.a)", place=place))
    value = cleaned("h.a")
    return as_record(X.first(t, patterns, f"not {no_invoice_value(value, field)}", invoice.MARKS[field], LOWER), record(value, "h.raw"))


def party_block(t: str) -> str:
    """The first two lines that look like names in the block under "Parties"."""
    at = f"regexp_instr({t}, '(?i)Parties')"
    tail = f"substring({t}, {at} + 7, {invoice.PARTY_BLOCK_CHARS})"
    lines = f"transform(split({tail}, '\\n', -1), l -> {X.strip('l')})"
    name = " and ".join([
        "length(l) >= 5", f"not {X.like('l', invoice.PARTY_LABELS, 'i')}", f"not {X.like('l', invoice.PARTY_CONTACT, 'i')}",
        f"not {X.like('l', r'^[\d\-/.\s()]+$', '')}", f"not {X.like('l', r'^\d{4}[-./]\d{1,2}[-./]\d{1,2}$', '')}", f"{X.like('l', r'^[A-Z가-힣(㈜]', '')}",
    ])
    return f"if({at} = 0, cast(array() as array<string>), slice(filter({lines}, l -> {name}), 1, 2))"


def fallback_party(t: str, place: int) -> str:
    return f"transform(array({party_block(t)}), p -> if(size(p) >= {place}, cast({record(f'p[{place - 1}]', X.text('[fallback]'))} as {RECORD}), null))[0]"


def items(column: str) -> Column:
    """Array of description, quantity, unit_price, amount, raw: lines that end in three figures."""
    # A match is whole lines, so that its own text matches in the same way.
    line = X.pattern(invoice.ITEM_LINE, "")
    lines = f"regexp_extract_all(coalesce(`{column}`, ''), {line}, 0)"
    group = lambda k: f"regexp_extract(x, {line}, {k})"
    number = lambda v: f"try_cast(replace({v}, ',', '') as double)"
    each = f"named_struct('description', {X.strip(group(1))}, 'quantity', {number(group(2))}, 'unit_price', {number(group(3))}, 'amount', {number(group(4))}, 'raw', x)"
    good = f"i.quantity is not null and i.unit_price is not null and i.amount is not null and not {X.like('i.description', invoice.ITEM_HEADER, 'i')}"
    return F.expr(f"filter(transform({lines}, x -> {each}), i -> {good})")


def field_map(found: dict[str, str]) -> Column:
    """The fields that are found, in the catalogue's order."""
    entries = ", ".join(f"named_struct('key', {X.text(name)}, 'value', {sql})" for name, sql in found.items())
    return F.expr(f"map_from_entries(filter(array({entries}), e -> e.value is not null))")


def key_fields(fields: str, first_of: Sequence[str] = ("value", "term", "raw")) -> Column:
    """Flat map from a field to its first part that is not empty."""
    parts = ", ".join(f"nullif(v.{p}, '')" for p in first_of)
    return F.expr(f"transform_values({fields}, (k, v) -> coalesce({parts}))")


def warning_missing(absent: str) -> str:
    return f"if(size({absent}) > 0, array(concat('MISSING_FIELDS:', upper(array_join({absent}, ',')))), cast(array() as array<string>))"


def with_common(docs: DataFrame, text: str) -> DataFrame:
    """docs with common and the lower-case text."""
    return docs.withColumn("common", extract.common_fields(text)).withColumn(LOWER, F.lower(F.coalesce(F.col(text), F.lit(""))))


def parse_invoice_like(docs: DataFrame, kind: str | Column, text: str = "text", label_first: bool | None = None) -> DataFrame:
    """fields, items, key_fields, warnings, confidence, common; kind: one of invoice.ESSENTIAL, or a column of them.

    label_first: whether the label is tried before the value; by default for orders alone.
    """
    if label_first is None:
        label_first = isinstance(kind, str) and kind == "PurchaseOrder"
    catalogue = invoice.FORWARD if label_first else invoice.reverse()
    t = f"coalesce(`{text}`, '')"
    found = {name: invoice_field(t, name, patterns) for name, patterns in catalogue.items()}
    for name in invoice.FORM:
        form = invoice_form_field(t, name)
        found[name] = f"coalesce({found[name]}, {form})" if name in found else form
    found["seller"] = f"coalesce({found['seller']}, {fallback_party(t, 1)})"
    # Of the names in the block, the buyer is the second even where the seller was found elsewhere.
    found["buyer"] = f"coalesce({found['buyer']}, {fallback_party(t, 2)})"
    out = with_common(docs, text).withColumn("_kind", F.lit(kind) if isinstance(kind, str) else kind)
    out = out.withColumns({"fields": field_map(found), "items": items(text)})
    nothing = "cast(array() as array<string>)"
    needed = "case _kind " + " ".join(f"when {X.text(k)} then {X.texts(names)}" for k, names in invoice.ESSENTIAL.items()) + f" else {nothing} end"
    absent = f"filter({needed}, n -> not map_contains_key(fields, n))"
    weight = "map_contains_key(fields, 'gross_weight') or map_contains_key(fields, 'net_weight')"
    only_packing = lambda ok, word: f"if(_kind = 'PackingList' and not ({ok}), array('{word}'), {nothing})"
    warnings = [warning_missing(absent), f"if(size(items) = 0, array('NO_ITEMS_DETECTED'), {nothing})", only_packing(weight, "NO_WEIGHT_INFO"), only_packing("map_contains_key(fields, 'measurement')", "NO_MEASUREMENT")]
    n = F.size("fields")
    score = F.when(n >= 6, 0.5).when(n >= 3, 0.3).when(n >= 1, 0.15).otherwise(0.0) + F.least(F.lit(0.3), F.size("items") * 0.05)
    score += F.when(F.size("common.incoterms") > 0, 0.1).otherwise(0.0) + F.when(F.size("common.amounts") > 0, 0.1).otherwise(0.0)
    return out.withColumns({"key_fields": key_fields("fields"), "warnings": F.expr(f"concat({', '.join(warnings)})"), "confidence": F.least(score, F.lit(1.0))}).drop(LOWER, "_kind")


def lading_field(t: str, field: str, patterns: Sequence[str | exact]) -> str:
    two = all(X.groups_in(p) == 2 for p in patterns)
    accept = f"not {no_value('h.a', lading.LABELS, lading.LABEL_STARTS)}"
    return as_record(X.first(t, patterns, accept, lading.MARKS[field], LOWER), record(X.strip("h.a"), "h.raw", unit="h.b" if two else "''"))


def lading_form_field(t: str, field: str, patterns: Sequence[str | exact], group: str = "a") -> str:
    value = cleaned(f"h.{group}", until_cell=True)
    return as_record(X.first(t, patterns, f"not {no_value(value, lading.LABELS, lading.LABEL_STARTS)}", lading.MARKS[field], LOWER), record(value, "h.raw"))


def by_air(text: str) -> Column:
    t = f"coalesce(`{text}`, '')"
    return F.expr(f"{X.contains_any(f'upper({t})', lading.BY_AIR_UPPER)} or {X.contains_any(t, lading.BY_AIR)}")


def containers(text: str) -> Column:
    return F.expr(f"array_distinct(regexp_extract_all(coalesce(`{text}`, ''), {X.pattern(lading.CONTAINER, '')}, 1))")


def parse_lading(docs: DataFrame, text: str = "text") -> DataFrame:
    """fields, key_fields, is_air_waybill, transport_mode, containers, warnings, confidence, common."""
    t = f"coalesce(`{text}`, '')"
    found = {name: lading_field(t, name, patterns) for name, patterns in lading.FIELDS.items()}
    for name, patterns in lading.FORM.items():
        found[name] = f"coalesce({found[name]}, {lading_form_field(t, name, patterns)})"
    for name, group in (("vessel", "a"), ("voyage", "b")):  # a form says these best
        found[name] = f"coalesce({lading_form_field(t, name, lading.VESSEL_AND_VOYAGE, group)}, {found[name]})"
    out = with_common(docs, text).withColumn("fields", field_map(found)).withColumn("key_fields", key_fields("fields", ("value", "raw")))
    out = out.withColumn("is_air_waybill", by_air(text)).withColumn("transport_mode", F.when(F.col("is_air_waybill"), "air").otherwise("sea")).withColumn("containers", containers(text))
    has = lambda name: f"map_contains_key(fields, '{name}')"
    absent = f"array_compact(array(if({has('bl_number')} or {has('awb_number')}, null, 'BL_AWB_NUMBER'), if({has('shipper')}, null, 'SHIPPER'), if({has('consignee')}, null, 'CONSIGNEE')))"
    n = F.size("fields")
    score = F.when(n >= 8, 0.85).when(n >= 5, 0.65).when(n >= 3, 0.45).when(n >= 1, 0.2).otherwise(0.0) + F.when(F.size("containers") > 0, 0.1).otherwise(0.0)
    return out.withColumn("warnings", F.expr(warning_missing(absent))).withColumn("confidence", F.least(score, F.lit(1.0))).drop(LOWER)


def swift_fields(t: str) -> str:
    """Entries name, (code, value) of a message: cut before each code, with the label after the code left out.

    A value ends where the next code starts; on the code's own line it ends at a colon. Of a
    repeated field the last value counts.
    """
    pieces = f"filter(split({t}, {X.text(r'(?Ud)(?=' + credit.SWIFT_CODE + ')')}, -1), p -> {X.like('p', '^' + credit.SWIFT_CODE, '')})"
    code = f"regexp_extract(p, {X.text(r'^:(\d{2}[A-Z]?):')}, 1)"
    rest = f"regexp_replace(p, {X.text(r'(?Ud)^:\d{2}[A-Z]?:\s*(?:' + credit.SWIFT_LABEL + ')?')}, '')"
    value = X.strip(f"regexp_replace({rest}, {X.text(r'(?Ud)^([^\n:]+):[^\n]*')}, '$1')")
    names = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in credit.SWIFT_NAMES.items()) + ")"
    return f"transform({pieces}, p -> named_struct('name', coalesce(try_element_at({names}, {code}), concat('field_', {code})), 'code', {code}, 'value', {value}))"


def narrative_field(t: str, field: str, patterns: Sequence[str | exact]) -> str:
    if field == "amount":
        return as_record(X.first(t, patterns, "true", credit.MARKS[field], LOWER), record("replace(h.b, ',', '')", "h.raw", currency="upper(h.a)"))
    return as_record(X.first(t, patterns, f"not {no_value('h.a', credit.LABELS, credit.LABEL_STARTS)}", credit.MARKS[field], LOWER), record(X.strip("h.a"), "h.raw"))


def parse_credit(docs: DataFrame, text: str = "text") -> DataFrame:
    """format, swift (entries), fields (in words), key_fields, warnings, confidence, common.

    Written "\\n" are line feeds here. A currency and amount in one field are split where either is missing.
    """
    out = with_common(docs, text).withColumn("_t", F.expr(f"replace(coalesce(`{text}`, ''), {X.text(chr(92) + 'n')}, {X.text(chr(10))})"))
    out = out.withColumn("swift", F.expr(swift_fields("_t"))).withColumn("format", F.when(F.size("swift") >= credit.SWIFT_LEAST, "swift_mt700").otherwise("narrative"))
    found = {name: narrative_field("_t", name, patterns) for name, patterns in credit.NARRATIVE.items()}
    swift = F.col("format") == "swift_mt700"
    out = out.withColumn("fields", F.when(~swift, field_map(found)))
    last = "aggregate(swift, cast(map() as map<string,string>), (m, e) -> map_concat(map_filter(m, (k, v) -> k <> e.name), map(e.name, e.value)))"
    words = "transform_values(fields, (k, v) -> coalesce(nullif(v.value, ''), v.raw))"
    with_currency = f"transform(array({words}), m -> if(map_contains_key(fields, 'amount') and fields['amount'].currency <> '' , map_concat(map_filter(m, (k, v) -> k <> 'currency'), map('currency', fields['amount'].currency)), m))[0]"
    out = out.withColumn("_flat", F.when(swift, F.expr(last)).otherwise(F.expr(with_currency)))
    pair = X.strip("coalesce(try_element_at(_flat, 'currency_amount'), '')")
    part = lambda k: f"regexp_extract({pair}, {X.pattern(credit.CURRENCY_AMOUNT, '')}, {k})"
    extra = lambda name, k: f"if(not map_contains_key(_flat, '{name}') and {part(k)} <> '', map('{name}', {part(k)}), cast(map() as map<string,string>))"
    out = out.withColumn("key_fields", F.expr(f"map_concat(_flat, {extra('currency', 1)}, {extra('amount', 2)})"))
    has = lambda *names: " or ".join(f"map_contains_key(key_fields, '{n}')" for n in names)
    wanted = (("LC_NUMBER", ("lc_number", "documentary_credit_number")), ("APPLICANT", ("applicant",)), ("BENEFICIARY", ("beneficiary",)), ("AMOUNT", ("amount", "currency_amount")))
    absent = "array_compact(array(" + ", ".join(f"if({has(*names)}, null, '{label}')" for label, names in wanted) + "))"
    n = F.size("key_fields")
    score = F.when(n >= 10, 0.8).when(n >= 5, 0.6).when(n >= 3, 0.4).when(n >= 1, 0.2).otherwise(0.0)
    for condition in (F.size("common.dates") > 0, F.size("common.amounts") > 0, extract.has_parties("common.parties")):
        score += F.when(condition, 0.05).otherwise(0.0)
    out = out.withColumn("warnings", F.expr(warning_missing(absent))).withColumn("confidence", F.least(score, F.lit(1.0)))
    return out.drop("_t", "_flat", LOWER)


def long_fields(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row a field: keep, pos, field, value, unit, currency, term, place, raw."""
    rows = elements(parsed, keep, F.map_entries("fields"))
    return rows.select(*keep, "pos", F.col("_e.key").alias("field"), *[F.col(f"_e.value.{c}").alias(c) for c in ("value", "unit", "currency", "term", "place", "raw")])


def long_items(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row an item: keep, pos (from 1) and the item's columns."""
    return elements(parsed, keep, "items").select(*keep, (F.col("pos") + 1).alias("pos"), "_e.*")


Parser = Callable[[DataFrame, Column, str], DataFrame]
#: Parsers and the kinds that each reads; a parser takes papers, their kind and the name of the text column. More are registered here.
PARSERS: list[tuple[tuple[str, ...], Parser]] = [
    (("CommercialInvoice", "ProformaInvoice", "PackingList"), lambda docs, kind, text: parse_invoice_like(docs, kind, text, label_first=False)),
    (("PurchaseOrder",), lambda docs, kind, text: parse_invoice_like(docs, kind, text, label_first=True)),
    (("BillOfLading",), lambda docs, kind, text: parse_lading(docs, text)),
    (("LetterOfCredit",), lambda docs, kind, text: parse_credit(docs, text)),
]


def register(kinds: tuple[str, ...], parser: Parser) -> None:
    """Kinds that were read by another parser are read by this one from now on."""
    PARSERS.append((kinds, parser))


def parse_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """What is read from papers of no known kind: common and confidence."""
    out = with_common(docs, text).withColumn("key_fields", F.expr("cast(map() as map<string,string>)")).withColumn("warnings", F.expr("cast(array() as array<string>)"))
    return out.withColumn("confidence", extract.base_confidence("common", F.lit(False))).drop(LOWER)


def parse(docs: DataFrame, kind_column: str = "doc_type", text: str = "text") -> DataFrame:
    """docs with common, key_fields, warnings and confidence by the parser of each row's kind; papers of no kind get the base parser.

    The rows are stored once with their kinds; each parser then reads its own rows in a branch of its
    own, so that no plan holds all parsers' patterns and no row meets patterns of other kinds. A stream
    is parsed batch by batch, in foreachBatch.
    """
    parts = ("common", "key_fields", "warnings", "confidence")
    # The row goes as one struct, so that its columns can't clash with a parser's.
    rows = kept(docs.select(F.struct("*").alias("_row"), F.col(kind_column).alias("_doc_type"), F.col(text).alias("_own")))
    claimed: set[str] = set()
    branches = []
    for kinds, parser in reversed(PARSERS):  # of two parsers of a kind the later one reads it
        own = sorted(set(kinds) - claimed)
        claimed |= set(own)
        if own:
            branches.append(parser(rows.filter(F.col("_doc_type").isin(*own)), F.col("_doc_type"), "_own"))
    branches.append(parse_base(rows.filter(~F.coalesce(F.col("_doc_type").isin(*claimed), F.lit(False))), "_own"))
    read = [b.select("_row", *parts) for b in branches]
    return reduce(DataFrame.unionByName, read).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], *parts)
