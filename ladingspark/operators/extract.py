"""What is read from every kind of paper: amounts, dates, delivery terms, parties.

Functions take the name of a text column and return Columns; a null text gives what an empty one does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalogs import common as C
from ..functions import regexx as X


def _text(column: str) -> str:
    return f"coalesce(`{column}`, '')"


def amounts(column: str) -> Column:
    """Array of currency, value (double), raw. Figures without separators are cut after three digits; a figure that is no number is left out."""
    hits = X.hits(_text(column), C.AMOUNT)
    each = "named_struct('currency', upper(h.a), 'value', try_cast(replace(h.b, ',', '') as double), 'raw', h.raw)"
    return F.expr(f"filter(transform({hits}, h -> {each}), v -> v.value is not null)")


def dates(column: str) -> Column:
    """Array of iso, raw: both forms in turn, years 1900 to 2100, each date once. Days go up to 31 in every month."""
    found = []
    for form in C.DATES:
        good = f"int(h.a) between {C.YEARS[0]} and {C.YEARS[1]} and int(h.b) between 1 and 12 and int(h.c) between 1 and 31"
        each = "named_struct('iso', concat(h.a, '-', lpad(h.b, 2, '0'), '-', lpad(h.c, 2, '0')), 'raw', h.raw)"
        found.append(f"transform(filter({X.hits(_text(column), form, '')}, h -> {good}), h -> {each})")
    alls = f"concat({', '.join(found)})"
    first = "exists(kept, k -> k.iso = d.iso)"
    return F.expr(f"aggregate({alls}, cast(array() as array<struct<iso:string,raw:string>>), (kept, d) -> if({first}, kept, concat(kept, array(d))))")


def incoterms(column: str) -> Column:
    """Array of 'TERM Place' in the order of the list of terms, each once."""
    each = [
        f"if(contains({_text(column)}, {X.text(term)}), transform({X.hits(_text(column), rf'\b{term}\b\s*([A-Za-z가-힣]+)?', '')}, h -> trim(concat({X.text(term)}, ' ', h.a))), array())"
        for term in C.TERMS
    ]
    return F.expr(f"array_distinct(concat({', '.join(each)}))")


def parties(column: str) -> Column:
    """Struct of party_a, party_b (booleans), roles and placeholders (arrays)."""
    t = _text(column)
    roles = f"filter({X.texts(C.ROLES)}, r -> contains({t}, r))"
    places = f"slice(array_distinct(regexp_extract_all({t}, {X.pattern(C.PLACEHOLDER, '')}, 0)), 1, {C.MOST_PLACEHOLDERS})"
    named = lambda sign, p: f"contains({t}, '{sign}') and {X.like(t, p, '')}"
    return F.expr(f"named_struct('party_a', {named('갑', C.PARTY_A)}, 'party_b', {named('을', C.PARTY_B)}, 'roles', {roles}, 'placeholders', {places})")


def has_parties(struct: str) -> Column:
    return F.expr(f"{struct}.party_a or {struct}.party_b or size({struct}.roles) > 0 or size({struct}.placeholders) > 0")


def common_fields(column: str) -> Column:
    """Struct of amounts, dates, incoterms, parties."""
    return F.struct(amounts(column).alias("amounts"), dates(column).alias("dates"), incoterms(column).alias("incoterms"), parties(column).alias("parties"))


def base_confidence(common: str, has_specific: Column) -> Column:
    """Parties .25, dates .15, delivery terms .15, amounts .15, fields of the kind .30."""
    part = lambda condition, worth: F.when(condition, worth).otherwise(0.0)
    size = lambda name: F.size(F.col(f"{common}.{name}")) > 0
    total = part(has_parties(f"{common}.parties"), 0.25) + part(size("dates"), 0.15) + part(size("incoterms"), 0.15) + part(size("amounts"), 0.15)
    return F.least(total + part(has_specific, 0.30), F.lit(1.0))


def plain_share(column: str) -> Column:
    """1 less the share of ordinary characters; 1 for an empty text."""
    t = _text(column)
    return F.expr(f"if(length({t}) = 0, 1.0D, 1.0D - double(regexp_count({t}, {X.pattern(C.PLAIN_CHARACTER, '')})) / length({t}))")


def article_count(column: str) -> Column:
    return F.expr(f"size(array_distinct(regexp_extract_all({_text(column)}, {X.pattern(C.ARTICLE, '')}, 1)))")


def leaked(column: str) -> Column:
    """Whether at least two marks of an instruction are in the text."""
    t = f"lower({_text(column)})"
    return F.expr(f"size(filter({X.texts(C.LEAK_MARKS)}, m -> contains({t}, m))) >= {C.LEAST_LEAKS}")


def numbers(column: str) -> Column:
    """All numbers without commas; a sign counts only before a decimal point."""
    return F.expr(f"transform(regexp_extract_all(replace({_text(column)}, ',', ''), {X.pattern(r'[-+]?\d*\.\d+|\d+', '')}, 0), n -> double(n))")
