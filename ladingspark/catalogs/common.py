"""Values that all kinds of papers share."""

from __future__ import annotations

#: Delivery terms in the order they are reported, currencies, figures and dates.
TERMS = ("EXW", "FCA", "FAS", "FOB", "CFR", "CIF", "CPT", "CIP", "DAP", "DPU", "DDP", "DAT")
CURRENCIES = ("USD", "KRW", "EUR", "JPY", "CNY", "GBP", "HKD", "SGD")
AMOUNT = rf"({'|'.join(CURRENCIES)})\s*([0-9]{{1,3}}(?:[,\.][0-9]{{3}})*(?:\.[0-9]{{1,2}})?)"
DATES = (
    r"(\d{4})[-./\s]?(\d{1,2})[-./\s]?(\d{1,2})",
    r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일",
)
YEARS = (1900, 2100)

#: Korean parties.
PARTY_A = r"[“\"]갑[”\"]|\b갑\b"
PARTY_B = r"[“\"]을[”\"]|\b을\b"
ROLES = ("구매자", "공급자", "수입자", "수출자", "매도인", "매수인", "위탁자", "수탁자")
PLACEHOLDER = r"@[가-힣]+[12]?"
MOST_PLACEHOLDERS = 10

#: Marks of an instruction that a model repeats, characters that text is made of, and article numbers.
LEAK_MARKS = ("do not correct", "preserve line breaks", "unreadable", "output only", "read the image", "rules (strict)", "output format", "[system_prompt]")
LEAST_LEAKS = 2
PLAIN_CHARACTER = r"[A-Za-z0-9가-힣\s.,:;()/\-+*#@%'\"!?\[\]{}<>\\&=$^`~|_·①-⑳]"
ARTICLE = r"제\s*(\d+)\s*조"
