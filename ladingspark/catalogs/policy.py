"""Weights of the search, limits of the checks and wording of the reports."""

from __future__ import annotations

#: The search.
QUERY_WORDS, QUERY_ADDED, QUERY_PREFIX = ("liability", "risk", "mandatory", "exclude"), " mandatory provision liability exclusion", "query: "
OVERFETCH, SEEDS, GRADED, RESULTS = 2, 3, 3, 10
MANDATORY_BOOST, EDGE_BOOST, MOST_EDGE_BOOST, MOST_SCORE, NEIGHBOUR_SCORE = 15.0, 5.0, 15.0, 100.0, 75.0
NEIGHBOUR_REASON = "Graph Neighbor of "
CONTENT_CHARS = 1000

#: The checks.
LEAST_COVERAGE, TOLERANCE = 110, 0.01
PASS, FAIL, WARNING, UNKNOWN, ERROR = "PASS", "FAIL", "WARNING", "UNKNOWN", "ERROR"
COVER_TERMS = ("CIF", "CIP")
NOT_BY_AIR = "FOB"

#: Wording.
NOT_KNOWN = "미확인"
NO_FACTS, NOT_CHECKED = "검증 데이터 없음", "수치 검증 수행 불가"
ICONS = {"FAIL": "❌ [결함 적발] ", "PASS": "✅ [정상 확인] "}
OTHER_ICON = "⚠️ ["
NO_DEFECT = "✅ 수치 및 날짜상 명백한 하자는 발견되지 않았습니다.\n"
FACTS_TITLE, DEAL_TITLE, INPUT_TITLE = "### 🚨 [시스템 팩트 체크 결과]\n", "### 📋 [기본 거래 정보 요약]\n", "### 📊 [Input Data Summary]\n"
RISKS = ("위험", "주의", "적합")
VERDICT_RULE, VERDICT_TITLE, PREP_TITLE, JUDGMENT_TITLE = "═" * 60, "⚖️  최종 법적 판단", "📋 [1단계: 서류 사전 분석]", "⚖️  [최종 판정]"
SPECIAL_TITLE = "### [이번 분석 특별 지시]"
NO_RISK = "적합"

#: What the checks say.
COVER_UNKNOWN = "보험 부보율 정보를 찾을 수 없습니다."
COVER_LOW = "보험 부보율 부족: {share}% (최소 110% 필요)"
COVER_GOOD = "보험 부보율 적정: {share}%"
AMOUNTS_UNKNOWN = "금액 정보(LC/Invoice)가 누락되었습니다."
AMOUNTS_BROKEN = "금액 데이터 형식이 올바르지 않습니다."
AMOUNTS_OVER = "Invoice 금액({invoice})이 LC 금액({credit})을 초과합니다."
AMOUNTS_GOOD = "LC/Invoice 금액 정합성 확인 ({invoice} <= {credit})"
DATES_UNKNOWN = "선적 관련 날짜가 누락되었습니다."
DATES_LATE = "지연 선적 발생: 선적 마감일({latest})보다 선적일({shipped})이 늦습니다."
DATES_GOOD = "선적일 적정 ({shipped} <= {latest})"
ITEMS_UNKNOWN = "품목 상세 정보가 없어 산술 검증을 수행할 수 없습니다."
ITEMS_BROKEN = "산술 검증 중 데이터 형식 오류 발생"
ITEM_OFF = "품목 {pos} 산술 불일치: {quantity} * {price} != {amount}"
TOTAL_OFF = "총액 불일치: 상세 합계({sum}) != 명시된 총액({total}). OCR 인식 오류(콤마 유실 등)가 의심됩니다."
ITEMS_GOOD = "문서 내 수치 산술 정합성 확인 완료 (상세 합계와 총액 일치)"

#: The tables of the report.
DEAL_TABLE = """| 항목 | 내용 |
| :--- | :--- |
| **수출자** | {exporter} |
| **수입자** | {importer} |
| **선적항 / 하역항** | {loading} / {discharge} |
| **거래 조건 (Incoterms)** | {term} |
| **거래 금액** | {amount} {currency} |
| **선적 기한 / 실제 선적** | {latest} / {shipped} |
"""
INPUT_LINES = """- Incoterms: {term}
- L/C Amount: {credit}
- Invoice Total: {invoice}
- Insurance: {insurance}
"""
SPECIAL_LINE = "- Special Conditions: {special}\n"

#: Pages.
TEXT_PAGE_CHARS, TEXT_SAMPLE_PAGES, LOW_BLOCK = 50, 3, 0.7
SURE_PAGE, PAGE_CHARS, MOST_RECHECKS = 0.75, 300, 6
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".gif", ".webp")
REVIEWED = "salescontract"
FEEDBACK_MARK = "수정 지시:"
MOST_DRAFTS = 2
UPLOADS = {".txt": "text/plain", ".json": "application/json", ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".bmp": "image/bmp", ".webp": "image/webp"}
