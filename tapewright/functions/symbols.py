"""Contract symbols as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: month codes in calendar order, symbol layout, two-digit year base
MONTH_CODES = "FGHJKMNQUVXZ"
SYMBOL = rf"^([A-Z0-9]{{1,5}}?)([{MONTH_CODES}])(\d{{2}})$"
CENTURY = 2000


def parse_symbol(symbol: Column, known_roots: list[str]) -> dict[str, Column]:
    """Root, month code, delivery month and confidence; the right end anchors the parse."""
    text = F.upper(F.trim(symbol))
    parsed = text.rlike(SYMBOL)
    root = F.when(parsed, F.regexp_extract(text, SYMBOL, 1))
    code = F.when(parsed, F.regexp_extract(text, SYMBOL, 2))
    year = F.when(parsed, F.regexp_extract(text, SYMBOL, 3)).cast("int") + CENTURY
    month = F.instr(F.lit(MONTH_CODES), code)
    return {
        "root": root,
        "month_code": code,
        "contract_month": F.when(parsed, F.make_date(year, month, F.lit(1))),
        "parse_confidence": F.when(~F.coalesce(parsed, F.lit(False)), 0.0)
        .when(root.isin(known_roots), 1.0)
        .otherwise(0.7),
    }
