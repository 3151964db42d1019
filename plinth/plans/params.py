"""Query parameters from a code string."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from plinth.functions.dictionaries import FIRST_MONTH, TOWNS

#: Least length of a code, and the area that every query has.
SHORTEST, AREA = 9, 80.0


@dataclass(frozen=True)
class Params:
    code: str
    year: int
    month: int
    month_code: int
    town_code: int
    area: float = AREA

    @property
    def town(self) -> str:
        return TOWNS[self.town_code]


def parse(code: str) -> Params:
    """The last digit but one is the year (4-9: 2014-2019, 0-3: 2020-2023); the one before it is both the month (0: October) and the town."""
    if len(code) < SHORTEST:
        raise ValueError(f"a code has {SHORTEST} characters at least")
    year_digit, month_digit = code[-2], code[-3]
    if not ("0" <= year_digit <= "9" and "0" <= month_digit <= "9"):
        raise ValueError("the second and third last characters of a code are digits")
    year = int(year_digit) + (2010 if int(year_digit) >= 4 else 2020)
    month = int(month_digit) or 10
    return Params(code, year, month, (year - FIRST_MONTH[0]) * 12 + month - FIRST_MONTH[1], int(month_digit))


def parse_columns(code: Column) -> list[Column]:
    """The same for a column of codes: year, month, month_code, town_code; null for what is no code.

    Two characters are cut out, without a pattern; give a column by name, as an expression would be computed again for each output.
    """
    m_digit, y_digit = F.substring(code, -3, 1), F.substring(code, -2, 1)
    ok = (F.length(code) >= SHORTEST) & m_digit.between("0", "9") & y_digit.between("0", "9")
    m, y = F.ascii(m_digit) - ord("0"), F.ascii(y_digit) - ord("0")
    year, month = y + F.when(y >= 4, 2010).otherwise(2020), F.when(m == 0, 10).otherwise(m)
    month_code = (year - FIRST_MONTH[0]) * 12 + month - FIRST_MONTH[1]
    return [F.when(ok, c).cast("int").alias(n) for n, c in (("year", year), ("month", month), ("month_code", month_code), ("town_code", m))]
