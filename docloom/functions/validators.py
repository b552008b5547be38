"""Validators of field and column values as boolean expressions; null is never valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: The 27 federative units of Brazil.
STATES = ("AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG", "MS", "MT", "PA", "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR", "RS", "SC", "SE", "SP", "TO")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def valid_cpf(c: Column) -> Column:
    """Eleven digits, not all the same, with both check digits right."""
    d = _digits(c)
    digit = lambda i: F.substring(d, i + 1, 1).cast("int")
    check = lambda n: F.pmod(F.pmod(sum((digit(i) * (n + 1 - i) for i in range(1, n)), digit(0) * (n + 1)) * 10, F.lit(11)), F.lit(10))
    return _sure(F.when((F.length(d) == 11) & ~d.rlike("^(.)\\1*$"), (check(9) == digit(9)) & (check(10) == digit(10))))


def valid_cep(c: Column) -> Column:
    return _sure(F.length(_digits(c)) == 8)


def valid_iso_date(c: Column) -> Column:
    """yyyy-MM-dd, yyyyMMdd, or a week date such as 2026-W03-4 and 2026W034 (day of the week optional)."""
    s = strip(c)
    year, week = F.substring(s, 1, 4).cast("int"), F.regexp_extract(s, r"W(\d{2})", 1)
    # a year has week 53 when it starts or ends on a Thursday
    long_year = F.make_date(year, F.lit(1), F.lit(1))
    thursday = (F.dayofweek(long_year) == 5) | (F.dayofweek(F.make_date(year, F.lit(12), F.lit(31))) == 5)
    weeks = F.when(thursday, 53).otherwise(52)
    return _sure(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("1 = 1") & F.try_to_date(s, "yyyy-MM-dd").isNotNull())
                 .when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd").isNotNull())
                 .when(s.rlike(r"^\d{4}(-W\d{2}(-[1-7])?|W\d{2}[1-7]?)$"), F.when(year >= 1, (week.cast("int") >= 1) & (week.cast("int") <= weeks)))) & ~s.startswith("0000")


def valid_br_date(c: Column) -> Column:
    s = strip(c)
    return _sure(F.when(s.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(s, "dd/MM/yyyy").isNotNull()) & ~s.endswith("/0000"))


def valid_email(c: Column) -> Column:
    return _sure(strip(c).rlike(r"(?U)^[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"))


def valid_phone_br(c: Column) -> Column:
    return _sure(F.length(_digits(c)).isin(10, 11))


def valid_state(c: Column) -> Column:
    return _sure(F.upper(strip(c)).isin(*STATES))


FIELD_VALIDATORS = {"cpf": valid_cpf, "cep": valid_cep, "iso_date": valid_iso_date, "br_date": valid_br_date,
                    "email": valid_email, "phone_br": valid_phone_br, "uf": valid_state}

#: Full-match shapes of typed table columns.
COLUMN_SHAPES = {
    "phone": r"\(?[0-9]{2}\)?\s*[0-9]{4,5}-?[0-9]{4}",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "date": r"[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "version": r"[0-9]+\.[0-9]+(?:\.[0-9]+)?",
    "number": r"[0-9]+",
}
#: What a name, sector or role never looks like.
MISPLACED = "|".join([COLUMN_SHAPES["date"], r"[0-9]{4}-[0-9]{2}-[0-9]{2}", *(COLUMN_SHAPES[t] for t in ("phone", "version", "email"))])


def valid_for_column(value: Column, kind: Column) -> Column:
    """Whether value fits a table column of type kind; unknown types take anything."""
    out = F.when(kind.isin("name", "sector", "role"), (value != "") & ~value.rlike(f"^(?:{MISPLACED})$")).when(kind == "free", value != "")
    for name, shape in COLUMN_SHAPES.items():
        out = out.when(kind == name, value.rlike(f"^(?:{shape})$"))
    return _sure(out.otherwise(value.isNotNull()))
