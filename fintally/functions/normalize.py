"""Import normalisation as Column expressions: dates, amounts, merchants, split amounts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fintally.formats import DEFAULT_DATE_PATTERNS

# A number as Python's float() reads it after the currency clean-up (no 'd'/'f' suffixes,
# no hex), so that try_cast never accepts text the reference rejects.
NUMERIC_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_TIME = r"([T ]\s*\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?\s*([AaPp]\.?[Mm]\.?)?\s*(Z|z|UTC|GMT|[+-]\d{2}:?\d{2})?)?"
_WEEKDAY = r"(?:(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un)[a-z]*\.?,?\s+)?"
_DAY, _MONTH = r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:0?[1-9]|1[0-2])"
_NAME = (r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
         r"|nov(?:ember)?|dec(?:ember)?)\.?")
_ORD = "(?:st|nd|rd|th)?"
#: Shapes of a date as a general parser reads them, with an optional weekday and time of day.
_GENERAL = _WEEKDAY + "(?:" + "|".join([
    rf"\d{{4}}[-/. ]{_MONTH}[-/. ]{_DAY}", rf"{_MONTH}[-/. ]{_DAY}[-/. ](?:\d{{4}}|\d{{2}})", rf"{_DAY}[-/. ]{_MONTH}[-/. ](?:\d{{4}}|\d{{2}})",
    rf"{_DAY}{_ORD}[-/ ]\s*{_NAME},?[-/ ]\s*(?:\d{{4}}|\d{{2}})", rf"{_NAME}[-/ ]\s*{_DAY}{_ORD},?[-/ ]\s*\d{{4}}", rf"\d{{4}}[-/ ]{_NAME}[-/ ]{_DAY}",
    r"\d{8}"]) + ")" + _TIME


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pattern_shape(pattern: str) -> str:
    """A regular expression for the texts that a datetime pattern (of y, M, d and separators) takes."""
    import re
    fields = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMM": _NAME, "MM": _MONTH, "M": _MONTH, "dd": _DAY, "d": _DAY}
    return "".join(fields[part] if part in fields else re.escape(part) for part in re.findall(r"y+|M+|d+|[^yMd]", pattern))


def _calendar_day(text: Column) -> Column:
    """The date that a text of one of the known shapes spells: year first if it has four digits, a month
    by its name, else month before day unless the first number is over 12. Two-digit years as
    Python reads them (69..99 -> 19xx). A day that does not exist gives NULL. One parse, interpreted
    as a whole, so generated code stays small however often it is used."""
    plain = F.regexp_replace(F.regexp_replace(text, "^" + _WEEKDAY, ""), _TIME + "$", "")
    parts = F.split(F.regexp_replace(plain, r"(\d)(?:st|nd|rd|th)\b", "$1"), "[^0-9A-Za-z]+")

    def spelled(p: Column) -> Column:
        a, b, c = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
        name = lambda x: x.rlike("^[A-Za-z]")
        number = lambda x: ((F.instr(F.lit(_MONTHS), F.lower(F.substring(x, 1, 3))) + 2) / 3).cast("int").cast("string")
        year = lambda x: F.when(F.length(x) == 2, F.concat(F.when(x >= "69", F.lit("19")).otherwise(F.lit("20")), x)).otherwise(x)
        ymd = lambda y, m, d: F.concat_ws("-", year(y), m, d)
        return (F.when(F.size(p) == 1, F.concat_ws("-", F.substring(a, 1, 4), F.substring(a, 5, 2), F.substring(a, 7, 2)))
                .when(name(a), ymd(c, number(a), b))
                .when(name(b), F.when(F.length(a) == 4, ymd(a, number(b), c)).otherwise(ymd(c, number(b), a)))
                .when(F.length(a) == 4, ymd(a, b, c))
                .when(a.try_cast("int") <= 12, ymd(c, a, b)).otherwise(ymd(c, b, a)))

    return F.transform(F.array(parts), spelled)[0].try_cast("date")


def norm_date(col, patterns=DEFAULT_DATE_PATTERNS, fallback: bool = True) -> Column:
    """The date of a text that one of ``patterns`` takes or, with ``fallback``, that has a shape a
    general parser reads (NULL otherwise). Patterns that differ only in the order of month and day
    are tried month first, as the lists have it."""
    s = F.trim(_c(col).cast("string"))
    shapes = [pattern_shape(p) for p in patterns] + ([_GENERAL] if fallback else [])
    return F.when(s.rlike("^(?:" + "|".join(shapes) + ")$"), _calendar_day(s))


def norm_date_first_token(col, patterns) -> Column:
    """Parse only the first whitespace-separated token (onboarding import)."""
    tok = F.split(F.trim(_c(col).cast("string")), r"\s+").getItem(0)
    return norm_date(tok, patterns, fallback=False)


def _clean_amount_text(col) -> Column:
    s = F.regexp_replace(F.trim(_c(col).cast("string")), r"[$,]", "")
    return F.when(F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")")),
                  F.concat(F.lit("-"), F.substring(s, 2, 2147483647).substr(F.lit(1), F.length(s) - 2))) \
        .otherwise(s)


def norm_amount(col) -> Column:
    """'$1,234.56' -> 1234.56, '(125.50)' -> -125.5; NULL when not a number."""
    t = F.trim(_clean_amount_text(col))
    return F.when(t.rlike(NUMERIC_RE), t.try_cast("double"))


def norm_amount_lenient(col) -> Column:
    """Wizard parsing: NULL, '' or '-' count as 0.0; unparseable text gives NULL (an error)."""
    raw = _c(col).cast("string")
    cleaned = F.regexp_replace(F.trim(raw), r"[$,]", "")
    return (F.when(raw.isNull() | (raw == "") | (cleaned == "") | (cleaned == "-"), F.lit(0.0))
            .otherwise(norm_amount(col)))


def norm_split_amount(debit, credit) -> Column:
    """credit - debit (wizard); NULL when both sides are unparseable."""
    d, c = norm_amount_lenient(debit), norm_amount_lenient(credit)
    return F.when(d.isNull() & c.isNull(), F.lit(None).cast("double")) \
        .otherwise(F.coalesce(c, F.lit(0.0)) - F.coalesce(d, F.lit(0.0)))


def norm_split_amount_analysis(debit, credit, account_type_variant: bool = False) -> Column:
    """Analysis variant: credit - debit when credit is non-zero, else -|debit| when debit is
    non-zero, else NULL. The account-type variant uses -debit (no abs) and never NULL."""
    d = F.coalesce(norm_amount(debit), F.lit(0.0))
    c = F.coalesce(norm_amount(credit), F.lit(0.0))
    if account_type_variant:
        return F.when(c != 0, c - d).otherwise(-d)
    return F.when(c != 0, c - d).when(d != 0, -F.abs(d))


def norm_merchant(col) -> Column:
    """Trimmed merchant text, 'UNKNOWN' when missing."""
    return F.coalesce(F.trim(_c(col).cast("string")), F.lit("UNKNOWN"))


def norm_description(col) -> Column:
    return F.trim(_c(col).cast("string"))


def onboarding_amount(col) -> Column:
    """Onboarding parse: strip '$' and ',' then trim; '(x)' is -x; empty text gives NULL."""
    s = F.trim(F.regexp_replace(_c(col).cast("string"), r"[$,]", ""))
    inner = F.substring(s, 2, 2147483647).substr(F.lit(1), F.length(s) - 2)
    paren = F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")"))
    inner_t = F.trim(inner)
    return (F.when(paren, F.when(inner_t.rlike(NUMERIC_RE), -inner_t.try_cast("double")))
            .when(s.rlike(NUMERIC_RE), s.try_cast("double")))
