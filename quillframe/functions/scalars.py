"""The scalar functions of the dialect as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from quillframe.errors import ArgumentError
from quillframe.functions.values import DATE, DOUBLE, INT, LONG, STAMP, STRING, Value, date, filled, maybe_number, number, number_type, stamp, text, utc, whole_text

#: White space that TRIM removes, and the short names of the days from Sunday on: fixed values.
SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
DAYS = "日月火水木金土"

FUNCTIONS: dict[str, Callable[..., Value]] = {}


def function(*names: str):
    def add(f):
        for name in names:
            FUNCTIONS[name] = f
        return f

    return add


def string(c: Column) -> Value:
    return Value(filled(c), STRING)


def integer(c: Column) -> Value:
    return Value(c.cast("int"), INT)


def constant(v: Value, what: str):
    if not v.is_literal:
        raise ArgumentError(f"{what} must be a literal or a variable")
    return v.literal


# ------------------------------------------------------------------ strings
FUNCTIONS["UPPER"] = lambda x: string(F.upper(text(x)))
FUNCTIONS["LOWER"] = lambda x: string(F.lower(text(x)))
FUNCTIONS["LTRIM"] = lambda x: string(F.regexp_replace(text(x), f"^{SPACE}+", ""))
FUNCTIONS["RTRIM"] = lambda x: string(F.regexp_replace(text(x), f"{SPACE}+$", ""))
FUNCTIONS["TRIM"] = lambda x: string(F.regexp_replace(text(x), f"^{SPACE}+|{SPACE}+$", ""))
FUNCTIONS["LENGTH_CHAR"] = lambda x: integer(F.length(whole_text(x)))
FUNCTIONS["LENGTH"] = lambda x: integer(F.octet_length(F.encode(whole_text(x), "UTF-16BE")) / 2)
FUNCTIONS["INSTR"] = lambda x, y: integer(F.instr(whole_text(x), whole_text(y)))
FUNCTIONS["CONCAT"] = lambda *xs: string(F.concat(*map(whole_text, xs)))
FUNCTIONS["REPLACE"] = lambda x, a, b: string(F.when(whole_text(a) == "", whole_text(x)).otherwise(F.replace(whole_text(x), whole_text(a), whole_text(b))))


@function("SUBSTRING")
def _substring(x: Value, start: Value, length: Value | None = None) -> Value:
    at = F.greatest(number(start).cast("int"), F.lit(1))
    return string(F.substring(whole_text(x), at, F.greatest(number(length).cast("int"), F.lit(0)) if length else F.lit(2**31 - 1)))


@function("LEFT")
def _left(x: Value, k: Value) -> Value:
    return string(F.left(whole_text(x), F.greatest(number(k).cast("int"), F.lit(0))))


@function("RIGHT")
def _right(x: Value, k: Value) -> Value:
    return string(F.right(whole_text(x), F.greatest(number(k).cast("int"), F.lit(0))))


def _pad(f):
    def run(x: Value, k: Value, fill: Value | None = None) -> Value:
        with_ = whole_text(fill) if fill else F.lit(" ")
        return string(F.when(with_ == "", whole_text(x)).otherwise(f(whole_text(x), F.greatest(number(k).cast("int"), F.lit(0)), with_)))

    return run


FUNCTIONS["LPAD"], FUNCTIONS["RPAD"] = _pad(F.lpad), _pad(F.rpad)


@function("TRANSLATE")
def _translate(x: Value, a: Value, b: Value) -> Value:
    old, new = constant(a, "TRANSLATE's characters"), constant(b, "TRANSLATE's characters")
    if len(old) != len(new):
        raise ArgumentError("TRANSLATE takes as many characters as it gives")
    return string(F.translate(whole_text(x), old, new)) if old else Value(text(x), STRING)


# ------------------------------------------------------------- conditionals
def common(values: list[Value]) -> tuple[list[Column], object]:
    """One type for all: theirs if equal, a number if all are, else text."""
    shown = [v for v in values if not (v.is_literal and v.literal == "")]
    kinds = {v.kind for v in shown}
    if len(kinds) == 1 and kinds != {"num"}:
        t = shown[0].type
        return [F.lit(None).cast(t) if v.is_literal and v.literal == "" else v.col for v in values], t
    if kinds == {"num"}:
        types = {v.type for v in shown}
        t = types.pop() if len(types) == 1 else LONG if types <= {INT, LONG} else DOUBLE
        return [maybe_number(v).cast(t) for v in values], t
    return [text(v) for v in values], STRING


@function("COALESCE", "ISNULL")
def _coalesce(*xs: Value) -> Value:
    cols, t = common(list(xs))
    return Value(F.coalesce(*cols), t)


@function("NULLIF")
def _nullif(x: Value, y: Value) -> Value:
    return Value(F.when(~whole_text(x).eqNullSafe(whole_text(y)), x.col), x.type)


@function("GREATEST")
def _greatest(*xs: Value) -> Value:
    cols, t = common(list(xs))
    return Value(F.greatest(*cols), t)


@function("LEAST")
def _least(*xs: Value) -> Value:
    cols, t = common(list(xs))
    empty = cols[0].isNull()
    for c in cols[1:]:
        empty |= c.isNull()
    return Value(F.when(~empty, F.least(*cols)), t)


# ------------------------------------------------------ regular expressions
def pattern(p: Value, flags: Value | None) -> str:
    marks = constant(flags, "flags") if flags else ""
    if set(marks) - set("ims") or len(set(marks)) < len(marks):
        raise ArgumentError(f"flags are i, m and s, once each; not {marks!r}")
    own = constant(p, "a pattern")
    return f"(?{marks}){own}" if marks else own


def template(r: str) -> str:
    """A replacement in Java's notation: whole match, numbered and named groups, dollar."""
    out = re.sub(r"\$(\$|&|<(\w+)>|\d{1,2})|([\\$])", lambda m: "\\" + m[3] if m[3] else "\\$" if m[1] == "$" else "$0" if m[1] == "&" else f"${{{m[2]}}}" if m[2] else m[0], r)
    return out


@function("REGEXP_LIKE")
def _regexp_like(x: Value, p: Value, flags: Value | None = None) -> Value:
    return Value(F.when(F.rlike(whole_text(x), F.lit(pattern(p, flags))), "1").otherwise("0"), STRING)


@function("REGEXP_SUBSTR")
def _regexp_substr(x: Value, p: Value, flags: Value | None = None) -> Value:
    return string(F.regexp_substr(whole_text(x), F.lit(pattern(p, flags))))


MARK = "\ufdd0"  # a noncharacter: in no text


@function("REGEXP_REPLACE")
def _regexp_replace(x: Value, p: Value, r: Value, flags: Value | None = None, occurrence: Value | None = None) -> Value:
    """Of the n-th match only: replacements are marked in the whole text, where look-around sees what it should, and all but the n-th undone."""
    find, put = pattern(p, flags), template(str(constant(r, "a replacement")))
    nth = int(constant(occurrence, "an occurrence")) if occurrence else 0
    t = whole_text(x)
    if nth <= 0:
        return string(F.regexp_replace(t, F.lit(find), F.lit(put)))
    marked = lambda x: F.split(F.regexp_replace(t, F.lit(find), F.lit(MARK + x + MARK)), MARK, -1)
    own, new = marked("$0"), marked(put)  # text, match, text, match ... text
    return string(F.array_join(F.transform(own, lambda x, i: F.when(i == 2 * nth - 1, F.get(new, i)).otherwise(x)), ""))


# ------------------------------------------------------------------ numbers
WHOLE = float(1 << 53)


def _scaled(f):
    def run(x: Value, digits: Value | None = None) -> Value:
        d = int(constant(digits, "digits")) if digits else 0
        n = number(x).cast("double")
        p = float(10 ** abs(d))
        scaled = n * p if d >= 0 else n / p
        done = f(scaled).cast("double")
        # doubles of 2^53 and more are whole
        return Value(F.when(F.abs(scaled) >= WHOLE, n).otherwise(done / p if d >= 0 else done * p), DOUBLE)

    return run


FUNCTIONS["ROUND"] = _scaled(lambda c: F.floor(c + 0.5))
FUNCTIONS["FLOOR"] = _scaled(F.floor)
FUNCTIONS["CEIL"] = _scaled(F.ceil)
FUNCTIONS["TRUNCATE"] = _scaled(lambda c: F.signum(c) * F.floor(F.abs(c)))
FUNCTIONS["ABS"] = lambda x: Value(F.abs(number(x)), number_type(x))
FUNCTIONS["POWER"] = lambda x, y: Value(F.pow(number(x).cast("double"), number(y).cast("double")), DOUBLE)
FUNCTIONS["SQRT"] = lambda x: Value(F.sqrt(number(x).cast("double")), DOUBLE)
FUNCTIONS["MOD"] = lambda x, y: arithmetic("%", x, y)


def arithmetic(op: str, x: Value, y: Value) -> Value:
    """Empty is 0; division by zero gives NaN."""
    a, b = number(x), number(y)
    tx, ty = number_type(x), number_type(y)
    whole = all(t.simpleString() in ("tinyint", "smallint", "int", "bigint") for t in (tx, ty))
    t = LONG if whole else DOUBLE
    if op in "/%":
        a, b = a.cast("double"), b.cast("double")
        if y.is_literal and y.literal:
            out = a / b if op == "/" else a % b
        else:
            out = F.when(b == 0, F.lit(float("nan"))).otherwise((a / F.nullif(b, F.lit(0.0))) if op == "/" else (a % F.nullif(b, F.lit(0.0))))
        exact = op == "%" and whole and y.is_literal and bool(y.literal)
        return Value(out.cast("bigint"), LONG) if exact else Value(out, DOUBLE)
    a, b = a.cast(t), b.cast(t)
    return Value(a + b if op == "+" else a - b if op == "-" else a * b, t)


@function("CAST")
def _cast(x: Value, kind: Value) -> Value:
    k = kind.literal
    if k in ("TEXT", "VARCHAR", "CHAR", "STRING", "NVARCHAR"):
        return Value(text(x), STRING)
    if k == "DATE":
        return Value(date(x), DATE)
    if x.kind == "num":
        return Value(number(x), x.type)
    return Value(F.when(whole_text(x) == "", F.lit(0.0)).otherwise(F.trim(whole_text(x)).try_cast("double")), DOUBLE)


@function("FORMAT")
def _format(x: Value, how: Value) -> Value:
    p = constant(how, "a pattern")
    if isinstance(p, int):
        p = "#,##0" + ("." + "0" * p if p > 0 else "")
    percent = p.endswith("%")
    body = p.rstrip("%")
    _, _, decimals = body.partition(".")
    if not re.fullmatch(r"[#0,]*(\.0*#*)?", body):
        raise ArgumentError(f"unknown pattern {p!r}")
    least, most = decimals.count("0"), len(decimals)
    n = number(x).cast("double") * (100.0 if percent else 1.0)
    scaled = F.abs(n) * float(10**most)
    rounded = F.when(scaled >= WHOLE, n).otherwise(F.signum(n) * F.floor(scaled + 0.5) / float(10**most))
    out = F.format_number(rounded, most)
    if most > least:
        keep = rf"(\.\d{{{least}}}\d*?)0+$" if least else r"(\.\d*?)0+$"
        out = F.regexp_replace(F.regexp_replace(out, keep, "$1"), r"\.$", "")
    if "," not in body:
        out = F.replace(out, F.lit(","), F.lit(""))
    return string(F.when(maybe_number(x).isNotNull(), F.concat(out, F.lit("%" if percent else ""))))


# -------------------------------------------------------------------- dates
for _name, _f in {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "DAYOFWEEK": F.dayofweek, "QUARTER": F.quarter, "WEEK": F.weekofyear}.items():
    FUNCTIONS[_name] = lambda x, f=_f: integer(f(date(x)))
FUNCTIONS["LAST_DAY"] = lambda x: Value(F.last_day(date(x)), DATE)
FUNCTIONS["DATEDIFF"] = lambda a, b: integer(F.coalesce(F.datediff(date(a), date(b)), F.lit(0)))


@function("DATE_ADD")
def _date_add(d: Value, k: Value, unit: Value) -> Value:
    u = str(constant(unit, "a unit")).upper()
    n = number(k).cast("int")
    if u == "DAY":
        return Value(F.date_add(date(d), n), DATE)
    if u not in ("MONTH", "YEAR"):
        raise ArgumentError(f"units are DAY, MONTH and YEAR, not {u}")
    return Value(F.add_months(date(d), n if u == "MONTH" else n * 12), DATE)


@function("DATE_FORMAT")
def _date_format(x: Value, how: Value) -> Value:
    t, d = utc(Value(stamp(x), STAMP)) if x.kind == "ts" and not isinstance(x.type, T.TimestampNTZType) else stamp(x), date(x)
    parts = {
        **{k: F.date_format(t, v) for k, v in {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "i": "mm", "s": "ss"}.items()},
        "w": (F.dayofweek(d) - 1).cast("string"), "a": F.substring(F.lit(DAYS), F.dayofweek(d), F.lit(1)), "v": F.lpad(F.weekofyear(d).cast("string"), 2, "0"), "G": F.extract(F.lit("YEAROFWEEK"), d).cast("string"), "%": F.lit("%"),
    }
    out = [parts[m[1:]] if m[0] == "%" and m[1:] in parts else F.lit(m) for m in re.findall(r"%.|[^%]+|%", str(constant(how, "a format")))]
    return string(F.concat(*out)) if out else Value(F.lit(None).cast("string"), STRING)
