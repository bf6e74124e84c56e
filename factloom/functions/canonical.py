"""JSON with one spelling: object keys sorted, numbers and strings as a JavaScript engine
writes them, so that a hash of it equals one made elsewhere, byte for byte.

Everything is built of columns, from the column's type: keys of a struct are sorted
when the plan is made, keys of a map as rows pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Fixed value: the largest key that counts as an array index, plus one.
INDEX_END = 4294967295
#: The short escapes of JSON strings.
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _is_index(key: str) -> bool:
    return key.isascii() and key.isdigit() and (key == "0" or key[0] != "0") and int(key) < INDEX_END


def _key_order(key: str) -> tuple:
    """Index keys first, by number; then by UTF-16 code units."""
    return (0, int(key), b"") if _is_index(key) else (1, 0, key.encode("utf-16-be", "surrogatepass"))


def _quoted(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    # one literal, so that a plan of many texts stays quick to make
    escapes = F.split(F.lit(" ".join(SHORT.get(chr(n), f"\\u{n:04x}") for n in range(0x20))), " ")
    odd = F.aggregate(F.sequence(F.lit(0), F.lit(0x1F)), out, lambda told, n: F.replace(told, F.char(n), F.element_at(escapes, n + 1)))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), odd).otherwise(out), F.lit('"'))


def _number(x: Column) -> Column:
    """A double as the shortest digits that give it back: plain from 1e-6 to under 1e21,
    else with an exponent; null for what is no number. The digits are Java's: two at
    least (4.9e-324 for 5e-324), and before version 19 a few doubles have one digit too many."""
    told = F.upper(x.cast("string"))  # the shortest digits, in another layout
    sign = F.when(F.substring(told, 1, 1) == "-", "-").otherwise("")
    bare = F.regexp_replace(told, "^-", "")
    mantissa, power = F.regexp_replace(bare, "E.*$", ""), F.coalesce(F.nullif(F.regexp_extract(bare, "E([-+]?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_extract(mantissa, "\\.([0-9]*)$", 1)
    lead = F.regexp_replace(F.concat(whole, part), "^0+", "")
    # value = 0.digits * 10 ** point
    point = F.length(whole) + power - (F.length(F.concat(whole, part)) - F.length(lead))
    digits = F.regexp_replace(lead, "0+$", "")
    n = F.length(digits)
    plain = (
        F.when(n <= point, F.rpad(digits, point, "0"))
        .when(point > 0, F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
    )
    more = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    far = F.concat(F.substring(digits, 1, 1), more, F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string"))
    shown = F.when((point > 21) | (point < -5), far).otherwise(plain)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "null").when(x == 0, "0").otherwise(F.concat(sign, shown))


def _instant(x: Column) -> Column:
    """A time as text in UTC to the millisecond."""
    ms = F.lpad(F.pmod(F.unix_millis(x), F.lit(1000)).cast("string"), 3, "0")
    utc = F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(F.lit('"'), utc, F.lit("."), ms, F.lit('Z"'))


def _map(x: Column, kind: S.MapType) -> Column:
    """A map's members, index keys first and ascending, then the others by code units."""
    index = lambda k: k.rlike("^(?:0|[1-9][0-9]{0,9})$") & (k.cast("decimal(20,0)") < INDEX_END)
    rows = F.transform(
        F.map_entries(x),
        lambda e: F.struct(
            F.when(index(e["key"].cast("string")), 0).otherwise(1).alias("a"),
            F.when(index(e["key"].cast("string")), e["key"].cast("string").cast("decimal(20,0)")).alias("b"),
            F.encode(e["key"].cast("string"), "UTF-16BE").alias("c"),
            F.concat(_quoted(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType)).alias("s"),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(rows), lambda r: r["s"]), ","), F.lit("}"))


def canonical_json(x: Column, kind: S.DataType, absent: frozenset[str] = frozenset()) -> Column:
    """The canonical text of a column of that type; a null is `null`.

    absent: names of a top-level struct's fields that are left out where they are null, as a
    member without a value is. Byte, short, int and long are written as they are (over
    2**53 too), float as its double, decimals as doubles, dates as text.
    """
    if isinstance(kind, S.StructType):
        names = sorted(kind.names, key=_key_order)
        parts = [F.concat(_quoted(F.lit(n)), F.lit(":"), canonical_json(x[n], kind[n].dataType)) for n in names]
        told = [F.when(x[n].isNotNull(), p) if n in absent else p for n, p in zip(names, parts)]
        text = F.when(x.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *told), F.lit("}")) if told else F.lit("{}"))
    elif isinstance(kind, S.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: canonical_json(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, S.MapType):
        text = _map(x, kind)
    elif isinstance(kind, S.BooleanType | S.ByteType | S.ShortType | S.IntegerType | S.LongType):
        text = x.cast("string")
    elif isinstance(kind, S.DoubleType | S.FloatType | S.DecimalType):
        text = _number(x.cast("double"))
    elif isinstance(kind, S.TimestampType):
        text = _instant(x)
    elif isinstance(kind, S.NullType):
        return F.lit("null")
    else:
        text = _quoted(x.cast("string"))
    return F.coalesce(text, F.lit("null"))


def content_hash(type_: Column, occurred_at: Column, date_basis: Column, contact: Column, payload: Column, kind: S.DataType) -> Column:
    """The hash of what a fact asserts; occurred_at is a time."""
    return hash_of(type_, occurred_at, date_basis, contact, canonical_json(payload, kind))


def hash_of(type_: Column, occurred_at: Column, date_basis: Column, contact: Column, payload_text: Column) -> Column:
    """The same of a payload that is canonical text already."""
    told = [_quoted(type_.cast("string")), _instant(occurred_at), _quoted(date_basis.cast("string")), _quoted(contact.cast("string")), payload_text]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(t, F.lit("null")) for t in told]), F.lit("]")), 256)
