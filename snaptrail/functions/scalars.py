"""Column functions that clean and read cells."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from snaptrail.spec import SPARK_TYPES, TableSpec

_TIME = "(?:[01]?[0-9]|2[0-3]):[0-5]?[0-9]:(?:[0-5]?[0-9]|6[01])"
#: what a date looks like as a whole, and how its first group is read
DATE_FORMS = (
    (rf"^([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})(?:T{_TIME}(?:\.[0-9]{{1,6}}Z|Z)?| {_TIME}(?:\.[0-9]{{1,6}})?)?$", "yyyy-M-d"),
    (r"^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$", "d/M/yyyy"),
    (rf"^([0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}})(?: {_TIME})?$", "d.M.yyyy"),
    (r"^([0-9]{1,2} [A-Za-z]{4,9} [0-9]{4})$", "d MMMM yyyy"),
    (r"^([0-9]{1,2} [A-Za-z]{3} [0-9]{4})$", "d MMM yyyy"),
    (r"^([0-9]{1,2}-[0-9]{1,2}-[0-9]{4})$", "d-M-yyyy"),
    (r"^([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})", "d.M.yyyy"),
)


def evaluated_once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.transform(F.array(c), use)[0]


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def nfc(c: Column) -> Column:
    """Unicode composition; only values beyond ASCII leave the JVM."""
    return F.coalesce(_composed(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def strip(c: Column) -> Column:
    """No-break spaces as spaces, white space off the ends, empty as null; never edits inside."""
    spaced = F.translate(c, " ", " ")
    return F.nullif(F.regexp_replace(spaced, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit(""))


def clean(c: Column) -> Column:
    return strip(nfc(c))


def to_date(c: Column) -> Column:
    """The first form that fits; what fits none is null, never an error."""

    def read(s: Column) -> Column:
        # a text has the form of at most one pattern, but for the last one, which is the third with anything behind it
        found = None
        for pattern, form in DATE_FORMS:
            date = F.try_to_date(F.regexp_extract(F.initcap(s) if "MMM" in form else s, pattern, 1), form)
            found = F.when(s.rlike(pattern), date) if found is None else found.when(s.rlike(pattern), date)
        return found

    return evaluated_once(F.regexp_replace(strip(c), r"\s+0:00:00$", ""), read)


def host(c: Column) -> Column:
    """Host name of a web address, or null where there is none."""
    s = F.lower(F.regexp_replace(strip(c), r"[\t\r\n]", ""))
    place = F.regexp_extract(s, r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1)
    name = F.regexp_extract(F.regexp_replace(place, r"^.*@", ""), r"^([^:]*)", 1)
    named = lambda n: F.when(F.contains(n, F.lit(".")) & ~F.contains(n, F.lit(" ")) & ~n.rlike(r"[\[\]]"), F.nullif(F.regexp_replace(n, r"\.+$", ""), F.lit("")))
    return evaluated_once(name, named)


def is_domain(c: Column) -> Column:
    return c.rlike(r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$")


def split_list(c: Column, seps: str = r"[,;\n]| - |\s{2,}") -> Column:
    """Cleaned, non-empty items; no items for null."""
    return F.coalesce(F.filter(F.transform(F.split(strip(c), seps), strip), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def pad_company_id(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{1,7}$"), F.lpad(c, 8, "0")).otherwise(c)


def strip_www(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"^www\.", "")


def contains_ci(c: Column, text: str | Column) -> Column:
    """Literal, caseless."""
    return F.contains(F.lower(c), F.lower(F.lit(text) if isinstance(text, str) else text))


def normalise_code(c: Column) -> Column:
    return F.translate(F.upper(F.trim(c)), "_", "-")


def licence_stem(c: Column) -> Column:
    return F.regexp_replace(c, "-[^-]*$", "")


def local_date_prefix(c: Column) -> Column:
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def parsed(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """The declared rows of raw parts: what the table's own ``parse`` reads (raw itself without one), coerced."""
    return coerce(spec.parse(raw) if spec.parse else raw, spec)


def coerce(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The declared columns in order and type; missing ones are null, undeclared ones an error."""
    extra = sorted(set(df.columns) - set(spec.names))
    if extra:
        raise ValueError(f"UNDECLARED_COLUMNS: {extra}")
    kinds = dict(df.dtypes)

    def one(name: str, kind: str) -> Column:
        target = SPARK_TYPES[kind]
        if name not in kinds:
            return F.lit(None).cast(target).alias(name)
        c, given = F.col(name), kinds[name]
        if kind == "text":
            c = clean(c.cast("string"))
        elif kind == "date":
            c = c.cast("date") if given in ("date", "timestamp", "timestamp_ntz") else to_date(c.cast("string"))
        elif kind == "timestamptz":
            c = c.cast("timestamp") if given.startswith("timestamp") else c.cast("string").try_cast("timestamp")
        elif kind in ("int", "bigint", "numeric"):
            text = F.trim(c.cast("string"))
            c = text.try_cast(target) if kind == "numeric" else F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast(target))
        elif kind == "bool":
            c = c.cast("boolean")
        else:
            c = F.filter(F.transform(c, strip), lambda x: x.isNotNull()) if given.startswith("array") else F.array(clean(c.cast("string")))
        return c.alias(name)

    return df.select(*[one(c.name, c.type) for c in spec.columns])
