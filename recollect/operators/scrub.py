"""Log records without credentials."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "[REDACTED]"
#: The names of fields that hold credentials, the form of bearer tokens, the characters of a transcript that stay.
SENSITIVE = r"(?i)api[_-]?key|token|bearer|password|secret|authorization"
BEARER = r"(?i)(bearer)\s+[A-Za-z0-9._\-+/=]+"
SHOWN = 200


def masked(text: Column) -> Column:
    """Text without the values of bearer tokens; the word before them stays as it is written."""
    return F.regexp_replace(text, BEARER, f"$1 \\{MASK}")


def shortened(text: Column) -> Column:
    """The first characters of a long text and how many more it has."""
    more = F.concat(F.left(text, F.lit(SHOWN)), F.lit("... ["), (F.length(text) - SHOWN).cast("string"), F.lit(" more chars]"))
    return F.when(F.length(text) > SHOWN, more).otherwise(text)


def scrubbed(value: Column, kind: T.DataType) -> Column:
    """A record of any depth: fields and map entries with a sensitive name become the mask, whatever they hold, other texts lose bearer tokens.

    Nulls stay null but for sensitive fields; sensitive entries of maps that hold no texts become null."""
    if isinstance(kind, T.StringType):
        return masked(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: scrubbed(x, kind.elementType))
    if isinstance(kind, T.MapType):
        mask = F.lit(MASK) if isinstance(kind.valueType, T.StringType) else F.lit(None).cast(kind.valueType)
        return F.transform_values(value, lambda k, v: F.when(k.cast("string").rlike(SENSITIVE), mask).otherwise(scrubbed(v, kind.valueType)))
    if isinstance(kind, T.StructType):
        fields = [(F.lit(MASK) if re.search(SENSITIVE, f.name) else scrubbed(value[f.name], f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value
