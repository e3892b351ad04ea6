"""Explicit schemas of the lending tables.

Declared rather than inferred: inference costs a pass over the files, and the
text ``\\N`` in a date or amount column would turn the whole column to string.
"""

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_DATE, _STRING = T.DateType(), T.StringType()

SCHEMAS: dict[str, T.StructType] = {
    "train": _schema(
        ("user_id", _LONG),
        ("listing_id", _LONG),
        ("auditing_date", _DATE),
        ("due_date", _DATE),
        ("due_amt", _DOUBLE),
        ("repay_date", _STRING),
        ("repay_amt", _STRING),
    ),
    "test": _schema(
        ("user_id", _LONG),
        ("listing_id", _LONG),
        ("auditing_date", _DATE),
        ("due_date", _DATE),
        ("due_amt", _DOUBLE),
    ),
    "submission": _schema(("listing_id", _LONG), ("repay_date", _DATE), ("repay_amt", _DOUBLE)),
    "listing_info": _schema(
        ("user_id", _LONG),
        ("listing_id", _LONG),
        ("auditing_date", _DATE),
        ("term", _INT),
        ("rate", _DOUBLE),
        ("principal", _INT),
    ),
    "user_info": _schema(
        ("user_id", _LONG),
        ("reg_mon", _DATE),
        ("gender", _STRING),
        ("cell_province", _STRING),
        ("id_province", _STRING),
        ("id_city", _STRING),
        ("insertdate", _DATE),
    ),
    "user_taglist": _schema(("user_id", _LONG), ("taglist", _STRING), ("insertdate", _DATE)),
    "user_repay_logs": _schema(
        ("user_id", _LONG),
        ("listing_id", _LONG),
        ("order_id", _INT),
        ("due_date", _DATE),
        ("due_amt", _DOUBLE),
        ("repay_date", _DATE),
        ("repay_amt", _DOUBLE),
    ),
    "user_behavior_logs": _schema(
        ("user_id", _LONG),
        ("behavior_time", T.TimestampNTZType()),
        ("behavior_type", _INT),
    ),
}
