"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_mpegts import op1_mpegts
from .op10_oddsketch import op10_oddsketch
from .op2_brown import op2_brown
from .op3_bytes import ORACLE as BYTES_SQL
from .op3_bytes import op3_bytes
from .op4_license import op4_license
from .op4_license import oracle as license_sql
from .op5_harmonic import op5_harmonic
from .op6_suffix import op6_suffix
from .op7_langid import language_of_pages, op7_langid
from .op8_pivotal import op8_pivotal
from .op9_parsing import op9_parsing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mpegts": op1_mpegts,
    "op2_brown": op2_brown,
    "op3_bytes": op3_bytes,
    "op4_license": op4_license,
    "op5_harmonic": op5_harmonic,
    "op6_suffix": op6_suffix,
    "op7_langid": op7_langid,
    "op8_pivotal": op8_pivotal,
    "op9_parsing": op9_parsing,
    "op10_oddsketch": op10_oddsketch,
    "language_of_pages": language_of_pages,
}
ORACLE_SQL: dict[str, str] = {"op3_bytes": BYTES_SQL, "op4_license": license_sql()}
