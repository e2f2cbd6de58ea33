"""Elementary functions of the C library, where a last digit decides.

Java's arcsine differs in the last digit for one value in twenty. Positions that are exactly a threshold apart then fall on
either side of it, so the survey-shaped tables take the C library's values, as databases do.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.DoubleType())
def libm_asin(x: pa.Array) -> pa.Array:
    return pa.array([v if v is None else math.asin(v) if abs(v) <= 1 else math.nan for v in x.to_pylist()], pa.float64())
