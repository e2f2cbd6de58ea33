"""Text helpers: names, labels and patterns found in catalogs and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysift.functions.numeric import col

# Observing runs as closed GPS ranges; later times belong to the open run.
OBSERVING_RUNS = (
    ("O1", 1126051217, 1137254417), ("O2", 1164556817, 1187733618),
    ("O3a", 1238112018, 1253977218), ("O3b", 1256655618, 1269363618),
)
OPEN_RUN = "O4+"
# Fixed patterns: report file names and the sentences of stored explanations.
REPORT_STAMP = r"quick_run_(\d{8}_\d{6})\.json"
TEMPLATE_NAME = r"'(\w+)'\s*template"
UNEXPLAINED_NUMBER = r"unexplainability[=:]?\s*([\d.]+)"


def observing_run(gps) -> Column:
    g = col(gps)
    ladder = F.when(g.isNull(), F.lit(None).cast("string"))
    for run, start, end in OBSERVING_RUNS:
        ladder = ladder.when(g.between(start, end), run)
    return ladder.when(g > OBSERVING_RUNS[-1][2], OPEN_RUN)


def report_time(path) -> Column:
    stamp = F.regexp_extract(col(path), REPORT_STAMP, 1)
    return F.when(stamp != "", F.to_timestamp(F.when(stamp != "", stamp), "yyyyMMdd_HHmmss"))


def first_match(texts, pattern: str) -> Column:
    """First capture of a pattern over an array of sentences, null when no sentence has it."""
    hits = F.filter(
        F.transform(col(texts), lambda t: F.regexp_extract(t, pattern, 1)), lambda h: h != ""
    )
    return F.get(hits, F.lit(0))


def pulsar_key(name) -> Column:
    """Name without case and without its J or B prefix letters."""
    return F.regexp_replace(F.lower(F.trim(col(name))), "^[jb]+", "")


def position_name(ra, dec) -> Column:
    """HHMM+DDMM from decimal degrees."""
    h, d = col(ra) / 15.0, F.abs(col(dec))
    hh, dd = F.floor(h), F.floor(d)
    return F.format_string(
        "%02d%02d%s%02d%02d", hh, F.floor((h - hh) * 60), F.when(col(dec) >= 0, "+").otherwise("-"),
        dd, F.floor((d - dd) * 60),
    )
