"""Secrets in texts: patterns that stand alone, and weak parts that count only next to their complements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import fresh, map_text
from skysift.session import cut

#: Kinds in the order of their numbers; the first three stand alone, the others are reported only when linked.
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
#: What each kind is a part of: an access identifier, a secret or an endpoint.
ROLE = {"access": "identifier", "identifier": "identifier", "assign": "secret", "hex": "secret", "key": "secret", "endpoint": "endpoint"}
#: Code points between two parts of one credential at most.
SCOPE = 400

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", re.ASCII | re.IGNORECASE)
KEY = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]{1,11}://[^\s"'<>]+|\b\d{1,3}(?:\.\d{1,3}){3}:\d{2,5}\b)""", re.ASCII)
LONG_RUN = re.compile(rb"[A-Za-z0-9+/_-]{24,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
IDENTIFIER_WORDS = (b"user", b"login", b"account", b"client", b"key")


def mixed(token: str) -> bool:
    """Whether a long token has digits and letters of both cases, as generated keys have."""
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def parts_of(raw: bytes | None) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) in code points, end exclusive. Cheap searches for what a pattern needs come first."""
    if not raw:
        return []
    low, text, found = raw.lower(), None, []

    def add(kind: int, pattern: re.Pattern, good) -> None:
        nonlocal text
        if text is None:
            text = raw.decode()
        found.extend((kind, m.start(), m.end()) for m in pattern.finditer(text) if good(m))

    if any(w in low for w in ASSIGN_WORDS):
        add(0, ASSIGN, lambda m: m.end(2) - m.start(2) >= 6)
    if b"AKIA" in raw:
        add(1, ACCESS, lambda m: m.end() - m.start() >= 20)
    if LONG_RUN.search(raw):
        add(2, HEX, lambda m: m.end() - m.start() >= 24)
        add(4, KEY, lambda m: mixed(m.group()))
    if (b"=" in raw or b":" in raw) and any(w in low for w in IDENTIFIER_WORDS):
        add(3, IDENTIFIER, lambda m: True)
    if b"://" in raw or re.search(rb"\d:\d", raw):
        add(5, ENDPOINT, lambda m: True)
    return found


def find_credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``id_col`` and ``spans``: an array of (start, kind, end), kind as its number in KINDS, in that order.

    Patterns that stand alone are always reported. Weak parts - plain identifiers, generated-looking keys and endpoints -
    are reported only with complementary parts in their scope, that is, within ``scope`` code points: a key with an identifier,
    an identifier with a secret, an endpoint with both. Parts meet in an interval join on scope-wide bins of a text, each
    part in its own bin and the weak ones in the bins around it; it is a semi-join, so no pairs are made. A weak key that a
    stronger span covers isn't reported again.

    One row per row of ``docs``, also for null and empty texts, which have no spans. Rows that share an id are searched each by
    itself; other columns are not looked at.
    """
    row = fresh(docs.select(id_col), "_row")
    named = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias(row))

    def factory():
        def run(texts):
            every = [parts_of(t) for t in texts]
            return ([[x for part in parts for x in part] for parts in every],)

        return run

    flat = map_text(named, "_text", [id_col, row], [("_flat", "array<bigint>")], factory)
    parts = F.transform(F.sequence(F.lit(0), (F.size("_flat") / 3).cast("int") - 1), lambda i: F.struct(F.get("_flat", (3 * i + 1).cast("int")).alias("start"), F.get("_flat", (3 * i).cast("int")).cast("int").alias("kind"), F.get("_flat", (3 * i + 2).cast("int")).alias("end")))
    found = cut(flat.select(id_col, row, F.when(F.size("_flat") > 0, parts).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("_parts")))

    keys = [F.col(id_col).alias("_id"), F.col(row).alias("_of")]
    some = found.where(F.size("_parts") > 1).dropDuplicates([id_col, row]).select(*keys, F.explode("_parts").alias("p"))
    role = F.element_at(F.array(*(F.lit(ROLE[k]) for k in KINDS)), F.col("p.kind") + 1)
    placed = some.select("_id", "_of", "p", role.alias("_role"), F.floor(F.col("p.start") / scope).alias("_bin"))
    right = placed.select(F.col("_id").alias("r_id"), F.col("_of").alias("r_of"), F.col("p").alias("r"), F.col("_role").alias("r_role"), "_bin").withColumn("r_bin", F.explode(F.sequence("_bin", F.floor((F.col("r.end") - 1) / scope)))).drop("_bin")
    weak = placed.where("p.kind >= 3").withColumn("_near", F.explode(F.sequence(F.col("_bin") - 1, F.floor((F.col("p.end") - 1) / scope) + 1)))

    def linked(candidates: DataFrame, needed: str) -> DataFrame:
        near = (F.col("p.start") < F.col("r.end") + scope) & (F.col("r.start") < F.col("p.end") + scope)
        apart = (F.col("p.start") >= F.col("r.end")) | (F.col("r.start") >= F.col("p.end"))
        same = F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_of") == F.col("r_of")) & (F.col("_near") == F.col("r_bin"))
        return candidates.join(right.where(F.col("r_role") == needed), same & near & apart, "left_semi").select("_id", "_of", "p").distinct()

    of_kind = {k: weak.where(F.col("p.kind") == KINDS.index(k)) for k in KINDS[3:]}
    endpoint = linked(of_kind["endpoint"], "identifier").intersect(linked(of_kind["endpoint"], "secret"))
    kept = linked(of_kind["key"], "identifier").unionByName(linked(of_kind["identifier"], "secret")).unionByName(endpoint)
    more = kept.groupBy("_id", "_of").agg(F.collect_list("p").alias("_linked"))
    joined = found.join(more, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(row) == F.col("_of")), "left")
    base = F.filter("_parts", lambda p: p["kind"] < 3)
    extra = F.filter(F.coalesce("_linked", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")), lambda p: ~F.exists(base, lambda b: (b["start"] <= p["start"]) & (p["end"] <= b["end"])))
    return joined.select(id_col, F.array_sort(F.concat(base, extra)).alias("spans"))
