"""Secret scans that link the parts of a credential.

Three base kinds stand alone (assign, access, hex; see ``BASE``). Besides, a task finds weak parts that mean nothing
alone: identifiers (``user = ...``, ``client_id: ...``), short or random-looking secrets (``pwd = ...``, a mixed run of 24 characters
or more) and endpoints (``scheme://host``, ``host = ...``). A weak part is reported only if complementary parts
co-occur in its scope: an identifier needs a secret, an endpoint needs a secret, and a weak secret needs an identifier or
an endpoint. Base finds count as complements (access: identifier; assign and hex: secret). The scope of a part is the
text within ``SCOPE`` code points of it.

The parts of all rows are exploded and joined as intervals by blocks of ``SCOPE`` code points of the same row: a candidate
enters every block that it touches, a complement every block that it or the scope around it touches, so parts of any length meet
whatever lies near any of their ends. The rows of a part grow with its length, and parts of one pattern don't overlap, so all rows
of a text grow with its length. A block touches a bounded number of parts, so no pair list grows with the length of a
text, and keys are single blocks of single rows.
The parts are written to the shared folder first, so texts are scanned once.

Rows: a null or empty text has no spans (and the digest of the empty string). Each row, repeated or not, is scanned on its own.
Overlapping spans of different kinds are all reported. Existing columns with the names of the results are replaced.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import written
from .common import read
from .registry import query

SCOPE = 300
#: Kind, pattern, group whose length counts (0: the whole match), least length.
BASE = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: Without any of these (in lower case) a text has no match of the kind.
HINTS = {"assign": ["passw", "secret", "token", "apikey", "api_key"], "access": ["akia"], "hex": [""],
         "identifier": ["user", "login", "client", "account", "access"],
         "secret": ["pwd", "pass", "secret", "token", "apikey", "api_key", "private", "access"],
         "endpoint": ["://", "host", "server", "endpoint"]}
#: Kinds in the order in which spans of one start are listed.
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
#: Role of each kind as a complement.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret",
         "endpoint": "endpoint"}
NEEDS = {"identifier": ["secret"], "endpoint": ["secret"], "secret": ["identifier", "endpoint"]}

_PARTS = "array<struct<start:long,ord:int,end:long>>"


class Scanner:
    """Finds base spans and weak parts of one text."""

    def __init__(self) -> None:
        # a hexadecimal run shorter than asked for can't match within itself, so the least length goes into the pattern
        self.base = [("hex", re.compile(rf"[0-9a-f]{{{n},}}"), g, n) if kind == "hex"
                     else (kind, re.compile(p, re.ASCII), g, n) for kind, p, g, n in BASE]
        self.weak = [
            ("identifier", re.compile(r"(?i:(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id))"
                                      r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", re.ASCII)),
            ("secret", re.compile(r"(?i:(?<![A-Za-z0-9])(?:pwd|pass(?:word|wd)?|secret|token|api_?key|private_?key|client_?secret|access_?key))"
                                  r"[\"']?\x20*[:=]\x20*[\"']?[^\s\"']{4,}", re.ASCII)),
            ("endpoint", re.compile(r"\b[a-z][a-z0-9+]{1,15}://[^\s\"'<>]{3,}|(?i:(?<![A-Za-z0-9])(?:host(?:name)?|server|endpoint))"
                                    r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,}", re.ASCII)),
        ]
        self.random = re.compile(r"[A-Za-z0-9+/_-]{24,}")
        self.classes = [re.compile(c) for c in ("[0-9]", "[A-Z]", "[a-z]")]

    def scan(self, text: str | None) -> tuple[list, list]:
        base, weak = [], []
        if not text:
            return base, weak
        low = text.lower()  # texts without any word of a pattern skip it
        for kind, pattern, group, least in self.base:
            if not any(w in low for w in HINTS[kind]):
                continue
            order = KINDS.index(kind)
            for m in pattern.finditer(text):
                a, b = m.span(group)
                if b - a >= least:
                    base.append((m.start(), order, m.end()))
        starts = {a for a, _, _ in base}  # a base find already tells its place
        for kind, pattern in self.weak:
            if any(w in low for w in HINTS[kind]):
                order = KINDS.index(kind)
                weak += [(m.start(), order, m.end()) for m in pattern.finditer(text) if m.start() not in starts]
        order = KINDS.index("secret")
        for m in self.random.finditer(text):
            mixed = all(c.search(text, m.start(), m.end()) for c in self.classes)
            if mixed and not any(a < m.end() and m.start() < b for a, _, b in base):
                weak.append((m.start(), order, m.end()))
        return sorted(base), sorted(set(weak))


def _listed(spans: Column) -> Column:
    """kind:start:end, by start and then by kind, joined by commas."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["ord"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Replaces the text by n_assign, n_access, n_hex, base_sha256, spans and linked (the spans that linking added)."""

    @F.pandas_udf(f"struct<base:{_PARTS},weak:{_PARTS}>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for batch in batches:
            found = [scanner.scan(t) for t in batch]
            yield pd.DataFrame({"base": [[{"start": a, "ord": k, "end": b} for a, k, b in f[0]] for f in found],
                                "weak": [[{"start": a, "ord": k, "end": b} for a, k, b in f[1]] for f in found]})

    kept = [c for c in docs.columns if c != text and c not in RESULTS]
    found = written(docs.select(F.struct(F.lit(1).alias("_"), *kept).alias("_row"), parts(F.col(text)).alias("_p"))
                    .withColumn("_id", F.monotonically_increasing_id()), "secret-parts")
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("ord") + 1)
    every = (found.where(F.size("_p.weak") > 0)
             .select("_id", F.explode(F.concat(F.transform("_p.base", lambda s: F.struct(F.lit(False).alias("weak"), s.alias("s"))),
                                               F.transform("_p.weak", lambda s: F.struct(F.lit(True).alias("weak"), s.alias("s"))))).alias("x"))
             .select("_id", "x.weak", "x.s.*").withColumn("role", role))
    # both sides enter every block that they touch, a complement with the scope around it: what is near shares a block
    blocks = lambda first, end: F.explode(F.sequence(F.floor(first / scope), F.floor((end - 1) / scope))).alias("block")
    weak = every.where("weak").select("_id", blocks(F.col("start"), F.col("end")), "start", "ord", "end", "role")
    others = every.select("_id", blocks(F.col("start") - scope, F.col("end") + scope), F.col("start").alias("a"),
                          F.col("end").alias("b"), F.col("role").alias("other"))
    needed = F.lit(False)
    for r, roles in NEEDS.items():
        needed = needed | ((F.col("role") == r) & F.col("other").isin(roles))
    linked = (weak.alias("w")
              .join(others.withColumnRenamed("_id", "_o").withColumnRenamed("block", "_b").alias("o"),
                    (F.col("_id") == F.col("_o")) & (F.col("block") == F.col("_b"))
                    & (F.col("a") < F.col("end") + scope) & (F.col("start") < F.col("b") + scope) & needed, "left_semi")
              .groupBy("_id").agg(F.collect_set(F.struct("start", "ord", "end")).alias("linked")))
    empty = F.expr(f"CAST(array() AS {_PARTS})")
    count = lambda k: F.size(F.filter("_p.base", lambda s: s["ord"] == KINDS.index(k))).cast("long")
    joined = found.join(linked, "_id", "left").withColumn("linked", F.coalesce("linked", empty))
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept],
                         *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                         F.sha2(_listed(F.col("_p.base")), 256).alias("base_sha256"),
                         _listed(F.concat("_p.base", "linked")).alias("spans"), _listed(F.col("linked")).alias("linked"))


RESULTS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "linked")


@query("op3_secret_scans")
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
            .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "linked"))
