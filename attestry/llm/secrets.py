"""Secret scans: base patterns for each document, and weak candidates linked to their complementary parts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import keep, within_bounds

# The base kinds, their patterns and the least length of what each must hold.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
_LETTERS = "A-Za-z0-9"
#: Weak candidates. Alone each of them is common in harmless text; they count only beside their complement.
WEAK = {
    "ident": re.compile(
        rf"""(?<![{_LETTERS}])(?:A(?:KI|SI|RO|ID)A[A-Z0-9]{{8,}}|(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{{3,}})""",
        re.A,
    ),
    "key": re.compile(
        rf"""(?<![{_LETTERS}])(?:(?:pwd|pass|credential|private_?key|secret|token|password|passwd|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{4,}}|[0-9a-f]{{16,31}}(?![{_LETTERS}]))""",
        re.I | re.A,
    ),
    "endpoint": re.compile(
        rf"""(?<![{_LETTERS}])(?:(?i:[a-z][a-z0-9+.-]{{1,9}})://[^\s"'<>]{{3,}}|arn:aws:[a-z0-9:/_-]{{3,}}|(?i:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{{3,}})""",
        re.A,
    ),
}
# One of these is in every lower-cased text that has an assign match, or a weak ident match.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
IDENT_WORDS = ("akia", "asia", "aroa", "aida", "user", "login", "account", "client", "access")
#: Code points between an identifier, a secret and an endpoint that belong together.
SCOPE = 160
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base matches, sorted."""
    out, small = [], text.lower()
    if any(w in small for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]  # a run of 32 or more is a maximal run
    return sorted(out)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the weak candidates that are not within a base match; one that goes beyond it is kept whole.

    Every link has an identifier, so a text without one is not searched for the other parts.
    """
    out, taken, small = [], [(s, e) for s, _, e in base], text.lower()
    has_ident = any(k == KINDS.index("access") for _, k, _ in base)
    if not has_ident and not (any(w in small for w in IDENT_WORDS) and WEAK["ident"].search(text)):
        return out
    for kind, pattern in WEAK.items():
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if not any(s <= m.start() and m.end() <= e for s, e in taken)]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column(0), {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "base", "weak")}
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            for i, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(x[1] == i for x in base))
            said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
            out["base_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
            out["base"].append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base])
            out["weak"].append([{"kind": k, "start": s, "end": e} for k, s, e in weak_spans(text, base)])
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        kinds = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "base": span, "weak": span}
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(out[k], t) for k, t in kinds.items()]], ["doc_id", *kinds])


def linked_spans(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak rows of parts (row, kind, role, weak, start, end) whose complement stands within `scope` code points.

    An identifier and a secret complement each other; an endpoint needs both. The interval join goes by stretches of
    `scope` code points: each stretch has, for each role, its first start and its last end, and a candidate is joined
    with its own stretch and the next on either side. The rows of a join are three for each candidate, however
    many parts stand together: no pairs are made.
    """
    stretch = F.floor(F.col("start") / scope)
    at = parts.withColumn("cell", stretch)
    ends = at.withColumn("cell", F.explode(F.sequence("cell", F.floor((F.col("end") - 1) / scope))))
    marks = ends.groupBy("row", "cell").agg(
        *[f(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("ident", "key") for f, c in ((F.min, "start"), (F.max, "end"))]
    )
    weak = at.where("weak").withColumn("first", F.floor(F.col("start") / scope) - 1).withColumn("last", F.floor((F.col("end") - 1) / scope) + 1)
    weak = weak.withColumn("cell", F.explode(F.sequence("first", "last")))
    near = weak.join(marks, ["row", "cell"])

    def close(role: str):
        return F.coalesce((F.col(f"{role}_start") <= F.col("end") + scope) & (F.col(f"{role}_end") >= F.col("start") - scope), F.lit(False))

    found = near.groupBy("row", "kind", "role", "start", "end").agg(
        F.max(close("ident")).alias("ident"), F.max(close("key")).alias("key")
    )
    wanted = F.when(F.col("role") == "ident", F.col("key")).when(F.col("role") == "key", F.col("ident")).otherwise(F.col("ident") & F.col("key"))
    return found.where(wanted).select("row", "kind", "start", "end")


@within_bounds
def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_linked (spans added by linking).

    Positions are code points, ends exclusive. Whole texts are read. Null text counts as empty: no spans, and the
    digest of the empty string. Rows that repeat a doc_id are scanned each for itself. Other columns are ignored.
    """
    scanned = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _scan, f"doc_id {dict(docs.dtypes)[doc_id]}, n_assign long, n_access long, n_hex long, base_sha256 string, base {_SPANS}, weak {_SPANS}"
    )
    scanned = keep(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    role = F.create_map(*[F.lit(x) for x in ("assign", "key", "access", "ident", "hex", "key", "ident", "ident", "key", "key", "endpoint", "endpoint")])
    some = scanned.where(F.size("weak") > 0)
    parts = some.select("row", F.explode("base").alias("p"), F.lit(False).alias("weak")).unionByName(
        some.select("row", F.explode("weak").alias("p"), F.lit(True).alias("weak"))
    ).select("row", "p.*", role[F.col("p.kind")].alias("role"), "weak")
    added = linked_spans(parts, scope).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    out = scanned.drop("weak").join(added, "row", "left")
    order = F.create_map(*[x for i, k in enumerate((*KINDS, *WEAK)) for x in (F.lit(k), F.lit(i))])
    every = F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))
    every = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_linked"),
    )
