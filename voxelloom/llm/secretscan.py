"""Secret scans: base patterns, and linking of weak parts that complement each other. SQL functions only.

Strong spans (assignments, access identifiers, long hex) are reported always. Weak parts are reported
only in company: an account-like identifier, a token that looks random, and an endpoint (URL or named
host) make a credential together. Each part has a scope of ``SCOPE`` characters to either side; a weak
identifier or token is reported when parts of both other roles lie within its scope. Strong spans play
their roles too: access identifiers as identifiers, assignments and hex as secrets.

The interval join runs on (row, block of ``SCOPE`` characters): parts are first reduced to the first
start and last end per row, block and role, and a candidate meets the three to five blocks its scope
touches, so no pairs within a document are made, however many parts it has.

Edge cases: null text is empty text; repeated rows are judged each; a null key is returned as it is; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.spans import counted, listed, tagged, with_matches
from voxelloom.session import written

KINDS = ["assign", "access", "hex", "weak_id", "weak_secret"]
_VALUE = "[A-Za-z0-9+/_.=-]"
PATTERNS = {
    "assign": (rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?{_VALUE}++""", "text rlike '[:=]'"),
    "access": (r"AKIA[A-Z0-9]++", "contains(text, 'AKIA')"),
    "hex": (r"[0-9a-f]{24,}+", None),
    "weak_id": (r"""(?i:\b(?:user(?:name)?|login|account|client|access_?key)(?:_?id)?["']?\x20*[:=]\x20*["']?)[A-Za-z0-9@._+-]{3,}+""", "text rlike '[:=]'"),
    "weak_secret": (r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/=_-]{20})(?=[A-Za-z+/=_-]*+[0-9])(?=[a-z0-9+/=_-]*+[A-Z])(?=[A-Z0-9+/=_-]*+[a-z])[A-Za-z0-9+/=_-]++", "text rlike '[0-9]'"),
    "endpoint": (r"""(?:(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s"'<>]++|(?i:\b(?:host(?:name)?|endpoint|server|url))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,}+)""", "text rlike '[:=]'"),
}
#: The last group of an assignment, of which six characters are needed.
_LAST = rf"[:=]\x20*[\"']?({_VALUE}+)$"
SCOPE = 256
#: Of each kind of span its role (0 identifier, 1 secret, 2 endpoint) and the number that a weak part reports.
ROLES = {"access": (0, -1), "weak_id": (0, 3), "assign": (1, -1), "hex": (1, -1), "weak_secret": (1, 4), "endpoint": (2, -1)}


def linked_parts(slim: DataFrame) -> DataFrame:
    """rid, s, k, e of the weak parts of ``slim`` (rid, parts) whose scope holds parts of both other roles."""
    # Rows without a weak part have nothing to report, whatever else they hold.
    one = slim.where(F.exists("parts", lambda p: p["k"] >= 0)).select("rid", F.explode("parts").alias("p")).select("rid", "p.*")
    # A part lies in the blocks that it touches; of each block count the first start and the last end.
    blocks = F.explode(F.sequence(F.floor(F.col("s") / SCOPE), F.floor((F.col("e") - 1) / SCOPE))).alias("block")
    reduced = one.select("rid", F.col("role").alias("other"), "s", "e", blocks).groupBy("rid", "block", "other").agg(F.min("s").alias("first"), F.max("e").alias("last"))
    reach = F.explode(F.sequence(F.floor((F.col("s") - SCOPE) / SCOPE), F.floor((F.col("e") - 1 + SCOPE) / SCOPE))).alias("block")
    near = one.where("k >= 0").select("rid", "s", "e", "k", "role", reach).join(reduced, ["rid", "block"])
    # Blocks to the left are near enough if their last end is, blocks to the right if their first start is.
    near = near.where((F.col("other") != F.col("role")) & (F.col("last") >= F.col("s") - SCOPE) & (F.col("first") <= F.col("e") + SCOPE))
    both = near.groupBy("rid", "s", "e", "k").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a < b")
    return both.select("rid", "s", "k", "e")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added: one row per row of ``docs``."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = with_matches(src, "text", PATTERNS)
    src = src.withColumns({
        "assign": F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], _LAST, 1)) >= 6),
        "access": F.filter("access", lambda x: F.length(x["m"]) >= 20),
    })
    src = src.withColumn("base", tagged({"assign": 0, "access": 1, "hex": 2}))
    free = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))
    src = src.withColumns({k: F.filter(k, free) for k in ("weak_id", "weak_secret")})
    parts = F.concat(*[F.expr(f"transform({c}, x -> named_struct('s', x.s, 'e', x.e, 'role', {role}, 'k', {k}))") for c, (role, k) in ROLES.items()])
    slim = written(src.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "base", parts.alias("parts")), "secret-slim")
    added = linked_parts(slim).groupBy("rid").agg(F.collect_set(F.struct("s", "k", "e")).alias("added"))
    out = slim.select("rid", "doc_id", "base").join(added, "rid", "left")
    out = out.withColumn("added", F.coalesce("added", F.array().cast("array<struct<s:int,k:int,e:int>>")))
    out = out.withColumn("all", F.array_sort(F.concat("base", "added")))
    return out.select("doc_id", *counted("base", KINDS[:3]), F.sha2(listed("base", KINDS), 256).alias("base_sha256"), listed("all", KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"))
