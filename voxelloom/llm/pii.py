"""Personal data: base patterns, and bootstrapped contextual extraction. SQL functions only.

Base spans come from four patterns. The method then learns where identifiers stand: every token that
has a digit or an at sign is an instance, and so is every run of tokens without letters that are written as
groups of digits, one blank apart; punctuation around it is none of it. The words around an instance (two before; one before and one after,
whole words whatever their length) are its lexical patterns. Patterns and instances form a bipartite
graph. Tokens that base spans cover are the first seeds of their kind. Each round scores the patterns, a
pattern's confidence in a kind being the mean confidence of its distinct instances in it (discounted for
few), and trusts those of ``TRUST`` that rest on ``MIN_SEEDS`` accepted instances; trusted patterns then
speak for the unseen tokens that stand in them, in whatever format: a pattern speaks for a token by its
confidence, times the shares of its instances that have an at sign and letters where the token has (or
lack them with it), times how near their digit counts are. A token of joint score ``TRUST`` (one minus the
product of its patterns' doubts) is accepted for the kind that scores best, and is a seed of the next
round, where it induces new patterns. The patterns of the last round discover the spans that are added.

The graph holds distinct (pattern, instance) pairs of the whole corpus, gathered by partial aggregates,
and scores move by joins on either side; nothing is collected. Tokens meet the base spans of their row by
blocks of ``BLOCK`` characters, so that rows with very many of both make no pairs beyond a block.

Edge cases: null text is empty text; without seeds nothing is added; repeated rows are judged each;
a null key is returned as it is; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.spans import counted, listed, tagged, with_matches
from voxelloom.session import written

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: Equal to the plain patterns in what they match: starts inside a run that fails at its start are left out.
PATTERNS = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "contains(text, '.')"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13,}+", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')"),
}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_GROUP = r"[^\s\p{L}0-9@]*+[0-9][^\s\p{L}@]*+(?!\S)"
TOKEN = rf"(?<!\S)(?:{_GROUP}(?:\x20{_GROUP})*+|[^\s0-9@]*+[0-9@]\S*+)"
#: What stands around an instance without being part of it.
BEFORE, AFTER = r"^[(\[{<\"'`*]+", r"[)\]}>\"'`*.,;:!?]+$"
MIN_SEEDS = 3
TRUST = 0.6
ROUNDS = 4
#: Characters of a block in which tokens meet base spans.
BLOCK = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check that doubles every second digit from the right."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    double = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return F.aggregate(double, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x["m"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda x: F.length(_digits(x["m"])).between(14, 19) & luhn(_digits(x["m"])),
    "phone": lambda x: F.length(_digits(x["m"])).between(10, 15),
}


def base_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (array of s, k, e) and the rows' tokens (with their words around) that may be identifiers."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = with_matches(src, "text", PATTERNS | {"tok": (TOKEN, None)}, context="tok").drop("text")
    kept = {k: F.filter(F.col(k), VALID[k]) for k in KINDS}
    return src.withColumns(kept).select("doc_id", tagged({k: i for i, k in enumerate(KINDS)}).alias("base"), "tok")


SOFT = ("at", "letters", "digits")


def _features(t: Column) -> dict[str, Column]:
    """Soft evidence of a token's kind: at sign, letters, number of digits."""
    return {"at": t.contains("@").cast("double"), "letters": t.rlike(r"\p{L}").cast("double"), "digits": F.length(_digits(t)).cast("double")}


def _blocks() -> Column:
    return F.explode(F.sequence(F.floor(F.col("s") / BLOCK), F.floor((F.col("e") - 1) / BLOCK))).alias("block")


def _instances(slim: DataFrame) -> DataFrame:
    """One row per identifier-like token: place, text, its patterns and the base kind that covers it, if any."""
    one = slim.select("rid", (F.size("base") > 0).alias("known"), F.explode("tok").alias("t")).select("rid", "known", "t.*")
    outer = [F.length("m") - F.length(F.regexp_replace("m", p, "")) for p in (BEFORE, AFTER)]
    one = one.withColumns({"s": F.col("s") + outer[0], "e": F.col("e") - outer[1], "m": F.regexp_replace(F.regexp_replace("m", BEFORE, ""), AFTER, "")})
    two = F.when(F.size("left") == 2, F.concat(F.lit("2 "), F.lower(F.array_join("left", " "))))
    near = F.when((F.size("left") > 0) | F.col("right").isNotNull(), F.concat(F.lit("1 "), F.concat_ws(" _ ", F.lower(F.try_element_at("left", F.lit(-1))), F.lower("right"))))
    patterns = F.filter(F.array(two, near), lambda p: F.length(p) > 5)
    one = one.select("rid", "known", "s", "e", F.lower("m").alias("tok"), patterns.alias("patterns"))
    spans = slim.where(F.size("base") > 0).select("rid", F.explode("base").alias("b")).select("rid", "b.*").select("rid", "k", F.col("s").alias("bs"), F.col("e").alias("be"), _blocks())
    meet = one.where("known").select("rid", "s", "e", _blocks()).join(spans, ["rid", "block"]).where("bs < e and be > s")
    kinds = meet.groupBy("rid", "s").agg(F.min(F.struct("bs", "k")).getField("k").alias("kind"))
    names = ["rid", "s", "e", "tok", "kind", "patterns"]
    return one.where("known").join(kinds, ["rid", "s"], "left").select(*names).unionByName(one.where("not known").withColumn("kind", F.lit(None).cast("int")).select(*names))


def _spoken(free: DataFrame, trusted: DataFrame, by: list[str]) -> DataFrame:
    """``by``, kind, conf: what trusted patterns speak for among ``free`` (by, tok, pattern), with joint scores of ``TRUST``."""
    own = free.select(*by, "pattern", *[f.alias(f"own_{c}") for c, f in _features(F.col("tok")).items()])
    same = [1 - F.abs(F.col(f"own_{c}") - F.col(c)) for c in ("at", "letters")]
    near = (F.least("own_digits", "digits") + 1) / (F.greatest("own_digits", "digits") + 1)
    score = F.col("conf") * same[0] * same[1] * F.when(F.col("own_at") > 0, 1.0).otherwise(near * near)  # names, not digits, make addresses
    joint = own.join(trusted, "pattern").withColumn("score", score).groupBy(*by, "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))).alias("conf")).where(F.col("conf") >= TRUST)
    best = joint.groupBy(*by).agg(F.max(F.struct("conf", -F.col("kind"))).alias("x"))
    return best.select(*by, (-F.col("x.col2")).alias("kind"), "x.conf")


def score_patterns(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, conf, at, letters, digits: trusted patterns with what their instances are like."""
    edges = occurrences.select(F.explode("patterns").alias("pattern"), "tok", "kind").groupBy("pattern", "tok").agg(F.max("kind").alias("kind"))
    edges = written(edges, "pii-edges")
    size = written(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SEEDS), "pii-sizes")
    seeds = written(edges.where("kind is not null").groupBy("tok").agg(F.max("kind").alias("kind")).withColumn("conf", F.lit(1.0)), "pii-seeds")
    unseen = edges.join(seeds.select("tok"), "tok", "left_anti")
    accepted = seeds
    for i in range(rounds):
        hits = edges.select("pattern", "tok").join(accepted, "tok").withColumns(_features(F.col("tok")))
        like = [F.avg(c).alias(c) for c in SOFT]
        score = hits.groupBy("pattern", "kind").agg(F.sum("conf").alias("sum"), F.count("*").alias("m"), *like).where(F.col("m") >= MIN_SEEDS).join(size, "pattern")
        trusted = score.select("pattern", "kind", (F.col("sum") / (F.col("n") + 1)).alias("conf"), *SOFT).where(F.col("conf") >= TRUST)
        trusted = written(trusted, "pii-patterns")
        if i < rounds - 1:
            accepted = written(seeds.unionByName(_spoken(unseen, trusted, ["tok"])), "pii-accepted")
    return trusted


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per row of ``docs``."""
    slim = base_spans(docs, key, text).withColumn("rid", F.monotonically_increasing_id())
    slim = written(slim, "pii-slim")
    seen = written(_instances(slim), "pii-instances")
    trusted = score_patterns(seen)
    free = seen.where("kind is null").select("rid", "s", "e", "tok", F.explode("patterns").alias("pattern"))
    added = _spoken(free, trusted, ["rid", "s", "e"]).select("rid", F.struct("s", F.col("kind").alias("k"), "e").alias("x")).groupBy("rid").agg(F.collect_list("x").alias("added"))
    out = slim.select("rid", "doc_id", "base").join(added, "rid", "left")
    out = out.withColumn("added", F.coalesce("added", F.array().cast("array<struct<s:int,k:int,e:int>>")))
    out = out.withColumn("all", F.array_sort(F.concat("base", "added")))
    return out.select("doc_id", *counted("base", KINDS), F.sha2(listed("base", KINDS), 256).alias("base_sha256"), listed("all", KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"))
