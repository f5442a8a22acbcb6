"""Secret scan with multipart credential linking, in SQL functions only.

Base findings stand by themselves: assigned secrets, access key ids and long hexadecimal strings. Weak parts
do not: identifiers that are merely assigned (user, account, client id), strings that merely look random,
and endpoints (URLs, host:port). A weak part is reported only if a complementary part lies in its scope, the places
at most ``SCOPE`` code points from its start: a random string beside an identifier or an endpoint, an identifier beside a
secret, an endpoint beside a secret.

The interval join runs on buckets of ``SCOPE`` code points. For each (document, bucket, role) only the first and last
start are kept, combined before the shuffle: parts of the same bucket are always in scope, of the one before the last decides, of the one
after the first. So each part meets at most three rows of each role, however many parts a document has, and a
document with very many parts is spread over its buckets.

Cases: null text is empty (no findings); repeated rows have equal results; rows that share a doc_id but not their text are separate; null doc_id is kept;
very long texts are scanned whole; equal starts are ordered by kind as listed in ``KINDS``; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .spans import SPAN, redacted, shown, spans, tagged, where_any

#: Code points from start to start.
SCOPE = 200
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
# The patterns. Searching long runs from their beginning only keeps the scan linear.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
WEAK_ID = r"""(?<![A-Za-z0-9_])(?i:user|username|login|account|client_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = (
    r"""(?:https?|ftp|ssh|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]{3,}"""
    r"|(?<![A-Za-z0-9.-])(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9][A-Za-z0-9.-]*+:[0-9]{2,5}(?![0-9])"
)


def looks_random(s: Column) -> Column:
    """Upper and lower case, two digits, and at least 14 different characters."""
    return s.rlike("[a-z]") & s.rlike("[A-Z]") & s.rlike("[0-9].*[0-9]") & (F.size(F.array_distinct(F.split(s, ""))) >= 14)


def apart(found: Column, base: list[Column]) -> Column:
    """Spans that touch none of the base spans."""
    whole = F.concat(*base)
    return F.filter(found, lambda x: ~F.exists(whole, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans): the spans of each row as array of (start, no, kind, stop), sorted by start and kind."""
    c = F.col
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    base = {
        "assign": F.filter(where_any(c("text").rlike(r"(?i:passw|secret|token|api_?key)"), spans(c("text"), ASSIGN, part=1)), lambda x: F.char_length(x["part"]) >= 8),
        "access": where_any(F.contains("text", F.lit("AKIA")), spans(c("text"), ACCESS)),
        "hex": where_any(c("text").rlike("[0-9a-f]{32}"), spans(c("text"), HEX)),
    }
    rows = rows.withColumns(base)
    weak = {
        "weak_id": where_any(c("text").rlike(r"(?i:user|login|account|client_?id|key_?id)"), spans(c("text"), WEAK_ID)),
        "weak_secret": F.filter(where_any(c("text").rlike("[A-Za-z0-9+/_-]{20}"), spans(c("text"), WEAK_SECRET)), lambda x: looks_random(x["found"])),
        "endpoint": where_any(F.contains("text", F.lit("://")) | c("text").rlike(r"[A-Za-z0-9]:[0-9]{2}"), spans(c("text"), ENDPOINT)),
    }
    own = [c(k) for k in base]
    return rows.withColumns({k: apart(v, own) for k, v in weak.items()})


def linked(found: DataFrame) -> DataFrame:
    """(doc_id, mark, weak): the weak spans of each text that have a complementary part in their scope."""
    c = F.col
    role = {"assign": "secret", "hex": "secret", "access": "id", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
    needs = {"weak_id": ["secret"], "weak_secret": ["id", "endpoint"], "endpoint": ["secret"]}

    def parts_of(k: str) -> Column:
        return F.transform(c(k), lambda x: F.struct(F.lit(k).alias("kind"), F.lit(KINDS.index(k)).alias("no"), F.lit(role[k]).alias("role"), x["start"].alias("start"), x["stop"].alias("stop")))

    each = F.concat(*map(parts_of, KINDS))
    some = found.where(F.size("weak_id") + F.size("weak_secret") + F.size("endpoint") > 0)
    parts = some.select("doc_id", "mark", F.explode(each).alias("p")).select("doc_id", "mark", "p.*").withColumn("bucket", F.floor(c("start") / SCOPE)).distinct()
    parts = written(parts, "parts")
    ends = parts.groupBy("doc_id", "mark", "bucket", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    near = ends.select("doc_id", "mark", "role", "first", "last", c("bucket").alias("of"), F.explode(F.array(c("bucket") - 1, c("bucket"), c("bucket") + 1)).alias("bucket"))
    weak = parts.where(c("kind").isin(*needs)).alias("w")
    fits = F.lit(False)
    for kind, roles in needs.items():
        fits = fits | ((c("w.kind") == kind) & c("n.role").isin(*roles))
    reach = (c("n.of") == c("n.bucket")) | ((c("n.of") < c("n.bucket")) & (c("w.start") - c("n.last") <= SCOPE)) | ((c("n.of") > c("n.bucket")) & (c("n.first") - c("w.start") <= SCOPE))
    same = c("w.doc_id").eqNullSafe(c("n.doc_id")) & (c("w.mark") == c("n.mark")) & (c("w.bucket") == c("n.bucket"))
    hits = weak.join(near.alias("n"), same & fits & reach, "left_semi")
    span = F.struct("start", "no", "kind", "stop")
    return hits.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(span)).alias("weak"))


def findings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, all): counts, and sorted spans as arrays of (start, no, kind, stop)."""
    c = F.col
    found = scan(docs).withColumn("mark", F.xxhash64("text"))
    keep = ["text"] if with_text else []
    found = written(found.select("doc_id", "mark", *keep, *KINDS), "findings")
    base = F.sort_array(F.concat(*[tagged(c(k), k, KINDS.index(k)) for k in KINDS[:3]]))
    rows = found.select("doc_id", "mark", *keep, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], base.alias("base")).alias("r")
    weak = linked(found).alias("w")
    out = rows.join(weak, c("r.doc_id").eqNullSafe(c("w.doc_id")) & (c("r.mark") == c("w.mark")), "left")
    every = F.when(c("weak").isNull(), c("base")).otherwise(F.sort_array(F.concat("base", "weak")))
    return out.select("r.doc_id", *keep, *[f"n_{k}" for k in KINDS[:3]], "base", every.alias("all"))


def digests(docs: DataFrame) -> DataFrame:
    c = F.col
    return findings(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(shown(c("base")), 256).alias("base_sha256"), shown(c("all")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every finding replaced by its kind."""
    return findings(docs, with_text=True).select("doc_id", redacted(F.col("text"), F.col("all"), lambda x: F.concat(F.lit("<"), x["kind"], F.lit(">"))).alias("text"))


__all__ = ["SPAN", "digests", "findings", "masked"]
