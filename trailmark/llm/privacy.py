"""Personal data and information-theoretic sanitisation, in SQL functions only.

Base findings are e-mail addresses, IP addresses, card and phone numbers. Each distinct value is a protected entity.
A term (a word of a document that holds it, wherever it stands) discloses an entity as far as it predicts it: with counts of documents
over the whole corpus, PMI(e; t) = log2(N n(e,t) / (n(e) n(t))), against the entity's information IC(e) = log2(N / n(e)). All four
are counts of the same event, a document that holds them anywhere. A ratio of ``GENERALISE`` or more is too much: the term is generalised to its shape in all documents that hold the entity, from
``REMOVE`` on it is removed. A ratio is evidence only where it rests on more than one passage, so copies of one text prove
nothing: an entity counts from ``CONTEXTS`` different passages on (the ``REACH`` characters on either side of it), and a pair from so many too.
Texts that only share a short line with the entity, as a signature, are different passages. Passages are evidence only; they bound no term.

Each different text that holds an entity with enough passages is cut into its different terms once, a row for each term and such
entity of it; terms are counted over the whole corpus. All counts are combined before the shuffle, so a term or an entity
that a third of the documents have is a single key of counts. No pairs of documents arise.

Cases: null text is empty (no findings); repeated rows have equal results and count as documents each; rows that share a doc_id but not
their text are separate; null doc_id is kept; overlapping findings of different kinds all stay; equal ratios are treated alike; very long texts and runs are
scanned whole, in time linear in their length; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .spans import let, redacted, shown, spans, tagged, where_any

KINDS = ["email", "ip", "card", "phone", "term"]
#: Disclosure ratios; least different passages; least letters of a term; characters of a passage on either side; bytes of one in UTF-32.
GENERALISE, REMOVE, CONTEXTS, TERM_LETTERS, REACH, WIDE = 0.8, 0.95, 3, 4, 200, 4
#: Stands for a separator between two digits or two labels in a copy that is only searched: runs are then one class, matched without recursion.
MARK = "\ue000"
# The patterns. A match begins at the beginning of a run, or where the last one ended, which is the leftmost place.
EMAIL = rf"(?:(?<![A-Za-z0-9._%+{MARK}-])|\G)[A-Za-z0-9._%+{MARK}-]++@[A-Za-z0-9-]+{MARK}[A-Za-z0-9{MARK}-]+"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = rf"[0-9][0-9{MARK}]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[\p{L}][\p{L}\p{N}'_-]*"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    one = lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x: x.cast("int"))
    return F.aggregate(F.transform(values, one), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_findings(text: Column) -> dict[str, Column]:
    """Arrays of spans by kind."""
    unmarked = F.replace(text, F.lit(MARK), F.lit("\ue001"))
    emails = where_any(F.contains(text, F.lit("@")), spans(text, EMAIL, search=F.regexp_replace(unmarked, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)))
    strip = lambda p: F.ltrim(p, F.lit("0"))
    at_most_255 = lambda p: (F.char_length(strip(p)) <= 3) & (F.concat(F.lit("0"), F.substr(strip(p), F.lit(1), F.lit(3))).cast("int") <= 255)
    ips = F.filter(where_any(text.rlike(r"[0-9]\.[0-9]"), spans(text, IP)), lambda x: F.forall(F.split(x["found"], r"\."), at_most_255))
    digits = lambda x: F.regexp_replace(x["found"], "[^0-9]", "")
    length = lambda x, low, high: (F.char_length(digits(x)) >= low) & (F.char_length(digits(x)) <= high)
    marked = F.regexp_replace(unmarked, r"(?<=[0-9])[\x20-](?=[0-9])", MARK)
    cards = F.filter(where_any(text.rlike(r"[0-9][0-9\x20-]{11}[0-9]"), spans(text, CARD, search=marked)), lambda x: F.when(length(x, 13, 19), luhn(digits(x))).otherwise(F.lit(False)))
    phones = F.filter(where_any(text.rlike(r"\+[0-9]"), spans(text, PHONE)), lambda x: length(x, 9, 15))
    return {"email": emails, "ip": ips, "card": cards, "phone": phones}


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark, email, ip, card, phone)."""
    c = F.col
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"mark": F.xxhash64("text")} | base_findings(c("text")))


def terms(text: Column) -> Column:
    """The different words of a text, in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}'_-]+"), lambda w: (F.char_length(w) >= TERM_LETTERS) & w.rlike(r"^\p{L}"))
    return F.array_distinct(words)


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, ratio): terms that disclose an entity beyond the lower threshold. ``found``: the documents with findings."""
    c = F.col

    def mentions(text: Column) -> Column:
        """Entity and passage of each finding; characters are taken from a copy of equal widths, so each is found at once."""

        def piece(wide: Column, start: Column, n: Column) -> Column:
            return F.decode(F.substr(wide, (start * WIDE + 1).cast("int"), (n * WIDE).cast("int")), "UTF-32")

        def around(wide: Column, x: Column) -> Column:
            before = piece(wide, F.greatest(F.lit(0), x["start"] - REACH), F.least(F.lit(REACH), x["start"]))
            after = piece(wide, x["stop"], F.lit(REACH))
            # A word that the reach cuts is none.
            before = F.when(x["start"] > REACH, F.regexp_replace(before, r"^[\p{L}\p{N}'_-]+", "")).otherwise(before)
            after = F.when((x["stop"] + REACH) * WIDE < F.length(wide), F.regexp_replace(after, r"[\p{L}\p{N}'_-]+$", "")).otherwise(after)
            return F.concat(before, F.lit("\n"), after)

        def of(wide: Column) -> Column:
            one = lambda k: F.transform(c(k), lambda x: F.struct(F.xxhash64(F.lit(k), F.lower(x["found"])).alias("entity"), around(wide, x).alias("passage")))
            return F.concat(*map(one, KINDS[:4]))

        return let(F.encode(text, "UTF-32"), of)

    held = found.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("same"), F.explode(mentions(c("text"))).alias("e"))
    held = written(held.select("row", "same", "e.entity", F.xxhash64("e.passage").alias("context")), "mentions")
    known = held.groupBy("entity").agg(F.count_distinct("row").alias("n_e"), F.count_distinct("context").alias("contexts")).where(c("contexts") >= CONTEXTS)
    known = written(known, "entities")
    # Each different text once, with its entities; a text that k rows have is k documents.
    here = held.join(known.select("entity"), "entity").groupBy("same", "entity").agg(F.min("context").alias("context"))
    here = here.groupBy("same").agg(F.collect_list(F.struct("entity", "context")).alias("entities"))
    copies = held.groupBy("same").agg(F.count_distinct("row").alias("copies"))
    texts = found.select(F.xxhash64("text").alias("same"), "text").dropDuplicates(["same"]).join(here.join(copies, "same"), "same")
    words = texts.select("entities", "copies", F.explode(terms(c("text"))).alias("term"))
    pairs = words.select("term", "copies", F.explode("entities").alias("e")).select("e.entity", "e.context", "term", "copies")
    counts = [F.sum("copies").alias("n_et"), F.count_distinct("context").alias("contexts")]
    joint = pairs.groupBy("entity", "term").agg(*counts).where(c("contexts") >= CONTEXTS)
    joint = written(joint.join(known.select("entity", "n_e"), "entity"), "joint")
    wanted = joint.select("term").distinct()
    text = F.coalesce(c("text").cast("string"), F.lit(""))
    # Counted for all terms, as that combines within tasks; joined before, each mention in the corpus would be a row.
    n_t = docs.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term")
    total = docs.agg(F.count("*").alias("n"))
    ratio = F.log2(c("n") * c("n_et") / (c("n_e") * c("n_t"))) / F.log2(c("n") / c("n_e"))
    rated = joint.join(n_t, "term").join(F.broadcast(total)).where("n > n_e").select("entity", "term", ratio.alias("ratio"))  # total is one row
    return rated.where(c("ratio") >= GENERALISE)


def added_terms(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, mark, terms): the places of disclosing terms in the documents that hold their entity."""
    c = F.col
    rates = written(disclosing(found, docs), "rates")
    entity = lambda k: F.transform(c(k), lambda x: F.xxhash64(F.lit(k), F.lower(x["found"])))
    each = found.select("doc_id", "mark", F.explode(F.array_distinct(F.concat(*map(entity, KINDS[:4])))).alias("entity"))
    highest = each.join(rates, "entity").groupBy("doc_id", "mark", "term").agg(F.max("ratio").alias("ratio"))
    wanted = highest.groupBy("doc_id", "mark").agg(F.map_from_entries(F.collect_list(F.struct("term", "ratio"))).alias("wanted"))
    same = c("f.doc_id").eqNullSafe(c("w.doc_id")) & (c("f.mark") == c("w.mark"))
    texts = found.select("doc_id", "mark", "text", *KINDS[:4]).dropDuplicates(["doc_id", "mark"]).alias("f").join(wanted.alias("w"), same)
    base = F.concat(*[c(k) for k in KINDS[:4]])
    rated = F.transform(spans(c("text"), WORD), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.element_at(c("wanted"), F.lower(x["found"])).alias("ratio")))
    free = let(base, lambda b: F.filter(rated, lambda x: x["ratio"].isNotNull() & ~F.exists(b, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"]))))
    return texts.select("f.doc_id", "f.mark", free.alias("terms"))


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_email, n_ip, n_card, n_phone, base, all, removed): ``base`` and ``all`` sorted by kind and start, ``removed`` the starts of terms to remove."""
    c = F.col
    rows = scan(docs)
    with_any = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    found = written(rows.where(with_any), "findings")
    extra = added_terms(found, docs)
    order = lambda k: F.transform(tagged(c(k), k, KINDS.index(k)), lambda x: F.struct(x["no"].alias("no"), x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))
    base = F.sort_array(F.concat(*map(order, KINDS[:4])))
    some = found.withColumn("base", base).alias("r").join(extra.alias("t"), c("r.doc_id").eqNullSafe(c("t.doc_id")) & (c("r.mark") == c("t.mark")), "left")
    empty = F.array().cast("array<struct<no:int,start:bigint,kind:string,stop:bigint>>")
    term = lambda x: F.struct(F.lit(4).alias("no"), x["start"].alias("start"), F.lit("term").alias("kind"), x["stop"].alias("stop"))
    added = F.when(c("t.terms").isNull(), empty).otherwise(F.transform("t.terms", term))
    removed = F.transform(F.filter("t.terms", lambda x: x["ratio"] >= REMOVE), lambda x: x["start"])
    none = F.array().cast("array<bigint>")
    counts = [F.size(f"r.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    some = some.select("r.doc_id", "r.text", *counts, "r.base", F.concat("r.base", added).alias("all"), F.coalesce(removed, none).alias("removed"))
    zeros = [F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    clean = rows.where(~with_any).select("doc_id", "text", *zeros, empty.alias("base"), empty.alias("all"), none.alias("removed"))
    return clean.unionByName(some)


def digests(docs: DataFrame) -> DataFrame:
    c = F.col
    return findings(docs).select("doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(shown(c("base")), 256).alias("base_sha256"), shown(c("all")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text): base findings become their kind, disclosing terms their shape, or nothing from the upper threshold on."""
    c = F.col
    by_start = F.array_sort(F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["no"].alias("no"), x["kind"].alias("kind"), x["stop"].alias("stop"))))
    shape = lambda x: F.regexp_replace(F.regexp_replace(F.substr(c("text"), (x["start"] + 1).cast("int"), (x["stop"] - x["start"]).cast("int")), r"\p{Lu}", "X"), r"\p{L}", "x")

    def label(x: Column) -> Column:
        gone = F.array_contains(c("removed"), x["start"])
        return F.when(x["kind"] != "term", F.concat(F.lit("<"), x["kind"], F.lit(">"))).when(gone, F.lit("")).otherwise(F.regexp_replace(shape(x), "x+", "x"))

    return findings(docs).select("doc_id", F.when(F.size("all") > 0, redacted(c("text"), by_start, label)).otherwise(c("text")).alias("text"))
