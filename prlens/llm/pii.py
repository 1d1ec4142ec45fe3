"""Information-theoretic sanitisation of personal data, in built-in expressions only.

Base spans (e-mail addresses, IP addresses, card numbers, phone numbers) are the protected entities. Words (three
letters or more, outside base spans) anywhere in a document with an entity are its terms. Over the corpus, a term t
discloses an entity e by the information that seeing t gives about e, as a share of all there is: PMI(t; e) / IC(e),
with PMI = ln(p(t, e) / (p(t) p(e))) and IC = -ln p(e); p counts documents. IC weighs rare entities, none is left out.
Every occurrence of a term at or above the threshold for any entity is a span, in all documents, and is removed.

Defined results: null and empty texts hold no spans; a null id is carried; repeated rows count one by one and get
equal spans; an empty table gives an empty table; positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prlens.llm._arrow import written

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. They match what the plain patterns of their kind match, leftmost and non-overlapping, but never
#: look twice at a run of characters: a match starts where a run starts or where the match before it ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_IP_OK = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: Words, and pieces of a text that no border of a word falls into.
WORD = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])"
_LONG, _SHORT = r"(?s).{1,20000}+[\p{L}\p{N}]*+", r"(?s).{1,200}+[\p{L}\p{N}]*+"
#: Most hash values that are broadcast to leave out, before a shuffle, words that are no told terms: the terms' whole
#: hashes while there are no more terms than that, else their remainders, which let other words through as well.
BUCKETS = 1 << 21


def located(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<s, e, v>>``: code points from and to, and the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["f"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["f"].alias("v")))).alias("out"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda f, b: F.struct(f.alias("f"), b.alias("b")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step)["out"]).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind; a cheap test keeps texts without any sign of a kind from its pattern."""
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    return {
        "email": F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none),
        "ip": F.when(F.contains(text, F.lit(".")), F.filter(located(text, IP), lambda x: x["v"].rlike(_IP_OK))).otherwise(none),
        "card": F.filter(located(text, CARD), lambda x: luhn(_digits(x["v"]))),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE), lambda x: F.length(_digits(x["v"])).between(8, 15))).otherwise(none),
    }


def _written_spans(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(kind + ":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def _bare(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))

    def step(acc: Column, x: Column) -> Column:
        s, e = F.greatest(x["s"], acc["at"]), F.greatest(x["e"], acc["at"])
        return F.struct(e.alias("at"), F.concat(acc["out"], text.substr(acc["at"] + 1, s - acc["at"]), F.repeat(F.lit(" "), e - s)).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], text.substr(done["at"] + 1, F.length(text)))).otherwise(text)


def _words(text: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.lower(w)))


def _occurrences(bare: DataFrame) -> DataFrame:
    """``row``, ``s``, ``e`` and ``term`` of every word; texts are cut into pieces, so that time grows with their length."""
    rows = bare.select("row", F.explode(located(F.col("_b"), _LONG)).alias("x"))
    rows = rows.select("row", F.col("x.s").alias("_s"), F.explode(located(F.col("x.v"), _SHORT)).alias("x"))
    rows = rows.select("row", (F.col("_s") + F.col("x.s")).alias("_s"), F.explode(located(F.col("x.v"), WORD)).alias("x"))
    return rows.select("row", (F.col("_s") + F.col("x.s")).alias("s"), (F.col("_s") + F.col("x.e")).alias("e"), F.lower("x.v").alias("term"))


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per document: counts of each kind, ``base`` and ``terms`` (arrays of spans), ``row`` (a hash of id and text).

    Only the spans, and the words of documents that hold an entity, are kept between the steps, in a table in the
    shared folder. Words of all documents are counted in their tasks first; their places are looked up by the told terms.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    spans = docs.select(F.col(key).alias("_id"), t.alias("_t"))
    found = spans.select("_id", "_t", F.xxhash64("_id", "_t").alias("row"), *[c.alias(k) for k, c in base_spans(F.col("_t")).items()])
    tagged = lambda k: F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.lit(k).alias("kind")))
    found = found.withColumn("_all", F.concat(*[tagged(k) for k in KINDS]))
    found = found.withColumn("_b", _bare(F.col("_t"), F.col("_all")))
    named = F.transform("_all", lambda x: F.concat(x["kind"], F.lit(":"), F.when(x["kind"] == "email", F.lower(x["v"])).otherwise(F.regexp_replace(x["v"], "[^0-9.]", ""))))
    slim = written(found.select("_id", "row", *KINDS, F.array_distinct(named).alias("entities"), F.when(F.size("_all") > 0, _words(F.col("_b"))).alias("words")), "pii")
    total = slim.count()
    n = F.lit(float(max(total, 1)))
    entities = slim.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") < n)
    entities = written(entities, "pii-entities")
    together = slim.where(F.size("words") > 0).select("entities", F.explode("words").alias("term")).select("term", F.explode("entities").alias("entity"))
    pairs = together.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_te")).join(entities, "entity")
    # as n_te <= n_e, PMI / IC >= threshold needs n_t <= n_e ** threshold * n ** (1 - threshold): words in more documents tell of no entity
    most = entities.agg(F.max("n_e")).first()[0] or 0
    counts = found.select(F.explode(_words(F.col("_b"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    counts = counts.where(F.col("n_t") <= most**threshold * max(total, 1) ** (1 - threshold) + 1)
    pmi = F.log(F.col("n_te") * n / (F.col("n_t") * F.col("n_e")))
    told = written(pairs.join(counts, "term").where(pmi >= threshold * F.log(n / F.col("n_e")) - 1e-9).select("term").distinct(), "pii-told")
    bucket = (F.xxhash64("term") if told.count() <= BUCKETS else F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).alias("_bucket")
    places = _occurrences(found.select("row", "_b")).withColumn("_bucket", bucket)
    places = places.join(F.broadcast(told.select(bucket).distinct()), "_bucket", "left_semi").drop("_bucket").join(told, "term", "left_semi")
    added = places.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("s", "e", F.col("term").alias("v")))).alias("terms"))
    out = slim.drop("words", "entities").join(added, "row", "left")
    return out.select(F.col("_id").alias(key), "row", *KINDS, F.coalesce("terms", F.array().cast("array<struct<s:int,e:int,v:string>>")).alias("terms"))


def span_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    base = F.concat(*[_written_spans(k, F.col(k)) for k in KINDS])
    return found.select(
        key, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _written_spans("term", F.col("terms"))), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def sanitize(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` sanitised: base spans become their kind in brackets (generalised), disclosing terms go (removed).

    Where spans overlap, the one that starts first (then the longer) counts.
    """
    change = lambda k: F.transform(F.col(f"_p_{k}"), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.lit("" if k == "terms" else f"[{k}]").alias("to")))
    every = F.array_sort(F.concat(*[change(k) for k in (*KINDS, "terms")]))
    t = F.coalesce(F.col(text), F.lit(""))

    def step(acc: Column, x: Column) -> Column:
        put = F.struct((-x["e"]).alias("at"), F.concat(acc["out"], t.substr(acc["at"] + 1, x["s"] - acc["at"]), x["to"]).alias("out"))
        return F.when(x["s"] >= acc["at"], put).otherwise(acc)

    done = F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    spans = found.dropDuplicates(["row"]).select(*[F.col(c).alias(f"_p_{c}") for c in ("row", *KINDS, "terms")])  # names that no column of docs has
    joined = docs.join(spans, F.xxhash64(F.col(key), t) == F.col("_p_row"), "left")
    clean = F.when(F.size("_p_email").isNull(), F.col(text)).otherwise(F.concat(done["out"], t.substr(done["at"] + 1, F.length(t))))
    return joined.withColumn(text, clean).select(*docs.columns)
