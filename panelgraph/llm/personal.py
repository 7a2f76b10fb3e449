"""Personal data: fixed patterns, and terms that give the protected values away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Each distinct value is a
protected entity. All words outside base spans of the documents that name it are candidate terms, and what
the corpus tells decides: with N documents, n(e) of them naming e, n(t) having t and n(t, e) both, the term
discloses

    PMI(t; e) = log2(n(t, e) N / (n(t) n(e)))   of   IC(e) = log2(N / n(e))   bits.

A term whose PMI reaches ``SHARE`` of the information content is a disclosure, unless chance explains it: of
the m different texts that name e (copies are one observation) k have t with a probability of at most
2^(-m D(k / m || n(t) / N)) by Chernoff's bound, and that times the number of their words must stay within ``DOUBT``. Two documents are enough
for that in a few hundred, a single one in a hundred times as many as it has words. In documents that name e such
terms become spans too, and the sanitised text replaces values by their kind and terms by ``[TERM]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables, let, whole

#: The patterns as agreed, written so that a failed try does not scan a run of characters again.
#: ``(?:(?<![c])|\G)`` lets a match begin only at the start of a run of c, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM_KIND = "term"

SHARE, DOUBT = 0.8, 0.01
LETTERS = r"\p{L}{2,}+"
SPAN = "struct<start:int,end:int,value:string>"


def find(text: Column, pattern: Column | str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches in code points, end exclusive."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def place(gaps: Column) -> Column:
        return let(found, lambda values: F.aggregate(
            F.zip_with(gaps, values, lambda g, v: F.struct(g.alias("g"), v.alias("v"))),
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["g"]) + F.coalesce(F.length(x["v"]), F.lit(0))).alias("at"),
                F.when(x["v"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + F.length(x["g"])).alias("start"), (acc["at"] + F.length(x["g"]) + F.length(x["v"])).alias("end"), x["v"].alias("value"),
                )))).alias("spans"),
            ),
            lambda acc: acc["spans"],
        ))

    return let(between, place)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(plain) <= 3) & (F.coalesce(F.try_to_number(plain, F.lit("999")), F.lit(999)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def base_spans(text: Column) -> Column:
    """struct of one span array per kind. Patterns only run over texts that can match."""
    t = whole(text)
    none = F.array().cast(f"array<{SPAN}>")

    def kept(possible: Column, pattern: str, valid) -> Column:
        return F.when(possible, F.filter(find(t, pattern), lambda s: valid(s["value"]))).otherwise(none)

    def card(value: Column) -> Column:
        return F.length(_digits(value)).between(13, 19) & _luhn(_digits(value))

    return F.struct(
        kept(t.contains("@"), EMAIL, lambda v: F.lit(True)).alias("email"),
        kept(t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP, _ip).alias("ip"),
        kept(t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD, card).alias("card"),
        kept(t.rlike(r"\+[0-9]"), PHONE, lambda v: F.length(_digits(v)).between(9, 15)).alias("phone"),
    )


def labelled(spans: dict[str, Column]) -> Column:
    """``kind:start:end`` by kind, then start, comma-joined."""

    def named(kind: str, found: Column) -> Column:
        return F.transform(found, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[named(k, a) for k, a in spans.items()]), ",")


def _observed(docs: DataFrame) -> DataFrame:
    """doc, entities, words (different, outside base spans), copies of every different text."""
    found = docs.withColumn("base", base_spans(F.col("text")))
    base = {k: F.col(f"base.{k}") for k in KINDS}

    def named(kind: str) -> Column:
        value = (lambda v: _digits(v)) if kind in ("card", "phone") else F.lower
        return F.transform(base[kind], lambda s: F.concat_ws(":", F.lit(kind), value(s["value"])))

    words = F.array_distinct(F.regexp_extract_all(F.lower(sanitised(F.col("text"), base, F.lit(" "))), F.lit(LETTERS), F.lit(0)))
    return found.select("doc", F.array_distinct(F.concat(*map(named, KINDS))).alias("entities"), words.alias("words")).dropDuplicates(["doc"]).join(
        docs.select("doc", "row").distinct().groupBy("doc").agg(F.count("*").alias("copies")), "doc"
    )


def disclosures(tables: Tables, docs: DataFrame, share: float = SHARE, doubt: float = DOUBT) -> DataFrame:
    """doc, terms: for each text that names an entity, the terms that disclose it.

    docs: doc (a key of the text), row (one of the document), text. Counts cover all documents. Words are counted first; those too
    common to disclose any entity of their text fall before words meet entities.
    """
    observed = tables.write("observed", _observed(docs))
    n = F.lit(observed.agg(F.sum("copies")).first()[0] or 0).cast("double")
    naming = observed.where(F.size("entities") > 0)
    mentions = tables.write("mentions", naming.select("doc", "copies", F.size("words").alias("tried"), F.explode("entities").alias("entity")))
    of_entity = tables.write("of_entity", mentions.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts"), F.sum("tried").alias("tried")))
    of_term = tables.write("of_term", observed.select("copies", F.explode("words").alias("term")).groupBy("term").agg(F.sum("copies").alias("n_t")))

    # PMI >= share * IC asks for n(t) <= n(t, e) (N / n(e))^(1 - share), which is n(e)^share N^(1 - share) at most
    known = tables.write("known", mentions.select("doc", "copies", "entity").join(of_entity, "entity"))
    most = known.groupBy("doc").agg(F.max("n_e").alias("most"))
    rare = naming.select("doc", F.explode("words").alias("term")).join(of_term, "term").join(most, "doc").where(
        F.col("n_t") <= F.pow("most", F.lit(share)) * F.pow(n, F.lit(1 - share)) * 1.000001
    )
    both = rare.select("doc", "term", "n_t").join(known, "doc").groupBy("entity", "term", "n_t", "n_e", "texts", "tried").agg(
        F.sum("copies").alias("both"), F.count("*").alias("seen")
    )
    content, p, a = F.log2(n / F.col("n_e")), F.col("n_t") / n, F.col("seen") / F.col("texts")
    bits = F.col("texts") * (a * F.log2(a / p) + F.when(a < 1, (1 - a) * F.log2((1 - a) / (1 - p))).otherwise(0.0))
    disclosed = tables.write("disclosed", both.where(
        (content > 0) & (F.log2(F.col("both") * n / (F.col("n_t") * F.col("n_e"))) >= share * content) & (a > p) & (bits >= F.log2(F.col("tried") / doubt))
    ).select("entity", "term"))
    found = mentions.select("doc", "entity").join(disclosed, "entity").select("doc", "term").distinct()
    here = naming.select("doc", F.explode("words").alias("term")).join(found, ["doc", "term"], "left_semi")
    return tables.write("terms", here.groupBy("doc").agg(F.collect_set("term").alias("terms")))


def detect(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), share: float = SHARE, doubt: float = DOUBT) -> DataFrame:
    """keep columns, text, and one span array for each kind and for ``term``.

    docs: doc_id, text and what ``keep`` names; others are ignored. Null texts count as empty and have no
    span. Repeated rows (same id and text) are one document to the counts, equal texts get the same spans. Terms
    inside a base span are left to it. An empty table gives an empty result.
    """
    tables = Tables(docs.sparkSession, "personal")
    key = F.xxhash64(whole("text"))
    columns = tuple(dict.fromkeys((*keep, "text")))
    keyed = docs.select(key.alias("doc"), F.xxhash64("doc_id", whole("text")).alias("row"), whole("text").alias("text"))
    terms = disclosures(tables, keyed, share, doubt)
    tables.drop("observed", "mentions", "of_entity", "of_term", "known", "disclosed")
    joined = docs.select(*columns, key.alias("__doc")).join(terms, F.col("__doc") == F.col("doc"), "left")
    spotted = joined.withColumn("base", base_spans(F.col("text")))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort("terms"), "|"), F.lit(r")(?!\p{L})"))
    inside = lambda s: F.exists(F.concat(*[F.col(f"base.{k}") for k in KINDS]), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    own = F.when(F.col("terms").isNotNull(), F.filter(find(whole("text"), pattern), lambda s: ~inside(s))).otherwise(F.array().cast(f"array<{SPAN}>"))
    return spotted.withColumn("term", own).select(*columns, *[F.col(f"base.{k}").alias(k) for k in KINDS], "term")


def sanitised(text: Column, spans: dict[str, Column], mark: Column | None = None) -> Column:
    """The text with every span replaced by its kind in capitals (or ``mark``); of spans that overlap, the later gives way."""

    def tagged(kind: str, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.lit(f"[{kind.upper()}]") if mark is None else mark).alias("tag")))

    every = F.array_sort(F.concat(*[tagged(k, a) for k, a in spans.items()]))
    t = whole(text)

    def replaced(ss: Column) -> Column:
        joined = F.aggregate(
            ss, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), s["tag"])).otherwise("")).alias("out"),
            ),
            lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))),
        )
        return F.when(F.size(ss) == 0, text).otherwise(joined)

    return let(every, replaced)
