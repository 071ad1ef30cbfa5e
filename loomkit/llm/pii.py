"""Operator 10: personal data, found by pattern and by what the corpus discloses.

The patterns give the protected entities: e-mail and IP addresses, card and phone numbers.
Words of a text that holds an entity may reveal it too. With N documents, df(c) that hold the
entity c, df(t) that hold the word t and co that hold both, the information of the entity is
IC(c) = -log2(df(c) / N) and what the word tells of it PMI = log2(co * N / (df(c) * df(t)))
(Sanchez and Batet 2016); a word with PMI >= IC / ``ALPHA`` discloses the entity, and its
occurrences in all documents of the entity are taken too: removed where PMI reaches IC, for
such a word stands with the entity alone, and otherwise generalised to its kind, NAME, NUMBER
or WORD. Rare entities are weighed like the others. As co <= df(c), a word with
df(t) > N * (df(c) / N) ** (1 / ``ALPHA``) can't disclose c and is not paired with it; entities
that stand in the same documents are paired as one. Both leave the result as it is. Only
DataFrame operations are used. The texts of documents that hold an entity are kept where they
are first read, so that no text is ever shuffled to be searched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, saved

KINDS = ("email", "ip", "card", "phone")
ALPHA, SUPPORT = 1.1, 1
TERM = r"[\p{L}\p{N}]+"
#: Words in more than this share of all documents are taken out by a broadcast if they can't disclose anything: a document has a bounded number of them.
COMMON = 0.01

# The contract's patterns; runs that can't match otherwise are possessive, so that long texts need neither stack nor time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_WHOLE = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
STEP = 256


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches of ``pattern``, in code points, end exclusive; [] of null."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.transform(F.slice(gaps, 1, F.size(found)), F.char_length), F.transform(found, F.char_length), lambda g, m: F.struct(g.alias("g"), (g + m).alias("both")))
    zero = F.lit(0)
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x.both)

    def spans(f: Column, ls: Column, sums: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            chunk = F.floor(i / STEP).cast("int")
            start = F.aggregate(F.slice(sums, 1, chunk), zero, lambda s, x: s + x) + total(F.slice(ls, chunk * STEP + 1, i - chunk * STEP)) + ls[i].g
            return F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"))

        return F.transform(f, one)

    # The three arrays are bound once each, by a transform over an array of one.
    sums = lambda ls: F.transform(F.sequence(zero, F.floor(F.size(ls) / STEP).cast("int")), lambda c: total(F.slice(ls, c * STEP + 1, STEP)))
    bound = F.transform(F.array(F.struct(found.alias("f"), lengths.alias("ls"))), lambda x: F.struct(x.f.alias("f"), x.ls.alias("ls"), sums(x.ls).alias("sums")))
    out = F.flatten(F.transform(bound, lambda x: spans(x.f, x.ls, x.sums)))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the spans that pass its test."""
    n = lambda x: F.length(_digits(x.value))
    fits = {
        "email": lambda x: x.value.isNotNull(),
        "ip": lambda x: x.value.rlike(IP_WHOLE),
        "card": lambda x: F.when(n(x).between(16, 19), luhn(_digits(x.value))).otherwise(F.lit(False)),
        "phone": lambda x: n(x).between(8, 15),
    }
    needed = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return {k: F.when(needed[k], F.filter(located(text, PATTERNS[k]), fits[k])).otherwise(none) for k in KINDS}


def _listed(kind: str, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x.start.cast("string"), F.lit(":"), x.end.cast("string"))), ",")


def _joined(parts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), ",")


def find_base(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, email, ip, card, phone, held): the spans of each row; ``whole`` is a hash of its text, null being empty, and ``held`` the text if there are spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", "text", *[s.alias(k) for k, s in base_spans(F.col("text")).items()])
    some = F.expr(" or ".join(f"size({k}) > 0" for k in KINDS))
    return found.select("doc_id", F.xxhash64("text").alias("whole"), *KINDS, F.when(some, F.col("text")).alias("held"))


def _entities(base: DataFrame) -> DataFrame:
    """(doc, entity): the entities of each document, a document being a doc_id with a text."""
    def of(kind: str) -> Column:
        return F.transform(kind, lambda x: F.xxhash64(F.lit(kind), _digits(x.value) if kind in ("card", "phone") else F.lower(x.value)))

    return base.select(_document().alias("doc"), F.explode(F.array_distinct(F.flatten(F.array(*map(of, KINDS))))).alias("entity")).distinct()


def _document() -> Column:
    """The hash of (doc_id, whole); a null doc_id is a value of its own."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "whole")


def _classes(entities: DataFrame) -> DataFrame:
    """(doc, class, df_c): the entities of each document, those that stand in the same documents as one class."""
    # Sets of documents are told apart by their number and two sums of hashes.
    sums = [F.bit_xor(F.xxhash64(F.lit(k), "doc")) for k in (1, 2)]
    by = entities.groupBy("entity").agg(F.count("*").alias("df_c"), F.xxhash64(F.count("*"), *sums).alias("class"))
    return entities.join(by, "entity").groupBy("doc", "class").agg(F.first("df_c").alias("df_c"))


def _words(base: DataFrame) -> DataFrame:
    """(doc, whole, term, start, end, tag): the words outside the entities in the documents that hold one; hashes of lower-cased words, and their kind."""
    every = F.flatten(F.array(*[F.transform(k, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))) for k in KINDS]))
    rows = base.where("held is not null").select(_document().alias("doc"), "whole", "held", every.alias("every")).dropDuplicates(["doc"])
    words = rows.select("doc", "whole", "every", F.explode(located(F.col("held"), TERM)).alias("t"))
    outside = ~F.exists("every", lambda e: (F.col("t.start") < e.end) & (F.col("t.end") > e.start))
    tag = F.when(F.col("t.value").rlike(r"^\p{N}+$"), "NUMBER").when(F.col("t.value").rlike(r"^\p{Lu}"), "NAME").otherwise("WORD")
    return words.where(outside).select("doc", "whole", F.xxhash64(F.lower("t.value")).alias("term"), F.col("t.start").alias("start"), F.col("t.end").alias("end"), tag.alias("tag"))


def disclosing(docs: DataFrame, base: DataFrame, words: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(doc, term, full): the words of each document whose mutual information with one of its entities reaches the entity's information over ``alpha``; ``full`` if it reaches all of it.

    With ``support`` above 1, only words that stand with the entity in so many different texts count.
    """
    n = base.count()
    held = saved(few(_classes(_entities(base))))
    bound = lambda df_c: n * F.pow(df_c / n, F.lit(1 / alpha)) * (1 + 1e-9)
    most = held.agg(F.max("df_c").alias("df_c")).select(bound(F.col("df_c"))).first()[0] or 0.0
    every = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)), lambda x: F.xxhash64(x)))
    df_t = saved(docs.select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("df_t")))
    common = df_t.where(F.col("df_t") > max(most, n * COMMON)).select("term")
    rare = words.join(F.broadcast(common), "term", "left_anti").groupBy("term", "doc").agg(F.first("whole").alias("whole"))
    rare = rare.join(df_t.where(F.col("df_t") <= most), "term")
    # Each document's words and classes meet by the document; of its words only those that can disclose the class are paired with it.
    pairs = saved(few(rare.join(held, "doc").where(F.col("df_t") <= bound(F.col("df_c"))).select("doc", "whole", "class", "df_c", "term", "df_t")))
    co = pairs.groupBy("class", "term").agg(F.first("df_c").alias("df_c"), F.first("df_t").alias("df_t"), F.count("*").alias("co"), *([F.count_distinct("whole").alias("texts")] if support > 1 else []))
    pmi, ic = F.log2(F.col("co") * n / (F.col("df_c") * F.greatest("df_t", "co"))), F.log2(n / F.col("df_c"))
    found = co.where(pmi >= ic / alpha - 1e-9).withColumn("full", pmi >= ic - 1e-9)
    found = found.where(F.col("texts") >= support) if support > 1 else found
    return pairs.join(found.select("class", "term", "full"), ["class", "term"]).groupBy("doc", "term").agg(F.bool_or("full").alias("full"))


def find(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(doc_id, whole, email, ip, card, phone, held, term): all spans of each row of ``docs`` (doc_id, text).

    Whole texts are searched, null counting as empty; a row in, a row out; rows with equal doc_id
    and text have equal spans, and count as one document; other columns are ignored. Every
    occurrence of a disclosing word is a span (start, end, tag), but for those inside entities;
    its tag is null if it is to be removed. A word at the very threshold discloses.
    """
    base = saved(find_base(docs))
    words = saved(few(_words(base)))
    flagged = disclosing(docs, base, words, alpha, support)
    added = words.join(flagged, ["doc", "term"]).groupBy(F.col("doc").alias("a_doc")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.when(~F.col("full"), F.col("tag")).alias("tag")))).alias("term"))
    out = base.join(added, _document() == F.col("a_doc"), "left")
    none = F.array().cast("array<struct<start:int,end:int,tag:string>>")
    return out.select("doc_id", "whole", *KINDS, "held", F.coalesce("term", none).alias("term"))


def _sanitised(text: Column) -> Column:
    """``text`` with the spans of ``find``'s columns replaced: entities and generalised words by their kind in brackets, removed words by nothing; of overlapping entities the first counts.

    The text is cut into its characters once, so that long texts with many spans take time in proportion.
    """
    kind = "array<struct<start:int,end:int,tag:string>>"
    tagged = lambda k: F.transform(k, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), F.lit(f"[{k.upper()}]").alias("tag")))
    entities = F.array_sort(F.flatten(F.array(*map(tagged, KINDS))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    apart = F.aggregate(entities, first, lambda s, x: F.when(x.start >= s.at, F.struct(x.end.alias("at"), F.concat(s.out, F.array(x)).alias("out"))).otherwise(s), lambda s: s.out)
    words = F.transform("term", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), F.when(x.tag.isNull(), "").otherwise(F.concat(F.lit("["), x.tag, F.lit("]"))).alias("tag")))
    spans = F.array_sort(F.concat(apart.cast(kind), words.cast(kind)))

    def built(b: Column) -> Column:
        end = lambda i: F.when(i == 0, 0).otherwise(b.spans[F.greatest(i - 1, F.lit(0))].end)
        parts = F.transform(b.spans, lambda x, i: F.concat(F.array_join(F.slice(b.chars, end(i) + 1, x.start - end(i)), ""), x.tag))
        last = end(F.size(b.spans))
        return F.concat(F.array_join(parts, ""), F.array_join(F.slice(b.chars, last + 1, F.greatest(F.size(b.chars) - last, F.lit(0))), ""))

    return F.when(text.isNotNull(), F.transform(F.array(F.struct(F.split(text, "").alias("chars"), spans.alias("spans"))), built)[0])


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, n_base, n_removed, base_sha256, spans, sanitised_sha256) of what ``find`` gives; n_base counts the spans of all patterns, and the last is null where nothing changes."""
    base = [_listed(k, F.col(k)) for k in KINDS]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "term")], (F.size(KINDS[0]) + F.size(KINDS[1]) + F.size(KINDS[2]) + F.size(KINDS[3])).cast("long").alias("n_base"), F.size(F.filter("term", lambda x: x.tag.isNull())).cast("long").alias("n_removed"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined([*base, _listed("term", F.col("term"))]).alias("spans"), F.sha2(_sanitised(F.col("held")), 256).alias("sanitised_sha256"))


def sanitise(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``docs`` with ``text`` sanitised: entities become their kind in brackets, words that disclose one in part theirs, and words that disclose it fully go.

    Texts without an entity, null ones too, stay as they are; a row in, a row out. Columns keep
    their names, order and values, whatever they are called.
    """
    found = find(docs, alpha, support).where("held is not null").dropDuplicates(["doc_id", "whole"])
    clean = found.select(F.col("doc_id").alias("f_id"), F.col("whole").alias("f_whole"), _sanitised(F.col("held")).alias("clean"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    text = F.coalesce(F.col("d.text").cast("string"), F.lit(""))
    joined = packed.join(clean.hint("shuffle_hash"), F.col("d.doc_id").eqNullSafe(F.col("f_id")) & (F.xxhash64(text) == F.col("f_whole")), "left")
    return joined.select(*[F.coalesce("clean", "d.text").alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
