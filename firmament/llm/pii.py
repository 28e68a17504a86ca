"""Personal data: fixed patterns, and terms that disclose what they found.

Base spans come from four patterns (kinds email, ip, card, phone).  The
method treats every value found as a protected entity and asks the corpus how
much the words of its documents give away: with document counts c over N,

    PMI(t, e) = log2(c_te * N / (c_t * c_e)),   IC(e) = log2(N / c_e)

and a term t discloses e when PMI(t, e) / IC(e) reaches ``disclosure``.  Most
values are in one document; there PMI(t, e) is the term's own information
content, log2(N / c_t), so no number of documents is asked for (``support``
asks for one).  A term that discloses any entity is generalised to its stem if
the stem discloses none, else removed; both give spans of kind ``term``, at
every place outside the values, in every document that holds the term.  c_t,
c_e and c_te count whole documents that hold the term, the entity and both.

Two steps keep the pairs few without losing any.  c_te <= c_e, so only terms
with log2(N / c_t) >= ``disclosure`` * IC(e) can disclose e and are paired
with it.  Entities held by the same texts have equal counts with every term,
so such a group is paired as one.

DataFrame functions only.  Equal texts are told by key, so copies make one
row in every later table, and each table is pre-aggregated before a shuffle.

Defined results: null and empty texts have no spans; repeated rows get equal
rows; null ids are carried; patterns are written so that very long texts cost
time in proportion to their length; empty tables give no rows; other columns
are ignored or, in ``sanitised``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.llm.store import saved, small, text_key, unused

KINDS = ("email", "ip", "card", "phone", "term")
# Leftmost, non-overlapping.  Possessive repeats and starts only where a run
# begins find the same spans as the plain forms, without their retries.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"  # longer runs are dropped whole by their digits
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"\p{L}{3,}+"
STEM = 4  # letters of a generalised term, and a third of a longer word's
TERMS_BROADCAST = 2_000_000  # hashes of 8 bytes
BLOCK = 64  # matches placed at a time: an array that grows by one is copied each time


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, in code points.

    A split gives the pieces between matches; lengths add up to positions."""
    span = "array<struct<start:int,end:int,value:string>>"

    def block(x: Column, first: Column) -> Column:
        """Its length in the text, and its matches placed from its start."""

        def step(acc: Column, i: Column) -> Column:
            start = acc["pos"] + F.char_length(x["pieces"][i])
            end = start + F.char_length(x["values"][i])
            one = F.array(F.struct(start.alias("start"), end.alias("end"), x["values"][i].alias("value")))
            return F.struct(end.alias("pos"), F.concat(acc["out"], one).alias("out"))

        begin = F.struct(F.lit(0).alias("pos"), F.array().cast(span).alias("out"))
        return F.aggregate(F.sequence(first, F.least(first + F.lit(BLOCK), F.size(x["values"])) - 1), begin, step)

    def place(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(x["values"]) - 1, F.lit(BLOCK)), lambda first: block(x, first))
        return F.transform(F.array(blocks), joined)[0]

    def joined(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["pos"])))

        def moved(xs: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda b, k: F.transform(b["out"], lambda m: F.struct((m["start"] + xs[k]).alias("start"), (m["end"] + xs[k]).alias("end"), m["value"].alias("value")))))

        return F.transform(F.array(starts), moved)[0]

    def located(values: Column) -> Column:
        both = F.array(F.struct(values.alias("values"), F.split(text, pattern, -1).alias("pieces")))
        return F.when(F.size(values) > 0, F.transform(both, place)[0]).otherwise(F.array().cast(span))

    return F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), located)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> by start, then kind (0..3)."""

    def small_parts(s: Column) -> Column:
        bare = F.transform(F.split(s["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(bare, lambda p: F.when(F.char_length(p) <= 3, p.cast("int") <= 255).otherwise(False))

    def long_card(s: Column) -> Column:
        d = F.transform(F.array(_digits(s["value"])), lambda d: F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(False))
        return d[0]

    rules = (
        (EMAIL, text.contains("@"), None),
        (IP, F.lit(True), small_parts),
        (CARD, F.lit(True), long_card),
        (PHONE, text.contains("+"), lambda s: F.char_length(_digits(s["value"])).between(9, 15)),
    )

    def of(kind: int, pattern: str, possible: Column, keep) -> Column:
        found = F.when(possible, matches(text, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
        found = F.filter(found, keep) if keep else found
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    return F.array_sort(F.concat(*[of(kind, *rule) for kind, rule in enumerate(rules)]))


def _stem(word: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), F.greatest(F.lit(STEM), F.floor(F.char_length(word) / 3).cast("int"))), F.lit("*"))


def _hashes(text: Column) -> Column:
    """array<bigint>: the distinct words of a text and their stems."""
    words = F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.char_length(w) >= 3), lambda w: F.lower(w)))
    return F.transform(F.array(words), lambda ws: F.array_distinct(F.concat(F.transform(ws, lambda w: F.xxhash64(w)), F.transform(ws, lambda w: F.xxhash64(_stem(w))))))[0]


def disclosing(held: DataFrame, texts: DataFrame, docs: DataFrame, text_col: str, disclosure: float, support: int) -> DataFrame:
    """(h): hashes of the terms and stems that disclose an entity.  ``held``:
    distinct (text_key, entity); ``texts``: distinct (text_key, copies, hashes)
    of the texts that hold one."""
    n = docs.count()
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "text_key")) for seed in (0, 1)]  # equal for entities of the same texts
    kinds = held.join(texts.select("text_key", "copies"), "text_key").groupBy("entity").agg(F.sum("copies").alias("c_e"), same[0].alias("a"), same[1].alias("b"))
    kinds = saved(kinds.select("entity", "c_e", F.xxhash64("c_e", "a", "b").alias("group")), "entities")
    groups = saved(held.join(small(kinds, TERMS_BROADCAST), "entity").select("text_key", "group", "c_e").distinct(), "groups")

    wanted = saved(texts.select(F.explode("hashes").alias("h")).distinct(), "terms")
    few = wanted.count() <= TERMS_BROADCAST
    words = docs.select(F.explode(_hashes(F.coalesce(F.col(text_col), F.lit("")))).alias("h"))
    words = words.join(F.broadcast(wanted), "h", "left_semi") if few else words
    c_t = words.groupBy("h").agg(F.count("*").alias("c_t"))
    c_t = c_t if few else c_t.join(wanted, "h", "left_semi")

    total = F.lit(float(max(n, 1)))
    ic_t, ic_e = F.log2(total / F.col("c_t")), F.log2(total / F.col("c_e"))
    most = groups.agg(F.max("c_e")).first()[0] or 1
    c_t = saved(c_t.filter(ic_t >= F.lit(disclosure) * F.log2(total / F.lit(float(most))) - 1e-9), "frequencies")

    near = texts.select("text_key", "copies", F.explode("hashes").alias("h")).join(small(c_t, TERMS_BROADCAST), "h")
    near = near.join(groups, "text_key").filter((ic_e > 0) & (ic_t >= F.lit(disclosure) * ic_e - 1e-9))
    c_te = near.groupBy("group", "c_e", "h", "c_t").agg(F.sum("copies").alias("c_te"))
    pmi = F.log2(F.col("c_te") * total / (F.col("c_t") * F.col("c_e")))
    return c_te.filter((F.col("c_te") >= support) & (pmi >= F.lit(disclosure) * ic_e - 1e-9)).select("h").distinct()


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.9, support: int = 1) -> DataFrame:
    """One row per document: doc_id, text_key, spans: array<struct<start,
    kind (place in KINDS), end, label>> by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.transform(F.array(base_spans(text)), lambda s: F.when(F.size(s) > 0, s))[0]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"), found.alias("spans"))
    hashes = F.when(F.col("spans").isNotNull(), _hashes(F.col("text")))
    rows = saved(rows.select("doc_id", "text_key", "spans", hashes.alias("hashes")), "base")

    texts = rows.filter("spans is not null").groupBy("text_key").agg(F.count("*").alias("copies"), F.first("hashes").alias("hashes"), F.first("spans").alias("spans"))
    texts = saved(texts, "texts")
    plain = F.when(F.col("s.kind") < 2, F.lower("s.value")).otherwise(_digits(F.col("s.value")))
    held = texts.select("text_key", F.explode("spans").alias("s")).select("text_key", F.xxhash64("s.kind", plain).alias("entity")).distinct()
    bad = saved(disclosing(saved(held, "held"), texts, docs, text_col, disclosure, support), "disclosing")

    near = small(bad, TERMS_BROADCAST)
    places = docs.select(text_key(F.col(text_col)).alias("text_key"), F.explode(matches(text, WORD)).alias("w"))
    places = places.select("text_key", "w.start", "w.end", F.lower("w.value").alias("term")).withColumn("h", F.xxhash64("term")).join(near, "h", "left_semi")
    places = saved(places.select("text_key", "start", "end", "term").distinct(), "places")
    stems = places.select("term", _stem(F.col("term")).alias("stem")).distinct().join(bad.select(F.col("h").alias("bad")), F.xxhash64("stem") == F.col("bad"), "left")
    labels = saved(stems.select("term", F.when(F.col("bad").isNull(), F.col("stem")).otherwise("").alias("label")), "labels")
    places = places.join(small(labels, TERMS_BROADCAST), "term")
    term = F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end", "label")
    terms = saved(places.groupBy("text_key").agg(F.collect_list(term).alias("terms")), "marks")

    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform(F.coalesce("spans", F.array().cast(rows.schema["spans"].dataType)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), names[s["kind"]].alias("label")))
    out = rows.drop("hashes").join(terms, "text_key", "left")
    outside = F.when(F.col("spans").isNull(), F.col("terms")).otherwise(F.filter("terms", lambda t: ~F.exists("spans", lambda o: (o["start"] < t["end"]) & (t["start"] < o["end"]))))
    both = F.when(F.col("terms").isNull(), base).otherwise(F.array_sort(F.concat(base, outside)))
    return out.select("doc_id", "text_key", both.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    spans = F.col("spans")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    base = F.filter(spans, lambda s: s["kind"] < len(KINDS) - 1)
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def sanitised(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with spans written as their labels (removed terms as
    nothing); overlapping spans are one, with the first one's label."""
    per_text = found.filter(F.size("spans") > 0).select("text_key", "spans").dropDuplicates(["text_key"])
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["pos"]
        more = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), s["label"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(new, more).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.char_length(text)))
    key, spans = unused(docs, "text_key"), unused(docs, "spans")
    keyed = docs.withColumn(key, text_key(text)).join(per_text.select(F.col("text_key").alias(key), F.col("spans").alias(spans)), key, "left")
    changed = F.when(F.col(spans).isNotNull(), F.aggregate(spans, begin, step, rest)).otherwise(text)
    return keyed.withColumn(text_col, changed).select(*docs.columns)
