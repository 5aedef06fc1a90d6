"""Personal data in texts, and the terms that give it away.

Four fixed kinds of patterns find the protected entities. A corpus tells how much a term reveals: with document counts over all texts, the information of
an entity e is log(N / n(e)), and what a term t discloses of it is the pointwise mutual information log(P(e | t) / P(e)). A term meets an entity
where it stands within ``NEAR`` words of it. P(e | t) is smoothed by half a text in which e is as likely as anywhere. One text proves nothing about a rare word, so a
term is compared only with entities that it meets in at least ``SUPPORT`` different texts, or stands beside (within ``BESIDE`` words) in one.
A term that discloses at least the share ``disclosure`` of an entity's information is treated where it stands near that entity: removed if all texts with it
have it near the entity, generalised otherwise.

Everything is columns of Spark. Positions come from the lengths of what stands between matches. Terms are counted once per different text, copies
and terms summed map-side first, as 64-bit hashes. Entities are spread over the word positions around them and meet the words there by an equi-join, so what
meets grows with the entities and not with terms times entities.

Defined results: null is the empty text and has no spans; an empty table gives an empty table; positions are code points, ends exclusive; spans that begin
together come in the order of KINDS; rows that repeat an id and text get the same spans; texts, entities, terms and what meets are all counted over
different texts, so copies make no term revealing and hide none; an entity without a letter or digit meets the words around it; a null id is an id like
any other; a text of any length is read whole, its words in one task; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.llm.common import discard, stored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "removed", "generalised")
#: Fixed: the patterns of the contract. Possessive repeats match the same, without recursion over long texts, and a match begins only where one of
#: its first characters does not go on from before, or right after the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that is in every match.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What separates terms, and their least length.
BETWEEN_TERMS = r"[^\p{L}\p{N}]+"
TERM_CHARS = 4
#: Texts by which P(e | t) is smoothed; the words on either side in which a term meets an entity; texts in which it has to, unless it stands beside it.
SMOOTHING = 0.5
NEAR = 16
SUPPORT = 2
BESIDE = 3


SPAN = "struct<start:bigint,kind_no:int,end:bigint,kind:string,value:string>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Every second digit from the right counts twice, less nine over nine; the sum is a multiple of ten."""
    figures = F.transform(F.regexp_extract_all(F.reverse(match), F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))
    each = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        figures = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(figures, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _placed(parts: str, found: str, kind: str) -> Column:
    """Matches as spans, from the parts before them."""
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["part"])
        end = begin + F.length(pair["value"])
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(parts, 1, F.size(found)), F.col(found), lambda part, value: F.struct(part.alias("part"), value.alias("value")))
    return F.filter(F.aggregate(pairs, empty, step, lambda state: state["spans"]), lambda span: _passes(kind, span["value"]))


def pattern_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, spans, held): the base spans of each text by start, then kind; ``version`` is a hash of the text, ``held`` the text where it has spans."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    found = {}
    for kind, pattern in PATTERNS.items():
        hit = F.contains("body", F.lit(HINTS[kind])) if HINTS[kind] else F.lit(True)
        found[f"{kind}_found"] = F.when(hit, F.regexp_extract_all("body", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("*", *(c.alias(name) for name, c in found.items()))
    parts = {f"{kind}_parts": F.when(F.size(f"{kind}_found") > 0, F.split("body", pattern, -1)).otherwise(F.array().cast("array<string>")) for kind, pattern in PATTERNS.items()}
    rows = rows.select("*", *(c.alias(name) for name, c in parts.items()))
    spans = F.concat(*(_placed(f"{kind}_parts", f"{kind}_found", kind) for kind in BASE_KINDS))
    rows = rows.select("id", "version", "body", F.array_sort(spans).alias("spans"))
    return rows.select("id", "version", "spans", F.when(F.size("spans") > 0, F.col("body")).alias("held"))


def _terms(text: str) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), BETWEEN_TERMS), lambda w: F.length(w) >= TERM_CHARS)
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _word_places(words: DataFrame, held: DataFrame) -> DataFrame:
    """(id, version, span, first, last): the words that each span touches, by what is known of the words that start before its start and before its end.

    Words do not overlap, so all of them but the last one have ended by then.
    """
    none = F.lit(None).cast(SPAN)
    spans = held.select("id", "version", F.explode("spans").alias("span"))
    sides = F.explode(F.array(F.struct(F.col("span.start").alias("at"), F.lit(True).alias("is_start")), F.struct(F.col("span.end").alias("at"), F.lit(False).alias("is_start"))))
    of_spans = spans.select("id", "version", "span", sides.alias("side")).select("id", "version", F.col("side.at").alias("at"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("bigint").alias("end"), "span", F.col("side.is_start").alias("is_start"))
    of_words = words.select("id", "version", F.col("start").alias("at"), "pos", "end", none.alias("span"), F.lit(None).cast("boolean").alias("is_start"))
    # A side comes before a word that starts there: its pos is NULL.
    upto = Window.partitionBy("id", "version").orderBy("at", F.asc_nulls_first("pos"))
    known = of_words.unionByName(of_spans).withColumns({"before": F.max("pos").over(upto), "ended": F.max("end").over(upto)}).filter(F.col("span").isNotNull())
    last = F.coalesce("before", F.lit(-1))
    first = last + F.when(F.col("ended") > F.col("at"), 0).otherwise(1)
    places = known.groupBy("id", "version", "span")
    return places.agg(F.max(F.when(F.col("is_start"), first)).alias("first"), F.max(F.when(~F.col("is_start"), last)).alias("last"))


def revealing_spans(docs: DataFrame, base: DataFrame, text_col: str, disclosure: float) -> DataFrame:
    """(id, version, spans) of the terms that reveal entities of their text, outside the base spans.

    Texts with entities come with ``base``, so that the others are not shuffled to find them.
    """
    total = docs.select(F.xxhash64(text_col)).distinct().count()
    held = base.filter(F.size("spans") > 0).select("id", "version", "spans")
    entities = held.select("version", F.explode("spans").alias("span")).select("version", F.xxhash64("span.kind", "span.value").alias("entity")).distinct()
    counts = stored(entities.groupBy("entity").agg(F.count("*").alias("n_e")), "entities")
    df = docs.select(F.xxhash64(text_col).alias("version"), _terms(text_col).alias("terms")).dropDuplicates(["version"])
    df = df.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    df = stored(df, "term-counts")
    texts = base.filter(F.size("spans") > 0).select("id", "version", F.col("held").alias("body")).dropDuplicates(["id", "version"])
    words = texts.select(
        "id", "version",
        F.posexplode(F.arrays_zip(F.split("body", r"[\p{L}\p{N}]+", -1).alias("gap"), F.regexp_extract_all("body", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("word"))).alias("pos", "pair"),
    ).filter("pair.word is not null")
    words = words.select("id", "version", "pos", F.col("pair.word").alias("word"), F.length("pair.gap").alias("gap"))
    ahead = Window.partitionBy("id", "version").orderBy("pos")
    words = words.withColumn("end", F.sum(F.col("gap") + F.length("word")).over(ahead))
    words = stored(words.select("id", "version", "pos", "word", (F.col("end") - F.length("word")).alias("start"), "end"), "words-of-texts")
    places = _word_places(words, held.dropDuplicates(["id", "version"]))
    near = F.explode(F.sequence(F.col("first") - NEAR, F.col("last") + NEAR)).alias("pos")
    around = places.select("id", "version", F.xxhash64("span.kind", "span.value").alias("entity"), "first", "last", near)
    around = around.withColumn("distance", F.greatest(F.col("first") - F.col("pos"), F.col("pos") - F.col("last")))
    around = around.groupBy("id", "version", "pos", "entity").agg(F.min("distance").alias("distance"))
    around = around.withColumn("least", F.min("distance").over(Window.partitionBy("id", "version", "pos"))).filter("least > 0").drop("least")
    around = around.withColumnsRenamed({"id": "near_id", "version": "near_version", "pos": "near_pos"})
    terms = words.filter(F.length("word") >= TERM_CHARS).withColumn("term", F.xxhash64(F.lower("word")))
    here = F.col("id").eqNullSafe(F.col("near_id")) & (F.col("version") == F.col("near_version")) & (F.col("pos") == F.col("near_pos"))
    meets = stored(terms.join(around, here).select("id", "version", "pos", "word", "start", "end", "term", "entity", "distance"), "terms-near-entities")
    discard(words)
    known = F.log(F.lit(float(total)) / F.col("n_e"))
    told = F.log((F.col("n_te") * float(total) / F.col("n_e") + SMOOTHING) / (F.col("n_t") + SMOOTHING))
    pairs = meets.groupBy("version", "term", "entity").agg(F.min("distance").alias("distance"))
    met = pairs.groupBy("term", "entity").agg(F.count("*").alias("n_te"), F.min("distance").alias("distance"))
    met = met.filter((F.col("n_te") >= SUPPORT) | (F.col("distance") <= BESIDE)).join(counts, "entity").join(df, "term")
    telling = met.filter((told > 0) & (told >= disclosure * known)).select("term", "entity", (F.col("n_t") <= F.col("n_te")).alias("only_there"))
    telling = stored(telling, "revealing-terms")
    discard(counts, df)
    treated = meets.join(telling, ["term", "entity"]).groupBy("id", "version", "word", "start", "end").agg(F.max("only_there").alias("only_there"))
    kind = F.when(F.col("only_there"), F.lit("removed")).otherwise(F.lit("generalised"))
    number = F.when(F.col("only_there"), F.lit(KINDS.index("removed"))).otherwise(F.lit(KINDS.index("generalised")))
    span = F.struct(F.col("start").cast("bigint").alias("start"), number.alias("kind_no"), F.col("end").cast("bigint").alias("end"), kind.alias("kind"), F.col("word").alias("value"))
    more = stored(treated.groupBy("id", "version").agg(F.collect_list(span).alias("more")), "revealing-spans")
    discard(meets, telling)
    return more


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.8) -> DataFrame:
    """(id, version, spans): one row per document; spans have start, kind_no, end, kind and value, by start, then kind."""
    base = stored(pattern_spans(docs, id_col, text_col), "pattern-spans")
    more = revealing_spans(docs, base, text_col, disclosure)
    more = more.withColumnsRenamed({"id": "more_id", "version": "more_version"})
    same = F.col("id").eqNullSafe(F.col("more_id")) & (F.col("version") == F.col("more_version"))
    spans = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "more")))
    return base.join(more, same, "left").select("id", "version", spans.alias("spans"))


def _general(span: Column) -> Column:
    """What a generalised term was: a number, a name or a word."""
    value = span["value"]
    return F.when(value.rlike("^[0-9]+$"), "<number>").when(value.rlike(r"^\p{Lu}"), "<name>").otherwise("<word>")


def sanitised(text: str, spans: str) -> Column:
    """The text with its spans replaced: entities by their kind, revealing terms by a general one or by nothing. Overlaps go with the first span."""
    new = lambda span: F.when(span["kind"] == "removed", F.lit("")).when(span["kind"] == "generalised", _general(span)).otherwise(F.concat(F.lit("<"), span["kind"], F.lit(">")))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    body = F.coalesce(F.col(text), F.lit(""))

    def step(state: Column, span: Column) -> Column:
        between = F.substring(body, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        taken = F.struct(span["end"].alias("at"), F.concat(state["out"], between, new(span)).alias("out"))
        return F.when(span["start"] >= state["at"], taken).otherwise(F.struct(F.greatest(state["at"], span["end"]).alias("at"), state["out"].alias("out")))

    return F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substring(body, (s["at"] + 1).cast("int"), F.length(body))))
