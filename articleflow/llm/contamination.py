"""Documents that hold benchmark items, also with other numbers, names or units.

Numbers, names and units after numbers become typed placeholders that carry their value; what is left, in lower case, is the template. Windows
of eight template tokens of all documents meet those of the items in a hash join. White space does not count. A capitalised word that may open a
sentence is read both as a name and as a word, and windows are also read without names, so lower-case copies meet too. Windows of one item that lie
in a document at the same shift are one match; a match counts when it has enough windows and when its slots are consistent: over the
matched stretch, equal values of the item stand for equal values of the document and the other way round. That is tried with words that may open a
sentence as names, then as words, and last with verbatim windows alone.

Everything is columns of Spark. The windows of the items are broadcast only if there are few, otherwise both sides are shuffled.

Defined results: null or empty texts hold nothing and null or short items (under eight tokens) are not searched; rows that repeat an id are judged
row by row; a repeated item gives one match for each of its ids; null item ids stay apart from all others; other columns are not read. An empty
table of documents gives no rows, one of items no leaks. Whole texts are read, however long; a text must fit a task as an array of its tokens.
Matches of one item at several shifts are all given; ties between ways to read a match go to the first that is consistent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import stored

WINDOW = 8
#: Windows of an item that must match at one shift, or all but one if it has fewer: the first word may look like a name inside a sentence.
LEAST_WINDOWS = 5
#: Windows of items that may be broadcast (24 bytes each).
BROADCAST_WINDOWS = 500_000
#: Fixed: units that count as such after a number.
UNITS = (
    "mm cm dm m km inch inches foot feet yard yards mile miles mg g kg t ton tons tonne tonnes pound pounds ounce ounces ml l litre litres liter liters gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees"
).split()

#: A capitalised word or a number; the look ahead comes first, so that other places are passed by quickly.
_SLOT = r"(?=\p{Lu})(?<![\p{L}\p{N}<])(\p{Lu}\p{Ll}+)(?!\p{L})|([0-9]+)"
_NUMBER = r" <s(?=[0-9])"
#: One that is marked stands inside a sentence, and so is a name, after a small letter, a digit, a comma or a semicolon and one blank.
_INSIDE = r" <s(?<=[\p{Ll}\p{N},;] {1,2} <s)"
#: White space other than one plain blank.
_BLANKS = r"[\s\p{Z}&&[^ ]][\s\p{Z}]*| [\s\p{Z}]+"
_UNIT = r"(<n[0-9]*\s+)(" + "|".join(UNITS) + r")(?![\p{L}\p{N}])"
_GAP = r"[^\p{L}\p{N}<]+"


def _marked(text: str | Column) -> Column:
    """Tokens of a text; numbers, names, units and words that may be names begin with ``<n``, ``<a``, ``<u`` and ``<s``, followed by their value."""
    text = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<"), F.lit(" ")), _BLANKS, " ")
    marked = F.regexp_replace(marked, _SLOT, " <s$1$2 ")
    marked = F.regexp_replace(marked, _NUMBER, " <n")
    marked = F.regexp_replace(marked, _INSIDE, " <a")
    marked = F.regexp_replace(F.lower(marked), _UNIT, "$1<u$2")
    return F.filter(F.split(marked, _GAP), lambda word: word != "")


def _word(token: Column) -> Column:
    return F.when(F.startswith(token, F.lit("<")), F.substring(token, 3, 1 << 30)).otherwise(token)


def _is(token: Column, *kinds: str) -> Column:
    return F.substring(token, 1, 2).isin(*(f"<{kind}" for kind in kinds))


def _read(token: Column, names: str) -> Column:
    """What a token counts as in a window when these kinds are names and the others are words."""
    held = F.when(_is(token, "n", "u"), F.substring(token, 1, 2))
    return (held.when(_is(token, *names), F.lit("<a")) if names else held).otherwise(_word(token))


def tokens(text: str | Column, values: bool) -> Column:
    """Template tokens of a text; ``<n``, ``<a`` and ``<u`` stand for numbers, names and units, followed by their value if wanted."""
    return F.transform(_marked(text), lambda t: F.when(_is(t, "s"), _word(t)).otherwise(t) if values else _read(t, "a"))


def template_windows(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """The keys, ``pos`` and a hash for each window of template tokens in each way to read it.

    Tokens are hashed once; a window's hash is put together by doubling, from those of its halves. Each step is a projection of its own that is used
    more than once, and no filter reads it, so that Spark works it out once.
    """
    ways = ["as", "a", ""]
    held = [f"way{i}" for i in range(len(ways))]
    hashed = lambda names: lambda t: F.when(F.startswith(t, F.lit("<")), F.xxhash64(_read(t, names))).otherwise(F.xxhash64(t))
    steps = rows.select(*keys, _marked(text).alias("marked"))
    steps = steps.select(*keys, *(F.transform("marked", hashed(names)).alias(way) for way, names in zip(held, ways, strict=True)))
    size = 1
    while size < WINDOW:
        steps = steps.select(*keys, *(F.zip_with(way, F.slice(way, size + 1, F.size(way)), lambda x, y: F.xxhash64(x, y)).alias(way) for way in held))
        size *= 2
    whole = F.slice(F.arrays_zip(*held), F.lit(1), F.greatest(F.size(held[0]) - (WINDOW - 1), F.lit(0)))
    windows = steps.select(*keys, F.posexplode_outer(whole).alias("pos", "window")).filter("pos is not null")
    return windows.select(*keys, "pos", F.explode(F.array_distinct(F.array(*(F.col(f"window.{way}") for way in held)))).alias("hash"))


#: How slots are read, one way after the other: kinds that are names, and whether slots may differ at all.
_READINGS = [("as", True), ("a", True), ("a", False)]


def _judged(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys and ``at``: ``first`` and ``last`` window of the item in a stretch of ``pairs`` in the first reading in which enough of its windows are
    equal and its slots are consistent; else null.

    As in ``template_windows``, each step is a projection of its own that is used more than once, so that Spark works it out once a row and not once
    for each place that reads it.
    """
    keys = [*keys, "needed"]
    ways = range(len(_READINGS))
    same = lambda p: _word(p["item_words"]) == _word(p["doc_words"])
    both = lambda p, *kinds: _is(p["item_words"], *kinds) & _is(p["doc_words"], *kinds)
    met = lambda names: lambda p: both(p, "n") | both(p, "u") | both(p, *names)
    equal = lambda names, slots: lambda p: F.coalesce(same(p) | met(names)(p) if slots else same(p), F.lit(False))
    steps = rows.select(*keys, "first", "pairs", *(F.transform("pairs", equal(*_READINGS[k])).alias(f"equal{k}") for k in ways))
    size = 1
    while size < WINDOW:
        steps = steps.select(*keys, "first", "pairs", *(F.zip_with(f"equal{k}", F.slice(f"equal{k}", size + 1, F.size(f"equal{k}")), lambda x, y: x & y).alias(f"equal{k}") for k in ways))
        size *= 2
    hits = lambda k: F.filter(F.transform(f"equal{k}", lambda e, i: F.when(e, i + 1)), lambda i: i.isNotNull())
    steps = steps.select(*keys, "first", "pairs", *(hits(k).alias(f"hits{k}") for k in ways))
    steps = steps.select(*keys, "first", "pairs", *(F.struct(F.array_min(f"hits{k}").alias("low"), F.array_max(f"hits{k}").alias("high"), F.size(f"hits{k}").alias("n")).alias(f"hits{k}") for k in ways))

    def held(k: int) -> Column:
        names = _READINGS[k][0]
        stretch = F.slice("pairs", F.col(f"hits{k}.low"), F.col(f"hits{k}.high") - F.col(f"hits{k}.low") + WINDOW)
        kept = F.filter(stretch, lambda p: met(names)(p) | (_is(p["item_words"], "n", "u", *names) & same(p)))
        kind = lambda token: F.when(_is(token, "n", "u"), F.substring(token, 1, 2)).otherwise("<a")
        slot = lambda p: F.struct(F.concat(kind(p["item_words"]), _word(p["item_words"])).alias("i"), F.concat(kind(p["item_words"]), _word(p["doc_words"])).alias("d"))
        return F.array_distinct(F.transform(kept, slot))

    slotted = [k for k in ways if _READINGS[k][1]]
    steps = steps.select(*keys, "first", *(f"hits{k}" for k in ways), *(held(k).alias(f"held{k}") for k in slotted))

    def at(k: int) -> Column:
        good = F.col(f"hits{k}.n") >= F.col("needed")
        if k in slotted:
            good &= (F.size(F.array_distinct(f"held{k}.i")) == F.size(f"held{k}")) & (F.size(F.array_distinct(f"held{k}.d")) == F.size(f"held{k}"))
        return F.when(good, F.struct((F.col("first") + F.col(f"hits{k}.low") - 1).alias("first"), (F.col("first") + F.col(f"hits{k}.high") - 1).alias("last")))

    return steps.select(*keys[:-1], F.coalesce(*(at(k) for k in ways)).alias("at"))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, version, item, first, last, shift): consistent matches of items in documents, in tokens of the item; ``version`` is a hash of the text."""
    wanted = items.select(F.col(item_id_col).alias("item"), F.xxhash64(item_text_col).alias("item_version"), F.col(item_text_col).cast("string").alias("item_text"))
    item_windows = stored(template_windows(wanted, "item_text", "item", "item_version").withColumnRenamed("pos", "item_pos"), "item-windows")
    side = F.broadcast(item_windows) if item_windows.count() <= BROADCAST_WINDOWS else item_windows
    bodies = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).cast("string").alias("body"))
    met = template_windows(bodies, "body", "id", "version").join(side, "hash")
    needed = item_windows.groupBy(F.col("item").alias("of_item"), F.col("item_version").alias("of_version")).agg(F.greatest(F.lit(1), F.least(F.count_distinct("item_pos") - 1, F.lit(LEAST_WINDOWS))).alias("needed"))
    runs = met.groupBy("id", "version", "item", "item_version", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.min("item_pos").alias("first"), F.max("item_pos").alias("last"), F.count_distinct("item_pos").alias("n")
    )
    same_item = F.col("item").eqNullSafe(F.col("of_item")) & (F.col("item_version") == F.col("of_version"))
    long_runs = stored(runs.join(needed, same_item).filter("n >= needed").drop("of_item", "of_version"), "long-runs")
    item_words = wanted.distinct().select(F.col("item").alias("of_item"), F.col("item_version").alias("of_version"), _marked("item_text").alias("item_words"))
    with_slots = long_runs.join(item_words, same_item).drop("of_item", "of_version")
    with_slots = with_slots.withColumn("item_words", F.expr(f"slice(item_words, first + 1, last - first + {WINDOW})"))
    has_slots = F.exists("item_words", lambda w: F.startswith(w, F.lit("<")))
    plain = with_slots.filter(~has_slots).drop("item_words", "needed")
    slotted = stored(with_slots.filter(has_slots), "slotted-runs")
    same_text = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("version") == F.col("of_text"))
    keys = slotted.select(F.col("id").alias("of_id"), F.col("version").alias("of_text")).distinct()
    held = bodies.join(keys, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("version") == F.col("of_text")), "left_semi")
    held = held.dropDuplicates(["id", "version"]).select(F.col("id").alias("of_id"), F.col("version").alias("of_text"), _marked("body").alias("words"))
    compared = slotted.join(held, same_text).withColumn("doc_words", F.expr(f"slice(words, first + shift + 1, last - first + {WINDOW})"))
    compared = compared.withColumn("pairs", F.arrays_zip("item_words", "doc_words"))
    others = [c for c in plain.columns if c not in ("first", "last")]
    judged = stored(_judged(compared, *others), "judged-runs").filter("at is not null")
    consistent = judged.withColumns({"first": F.col("at.first"), "last": F.col("at.last")}).select(*plain.columns)
    return plain.unionByName(consistent).withColumn("last", F.col("last") + WINDOW)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, version, items, longest): the texts that hold items, which ones, and the tokens of the longest match."""
    found = matches(docs, items, id_col, text_col, item_id_col, item_text_col)
    return found.groupBy("id", "version").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("last") - F.col("first")).alias("longest"))


def flagged(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``row`` (the document), ``is_leak``, ``items`` and ``longest``: every row of ``docs`` once."""
    found = stored(contaminated(docs, items, id_col, text_col, item_id_col, item_text_col), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_version"))
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_version") == F.col("version"))
    return rows.join(found, same, "left").select(
        "row", F.col("items").isNotNull().alias("is_leak"), F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"), F.coalesce(F.col("longest").cast("long"), F.lit(0)).alias("longest")
    )
