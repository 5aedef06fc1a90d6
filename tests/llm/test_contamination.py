import itertools

from articleflow.llm import contamination
from articleflow.llm.contamination import UNITS, flagged, tokens

from . import cases

ITEMS = [
    (1, "A train leaves Boston at 9 and travels 120 miles in 3 hours before it meets Alice who walked 120 miles from the station"),
    (2, "short one"), (3, None), (None, cases.SHARED[4]), (5, "what is the sum of the first ten even numbers that are not divisible by three"),
]
CASES = [
    ("x y z. A train leaves Paris at 8 and travels 250 miles in 7 hours before it meets Bobby who walked 250 miles from the station today", [1]),
    ("A train leaves Paris at 8 and travels 250 miles in 7 hours before it meets Bobby who walked 251 miles from the station today", []),
    ("A train leaves Paris at 8 and travels 8 miles in 7 hours before it meets Bobby who walked 8 miles from the station today", []),
    ("First, what is the sum of the FIRST ten even numbers; that are not divisible by three?", [5]),
    ("what is the sum of the first ten odd numbers that are all divisible by three", []),
    (None, []), ("", []), ("short one", []), (cases.SHARED[4] + " end", [None]), (" ".join([cases.prose(3000), cases.SHARED[4], cases.prose(3000)]), [None]),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id int, text string")


def test_items_are_found_verbatim_and_with_other_slots(spark):
    docs = cases.documents(spark, [t for t, _ in CASES])
    found = {r.doc_id: r for r in flagged(docs, items(spark)).select("row.doc_id", "row.label", "is_leak", "items").collect()}
    # a leak by an item without an id has no item to show
    assert [found[i].items for i in range(len(CASES))] == [[x for x in want if x is not None] for _, want in CASES]
    assert [found[i].is_leak for i in range(len(CASES))] == [bool(want) for _, want in CASES]
    assert {r.label for r in found.values()} == {"own label"}


def test_shuffled_items_give_the_same(spark, monkeypatch):
    monkeypatch.setattr("articleflow.llm.contamination.BROADCAST_WINDOWS", 0)
    found = flagged(cases.documents(spark, [t for t, _ in CASES]), items(spark)).filter("is_leak").count()
    assert found == sum(bool(want) for _, want in CASES)


def test_awkward_rows_and_no_python(spark, plan_of):
    rows = flagged(cases.awkward(spark), items(spark)).select("row.doc_id", "is_leak").collect()
    assert sorted(r.is_leak for r in rows) == [False, False, True, True, True, True]
    assert flagged(cases.empty(spark), items(spark)).count() == 0
    assert flagged(cases.documents(spark), items(spark, [])).filter("is_leak").count() == 0
    plan = plan_of(flagged(cases.documents(spark), items(spark)))
    assert "Python" not in plan and "Arrow" not in plan


OPENINGS = "Tom has 5 red apples and gives 2 to a friend. Sue has 3 times as many. Tom eats 2. How many apples are left in all for Sue?"
CAMP = "in the morning old Alice and young Robert carry 12 boxes of fruit from the farm to the market where they sell them"


def test_names_that_open_sentences_other_blanks_and_case(spark):
    other = OPENINGS.replace("Tom", "Anna").replace("Sue", "Maria").replace("5", "9").replace("3", "4").replace("2", "6")
    mixed = other.replace("eats 6", "eats 7")
    wrapped = CAMP.replace(" Alice", "\nAlice").replace(" Robert", "  Robert")
    rows = [other, mixed, wrapped, CAMP.lower(), CAMP.lower().replace("12", "15"), "\u201c" + other]
    docs = cases.documents(spark, rows)
    found = {r.doc_id: r["items"] for r in flagged(docs, items(spark, [(1, OPENINGS), (2, CAMP)])).select("row.doc_id", "items").collect()}
    assert [found[i] for i in range(len(rows))] == [[1], [], [2], [2], [2], [1]]


def test_tokens_carry_their_values(spark):
    row = spark.createDataFrame([("He paid 3.50 dollars to Ann, 5 km away. Then <b>",)], "text string").select(tokens("text", True), tokens("text", False)).first()
    assert row[0] == ["he", "paid", "<n3", "<n50", "<udollars", "to", "<aann", "<n5", "<ukm", "away", "then", "b"]
    assert row[1] == ["he", "paid", "<n", "<n", "<u", "to", "<a", "<n", "<u", "away", "then", "b"]


SHORT = ["Tom has 5 apples and Sue has 3 more", "How far does the train from Oslo travel in 2 hours", "They sell 7 kg of rice for 21 euro today", "all of the birds in the tree fly away again"]


def test_short_items_with_names_are_found(spark):
    docs = cases.documents(spark, [f"{cases.prose(9)}. {item}. {cases.prose(9)}" for item in SHORT] + [item.lower() for item in SHORT] + [cases.prose(30)])
    found = {r.doc_id: r["items"] for r in flagged(docs, items(spark, list(enumerate(SHORT)))).select("row.doc_id", "items").collect()}
    assert [found[i] for i in range(len(found))] == [[i % 4] for i in range(8)] + [[]]


def _plain_tokens(text):
    """(kind, word) by character, for texts of plain words, single blanks and full stops."""
    out, before = [], ". "
    for word in text.split(" "):
        bare = word.strip(".")
        kind = "n" if bare.isdigit() else "w"
        if bare.istitle() and len(bare) > 1:
            kind = "s" if before[-1] == "." else "a"
        if bare.lower() in UNITS and out and out[-1][0] == "n" and before[-1] != ".":
            kind = "u"
        out.append((kind, bare.lower()))
        before = word
    return out


def _holds(item, doc):
    """Tries every shift and reading token by token."""
    read = lambda t, names: t[0] if t[0] in "nu" else "a" if t[0] in names else ("w", t[1])
    windows = len(item) - 7
    needed = max(1, min(windows - 1, 5))
    for shift, names, slots in itertools.product(range(-len(item), len(doc)), ("as", "a"), (True, False)):
        if not slots and names == "as":
            continue
        met = lambda i, d, names=names: i[0] == d[0] and i[0] in "nu" or i[0] in names and d[0] in names
        pair = {p: (item[p], doc[p + shift]) for p in range(len(item)) if 0 <= p + shift < len(doc)}
        # a stretch is what windows of any reading have in common
        seen = [p for p in range(windows) if all(q in pair for q in range(p, p + 8)) and any(all(read(pair[q][0], n) == read(pair[q][1], n) for q in range(p, p + 8)) for n in ("as", "a", ""))]
        if len(seen) < needed:
            continue
        pair = {p: pair[p] for p in range(seen[0], seen[-1] + 8) if p in pair}
        equal = {p: i[1] == d[1] or slots and met(i, d) for p, (i, d) in pair.items()}
        hits = [p for p in range(seen[0], seen[-1] + 1) if all(equal.get(q) for q in range(p, p + 8))]
        if len(hits) < needed:
            continue
        held = set()
        for p in range(hits[0], hits[-1] + 8):
            i, d = pair[p]
            if met(i, d) or (i[0] in "nu" + names and i[1] == d[1]):
                kind = i[0] if i[0] in "nu" else "a"
                held.add(((kind, i[1]), (kind, d[1])))
        if not slots or len({i for i, _ in held}) == len({d for _, d in held}) == len(held):
            return True
    return False


def test_many_short_items_agree_with_brute_force(spark):
    rng = cases.random.Random(5)
    words, names, units = "one man cow hill road cake song".split(), "Ann Bob Cleo Dan".split(), ["miles", "kg"]

    def sentence(count):
        out = [rng.choice(names) if rng.random() < 0.5 else rng.choice(words).title()]
        while len(out) < count:
            out += rng.choice([[rng.choice(words)], [rng.choice(words)], [rng.choice(names)], [str(rng.randint(2, 5)), rng.choice(units)]])
        return " ".join(out) + "."

    def changed(text):
        swap = dict(zip(names, rng.sample(names, 4), strict=True)) | dict(zip("2345", rng.sample("6789", 4), strict=True))
        out = [swap.get(w.strip("."), w.strip(".")) + "." * w.endswith(".") for w in text.split(" ")]
        if rng.random() < 0.5:
            out[rng.randrange(len(out))] = rng.choice(words + names)
        return " ".join(out)

    rows = [" ".join(sentence(rng.randint(3, 6)) for _ in range(rng.randint(2, 3))) for _ in range(40)]
    texts = [f"{sentence(6)} {make(row)} {sentence(5)}" for row in rows for make in (str, changed, str.lower)]
    docs, wanted = cases.documents(spark, texts), items(spark, list(enumerate(rows)))
    found = {r.doc_id: r["items"] for r in flagged(docs, wanted).select("row.doc_id", "items").collect()}
    plain_items, plain_docs = [_plain_tokens(t) for t in rows], [_plain_tokens(t) for t in texts]
    assert [found[d] for d in range(len(texts))] == [[i for i, item in enumerate(plain_items) if len(item) >= 8 and _holds(item, plain_docs[d])] for d in range(len(texts))]


def test_slots_are_compared_once_a_row(spark):
    words = [f"w{i}" for i in range(300)]
    pair = lambda i, other="": {"item_words": "<n7" if i == 150 else words[i], "doc_words": "<n9" if i == 150 else other or words[i]}
    rows = [(1, 5, 10, [pair(i) for i in range(300)]), (2, 5, 10, [pair(i, "x" if i % 8 == 7 else "") for i in range(300)])]
    rows = spark.createDataFrame(rows, "id int, needed int, first int, pairs array<struct<item_words: string, doc_words: string>>")
    judged = contamination._judged(rows, "id")
    assert {r.id: r.at and tuple(r.at) for r in judged.collect()} == {1: (10, 302), 2: None}
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(pairs") == len(contamination._READINGS)
