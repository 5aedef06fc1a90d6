import math
import random
import re
from collections import Counter

from articleflow.llm import privacy
from articleflow.llm.privacy import BASE_KINDS, find_personal_data, sanitised

from . import cases


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


DATA = [
    "a@b.c_d@e.f x.y@z-1.co.uk, \U0001f600 é1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0255 4111 1111 1111 1111 4111-1111-1111-1112 +1 (555) 010-9999. +49 30 1234567",
    "1 2 3 4 5 6 7 8 9 " * 3000, "a" * 30000 + "@x.yy b@c" + ".d" * 10000, "é@x.y +1 2 3 0.0.0.0 99999999999999999999.1.1.1",
]
TALK = ["Bob Smithson writes bob@corp.example today", "Smithson mails bob@corp.example again", "hello Smithson and bob@corp.example", "other words, hello again today", "hello, mail today"]


def test_base_spans_equal_brute_force(spark):
    rows = cases.texts() + DATA
    found = {r.id: r.spans for r in find_personal_data(cases.documents(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, text in enumerate(rows):
        assert [(s.kind, s.start, s.end) for s in found[i] if s.kind in BASE_KINDS] == base(text or "")


def test_terms_that_reveal_an_entity_go(spark):
    docs = cases.documents(spark, TALK)
    found = find_personal_data(docs)
    more = {r.id: [(s.kind, s.value) for s in r.spans if s.kind not in BASE_KINDS] for r in found.collect()}
    assert more == {0: [("removed", "Smithson")], 1: [("removed", "Smithson")], 2: [("removed", "Smithson")], 3: [], 4: []}
    clean = {r.doc_id: r.clean for r in docs.select("doc_id", "text").join(found.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", sanitised("text", "spans").alias("clean")).collect()}
    assert clean[0] == "Bob  writes <email> today" and clean[3] == TALK[3]


def test_copies_make_no_term_revealing(spark):
    found = find_personal_data(cases.documents(spark, [TALK[0]] * 5 + TALK[3:])).collect()
    assert all(s.kind in BASE_KINDS for r in found for s in r.spans) and sum(len(r.spans) for r in found) == 5


def test_copies_hide_no_term(spark):
    found = find_personal_data(cases.documents(spark, TALK[:1] * 40 + TALK)).collect()
    assert {s.value for r in found for s in r.spans if s.kind == "removed"} == {"Smithson"}
    assert not any(s.kind == "generalised" for r in found for s in r.spans)


def test_terms_beside_an_entity_of_one_text_go(spark):
    rows = ["Smithson writes bob@corp.example today"] + [f"{word} writes words today" for word in cases.WORDS[:20]]
    found = {r.id: [(s.kind, s.value) for s in r.spans] for r in find_personal_data(cases.documents(spark, rows)).collect()}
    assert found.pop(0) == [("removed", "Smithson"), ("email", "bob@corp.example")]
    assert not any(found.values())


def test_terms_of_a_given_table_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = find_personal_data(docs).collect()
    assert any(s.kind == "removed" for r in found for s in r.spans) and any(s.kind == "generalised" for r in found for s in r.spans)
    assert all(any(s.kind in BASE_KINDS for s in r.spans) for r in found if r.spans)


def test_awkward_rows_and_no_python(spark, plan_of):
    assert find_personal_data(cases.awkward(spark)).count() == 6
    assert find_personal_data(cases.empty(spark)).count() == 0
    plan = plan_of(find_personal_data(cases.documents(spark, TALK)))
    assert "Python" not in plan and "Arrow" not in plan


def near_terms(rows, disclosure=0.8):
    """The method counted out in plain loops: {(row, start, end): kind} of what is added."""
    texts = sorted({t or "" for t in rows})
    words = {t: [(m[0], *m.span()) for m in re.finditer(r"[^\W_]+", t)] for t in texts}
    entities = {t: [(kind, t[a:b], a, b) for kind, a, b in base(t)] for t in texts}
    n_t = Counter(w for t in texts for w in {w.lower() for w, _, _ in words[t] if len(w) >= 4})
    n_e = Counter(e for t in texts for e in {e[:2] for e in entities[t]})
    least, places = {}, {}
    for t in texts:
        inside = {i for i, (_, a, b) in enumerate(words[t]) if any(x < b and a < y for *_, x, y in entities[t])}
        for kind, value, x, y in entities[t]:
            first, last = sum(b <= x for _, _, b in words[t]), sum(a < y for _, a, _ in words[t]) - 1
            for i, (w, a, b) in enumerate(words[t]):
                distance = max(first - i, i - last)
                if len(w) >= 4 and i not in inside and distance <= 16:
                    key = (w.lower(), kind, value)
                    least.setdefault(key, {})[t] = min(distance, least.get(key, {}).get(t, 99))
                    places.setdefault(key, set()).add((t, a, b))
    found = {}
    for (w, *e), by_text in least.items():
        n, n_te = n_e[tuple(e)], len(by_text)
        told = math.log((n_te * len(texts) / n + 0.5) / (n_t[w] + 0.5))
        if (n_te >= 2 or min(by_text.values()) <= 3) and told > 0 and told >= disclosure * math.log(len(texts) / n):
            for place in places[(w, *e)]:
                found[place] = max(found.get(place, False), n_t[w] <= n_te)
    return {(i, a, b): "removed" if only else "generalised" for i, t in enumerate(rows) for (u, a, b), only in found.items() if u == (t or "")}


def talks(seed, n):
    dice, rows = random.Random(seed), []
    people = [(f"{name}son", f"{name.lower()}@corp{i}.example") for i, name in enumerate(["Smith", "Ander", "Peter", "John"])]
    for i in range(n):
        words = dice.choices(cases.WORDS, k=dice.randrange(5, 60)) + [f"rare{i}" + "x" * dice.randrange(3)]
        dice.shuffle(words)
        if i % 5 == 0:
            name, mail = people[i // 5 % 4]
            place = dice.randrange(len(words))
            words[place:place] = [name, "writes", mail] if i % 2 else [mail + ",", "10.0.0.1", "of", name]
        rows.append(" ".join(words))
    return rows + rows[:10]


def test_terms_equal_plain_loops(spark):
    rows = talks(3, 120) + TALK + ["-@-.- Smithson", "", None]
    found = find_personal_data(cases.documents(spark, rows)).collect()
    got = {(r.id, s.start, s.end): s.kind for r in found for s in r.spans if s.kind not in BASE_KINDS}
    assert got == near_terms(rows) and set(got.values()) == {"removed", "generalised"}


def test_planted_names_go_and_other_words_stay(spark):
    rows = talks(5, 300)
    found = find_personal_data(cases.documents(spark, rows)).collect()
    gone = [s.value for r in found for s in r.spans if s.kind not in BASE_KINDS]
    names = sum(len(re.findall(r"(?:Smith|Ander|Peter|John)son", t)) for t in rows)
    others = sum(len(w) >= 4 for t in rows if base(t) for w in t.split()) - names
    assert sum(v.endswith("son") for v in gone) == names
    assert sum(not v.endswith("son") for v in gone) < 0.02 * others


def test_generalised_terms_say_what_they_were(spark):
    spans = "array(named_struct('start', 0L, 'kind_no', 5, 'end', 4L, 'kind', 'generalised', 'value', {}))"
    rows = spark.sql(" union all ".join(f"select '{w} x' as t, {spans.format(repr(w))} as s" for w in ("Jane", "1984", "jane")))
    assert {r[0] for r in rows.select(sanitised("t", "s")).collect()} == {"<name> x", "<number> x", "<word> x"}


def test_texts_without_entities_are_not_shuffled_to_find_words(spark, plan_of, monkeypatch):
    plans = {}
    monkeypatch.setattr(privacy, "stored", lambda df, name, store=privacy.stored: plans.update({name: plan_of(df)}) or store(df, name))
    rows = privacy.find_personal_data(cases.documents(spark, ["Write to a@b.example, Quixotle.", "nothing here", None, "nothing here"])).collect()
    assert len(rows) == 4 and sorted(rows[0].asDict()) == ["id", "spans", "version"]
    assert sum(len(r.spans) > 0 for r in rows) == 1
    assert "Join" not in plans["words-of-texts"]
