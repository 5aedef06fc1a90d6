import re

from articleflow.llm.lines import STRIPPED, dedup_lines

from . import cases


def brute(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(STRIPPED))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_equal_brute_force_and_bitmaps_rebuild_texts(spark):
    rows = list(enumerate(cases.texts()))
    found = dedup_lines(cases.documents(spark, [t for _, t in rows])).select("row.doc_id", "row.text", "row.label", "n_lines", "n_dropped", "kept", "keep_runs").collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found) == brute(rows)
    assert sum(r.n_dropped for r in found) > 20 and {r.label for r in found} == {"own label"}
    for r in found:
        lines, at, kept = (r.text or "").split("\n"), 0, []
        for run in r.keep_runs:
            kept += lines[at : at + run] if run > 0 else []
            at += abs(run)
        assert at == len(lines) and "\n".join(kept) == r.kept


def test_lines_with_null_and_repeated_ids(spark):
    found = dedup_lines(cases.awkward(spark)).select("row.doc_id", "row.text", "n_dropped").collect()
    assert len(found) == 6 and all(r.n_dropped == 0 for r in found)  # two documents at most hold the line
    line = cases.SHARED[4]
    rows = dedup_lines(cases.documents(spark, [line] * 5, [None, 1, 2, 3, 4])).select("row.doc_id", "n_dropped").collect()
    assert {r.doc_id: r.n_dropped for r in rows} == {None: 1, 1: 1, 2: 1, 3: 1, 4: 0}
    assert dedup_lines(cases.empty(spark)).count() == 0


def test_lines_use_no_python(spark, plan_of):
    plan = plan_of(dedup_lines(cases.documents(spark)))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
