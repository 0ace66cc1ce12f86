from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.llm import lines

from conftest import sentence


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, least=lines.MIN_CHARS):
    """docs: doc_id -> text. Kept text."""
    seen, out = [], {}
    for i in sorted(docs):
        kept = []
        for x in docs[i].split("\n"):
            if x.strip():
                if any(x == y or (len(x) >= least and len(y) >= least and abs(len(x) - len(y)) < 2 and edit(x, y) < 2) for y in seen):
                    seen.append(x)
                    continue
                seen.append(x)
            kept.append(x)
        out[i] = "\n".join(kept)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=7), st.text("ab", max_size=7))
def test_one_edit(a, b):
    assert lines.one_edit(a, b) == (edit(a, b) <= 1)


@settings(max_examples=200, deadline=None)
@given(st.text("abé\U0001f600", min_size=1, max_size=9))
def test_hashes_of_deletions(s):
    k1, _ = lines.deletions(s, 0, len(s))
    assert k1[0] == lines.deletions(s, 0, 0)[0][0]
    for p in range(len(s)):
        assert k1[1 + p] == lines.deletions(s[:p] + s[p + 1 :], 0, 0)[0][0]


def test_against_brute_force(spark):
    base = [sentence(k, 6) for k in range(12)]
    docs = {}
    for d in range(24):
        x = base[d % 12]
        p = (d * 5) % len(x)
        kinds = [x, x[:p] + x[p + 1 :], x[:p] + "Q" + x[p:], x[:p] + "Z" + x[p + 1 :], x[: p // 2] + "QQ" + x[p // 2 :], x + "!", "!" + x]
        docs[d] = "\n".join([kinds[d % 7], "", base[(d * 7) % 12], kinds[(d + 3) % 7], "Yes.", f"short {d}", kinds[(d + 5) % 7]])
    df = spark.createDataFrame(list(docs.items()), "doc_id LONG, text STRING")
    assert {r.doc_id: r.text for r in lines.report(df).collect()} == brute(docs)
    exact = {r.doc_id: r.text for r in lines.report(df, max_edits=0).collect()}
    assert exact == brute(docs, 10**9)


def test_odd_rows(odd):
    got = lines.dedup(odd).collect()
    assert len(got) == odd.count() and set(got[0].asDict()) == set(odd.columns)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    docs = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    want = brute({k: v for k, v in docs.items() if v is not None})
    assert {k: r.text for k, r in by.items()} == {k: want.get(k) for k in docs}
    assert all(r.n_chars == len(r.text) for r in by.values() if r.text is not None)
    assert sorted(str(r.text) for r in got if r.doc_id is None) == sorted(str(r.text) for r in odd.collect() if r.doc_id is None)
    assert sum(r.text == by[1].text for r in got if r.doc_id == 1) == 3


def test_empty(empty):
    assert lines.dedup(empty).count() == 0 and lines.report(empty).count() == 0


def test_near_group_and_shuffle_join(spark, monkeypatch):
    """Many lines that differ in one character, and the other way of looking lines up."""
    x = sentence(5, 20)
    docs = {k: x[:30] + chr(97 + k % 26) + chr(65 + k // 26) + x[32:] for k in range(120)}
    df = spark.createDataFrame(list(docs.items()), "doc_id LONG, text STRING")
    want = brute(docs)
    assert {r.doc_id: r.text for r in lines.report(df).collect()} == want
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert {r.doc_id: r.text for r in lines.report(df).collect()} == want
