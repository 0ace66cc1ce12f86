import hashlib
import re

from quireflow.llm import decontaminate

from conftest import sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def tokens(t):
    return WORD.findall((t or "").translate(LOW))


def brute(text, items, window=13):
    t, hit, names = tokens(text), set(), set()
    for name, x in items:
        w = tokens(x)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for p in range(len(t) - n + 1):
                if t[p : p + n] == w[k : k + n]:
                    hit |= set(range(p, p + n))
                    names.add("" if name is None else str(name))
    return len(t), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(t)


ITEMS = [(1, sentence(1, 30)), (10, sentence(2, 14)), (2, "Three Word item"), (3, None), (4, "!?"), (5, sentence(1, 30)), (None, "Größe über alles zusätzlich"), (6, "solo"), (6, "other text here")]
BENCH = "item_id LONG, text STRING, doc_id STRING, spans STRING"


def affected(text, items, window=13):
    """Whether brute() finds a share of a twentieth, or a run of the window in any item."""
    t = tokens(text)
    runs = [tokens(x)[k : k + window] for _, x in items for k in range(len(tokens(x)) - window + 1)]
    return brute(text, items)[4] or any(t[p : p + window] in runs for p in range(len(t) - window + 1))


def texts():
    a, b = sentence(1, 30), sentence(2, 14)
    return [None, "", " . ", a, f"{sentence(8, 200)} {a.upper()} {sentence(9, 100)}", b.replace(" ", "--"), " ".join(b.split()[:12]), "three   word-item", "Solo", "x GRößE Über alles zusätzlich y", f"{a} {a} {b}", " ".join(a.split()[:13]) + " stop " + " ".join(a.split()[13:28]), sentence(3, 5000) + " " + b, "other text here solo"]


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in df.collect())


def test_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, texts()[3]), (3, texts()[3])]
    docs = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "doc_id LONG, text STRING, n_words STRING, found STRING")
    bench = spark.createDataFrame([(*x, "x", "x") for x in ITEMS], BENCH)
    want = sorted((i is None, i or 0, brute(t, ITEMS)) for i, t in rows)
    assert got(decontaminate.contamination(docs, bench)) == want
    assert got(decontaminate.contamination(docs, bench, block_bytes=100)) == want  # in many blocks
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if not affected(t, ITEMS))
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminate(docs, bench, block_bytes=100).collect()) == sorted(str(r.doc_id) for r in kept.collect())
    assert {r.found for r in kept.collect()} == {"x"}


def test_whole_items_in_long_documents_are_removed(spark):
    """An item, or a window of one, in a text of which it is less than a twentieth; short items may occur there."""
    item = sentence(1, 30)
    rows = [(1, f"{sentence(8, 900)} {item} {sentence(9, 900)}"), (2, f"{sentence(8, 900)} {' '.join(item.split()[9:22])} {sentence(9, 900)}"), (3, f"{sentence(8, 900)} {' '.join(item.split()[9:21])} {sentence(9, 900)}"), (4, f"{sentence(8, 900)} Three Word item"), (5, sentence(8, 900))]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    bench = spark.createDataFrame([(1, item, "", ""), (2, "three word item", "", "")], BENCH)
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4, 5]


def test_longest_match(spark):
    a = sentence(1, 30).split()
    docs = spark.createDataFrame([(1, "intro " + " ".join(a[:20]) + " gap " + " ".join(a[5:30])), (2, "none")], "doc_id LONG, text STRING")
    r = {x.doc_id: (x.longest_match, x.match_start) for x in decontaminate.contamination(docs, spark.createDataFrame([(1, sentence(1, 30), "", "")], BENCH)).collect()}
    assert r == {1: (25, 22), 2: (0, None)}


def test_shards_are_cut(spark, monkeypatch):
    q = decontaminate.Queries([(str(i), t) for i, t in ITEMS], 13)
    many = [t for t in texts() for _ in range(3)]
    whole = list(decontaminate.scan_texts(iter(many), q))
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 10)
    assert list(decontaminate.scan_texts(iter(many), q)) == whole


def test_empty(odd, empty, spark):
    bench = spark.createDataFrame([(*x, "x", "x") for x in ITEMS], BENCH)
    assert decontaminate.contamination(empty, bench).count() == 0
    none = decontaminate.contamination(odd, bench.limit(0)).collect()
    assert len(none) == odd.count() and not any(r.contaminated for r in none)
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
