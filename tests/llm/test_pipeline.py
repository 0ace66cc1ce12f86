import corpus_pipeline
import pytest

from quireflow.llm import decontaminate, langid, lines, mixing, simhash
from quireflow.llm.common import stored

from conftest import sentence

from test_decontaminate import affected
from test_lines import brute as line_brute
from test_simhash import brute_fingerprint, roots


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(k, "\n".join(sentence(k * 3 + j, 12) for j in range(3)), "en", f"s{k % 3}", 1, "x") for k in range(60)]
    bench = sentence(999, 20)
    rows += [(100, rows[0][1], "en", "s0", 1, "x"), (101, rows[1][1] + "\n" + sentence(7777, 12), "en", "s1", 1, "x"), (102, bench, "en", "s2", 1, "x"), (103, None, None, None, None, None), (104, "12 34", "en", "s0", 1, "x"), (105, sentence(5, 12) + "\n" + bench, "en", "s1", 1, "x"), (106, sentence(4321, 1200) + "\n" + bench + "\n" + sentence(1234, 200), "en", "s1", 1, "x")]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, target STRING").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id LONG, text STRING").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stage_by_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    text = lambda d: {r.doc_id: r.text for r in d.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = text(docs), stage(spark, docs, folder)
        after = text(out)
        if k < 4:
            assert out.columns == columns
        if k == 0:
            assert set(before) - set(after) == {103, 104}
        elif k == 1:
            assert after == line_brute(before)
        elif k == 2:
            ids = sorted(before)
            r = roots([brute_fingerprint(before[i]) for i in ids])
            assert set(after) == {ids[x] for x in r}
        elif k == 3:
            assert set(after) == {i for i in before if not affected(before[i], [(1, sentence(999, 20))])}
        else:
            assert set(after) == {r.doc_id for r in mixing.mix(docs).filter("taken > 0").collect()}
        docs = out
    want = sorted(str(r.asDict()) for r in docs.collect())
    assert sorted(str(r.asDict()) for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_stages_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls, ties, repeated rows, a very long text and clashing names through all stages: each keeps some of the rows before, all with their other columns as they were."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, sentence(777)), (None, None)], "item_id LONG, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, before = odd, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == odd.columns
        ids = [r.doc_id for r in out.collect()]
        assert before is None or set(ids) <= set(before)
        assert {r[c] for r in out.select("h", "__kept", "found").collect() for c in ("h", "__kept", "found")} <= {"x"}
        docs = stored(out)
        before = ids
    assert 7 in before and None in before and 4 not in before  # the long text and one without doc_id stay; a null text goes
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def test_each_stage_calls_its_operator():
    assert all(callable(f) for f in (langid.accepted, lines.dedup, simhash.dedup, decontaminate.decontaminate, mixing.mixed))
