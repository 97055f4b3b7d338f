import corpus_pipeline as cp
from docloom.llm import decontaminate, langid, mixing, secrets
from docloom.plans.tables import materialize
from tests.llm.helpers import SF, docs
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_simhash import brute_alike

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def test_stages_equal_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    now, before = documents, rows_of(documents)
    for name, stage in cp.STAGES[:-1]:
        now = materialize(stage(spark, now, SF), name)
        assert now.columns == COLUMNS
        got = rows_of(now)
        if name == "language_id":
            judged = langid.judge([r[1] for r in before], tuple(sorted(langid.learn(documents).items())))
            want = [r for r, j in zip(before, judged, strict=True) if j[0] != "und" and not (len(r[1]) >= cp.MIN_CHARS and j[2] > cp.MAX_BITS)]
        elif name == "simhash_dedup":
            groups = brute_alike([r[1] for r in before], cp.SIMILARITY, cp.SHINGLE)
            least = {g: min(r[0] for r, k in zip(before, groups, strict=True) if k == g) for g in set(groups)}
            want = [r for r in before if r[0] in least.values()]
        elif name == "decontamination":
            dirty = {d for d, _ in leaks([r[:2] for r in before], items)}
            want = [r for r in before if r[0] not in dirty]
        else:
            clean = [(r[0], secrets.redact_text(r[1], secrets.scan_texts([r[1]])[0], "[SECRET]"), *r[2:4]) for r in before]
            want = [(*r, len(r[1])) for r in clean]
        assert got == sorted(want), name
        before = got
    last = cp.STAGES[-1][1](spark, now, SF)
    assert sorted(map(str, last.collect())) == sorted(map(str, mixing.mix_sources(now).collect()))
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, last.collect()))


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    rows = [(1, None, None, None), (None, "some words here", "en", "a"), (2, "", "en", None), (3, "some other words", None, None), (3, "some other words", None, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()} <= {None, 3}


def test_clean_documents_stay(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    item = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.drop_leaks(df, item.where("false")).count() == 40


def test_empty_tables(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.collect() == [] and "taken" in out.columns
