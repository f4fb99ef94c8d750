import hashlib
import uuid

from oracle import SF
from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm.common import table


def test_stages_in_turn(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, sizes, tables = docs.columns, [docs.count()], [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
        assert tables[-1].columns == columns and tables[-1].dtypes == docs.dtypes
        sizes.append(tables[-1].count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4]
    texts = [r.text for r in tables[2].select("text").collect()]
    assert len({hashlib.sha256(t.encode()).digest() for t in texts}) == len(texts) == len({r.text for r in tables[1].select("text").collect()})
    assert tables[4].filter(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")).count() == 0
    packed = corpus_pipeline.pack(spark, tables[4], SF)
    assert packed.select("doc_id").distinct().count() == sizes[4]


def test_run_and_edges(spark, edges, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "personal_data", "best_fit_packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0
    for table_ in (edges, empty):
        rows = table_
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        rows.collect()


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept, held against plain programs."""
    from test_exact_and_near import brute
    from test_filters import base_spans
    from test_tokens import check_packed

    from tilewright.llm import langid, pii

    tables = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(stored_again(spark, stage(spark, tables[-1], SF)))
    rows = [{r.doc_id: r.text for r in t.collect()} for t in tables]

    answers = langid.identify(tables[0]).collect()
    assert set(rows[1]) == {r.doc_id for r in answers if r.lang_pred != "und" and r.score >= langid.FLOOR} and len(rows[1]) > 190

    last = {}
    for i, t in rows[1].items():
        last[t or ""] = max(i, last.get(t or "", i))
    assert set(rows[2]) == set(last.values())

    listed = sorted(rows[2].items())
    _, root = brute(listed)
    assert set(rows[3]) == {listed[k][0] for k in set(root)}

    found = {r.doc_id: r.spans for r in pii.find_personal_data(tables[3]).collect()}
    for i, t in rows[3].items():
        assert [s for s in found[i].split(",") if s.split(":")[0] in pii.BASE] == base_spans(t or "")
        spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in found[i].split(",") if s))
        if any(x[1] > y[0] for x, y in zip(spans, spans[1:])):
            continue  # of findings that overlap the first kind's is marked
        want, at = "", 0
        for a, b, kind in spans:
            want, at = want + t[at:a] + f"[{kind.upper()}]", b
        assert rows[4][i] == want + t[at:]

    check_packed(corpus_pipeline.pack(spark, tables[4], SF).collect(), list(rows[4].items()))


def stored_again(spark, df):
    folder = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.parquet(folder)
