import re

import corpus_pipeline as C
import numpy as np
import public_tokenizers
from regionflow.llm import language as L
from tokenizers import Tokenizer

from .test_dedup import alike
from .test_scans import plain

PLACE = "/root/testdata/sf0.001"


def brute(spark):
    docs = spark.read.parquet(f"{PLACE}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = L.learn(docs)
    found = dict(zip(rows, model.predict(rows.values()), strict=True))
    rows = {k: t for k, t in rows.items() if found[k][0] != "und" and found[k][1] >= L.REJECT_BELOW}
    best = {}
    for k, t in rows.items():
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), k))
    rows = {k: rows[k] for k in (min(g)[1] for g in best.values())}
    part = alike(rows)
    rows = {k: t for k, t in rows.items() if part[k] == k}
    for k, t in rows.items():
        spans, out, at = [], [], 0
        for start, _, _, end in plain(t):
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([start, end])
        for a, b in spans:
            out += [t[at:a], "[SECRET]"]
            at = b
        rows[k] = "".join([*out, t[at:]])
    return rows


def test_run(spark):
    want = brute(spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(C.TOKENIZER))
    got = {}
    for r in C.run(spark, PLACE).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in want.items()}


def test_stages_leave_other_columns_alone(spark, docs):
    """Whatever they are called, columns of a row that stays are as they were."""
    others = [c for c in docs.columns if c != "text"]
    before = {tuple(r[c] for c in others) for r in docs.collect()}
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, PLACE)
        kept = [tuple(r[c] for c in others) for r in out.collect()]
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and kept and set(kept) <= before


def test_stages_keep_the_columns_and_odd_rows(spark, docs, nothing):
    for source in (docs, nothing):
        df = source
        for _, stage in C.STAGES[:-1]:
            df = stage(spark, df, PLACE)
            assert df.columns == docs.columns
        out = C.STAGES[-1][1](spark, df, PLACE)
        assert out.count() >= df.count()
        if source is docs:
            ids = {r["doc_id"] for r in df.collect()}
            assert {2, 7, 10, 11, 13, 14} <= ids and not {1, 3, 4, 5, 6, 8, 15} & ids
    assert np.isscalar(C.SHINGLE_WORDS)
