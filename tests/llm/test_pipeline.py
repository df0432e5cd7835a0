import re

import corpus_pipeline
from raregrain.llm import mix_schedule, sql
from raregrain.llm.decontam import decontaminate

from .helpers import SPACED, brute_components, duck, rows_of
from .test_secrets import base_spans


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "mixing":
            assert out.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs.toPandas(), spark.read.parquet(str(tmp_path / name)).toPandas())
        docs = spark.read.parquet(str(tmp_path / name))
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    gone = set(before["doc_id"]) - set(after["doc_id"])
    clean = [i for i in before["doc_id"] if labels.get(i, 0) == 0]
    assert sum(i in gone for i in clean) <= 0.05 * len(clean)
    before, after = kept["near_duplicates"]
    want = brute_components(before["doc_id"].tolist(), before["text"].tolist(), 80)
    assert sorted(after["doc_id"]) == sorted(set(want.values()))
    before, after = kept["decontamination"]
    found = decontaminate(spark.createDataFrame(before[["doc_id", "text"]]), spark.read.parquet(f"{sf}/benchmark.parquet")).filter("n_hit = 0")
    assert sorted(after["doc_id"]) == sorted(r["doc_id"] for r in found.collect())
    before, after = kept["secrets"]
    assert len(before) == len(after) and not [t for t in after["text"] if base_spans(t)]
    texts = after.set_index("doc_id")["text"]
    for i, t in before[["doc_id", "text"]].itertuples(index=False):
        spans = [tuple(map(int, re.findall(r"\d+", s))) for s in base_spans(t).split(",") if s]
        if not spans:
            assert texts[i] == t or "[SECRET]" in texts[i]
    sizes = {i: len(SPACED.findall(t)) for i, t in texts.items()}
    mixed = kept["mixing"][1].set_index("doc_id")
    assert mixed["size"].to_dict() == sizes and (mixed["taken"] <= 2 * mixed["size"]).all()
    last = spark.read.parquet(str(tmp_path / "secrets"))
    assert rows_of(mix_schedule.taken(last).drop("source")) == duck(sql.OP3, documents=last)
