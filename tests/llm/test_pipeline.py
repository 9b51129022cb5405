"""The corpus pipeline: each stage against what it must do to its own input."""

import public_tokenizers

import corpus_pipeline
from locusframe.llm import neardup, suffixes
from locusframe.llm.common import Work

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, work, seen = docs.columns, Work(spark), [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(work.put(stage(spark, seen[-1], SF), f"t{i}"))
    for df in seen[1:5]:
        assert df.columns == columns
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in seen]
    assert ids[0] > ids[1] > ids[2] and ids[2] == ids[3] and ids[3] >= ids[4] == ids[5]
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(marks[i] for i in marks if i not in ids[1]) <= 2
    classes = {r["doc_id"]: r["class_id"] for r in neardup.classes(seen[1]).collect()}
    assert ids[2] == {i for i, c in classes.items() if i == c}
    left = suffixes.deduplicate(seen[2]).collect()
    kept = {r["doc_id"]: bytes(r["kept"]).decode(errors="ignore") for r in left}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in seen[3].collect()} == {k: (t, len(t)) for k, t in kept.items()}
    import tiktoken

    from locusframe.llm.bpe import Vocabulary

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Vocabulary(f.read()).ranks, special_tokens={})
    for r in seen[5].collect():
        assert r["ids"] == library.encode_ordinary(kept[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
