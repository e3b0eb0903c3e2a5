import corpus_pipeline
from wardline.llm import near_copies, positional, quality_cnn, queries, secrets
from wardline.llm.common import written


def test_stages_are_what_they_do_one_by_one(spark, sf):
    """Every stage held against its operator's own decisions, taken row by row on the driver."""
    docs = queries.table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_filter", "near_dedup", "decontaminate", "redact_secrets", "tokenise"]
    model = queries.quality_model(docs, queries.table(spark, sf, "labels"))
    scores = {d["doc_id"]: float(model.score([(d["text"] or "").encode()])[0]) for d in docs.collect()}
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, now, sf), name)
        seen[name] = {r["doc_id"]: r for r in out.collect()}
        assert name == "tokenise" or out.columns == docs.columns
        if name == "quality_filter":
            assert seen[name].keys() == {i for i, s in scores.items() if s >= queries.GOOD}
        elif name == "near_dedup":
            groups = near_copies.near_groups(now).collect()
            assert seen[name].keys() == {g["component_id"] for g in groups}
        elif name == "decontaminate":
            windows, _ = positional.windows_of([(str(r["item_id"]), r["text"].encode()) for r in queries.table(spark, sf, "benchmark").collect()], 10)
            every = {tuple(w) for w in windows}
            clean = set()
            for r in now.collect():
                w = positional.words((r["text"] or "").encode())
                if not any(tuple(w[k : k + n]) in every for n in {len(x) for x in every} for k in range(len(w) - n + 1)):
                    clean.add(r["doc_id"])
            assert seen[name].keys() == clean
        elif name == "redact_secrets":
            before = {r["doc_id"]: r["text"] for r in now.collect()}
            assert seen[name].keys() == before.keys()
            for i, r in seen[name].items():
                assert r["text"] == secrets.redacted(before[i], secrets.all_spans(before[i])[2], "[SECRET]") and r["n_chars"] == len(r["text"])
        else:
            assert seen[name].keys() == seen["redact_secrets"].keys() and all(r["n_tokens"] == len(r["ids"]) // 4 for r in seen[name].values())
        now = out
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == seen["tokenise"].keys()


def test_hard_rows_pass_every_stage(spark, docs, sf):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() <= docs.count()
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_the_stages_keep_scores_out_of_the_documents():
    assert quality_cnn.SAMPLE_ROWS == 4000 and corpus_pipeline.COLUMNS == ("doc_id", "text", "lang", "source", "n_chars")
