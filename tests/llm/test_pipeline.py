"""The pipeline's stages against brute-force counterparts, each on what the one before it kept."""

import corpus_pipeline
from tests.llm.helpers import DOCS, empty, odd_docs, odd_rows, rows_of, word
from tests.llm.test_neardup import brute_classes, crowd
from tests.llm.test_quality import brute_kept
from tests.llm.test_substring import brute as cut


def rows():
    extra = [(700 + i, f"{' '.join(word(i * 1000 + j, 'p') for j in range(60))}. {' '.join(word(j, 's') + '###' for j in range(40)) if i == 0 else 'end'}", "en", "b", 1) for i in range(4)]
    return odd_rows() + crowd(9, (0, 4)) + extra + [(17, "another text under one id " * 9, None, None, None)]


def test_stages(spark, tmp_path):
    docs, kept = spark.createDataFrame(rows(), DOCS), rows()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        if name == "quality_rules":
            kept = [r for r, good in zip(kept, brute_kept([r[1] for r in kept]), strict=True) if good]
            assert 20 < len(kept) < len(rows()) - 8 and 700 not in {r[0] for r in kept}
        elif name == "near_dedup":
            kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
            classes = brute_classes([(i, r[1]) for i, r in enumerate(kept)])
            kept = [r for i, r in enumerate(kept) if classes[i] == i]
        else:
            kept = [(r[0], b[2] if b[1] else r[1], *r[2:4]) for r, b in zip(kept, cut([r[1] for r in kept], 35), strict=True)]
            assert rows_of(out, "doc_id", "text", "lang", "source") == sorted(kept, key=repr)
            assert out.where("n_chars <> char_length(text)").count() == 0
        assert rows_of(out, "doc_id") == sorted(((r[0],) for r in kept), key=repr), name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    mixed = corpus_pipeline.source_mix(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.exceptAll(docs.unionAll(docs).unionAll(docs)).isEmpty()
    assert corpus_pipeline.byte_bpe(spark, mixed, str(tmp_path)).count() == mixed.count()


def test_run(spark, tmp_path):
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_stages_take_empty_tables(spark, tmp_path):
    docs = empty(odd_docs(spark))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "source_mix", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
