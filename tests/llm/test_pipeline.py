import random

import sentencepiece
import public_tokenizers

import corpus_pipeline
from leafmill.llm.common import words

RNG = random.Random(2)


def test_stages_against_plain_rules(spark, tmp_path):
    prose = lambda n: " ".join(f"w{RNG.randrange(900)}" for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        rows.append((i, prose(60) + (" scum vile rot" * 2 if toxic else ""), "en", "s", 0))
        if i < 240:
            labels.append((i, 1, int(toxic)))
    item = prose(14)
    copy, passage = prose(80), "\n".join(prose(13) for _ in range(6))
    rows += [(400, copy, "en", "s", 0), (401, copy.replace(" ", "  "), "en", "s", 0), (402, copy + " one", "en", "s", 0)]
    rows += [(410, prose(30) + " " + item + " " + prose(30), "en", "s", 0)]
    rows += [(420 + k, prose(15) + "\n" + passage + "\n" + prose(15), "en", "s", 0) for k in range(2)]
    rows += [(430, None, None, None, None), (431, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    first = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == first, name
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    toxic, lines, near, clean, coded = kept.values()
    ids = {r[0] for r in rows}
    assert ids - set(toxic) == {i for i in range(0, 300, 6)}
    assert set(lines) == set(toxic) and len(lines[421].text) < len(lines[420].text) and lines[420].text == rows[-4][1]
    assert set(lines) - set(near) == {401, 402}
    assert set(near) - set(clean) == {410} and words(item)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {i: r.ids for i, r in coded.items()} == {i: sp.encode(r.text or "") for i, r in clean.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i: r.ids for i, r in coded.items()}
