"""The pipeline's stages against plain versions on a small corpus."""

import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from barloom.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def corpus():
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(900)]
    rows, labels = [], []
    for i in range(500):
        words = [r.choice(vocab) for _ in range(r.randint(60, 160))]
        if i % 9 == 0:
            words[10:12] = ["zorgle", "quibnast"]
        if i % 11 == 0:
            words[20] = "password=0123456789abcdef01"
        rows.append((i, ". ".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(i % 9 == 0)))
    rows += [(500 + i, rows[i + 1][1], "en", "s1", 0) for i in range(30)]
    rows += [(600, None, None, None, None), (601, "", "en", "s0", 0), (602, "tiny", "en", None, 4)]
    return rows, labels


def test_stages_in_order(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "bpe"]
    clean = {x.doc_id for x in seen["toxicity"]}
    toxic = {i for i in range(500) if i % 9 == 0} | {500 + i for i in range(30) if (i + 1) % 9 == 0}
    assert not clean & toxic and len(clean) == len(rows) - len(toxic)
    one = {x.doc_id for x in seen["simhash"]}
    copies = {500 + i for i in range(30)} | {601}  # null and empty texts are one class
    assert one == clean - copies
    assert {x.doc_id for x in seen["secrets"]} == one
    assert not any("0123456789abcdef01" in (x.text or "") for x in seen["secrets"])
    size = {x.doc_id: len((x.text or "").split()) for x in seen["secrets"]}
    taken = {}
    for x in seen["mixing"]:
        taken[x.doc_id] = taken.get(x.doc_id, 0) + len(x.text.split())
    assert all(n <= 2 * size[d] for d, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.02 * sum(size.values())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = sorted((x.doc_id, len(library.encode_ordinary(x.text))) for x in before.collect())
    assert sorted((x.doc_id, x.n_tokens) for x in seen["bpe"]) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(want)


def test_stages_leave_columns_of_any_name(spark, tmp_path):
    """Columns named as those that stages use inside come through each stage as they were."""
    rows, labels = corpus()
    names = ["size", "take", "pass", "_mix_row", "row", "score", "_doc", "_text", "key", "kept", "label", "spans", "_rest", "ids", "words"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows[:60] + rows[-3:])]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, schema)
    own = {r[5 + names.index("size")][4:] for r in rows}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        for r in docs.collect():
            assert r["size"][4:] in own and all(r[n] == n + r["size"][4:] for n in names)
    assert 30 < docs.select("_mix_row").distinct().count() <= 63
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
