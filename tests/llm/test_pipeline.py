"""The pipeline's stages, each held against brute force on what the stage before it left."""

import random

import pytest

import corpus_pipeline as pipeline
from wiretide.llm import toxicity

from .test_corpus import brute_classes, covered, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("klmnopqr") for _ in range(rng.randint(2, 7))) for _ in range(2500)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, leak = say(70), say(14)
    texts, toxic = [], []
    for i in range(240):
        t = say(rng.randint(20, 120))
        toxic.append(i % 6 == 0)
        texts.append(t + " vile scum" if toxic[-1] else t)
    for t in (f"{say(30)} {passage} {say(8)}", f"{passage} {say(25)}", f"{say(20)} {leak} {say(20)}", texts[7], texts[7], texts[8] + " more", None, "", "short one", say(4000)):
        texts.append(t)
        toxic.append(False)
    root = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "src", None if t is None else len(t), "extra") for i, t in enumerate(texts)]
    spark.createDataFrame(rows + [rows[3]], "doc_id long, text string, lang string, source string, n_chars long, uid string").repartition(4).write.parquet(f"{root}/documents.parquet")
    marks = [(i, 1, int(x)) for i, x in enumerate(toxic) if i % 2 == 0]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, say(12)), (3, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), leak


def test_stages(spark, folder, tmp_path):
    sf_dir, leak = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(pipeline.STAGES) - 1:
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        kept = sorted((tuple(r) for r in after), key=str)
        if name == "toxicity":
            train = ~toxicity.in_fold(5, 0)
            model = toxicity.model(spark.read.parquet(f"{sf_dir}/documents.parquet").where(train), spark.read.parquet(f"{sf_dir}/labels.parquet").where(train))
            fine = {r["doc_id"] for r in toxicity.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), model).collect() if r["score"] < 0.5}
            assert kept == sorted((tuple(r) for r in before if r["doc_id"] in fine), key=str)
            assert not {r["doc_id"] for r in after if "vile" in words(r["text"])} and len(after) == len(before) - 40
        elif name == "near duplicates":
            of, _, _ = brute_classes(before)
            first = {}
            for r, c in zip(before, of, strict=True):
                if c not in first or r["doc_id"] < first[c]["doc_id"]:
                    first[c] = r
            assert kept == sorted((tuple(r) for r in first.values()), key=str)
        elif name == "repeated passages":
            assert not covered([tuple(r) for r in after], 50)
            old, repeated = {r["doc_id"]: r for r in before}, covered([tuple(r) for r in before], 50)
            assert repeated and {r["doc_id"] for r in after} == set(old)
            for r in after:
                assert tuple(r) == tuple(old[r["doc_id"]]) or (r["doc_id"] in repeated and r["n_chars"] == len(r["text"]) < len(old[r["doc_id"]]["text"]))
        elif name == "decontamination":
            inside = lambda t: any(words(t)[i : i + 10] == words(leak)[j : j + 10] for i in range(len(words(t)) - 9) for j in range(5))
            assert kept == sorted((tuple(r) for r in before if not inside(r["text"])), key=str) and len(after) == len(before) - 1
        before = after
    packed = out.collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in before}
    ends = {}
    for r in packed:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in ends.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    whole = pipeline.run(spark, sf_dir).collect()
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(whole) == key(packed)


def test_empty_tables(spark, folder, tmp_path):
    sf_dir, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
