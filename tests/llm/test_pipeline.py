import itertools
import random

import corpus_pipeline
from revlake.llm import decontamination, hashing, linededup, mixing, neardup, quality
from revlake.llm.queries import ORACLES, QUERIES

from .test_operators import brute_lines, prose


def test_queries_are_registered():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    columns, rows = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        assert 0 < docs.count() <= rows, name
        rows = docs.count()
        assert set(columns) <= set(docs.columns) and (name == "mixing" or docs.columns == columns)
    last = docs.collect()
    assert len({r.doc_id for r in last}) == len(last)
    for r in last:
        lines = before[r.doc_id].text.split("\n")
        assert all(x in lines for x in r.text.split("\n") if x) and r.n_chars == len(r.text) and r.taken <= 2 * r["size"]


def test_the_mix_takes_effect_on_the_rows(spark):
    rows = [(i, "one two three", "hot" if i < 200 else "small") for i in range(210)] + [(900, "", "small")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    every = {r.doc_id: r.taken for r in mixing.mix(docs, "text", "source").collect()}
    found = {r.doc_id: r.taken for r in corpus_pipeline.mix(spark, docs, "").collect()}
    assert every[900] == 0 and found == {i: n for i, n in every.items() if n}


def test_run_against_brute_force(spark, tmp_path, monkeypatch):
    """Every stage's rows, from plain Python over the whole of its input: scores of all texts, all pairs of lines and of documents, every item aligned with every text."""
    rng, docs, labels = random.Random(51), [], []
    items = [(1, prose(rng, 30)), (2, prose(rng, 25)), (3, None)]
    shared = [prose(rng, 18) for _ in range(3)]
    near = prose(rng, 90).split()
    for i in range(240):
        lines = [prose(rng, rng.randrange(20, 60)) for _ in range(3)]
        if i % 4 == 0:
            lines.insert(1, shared[i % 3][:-1] + rng.choice("abcd"))
        if i % 10 == 1:
            copy = list(near)
            copy[rng.randrange(90)] = f"edit{i}"
            lines = [" ".join(copy)]
        if i % 15 == 2:
            lines.append(items[i % 2][1])
        bad = i % 5 == 3
        text = "\n".join(lines)
        docs.append((i, "!! ".join(text.split(" ")).upper() if bad else text, "en", ["a", "b", None][i % 3], len(text)))
        if i % 2:
            labels.append((i, int(not bad), 0))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = quality.fit(frame, labels)
    good = [(i, t) for i, t, *_ in docs if model.score(quality.features(t)[None])[0] >= 0.5]
    monkeypatch.setattr(linededup, "SHINGLE", linededup.FINE)  # of the brute-force version
    cut = brute_lines(good)
    rows = spark.createDataFrame(list(cut.items()), "doc_id bigint, text string")
    idf = neardup.idf_table(rows)
    weighed = {i: neardup.weigh(t, idf) for i, t in cut.items()}
    root = {i: i for i in cut}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(cut, 2):
        if cut[a] == cut[b] or neardup.similarity(weighed[a], weighed[b]) >= neardup.THRESHOLD:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    code = lambda t: hashing.words((t or "").encode(), hashing.MARKS)[0]

    def copied(text):
        return any(len(w) and (s := decontamination.align(w, code(text))[0]) / len(w) >= decontamination.THRESHOLD and s >= min(decontamination.LEAST, len(w)) for w in (code(t) for _, t in items))

    left = {i: t for i, t in cut.items() if find(i) == i and not copied(t)}
    want = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame([(i, left[i], docs[i][3]) for i in left], "doc_id bigint, text string, source string")).collect() if r.taken}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 60 < len(want) < 190 and {r.doc_id: r.taken for r in found} == want
    assert all(r.text == left[r.doc_id] and r.n_chars == len(r.text) for r in found)
