import corpus_pipeline
from searchloom.llm.queries import BYTE_BPE
from tests.llm import test_decontaminate, test_mixing, test_quality, test_simhash, test_tokens
from tests.llm.samples import SCHEMA, frame

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_brute_force(spark, folder):
    """Each stage against brute force on what the one before it kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    data = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    found = {}
    for name, function in corpus_pipeline.STAGES:
        frame_ = spark.createDataFrame(data, SCHEMA)
        got = function(spark, frame_, folder)
        found[name] = got
        if name == "token output":
            break
        assert got.columns == COLUMNS
        rows = sorted((tuple(r) for r in got.collect()), key=repr)
        if name == "quality rules":
            want = [r for r in data if test_quality.brute(r[1])["kept"]]
        elif name == "near duplicates":
            want = [r for r, (i, _, c) in zip(data, test_simhash.brute_components(data), strict=True) if i == c]
        elif name == "decontamination":
            hit = {r[0] for r in test_decontaminate.brute(data, items) if r[-1]}
            want = [r for r in data if r[0] not in hit]
        else:
            taken = {r[0]: r[4] // r[1] for r in test_mixing.brute(data)}
            want = [r for r in data for _ in range(taken[r[0]])]
        assert rows == sorted(want, key=repr), name
        assert rows
        data = rows
    want, _ = test_tokens.expected(data)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found["token output"].collect())
    assert got == sorted((i, n, c) for i, _, n, c in want)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_stages_stand_edges(spark, folder):
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, frame(spark, []), folder).count() == 0
        function(spark, frame(spark), folder).count()
    assert BYTE_BPE
