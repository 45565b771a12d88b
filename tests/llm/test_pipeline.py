import corpus_pipeline
from foretally.llm import toxicity
from test_bpe import brute as brute_tokens
from test_decontam import brute_tiles, kept
from test_pii import brute_base
from test_simhash import brute_components, brute_print

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "personal_data", "bpe"]

    def step(name, before):
        after = stages[name](spark, before, FOLDER)
        return after, {r.doc_id: r for r in after.collect()}

    start = {r.doc_id: r for r in docs.collect()}
    clean, rows = step("toxicity", docs)
    scores = {r.doc_id: r.score for r in toxicity.judged(docs, labels).collect()}
    assert clean.schema == docs.schema and rows == {d: r for d, r in start.items() if scores[d] < toxicity.REJECT}

    once, after = step("near_duplicates", clean)
    groups = brute_components({d: brute_print(r.text) for d, r in rows.items()})
    assert once.schema == docs.schema and after == {d: r for d, r in rows.items() if groups[d] == d}

    left, rows = step("decontamination", once)
    items = [kept(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = set()
    for d, r in after.items():
        words = kept(r.text)
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for item in items:
            if grams & {tuple(item[k : k + 5]) for k in range(len(item) - 4)} and brute_tiles(item, words) / len(item) >= 0.8:
                dirty.add(d)
    assert dirty and left.schema == docs.schema and rows == {d: r for d, r in after.items() if d not in dirty}

    hidden, after = step("personal_data", left)
    assert hidden.schema == docs.schema and set(after) == set(rows)
    for d, r in after.items():
        assert not brute_base(r.text) and r.n_chars == len(r.text)
        assert brute_base(rows[d].text) or r == rows[d] or "[" in r.text

    _, tokens = step("bpe", hidden)
    assert {d: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for d, r in tokens.items()} == {d: brute_tokens(r.text) for d, r in after.items()}

    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert whole == tokens


def test_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en", "s", 62), (1, text, "en", "s", 62), (2, text, None, None, None), (None, text, "en", "s", 62), (3, None, "en", None, 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    kept_ = stages["near_duplicates"](spark, docs, FOLDER).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept_) == sorted([("1", text), ("None", text), ("3", None)], key=str)
    for name in list(stages):
        frame = stages[name](spark, docs, FOLDER)
        assert frame.count() >= 3
        if name != "bpe":
            assert frame.columns == docs.columns
        assert stages[name](spark, docs.limit(0), FOLDER).collect() == []


def test_near_duplicates_are_dropped_by_row(spark):
    a, b = ("the old mill stands by a slow river near our town and its wheel turns", "stars over this quiet desert were bright when we left camp at dawn")
    c, d = ("quarterly figures show that sales of bicycles rose again in spring", "she baked nine loaves before anyone in that house had woken up")
    assert len({brute_print(t) for t in (a, b, c, d)}) == 4
    rows = [(1, a.upper()), (5, a), (5, b), (9, b.upper()), (6, c), (6, d), (7, d), (7, d), (8, d), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert left.schema == docs.schema
    expected = [(1, a.upper()), (5, b), (6, c), (6, d), (None, a), (None, a)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(expected, key=str)
