"""The queries over whole tables against their SQL, and those without SQL against brute force."""

import collections
import re

import pytest
from compare import DATA, database, duck_rows, spark_rows

from densegrid.llm import near_dedup
from densegrid.llm.oracles import ORACLES
from densegrid.llm.queries import QUERIES

SF = f"{DATA}/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_with_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    wanted_columns, wanted = duck_rows(database("sf0.01"), ORACLES[name])
    assert columns == wanted_columns
    assert rows == wanted


def test_op6_with_altered_notices(spark, tmp_path):
    """Notices with a rare word altered, in all documents or in some: the operator and its SQL agree."""
    import duckdb

    from densegrid.llm import licenses

    bodies = [t[0] for t in licenses.TEMPLATES]
    texts = [b.replace("subject", "liable") for b in bodies] * 3 + [" ".join(b.split()[:-1]) for b in bodies] + bodies[:1] + [None, "", "cc by, All rights reserved"]
    rows = [(i, t if t is None else f"intro {t} outro", "en", "a", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns, found = spark_rows(QUERIES["op6_license_scan"](spark, str(tmp_path)))
    wanted_columns, wanted = duck_rows(con, ORACLES["op6_license_scan"])
    assert (columns, found) == (wanted_columns, wanted)
    assert any(0 < r[columns.index("score")] < 1 for r in found)


def test_op1_is_the_library(spark, docs):
    import sentencepiece

    from densegrid.llm.queries import PIECES

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {r.doc_id: r for r in QUERIES["op1_sentencepiece"](spark, SF).collect()}
    assert len(found) == len(docs)
    for d in docs:
        assert found[d.doc_id].token_ids == library.encode(d.text)
        assert found[d.doc_id].round_trip
        assert found[d.doc_id].n_tokens == len(found[d.doc_id].token_ids)


def brute_classes(texts, k=5, least=0.8):
    """Smallest id per class, from all pairs of distinct word sequences."""
    by_words = collections.defaultdict(list)
    for doc_id, text in texts:
        by_words[tuple(WORD.findall(lower_az(text)))].append(doc_id)
    words = list(by_words)
    grams = [[w[i: i + k] for i in range(max(1, len(w) - k + 1))] if w else [] for w in words]
    sets = [set(g) for g in grams]
    root = list(range(len(words)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(words)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.5 * max(len(sets[i]), len(sets[j])) > 0 and near_dedup.ordered_similarity(grams[i], grams[j], least):
                root[find(i)] = find(j)
    classes = collections.defaultdict(list)
    for i, w in enumerate(words):
        classes[find(i)] += by_words[w]
    return {d: min(c) for c in classes.values() for d in c}


def test_op2_is_brute_force(spark, docs):
    wanted = brute_classes([(d.doc_id, d.text) for d in docs])
    found = QUERIES["op2_order_minhash"](spark, SF).collect()
    assert {r.doc_id: r.class_id for r in found} == wanted
    sizes = collections.Counter(wanted.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in found)


def test_op3_finds_every_article(spark):
    import html

    found = {r.page_id: r for r in QUERIES["op3_html_extraction"](spark, SF).collect()}
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = page.html[page.html.index("<article>"): page.html.index("</article>")]
        parts = [html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))) for x in re.split("</?(?:p|h1|article)>", article)]
        text = "\n".join(" ".join(p.split()) for p in parts if p.strip())
        assert found[page.page_id].text == text
        assert found[page.page_id].n_chars == len(text)


def test_op5_agrees_with_the_labels(spark, docs):
    found = {r.doc_id: r for r in QUERIES["op5_quality"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = sum(found[r.doc_id].kept == (r.quality == 1) for r in labels)
    assert len(found) == len(docs)
    assert right >= 0.98 * len(labels)


def brute_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (left - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        new = {s for s in rest if level * weight[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= new


def test_op8_meets_its_targets(spark, docs):
    first, second = ({r.doc_id: r for r in QUERIES["op8_mixing"](spark, SF).collect()} for _ in range(2))
    assert first == second
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for d in docs:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", d.text))
        assert first[d.doc_id].size == size
        assert 0 <= first[d.doc_id].taken <= 2 * size
        sizes[d.source] += size
        taken[d.source] += first[d.doc_id].taken
        largest[d.source] = max(largest[d.source], size)
    targets = brute_targets(sizes)
    for s in sizes:
        assert all(abs(first[d.doc_id].target - targets[s]) < 1e-6 and first[d.doc_id].source_size == sizes[s] for d in docs if d.source == s)
        assert abs(taken[s] - targets[s]) <= 0.5 * largest[s]
