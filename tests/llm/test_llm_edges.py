"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

import random
import re

import numpy as np
import pytest

from densegrid.llm import exact_dedup, html_main, licenses, lm, mixing, near_dedup, quality, sentencepiece_codec, topk, warc
from densegrid.llm.queries import PIECES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def some_docs(spark):
    return make(spark, [
        (1, "Same TEXT", "en", "a", 9), (2, "same text", "en", "a", 9), (2, "same text", "en", "a", 9), (None, "same text", None, None, None),
        (3, None, "en", "b", 0), (4, "", None, None, None), (5, "É é", "fr", "b", 3), (6, "é É", "fr", "b", 3), (7, prose(1, 30_000), "en", "b", 1),
    ])


# Exact deduplication


def test_exact_marks(spark):
    found = exact_dedup.mark_copies(some_docs(spark)).collect()
    assert len(found) == 9
    by_id = {r.doc_id: r for r in found}
    assert (by_id[1].keep_id, by_id[1].group_size, by_id[1].kept) == (2, 4, False)
    assert (by_id[2].kept, by_id[None].kept) == (True, False)
    assert (by_id[3].keep_id, by_id[4].keep_id, by_id[4].group_size) == (4, 4, 2)
    assert by_id[5].group_size == by_id[6].group_size == 1


def test_exact_drop_keeps_one_and_all_columns(spark):
    docs = some_docs(spark).selectExpr("*", "doc_id as _row", "text as _bits", "doc_id as _may_repeat", "1 as text_sha256")
    found = exact_dedup.drop_copies(docs)
    assert found.columns == docs.columns
    assert sorted(r.doc_id for r in found.collect()) == [2, 4, 5, 6, 7]


def test_exact_full_filter_changes_nothing(spark):
    wide, narrow = (sorted(map(tuple, exact_dedup.mark_copies(some_docs(spark), filter_bits=b).collect()), key=repr) for b in (1 << 20, 8))
    assert wide == narrow


def test_exact_empty(spark):
    assert exact_dedup.mark_copies(make(spark, [])).count() == 0
    assert exact_dedup.drop_copies(make(spark, [])).count() == 0


# Near-duplicates


def near_docs(spark):
    base = prose(3, 300).split()
    edited = [" ".join(base[:k] + ["zzz"] + base[k + 1:]) for k in range(40, 280, 6)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate([" ".join(base), *edited])]
    return make(spark, rows + [(900, None, None, None, None), (901, "", None, None, None), (902, "one", None, None, None), (903, prose(8, 400), None, None, 1),
                               (904, prose(9, 25_000), None, None, 1), (904, prose(9, 25_000), None, None, 1), (None, prose(10, 50), None, None, 1)])


def test_near_classes(spark):
    found = near_dedup.classes(near_docs(spark)).collect()
    assert len(found) == near_docs(spark).count()
    group = [r for r in found if r.doc_id is not None and r.doc_id < 900]
    assert {r.class_id for r in group} == {0} and {r.class_size for r in group} == {41}
    rest = {r.doc_id: r for r in found}
    assert rest[900].class_id == rest[901].class_id == 900
    assert rest[902].class_size == rest[903].class_size == 1 and rest[904].class_size == 2
    assert rest[None].class_id is None and rest[None].kept


def test_near_drop(spark):
    docs = near_docs(spark).selectExpr("*", "doc_id as node", "1 as at", "2 as _doc")
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, i) for i in (0, 900, 902, 903, 904)] + [(True, None)]
    assert near_dedup.classes(make(spark, [])).count() == 0


def test_repeated_rows_with_hot_keys(skewed):
    rows = [(i, i if i < 50 else 7 if i < 150 else 1000 + i // 2) for i in range(200)]
    found = near_dedup._repeated(skewed.createDataFrame(rows, "row long, key long"), "key", len(rows)).collect()
    keys = [k for _, k in rows]
    assert sorted((r.row, r.key) for r in found) == [(i, k) for i, k in rows if keys.count(k) > 1]


@pytest.mark.parametrize("few", [0, 1000])
def test_repeated_rows_without_a_shuffle(skewed, monkeypatch, few):
    """A small set of keys is broadcast however large the table; with more, hot keys still stay in place."""
    monkeypatch.setattr(near_dedup, "FEW", few)
    skewed.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, i if i < 50 else 7 if i < 150 else 1000 + i // 2) for i in range(200)]
        found = near_dedup._repeated(skewed.createDataFrame(rows, "row long, key long"), "key", len(rows))
        keys = [k for _, k in rows]
        assert sorted((r.row, r.key) for r in found.collect()) == [(i, k) for i, k in rows if keys.count(k) > 1]
        assert ("SortMergeJoin" in found._jdf.queryExecution().toString()) == (few == 0)
    finally:
        skewed.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_of_two_end_with_their_leader(spark, monkeypatch):
    """Pairs of near misses that meet in buckets of two: aligned once, nothing is left open; texts move once."""
    staged = {}

    def seen(df, name):
        staged.setdefault(name, [df._jdf.queryExecution().executedPlan().toString()])
        out = near_dedup_stage(df, name)
        staged[name].append(out.count())
        return out

    near_dedup_stage = near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = []
        for i in range(30):
            base = prose(100 + i, 200).split()
            texts += [" ".join(base), " ".join("zzz" if k % 24 == 8 else w for k, w in enumerate(base))]
        found = near_dedup.classes(make(spark, [(i, t, None, None, 1) for i, t in enumerate(texts)])).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id: r.class_id for r in found} == {i: i for i in range(60)}
    assert staged["pairs"][1:] == [staged["pairs"][1]] and staged["pairs"][1] >= 25
    assert staged["contested"][1:] == [0]
    assert staged["texts"][0].count("Exchange hashpartitioning(node") == 2


def test_chain_of_links_is_one_class(spark):
    """No leader is similar to everything: every text is near its neighbours only."""
    base = prose(4, 400).split()
    texts = []
    for step in range(12):
        texts.append(" ".join(base))
        for k in range(step * 30, step * 30 + 30, 8):
            base[k] = f"new{k}"
    found = near_dedup.classes(make(spark, [(i, t, None, None, 1) for i, t in enumerate(texts)])).collect()
    grams = [[tuple(t.split()[i: i + 5]) for i in range(396)] for t in texts]
    assert all(near_dedup.ordered_similarity(a, b, 0.8) for a, b in zip(grams, grams[1:]))
    assert not near_dedup.ordered_similarity(grams[0], grams[-1], 0.8)
    assert {r.class_id for r in found} == {0}


def test_near_misses_of_one_text_are_hardly_aligned(spark, monkeypatch):
    """400 texts below 0.8 to their center and to one another, among 40 near copies: no pair of them is lost or aligned."""
    rng = random.Random(11)
    base = prose(5, 200).split()

    def changed(n):
        out = base[:]
        for place in rng.sample(range(0, 200, 6), n):
            out[place] = f"{rng.randrange(10**9)}"
        return " ".join(out)

    texts = [changed(2) for _ in range(40)] + [changed(rng.randrange(6, 9)) for _ in range(400)]
    # Two of the near misses are near copies of one another.
    texts.append(texts[100] + " end")
    pairs = []

    def counted(df, name):
        out = near_dedup_stage(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    near_dedup_stage = near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", counted)
    found = near_dedup.classes(make(spark, [(i, t, None, None, 1) for i, t in enumerate(texts)])).collect()
    grams = [[tuple(t.split()[i: i + 5]) for i in range(len(t.split()) - 4)] for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.ordered_similarity(grams[i], grams[j], 0.8):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert {r.doc_id: r.class_id for r in found} == {i: top(i) for i in range(len(texts))}
    assert len({r.class_id for r in found}) > 390
    # Round one aligns every leader with its buckets; after that hardly anything is left.
    assert pairs[0] < 24 * len(texts) and sum(pairs[1:]) < len(texts)


def test_short_texts_always_meet(spark):
    """4 against 5 shingles, 5 against 6, 8 against 10 and 9 against 9, all links."""
    rows = []
    for i in range(3000):
        ws = [f"{i}x{j}" for j in range(14)]
        pair = [(ws[:8], ws[:9]), (ws[1:9], ws[:9]), (ws[:9], ws[:10]), (ws[1:13], ws[:14]), (ws[:13], ws[1:14])][i % 5 if i >= 2000 else i % 2]
        rows += [(2 * i + k, " ".join(t), None, None, 1) for k, t in enumerate(pair)]
    found = near_dedup.classes(make(spark, rows)).collect()
    assert [r.doc_id for r in found if r.class_size != 2 or r.class_id != r.doc_id - r.doc_id % 2] == []


def test_short_keys_are_every_link():
    rng = random.Random(0)
    for _ in range(3000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 11))]
        b = [x for x in a if rng.random() > 0.1]
        if rng.random() < 0.5:
            b.insert(rng.randint(0, len(b)), rng.randint(0, 3))
        if b and len(b) <= near_dedup.SHORT and near_dedup.ordered_similarity(a, b, 0.8):
            assert set(near_dedup.short_keys(np.array(a, np.uint64), 0.8)) & set(near_dedup.short_keys(np.array(b, np.uint64), 0.8))


def test_alignment_is_the_plain_one():
    rng = random.Random(0)
    for _ in range(300):
        a = [rng.randint(0, 9) for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() > 0.08]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.randint(0, 9))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        plain = row[-1] / (len(a) + len(b) - row[-1]) if a or b else 1.0
        assert near_dedup.ordered_similarity(a, b, 0.8) == pytest.approx(plain if plain >= 0.8 else 0.0)


# SentencePiece


def test_codec_is_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = sentencepiece_codec.load_pieces(PIECES)
    codec, raw = sentencepiece_codec.Codec(pieces, "bpe"), sentencepiece_codec.raw_pieces(pieces)
    rng = random.Random(1)
    bits = ["a", "e", "the", "ing", " ", "  ", "    ", "\n", "\t", "é", "日", "😀", "▁", "1", "<s>", " " * 17, "\r", "\0", ",", "e.", "//", "don't", "ﬁ"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert codec.encode(text) == library.encode(text)
        assert sentencepiece_codec.decode_ids(codec.encode(text), raw) == text.replace("▁", " ")


def test_unigram_is_the_best_path():
    pieces = [("<unk>", 0.0, sentencepiece_codec.UNKNOWN)] + [
        (p, s, sentencepiece_codec.NORMAL) for p, s in [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -3.1), ("ba", -3.9), ("▁a", -3.2), ("aba", -5.0), ("bab", -5.2)]
    ]
    codec = sentencepiece_codec.Codec(pieces, "unigram")
    score = {p: s for p, s, _ in pieces}

    def best(text):
        if not text:
            return 0.0
        return max(score[text[:n]] + best(text[n:]) for n in range(1, 4) if text[:n] in score)

    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 12)))
        ids = codec.encode(text)
        assert "".join(pieces[i][0] for i in ids) == "▁" + text.replace(" ", "▁")
        assert sum(pieces[i][1] for i in ids) == pytest.approx(best("▁" + text.replace(" ", "▁")))


def test_codec_frames(spark):
    docs = some_docs(spark).selectExpr("*", "1 as row", "2 as ids")
    tokens = sentencepiece_codec.encode(docs, PIECES)
    assert tokens.columns == [*docs.columns, "token_ids"]
    back = {r.doc_id: r for r in sentencepiece_codec.decode(tokens, PIECES).collect()}
    assert len(back) == 8 and back[3].token_ids == [] and back[3].decoded == ""
    assert back[7].decoded == back[7].text and back[5].decoded == "É é"
    assert sentencepiece_codec.encode(make(spark, []), PIECES).count() == 0


# Main text


def test_extraction_on_new_layouts():
    """Held-out pages of the grammar: same blocks as the truth on nearly all."""
    trees, rng, right = html_main.train(), random.Random(99), 0
    for _ in range(150):
        nodes, y = html_main._labelled(html_main.training_page(rng))
        y[0] = 1
        kept = html_main.decode(nodes, html_main.predict(trees, html_main.node_features([nodes])))
        right += html_main.blocks(nodes, kept) == html_main.blocks(nodes, y > 0)
    assert right >= 140


def test_extraction_edges(spark):
    page = ("<body><nav><a href=x>Menu</a> <a href=y>Two</a></nav><article class=post><h1>A &amp; B</h1><p>First\n\t line, with <b>bold</b> text.<p>Open"
            "<script>x='<p>no</p>'</script><div class='ad'>Buy this now</div></article><footer>&copy; us</footer>")
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "no tags at all"), (5, "x", "<" * 2000 + "<p><!-- " * 50), (1, "u", page)]
    found = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 6
    texts = {r.page_id: r.text for r in found}
    assert texts[1] == "A & B\nFirst line, with bold text.\nOpen" and texts[2] == texts[3] == ""
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def page_text(inside, before="<html><head><title>T</title></head><body>", after="</body></html>"):
    filler = "<p>" + "Plain words of the article, and some more of them. " * 4 + "</p>"
    return html_main.main_text(f"{before}<article><h1>Head</h1>{filler}{inside}{filler}</article>{after}", html_main.train()).split("\n")[2:-1]


@pytest.mark.parametrize("mark", ["<![x b]>", "<![&nbsp;]>", "<![if !IE]>", "<![endif]>", "<![>", "<![CDATA[ b >", "<![if x>"])
def test_extraction_goes_on_after_a_marked_section(mark):
    """Up to the next ">" it is a comment; text after it stays, also if a later ``]]>`` or ``]>`` could end it."""
    assert page_text(f"<p>One.</p>{mark}<p>Two.</p><p>Three ]]&gt; a]> four.</p>") == ["One.", "Two.", "Three ]]> a]> four."]


def test_extraction_of_open_marked_sections():
    assert page_text("<p>One <![ b</p><p>Two.</p>") == ["One", "Two."]
    assert page_text("<p>One <svg><text><![CDATA[</svg> x > y]]></text></svg></p><p>Two.</p>") == ["One", "Two."]
    assert "".join(t for n in html_main.parse("<p>One</p><p>Two <![ three") for _, t in n.parts) == "OneTwo <![ three"


@pytest.mark.parametrize("head", [
    "<html><head><title>T</title>", "<head><meta charset=utf-8><link rel=x><style>p{}</style><script>'<p>'</script><noscript>no</noscript><template>t</template>", "<head>\n",
])
def test_extraction_without_end_of_head(head):
    assert page_text("<p>One.</p>", before=head, after="") == ["One."]
    assert page_text("<p>One.</p>", before=f"{head}</head><body><head>", after="") == ["One."]
    for start in ("Bare text, ", "<b>Bold</b> text, ", "<br>text, "):
        assert "text, " in html_main.main_text(f"{head}{start}" + "and some more of it, as it goes. " * 9, html_main.train())


def test_extraction_of_formulas_and_hidden_inline_elements():
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation>E=c^2</annotation></semantics></math>"
    assert page_text(f"<p>Then {formula} holds.</p><p>Two.</p>") == ["Then E=c2 holds.", "Two."]
    assert page_text("<p>As <math><mtext><![CDATA[x < y > z]]></mtext></math> says.</p>") == ["As x < y > z says."]
    hidden = ["<script>x()</script>", "<svg><path d=z /></svg>", "<button>Ok</button>", "<meta itemprop=x content=y>", "<select><option>1<option>2</select>", "<style>p{}</style><svg></svg>"]
    for inside in hidden:
        assert page_text(f"<p>One {inside} goes on {inside}here.</p><p>Two.</p>") == ["One goes on here.", "Two."]
    assert page_text("<div>One<hr>two<div>three</div>four</div>") == ["One", "two", "three", "four"]

@pytest.mark.parametrize("inside, wanted", [
    ("<p>One <noscript><div>Enable it</div></noscript> goes on.</p>", ["One goes on."]),
    ("<p>One <video><p>Your browser cannot play this</p></video> goes on.</p>", ["One goes on."]),
    ("<p>One <object><p>No plugin</p></object> goes on.</p>", ["One goes on."]),
    ("<ul><li>One <noscript><li>no</noscript>goes on.</li></ul>", ["One goes on."]),
    ("<p>One.</p><!--><p>Two.</p><!-- x --><p>Three.</p>", ["One.", "Two.", "Three."]),
    ("<p>One.</p><!---><p>Two.</p><!----><p>Three.</p>", ["One.", "Two.", "Three."]),
    ("<p>One.</p><!-- note --!><p>Two.</p><!-- <p>no</p> -- > no --><p>Three.</p>", ["One.", "Two.", "Three."]),
    ("<p>One.</p><a title='x > y' href=\"a>b\">Two</a> <p title=a=b/c>Three.</p></ ><?x y?><!y>", ["One.", "Two", "Three."]),
    ("<p>One.</p><script>'<p>no</p>' </scripts> </script x><p>Two.</p><iframe><p>no</iframe><p>a < b &lt; c <3</p>", ["One.", "Two.", "a < b < c <3"]),
])
def test_extraction_reads_markup_as_browsers_do(inside, wanted):
    assert page_text(inside) == wanted


@pytest.mark.parametrize("end", ["<!-- open > b", '<a href="foo<p>y', "<a title='x", "<!-- <p>no</p>", "<p", "<a b=", "</p ", "<script>no", "<!x", ""])
def test_extraction_of_pages_that_end_inside_markup(end):
    assert page_text(f"<p>One.</p><p>Two.</p>{'<p>Last one, with some more words of it in a row.</p>' * 3}", after=f"</article>{end}")[:2] == ["One.", "Two."]
    assert [t for n in html_main.parse(f"<p>a</p>{end}") if not n.hidden for _, t in n.parts] == ["a"]


@pytest.mark.parametrize("piece", ["<ul><li>", "<div></span></i></x>", "<a ", "<p><b", "<![ ", "</ ", "<!-- ", "<video><p>", "<a b='", "<svg><![CDATA[", "<table><tr><td>x</p>", "< <"])
def test_extraction_of_a_page_of_a_megabyte_is_linear(piece):
    import time

    start = time.time()
    html_main.parse(piece * (1_000_000 // len(piece)))
    assert time.time() - start < 20


# Quality


def test_quality(spark):
    rng = random.Random(5)
    rows = [(i, prose(i, 80) if i % 3 else " ".join(["spam!!"] * 60), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 100) for i in range(300)]
    docs = make(spark, rows + [(1000, None, None, None, None), (1001, "", "en", "a", 0), (None, prose(7, 90), "en", "a", 5), (7, prose(7, 80), "en", "a", 5)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(1, 0), (1, 1), (None, 1), (9, None)], "doc_id long, quality int")
    table = quality.features(docs)
    model = quality.fit(table, labels)
    found = quality.score(table, model).collect()
    assert len(found) == docs.count()
    good = {r.doc_id: r.quality >= 0.5 for r in found if r.doc_id is not None and r.doc_id < 300}
    assert sum(good[i] == (i % 3 > 0) for i in range(300)) >= 297
    clash = docs.selectExpr("*", "1 as m", "2 as x", "3 as _doc")
    kept = quality.keep_good(clash, model)
    assert kept.columns == clash.columns and 195 <= kept.count() <= 206


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = some_docs(spark)
    table = quality.features(docs)
    assert quality.fit(table, none) is None
    assert {r.quality for r in quality.score(table, None).collect()} == {None}
    assert quality.keep_good(docs, None).count() == docs.count()
    assert quality.features(make(spark, [])).count() == 0


# Licenses


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    rows = [
        (1, "CC-BY cc by; General Public\nLicense. GNU general public license cc by", None, None, 1), (2, None, None, None, None), (3, "", None, None, 0),
        (4, f"x {mit} y", None, None, 1), (4, "all rights reserved", None, None, 1), (4, "all rights reserved", None, None, 1),
        (None, "rights all reserved", None, None, 1), (6, prose(1, 20_000) + " all rights reserved", None, None, 1), (7, "all all rights reserved reserved", None, None, 1),
    ]
    found = licenses.scan(make(spark, rows).selectExpr("*", "1 as row", "2 as pos")).collect()
    assert len(found) == 9
    by_id = {r.doc_id: r for r in found}
    assert (by_id[1].n_base, by_id[1].first_word, by_id[1].last_word, by_id[1].base_labels) == (5, 0, 11, "cc-by,gpl")
    assert (by_id[2].n_words, by_id[2].n_base, by_id[2].first_word, by_id[2].labels, by_id[2].score) == (0, 0, None, "", 0.0)
    assert sorted((r.base_labels, r.labels) for r in found if r.doc_id == 4) == [("", "mit"), ("reserved", "reserved"), ("reserved", "reserved")]
    assert by_id[None].n_base == 0 and by_id[6].first_word == 20_000 and by_id[7].first_word == 1
    assert licenses.scan(make(spark, [])).count() == 0


@pytest.mark.parametrize("whole", [0, 1])
def test_licenses_without_the_rarest_word(spark, whole):
    """The rarest word of the template is altered, or is in no document at all."""
    mpl = "this source code form is subject to the terms of the mozilla public license"
    rows = [(i, mpl.replace("subject", "liable"), None, None, 1) for i in range(3)] + [(3 + i, mpl, None, None, 1) for i in range(whole)]
    rows += [(9, mpl.replace("mozilla", "modern"), None, None, 1), (10, "subject to mozilla public license terms", None, None, 1)][: 2 * whole]
    found = {r.doc_id: (r.labels, round(r.score, 6)) for r in licenses.scan(make(spark, rows)).collect()}
    altered = round(6 / 7, 6) if whole else 1.0
    assert found == {i: ("mpl", altered) for i in range(3)} | ({3: ("mpl", 1.0), 9: ("", 0.0), 10: ("", 0.0)} if whole else {})


# Search


def test_topk_is_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=9)], 0) for i in range(230)]
    rows += [(300 + i, rows[5][1], 0) for i in range(25)]  # ties
    rows += [(400, None, 0), (401, [1.0, None] * 4, 0), (402, [float("nan")] * 9, 0), (403, [float("inf")] * 9, 0), (404, [], 0), (405, [2.0, 3.0], 0), (None, [1.0] * 9, 0), (7, rows[7][1], 0)]
    vectors = topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = topk.top_k(vectors, vectors.filter("vec_id % 10 = 0"), k=10, lists=4, block=7).collect()
    whole = [(r.vec_id, list(r.v) + [0] * (9 - len(r.v))) for r in vectors.collect()]
    assert len(whole) == 257
    wanted = set()
    for q, x in whole:
        if q % 10 == 0:
            best = sorted(((-sum(a * b for a, b in zip(x, y)), v) for v, y in whole if v != q))[:10]
            wanted |= {(q, i + 1, v, -s) for i, (s, v) in enumerate(best)}
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)


def test_topk_few_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    two = topk.quantize(spark.createDataFrame([(0, [1.0]), (1, [-2.0])], schema))
    assert [tuple(r) for r in topk.top_k(two, two.filter("vec_id = 0")).collect()] == [(0, 1, 1, -2048 * 1024)]
    none = topk.quantize(spark.createDataFrame([], schema))
    assert topk.top_k(none, none).count() == 0


@pytest.mark.parametrize("size", [1e6, 1e9, 1e13, 1e300])
@pytest.mark.parametrize("block", [3, 1000])
def test_topk_with_large_components(spark, size, block):
    """Components whose products doubles, or 64 bits, do not hold; the order is that of the true scores."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5) * (size if i % 3 == 0 else 1)], "x") for i in range(60)]
    base = [size, -size, size, 1.0, 2.0]
    rows += [(100 + i, base[:3] + [1.0 + i / 1024, 2.0 - i / 2048], "x") for i in range(30)]  # equal but for the last digits
    vectors = topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string"))
    found = topk.top_k(vectors, vectors.filter("vec_id % 10 = 0"), k=10, lists=3, block=block).collect()
    whole = [(r.vec_id, r.v) for r in vectors.collect()]
    assert len(whole) == 90
    wanted = set()
    for q, x in whole:
        if q % 10 == 0:
            best = sorted(((-sum(a * b for a, b in zip(x, y)), v) for v, y in whole if v != q))[:10]
            wanted |= {(q, i + 1, v, max(-(1 << 63), min((1 << 63) - 1, -s))) for i, (s, v) in enumerate(best)}
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)


# Mixing


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randint(1, 60)), "en", rng.choice(["a", "b", "c", None]), 1) for i in range(500)]
    rows += [(600, None, "en", "a", 1), (601, "", "en", "only empty", 1), (7, "again again", "en", "a", 1), (7, "again again", "en", "a", 1), (None, "no id", "en", "b", 1)]
    docs = make(spark, rows).selectExpr("*", "1 as row", "2 as copies", "3 as _doc")
    found = mixing.taken(docs).collect()
    assert len(found) == 505
    assert {(r.target, r.taken) for r in found if r.doc_id == 601} == {(0.0, 0)}
    assert all(r.taken in (0, r.size, 2 * r.size) for r in found)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.select("text").collect()) == sum(r.taken for r in found)
    assert mixing.taken(make(spark, [])).count() == 0


def test_chunked_flights_keep_the_totals(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(-9, 9), i % 2, rng.randint(1, 900), 0.37 if i % 2 else 0.5) for i in range(3000)]
    frame = spark.createDataFrame(rows, "row long, tag long, group long, size long, p double").selectExpr("row", "xxhash64(tag, row) as tag", "group", "size", "p")
    found = {r.row: r.p for r in mixing.sample_copies(frame, chunk=100).collect()}
    assert len(found) == 3000 and set(found.values()) <= {0.0, 1.0}
    for g in (0, 1):
        mine = [r for r in rows if r[2] == g]
        assert abs(sum((found[r[0]] - r[4]) * r[3] for r in mine)) <= 100
        assert abs(sum(found[r[0]] - r[4] for r in mine)) <= 6


# Archives


def test_warc(spark):
    long, other = "<p>" + "x" * 1500, "é" * 700
    rows = [(1, "http://a/ b", long), (9, "http://b\r\nX: y", long), (4, None, long), (5, "u", None), (6, "u", ""), (7, "ü", "short"), (8, "u", "short"),
            (9, "again", long), (None, "n", long), (11, "a", other), (12, "b", other), (13, "c", "\r\n\r\nWARC/1.1" + "y" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as size")
    index = warc.write_archives(pages)
    found = warc.read_records(index).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found}
    assert (by_id[1].record_type, by_id[1].refers_to, by_id[4].refers_to, by_id[11].refers_to) == ("revisit", 9, 9, 12)
    assert {r.record_type for r in found if r.page_id in (5, 6, 7, 8, 9, 12, 13, None)} == {"response"}
    assert by_id[5].payload_bytes == 0 and by_id[1].payload_bytes == 1503 and by_id[11].payload_bytes == 1400
    assert bytes(by_id[13].payload).decode() == rows[-1][2] and re.fullmatch("[0-9a-f]{40}", by_id[1].payload_digest)
    some = warc.read_records(index.filter("page_id in (7, 12)"), gap=0, most=10).collect()
    assert {bytes(r.payload).decode() for r in some} == {"short", other}
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


# Language model


def test_scores_of_both_ways_agree(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "D", "é", "x1"]) for _ in range(rng.randint(0, 30))), "en", "a", 1) for i in range(60)]
    docs = make(spark, rows + [(100, None, None, None, None), (101, "one", None, None, 1), (101, "one", None, None, 1), (None, "a b", None, None, 1), (102, prose(1, 9000), None, None, 1)])
    plain = lm.score(docs, *lm.count_tables(docs)).collect()
    for options in ({}, {"frequent_words": 1, "frequent_bigrams": 1, "part_grams": 500}, {"frequent_words": 8, "frequent_bigrams": 20}):
        found = lm.score_corpus(docs, **options).collect()
        assert sorted(((r.doc_id or -1, r.n_words, round(r.score, 6)) for r in found)) == sorted(((r.doc_id or -1, r.n_words, round(r.score, 6)) for r in plain))
    assert lm.score_corpus(make(spark, [])).count() == 0


def test_backoff(spark):
    import math

    tables = lm.count_tables(make(spark, [(1, "a b a b c", None, None, 1)]))
    found = lm.score(make(spark, [(1, "b b c zz", None, None, 1)]), *tables, alpha=0.4).first()
    assert found.score == pytest.approx(math.log(2 / 5) + math.log(0.4 * 2 / 5) + math.log(1 / 2) + math.log(0.4 * 1 / 5))
