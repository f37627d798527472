"""License scan with a positional index over rare template words; DataFrame functions only.

Templates are word sequences with a label and the key phrase that must be present. IDF is counted over all documents.
The index holds of every template the words of highest IDF and those of its key phrase, with their offsets; frequent
words, and words that no document has, are left out of it unless the key phrase needs them. A document's own license
words, of highest IDF first, are looked up: a template comes into question if its anchor, the word of highest IDF in
the key phrase, is among them, without which no start can count. Then the document's places of index words are shifted
by the offsets in the template; places that agree on the start are intersected, and their share of the template's
index words is the coverage. A start counts when the coverage reaches ``least`` and all words of the key phrase agree,
whichever of the other words are there. The base phrases are key phrase from end to end, so every place where their words
stand consecutively counts, overlapping ones included.

Documents without words or hits get zeros, nulls and empty labels. Null text counts as empty. Rows are told apart by
themselves, so a repeated or null doc_id is no problem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densegrid.llm.text import words
from densegrid.runtime import stage

# Fixed values: (phrase, label), found wherever the words stand consecutively.
BASE = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Fixed values: (template, key phrase in it, label), well-known sentences of public licenses.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted", "mit"),
    ("licensed under the apache license version 2 0", "apache license", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "binary forms", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mozilla public license", "mpl"),
    ("gnu lesser general public license", "lesser general public license", "lgpl"),
    ("gnu affero general public license", "affero general public license", "agpl"),
    ("this work is licensed under a creative commons attribution", "creative commons", "cc"),
    ("released into the public domain", "public domain", "public-domain"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "without fee", "isc"),
    ("spdx license identifier", "spdx license identifier", "spdx"),
]
LEAST_COVERAGE = 0.75
#: Words of highest IDF that a template has in the index.
RARE_WORDS = 4


def _postings(base: list, templates: list) -> tuple[list, list]:
    """Rows (template, label, is_base) and (template, offset, word, is_key)."""
    heads, places = [], []
    entries = [(p, p, label, True) for p, label in base] + [(*t, False) for t in templates]
    for number, (text, key, label, is_base) in enumerate(entries):
        body, part = text.split(), key.split()
        starts = [i for i in range(len(body)) if body[i: i + len(part)] == part]
        if not starts:
            raise ValueError(f"key phrase {key!r} is not in its template")
        heads.append((number, label, is_base))
        places += [(number, i, w, starts[0] <= i < starts[0] + len(part)) for i, w in enumerate(body)]
    return heads, places


def rare_index(docs: DataFrame, text: str, base: list, templates: list, rare_words: int) -> tuple[DataFrame, DataFrame]:
    """The index (template, label, is_base, offset, word, is_key, anchor, words, key_words) and (word, idf)."""
    spark = docs.sparkSession
    heads, places = _postings(base, templates)
    lexicon = sorted({p[2] for p in places})
    heads = spark.createDataFrame(heads, "template int, label string, is_base boolean")
    places = spark.createDataFrame(places, "template int, offset int, word string, is_key boolean")
    # Only the license words of a document leave the scan, each once, and are summed before they are shuffled.
    own = F.array_intersect(words(F.col(f"`{text}`")), F.array(*map(F.lit, lexicon)))
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), own)).alias("word")).groupBy("word").count()
    seen = stage(seen, "license-words")
    total = seen.filter("word = ''").select(F.col("count").alias("total"))
    idf = stage(seen.filter("word != ''").join(F.broadcast(total)).select("word", F.log((F.col("total") + 1) / F.col("count")).alias("idf")), "license-idf")
    by_idf = Window.partitionBy("template").orderBy(F.desc_nulls_last("idf"), "offset")
    by_key = Window.partitionBy("template").orderBy(F.desc("is_key"), F.desc_nulls_first("idf"), "offset")
    ranked = places.join(idf, "word", "left").withColumns({"rank": F.row_number().over(by_idf), "key_rank": F.row_number().over(by_key)})
    whole = Window.partitionBy("template")
    index = (
        ranked.filter(F.col("is_key") | (F.col("rank") <= rare_words) & F.col("idf").isNotNull())
        .withColumn("words", F.count(F.lit(1)).over(whole))
        .withColumn("key_words", F.count_if("is_key").over(whole))
        .withColumn("anchor", F.col("key_rank") == 1)
        .join(heads, "template")
        .drop("idf", "rank", "key_rank")
    )
    return stage(index, "license-index"), idf


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: list = BASE, templates: list = TEMPLATES,
         least: float = LEAST_COVERAGE, rare_words: int = RARE_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, rarest_words.

    ``score`` is the largest coverage of a counted start, 0 without one. ``rarest_words`` are the document's license
    words, of highest IDF first. The templates, and so the index, are a fixed small table.
    """
    index, idf = rare_index(docs, text, base, templates, rare_words)
    lexicon = [(r["word"], r["idf"]) for r in idf.orderBy(F.desc("idf"), "word").collect()]
    anchors = [r["word"] for r in index.filter("anchor").select("word").distinct().collect()]
    by_rarity = F.array(*[F.lit(w) for w, _ in lexicon]).cast("array<string>")
    anchor_words = F.array(*map(F.lit, anchors)).cast("array<string>")
    index = F.broadcast(index)

    # A row per document (place null), and for documents with an anchor one per place of an index word.
    nothing = F.array(F.lit(None).cast("string"))
    row = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), words(F.col(f"`{text}`")).alias("w"))
    placed = row.select(
        "row", "doc_id", F.size("w").cast("long").alias("n_words"), F.array_intersect(by_rarity, "w").alias("rarest_words"),
        F.when(F.arrays_overlap("w", anchor_words), F.concat(nothing, "w")).otherwise(nothing).alias("w"),
    ).select("row", "doc_id", "n_words", "rarest_words", F.posexplode("w").alias("pos", "word"))
    known = F.broadcast(index.select("word").distinct().withColumn("known", F.lit(True)))
    hits = placed.join(known, "word", "left").filter("known or pos = 0").select(
        "row", F.when(F.col("pos") > 0, F.col("pos") - 1).alias("pos"), "word",
        *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc_id", "n_words", "rarest_words")],
    )
    hits = stage(hits, "license-hits")

    shifted = hits.filter("pos is not null").select("row", "pos", "word").join(index, "word").withColumn("start", F.col("pos") - F.col("offset"))
    starts = shifted.groupBy("row", "template", "start").agg(
        F.count(F.lit(1)).alias("agree"), F.count_if("is_key").alias("keys"),
        F.first("words").alias("words"), F.first("key_words").alias("key_words"), F.first("label").alias("label"), F.first("is_base").alias("is_base"),
    )
    found = (
        starts.filter("start >= 0 and keys = key_words")
        .withColumn("coverage", F.col("agree") / F.col("words"))
        .filter(F.col("coverage") >= F.when(F.col("is_base"), 1.0).otherwise(least))
    )
    per_row = found.groupBy("row").agg(
        F.count_if("is_base").alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    return hits.filter("pos is null").select("row", "doc_id", "n_words", "rarest_words").join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "rarest_words",
    )
