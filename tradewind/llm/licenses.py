"""License scans with a positional index of rare licence words.

Templates are licence lines, and paragraphs of whole licences or of their notices, so that a file that leaves one out or
puts its own words between them is still found by the others. The document frequency of every template word is counted over the
corpus; a template is looked up by the rarest word of its key, its *anchor*. An anchor found in a file gives the relative
position at which the template would have to lie; the postings of all template words in the file are
intersected at that position, and the template holds if its mandatory key phrase stands there whole and
enough of its words do. A phrase whose words must all stand there is a template that is all key.

Only DataFrame functions are used. Files are tokenised once; word positions are kept only of files
that hold all key words of a template, as no other can match. The template index is a fixed small table and is broadcast.

Defined results: NULL and empty texts have no words and no label; repeated rows are scanned each and
count as files; a file without any match has score 0 and empty labels; an empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.session import materialize

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_SHARE = 0.6


class Template(NamedTuple):
    label: str
    text: str
    key: str
    base: bool = False


# The phrases that must be found, and licence lines with the phrase each must hold.
TEMPLATES = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
    Template("mit-text", "released under the mit license", "mit license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("lgpl", "gnu lesser general public license version", "lesser general public license"),
    Template("agpl", "gnu affero general public license version", "affero general public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("creative-commons", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("bsd", "licensed under the bsd 3 clause license", "bsd 3 clause"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    Template("isc", "released under the isc license", "isc license"),
    Template("mit", "mit licence", "mit licence"),
    Template("apache-2.0", "apache license v2 0", "apache license v2 0"),
    Template("mit-text", "spdx license identifier mit", "spdx license identifier mit"),
    Template("apache-2.0", "spdx license identifier apache 2 0", "spdx license identifier apache 2 0"),
    Template("gpl-2.0", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0"),
    Template("gpl-3.0", "spdx license identifier gpl 3 0", "spdx license identifier gpl 3 0"),
    Template("bsd", "spdx license identifier bsd", "spdx license identifier bsd"),
    Template("mpl-2.0", "spdx license identifier mpl 2 0", "spdx license identifier mpl 2 0"),
    Template("isc", "spdx license identifier isc", "spdx license identifier isc"),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "bsd",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
        "endorse or promote products derived from this software",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        "for any purpose with or without fee is hereby granted",
    ),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http "
        "www apache org licenses license 2 0",
        "apache org licenses license 2 0",
    ),
    Template(
        "gpl-2.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 2 of the license or at your option any later version",
        "either version 2 of the license",
    ),
    Template(
        "gpl-3.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version",
        "either version 3 of the license",
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license v 2 0",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "free and unencumbered software",
    ),
)


def _words(text):
    return F.regexp_extract_all(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD_PATTERN), F.lit(0)
    )


def _postings(templates) -> list[tuple]:
    """(template, word, position, words of the template, words of its key, whether in the key)."""
    rows = []
    for number, t in enumerate(templates):
        words, key = t.text.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows += [(number, w, i, len(words), len(key), at <= i < at + len(key)) for i, w in enumerate(words)]
    return rows


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per file: words, places of the base phrases, labels and the best share of a template found."""
    spark = docs.sparkSession
    index = _postings(templates)
    vocabulary = sorted({row[1] for row in index})
    words = F.coalesce(_words(docs[text_col]), F.array().cast("array<string>"))
    given = docs.select(docs[id_col].alias("id"), words.alias("words"))
    present = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), "words")
    keys = sorted({tuple(sorted(set(t.key.split()))) for t in templates})
    possible = F.exists(
        F.array(*[F.array(*[F.lit(w) for w in key]) for key in keys]), lambda key: F.size(F.array_except(key, "present")) == 0
    )
    files = materialize(
        given.select("id", "words", present.alias("present")).select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.size("words").cast("long").alias("n_words"),
            "present",
            F.when(possible, F.col("words")).alias("words"),
        ),
        "files",
    )
    # One row per template word comes back.
    n_files = files.count()
    held = {r["word"]: r["count"] for r in files.select(F.explode("present").alias("word")).groupBy("word").count().collect()}
    idf = {w: math.log((n_files + 1) / (held.get(w, 0) + 1)) for w in vocabulary}
    anchors = [max(t.key.split(), key=lambda w: (idf[w], w)) for t in templates]
    postings = spark.createDataFrame(
        [(*row, row[5] and row[1] == anchors[row[0]]) for row in index],
        "template int, word string, position int, length int, key_length int, in_key boolean, anchor boolean",
    )
    labels = F.array(*[F.lit(t.label) for t in templates])
    base = F.array(*[F.lit(t.base) for t in templates])

    hits = files.filter("words IS NOT NULL").select("row", F.posexplode("words").alias("at", "word"))
    found = hits.join(F.broadcast(postings), "word").withColumn("offset", F.col("at") - F.col("position"))
    anchored = found.filter("anchor").select("row", "template", "offset").distinct()
    placed = (
        found.join(anchored, ["row", "template", "offset"])
        .groupBy("row", "template", "offset", "length", "key_length")
        .agg(F.count(F.lit(1)).alias("matched"), F.count(F.when(F.col("in_key"), 1)).alias("in_key"))
        .filter(F.col("in_key") == F.col("key_length"))
        .select(
            "row",
            "offset",
            (F.col("matched") / F.col("length")).alias("share"),
            F.element_at(labels, F.col("template") + 1).alias("label"),
            F.element_at(base, F.col("template") + 1).alias("base"),
        )
        .filter(F.col("share") >= LEAST_SHARE)
    )
    in_base = lambda c: F.when(F.col("base"), c)
    per_file = placed.groupBy("row").agg(
        F.count(in_base(F.lit(1))).alias("n_base"),
        F.min(in_base(F.col("offset"))).cast("long").alias("first_word"),
        F.max(in_base(F.col("offset"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(in_base(F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    return files.select("row", "id", "n_words").join(per_file, "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
