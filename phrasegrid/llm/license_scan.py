"""Licence scan by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import whole

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Public licence notices and their labels.
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY SA 4.0",
    "cc-by-nc": "Licensed under CC BY NC 4.0",
}

#: Words in a k-gram of phrases and of notices; diagonals this far apart belong to one occurrence; share of a notice's k-grams.
PHRASE_GRAM, NOTICE_GRAM, GAP, COVERAGE = 2, 4, 8, 0.6


def words_of(text: Column | str) -> Column:
    """Lower-cased words. Only ASCII letters matter to the templates; the one other letter whose lower case is a lone ASCII
    letter, the Kelvin sign, is replaced by a non-ASCII letter first."""
    return F.regexp_extract_all(F.lower(F.replace(whole(text), F.lit("K"), F.lit("å"))), F.lit(WORD), F.lit(0))


def _pairs(xs: Column, step: int, join) -> Column:
    return F.zip_with(xs, F.slice(xs, F.lit(step + 1), F.greatest(F.size(xs), F.lit(1))), join)


def grams(words: Column) -> tuple[Column, Column]:
    """Rolling 64-bit hashes of two and of four words at every position; the last ones of a text lack words and match none."""
    two = _pairs(words, 1, lambda a, b: F.xxhash64(a, b))
    return two, _pairs(two, 2, lambda a, b: F.xxhash64(a, b))


def template_grams(spark: SparkSession) -> DataFrame:
    """Every k-gram of every template with its position and words: a few hundred rows, fixed by the tables above."""
    split = lambda s: re.findall(WORD, s.lower())
    rows = [(i, label, k, base, split(s)) for i, (s, label, k, base) in enumerate([(p, x, PHRASE_GRAM, True) for p, x in PHRASES.items()] + [(s, x, NOTICE_GRAM, False) for x, s in NOTICES.items()])]
    at = spark.createDataFrame([(i, label, k, base, len(w) - k + 1, w) for i, label, k, base, w in rows], "template int, label string, k int, base boolean, grams int, words array<string>")
    two, four = grams(F.col("words"))
    at = at.select("template", "label", "k", "base", "grams", "words", F.posexplode(F.when(F.col("k") == PHRASE_GRAM, two).otherwise(four)).alias("tpos", "th"))
    at = at.withColumn("gram", F.expr("slice(words, tpos + 1, k)")).drop("words")
    none = F.array().cast("array<string>")
    marker = spark.range(1).select(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("k"), F.lit(False).alias("base"), F.lit(1).alias("grams"), F.lit(0).alias("tpos"), _marker().alias("th"), none.alias("gram"))
    return at.filter("tpos < grams").unionByName(marker)


def _marker() -> Column:
    return F.xxhash64(F.lit("\x00"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_notices.

    All rolling word k-gram hashes of a text are joined to the template positions (a fixed table of a few hundred rows,
    which is broadcast); a document adds a marker to its k-grams so that it has a row without any hit. A hit counts if the
    text's words there are the template's, and votes for the diagonal word - template position. A phrase stands where one diagonal has all its k-grams. For notices, diagonals no
    more than GAP apart are merged, since words left out or added shift the rest. Then spans are verified: an occurrence
    starts at one of the merged diagonals and takes no more of them than the notice has k-grams, so a longer chain is several
    occurrences or none, and what counts is how many different template positions it has, repeats once. One that reaches
    COVERAGE of the notice's k-grams gives the label; occurrences that don't share diagonals are counted in ``n_notices``.
    ``score`` is the best coverage of any template, 1 for a phrase.

    Null text is empty: no words, no labels, score 0. A null id stays null. Repeated rows give a row each. Labels are
    distinct and sorted, so ties don't show. An empty table gives no rows; other columns aren't read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(text_col).alias("words"))
    two, four = grams(F.col("words"))
    rows = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words", F.concat(two, four, F.array(_marker())).alias("hashes"))
    # The words stay with their document: only a hit takes its few of them out.
    hits = rows.select("row", "doc_id", "n_words", "words", F.posexplode("hashes").alias("at", "h"))
    hits = hits.join(F.broadcast(template_grams(docs.sparkSession)), F.col("h") == F.col("th"))
    hits = hits.withColumn("word", (F.col("at") - F.when(F.col("k") == NOTICE_GRAM, F.col("n_words")).otherwise(0)).cast("int"))
    hits = hits.filter(F.slice("words", F.col("word") + 1, F.col("k")) == F.col("gram")).withColumn("diagonal", (F.col("word") - F.col("tpos")).cast("long"))
    what = ["row", "doc_id", "n_words", "template", "label", "base", "grams"]
    votes = hits.groupBy(*what, "diagonal").agg(F.collect_list("tpos").alias("places"))
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near) > F.when(F.col("base"), 0).otherwise(GAP)).cast("int"), F.lit(0))
    votes = votes.withColumn("new", new).withColumn("span", F.sum("new").over(near))
    # The frame is as long as the longest notice; each template takes its own length of it.
    ahead = Window.partitionBy("row", "template", "span").orderBy("diagonal").rangeBetween(0, max(len(re.findall(WORD, x)) for x in NOTICES.values()))
    votes = votes.withColumn("ahead", F.collect_list(F.struct("diagonal", "places")).over(ahead))
    own = F.filter("ahead", lambda x: x["diagonal"] - F.col("diagonal") <= F.when(F.col("base"), 0).otherwise(F.col("grams")))
    distinct = F.size(F.array_distinct(F.flatten(F.transform(own, lambda x: x["places"]))))
    votes = votes.withColumn("coverage", distinct / F.col("grams"))
    starts = F.array_sort(F.collect_list(F.when(F.col("coverage") >= COVERAGE, F.col("diagonal").cast("long"))))
    apart = lambda got, d: F.when((got["n"] == 0) | (d > got["last"] + F.col("grams")), F.struct((got["n"] + 1).alias("n"), d.alias("last"))).otherwise(got)
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("last"))
    spans = votes.groupBy(*what, "span").agg(F.max("coverage").alias("coverage"), F.min("diagonal").cast("long").alias("word"), starts.alias("starts"))
    spans = spans.withColumn("times", F.aggregate("starts", none, apart)["n"])
    place = F.col("base") & (F.col("coverage") >= 1)
    found = place | (~F.col("base") & (F.col("template") >= 0) & (F.col("coverage") >= COVERAGE))
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(place, 1)).cast("long").alias("n_base"),
        F.min(F.when(place, F.col("word"))).alias("first_word"),
        F.max(F.when(place, F.col("word"))).alias("last_word"),
        joined(place).alias("base_labels"),
        joined(found).alias("labels"),
        F.coalesce(F.max(F.when((F.col("template") >= 0) & (place | ~F.col("base")), F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.coalesce(F.sum(F.when(found & ~F.col("base"), F.col("times"))), F.lit(0)).cast("long").alias("n_notices"),
    ).drop("row")
