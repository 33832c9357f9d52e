"""License scans by voting on offset diagonals of word k-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.words import ALNUM, signed, steps, words_of

#: The base phrases and their labels.
BASE_PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]

#: Notices and texts of well-known licenses, matched in whole or in large part.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

#: Pairs of words that make another license of a text that else is like a template.
DECISIVE = [
    "by nc", "by nd", "by sa", "nc nd", "nc sa",
    "attribution noncommercial", "attribution non", "attribution noderivatives", "attribution noderivs", "attribution no", "attribution sharealike", "attribution share",
    "noncommercial noderivatives", "noncommercial noderivs", "noncommercial no", "noncommercial sharealike", "noncommercial share",
    "gnu lesser", "gnu library", "gnu affero",
]

#: Words of a k-gram, and the bits of the bounded mask that k-grams are tested against before the join.
K, MASK_BITS = 2, 1 << 20


def _template_grams(templates: list[tuple[str, str]], base: int) -> list[tuple]:
    """(template, label, base, number of k-grams, of them decisive, position, hash, part): part is 1 for a decisive k-gram, 0 for another, -1 for one that speaks against a template, which has its first word only."""
    decisive = [words_of(t, ALNUM) for t in DECISIVE]
    keys = {int(d.grams(K)[2][0]) for d in decisive}
    out = []
    for t, (label, text) in enumerate(templates):
        words = words_of(text, ALNUM)
        _, pos, key = words.grams(K)
        own = [t >= base and int(h) in keys for h in key]
        same = (t, label, t < base, len(key), sum(own))
        out += [(*same, int(p), int(h), int(o)) for p, h, o in zip(pos, signed(key), own)]
        for d in decisive if t >= base else ():
            gram = d.grams(K)[2]
            if gram[0] not in key:
                out += [(*same, int(p), int(signed(gram)[0]), -1) for p in np.flatnonzero(words.key == d.key[0])]
    return out


def license_scan(
    df: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    base: list[tuple[str, str]] = BASE_PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    slack: int = 3,
    coverage: float = 0.75,
) -> DataFrame:
    """License mentions of each row of df: id, n_words, spans and what they amount to.

    Words are runs of ASCII letters and digits and of non-ASCII characters,
    A-Z lower-cased. Every rolling 2-gram of every whole text is hashed and
    joined with the 2-grams of base phrases (2 words or more) and templates.
    Matches vote for a diagonal: their place in the text less that in the
    template. A base phrase needs all its votes on one diagonal, which is to
    say all its words in a row, each place by itself. A template's diagonals
    at most `slack` apart merge into one span (words put in or left out);
    it is verified by the distinct template places that it covers, at least
    `coverage` of them, and by decisive words, those that make another
    license of a text, as "NC" behind "BY": all of its own are there, and none
    that it lacks, as these vote against its diagonal. So a variant never gets
    the label of a laxer or a stricter one.

    Result: id, n_words, n_base (places of base phrases), first_word and
    last_word (their smallest and largest start, else null), base_labels and
    labels (distinct, sorted, comma-joined, empty without any), score (1 with
    a base phrase, else the largest coverage of a verified span, else 0) and
    spans, an array of (start, end, label, base, coverage) in words.

    A null or empty text has no words and no spans. One row comes out for
    each row that goes in, so repeated ids and rows stay apart. Extra columns
    are ignored, an empty table gives an empty result.

    Hashes are first held against a mask of MASK_BITS bits, which no match
    fails; what passes is joined by Spark. The templates are a constant list,
    so broadcasting them is bounded. Only matches and one row for each
    document are shuffled, and nothing gathers texts.
    """
    grams = _template_grams([*base, *templates], len(base))
    known = np.zeros(MASK_BITS, bool)
    known[[g[6] % MASK_BITS for g in grams]] = True
    kind = df.schema[id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        done = 0
        for batch in batches:
            ids = batch.column(0)
            for row, words in steps(batch.column(1), ALNUM):
                found = [tuple(x[hit] for x in run) for run in words.gram_runs(K) if len(hit := np.flatnonzero(known[(run[2] % np.uint64(MASK_BITS)).astype(np.int64)]))]
                doc, pos, key = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)), *found))
                n = len(words)
                count = np.diff(words.first)
                # a row of its own for every document, then its possible matches
                at = np.concatenate([np.arange(n), doc])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part + done + row + at),
                        ids.take(pa.array(row + at)),
                        pa.array(np.concatenate([count, np.full(len(doc), -1)]), mask=np.arange(len(at)) >= n),
                        pa.array(np.concatenate([np.zeros(n, np.int64), pos]), mask=np.arange(len(at)) < n),
                        pa.array(np.concatenate([np.zeros(n, np.int64), signed(key)]), mask=np.arange(len(at)) < n),
                    ],
                    ["row", "id", "n_words", "pos", "hash"],
                )
            done += len(batch)

    spark = df.sparkSession
    table = spark.createDataFrame(grams, "template int, label string, base boolean, n int, decisive int, at int, hash long, part int")
    found = df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(scan, f"row long, id {kind}, n_words long, pos long, hash long")
    votes = found.join(F.broadcast(table), "hash", "left").filter(F.col("template").isNotNull() | F.col("n_words").isNotNull())
    diagonal = (F.col("pos") - F.col("at")).alias("diagonal")
    by_diagonal = (
        votes.groupBy("row", "id", "template", "label", "base", "n", "decisive", diagonal)
        .agg(F.max("n_words").alias("n_words"), *(F.collect_set(F.when(keep, F.col("at"))).alias(c) for c, keep in (("places", F.col("part") >= 0), ("musts", F.col("part") == 1), ("against", F.col("part") < 0))))
    )  # at most n places
    # neighbouring diagonals of a template are one span; those of a base phrase stay apart
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    opens = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True))
    spans = (
        by_diagonal.withColumn("span", F.sum(F.coalesce(opens, F.lit(True)).cast("int")).over(order))
        .groupBy("row", "id", "template", "label", "base", "n", "decisive", "span")
        .agg(
            F.max("n_words").alias("n_words"),
            F.min("diagonal").alias("from"),
            F.max("diagonal").alias("to"),
            *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("places", "musts", "against")),
        )
    )
    share = F.size("places") / F.col("n")
    verified = F.when(F.when(F.col("base"), share == 1).otherwise((share >= coverage) & (F.size("musts") == F.col("decisive")) & (F.size("against") == 0)), F.struct(
        (F.col("from") + F.array_min("places")).alias("start"),
        (F.col("to") + F.array_max("places") + K).alias("end"),
        "label",
        "base",
        share.alias("coverage"),
    ))
    out = spans.groupBy("row", "id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(verified)).alias("spans"))
    starts = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: s["start"])
    names = lambda keep: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("spans", keep), lambda s: s["label"]))), ",")
    return out.select(
        F.col("id").alias(id),
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(lambda s: s["base"]).alias("base_labels"),
        names(lambda s: F.lit(True)).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
        "spans",
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("spans")
