"""License texts in documents: k-gram hits on template positions, voted along diagonals, then verified.

Every document's words give one hash per run of k words. These hashes are joined in Spark with the
positions of the same hashes in the license templates. A hit at word i of a document and word j of a
template lies on diagonal i - j; hits are counted per (document, template, diagonal). Neighbouring diagonals
(a few words put in or left out move a copy to another diagonal) merge, and each merged span is verified
against the words themselves: the share of the template's words found in order inside the span.

The template table has a few hundred rows here; it is broadcast only after its rows are counted. Hits are counted with map-side combining. Only spans with enough votes go back to the texts.

Words are runs of ASCII digits, ASCII letters and any characters beyond ASCII, after A-Z are lower-cased. Base
labels come from fixed phrases and stand in every place where a phrase's words stand consecutively.

Defined results: null text is empty, without words and labels. Repeated rows get equal results: the
unit is an id with its text. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from promptgauge.llm.batches import per_row
from promptgauge.llm.columns import id_and_text
from promptgauge.session import written

K = 3
VOTES = 2
NEAR = 8
COVERAGE = 0.6
BROADCAST_ROWS = 50_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Fixed by the contract: phrase and label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public license notices, grants and whole licenses. Fixed values.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
        "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "mit": [
        "Released under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form"],
}


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8").lower())  # on bytes: A-Z only


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def gram_hashes(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The rolling hash of every run of k word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.array([], "i8")
    rolled = np.zeros(n, "u8")
    for j in range(k):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return rolled.astype("i8")


def template_table(spark: SparkSession, templates: dict[str, list[str]] | None = None, k: int = K) -> DataFrame:
    """``gram, label, template, at``: every position of every k-gram of the templates.

    The rows are counted here: up to ``BROADCAST_ROWS`` of them (a few MB) are marked for broadcast, so that the
    k-grams of the documents stay where they are; a larger table is joined as Spark sees fit, with the same result.
    """
    rows: list[tuple] = []
    for label, texts in (TEMPLATES if templates is None else templates).items():
        for n, text in enumerate(texts):
            words = words_of(text)
            grams = gram_hashes(np.array([_word_hash(w) for w in words], "u8"), k)
            rows += [(int(g), label, n, i) for i, g in enumerate(grams)]
    table = spark.createDataFrame(rows, "gram long, label string, template int, at int")
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def phrase_places(words: list[bytes], phrases: list[list[bytes]]) -> list[list[int]]:
    """The word numbers at which each phrase stands."""
    joined, found = b" " + b" ".join(words) + b" ", []
    for phrase in phrases:
        wanted, places, seen, number = b" " + b" ".join(phrase) + b" ", [], 0, 0
        at = joined.find(wanted)
        while at >= 0:
            number += joined.count(b" ", seen, at)
            places.append(number)
            seen, at = at, joined.find(wanted, at + 1)
        found.append(places)
    return found


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, text``; rows of equal id and text share a key, and so a result."""
    return id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("digest"), "text")


def gram_table(texts: DataFrame, k: int = K) -> DataFrame:
    """``doc_id, digest, place, gram``: every k-gram hash of every text, one row each."""

    def begin():
        known: dict[bytes, int] = {}

        def work(texts: list[str]) -> dict:
            made = []
            for text in texts:
                words = words_of(text)
                if len(known) > 500_000:
                    known.clear()
                fresh = {w: _word_hash(w) for w in set(words).difference(known)}
                known.update(fresh)
                made.append(gram_hashes(np.fromiter(map(known.__getitem__, words), "u8", len(words)), k))
            return {"grams": made}

        return work

    return per_row(texts, begin, "grams array<long>", "text").select("doc_id", "digest", F.posexplode("grams").alias("place", "gram"))


def candidate_spans(hits: DataFrame, near: int = NEAR, votes: int = VOTES) -> DataFrame:
    """Merged spans ``doc_id, digest, label, template, low, high, votes`` from template hits with enough votes."""
    copy = ["doc_id", "digest", "label", "template"]
    voted = hits.groupBy(*copy, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"))
    along = Window.partitionBy(*copy).orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > near, F.lit(True)).cast("int")
    numbered = voted.withColumn("opens", opens).withColumn("span", F.sum("opens").over(along))
    merged = numbered.groupBy(*copy, "span").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.filter(F.col("votes") >= votes).drop("span")


def coverage(words: list[bytes], template: list[bytes]) -> float:
    """The largest share of the template's words that stands in order in a stretch of twice its length."""
    size, best = len(template), 0
    for start in range(0, max(1, len(words) - size), size):
        blocks = SequenceMatcher(None, template, words[start : start + 2 * size], autojunk=False).get_matching_blocks()
        best = max(best, sum(b.size for b in blocks))
    return best / size


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, k: int = K, near: int = NEAR, votes: int = VOTES, least: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels`` by the fixed phrases; ``spans``, the verified
    ones as an array of ``label, low, high, coverage`` in words; ``labels``, those of both; ``score``, the best coverage
    (a fixed phrase alone counts one half).
    """
    templates = TEMPLATES if templates is None else templates
    known = {(label, n): words_of(t) for label, ts in templates.items() for n, t in enumerate(ts)}
    phrases, names = [words_of(p) for p in BASE], list(BASE.values())
    texts = keyed_texts(docs, id_col, text_col)
    hits = gram_table(texts, k).join(template_table(docs.sparkSession, templates, k), "gram").select("doc_id", "digest", "label", "template", "place", "at").distinct()
    spans = candidate_spans(hits, near, votes)
    listed = spans.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("low", "high", "label", "template"))).alias("candidates"))
    listed = written(listed, "spans").select(F.col("doc_id").alias("span_id"), F.col("digest").alias("span_digest"), "candidates")
    joined = texts.join(listed, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("digest") == F.col("span_digest")), "left")
    held = joined.select("doc_id", "text", F.to_json("candidates").alias("candidates"))

    def begin():
        def work(texts: list[str], candidates: list[str | None]) -> dict:
            made = {name: [] for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "spans", "labels", "score")}
            for text, listed in zip(texts, candidates, strict=True):
                words = words_of(text)
                found = phrase_places(words, phrases) if b"license" in words else [[]] * len(phrases)
                places, base = [p for ps in found for p in ps], {n for n, ps in zip(names, found, strict=True) if ps}
                spans = []
                for c in json.loads(listed or "[]"):
                    share = coverage(words[max(0, c["low"] - k) : c["high"] + 2 * k], known[c["label"], c["template"]])
                    if share >= least:
                        spans.append({"label": c["label"], "low": c["low"], "high": c["high"] + k, "coverage": share})
                labels = base | {s["label"] for s in spans}
                score = max([s["coverage"] for s in spans] + [0.5 * bool(places)])
                values = len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), spans, ",".join(sorted(labels)), score
                for name, value in zip(made, values, strict=True):
                    made[name].append(value)
            return made

        return work

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, spans array<struct<label: string, low: long, high: long, coverage: double>>, labels string, score double"
    return per_row(held, begin, fields, "text", "candidates")
