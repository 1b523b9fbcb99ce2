"""Licence scans: fixed phrases, and an exact set-similarity join of text blocks with licence templates.

Method. For a template of L words a text is cut into blocks of 2 L words, a new one every L words, so that any
passage of up to L words lies whole in a block, however long the template. A block meets the template if it holds
at least THRESHOLD of the template's distinct words (containment). The words of all templates are ordered by their
frequency in the whole corpus, rare ones first; other words count for nothing. Then, of a template of n distinct words, need of them required,

* prefix filter: a block with enough of the template's words holds one of its first
  n - need + 1 words, so only blocks with such a word are looked at;
* length filter: a block that holds fewer than need distinct words of any template cannot meet it;
* positional filter: if the first prefix word that the block holds is the template's i-th and the block's j-th
  (from 0), at most 1 + min(n - i - 1, m - j - 1) words can be shared, m being the block's distinct template words.

What is left is counted exactly. The frequencies are one aggregation over all documents, of at most as many
rows as the templates have words (MAX_TEMPLATE_WORDS at most); the search is a second pass without a shuffle.

Defined results. Null and empty texts have no words and no places; score 0. Words are runs of digits, a-z (A-Z lower-cased) and
all non-ASCII characters. Templates without words meet nothing. Repeated rows give repeated results. Extra columns are ignored.
score is the best containment of a met template, or PHRASE if there is only a phrase, or 0.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, minhash

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
THRESHOLD, PHRASE = 0.8, 0.6
#: The templates are sent to every task.
MAX_TEMPLATE_WORDS = 1_000_000
#: Licence texts or the notices that stand for them, by label.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.""",
    "apache-text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License
is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "gpl-text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "cc-text": """This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit
http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
}
OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,first_word:bigint,last_word:bigint,score:double>>"

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


def words(col) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text of an Arrow string array; n + 1 offsets of the texts into them."""
    return minhash.word_hashes(col, solid=_WORD)


def _hashes(text: str) -> np.ndarray:
    return words(pa.array([text], pa.string()))[0]


def token_counts(docs: DataFrame, tokens: np.ndarray, text: str = "text") -> dict[int, int]:
    """How often each of the given word hashes occurs in all texts."""
    tokens = np.sort(tokens)
    if not len(tokens):
        return {}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens), np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                h, _ = words(b.column("text").slice(s, 512))
                at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                total += np.bincount(at[tokens[at] == h], minlength=len(tokens))
        yield pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(total)], names=["token", "n"])

    rows = docs.select(common.whole_text(text).alias("text")).mapInArrow(step, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token: r.n for r in rows}


class Index:
    """Templates by the ranks of their words in global order, and the prefix words that point to them."""

    def __init__(self, templates: dict[str, str], counts: dict[int, int], threshold: float):
        texts = {label: h for label, h in ((label, _hashes(text)) for label, text in templates.items()) if len(h)}
        every = np.unique(np.concatenate([*texts.values(), np.zeros(0, np.uint64)]))
        if len(every) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
        order = np.lexsort((every, [counts.get(int(x), 0) for x in every.view(np.int64)]))
        self.words, self.rank = every, np.empty(len(every), np.int64)
        self.rank[order] = np.arange(len(every))
        self.entries, self.of = [], {}
        for label, h in texts.items():
            own = np.sort(self.rank[np.searchsorted(every, np.unique(h))])
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            for i, r in enumerate(own[: len(own) - need + 1]):
                self.of.setdefault(int(r), []).append((len(self.entries), i))
            self.entries.append((label, len(h), own, need))
        self.prefix = np.zeros(len(every), bool)
        self.prefix[list(self.of)] = True

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 for words of no template."""
        if not len(self.words) or not len(h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.rank[at], -1)

    def search(self, ranks: np.ndarray) -> list[tuple[str, int, int, float]]:
        """Of one text's word ranks the blocks that meet a template: label, first and last word, containment."""
        spots = np.flatnonzero((ranks >= 0) & self.prefix[ranks]) if len(self.words) else np.zeros(0, np.int64)
        first: dict[tuple[int, int], int] = {}  # block and template: the least place in the template of a prefix word that the block holds
        for s in spots.tolist():
            for e, i in self.of[int(ranks[s])]:
                stride = self.entries[e][1]
                for k in {max(0, s // stride - 1), s // stride}:
                    first[k, e] = min(i, first.get((k, e), i))
        out = []
        for (k, e), i in sorted(first.items()):
            label, stride, own, need = self.entries[e]
            block = np.unique(ranks[k * stride : (k + 2) * stride])
            block = block[np.searchsorted(block, 0) :]
            j = int(np.searchsorted(block, own[i]))
            if len(block) < need or 1 + min(len(own) - i - 1, len(block) - j - 1) < need:
                continue
            got = int(np.isin(own[i:], block[j:], assume_unique=True).sum())
            if got >= need:
                out.append((label, k * stride, min(len(ranks), (k + 2) * stride), got / len(own)))
        return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, keep: list[str], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The columns keep of docs with n_words, n_base, first_word, last_word, base_labels, labels, score, blocks."""
    counts = token_counts(docs, np.unique(np.concatenate([np.zeros(0, np.uint64), *(_hashes(t) for t in templates.values())])), text)
    index = Index(templates, counts, threshold)
    phrases = [(_hashes(p), label) for p, label in PHRASES]
    names = [f.split()[0] for f in OUT.split(", ")]

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        h, off = words(b.column("__text"))
        ranks = index.ranks(h)
        places: dict[int, list] = {}
        for p, label in phrases:
            n = max(len(h) - len(p) + 1, 0)
            hit = np.ones(n, bool)
            for j, x in enumerate(p):
                hit &= h[j : j + n] == x
            for s in np.flatnonzero(hit):
                d = int(np.searchsorted(off, s, side="right")) - 1
                if s + len(p) <= off[d + 1]:
                    places.setdefault(d, []).append((int(s - off[d]), label))
        rows = []
        for d in range(b.num_rows):
            base, blocks = places.get(d, []), index.search(ranks[off[d] : off[d + 1]])
            starts, own = [s for s, _ in base], {x for _, x in base}
            best = max([x[3] for x in blocks], default=PHRASE if base else 0.0)
            rows.append((int(off[d + 1] - off[d]), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in blocks})), best, [dict(zip(("label", "first_word", "last_word", "score"), x)) for x in blocks]))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(v, t) for v, t in zip(zip(*rows), kinds))], names=[*keep, *names])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                yield part(b.slice(s, 512))

    kept = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, common.whole_text(text).alias("__text")).mapInArrow(step, f"{kept}, {OUT}")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: licence phrases and templates in all documents."""
    return scan(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).drop("blocks")


def _block_sql(label: str, text: str) -> str:
    """DuckDB: every block of every text against one template, counted in full."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    own = sorted(set(w))
    n, need = len(w), math.ceil(THRESHOLD * len(own) - 1e-9)
    listed = ", ".join(f"'{x}'" for x in own)
    return f"""SELECT doc_id, '{label}' AS label, got / {len(own)}::DOUBLE AS score
  FROM (SELECT doc_id, len(list_intersect(list_distinct(w[k * {n} + 1:(k + 2) * {n}]), [{listed}])) AS got FROM (SELECT doc_id, w, unnest(range(0, (len(w) + {n - 1}) // {n})) AS k FROM d)) WHERE got >= {need}"""


def _place_sql(phrase: str, label: str) -> str:
    words_ = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words_))
    return f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM (SELECT doc_id, w, unnest(list_filter(range(1, len(w) - {len(words_) - 2}), lambda i: {same})) AS i FROM d)"


OP4_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS MATERIALIZED ({" UNION ALL ".join(_place_sql(*p) for p in PHRASES)}),
met AS MATERIALIZED ({" UNION ALL ".join(_block_sql(*t) for t in TEMPLATES.items())}),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
best AS (SELECT doc_id, max(score) AS score FROM met GROUP BY doc_id),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM met) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, CASE WHEN n_base > 0 THEN {PHRASE}::DOUBLE ELSE 0 END) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN labels USING (doc_id)
"""
