"""Licence notices: fixed phrases, and templates found by an exact set-similarity join with text blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, table

PHRASES = {(b"cc", b"by"): "cc-by", (b"general", b"public", b"license"): "gpl", (b"all", b"rights", b"reserved"): "reserved"}

#: Notices by label. Short openings of well-known notices, in the words that they share.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2.0": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike international license to view a copy of this license visit",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
}

#: Share of a template's distinct words that a block must hold; a block's length in template lengths.
THRESHOLD, SLACK = 0.8, 1.25

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def license_words(text: str | None) -> list[bytes]:
    """Words: digits, letters (A-Z lower-cased) and all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


@dataclass
class Template:
    label: str
    tokens: list[bytes]  # distinct, rarest in the corpus first
    width: int  # words of a block

    @property
    def needed(self) -> int:
        return math.ceil(THRESHOLD * len(self.tokens) - 1e-9)

    @property
    def prefix(self) -> list[bytes]:
        """A block with enough of the template holds one of these: all others are fewer than needed."""
        return self.tokens[: len(self.tokens) - self.needed + 1]


def ordered(templates: dict[str, str], frequency: dict[bytes, int]) -> list[Template]:
    out = []
    for label, text in templates.items():
        words = license_words(text)
        out.append(Template(label, sorted(set(words), key=lambda w: (frequency.get(w, 0), w)), math.ceil(SLACK * len(words))))
    return out


def best_block(words: list[bytes], t: Template, present: set[bytes] | None = None) -> tuple[int, int, int] | None:
    """The block of t.width words with the most of the template's words, if enough: (words held, start, end).

    Length filter: a text shorter than the needed words can't match. Prefix filter: only blocks around an
    occurrence of a prefix word count. Positional filter: if the rarest word present has rank i, at most
    len(tokens) - i words can be shared. Blocks start at any word; the first best one is returned.
    """
    need = t.needed
    if len(words) < need:
        return None
    present = present if present is not None else set(words)
    first = next((i for i, w in enumerate(t.tokens) if w in present), None)
    if first is None or len(t.tokens) - first < need or sum(w in present for w in t.tokens) < need:
        return None
    rank, prefix = {w: i for i, w in enumerate(t.tokens)}, len(t.prefix)
    hits = [(i, rank[w]) for i, w in enumerate(words) if w in rank]
    best, counts, held, rare, left = None, [0] * len(t.tokens), 0, 0, 0
    for i, r in hits:
        counts[r] += 1
        held += counts[r] == 1
        rare += r < prefix
        while hits[left][0] <= i - t.width:
            out = hits[left][1]
            counts[out] -= 1
            held -= counts[out] == 0
            rare -= out < prefix
            left += 1
        if rare and held >= need and (best is None or held > best[0]):
            best = (held, hits[left][0], i + 1)
    return best


def least_blocks(words: list[bytes], t: Template) -> list[tuple[int, int]]:
    """As many disjoint blocks with enough of the template as there can be: the one that ends first, then the next after it."""
    rank = {w: i for i, w in enumerate(t.tokens)}
    hits = [(i, rank[w]) for i, w in enumerate(words) if w in rank]
    out, counts, held, left = [], [0] * len(t.tokens), 0, 0
    for at, (i, r) in enumerate(hits):
        counts[r] += 1
        held += counts[r] == 1
        while hits[left][0] <= i - t.width or counts[hits[left][1]] > 1:
            gone = hits[left][1]
            counts[gone] -= 1
            held -= counts[gone] == 0
            left += 1
        if held >= t.needed:
            out.append((hits[left][0], i + 1))
            counts, held, left = [0] * len(t.tokens), 0, at + 1
    return out


def all_blocks(words: list[bytes], t: Template, present: set[bytes] | None = None) -> tuple[int, list[tuple[int, int, int]]]:
    """Most words held by any block, and disjoint blocks (words held, start, end), as many as there can be.

    Each is the best block between the one before and the least block after it, so a text with one has its best block.
    """
    best = best_block(words, t, present)
    if best is None:
        return 0, []
    least, out, free = least_blocks(words, t), [], 0
    if len(least) < 2:
        return best[0], [best]
    for stop in [*(a for a, _ in least[1:]), len(words)]:
        held, a, b = best_block(words[free:stop], t)
        out.append((held, free + a, free + b))
        free += b
    return best[0], out


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Starts of the fixed phrases with their labels; places may overlap."""
    out = []
    for phrase, label in PHRASES.items():
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if tuple(words[at : at + len(phrase)]) == phrase:
                out.append((at, label))
    return sorted(out)


def _frequencies(vocabulary: list[bytes]):
    def run(batches):
        import pyarrow as pa

        wanted, counts = set(vocabulary), dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in wanted.intersection(license_words(text)):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return run


def _scan(templates: list[Template]):
    def run(batches):
        import pyarrow as pa

        rarest = {w for t in templates for w in t.prefix}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = license_words(text)
                present = set(words)
                places = phrase_places(words) if not present.isdisjoint((b"cc", b"general", b"all")) else []
                blocks, most = [], 0.0
                if not present.isdisjoint(rarest):
                    for t in templates:
                        held, found = all_blocks(words, t, present)
                        most = max(most, held / len(t.tokens))
                        blocks += [(t.label, b[0] / len(t.tokens), b[1], b[2]) for b in found]
                base = sorted({label for _, label in places})
                labels = sorted({*base, *(b[0] for b in blocks)})
                score = 1.0 if places else most
                rows.append((doc_id, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(labels), score, [{"label": a, "score": s, "start": x, "end": y} for a, s, x, y in blocks]))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))]
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return run


@small_batches
def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Find licence notices in every text, one row per input row.

    doc_id, n_words, n_base (places of fixed phrases), first_word and last_word (their smallest and largest start, null
    without any), base_labels, labels, score (1 with a fixed phrase, else the largest share of a template
    that a block holds, 0 if none holds enough) and blocks (label, score, start, end in words). Of each template
    blocks holds as many disjoint ones as there can be; a block across two of them can hold more, and then gives the score.
    The first pass counts in how many texts each template word is, over all texts; tokens are ordered by it, rarest
    first, for the prefix filter. A null text counts as empty: no words, empty labels.
    """
    templates = templates or TEMPLATES
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = sorted({w for t in templates.values() for w in license_words(t)})
    counted = rows.select("text").mapInArrow(_frequencies(vocabulary), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {bytes(r.word): r.n for r in counted.collect()}  # a row for each template word
    found = rows.mapInArrow(_scan(ordered(templates, frequency)), "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<struct<label: string, score: double, start: bigint, end: bigint>>")
    return materialize(found)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return license_scan(table(spark, sf_dir, "documents")).drop("blocks")


def _phrases_sql() -> str:
    rows = []
    for phrase, label in PHRASES.items():
        at = " AND ".join(f"w[i + {j}] = '{x.decode()}'" for j, x in enumerate(phrase))
        rows.append(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, '{phrase[0].decode()}')) WHERE {at}")
    return " UNION ALL ".join(rows)


def _templates_sql() -> str:
    rows = []
    for t in ordered(TEMPLATES, {}):
        words = ", ".join(f"'{x.decode()}'" for x in sorted(t.tokens))
        rows.append(f"('{t.label}', [{words}], {t.needed}, {t.width})")
    return ", ".join(rows)


#: Blocks end at a template word and are as wide as a block may be; texts with too few of a template's words are left out first.
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS ({_phrases_sql()}),
s AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base, list(DISTINCT label) AS labels FROM b GROUP BY doc_id),
t AS (SELECT * FROM (VALUES {_templates_sql()}) t(label, words, needed, width)),
c AS (SELECT doc_id, w, label, words, needed, width FROM d, t WHERE len(list_intersect(w, words)) >= needed),
h AS (SELECT doc_id, label, needed, width, len(words) AS size, i, w[i] AS x FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c) WHERE list_contains(words, w[i])),
e AS (SELECT a.doc_id, a.label, a.i, any_value(a.needed) AS needed, any_value(a.size) AS size, count(DISTINCT z.x) AS held FROM h a JOIN h z ON z.doc_id = a.doc_id AND z.label = a.label AND z.i <= a.i AND z.i > a.i - a.width GROUP BY a.doc_id, a.label, a.i),
f AS (SELECT doc_id, list(DISTINCT label) AS labels, max(held / size) AS score FROM e WHERE held >= needed GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(base, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(s.labels, []), coalesce(f.labels, [])))), ',') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN f USING (doc_id)
"""
