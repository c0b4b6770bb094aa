"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm import alignment, collocations, decontaminate, language_id, licence_scan, line_dedup, near_dedup, packing, quality_rules, suffix_dedup, token_count, toxicity, url_filter

#: Verdict, host and path prefix of each rule.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Phrases and their labels.
LICENCE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Wordings of public licences, as notices and as the sentences they are known by, and labels.
LICENCE_TEMPLATES = [
    ("released under the MIT License", "mit"),
    ("licensed under the MIT License", "mit"),
    ("licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("this work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
    ("to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0-1.0"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "mit",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache-2.0",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "gpl-3.0",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "unlicense"),
    ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "refused_by")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "documents"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens=False).drop("tokens")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.language_id(docs, docs.where((fold(4) != 2) & F.col("lang").isNotNull()))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), fold(5) != 0)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_alignment(table(spark, sf_dir, "documents"), groups=False)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.licence_scan(table(spark, sf_dir, "documents"), LICENCE_TEMPLATES, LICENCE_PHRASES).drop("spans")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_minhash_near_dedup, op4_decontamination, op5_line_dedup, op6_url_filters, op7_suffix_array_dedup, op8_packing, op9_language_id, op10_toxicity, op11_token_alignment, op12_license_scan, op13_collocations)},
    "pipeline": pipeline,
}

ORACLE = {
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id < last_doc, false) AS gone FROM keyed LEFT JOIN hot USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op7_suffix_array_dedup": r"""
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS body FROM documents
), strings AS (
  SELECT doc_id, unnest(range(1, length(body) // 2 - 48)) AS p, unnest(list_transform(range(1, length(body) // 2 - 48), lambda p: md5_number(substr(body, 2 * p - 1, 100)))) AS string FROM raw
), firsts AS (
  SELECT string, min(doc_id) AS first_doc FROM strings GROUP BY string HAVING count(*) > 1
), gone AS (
  SELECT doc_id, p FROM strings JOIN firsts USING (string) WHERE first_doc < doc_id
), spans AS (
  SELECT doc_id, min(p) AS lo, max(p) + 49 AS hi FROM (
    SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM (
      SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM gone))
  GROUP BY doc_id, span
), pieces AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER w, 0) AS before, lead(lo) OVER w IS NULL AS last FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
), cut AS (
  SELECT doc_id, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans,
         string_agg(substr(body, 2 * before + 1, 2 * (lo - before - 1)) || CASE WHEN last THEN substr(body, 2 * hi + 1) ELSE '' END, '' ORDER BY lo) AS kept
  FROM pieces JOIN raw USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(body) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, body))) AS kept_sha256
FROM raw LEFT JOIN cut USING (doc_id)
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(gram, ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, m, unnest(list_transform(range(1, greatest(len(w) - m + 2, 1)), lambda i: w[i:i + m - 1])) AS gram FROM words, range(1, 6) AS t(m))
  GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), cuts AS (
  SELECT g.lang, g.phrase, g.f AS a, k, string_split(g.phrase, ' ') AS w FROM grams g, range(1, 5) AS t(k) WHERE m > k
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM grams g WHERE g.lang = b.lang AND g.f >= b.a AND len(string_split(g.phrase, ' ')) > len(string_split(b.phrase, ' ')) AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
""",
}
