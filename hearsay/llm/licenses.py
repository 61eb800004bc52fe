"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearsay.llm.common import materialise
from hearsay.session import ship_package

# Statements and opening sentences by which licences are named.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
}
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([._-][^/]*)?$"
_TOKEN = re.compile(rb"[a-z0-9][a-z0-9.+\-]*")


def tokens_of(text: bytes) -> list[bytes]:
    return [t.rstrip(b".-+") for t in _TOKEN.findall(text.lower())]


class Matcher:
    """Cosine of token bags to all templates, with the document frequencies of the corpus.

    Words that no template has weigh as if one document had them. A bag is
    compared only with templates of which it has a telling word: without any of
    these the cosine stays below the threshold, so nothing is lost.
    """

    def __init__(self, frequency: dict[bytes, int], documents: int, threshold: float, templates: dict[str, list[str]]):
        self.idf = {w: math.log((documents + 1) / (n + 1)) + 1 for w, n in frequency.items()}
        self.other, self.threshold = math.log((documents + 1) / 2) + 1, threshold
        self.vectors, self.telling = [], {}
        for name in sorted(templates):
            for text in templates[name]:
                bag = self._weights(Counter(tokens_of(text.encode())))
                norm = math.sqrt(sum(v * v for v in bag.values()))
                bag = {w: v / norm for w, v in bag.items()}
                common = 0.0
                for w in sorted(bag, key=lambda w: (bag[w], w)):
                    common += bag[w] ** 2
                    if common >= threshold ** 2:
                        self.telling.setdefault(w, []).append(len(self.vectors))
                self.vectors.append((name, bag))

    def _weights(self, bag: Counter) -> dict[bytes, float]:
        return {w: n * self.idf.get(w, self.other) for w, n in bag.items()}

    def best(self, tokens: list[bytes]) -> tuple[float, str | None]:
        near = {k for w in self.telling.keys() & set(tokens) for k in self.telling[w]}
        if not near:
            return 0.0, None
        bag = self._weights(Counter(tokens))
        norm = math.sqrt(sum(v * v for v in bag.values()))
        scored = [(sum(v * bag.get(w, 0.0) for w, v in self.vectors[k][1].items()) / norm, self.vectors[k][0]) for k in sorted(near)]
        top, name = max(scored, key=lambda x: x[0])
        return (top, name) if top >= self.threshold else (0.0, None)

    def scan(self, text: bytes) -> tuple[float, str | None, float]:
        """Best score and name over lines, paragraphs and the whole text; and the share of words the statement makes up."""
        lower = text.lower()
        words = max(1, len(lower.split()))
        found = (0.0, None, 0.0)
        for unit in [x for p in re.split(rb"\n[ \t\r]*\n", lower) for x in {p, *p.split(b"\n")}]:
            parts = tokens_of(unit)
            score, name = self.best(parts)
            if name and (score, len(parts)) > (found[0], found[2] * words):
                found = (score, name, len(parts) / words)
        return found


def scan_licenses(
    files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = 0.7,
    templates: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row per file: doc_id, path, own_license, own_score, declares, license and inherited_from.

    A file's own licence is the template nearest to one of its lines, paragraphs
    or its whole text, of at least the threshold. A file named as a licence
    file, or at least half made of its licence statement, declares it for its
    directory; where several do, the most frequent licence counts, then the
    first by name. Files without one inherit from the nearest ancestor that
    declares. Directories are looked up once each.

    Null and empty texts have no licence of their own; a null path has no
    directory and inherits nothing; rows that share a path are files of their own.
    """
    spark = files.sparkSession
    ship_package(spark)
    templates = templates or TEMPLATES
    vocabulary = {t for texts in templates.values() for x in texts for t in tokens_of(x.encode())}
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                n += 1
                seen.update(w for w in {x.strip(b".,;:()\"'") for x in (text or b"").lower().split()} if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array([*seen, None], pa.binary()), pa.array([*seen.values(), n], pa.int64())], names=["word", "n"])

    sums = rows.select("_text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = dict.fromkeys(vocabulary, 0) | {bytes(r["word"]): r["n"] for r in sums if r["word"] is not None}
    matcher = spark.sparkContext.broadcast(Matcher(frequency, sum(r["n"] for r in sums if r["word"] is None), threshold, templates))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matcher.value.scan(x or b"") for x in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.float64())], names=["doc_id", "path", "own_license", "own_score", "_part"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    own = materialise(rows.mapInArrow(scan, f"doc_id {kind}, path string, own_license string, own_score double, _part double"), "licenses")
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    own = own.withColumn("declares", F.coalesce(F.col("own_license").isNotNull() & (F.col("path").rlike(LICENSE_FILE) | (F.col("_part") >= 0.5)), F.lit(False)))
    own = own.withColumn("_dir", directory)

    said = own.where("declares AND _dir IS NOT NULL").groupBy("_dir", "own_license").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("_dir").orderBy(F.desc("n"), "own_license")
    said = said.withColumn("_k", F.row_number().over(first)).where("_k = 1").select(F.col("_dir").alias("_from"), F.col("own_license").alias("_license"))
    dirs = own.where("_dir IS NOT NULL").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("_from")).distinct()
    nearest = above.join(said, "_from").groupBy("_dir").agg(F.max(F.struct(F.length("_from").alias("l"), F.col("_from").alias("f"), F.col("_license").alias("license"))).alias("_near"))
    out = own.join(nearest, "_dir", "left")
    takes = F.col("own_license").isNull() & F.col("_near").isNotNull()
    return out.select(
        "doc_id", "path", "own_license", "own_score", "declares", F.coalesce("own_license", "_near.license").alias("license"),
        F.when(takes, F.col("_near.f")).alias("inherited_from"))
