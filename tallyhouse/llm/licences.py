"""Licence texts and notices found by the digest of their canonical form.

A text becomes canonical by lower case, without copyright lines, with equivalent spellings made
one, and with every run of other characters than letters and digits as one blank. Its SHA-256 is
hash-joined to the digests of known licences. Entire texts are looked up: a whole document, and
each of its lines as an entire text of its own, since notices stand on one line.

Digests of lines are counted per document before the join; the known digests are a table that
Spark broadcasts while it is small and shuffles otherwise.

Defined cases. Null, empty and purely non-alphanumeric texts have no digest and match nothing.
Repeated rows are looked up each on its own. Several notices of one licence in a document count
apart but are named once. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pairs of equivalent spellings, applied in this order to lower-cased text.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("noncommercial", "non-commercial"),
    ("organisation", "organization"),
    ("copyright owner", "copyright holder"),
    ("https:", "http:"),
    (" version ", " v"),
)

# Short notices, as they stand on one line.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License");',
    ),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "CC0-1.0": ("Released under CC0 1.0.", "Licensed under CC0 1.0."),
}

# Whole texts of short licences.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
TEXTS = {
    "MIT": (
        "MIT License\n\nCopyright (c) the holders\n\n"
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS,
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.\n\n" + _AS_IS,
    ),
}


def canonical(text: Column) -> Column:
    """The form that is digested; null where nothing is left of the text."""
    # one copyright line may follow another, so the line break is left in place
    out = F.regexp_replace(F.lower(text), r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$", "")
    out = F.regexp_replace(out, r"[ \t\r\n]+", " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    return F.when(out != "", out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licences(spark: SparkSession, texts: dict = TEXTS, notices: dict = NOTICES) -> DataFrame:
    """digest, license, kind (text or notice), one row per digest."""
    rows = [(name, kind, t) for kind, group in (("text", texts), ("notice", notices)) for name, all_ in group.items() for t in all_]
    df = spark.createDataFrame(rows, "license string, kind string, text string")
    return df.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"), F.min("kind").alias("kind"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, text_license, n_notices and notice_licenses of every document."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        digest(F.col("text")).alias("text_digest"),
        F.filter(
            F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), digest), lambda d: d.isNotNull()
        ).alias("lines"),
    )
    units = rows.select(
        "rid",
        "doc_id",
        "text_digest",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("text").alias("unit"), F.col("text_digest").alias("digest"))),
                F.transform("lines", lambda d: F.struct(F.lit("notice").alias("unit"), d.alias("digest"))),
            )
        ).alias("u"),
    ).select("rid", "doc_id", "text_digest", "u.*")
    found = units.join(known, "digest", "left")
    hit = lambda unit, column: F.when(F.col("unit") == unit, F.col(column))
    return found.groupBy("rid", "doc_id", "text_digest").agg(
        F.max(hit("text", "license")).alias("text_license"),
        F.count(hit("notice", "license")).alias("n_notices"),
        F.concat_ws(",", F.array_sort(F.collect_set(hit("notice", "license")))).alias("notice_licenses"),
    ).drop("rid")
