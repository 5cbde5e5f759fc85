"""License scan: TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

Comment marks are taken off the lines.  Lines that hold a licensing cue are compared alone, with the line after them and
by their sentences; so are paragraphs (lines joined up to an empty one) and their sentences, whatever their wrapping, and
the single identifiers of an SPDX expression.  Years and holders of copyright notices are left out.  The words of these
pieces are weighted by term frequency and by inverse document frequency over the licences and compared with every template
by sparse cosine (a join on words with the template weights, a fixed table).  A piece that names a variant (``VARIANTS``; for
"lesser" and "affero" the lines beside it count too) matches no template without that word.  A licence has several
templates; of each family the best one of ``MIN_SCORE`` or more counts, the best of all families is the file's own
licence, and a notice of reserved rights counts only where no other licence is named.  A directory's licence is that of
its licence files (base name LICENSE or COPYING ...; the best score, then the name).
A file without a licence of its own inherits from its nearest ancestor directory that has one, by joins on the
directory prefixes of its path.

Edge cases: null and empty texts have no licence of their own but may inherit; null paths inherit nothing; equal
scores take the first name; repeated rows give repeated results; a long text costs work in proportion to its length, and
a paragraph or line of any length is one piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, join_one, let

#: Licence statements.  Each licence has its short statements, its title, its SPDX lines (made from its name)
#: and the sentences of its full header or text that name it.
TEMPLATES = {
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License, version 3",
        "GNU Affero General Public License Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "AGPLv3 License",
    ),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.", "Apache License, Version 1.1"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 License.",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "BSD 2-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
        "Released under the BSD 3-Clause License.",
        "BSD 3-Clause License",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.", "Eclipse Public License, version 1.0"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Eclipse Public License, version 2.0"),
    "EUPL-1.2": ("Licensed under the EUPL, Version 1.2 or later.", "European Union Public Licence v. 1.2"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU General Public License, version 2",
        "GNU General Public License Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GPLv2 License",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License, version 3",
        "GNU General Public License Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GPLv3 License",
    ),
    "ISC": ("Released under the ISC License.", "ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "GNU Lesser General Public License, version 2.1",
        "GNU Lesser General Public License Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "LGPLv2.1 License",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "GNU Lesser General Public License, version 3",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "LGPLv3 License",
    ),
    "MIT": ("Released under the MIT License.", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    "MIT-0": ("Released under the MIT No Attribution License.", "MIT No Attribution"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License, Version 2.0"),
    "Proprietary": ("All rights reserved. No part may be reproduced without permission.", "All rights reserved.", "Copyright. All rights reserved.", "No part may be reproduced without permission.", "Proprietary and confidential. Unauthorized copying without permission is prohibited."),
    "Unlicense": ("Released under the Unlicense.", "The Unlicense", "This is free and unencumbered software released into the public domain."),
}
#: Words that set a licence apart from its relatives.
VARIANTS = ("affero", "clause2", "clause3", "lesser", "nc", "nd", "noattribution", "noncommercial", "noderivatives", "sa", "sharealike")
#: Sentences that relatives have in common count this share: (licence, number of the statement).
SHARED, SHARE = {("BSD-2-Clause", 2)}, 0.9
RESERVED = "Proprietary"
#: LICENSE, COPYING and the like, with a name or a text suffix; no program files.
LICENSE_FILE = r"(?i)^(?:un)?(?:licen[cs]es?|copying)(?:-[A-Za-z0-9.-]+|\.(?:txt|md|rst|html))?$"
CUE = r"(?i)licen[cs]e|copyright|spdx|redistribut|permission|rights reserved|creative commons|public domain|unencumbered|neither the name|cc0|no attribution"
#: What a comment puts before a line.
MARKS = r"(^|[\r\n])[ \t]*(?:[#*/;%!]+|--+)?[ \t]*"
PARAGRAPH, BLANKS = r"(?:\r?\n){2,}", r"[ \t\r\n]+"
SPDX, EITHER = r"(?i)SPDX-License-Identifier:[ \t]*(.*)", r"(?i)[ \t]+(?:OR|AND)[ \t]+"
CLAUSES, FREE = r"(?i)([23])[- ]clause", r"(?i)no attribution"
#: Owners and notices in a statement's own words, which no holder follows.
OWNER = r"(?i)copyright (holder|owner|notice)"
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Years and holder of a copyright notice, which are no words of the statement that follows it.
HOLDER = r"(?i)(?:copyright|\(c\)|©).*?(?=all rights reserved|licen[cs]|released|permission|redistribut|spdx|$)"
SENTENCE, STOP = r"(?<=[.;!?])\s+", r"(?<=[.!?])\s+"
#: Of the statements in the tests, the best piece of each scores 0.7 or more; lines without a statement of these licences stay below 0.65.
MIN_SCORE = 0.65


def _words(text: str) -> list[str]:
    text = re.sub(FREE, "noattribution", re.sub(CLAUSES, r"clause\1", re.sub(OWNER, r"owned \1", text)))
    return re.findall(WORD, text.lower().replace("licence", "license"))


def statements(name: str) -> list[str]:
    """The texts of a licence; identifiers of the GNU family come with their suffixes too."""
    ends = ("", "-only", "-or-later") if "GPL" in name else ("",)
    return [*TEMPLATES[name], *([] if name == RESERVED else [f"SPDX-License-Identifier: {name}{e}" for e in ends])]


def family(name: str) -> str:
    return name.split("-")[0]


def weights() -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """Unit template vectors, inverse document frequencies over licences and the frequency of words that no template has."""
    docs = {n: [Counter(_words(t)) for t in statements(n)] for n in TEMPLATES}
    df = Counter(w for c in docs.values() for w in set().union(*c))
    idf = {w: math.log(1 + len(docs) / n) for w, n in df.items()}
    rows = []
    for name, several in docs.items():
        for k, c in enumerate(several):
            norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items())) / (SHARE if (name, k) in SHARED else 1.0)
            rows += [(name, k, w, n * idf[w] / norm) for w, n in c.items()]
    return rows, idf, math.log(1 + len(docs))


def variants() -> list[tuple[str, int, list[str], str]]:
    """For each template the variants that it names, and its licence's family."""
    return [(n, k, [v for v in VARIANTS if v in _words(t)], family(n)) for n in TEMPLATES for k, t in enumerate(statements(n))]


def _pieces(text: Column) -> Column:
    """Structs (t, near): a piece and the text in which "lesser" and "affero" count for it."""
    piece = lambda t, near: F.struct(t.alias("t"), near.alias("near"))
    cued = lambda x: F.filter(x, lambda y: y.rlike(CUE))
    clean = F.regexp_replace(text, MARKS, "$1")
    lines = lambda x: F.transform(x, lambda y, i: F.struct(y.alias("t"), F.concat_ws(" ", y, F.get(x, i + 1)).alias("two"), F.concat_ws(" ", F.get(x, i - 1), y, F.get(x, i + 1)).alias("near")))

    def of_line(x: Column) -> Column:
        either = F.transform(F.filter(F.split(F.regexp_extract(x.t, SPDX, 1), EITHER), lambda y: y != ""), lambda y: piece(F.concat(F.lit("SPDX-License-Identifier: "), y), y))
        return F.concat(F.array(piece(x.t, x.near), piece(x.two, x.near)), F.transform(cued(F.split(x.t, SENTENCE)), lambda y: piece(y, x.near)), either)

    of_paragraph = lambda y: F.concat(F.array(piece(y, y)), F.transform(cued(F.split(y, STOP)), lambda z: piece(z, z)))
    from_lines = let(F.split(clean, r"[\r\n]+"), lambda x: F.flatten(F.transform(F.filter(lines(x), lambda y: y.t.rlike(CUE)), of_line)))
    paragraphs = F.transform(F.split(clean, PARAGRAPH), lambda y: F.trim(F.regexp_replace(y, BLANKS, " ")))
    return F.array_distinct(F.concat(from_lines, F.flatten(F.transform(cued(paragraphs), of_paragraph))))


def own_licenses(files: DataFrame, key: str) -> DataFrame:
    """Rows (key, license, score, licenses) of files with a statement: the best piece and template, and the best of each family."""
    spark = files.sparkSession
    rows, idf, rare = weights()
    tpl = F.broadcast(spark.createDataFrame(rows, "license string, k int, w string, u double"))  # fixed table of templates
    kinds = F.broadcast(spark.createDataFrame(variants(), "license string, k int, has array<string>, family string"))
    idfs = F.broadcast(spark.createDataFrame([*idf.items()], "w string, idf double"))
    lines = files.where(F.col("text").rlike(CUE)).select(key, F.posexplode(_pieces(F.col("text"))).alias("line", "p"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("p.t", OWNER, "owned $1"), HOLDER, "copyright "), CLAUSES, "clause$1"), FREE, "noattribution")
    said = F.regexp_extract_all(F.replace(F.lower(plain), F.lit("licence"), F.lit("license")), F.lit(WORD), F.lit(0))
    beside = F.regexp_extract_all(F.lower("p.near"), F.lit(r"\b(?:lesser|affero)\b"), F.lit(0))
    lines = lines.select(key, "line", said.alias("said"), beside.alias("beside"))
    lines = lines.select(key, "line", "said", F.array_union(F.array_intersect("said", F.array(*map(F.lit, VARIANTS))), "beside").alias("names"))
    words = lines.select(key, "line", F.explode("said").alias("w")).groupBy(key, "line", "w").agg(F.count("*").alias("tf"))
    words = words.join(idfs, "w", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    norm = words.groupBy(key, "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = words.join(tpl, "w").groupBy(key, "line", "license", "k").agg(F.sum(F.col("x") * F.col("u")).alias("dot"))
    cos = dot.join(norm, [key, "line"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= MIN_SCORE)
    cos = cos.join(kinds, ["license", "k"]).join(lines.select(key, "line", "names"), [key, "line"]).where(F.size(F.array_except("names", "has")) == 0)
    mark = F.struct((F.col("license") == RESERVED).alias("r"), (-F.col("score")).alias("s"), "license")
    families = cos.groupBy(key, "family").agg(F.min(mark).alias("b"))
    best = families.groupBy(key).agg(F.min("b").alias("b"), F.array_sort(F.collect_list("b.license")).alias("all"))  # at most one of each family
    named = F.filter("all", lambda x: (x != RESERVED) | (F.col("b.license") == RESERVED))
    return best.select(key, F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), F.array_join(named, ",").alias("licenses"))


def license_scan(files: DataFrame) -> DataFrame:
    """Rows (file_id, own_license, own_licenses, own_score, license, inherited_from) of ``files`` (file_id, path, text)."""
    rows = files.select("file_id", "path", "text").withColumn("fkey", F.xxhash64("file_id", "path", "text"))
    own = own_licenses(rows.select("fkey", "text").where("text is not null"), "fkey")
    named = rows.select("file_id", "path", "fkey").join(own, "fkey", "left")
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    base = F.element_at(parts, -1)
    named = cut(named.withColumn("dir", F.array_join(F.slice(parts, 1, F.greatest(depth, F.lit(0))), "/")))
    owned = named.where(F.col("license").isNotNull() & base.rlike(LICENSE_FILE)).groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("dir", F.col("b.license").alias("dir_license"))
    # Directories are looked up once each, not once for each of their files.
    places = named.where("license is null and dir is not null").select("dir").distinct()
    pieces = F.split("dir", "/")
    up = F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("up")))).otherwise(F.transform(F.sequence(F.lit(0), F.size(pieces)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(pieces, 1, i), "/").alias("up"))))
    above = cut(places.select("dir", F.explode(up).alias("a")).select("dir", "a.depth", "a.up"))
    near = join_one(above, owned.select(F.col("dir").alias("up"), "dir_license"), "up").where("dir_license is not null").groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_license")).alias("b"))
    out = join_one(named, near, "dir")
    inherits = F.col("license").isNull()
    return out.select("file_id", F.col("license").alias("own_license"), F.col("licenses").alias("own_licenses"), F.col("score").alias("own_score"), F.coalesce("license", "b.dir_license").alias("license"), F.when(inherits, F.col("b.up")).alias("inherited_from"))


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as files: source/lang/<64 ids>/<id>.txt; those whose first line has a cue as LICENSE-<id>."""
    text = F.col("text").cast("string")
    headed = F.coalesce(F.regexp_extract(text, r"^\s*([^\r\n]*)", 1).rlike(CUE), F.lit(False))
    name = F.when(headed, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 64).cast("string"), name)
    return docs.select(F.col("doc_id").cast("long").alias("file_id"), path.alias("path"), text.alias("text"))


