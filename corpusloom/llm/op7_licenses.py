"""Operator 7 [native]: licence scan by sparse TF-IDF cosine, with inheritance from the nearest ancestor directory.

DataFrame functions only. One pass reads the files and writes what can be a licence header to the shared folder: a text's
pieces are its lines, cut at the ends of sentences; a piece that holds an anchor word starts up to ten windows of one to
WINDOW neighbouring pieces that hold it, so a notice over several lines is one header. Of a file named like a licence file
the whole text is a header too, and the identifiers after SPDX tags count as headers of score 1. All else works on
these rows.

A header's terms are weighted by tf * idf and compared with the weighted terms of the templates: windows with statements,
titles and standard notices (NOTICES), whole files with full licence texts (TEXTS), each table with an idf of its own. The
dot products come from an equi-join on the term with these tables, which are fixed and small (a few hundred rows) and so
are broadcast. Terms outside the table count in a header's norm with the largest idf, so prose that merely mentions a
licence scores low. Versions are templates of their own, so each is told from the others by its number. A file's
own licence is its best header's at COSINE or more, if they share two terms at least; ties go to the smaller id.

Files named as in LICENCE_FILES, in any case and with any extension, declare their licence for their directory. A file
without a licence of its own takes that of the nearest ancestor directory that declares one: each directory's ancestors'
paths are joined with the declarations, the longest wins, and files are joined with their directory. The root is an
ancestor of every path: "" of relative paths, "/" of absolute ones. Directories that several files declare take the
highest score, then the smaller template id.

Cases: null or empty text has no headers; null paths have no ancestors; rows with the same path give a row each; a text of one
very long line is one piece; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch

#: Statements, titles and standard notices of public licences.
NOTICES = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License CC BY 3.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
#: Full texts of the short public licences; callers add those of the long ones.
TEXTS = (
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)
LICENCE_FILES = ("LICENSE", "LICENCE", "COPYING", "NOTICE")
#: Every notice holds one of these, so windows are made around them.
ANCHOR = "(?i)licen[cs]e|redistribution|permission is hereby|spdx|CC BY"
COSINE = 0.6
WINDOW = 4
SPDX = r"(?i)SPDX-License-Identifier:([ \t(]*[A-Za-z0-9.+-]+(?:[ \t)(]+(?:AND|OR|WITH)[ \t(]+[A-Za-z0-9.+-]+)*)"
_NAME = "(?i)^(?:" + "|".join(LICENCE_FILES) + ")(?:[._-].*)?$"
_LATER = r"(-only|-or-later|\+)$"
_SENTENCE_END = r"([.?!;:])[ \t\r]+"


def _terms(text: Column) -> Column:
    """Lower-case terms: runs of ASCII letters and digits, with dots inside numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+|[0-9]+(?:\.[0-9]+)*)"), F.lit(1))


def template_table(docs: DataFrame, notices: tuple = NOTICES) -> DataFrame:
    """(form, licence, term, weight, idf) of some notices (licence, notice), several of a licence perhaps; unit norm per form."""
    rows = docs.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(notices)], "form int, licence string, notice string")
    tf = rows.select("form", "licence", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("form", "licence", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg((F.log(F.lit(1.0 + len(notices)) / (1 + F.count("*"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "form").select("form", "licence", "term", (F.col("w") / F.col("norm")).alias("weight"), "idf")


def windows(text: Column) -> Column:
    """The windows of a text's pieces that hold an anchor, each once."""
    pieces = F.filter(F.split(F.regexp_replace(text, _SENTENCE_END, "$1\n"), "\n"), lambda x: x.rlike("[A-Za-z0-9]"))
    spans = F.array(*[F.struct(F.lit(before).alias("b"), F.lit(n).alias("n")) for n in range(1, WINDOW + 1) for before in range(n)])

    def around(p: Column, i: Column) -> Column:
        fits = F.filter(spans, lambda z: (i - z["b"] >= 1) & (i - z["b"] + z["n"] - 1 <= F.size(p)))
        return F.transform(fits, lambda z: F.array_join(F.slice(p, i - z["b"], z["n"]), " "))

    # the pieces are evaluated once, as the only element of an array
    made = F.transform(F.array(pieces), lambda p: F.flatten(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda i: F.coalesce(F.try_element_at(p, i).rlike(ANCHOR), F.lit(False))), lambda i: around(p, i))))
    return F.array_distinct(F.flatten(made))


def _best(score: Column, licence: Column) -> Column:
    """(score, licence) of the highest score, ties to the smaller licence."""
    return F.min_by(F.struct(score.alias("score"), licence.alias("licence")), F.struct(-score, licence))


def _scored(tf: DataFrame, tables: list[DataFrame], sizes: list[int]) -> DataFrame:
    """(kind, header, x: best score and licence) of the headers at COSINE or more that share two terms at least with a form
    (one alone, as German "mit", isn't a notice), from their term counts (kind, header, term, tf)."""
    import math

    both = [t.withColumn("kind", F.lit(k)) for k, t in enumerate(tables)]
    table = both[0].unionByName(both[1])
    idf = table.select("kind", "term", "idf").distinct()
    top = F.element_at(F.array(*[F.lit(math.log(1 + n) + 1) for n in sizes]), F.col("kind") + 1)
    w = tf.join(F.broadcast(idf), ["kind", "term"], "left").withColumn("w", F.col("tf") * F.coalesce("idf", top)).drop("idf")
    norm = w.groupBy("kind", "header").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = w.join(F.broadcast(table.select("kind", "form", "licence", "term", "weight")), ["kind", "term"]).groupBy("kind", "header", "form", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count("*").alias("shared")).where("shared > 1")
    close = dot.join(norm, ["kind", "header"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= COSINE)
    return close.groupBy("kind", "header").agg(_best(F.col("score"), F.col("licence")).alias("x"))


def license_scan(files: DataFrame, notices: tuple = NOTICES, texts: tuple = TEXTS) -> DataFrame:
    """Per row of ``files`` (path, text, and ``key`` passed through): licence, score, found (own, inherited, none), origin."""
    text, path = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("path").cast("string")
    parts = F.split(path, "/")
    declares = F.coalesce(F.element_at(parts, -1).rlike(_NAME), F.lit(False))
    none = F.array().cast("array<string>")
    known = sorted({k for k, _ in (*notices, *texts)})
    by_id = F.create_map(*[F.lit(x) for k in known for x in (k.lower(), k)])
    tags = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda t: F.split(F.lower(t), r"[ \t()]+")))
    ids = F.array_sort(F.array_distinct(F.array_compact(F.transform(tags, lambda t: F.try_element_at(by_id, F.regexp_replace(t, _LATER, ""))))))
    held = text.rlike(ANCHOR)
    root = F.when(path.startswith("/"), "/").otherwise("")
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    rows = files.select(
        F.monotonically_increasing_id().alias("rid"),
        "key",
        path.alias("path"),
        declares.alias("declares"),
        F.when(path.isNotNull(), F.when(folder == "", root).otherwise(folder)).alias("dir"),
        F.when(held, windows(text)).otherwise(none).alias("windows"),
        F.when(declares & held, text).alias("whole"),
        F.when(held, ids).otherwise(none).alias("ids"),
    )
    rows = Scratch(files.sparkSession, "op7").write(rows, "headers")  # rid is fixed from here on
    headers = F.transform("windows", lambda h: F.struct(F.lit(0).alias("kind"), h.alias("header")))
    headers = F.when(F.col("whole").isNotNull(), F.concat(headers, F.array(F.struct(F.lit(1).alias("kind"), F.col("whole").alias("header"))))).otherwise(headers)
    each = rows.where("size(windows) > 0 or whole is not null").select("rid", F.explode(headers).alias("h")).select("rid", "h.kind", "h.header")
    # the same header in many files is scored once
    tf = each.groupBy("kind", "header").agg(F.lit(1).alias("one")).select("kind", "header", F.explode(_terms(F.col("header"))).alias("term")).groupBy("kind", "header", "term").agg(F.count("*").alias("tf"))
    scored = _scored(tf, [template_table(files, notices), template_table(files, texts)], [len(notices), len(texts)])
    tagged = rows.where("size(ids) > 0").select("rid", F.lit(1.0).alias("score"), F.col("ids")[0].alias("licence"))
    found = each.join(scored, ["kind", "header"]).select("rid", "x.score", "x.licence").unionByName(tagged)
    own = found.groupBy("rid").agg(_best(F.col("score"), F.col("licence")).alias("x")).select("rid", "x.licence", "x.score")
    light = rows.select("rid", "key", "path", "dir", "declares").join(own, "rid", "left")
    declared = own.join(rows.where("declares and path is not null").select("rid", "dir"), "rid").groupBy("dir").agg(_best(F.col("score"), F.col("licence")).alias("x")).select("dir", "x.licence", "x.score")
    # directories are far fewer than files; a directory's ancestors are its leading segments
    dirs = rows.where("dir is not null").select("dir").distinct()
    segments = F.split("dir", "/")
    up = dirs.select(F.col("dir").alias("of"), F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, 1, n), "/"))).alias("dir")).where("dir <> ''")
    nearest = up.join(declared.where("dir not in ('', '/')"), "dir").groupBy("of").agg(F.max_by(F.struct("dir", "licence", "score"), F.length("dir")).alias("y")).withColumnRenamed("of", "dir")
    # every path has a root, so the roots' declarations, two at most, aren't dealt by directory
    roots = declared.where("dir in ('', '/')").select(F.col("dir").alias("root"), F.struct("dir", "licence", "score").alias("z"))
    out = light.join(nearest, "dir", "left").withColumn("root", F.when(F.col("path").startswith("/"), "/").when(F.col("path").isNotNull(), "")).join(F.broadcast(roots), "root", "left")
    out = out.withColumn("y", F.when(F.col("licence").isNull() & F.col("path").isNotNull(), F.coalesce("y", "z")))
    source = F.when(F.col("licence").isNotNull(), "own").when(F.col("y").isNotNull(), "inherited").otherwise("none")
    return out.select("key", "path", F.coalesce("licence", "y.licence").alias("licence"), F.coalesce("score", "y.score").alias("score"), source.alias("found"), F.col("y.dir").alias("origin"))


def _values(rows: tuple) -> str:
    return ", ".join("({}, '{}', '{}')".format(i, k, t.replace("'", "''")) for i, (k, t) in enumerate(rows))


_SQL_TERMS = r"regexp_extract_all(lower({0}), '[a-z]+|[0-9]+(?:\.[0-9]+)*')"
SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, 't' || (doc_id // 1000) || '/' || CASE WHEN doc_id % 1000 = 0 THEN 'LICENSE' WHEN doc_id % 100 = 0 THEN (doc_id // 100) || '/LICENSE' ELSE (doc_id // 100) || '/' || doc_id || '.txt' END AS path FROM documents
), forms(form, licence, notice, kind) AS (SELECT *, 0 FROM (VALUES {_values(NOTICES)}) UNION ALL SELECT *, 1 FROM (VALUES {_values(TEXTS)})),
tf AS (SELECT kind, form, licence, term, count(*) AS tf FROM (SELECT kind, form, licence, unnest({_SQL_TERMS.format('notice')}) AS term FROM forms) GROUP BY ALL),
top AS (SELECT kind, count(*) AS n FROM forms GROUP BY kind),
idf AS (SELECT tf.kind, term, ln((1.0 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf JOIN top ON top.kind = tf.kind GROUP BY 1, 2),
tw AS (SELECT tf.kind, form, licence, tf.term, tf * idf AS w FROM tf JOIN idf ON idf.term = tf.term AND idf.kind = tf.kind),
tn AS (SELECT kind, form, sqrt(sum(w * w)) AS n FROM tw GROUP BY 1, 2),
pieces AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '{_SENTENCE_END}', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS p FROM docs WHERE regexp_matches(text, '{ANCHOR}')),
anchors AS (SELECT doc_id, p, i FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM pieces) WHERE regexp_matches(p[i], '{ANCHOR}')),
wins AS (SELECT DISTINCT doc_id, 0 AS kind, array_to_string(p[i - b : i - b + n - 1], ' ') AS h FROM anchors, range(1, {WINDOW + 1}) x(n), range(0, {WINDOW}) y(b) WHERE b < n AND i - b >= 1 AND i - b + n - 1 <= len(p)
  UNION ALL SELECT doc_id, 1, text FROM docs WHERE path LIKE '%/LICENSE' AND regexp_matches(text, '{ANCHOR}')),
heads AS (SELECT DISTINCT kind, h FROM wins),
ht AS (SELECT kind, h, term, count(*) AS c FROM (SELECT kind, h, unnest({_SQL_TERMS.format('h')}) AS term FROM heads) GROUP BY ALL),
hw AS (SELECT ht.kind, h, ht.term, c * coalesce(idf, ln(1.0 + top.n) + 1) AS w FROM ht JOIN top ON top.kind = ht.kind LEFT JOIN idf ON idf.term = ht.term AND idf.kind = ht.kind),
hn AS (SELECT kind, h, sqrt(sum(w * w)) AS n FROM hw GROUP BY 1, 2),
dots AS (SELECT hw.kind, hw.h, tw.form, tw.licence, sum(hw.w * tw.w) AS dot FROM hw JOIN tw ON tw.term = hw.term AND tw.kind = hw.kind GROUP BY ALL HAVING count(*) > 1),
scores AS (SELECT dots.kind, dots.h, dots.licence, round(dot / hn.n / tn.n, 6) AS score FROM dots JOIN hn ON hn.h = dots.h AND hn.kind = dots.kind JOIN tn ON tn.form = dots.form AND tn.kind = dots.kind),
tags AS (SELECT doc_id, unnest(string_split_regex(lower(tag), '[ \t()]+')) AS id FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{SPDX}', 1)) AS tag FROM docs)),
found AS (SELECT doc_id, licence, score FROM wins JOIN scores ON scores.h = wins.h AND scores.kind = wins.kind WHERE score >= {COSINE}
  UNION ALL SELECT doc_id, f.licence, 1.0 FROM tags JOIN (SELECT DISTINCT licence FROM forms) f ON lower(f.licence) = regexp_replace(id, '{_LATER}', '')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS k FROM found),
files AS (SELECT d.doc_id, d.path, regexp_replace(d.path, '/[^/]*$', '') AS dir, r.licence, r.score FROM docs d LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r ON r.doc_id = d.doc_id),
declared AS (SELECT dir, licence, score, row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) AS k FROM files WHERE licence IS NOT NULL AND path LIKE '%/LICENSE'),
above AS (SELECT f.doc_id, d.dir, d.licence, d.score, row_number() OVER (PARTITION BY f.doc_id ORDER BY length(d.dir) DESC) AS k FROM files f JOIN declared d ON d.k = 1 AND (f.dir = d.dir OR starts_with(f.dir, d.dir || '/')) WHERE f.licence IS NULL)
SELECT f.doc_id, f.path, coalesce(f.licence, a.licence) AS licence, coalesce(f.score, a.score) AS score,
 CASE WHEN f.licence IS NOT NULL THEN 'own' WHEN a.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS found, a.dir AS origin
FROM files f LEFT JOIN (SELECT * FROM above WHERE k = 1) a ON a.doc_id = f.doc_id
"""
