"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along folders.

Units of a file are its whole text (a licence file), its lines, and its blocks: runs of
lines with a letter or digit, so that wrapped notices are one unit. A unit's vector holds
the roots of its terms' counts times their inverse document frequency over the templates;
a term of no template has the greatest one, function words are none. A unit carries the
licence of the template with the highest cosine, if that reaches the threshold. A file
takes the licence of its whole text, or of the title that its first block is, else that
of its best header. Files of the first two kinds declare it for their folder; a file
without a licence of its own inherits that of its nearest folder upwards that declares
one, found by joining folders with their ancestors.

Templates are notices, titles, SPDX lines and the whole texts of short licences; the
whole texts of long ones (say, from a folder) may be added by the parameter.

Only DataFrame operations run. A unit can reach the threshold only if it shares enough
of a template's weight, so it must hold one of the template's ``anchors``: the terms
without which a template's weight stays below the threshold (Cauchy-Schwarz).
Units without an anchor are passed over, which loses nothing. Equal units are scored
once, however many files hold them.

Rules, by case: null text counts as empty and carries no licence; a null path has no
folder and inherits nothing; a text of any length is read whole; ties go to the smaller
licence name; of licences a folder declares, the best scored one counts; files that
repeat path and text get equal results, one row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved
from .licence_texts import NOTICES, SPDX, SPDX_GNU, TEXTS, TITLES

THRESHOLD = 0.75

#: Licence, wording, and whether it is a title: the first block of a licence's text.
TEMPLATES = (
    [(licence, text, False) for licence, text in NOTICES + TEXTS]
    + [(licence, text, True) for licence, text in TITLES]
    + [(licence, f"SPDX-License-Identifier: {licence}", False) for licence in SPDX]
    + [(licence, f"SPDX-License-Identifier: {licence}{which}", False) for licence in SPDX_GNU for which in ("", "-only", "-or-later")]
)
Templates = list[tuple[str, str, bool]]
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: The same for Java, which would run out of stack on a long chain of dots.
JAVA_TERM = TERM + "+"
#: What lies between blocks: lines without a letter or digit.
BLANK = "\n[^A-Za-z0-9]*\n"
BEFORE = "^[^A-Za-z0-9]+"
# Function words, which are no terms.
STOP = "a all an and any are as at be by can do either even for from however if in into is it its may must neither no nor not of on one or other otherwise so such that the this to under was whether with without you your".split()
# Words that prose holds often, which the first filter had better not look for.
COMMON = "a above action all an and any are as at be but by can contract data deal direct do either even event except from goods general however included including international its june kind later list loss may must name names neither no nor notice option other otherwise out particular public rights services shall so special such used way whether whom written your business products caused performance limited code file files following for form forms free http https if in into is it january library met not obtain of on one or person program provided purpose source subject terms that the this to under use v version was with without work you 1 2 3".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(template: str) -> list[str]:
    return [t for t in re.findall(TERM, template.lower()) if t not in STOP]


def idf(templates: Templates = TEMPLATES) -> tuple[dict[str, float], float]:
    """Inverse document frequency of each template term, and of any other."""
    sets = [set(terms_of(text)) for _, text, _ in templates]
    df = Counter(t for s in sets for t in s)
    return {t: log((1 + len(sets)) / (1 + n)) + 1 for t, n in df.items()}, log(1 + len(sets)) + 1


def weights(templates: Templates = TEMPLATES) -> list[tuple[int, str, bool, str, float, float]]:
    """Template number, licence, title or not, term, its weight in the template's unit vector, its idf."""
    table, _ = idf(templates)
    out = []
    for k, (licence, text, title) in enumerate(templates):
        vector = {t: sqrt(n) * table[t] for t, n in Counter(terms_of(text)).items()}
        norm = sqrt(sum(x * x for x in vector.values()))
        out += [(k, licence, title, t, x / norm, table[t]) for t, x in sorted(vector.items())]
    return out


def anchors(threshold: float = THRESHOLD, templates: Templates = TEMPLATES) -> list[str]:
    """Terms of which a unit that reaches ``threshold`` holds one.

    Of every template, the terms that are not anchors weigh less than the threshold.
    Few anchors are wanted: the next is the term that brings the most weight still
    missing, over all templates; words common in prose are the last choice.
    """
    rows = [(k, t, w * w) for k, _, _, t, w, _ in weights(templates)]
    missing = dict.fromkeys(range(len(templates)), 1 - threshold * threshold * (1 - 1e-9))
    out: list[str] = []
    while any(m >= 0 for m in missing.values()):
        gain: Counter[str] = Counter()
        for k, t, w in rows:
            if t not in out and missing[k] >= 0:
                gain[t] += min(w, missing[k] + 1e-9) * (1e-6 if t in COMMON else 1)
        best = max(sorted(gain), key=gain.__getitem__)
        out.append(best)
        for k, t, w in rows:
            if t == best:
                missing[k] -= w
    return sorted(out)


def anchor_pattern(threshold: float, templates: Templates = TEMPLATES) -> str:
    """One of the anchors as a whole term, for texts in small letters; by first letter, so that few are tried."""
    by_first: dict[str, list[str]] = {}
    for a in anchors(threshold, templates):
        by_first.setdefault(a[0], []).append(a[1:])
    return "(?:^|[^a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(map(re.escape, rest))})" for c, rest in by_first.items()) + ")(?![a-z0-9])"


def _terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(JAVA_TERM), F.lit(0)), lambda t: ~t.isin(STOP))


def best_of_units(units: DataFrame, threshold: float, templates: Templates = TEMPLATES) -> DataFrame:
    """For distinct units (h, unit): h, licence, score and whether a title gave it, of those that reach ``threshold``."""
    spark = units.sparkSession
    # The templates' terms: fixed in number, so they may be broadcast.
    table = F.broadcast(spark.createDataFrame(weights(templates), "template int, licence string, title boolean, term string, weight double, idf double"))
    known = F.broadcast(table.select("term", "idf").distinct())
    tf = units.select("h", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("h", "term").agg(F.count("*").alias("tf"))
    _, other = idf(templates)
    valued = tf.join(known, "term", "left").withColumn("x", F.sqrt("tf") * F.coalesce("idf", F.lit(other)))
    norm = valued.groupBy("h").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = valued.filter("idf IS NOT NULL").join(table.drop("idf"), "term").groupBy("h", "template", "licence", "title").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    score = F.floor(F.col("dot") / F.col("norm") * 10000 + 0.5) / 10000
    found = dot.join(norm, "h").withColumn("score", score).filter(F.col("score") >= threshold)
    best = found.groupBy("h").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("licence"), (~F.col("title")).alias("notice"))).alias("b"))
    return best.select("h", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"), (~F.col("b.notice")).alias("title"))


def scan(files: DataFrame, path_col: str, text_col: str, id_col: str, threshold: float = THRESHOLD, templates: Templates = TEMPLATES) -> DataFrame:
    """One row per row of ``files``: doc_id, path, licence, score, via ('file', 'header', 'inherited' or null), declared_in (the folder)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pattern = anchor_pattern(threshold, templates)
    anchored = lambda c: F.lower(c).rlike(pattern)
    path = F.col(path_col)
    row_key = F.md5(F.concat_ws("\0", F.coalesce(F.concat(F.lit("/"), path), F.lit("")), F.md5(text)))
    found = Saved(files.filter(anchored(text)).select(row_key.alias("k"), text.alias("t"))).df
    part = lambda unit, whole=False, first=False: F.struct(F.lit(whole).alias("whole"), F.lit(first).alias("first"), unit.alias("unit"))
    lines = F.transform(F.split("t", "\n"), lambda x: part(x))
    blocks = F.transform(F.split(F.regexp_replace("t", BEFORE, ""), BLANK), lambda x, i: part(x, first=i == 0))
    # A later block of one line is among the lines, and a text of one line is its own only unit.
    several = F.filter(blocks, lambda u: u["first"] | F.contains(u["unit"], F.lit("\n")))
    inner = F.filter(F.concat(lines, several), lambda u: anchored(u["unit"]))
    parts = F.concat(F.array(part(F.col("t"), whole=True)), F.when(F.contains("t", F.lit("\n")), inner).otherwise(F.slice(inner, 1, 0)))
    units = found.select("k", F.explode(parts).alias("u")).select("k", "u.*", F.md5("u.unit").alias("h"))
    best = best_of_units(units.groupBy("h").agg(F.first("unit").alias("unit")), threshold, templates)
    text_of_licence = F.col("whole") | (F.col("first") & F.col("title"))
    order = F.struct((~text_of_licence).alias("part"), (-F.col("score")).alias("s"), F.col("licence").alias("licence"))
    own = units.select("k", "whole", "first", "h").distinct().join(best, "h").groupBy("k").agg(F.min(order).alias("own"), F.min(F.when(text_of_licence, order)).alias("file"))
    cut = F.length(path) - F.length(F.element_at(F.split(path, "/"), -1)) - 1
    rows = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.when(cut >= 0, F.substring(path, F.lit(1), cut)).when(path.isNotNull(), "").alias("folder"), row_key.alias("k")).join(own, "k", "left")
    declared = rows.filter("file IS NOT NULL AND folder IS NOT NULL").groupBy("folder").agg(F.min("file").alias("file"))
    above = rows.filter("own IS NULL AND folder IS NOT NULL").select("folder").distinct()
    steps = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    up = above.select("folder", F.explode(F.array_distinct(up)).alias("ancestor"))
    near = up.join(declared.withColumnRenamed("folder", "ancestor"), "ancestor").groupBy("folder").agg(F.max(F.struct(F.length("ancestor").alias("n"), F.col("ancestor"), F.col("file"))).alias("near"))
    out = rows.join(near, "folder", "left")
    inherited = F.col("own").isNull() & F.col("near").isNotNull()
    via = F.when(F.col("own").isNotNull(), F.when(F.col("own.part"), "header").otherwise("file")).when(inherited, "inherited")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own.licence", "near.file.licence").alias("licence"),
        F.coalesce(-F.col("own.s"), -F.col("near.file.s")).alias("score"),
        via.alias("via"),
        F.when(inherited, F.col("near.ancestor")).alias("declared_in"),
    )


def path_of_document() -> Column:
    """Documents have no paths: their files lie in folders of their source, by hundreds and by tens of thousands of ids."""
    i = F.col("doc_id")
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.expr("doc_id div 10000"), F.expr("doc_id div 100"), i)


def oracle(threshold: float = THRESHOLD) -> str:
    values = ", ".join(f"({k}, '{licence}', {title}, '{t}', {w!r}::DOUBLE, {i!r}::DOUBLE)" for k, licence, title, t, w, i in weights())
    _, other = idf()
    return f"""
WITH template(template, licence, title, term, weight, idf) AS (VALUES {values}),
known AS (SELECT DISTINCT term, idf FROM template),
files AS (SELECT doc_id, coalesce(text, '') AS t, concat_ws('/', coalesce(source, ''), doc_id // 10000, doc_id // 100, doc_id) AS path,
                 concat_ws('/', coalesce(source, ''), doc_id // 10000, doc_id // 100) AS folder FROM documents),
blocks AS (SELECT doc_id, regexp_split_to_array(regexp_replace(t, '{BEFORE}', ''), '{BLANK}') AS b FROM files),
units AS (SELECT doc_id, true AS whole, false AS first, t AS unit FROM files
          UNION ALL SELECT doc_id, false, false, unnest(string_split(t, chr(10))) FROM files
          UNION ALL SELECT doc_id, false, generate_subscripts(b, 1) = 1, unnest(b) FROM blocks),
texts AS (SELECT DISTINCT unit FROM units),
tf AS (SELECT unit, term, count(*) AS tf
       FROM (SELECT unit, unnest(regexp_extract_all(translate(unit, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM texts)
       WHERE term NOT IN ({', '.join(map(repr, STOP))}) GROUP BY unit, term),
valued AS (SELECT unit, tf.term, idf, sqrt(tf) * coalesce(idf, {other!r}::DOUBLE) AS x FROM tf LEFT JOIN known USING (term)),
norms AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM valued GROUP BY unit),
dots AS (SELECT unit, template, licence, title, sum(x * weight) AS dot FROM valued JOIN template USING (term) GROUP BY unit, template, licence, title),
best AS (SELECT unit, licence, title, score FROM
           (SELECT unit, licence, title, floor(dot / norm * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS score FROM dots JOIN norms USING (unit))
         WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, licence, title DESC) = 1),
found AS (SELECT doc_id, whole OR (first AND title) AS file, licence, score FROM units JOIN best USING (unit)),
own AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY file DESC, score DESC, licence) = 1),
declared AS (SELECT folder, licence, score FROM found JOIN files USING (doc_id) WHERE file
             QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, licence) = 1),
near AS (SELECT f.folder, d.folder AS ancestor, d.licence, d.score FROM (SELECT DISTINCT folder FROM files) f
         JOIN declared d ON f.folder = d.folder OR starts_with(f.folder, d.folder || '/') OR d.folder = ''
         QUALIFY row_number() OVER (PARTITION BY f.folder ORDER BY length(d.folder) DESC) = 1)
SELECT doc_id, path, coalesce(o.licence, n.licence) AS licence, coalesce(o.score, n.score) AS score,
       CASE WHEN o.licence IS NOT NULL THEN CASE WHEN o.file THEN 'file' ELSE 'header' END WHEN n.licence IS NOT NULL THEN 'inherited' END AS via,
       CASE WHEN o.licence IS NULL THEN n.ancestor END AS declared_in
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN near n ON f.folder = n.folder
"""
