"""License scans: whole texts against licence templates, by the Dice coefficient of word bigrams.

A text is normalised to its lower-case words of letters and digits, so that line breaks and signs say
nothing.  Every window of a template's number of words is compared with it: with ``c`` different template
bigrams in a window of ``n`` different ones and ``g`` of the template, the coefficient is
2 c / (n + g).

Size bounds prune: to reach the limit a text must share at least limit * g / (2 - limit) of a
template's bigrams, so a text with fewer words, or with fewer of these bigrams anywhere, is
not a candidate for it.  Windows start at a template bigram, which loses none that is better.  Of a
candidate's windows, n lies between c (one more, if it has a foreign bigram) and c plus all foreign ones; only
windows that can still be the best are cut out of the text and counted.  Only DataFrame functions are used.

Cases: null or empty text matches nothing; a licence is reported once per document row, with its best
coefficient over its templates and the first window that reaches it (ties: the smaller place);
rows that repeat a doc_id, also a null one, are scanned each on its own; very long texts are
read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.llm.base import settle
from meterflow.llm.license_texts import TEXTS

LIMIT = 0.8
#: A frame of so much over places that are scaled to it, so that windows of all sizes share one frame.
FRAME = 10**7


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams(text: str) -> set[str]:
    w = words(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}  # noqa: B905


def needed(g: int, limit: float = LIMIT) -> int:
    """Bigrams of a template's g that a window must have, whatever else it holds."""
    return math.ceil(limit * g / (2 - limit) - 1e-9)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEXTS, limit: float = LIMIT) -> DataFrame:
    """doc_id, license, dice (six decimals), word: a row per document row and licence found.

    ``word`` is the place, from 0, of the first word of the best window.
    """
    spark = docs.sparkSession
    known = [(i, name, sorted(bigrams(text)), len(words(text))) for i, (name, text) in enumerate(templates)]
    if any(size < 4 for *_, size in known):
        raise ValueError("a template needs at least four words")
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    split = numbered.select("doc_id", "row", F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "").alias("w"))
    n = F.size("w")
    paired = F.when(n >= 2, F.zip_with(F.slice("w", 1, n - 1), F.slice("w", 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    least = min(needed(len(g), limit) for _, _, g, _ in known)
    grams = split.where(n > least).select("doc_id", "row", paired.alias("grams"))
    every = F.array(*[F.lit(x) for x in sorted({x for _, _, g, _ in known for x in g})])
    met = grams.withColumn("met", F.array_intersect("grams", every)).where(F.size("met") >= least)
    fits = [F.when((F.size("grams") >= needed(len(g), limit)) & (F.size(F.array_intersect("met", F.array(*[F.lit(x) for x in g]))) >= needed(len(g), limit)), F.lit(i)) for i, _, g, _ in known]
    # The few texts that may hold a licence, once for each: they are read again for their best windows.  An explode keeps
    # the intersections from being worked out again in a filter.
    hopeful = settle(met.withColumn("template", F.explode(F.array_compact(F.array(*fits)))).select("doc_id", "row", "template", "grams"))
    # A few thousand rows, whatever the documents.
    facts = spark.createDataFrame([(i, name, x, len(g), size) for i, name, g, size in known for x in g], "template int, license string, gram string, g int, size int")
    placed = hopeful.select("doc_id", "row", "template", F.size("grams").alias("total"), F.posexplode("grams").alias("word", "gram"))
    hits = placed.join(F.broadcast(facts), ["template", "gram"])
    scale = F.floor(F.lit(FRAME) / (F.col("size") - 2)).cast("long")
    frame = Window.partitionBy("row", "template").orderBy(F.col("word").cast("long") * scale).rangeBetween(0, FRAME)
    common, found = F.size(F.collect_set("gram").over(frame)), F.count("*").over(frame)
    counted = hits.withColumns({"common": common, "found": found}).where(F.col("common") >= F.ceil(F.lit(limit) * F.col("g") / F.lit(2 - limit) - 1e-9))
    foreign = F.least(F.col("size") - 1, F.col("total") - F.col("word")) - F.col("found")
    dice = lambda n: 2.0 * F.col("common") / (n + F.col("g"))
    bounded = counted.withColumns({"low": dice(F.col("common") + foreign), "high": dice(F.col("common") + F.least(foreign, F.lit(1)))})
    able = bounded.withColumn("least", F.max("low").over(Window.partitionBy("row", "license"))).where(F.col("high") >= F.greatest(F.col("least"), F.lit(limit)) - 1e-6)
    # A window with no foreign bigram, or one, is known already.
    sure = able.where("low = high").select("row", "doc_id", "license", "word", F.col("low").alias("dice"))
    cut = able.where("low < high").select("row", "template", "license", "word", "common", "g", "size").join(hopeful, ["row", "template"])
    counted = cut.select("row", "doc_id", "license", "word", dice(F.size(F.array_distinct(F.slice("grams", F.col("word") + 1, F.col("size") - 1)))).alias("dice"))
    scored = sure.unionByName(counted).where(F.col("dice") >= limit - 1e-9)
    best = scored.groupBy("row", "doc_id", "license").agg(F.min(F.struct((-F.round("dice", 6)).alias("d"), "word")).alias("best"))
    return best.select("doc_id", "license", (-F.col("best.d")).alias("dice"), F.col("best.word").cast("long").alias("word"))


def oracle(templates: list[tuple[str, str]] = TEXTS, limit: float = LIMIT) -> str:
    """The same in DuckDB's SQL, without the pruning."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(k)}, {quoted(body)})" for i, (k, body) in enumerate(templates))
    grams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
with t as (select template, license, len(w) as size, list_distinct({grams}) as g from (select template, license, regexp_extract_all(lower(body), '[a-z0-9]+') as w from (values {rows}) v(template, license, body))),
tg as (select template, license, size, len(g) as g, unnest(g) as gram from t),
d as (select doc_id, row_number() over () as row, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents),
x as (select row, {grams} as gs from d where len(w) >= 2),
p as (select doc_id, row, unnest({grams}) as gram, unnest(range(0, len(w) - 1)) as word from d where len(w) >= 2),
h as (select * from p join tg using (gram)),
c as (select *, count(distinct gram) over (partition by row, template order by word range between current row and (size - 2) following) as common from h),
n as (select c.*, len(list_distinct(x.gs[word + 1:word + size - 1])) as n from c join x using (row) where 2.0 * common / (common + g) >= {limit} - 1e-9),
s as (select row, doc_id, license, word, round(2.0 * common / (n + g), 6) as dice from n where 2.0 * common / (n + g) >= {limit} - 1e-9)
select doc_id, license, max(dice)::double as dice, min_by(word, (-dice, word))::bigint as word from s group by row, doc_id, license"""
