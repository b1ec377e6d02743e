"""Licence scan by a trained paragraph classifier, with DataFrame functions only.

A sparse (elastic-net) multinomial logistic regression over words and word pairs is trained on notices composed from
the fixed templates below and on notice and body paragraphs of the licences (license_texts), plain and inside running
text, against paragraphs of the corpus (a bounded sample,
MAX_UNKNOWN lines of an eighth as many texts), phrases that merely mention licences, and licences of no family: those
are the unknown class. The margin between a family and unknown is calibrated on a held-out quarter and on licences that
the regression hasn't seen.

A paragraph is a block between blank lines (comment marks alone are blank), however its lines are wrapped. It is scored
in overlapping windows of its words, of two SPANS, so that a name within 16 words and a text within 128 stand whole in
one of them. Each family whose confidence passes counts once its templates confirm it: SIMILARITY of the shingles (5
words; shorter templates whole) of one of them stand in the window, and among them one that tells it from each other
licence with shingles in common (the notices of GPL, LGPL and AGPL differ in a word or two).

The scan is row-wise: no shuffle, no Python. Paragraphs that can't reach CONFIDENCE by the fitted weights, slope and
shift, because they have none of the words and pairs that speak most for a family, aren't scored.

Defined cases: null and empty texts have no licence; very long texts are scanned whole, window by window; families that
tie in a window all count; repeated rows get equal rows; an empty table trains on the fixed phrases alone and gives no
rows; only id and text are read, so no other column's name can clash.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stateroll.llm.common import column, table, written
from stateroll.llm.license_texts import BODIES, OTHERS, STRANGERS

CONFIDENCE, SIMILARITY, SHINGLE = 0.5, 0.8, 5
#: Paragraphs of the corpus in the unknown class, and words and pairs in the model besides those of the templates.
MAX_UNKNOWN, MAX_GRAMS = 4_000, 6_000
#: Words of a window and of the step to the next, for names and for bodies.
SPANS = [(32, 16), (256, 128)]
BLANK = r"\n[^\p{L}\p{N}\n]*\n"
BUCKETS = 1024
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"

# How licences are named, by family, and how notices begin; and phrases that name none.
FAMILIES = {
    "apache-2.0": ["apache license, version 2.0", "apache license 2.0", "apache license version 2.0", "apache software license 2.0", "apache-2.0"],
    "bsd-3-clause": ["bsd 3-clause license", "3-clause bsd license", "new bsd license", "bsd-3-clause"],
    "cc-by-4.0": ["cc by 4.0", "creative commons attribution 4.0 international license", "cc-by-4.0"],
    "cc-by-nc-4.0": ["cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license", "cc-by-nc-4.0"],
    "cc-by-sa-4.0": ["cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license", "cc-by-sa-4.0"],
    "cc0-1.0": ["cc0 1.0 universal", "creative commons zero 1.0", "cc0-1.0"],
    "gpl-2.0": ["gnu general public license, version 2", "gnu general public license v2", "gplv2", "gpl-2.0"],
    "gpl-3.0": ["gnu general public license, version 3", "gnu general public license v3", "gplv3", "gpl-3.0"],
    "isc": ["isc license", "internet systems consortium license"],
    "lgpl-3.0": ["gnu lesser general public license, version 3", "lgplv3", "lgpl-3.0"],
    "mit": ["mit license", "the mit license", "mit/x11 license", "expat mit license"],
    "mpl-2.0": ["mozilla public license, version 2.0", "mozilla public license 2.0", "mpl-2.0"],
}
# Identifiers that count after their mark only, alone or as a comment.
IDENTIFIERS = {"gpl-2.0": ["gpl-2.0-only", "gpl-2.0-or-later"], "gpl-3.0": ["gpl-3.0-only", "gpl-3.0-or-later"], "isc": ["isc"], "lgpl-3.0": ["lgpl-3.0-only", "lgpl-3.0-or-later"], "mit": ["mit"]}
MARKS = ["spdx-license-identifier:", "# spdx-license-identifier:", "// spdx-license-identifier:", "* spdx-license-identifier:"]
LEADS = ["", "licensed under", "licensed under the", "released under the", "this work is licensed under the", "distributed under the terms of the", "this software is available under the", "spdx-license-identifier:"]
UNKNOWN = [
    "all rights reserved", "copyright holder", "see the license file for details", "the license of the driver was renewed", "license agreement between the parties", "a custom license applies", "proprietary license", "no license is granted",
    "version 2.0 of the software", "version 3 of the program", "released in version 2", "under the terms of the contract", "the general public was invited", "creative writing is work", "attribution of the source", "international relations", "released under pressure",
    "licensed under a separate agreement", "licensed under an unknown license", "distributed under the trees", "this software is available", "this work is finished", "public license plate", "the universal machine", "the new system", "software of the consortium",
]


def templates() -> list[tuple[str, str]]:
    named = [(family, f"{lead} {name}".strip()) for family, names in FAMILIES.items() for name in names for lead in LEADS]
    marked = [(family, f"{mark} {name}") for family, names in IDENTIFIERS.items() for name in names for mark in MARKS]
    return named + marked + bodies()


def bodies() -> list[tuple[str, str]]:
    return [(family, text.lower()) for family, texts in BODIES.items() for text in texts]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def grams(words: Column) -> Column:
    """Different words and pairs of neighbours."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.concat(words, F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))))


def windows(words: Column) -> Column:
    """Overlapping runs of the words, of the lesser span and, where there are more words, of the greater."""
    n = F.size(words)
    runs = lambda span, step: F.transform(F.sequence(F.lit(0), (F.ceil(F.greatest(n - span, F.lit(0)) / step) * step).cast("int"), F.lit(step)), lambda at: F.slice(words, at + 1, F.lit(span)))
    (short, step), (long, stride) = SPANS
    return F.when(n > short, F.concat(runs(short, step), runs(long, stride))).otherwise(F.array(words))


def fixed_value(value: object, schema: str) -> Column:
    """A constant, as JSON: one literal instead of one for each number."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def template_grams() -> list[str]:
    """Different words and pairs of neighbours of all templates."""
    out: set[str] = set()
    for _, text in templates():
        words = re.findall(TOKEN, text)
        out.update(words, map(" ".join, zip(words, words[1:])))
    return sorted(out)


def local(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A table of few fixed rows, from an SQL VALUES list."""
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)} AS t({names})")


def any_of(grams: list[str]) -> str:
    """A pattern for any of the grams, as a tree by their letters: a position is tried against few branches. A space stands for what lies between words."""
    heads: dict[str, list[str]] = {}
    for g in grams:
        if not g:
            return ""  # one gram ends here: what follows doesn't matter
        heads.setdefault(g[0], []).append(g[1:])
    parts = [("[^a-z0-9]+" if h == " " else re.escape(h)) + any_of(rest) for h, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


class Model:
    """weights: of each gram, one for unknown (first) and one for each family."""

    def __init__(self, families: list[str], bias: list[float], weights: dict[str, list[float]]) -> None:
        self.families, self.bias, self.weights = families, bias, weights
        self.slope, self.shift = 1.0, 0.0

    @cached_property
    def screen(self) -> str:
        """A pattern (of the calibrated model) for grams of which a paragraph must have one to pass; none where it could pass without any.

        Confidence grows with the margin, and the margin is a sum. So the weakest grams that speak for a family may be
        left out as long as all of them together wouldn't reach CONFIDENCE.
        """
        if self.slope <= 0:
            return ""
        least = (math.log(CONFIDENCE / (1 - CONFIDENCE)) - self.shift) / self.slope
        spare = [least - (b - self.bias[0]) for b in self.bias[1:]]
        if min(spare) <= 0:
            return ""
        speaks = {g: [max(x - w[0], 0.0) for x in w[1:]] for g, w in self.weights.items() if max(w[1:]) > w[0]}
        kept = []
        for g, margins in sorted(speaks.items(), key=lambda x: (max(x[1]), x[0])):
            rest = [s - m for s, m in zip(spare, margins, strict=True)]
            if min(rest) > 1e-6:
                spare = rest
            else:
                kept.append(g)
        return f"(?<![a-z0-9]){any_of(sorted(kept))}" if kept else ""

    def scores(self, gs: Column) -> Column:
        # in buckets by a hash: a map is searched from its beginning for each gram
        of: list[dict[str, list[float]]] = [{} for _ in range(BUCKETS)]
        for g, w in sorted(self.weights.items()):
            of[zlib.crc32(g.encode()) % BUCKETS][g] = w
        table = fixed_value(of, "array<map<string,array<double>>>")
        known = F.transform(gs, lambda g: F.try_element_at(F.get(table, (F.crc32(g.cast("binary")) % BUCKETS).cast("int")), g))
        return F.aggregate(F.filter(known, lambda w: w.isNotNull()), F.array(*map(F.lit, self.bias)), lambda total, w: F.zip_with(total, w, lambda a, b: a + b))

    def judged(self, scored: Column) -> Column:
        """Of array<struct<paragraph, scores, joined>>: paragraph, family, confidence and similarity of each family whose confidence passes."""
        names = F.array(*map(F.lit, self.families))
        confidences = lambda p: F.transform(F.slice(p["scores"], 2, len(self.families)), lambda s, i: F.struct(
            F.get(names, i).alias("family"), (1 / (1 + F.exp(-(s - F.element_at(p["scores"], 1)) * self.slope - self.shift))).alias("confidence"),
        ))
        likely = lambda p: F.filter(confidences(p), lambda q: q["confidence"] >= CONFIDENCE)
        return F.flatten(F.transform(scored, lambda p: F.transform(likely(p), lambda q: F.struct(p["paragraph"].alias("paragraph"), q["family"].alias("family"), q["confidence"].alias("confidence"), similarity(q["family"], p["joined"]).alias("similarity")))))


def shingles(text: str) -> list[str]:
    words = re.findall(TOKEN, text)
    return [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


def compared() -> dict[str, list[dict]]:
    """Of each family, its templates: their shingles with a space around each, and for each other licence with some of them, those that it has not."""
    of: dict[str, set[str]] = {}
    for family, text in [*templates(), *((f, t.lower()) for f, texts in OTHERS.items() for t in texts)]:
        of.setdefault(family, set()).update(shingles(text))
    spaced = lambda words: [f" {w} " for w in words]
    out: dict[str, list[dict]] = {f: [] for f in FAMILIES}
    for family, text in templates():
        own = dict.fromkeys(shingles(text))
        apart = [[s for s in own if s not in of[g]] for g in of if g != family and not of[g].isdisjoint(own)]
        out[family].append({"own": spaced(own), "apart": [spaced(x) for x in apart if x]})
    return out


def similarity(family: Column, joined: Column) -> Column:
    """The largest share of a template's shingles that stand in the paragraph (its words, with a space around each); 0 where all that stand are another licence's too."""
    of = fixed_value(compared(), "map<string,array<struct<own:array<string>,apart:array<array<string>>>>>")
    stands = lambda s: F.contains(joined, s)
    shares = F.transform(F.element_at(of, family), lambda t: F.when(F.forall(t["apart"], lambda a: F.exists(a, stands)), F.size(F.filter(t["own"], stands)) / F.size(t["own"])).otherwise(0.0))
    return F.array_max(shares)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, CountVectorizerModel

    spark = docs.sparkSession
    families = sorted(FAMILIES)
    named = "|".join(["licen[sc]e", "copyright", "gpl", "creative commons", "apache", "mozilla", "mit ", "bsd", "cc by", "cc0"])
    # a bounded sample of texts by their hash, then of their lines
    text = column(text_col).cast("string")
    chosen = written(docs.where(text.isNotNull()).select(F.xxhash64(text).alias("th")).distinct().orderBy("th").limit(MAX_UNKNOWN // 8))
    few = docs.join(F.broadcast(chosen), F.xxhash64(text) == F.col("th"), "left_semi")
    lines = few.select(F.explode(F.split(F.lower(text), "\n")).alias("text")).where((F.length("text") > 0) & ~F.col("text").rlike(named))
    corpus = written(lines.select("text", F.xxhash64("text").alias("h")).distinct().orderBy("h", "text").limit(MAX_UNKNOWN))
    named_as = [(families.index(f) + 1, t) for f, t in templates()]
    bodies_as = [(families.index(f) + 1, t) for f, t in bodies()]
    first = len(named_as) - len(bodies_as)
    fixed = local(spark, [(label, t, k, int(k >= first)) for k, (label, t) in enumerate(named_as)], "label, text, k, body")
    # notices also stand inside running text: each once more among words of a corpus paragraph, bodies also among more words
    reach = [(label, t, k, 8) for k, (label, t) in enumerate(named_as)] + [(label, t, len(named_as) + k, 24) for k, (label, t) in enumerate(bodies_as)]
    around = corpus.select(F.split("text", " ").alias("w"), F.row_number().over(_by_hash()).alias("n")).where(F.col("n") <= len(reach))
    inside = local(spark, reach, "label, text, k, reach").join(around, F.col("k") + 1 == F.col("n"))
    inside = inside.select("label", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("reach")), F.array("text"), F.slice("w", F.col("reach") + 1, F.col("reach"))).alias("text"))
    unknown = local(spark, [(0, t) for t in UNKNOWN], "label, text")
    # licences of no family: every second one is learned from, the others only calibrate
    strange = local(spark, [(0, t.lower(), 2 + k % 2) for k, t in enumerate(STRANGERS)], "label, text, body")
    rows = fixed.select("label", "text", "body").union(inside.withColumn("body", F.lit(0))).union(unknown.withColumn("body", F.lit(0))).union(strange).union(corpus.select(F.lit(0), "text", F.lit(0)))
    # a body has few rows: the plain one is always learned from
    held = ((F.col("body") == 0) & (F.pmod(F.xxhash64("text"), F.lit(4)) == 0)) | (F.col("body") == 3)
    rows = written(rows.select("label", held.alias("held"), tokens(F.col("text")).alias("words")).select("label", "held", grams(F.col("words")).alias("grams")))
    # what the templates say is always in the model, however common the corpus' own words are
    said = template_grams()
    frequent = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=MAX_GRAMS + len(said), minDF=2, binary=True).fit(rows).vocabulary
    known = set(said)
    counted = CountVectorizerModel.from_vocabulary(said + [g for g in frequent if g not in known][:MAX_GRAMS], inputCol="grams", outputCol="features")
    counted.setBinary(True)
    fit = LogisticRegression(family="multinomial", elasticNetParam=0.8, regParam=0.0005, maxIter=60).fit(counted.transform(rows.where("NOT held")))
    matrix, bias = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()
    if len(bias) < len(families) + 1:
        raise ValueError("a family has no training notice")
    weights = {g: [round(float(x), 6) for x in matrix[:, k]] for k, g in enumerate(counted.vocabulary) if abs(matrix[:, k]).max() > 1e-6}
    model = Model(families, [round(float(x), 6) for x in bias], weights)
    margins = rows.where("held").select((F.col("label") > 0).cast("int").alias("label"), model.scores(F.col("grams")).alias("s"))
    margins = margins.select("label", (F.array_max(F.slice("s", 2, len(families))) - F.element_at("s", 1)).alias("margin"))
    from pyspark.ml.feature import VectorAssembler

    platt = LogisticRegression(regParam=0.001, standardization=False).fit(VectorAssembler(inputCols=["margin"], outputCol="features").transform(margins))
    model.slope, model.shift = round(float(platt.coefficients[0]), 6), round(float(platt.intercept), 6)
    return model


def _by_hash():
    from pyspark.sql import Window

    return Window.orderBy("h")  # over MAX_UNKNOWN rows at most


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its id and `found`, an array of (paragraph, family, confidence, similarity): each family whose confidence passes in a window of the paragraph."""
    text = F.lower(F.coalesce(column(text_col).cast("string"), F.lit("")))
    blocks = F.transform(F.split(text, BLANK), lambda block, i: F.struct(i.alias("paragraph"), block.alias("text")))
    if screen := model.screen:
        blocks = F.filter(blocks, lambda p: p["text"].rlike(screen))
    words = F.transform("blocks", lambda p: F.struct(p["paragraph"].alias("paragraph"), tokens(p["text"]).alias("words")))
    cut = F.flatten(F.transform("words", lambda p: F.transform(windows(p["words"]), lambda w: F.struct(p["paragraph"].alias("paragraph"), w.alias("words")))))
    scored = F.transform("cut", lambda p: F.struct(p["paragraph"].alias("paragraph"), model.scores(grams(p["words"])).alias("scores"), F.concat(F.lit(" "), F.array_join(p["words"], " "), F.lit(" ")).alias("joined")))
    out = docs.select(column(id_col).alias("id"), blocks.alias("blocks")).select("id", words.alias("words")).select("id", cut.alias("cut")).select("id", scored.alias("scored"))
    return out.select(F.col("id").alias(id_col), model.judged(F.col("scored")).alias("found"))


def licences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its id, licences (confirmed families in order, comma-joined), n_confirmed (families of paragraphs), n_unconfirmed (paragraphs with likely families of which none is confirmed), and best, the highest confidence of a confirmed one (0 if none)."""
    sure = F.filter("found", lambda p: p["similarity"] >= SIMILARITY)
    got = scan(docs, model, id_col, text_col).select(id_col, "found", sure.alias("sure"))
    pairs = F.array_distinct(F.transform("sure", lambda p: F.struct(p["paragraph"], p["family"])))
    return got.select(
        id_col, F.array_join(F.array_sort(F.array_distinct("sure.family")), ",").alias("licences"), F.size(pairs).cast("long").alias("n_confirmed"),
        F.size(F.array_except("found.paragraph", "sure.paragraph")).cast("long").alias("n_unconfirmed"), F.coalesce(F.array_max("sure.confidence"), F.lit(0.0)).alias("best"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences(docs, train(docs))
