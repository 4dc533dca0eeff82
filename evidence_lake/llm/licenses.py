"""License scans by diagonal voting, with DataFrame functions only.

Templates are phrases and notices. All rolling k-gram hashes of a text's words (k = 2 for phrases, 4
for notices) are joined to the places of the templates. A match at word i of a text and word j of a
template votes for the diagonal i - j. Diagonals of one template that lie within SHIFT of the one
before, as inserted or lost words make them, are merged to a span. Votes are then verified: only words
that equal the template's on their diagonal count. A phrase is found where all its words are on one
diagonal; a notice where the verified words of a span cover enough of the template.

Template places are broadcast only up to MAX_BROADCAST_GRAMS of them. Matches, not texts, are
shuffled, except that verifying joins texts to their diagonals: where those are few, Spark sends
them to the texts, else both are sorted.

Defined cases: a null or empty text has no words and no labels. A row is known by its id and text:
rows that repeat both get equal results, rows that repeat an id with other texts get their own. A
null id stays null. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, stored
from .license_texts import NOTICES, PHRASES

PHRASE_K = 2
NOTICE_K = 4
SHIFT = 3
LEAST_COVERAGE = 0.75
MAX_BROADCAST_GRAMS = 100_000
# All but ASCII digits, letters and what lies above ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    is_phrase: bool = False

    @property
    def k(self) -> int:
        return PHRASE_K if self.is_phrase else NOTICE_K


TEMPLATES = (
    *(Template(label, text, True) for label, text in PHRASES),
    *(Template(label, text) for label, text in NOTICES),
)


def words_of(text: Column) -> Column:
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, -1)
    return F.filter(parts, lambda w: w != "")


def grams(words: str, k: int) -> str:
    """SQL for the hashes of all k-grams of an array of words."""
    parts = ", ".join(f"{words}[i + {o}]" for o in range(k))
    return f"""CASE WHEN size({words}) >= {k} THEN
        transform(sequence(0, size({words}) - {k}), i -> xxhash64({k}, {parts}))
        ELSE array() END"""


def template_words(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    rows = [(t, x.label, x.is_phrase, x.k, x.text) for t, x in enumerate(templates)]
    df = spark.createDataFrame(rows, "t INT, label STRING, is_phrase BOOLEAN, k INT, text STRING")
    return df.select("t", "label", "is_phrase", "k", words_of(F.col("text")).alias("template"))


def template_places(templates: DataFrame) -> DataFrame:
    """hash, t, k and j of every k-gram of every template."""
    hashes = F.when(F.col("k") == PHRASE_K, F.expr(grams("template", PHRASE_K))).otherwise(F.expr(grams("template", NOTICE_K)))
    return templates.select("t", "k", F.posexplode(hashes).alias("j", "hash"))


def row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("_ls_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_ls_text")]


KEY = ["_ls_id", "_ls_text"]


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["_ls_id"].eqNullSafe(right["_ls_id2"]) & (left["_ls_text"] == right["_ls_text2"])


def renamed_key(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"_ls_id": "_ls_id2", "_ls_text": "_ls_text2"})


def diagonals(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key, t, d and js: on diagonal d of template t, the template places whose k-grams match.

    A diagonal holds at most a template's places; a repeated row adds nothing to it.
    """
    n_places = places.count()
    split = docs.select(*row_key(id_col, text_col), words_of(F.col(text_col)).alias("words"))
    rolled = split.select(
        *KEY,
        F.greatest(F.size("words") - (PHRASE_K - 1), F.lit(0)).alias("n2"),
        F.concat(F.expr(grams("words", PHRASE_K)), F.expr(grams("words", NOTICE_K))).alias("hashes"),
    )
    # The outer form: the filter that Spark infers for the other would split a text once for each word.
    rows = rolled.select(*KEY, "n2", F.posexplode_outer("hashes").alias("p", "hash"))
    hint = F.broadcast(places) if n_places <= MAX_BROADCAST_GRAMS else places
    i = F.when(F.col("k") == PHRASE_K, F.col("p")).otherwise(F.col("p") - F.col("n2"))
    matches = rows.join(hint, "hash").select(*KEY, "t", (i - F.col("j")).alias("d"), "j")
    return matches.groupBy(*KEY, "t", "d").agg(F.sort_array(F.collect_set("j")).alias("js"))


def merged(runs: DataFrame) -> DataFrame:
    """Diagonals with the number of the span they belong to. Phrases are not merged."""
    own = Window.partitionBy(*KEY, "t").orderBy("d")
    apart = F.col("is_phrase") | (F.col("d") - F.lag("d", 1).over(own) > SHIFT)
    # One text's diagonals of one template; repeated texts come to one row each.
    numbered = runs.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    return numbered.withColumn("span", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def verified(docs: DataFrame, runs: DataFrame, templates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row with its number of words and, for each diagonal, the template places that hold: each
    word of the k-gram there equals the text's."""
    grouped = runs.groupBy(*KEY).agg(F.collect_list(F.struct("t", "span", "d", "js")).alias("runs"))
    # Templates are few and become constants of the plan.
    known = sorted((r.t, r.k, r.template) for r in templates.collect())
    wording = F.array(*(F.array(*map(F.lit, template)) for _, _, template in known)).alias("_wording")
    sizes = F.array(*(F.lit(k) for _, k, _ in known)).alias("_sizes")
    left = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), words_of(F.col(text_col)).alias("words"))
    right = renamed_key(stored(grouped, "license-diagonals"))
    holds = """transform(coalesce(runs, array()), r -> named_struct('t', r.t, 'span', r.span, 'd', r.d, 'js',
        filter(r.js, j -> slice(words, r.d + j + 1, _sizes[r.t]) = slice(_wording[r.t], j + 1, _sizes[r.t]))))"""
    joined = left.join(right, same_row(left, right), "left").select("*", wording, sizes)
    return joined.select(
        "doc_id", *KEY, F.size("words").cast("long").alias("n_words"), F.expr(holds).alias("runs")
    )


def spans(checked: DataFrame, templates: DataFrame, least: float) -> DataFrame:
    """The operator's spans: key, label, is_phrase, first and last word, and the share of the template
    that is there word by word."""
    rows = checked.where(F.size("runs") > 0).select(*KEY, F.explode("runs").alias("r"))
    rows = rows.select(*KEY, "r.t", "r.span", "r.d", F.explode("r.js").alias("j"))
    places = rows.groupBy(*KEY, "t", "span", "j").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    facts = templates.select("t", "label", "is_phrase", "k", F.size("template").alias("length"))
    joined = places.join(F.broadcast(facts), "t")
    own = Window.partitionBy(*KEY, "t", "span").orderBy("j")
    # A place covers its k words, or as many as there are before the next place.
    covered = F.least(F.coalesce(F.lead("j").over(own) - F.col("j"), F.col("k")), F.col("k"))
    return (
        joined.withColumn("covered", covered)
        .groupBy(*KEY, "t", "span", "label", "is_phrase", "length")
        .agg(
            F.sum("covered").alias("covered"),
            F.min(F.col("j") + F.col("low")).cast("long").alias("first_word"),
            (F.max(F.col("j") + F.col("high") + F.col("k")) - 1).cast("long").alias("last_word"),
        )
        .withColumn("coverage", F.col("covered") / F.col("length"))
        .where(F.when(F.col("is_phrase"), F.col("covered") == F.col("length")).otherwise(F.col("coverage") >= least))
        .drop("covered", "length", "span")
    )


def license_scan(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = LEAST_COVERAGE,
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n_words) and spans (key, t, label, is_phrase, first_word, last_word, coverage)."""
    known = template_words(docs.sparkSession, templates)
    if any(len(t.text) > 1 << 20 for t in templates):
        raise ValueError("a template holds a million characters at most")
    facts = known.select("t", "is_phrase")
    found = diagonals(docs, template_places(known), id_col, text_col).join(F.broadcast(facts), "t")
    checked = stored(verified(docs, merged(found), known, id_col, text_col), "license-runs")
    return checked.select("doc_id", *KEY, "n_words"), stored(spans(checked, known, least), "license-spans")


def license_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Base columns are those of phrases; last_word is where the last phrase starts. score is the
    greatest coverage of a span, 0 without one.
    """
    rows, found = license_scan(docs, **options)
    base = F.col("is_phrase")
    listed = lambda column: F.array_join(F.sort_array(F.collect_set(column)), ",")
    summed = found.groupBy(*KEY).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"),
        F.max("coverage").alias("score"),
    )
    right = renamed_key(summed)
    return rows.join(right, same_row(rows, right), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
